"""Registered queries on evidence: hybrid retrieval, fuzzy verification, best evidence, merging, batches, issues, attention."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evidence as E
from ..operators import ledger as L
from ..operators import retrieval as H
from ..operators import review as R
from .catalog import _SQL_STATE, _SQL_TRIAGE, SQL_CHUNKS, SQL_FACTS, SQL_LEDGER, _mail, doc_facts, letters, part_ledger, query

# A word with a letter outside ASCII becomes Z, a word that no lower-cased text holds: RE2 knows word edges in ASCII only.
_FOREIGN = r"[\p{L}\p{N}\p{M}_]*[\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{2AF}\x{370}-\x{1FFF}][\p{L}\p{N}\p{M}_]*"
_TOK = lambda c: f"list_distinct(regexp_extract_all(regexp_replace({c}, '{_FOREIGN}', 'Z', 'g'), '\\b[a-zA-Z0-9.\\-_]{{2,}}\\b'))"
_STOP = "[" + ", ".join(f"'{w}'" for w in H.STOPWORDS) + "]"
_SQL_VECTORS = """{0}_w as (select {1}, regexp_extract_all(lower({2}), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+') as w from {3}),
{0}_g as (select {1}, unnest(w) as g, 2 as k from {0}_w union all select {1}, unnest(list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1])), 3 from {0}_w
 union all select {1}, unnest(flatten(list_transform(w, lambda x: list_transform(range(1, length(x) - 1), lambda i: x[i:i + 2])))), 1 from {0}_w
 union all select {1}, unnest(flatten(list_transform(w, lambda x: list_transform(range(1, length(x) - 2), lambda i: x[i:i + 3])))), 1 from {0}_w),
{0}_b as (select {1}, ('0x' || substr(md5(g), 31, 2))::int & 127 as bucket, sum(k)::bigint as weight from {0}_g group by all), {0}_n as (select {1}, sum(weight * weight)::bigint as n from {0}_b group by all)"""
_SQL_HYBRID = f"""with {SQL_CHUNKS}, {SQL_FACTS}, st as (select * from fa where lower(trim(value)) not in ('not stated', 'none', 'unknown')),
{_SQL_VECTORS.format("f", "document_id, field", "replace(field, '_', ' ') || ' ' || value", "st")}, {_SQL_VECTORS.format("c", "document_id, pos", "text", "ch")},
dots as (select f_b.document_id, field, pos, sum(f_b.weight * c_b.weight)::bigint as dot from f_b join c_b using (document_id, bucket) group by all),
tk as (select st.document_id, field, pos, trim(lower(value)) as v, lower(text) as t, list_filter({_TOK("trim(lower(value))")}, lambda x: not list_contains({_STOP}, x)) as own from st join ch using (document_id)),
lx as (select document_id, field, pos, t, greatest(case when length(v) >= 3 and contains(t, v) then 0.9::double else 0 end, case when len(own) > 0 then len(list_intersect(own, {_TOK("t")})) / len(own) * 0.75::double else 0 end) as s from tk),
ly as (select document_id, field, pos, least(1, s + case when s > 0 and contains(t, field[1:4]) then 0.1::double else 0 end) as lex from lx),
fu as (select ly.*, coalesce(dot / sqrt(f_n.n::double * c_n.n::double), 0) as sem from ly left join dots using (document_id, field, pos) left join f_n using (document_id, field) left join c_n using (document_id, pos)),
rl as (select *, case when sem <= 0 then lex when lex >= 0.7 then 0.65::double * lex + 0.35::double * sem when lex < 0.3 and sem >= 0.4 then 0.3::double * lex + 0.7::double * sem when lex > 0 then 0.5::double * lex + 0.5::double * sem when sem >= 0.4 then sem else 0 end as relevance,
 case when sem <= 0 then 'exact_lexical' when lex >= 0.7 then 'hybrid_lexical_lead' when lex < 0.3 and sem >= 0.4 then 'hybrid_semantic_lead' when lex > 0 then 'hybrid_balanced' else 'semantic' end as strategy from fu),
hy as (select *, row_number() over (partition by document_id, field order by relevance desc, pos) as rank from rl where relevance >= 0.15)"""


def hybrid(t):
    return H.retrieve_hybrid(doc_facts(t), E.chunk_lines(t("documents")))


@query(f"{_SQL_HYBRID} select document_id, field, rank, pos, strategy, {', '.join(f'floor({c} * 1e6::double + 0.5::double) / 1e6::double as {n}' for c, n in (('lex', 'lexical'), ('sem', 'semantic'), ('relevance', 'relevance')))} from hy where rank <= 3")
def hybrid_topk(t):
    return hybrid(t).select("document_id", "field", F.col("rank").cast("long"), F.col("pos").cast("long"), "strategy", *((F.floor(F.col(c) * 1e6 + 0.5) / 1e6).alias(c) for c in ("lexical", "semantic", "relevance")))


def _sometimes(texts: list[str]) -> list[list[float]]:
    """An embedder that fails on texts of 10, 20, 30, … characters."""
    if any(len(x) % 10 == 0 for x in texts):
        raise ValueError("no vector")
    return H.hashed_vectors(pa.array([re.findall(r"\w+", x.lower()) for x in texts], pa.list_(pa.string()))).tolist()


@query(_SQL_HYBRID.replace("f_n.n::double * c_n.n::double", "case when length(replace(field, '_', ' ') || ' ' || sv) % 10 > 0 and length(t) % 10 > 0 then f_n.n::double * c_n.n::double end").replace("select st.document_id, field, pos, trim(lower(value)) as v,", "select st.document_id, field, pos, value as sv, trim(lower(value)) as v,").replace("x as (select document_id, field, pos, t,", "x as (select document_id, field, pos, t, sv,").replace("ly as (select document_id, field, pos,", "ly as (select document_id, field, pos, t, sv,")
  + " select document_id, field, rank, pos, strategy, floor(relevance * 1e6::double + 0.5::double) / 1e6::double as relevance from hy where rank <= 3")
def failing_embedder(t):
    """Retrieval with an embedder that fails on a tenth of the texts: their pairs are scored by words alone."""
    got = H.retrieve_hybrid(doc_facts(t), E.chunk_lines(t("documents")), embed=H.embedder(_sometimes))
    return got.select("document_id", "field", F.col("rank").cast("long"), F.col("pos").cast("long"), "strategy", (F.floor(F.col("relevance") * 1e6 + 0.5) / 1e6).alias("relevance"))


@query(None)
def fuzzy_entailment(t):
    got = hybrid(t).withColumn("e", H.entails_fuzzy(F.col("value"), F.col("text")))
    return got.select("document_id", "field", "rank", "e.result", "e.confidence")


# Items merged so far, as collapsed snippets and ranks (0: none); each step marks the first item that holds, or is held by, the next candidate, or appends it.
_SQL_STEP = """m{n} as (select document_id, field, found, case when len(found) < {n} then items when hit > 0 then list_transform(items, lambda x, i: case when i = hit then {{'s': x.s, 'r': {n}}} else x end) else list_append(items, {{'s': found[{n}], 'r': {n}}}) end as items
 from (select *, coalesce(list_position(list_transform(items, lambda x: contains(x.s, found[{n}]) or contains(found[{n}], x.s)), true), 0) as hit from m{p}))"""
_COLLAPSED = "trim(lower(regexp_replace({}, '\\s+', ' ', 'g')))"


@query(f"""{_SQL_STATE}, fd as (select document_id, field, list({_COLLAPSED.format("text")} order by rank) as found from rk where rank <= 3 group by all),
m0 as (select document_id, field, found, [{{'s': {_COLLAPSED.format("string_split(d.text, chr(10))[1]")}, 'r': 0}}] as items from fd join documents d on d.doc_id = document_id), {", ".join(_SQL_STEP.format(n=n, p=n - 1) for n in (1, 2, 3))}
select document_id, field, len(items)::int as n, array_to_string(list_transform(items, lambda x: case when x.r = 0 then '-' else x.r::varchar end), ',') as ranks from m3""")
def evidence_merge(t):
    """The first line of each document as its facts' evidence, merged with what retrieval finds."""
    item = lambda snippet, relevance, rank: F.struct(F.lit("s").alias("source_id"), snippet.alias("snippet"), relevance.cast("double").alias("relevance"), rank.cast("int").alias("rank"))
    got = E.retrieve(doc_facts(t), E.chunk_lines(t("documents")))
    found = got.groupBy("document_id", "field").agg(F.array_sort(F.collect_list(F.struct("rank", "text", "relevance"))).alias("f"))
    docs = t("documents").select(F.col("doc_id").alias("document_id"), F.split("text", "\n")[0].alias("first"))
    none = F.lit(None)
    rows = found.join(docs.hint("merge"), "document_id").withColumn("all", H.merge_evidence(F.array(item(F.col("first"), none, none)), F.transform("f", lambda x: item(x["text"], x["relevance"], x["rank"]))))
    return rows.select("document_id", "field", F.size("all").alias("n"), F.array_join(F.transform("all", lambda x: x["rank"].cast("string")), ",", "-").alias("ranks"))


# Facts of whole envelopes, one for each document: the ledger (origin 0) and a payload section (1) which repeats the title and holds more.
_SQL_PARTS = """d1 as (select *, string_split(text, chr(10)) as ln from documents),
pf as (select doc_id as envelope_id, u.* from d1, lateral (values (0, 0, 'title', ln[1], 'CONFIRMED'), (0, 1, 'source', source, case when doc_id % 4 = 0 then 'NOT_STATED' else 'UNCERTAIN' end), (0, 2, 'unstated', 'Not stated', 'CONFIRMED'),
 (1, 0, 'title', ln[1], 'CONFIRMED'), (1, 1, 'lab_language', lang, 'CONFIRMED'), (1, 2, 'ending', ln[-1], case when doc_id % 3 = 0 then 'NOT_STATED' else 'CONFIRMED' end)) as u(origin, pos, field, value, status)),
fa as (select distinct envelope_id as document_id, field, value from pf where status <> 'NOT_STATED')"""


def envelope_parts(t):
    """(facts, their evidence so far: the first line of each document for its title in the ledger and its ending in the payload)."""
    d = t("documents").withColumn("ln", F.split("text", "\n"))
    own, last = F.col("doc_id"), F.element_at("ln", -1)
    row = lambda origin, pos, field, value, status: F.struct(F.lit(origin).alias("origin"), F.lit(pos).alias("pos"), F.lit(field).alias("field"), value.alias("value"), status.alias("status"))
    sure = F.lit("CONFIRMED")
    parts = [
        row(0, 0, "title", F.col("ln")[0], sure), row(0, 1, "source", F.col("source"), F.when(own % 4 == 0, "NOT_STATED").otherwise("UNCERTAIN")), row(0, 2, "unstated", F.lit("Not stated"), sure),
        row(1, 0, "title", F.col("ln")[0], sure), row(1, 1, "lab_language", F.col("lang"), sure), row(1, 2, "ending", last, F.when(own % 3 == 0, "NOT_STATED").otherwise(sure)),
    ]
    facts = d.select(own.alias("envelope_id"), own.alias("document_id"), F.inline(F.array(*parts)))
    had = d.select(own.alias("envelope_id"), F.explode(F.array(F.struct(F.lit(0).alias("origin"), F.lit(0).alias("pos")), F.struct(F.lit(1).alias("origin"), F.lit(2).alias("pos")))).alias("of"), F.lit(0).alias("place"), own.cast("string").alias("source_id"), F.col("ln")[0].alias("snippet"))
    return facts, had.select("envelope_id", "of.*", "place", "source_id", "snippet")


_SQL_PART_HYBRID = _SQL_HYBRID.replace("document_id, field", "document_id, field, value").replace(SQL_FACTS, _SQL_PARTS)
_SQL_PART_HYBRID = _SQL_PART_HYBRID.replace("least(1, s + case when s > 0 and contains(t, field[1:4]) then 0.1::double else 0 end)", "least(case when starts_with(field, 'lab_') then 0.88::double else 1 end, s + case when s > 0 and contains(t, replace(field, 'lab_', '')[1:4]) then 0.1::double else 0 end)")


@query(f"""{_SQL_PART_HYBRID}, fd as (select document_id, field, value, list({_COLLAPSED.format("ch.text")} order by rank) as found from hy join ch using (document_id, pos) where rank <= 3 group by all),
m0 as (select envelope_id, origin, pf.pos, pf.field, case when status = 'NOT_STATED' or found is null then []::varchar[] else found end as found, case when (origin, pf.pos) in ((0, 0), (1, 2)) then [{{'s': {_COLLAPSED.format("ln[1]")}, 'r': 0}}] else [] end as items
 from pf join d1 on doc_id = envelope_id left join fd on fd.document_id = envelope_id and fd.field = pf.field and fd.value = pf.value), {", ".join(_SQL_STEP.format(n=n, p=n - 1).replace("document_id, field", "envelope_id, origin, pos, field") for n in (1, 2, 3))}
select envelope_id, origin, pos, field, len(items)::int as n, array_to_string(list_transform(items, lambda x: case when x.r = 0 then '-' else x.r::varchar end), ',') as ranks from m3""")
def envelope_retrieval(t):
    facts, had = envelope_parts(t)
    got = H.retrieve_for_envelopes(facts, had, E.chunk_lines(t("documents")))
    return got.select("envelope_id", "origin", "pos", "field", F.size("items").alias("n"), F.array_join(F.transform("items", lambda x: F.coalesce(x["rank"].cast("string"), F.lit("-"))), ",").alias("ranks"))


# Evidence made of the lines of documents, with attributes by position, the same in both engines.
_SQL_EVIDENCE = f"""{SQL_CHUNKS}, ev as (select ch.document_id, pos, ch.text as snippet, string_split(d.text, chr(10))[1] as value, ['email', 'pdf', 'image', 'table_cell'][pos % 4 + 1] as source_type, ['SUPPORTS', 'CONTRADICTS', 'INSUFFICIENT', null][((ch.document_id + pos) % 4 + 1)::int] as result,
 (pos % 5)::double / 4 as confidence, (pos % 7)::double / 7 as relevance, case when pos % 2 = 1 then pos end as page, pos % 8 = 1 as has_box, case when pos % 3 = 0 then 0 end as char_start, case when pos % 3 = 0 then length(ch.text) end as char_end, case when pos % 5 = 2 then 'body' end as section
 from ch join documents d on d.doc_id = ch.document_id)"""


def evidence(t):
    docs = t("documents").select(F.col("doc_id").alias("document_id"), F.split("text", "\n")[0].alias("value"))
    p, even = F.col("pos"), lambda names, i: F.element_at(F.array(*map(F.lit, names)), i.cast("int") + 1)
    rows = E.chunk_lines(t("documents")).withColumnRenamed("text", "snippet").join(docs.hint("merge"), "document_id")
    return rows.withColumns({
        "source_type": even(("email", "pdf", "image", "table_cell"), p % 4), "result": even(("SUPPORTS", "CONTRADICTS", "INSUFFICIENT", None), (F.col("document_id") + p) % 4), "confidence": (p % 5) / 4.0, "relevance": (p % 7) / 7.0,
        "page": F.when(p % 2 == 1, p), "has_box": p % 8 == 1, "char_start": F.when(p % 3 == 0, 0), "char_end": F.when(p % 3 == 0, F.length("snippet")), "section": F.when(p % 5 == 2, "body"),
    })


_GROUNDED = """(v in ('', 'not stated', 'unknown', 'none') or contains(s, v) or len(list_filter(regexp_extract_all(v, '[0-9]+'), lambda d: length(d) >= 2 and contains(s, d))) > 0
 or len(list_filter(regexp_extract_all(v, '[\\p{L}\\p{N}\\p{M}_]+'), lambda w: length(w) >= 3 and contains(s, w))) > 0)"""


@query(f"""with {_SQL_EVIDENCE}, sc as (select *, case when result = 'SUPPORTS' or {_GROUNDED} then case when result = 'SUPPORTS' then 50 + 20 * confidence when result = 'INSUFFICIENT' then 10::double else 0 end
 + case when has_box and page is not null and source_type in ('pdf', 'image') then 100 when char_end > char_start and source_type not in ('pdf', 'image') then 80 when page is not null and source_type in ('pdf', 'image') then 40 when section <> '' then 20 else 5 end::double + 10 * relevance else -500::double end as score
 from (select *, trim(lower(value)) as v, lower(snippet) as s from ev) where result is distinct from 'CONTRADICTS'), rk as (select *, row_number() over (partition by document_id order by score desc, pos) as rn from sc)
select document_id, pos, round(score, 6) as score from rk where rn = 1""")
def best_evidence(t):
    return H.best_evidence(evidence(t), ["document_id"]).select("document_id", F.col("pos").cast("long").alias("pos"), F.round("score", 6).alias("score"))


@query(f"""with {_SQL_EVIDENCE} select source_type, case when (has_box and source_type in ('pdf', 'image')) or (source_type = 'email' and char_start is not null) then 'LEVEL_1_EXACT_VISUAL' when page > 0 then 'LEVEL_2_PAGE_TEXT' else 'LEVEL_3_SNIPPET_ONLY' end as level, count(*) as n from ev group by 1, 2""")
def citation_levels(t):
    level = H.citation_level(F.col("source_type"), F.col("page"), F.col("has_box"), F.col("char_start"), F.col("char_end"))
    return evidence(t).groupBy("source_type", level.alias("level")).agg(F.count("*").alias("n"))


_SQL_TASKS = """tk as (select l_suppkey as s, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) as rn, l_partkey % 40 as e, length('line_' || l_linenumber) + length(l_returnflag) + 80 as item, least((l_partkey % 40) * 20, 403) + 80 as once from lineitem)"""


@query(f"""with recursive {_SQL_TASKS}, run as (select s, rn, 1 as batch, 1 as items, item + once as chars, [e] as seen from tk where rn = 1
 union all select tk.s, tk.rn, case when o.closed then o.batch + 1 else o.batch end, case when o.closed then 1 else o.items + 1 end, case when o.closed then 0 else o.chars end + item + case when not o.closed and list_contains(o.seen, e) then 0 else once end, case when o.closed then [e] else list_append(o.seen, e) end
 from (select *, items >= 30 or chars >= 25000 as closed from run) o join tk on tk.s = o.s and tk.rn = o.rn + 1)
select s as l_suppkey, batch, count(*) as n_items, max(chars)::bigint as chars from run group by 1, 2""")
def greedy_batches(t):
    e = F.col("l_partkey") % 40
    tasks = t("lineitem").select(
        "l_suppkey", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice").alias("pos"), e.alias("evidence_id"),
        F.concat(F.lit("line_"), F.col("l_linenumber").cast("string")).alias("field"), F.col("l_returnflag").alias("value"), F.repeat(F.lit("x"), (e * 20).cast("int")).alias("snippet"),
    )
    return H.batches(tasks, "l_suppkey").groupBy("l_suppkey", "batch").agg(F.count("*").alias("n_items"), F.max("chars").alias("chars"))


_SQL_FAULTY = """ev as (select l_orderkey as envelope_id, case when l_partkey % 41 = 0 then '' else 'e' || l_linenumber || '-' || l_partkey end as evidence_id, case when l_partkey % 37 = 0 then ' ' when l_partkey % 31 = 0 then 'other.eml' else 'mail' || l_suppkey || '.eml' end as source_id, ['mail' || l_suppkey || '.eml.zip', 'x.pdf'] as known_sources,
 case when l_partkey % 29 = 0 then 'fax' else 'pdf' end as source_type, case when l_partkey % 23 = 0 then '' else l_returnflag end as snippet, (l_partkey % 13 - 1)::int as page, 10 as page_count, (l_linenumber - 2)::int as char_start, (l_partkey % 9)::int as char_end,
 case when l_partkey % 19 = 0 then 'MAYBE' when l_partkey % 2 = 0 then 'SUPPORTS' else 'INSUFFICIENT' end as result, case when l_partkey % 17 = 0 then 1.5::double when l_partkey % 3 = 0 then 0::double else 0.5::double end as confidence, case when l_partkey % 5 = 0 then 'fallback' when l_partkey % 5 < 3 then 'rule' end as method from lineitem)"""


@query(f"""with {_SQL_FAULTY}, r as (select envelope_id, evidence_id, unnest([case when trim(evidence_id) = '' then 'EVIDENCE_MISSING_ID:ERROR' end, case when trim(source_id) = '' then 'EVIDENCE_EMPTY_SOURCE:ERROR' end, case when source_id = 'other.eml' then 'EVIDENCE_DANGLING_SOURCE:ERROR' end,
 case when source_type = 'fax' then 'EVIDENCE_INVALID_TYPE:ERROR' end, case when snippet = '' then 'EVIDENCE_EMPTY_SNIPPET:ERROR' end, case when page < 1 then 'EVIDENCE_INVALID_PAGE:ERROR' end, case when page > page_count then 'EVIDENCE_PAGE_EXCEEDS_TOTAL:ERROR' end,
 case when char_start < 0 or char_end < char_start then 'EVIDENCE_INVALID_OFFSETS:ERROR' end, case when result = 'MAYBE' then 'VERIFICATION_UNKNOWN_RESULT:ERROR' end, case when confidence > 1 then 'CONFIDENCE_OUT_OF_BOUNDS:ERROR' end,
 case when method = 'fallback' and result = 'SUPPORTS' then 'VERIFICATION_FALLBACK_ILLEGAL_SUPPORT:ERROR' end, case when method is null and result = 'INSUFFICIENT' and confidence = 0 then 'VERIFICATION_UNVERIFIED_CANDIDATE:WARNING' end]) as x from ev)
select split_part(x, ':', 1) as code, split_part(x, ':', 2) as severity, count(*) as n, count(distinct envelope_id) as n_envelopes from r where x is not null group by 1, 2""")
def issues_evidence(t):
    p, n = F.col("l_partkey"), F.col("l_linenumber")
    own = F.concat(F.lit("mail"), F.col("l_suppkey").cast("string"), F.lit(".eml"))
    rows = t("lineitem").select(
        F.col("l_orderkey").alias("envelope_id"), F.when(p % 41 == 0, "").otherwise(F.concat(F.lit("e"), n.cast("string"), F.lit("-"), p.cast("string"))).alias("evidence_id"),
        F.when(p % 37 == 0, " ").when(p % 31 == 0, "other.eml").otherwise(own).alias("source_id"), F.array(F.concat(own, F.lit(".zip")), F.lit("x.pdf")).alias("known_sources"),
        F.when(p % 29 == 0, "fax").otherwise("pdf").alias("source_type"), F.when(p % 23 == 0, "").otherwise(F.col("l_returnflag")).alias("snippet"), (p % 13 - 1).alias("page"), F.lit(10).alias("page_count"),
        (n - 2).alias("char_start"), (p % 9).alias("char_end"), F.when(p % 19 == 0, "MAYBE").when(p % 2 == 0, "SUPPORTS").otherwise("INSUFFICIENT").alias("result"),
        F.when(p % 17 == 0, 1.5).when(p % 3 == 0, 0.0).otherwise(0.5).alias("confidence"), F.when(p % 5 == 0, "fallback").when(p % 5 < 3, "rule").alias("method"),
    )
    return L.evidence_issues(rows).groupBy("code", "severity").agg(F.count("*").alias("n"), F.countDistinct("envelope_id").alias("n_envelopes"))


_SQL_STATED = f"""with {SQL_LEDGER}, vf as (select *, ['SUPPORTS', 'CONTRADICTS', 'INSUFFICIENT'][((envelope_id * 3 + pos * 5) % 7 % 3 + 1)::int] as state from st)"""


def verified(t):
    i = ((F.col("envelope_id") * 3 + F.col("pos") * 5) % 7 % 3 + 1).cast("int")
    return part_ledger(t).withColumn("state", F.element_at(F.array(F.lit("SUPPORTS"), F.lit("CONTRADICTS"), F.lit("INSUFFICIENT")), i))


@query(f"""{_SQL_STATED}, x as (select *, case when status = 'NOT_STATED' then status when state = 'CONTRADICTS' then 'CONFLICT' when state = 'SUPPORTS' and status = 'UNCERTAIN' then 'CONFIRMED' when state = 'INSUFFICIENT' and status = 'CONFIRMED' then 'UNCERTAIN' else status end as new from vf)
select envelope_id, pos, new as status, case when new <> status then 'FACT_RECONCILED_TO_' || new end as code, case when new <> status then case when new = 'CONFIRMED' then 'INFO' else 'WARNING' end end as severity,
 case when new <> status then case when pos = 0 then 'read twice | ' else '' end || 'Status reconciled from ' || status || case new when 'CONFLICT' then ' to CONFLICT due to contradictory evidence.' when 'CONFIRMED' then ' to CONFIRMED based on supporting evidence.' else ' to UNCERTAIN: candidate evidence is INSUFFICIENT to verify.' end when pos = 0 then 'read twice' end as notes from x""")
def reconcile_status(t):
    rows = verified(t).withColumn("notes", F.when(F.col("pos") == 0, "read twice"))
    return L.reconcile(rows).select("envelope_id", "pos", "status", "code", "severity", "notes")


@query(f"""{_SQL_STATED}, x as (select envelope_id, pos, unnest([case when envelope_id % 3 = 0 and trim(lower(value)) not in ('not stated', '') then 'FACT_NOT_STATED_INCONSISTENT_VALUE' end, case when pos % 2 = 0 and state = 'SUPPORTS' then 'FACT_NOT_STATED_HAS_SUPPORTING_EVIDENCE' end, case when state = 'SUPPORTS' then 'FACT_NOT_STATED_VERIFICATION_SUPPORTED' end]) as code
 from vf where status = 'NOT_STATED' or envelope_id % 4 = 0) select envelope_id, pos, code, 'ERROR' as severity from x where code is not null""")
def issues_unstated(t):
    e = F.col("envelope_id")
    rows = verified(t).withColumn("status", F.when(e % 4 == 0, "NOT_STATED").otherwise(F.col("status"))).withColumn("normalized", F.when(e % 3 == 0, F.col("value")))
    return L.unstated_issues(rows.withColumn("n_supports", F.when((F.col("pos") % 2 == 0) & (F.col("state") == "SUPPORTS"), 1).otherwise(0)))


@query("""with f as (select distinct l_orderkey as e, l_linenumber as pos, 'line_' || l_linenumber as field, l_returnflag as s from lineitem)
select a.e as envelope_id, a.pos, a.field, string_agg(b.field, ',' order by b.pos) as related from f a join f b on a.e = b.e and a.s = b.s and a.field <> b.field group by a.e, a.pos, a.field, a.s""")
def related_facts(t):
    rows = t("lineitem").select(F.col("l_orderkey").alias("envelope_id"), F.col("l_linenumber").alias("pos"), F.concat(F.lit("line_"), F.col("l_linenumber").cast("string")).alias("field"), F.col("l_returnflag").alias("snippet")).distinct()
    return L.related(rows).withColumn("related", F.array_join("related", ","))


_SQL_ATTENTION = f"""{SQL_LEDGER}, s as (select envelope_id, case status when 'NOT_STATED' then 7 when 'UNCERTAIN' then 8 else 9 end as rule, pos, case status when 'NOT_STATED' then case when field = 'p_name' then field || ' is not stated in source documentation.' end
 when 'UNCERTAIN' then field || ' is marked uncertain (''' || value || ''') — reviewer verification required.' when 'CONFLICT' then 'Discrepancy detected for ' || field || ' (''' || value || ''') across source materials — resolve conflict.' end as text from st),
g as (select p_partkey as envelope_id, 0 as rule, unnest([0, 1, 2, 3, 4]) as pos, unnest([case when p_partkey % 4 = 0 then 'Dual regulatory domain (ICSR & PQC); review across both safety and quality workflows.' end, case when p_partkey % 3 = 0 then '{L.CRITICAL_CASE}' when p_partkey % 3 = 1 and p_partkey % 2 = 0 then '{L.EXPEDITED_CASE}' end,
 case when p_partkey % 5 = 0 then '{L.PHOTO}' end, case when p_partkey % 6 = 0 then 'Non-English source documentation (Spanish); verify verbatim original text against extraction.' end, case when p_partkey % 7 = 1 then '{L.HANDWRITTEN}' end]) as text from part),
a as (select * from s union all select * from g)"""


@query(f"""with {_SQL_ATTENTION} select p_partkey as envelope_id, case when p_partkey % 10 = 9 then '{L.CLOSE_IT}' else coalesce(x, '') end as sentences from part left join (select envelope_id, string_agg(text, '|' order by rule, pos) as x from a where text is not null group by 1) on envelope_id = p_partkey""")
def attention_list(t):
    k = F.col("p_partkey")
    cases = t("part").select(
        k.alias("envelope_id"), (k % 10 == 9).alias("not_relevant"), (k % 4 == 0).alias("multi"), F.array(F.lit("ICSR"), F.lit("PQC")).alias("categories"), F.when(k % 3 == 0, "CRITICAL").when(k % 3 == 1, "EXPEDITED").otherwise("STANDARD").alias("urgency"),
        (k % 2 == 0).alias("has_icsr"), (k % 5 == 0).alias("photo"), F.when(k % 6 == 0, "Spanish").alias("language"), (k % 7 == 1).alias("handwritten"),
    )
    return L.attention(cases, part_ledger(t), ["p_name"]).withColumn("sentences", F.array_join("sentences", "|"))


@query(f"""with {_SQL_TRIAGE}, c as (select o_orderkey, i or not (q or m or s) as has_icsr, q as has_pqc, m and not i as has_mi, s and not (i or q or m) as has_nr, o_orderkey % 5 as k from tr)
select o_orderkey as envelope_id, code, 'ERROR' as severity from (select o_orderkey, unnest([case when has_icsr and k = 0 then 'CATEGORY_PAYLOAD_MISMATCH_ICSR' end, case when has_pqc and k = 1 then 'CATEGORY_PAYLOAD_MISMATCH_PQC' end, case when has_mi and k = 2 then 'CATEGORY_PAYLOAD_MISMATCH_MI' end, case when has_nr and k = 3 then 'CATEGORY_PAYLOAD_MISMATCH_NOT_RELEVANT' end, case when has_nr then 'CATEGORY_NOT_RELEVANT_POLLUTED' end]) as code from c) where code is not null""")
def payload_mismatch(t):
    i, q, m, s = (T.any_of(F.col("text"), T.TRIAGE[k]) for k in ("ICSR", "PQC", "MI", "SPAM"))
    k, there = F.col("o_orderkey") % 5, F.lit("record")
    rows = letters(t).select(
        F.col("o_orderkey").alias("envelope_id"), (i | ~(q | m | s)).alias("has_icsr"), q.alias("has_pqc"), (m & ~i).alias("has_mi"), (s & ~(i | q | m)).alias("has_not_relevant"),
        *(F.when(k != n, there).alias(c) for n, c in enumerate(("icsr", "pqc", "mi", "not_relevant"))),
    )
    return L.payload_issues(rows)


@query("""select 'm-' || doc_id as message_id, case when doc_id % 6 = 0 then 'REVIEWED' else ['RECEIVED', 'PROCESSING', 'TRIAGED', 'FAILED', 'REVIEWED'][(doc_id % 5 + 1)::int] end as status from documents""")
def accept_actions(t):
    actions = _mail(t, "doc_id % 6 = 0").select("message_id", F.lit("ana").alias("reviewer_username"), F.lit("2025-01-01").alias("ts"))
    return R.accept(_mail(t), actions)[0].select("message_id", "status")


@query("""with a as (select doc_id, sha256(text) as h from documents where doc_id % 9 <> 0), b as (select doc_id, sha256(case when doc_id % 8 = 0 then text || 'x' else text end) as h from documents where doc_id % 11 <> 0)
select doc_id, case when b.h is null then 'missing' when a.h is null then 'unlisted' else 'changed' end as kind from a full join b using (doc_id) where a.h is distinct from b.h""")
def manifest_match(t):
    d = t("documents")
    files = d.filter("doc_id % 11 != 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 8 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("digest"))
    return R.matched(d.filter("doc_id % 9 != 0").select("doc_id", F.sha2("text", 256).alias("digest")), files, "doc_id", "digest")
