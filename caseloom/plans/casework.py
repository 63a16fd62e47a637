"""Queries of chunks, whole envelopes, cases and literature, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunks as C
from ..operators import envelope as E
from ..operators.shared import dealt
from .catalog import _LOOSE, _NEG, query

# A mail of each document: its lines as paragraphs, every third one blank, an image with every fifth.
_SQL_BODY = "case when text is null then null else array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: case when i % 3 = 0 then '  ' || chr(10) || ' ' || chr(10) || x else x end), chr(10) || ' ' || chr(10)) end"


@query(f"""with m as (select doc_id, {_SQL_BODY} as body, source from documents),
p as (select doc_id, unnest(regexp_extract_all(coalesce(body, ''), '(?s).*?(?:\\n\\s*\\n|\\z)')) as piece, generate_subscripts(regexp_extract_all(coalesce(body, ''), '(?s).*?(?:\\n\\s*\\n|\\z)'), 1) - 1 as pos from m),
o as (select *, sum(length(piece)) over (partition by doc_id order by pos) - length(piece) as place, regexp_replace(piece, '^\\s+|\\s+$', '', 'g') as text from p),
c as (select doc_id, 0 as part, 0 as pos, 'm' || doc_id || '.eml:header' as chunk_id, 'From: ' || source || ' <' || source || '@x.org>' || chr(10) || 'Date: ' || chr(10) || 'Subject: S' || chr(10) || 'Message-ID: ' || doc_id as text, 0 as s from m
 union all select doc_id, 1, pos, 'm' || doc_id || '.eml:body:p' || (pos + 1), text, place + length(piece) - length(regexp_replace(piece, '^\\s+', '')) from o where text <> ''
 union all select doc_id, 2, 1, 'photo' || doc_id || '.JPG:image', 'Photographic exhibit asset: photo' || doc_id || '.JPG', null from m where doc_id % 5 = 0)
select doc_id as document_id, part, pos, chunk_id, md5(text) as text_md5, s::int as char_start, case when s is not null then s + length(text) end::int as char_end from c""")
def mail_chunks(t):
    body = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.when((i + 1) % 3 == 0, F.concat(F.lit("  \n \n"), x)).otherwise(x)), "\n \n")
    k = F.col("doc_id").cast("string")
    files = F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("report.pdf"), F.concat(F.lit("photo"), k, F.lit(".JPG")))).otherwise(F.array().cast("array<string>"))
    mails = t("documents").select(F.col("doc_id").alias("document_id"), F.concat(F.lit("m"), k, F.lit(".eml")).alias("filename"), F.col("source").alias("sender"), F.concat("source", F.lit("@x.org")).alias("sender_email"), F.lit(None).cast("string").alias("date"), F.lit("S").alias("subject"), k.alias("message_id"), body.alias("body"), files.alias("attachments"))
    return C.mail_chunks(mails).select("document_id", "part", "pos", "chunk_id", F.md5("text").alias("text_md5"), "char_start", "char_end")


_SQL_LINES = "l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i from documents where text is not null), e as (select doc_id, line, i // 3 + 1 as page, i % 3 as seq from l)"


@query(f"""with {_SQL_LINES}, b as (select distinct doc_id, page from e where (page % 2 = 1 or seq = 1) and page % 5 <> 0), x as (select *, ['block', 'text', 'table_row', 'table', 'image'][case when page % 5 = 0 then 2 when page % 2 = 1 or seq = 1 then 1 when seq = 0 then 3 else 4 + doc_id % 2 end] as kind from e)
select doc_id as document_id, case when kind = 'block' then 'p' || page || ':b' || seq when kind = 'text' then 'p' || page || ':para' || (seq + 1) when kind = 'table_row' then 'p' || page || ':t1:r' || seq when kind = 'table' then 'p' || page || ':tbl' || (seq + 1) else 'p' || page || ':img' || (seq + 1) end as name,
 case when kind = 'block' then case when doc_id % 3 = 0 then 'scanned_page' else 'pdf_text' end when kind = 'text' then 'pdf_text' when kind like 'table%' then 'table_cell' else 'defect_image' end as source_type, kind = 'block' and seq = 0 as has_box, case when kind = 'image' then 0 else length(trim(line)) end as n
from x where case when kind in ('block', 'table_row') then length(trim(line)) >= 3 when kind = 'text' then false when kind = 'table' then trim(line) <> '' else true end
union all select doc_id, 'p' || page || ':para' || (pos + 1), 'pdf_text', false, length(text) from (select doc_id, page, unnest(pieces) as piece, generate_subscripts(pieces, 1) - 1 as pos, regexp_replace(piece, '^\\s+|\\s+$', '', 'g') as text from (select doc_id, page, regexp_extract_all(string_agg(line, chr(10) || chr(10) order by seq), '(?s).*?(?:\\n\\s*\\n|\\z)') as pieces from e where page % 5 = 0 group by all)) where length(text) >= 3""")
def page_chunks(t):
    lines = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).select("doc_id", "line", (F.floor(F.col("i") / 3) + 1).cast("int").alias("page"), (F.col("i") % 3).alias("seq"))
    kind = F.when((F.col("page") % 2 == 1) | (F.col("seq") == 1), "block").when(F.col("seq") == 0, "table_row").when(F.col("doc_id") % 2 == 0, "table").otherwise("image")
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    row = lambda df, kind, seq, text: df.select(F.col("doc_id").alias("document_id"), name.alias("filename"), "page", kind.alias("kind"), seq.alias("seq"), F.lit(0).alias("table_no"), seq.alias("row_no"), text.alias("text"), F.when((kind == "block") & (seq == 0), F.struct(F.lit(1.0).alias("x0"))).alias("box"), (F.col("doc_id") % 3 == 0).alias("scanned"))
    some = row(lines.filter("page % 5 != 0"), kind, F.col("seq"), F.col("line"))
    joined = lines.filter("page % 5 = 0").groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]), "\n\n").alias("all"))
    plain = row(joined, F.lit("text"), F.lit(0), F.col("all"))
    got = C.page_chunks(some.unionByName(plain))
    n = F.when(F.col("is_image"), 0).otherwise(F.length("text"))
    return got.select("document_id", F.expr("substring(chunk_id, instr(chunk_id, ':') + 1)").alias("name"), "source_type", "has_box", n.cast("long").alias("n"))


# Envelopes of parts: four facts each and a payload copy of the first, four candidates of evidence to a fact, some faulty.
_SQL_ENV = f"""f0 as (select p_partkey as e, 0 as origin, u.pos, u.field, u.value, p_brand from part, lateral (values (0, 'patient_age', (p_size * 3)::varchar), (1, 'suspect_product', p_name), (2, 'lot_number', case when p_partkey % 3 = 0 then 'Not stated' else p_brand end), (3, 'adverse_event', p_type)) as u(pos, field, value)),
f as (select *, e || '-' || pos as fact_id, case when value = 'Not stated' then 'NOT_STATED' when (e + pos) % 5 = 0 then 'UNCERTAIN' else 'CONFIRMED' end as status, case when e % 40 = 0 and pos = 1 then 1.5::double else 0.9::double end as confidence from f0),
v as (select f.*, e || '-' || pos || '-' || case when e % 50 = 0 and i = 3 then 0 else i end as evidence_id, i, case when i = 2 and e % 9 = 0 then 'other.pdf' else 'm' || e || '.eml' end as source_id,
 case i when 0 then 'The value is ' || value when 1 then case when e % 2 = 0 then 'the  VALUE is ' || value else 'no known link' end when 2 then case when e % 5 = 0 then ' ' else 'something else' end else 'denies ' || p_brand end as snippet from f, (values (0), (1), (2), (3)) as n(i)),
g as (select *, case when status = 'NOT_STATED' then 'not_stated_guard' when trim(snippet) = '' then 'empty_evidence_guard' end as r1, source_id || '|' || trim(lower(regexp_replace(snippet, '\\s+', ' ', 'g'))) as print from v),
h as (select *, case when r1 is null and row_number() over (partition by e, fact_id, r1 is null, print order by i) > 1 then 'duplicate_candidate_pruned' else r1 end as r2 from g),
k as (select *, case when r2 is null and row_number() over (partition by e, fact_id, r2 is null order by i) > 2 then 'excess_candidate_budget' else r2 end as r3 from h),
j as (select *, coalesce(r3, 'deterministic') as rule, case when r3 is not null then 'INSUFFICIENT' when contains(lower(snippet), lower(trim(value))) then 'SUPPORTS' when length({_LOOSE.format("lower(trim(value))")}) >= 3 and contains({_LOOSE.format("lower(snippet)")}, {_LOOSE.format("lower(trim(value))")}) then 'SUPPORTS' when {_NEG.replace("text", "snippet")} then 'CONTRADICTS' else 'INSUFFICIENT' end as result from k),
s as (select e, fact_id, case when bool_or(result = 'CONTRADICTS') then 'CONTRADICTS' when bool_or(result = 'SUPPORTS') then 'SUPPORTS' else 'INSUFFICIENT' end as state, count(*) filter (result = 'SUPPORTS') as n_supports from j group by all)"""


def envelopes(t):
    """(envelope_id, facts, evidence) as DataFrames."""
    k, none = F.col("p_partkey"), F.lit(None).cast("string")
    fact = lambda origin, pos, field, value: F.struct(F.lit(origin).alias("origin"), F.lit(pos).alias("pos"), F.lit(field).alias("field"), value.alias("value"))
    lot = F.when(k % 3 == 0, "Not stated").otherwise(F.col("p_brand"))
    rows = F.array(fact(0, 0, "patient_age", (F.col("p_size") * 3).cast("string")), fact(0, 1, "suspect_product", F.col("p_name")), fact(0, 2, "lot_number", lot), fact(0, 3, "adverse_event", F.col("p_type")), fact(1, 0, "patient_age", F.lit("copy")))
    e, pos = F.col("envelope_id"), F.col("pos")
    facts = dealt(t("part"), "p_partkey").select(k.alias("envelope_id"), "p_brand", F.inline(rows))
    facts = facts.withColumns({"fact_id": F.concat_ws("-", e, pos), "normalized": none, "notes": none, "status": F.when(F.col("value") == "Not stated", "NOT_STATED").when((e + pos) % 5 == 0, "UNCERTAIN").otherwise("CONFIRMED"), "confidence": F.when((e % 40 == 0) & (pos == 1), 1.5).otherwise(0.9)})
    i, value = F.col("i"), F.col("value")
    held = facts.filter("origin = 0").withColumn("i", F.explode(F.array(*map(F.lit, range(4)))))
    snippet = F.when(i == 0, F.concat(F.lit("The value is "), value)).when(i == 1, F.when(e % 2 == 0, F.concat(F.lit("the  VALUE is "), value)).otherwise("no known link")).when(i == 2, F.when(e % 5 == 0, " ").otherwise("something else")).otherwise(F.concat(F.lit("denies "), F.col("p_brand")))
    evidence = held.select("envelope_id", "fact_id", F.concat_ws("-", e, pos, F.when((e % 50 == 0) & (i == 3), 0).otherwise(i)).alias("evidence_id"), i.alias("pos"), F.when((i == 2) & (e % 9 == 0), "other.pdf").otherwise(F.concat(F.lit("m"), e.cast("string"), F.lit(".eml"))).alias("source_id"), F.lit("email").alias("source_type"), F.lit("").alias("place"), snippet.alias("snippet"), F.lit(1).alias("page"), F.lit(0).alias("char_start"), F.lit(5).alias("char_end"))
    return facts.drop("p_brand"), evidence


@query(f"""with {_SQL_ENV}, n as (select e, count(distinct print) filter (r1 is null) as n_prints, count(*) as n_before, count(*) filter (rule = 'deterministic') as n_after from j group by e)
select e as envelope_id, fact_id, state, n_supports, 4 as n_facts, n_prints, n_before, n_after from s join n using (e)""")
def verify_envelope(t):
    facts, _, metrics = E.verify_envelope(*envelopes(t))
    return facts.join(metrics.hint("merge"), "envelope_id").select("envelope_id", "fact_id", "state", "n_supports", F.col("n_facts").cast("int"), "n_prints", "n_before", "n_after")


@query(f"""with {_SQL_ENV}, o as (select e, fact_id, evidence_id, (row_number() over (partition by e order by pos, i) - 1) // 3 + 1 as batch from j where rule = 'deterministic')
select e as envelope_id, batch::int as batch, count(*) as n_items, string_agg(evidence_id, ',' order by evidence_id) as evidence_ids, max(batch) over (partition by e)::bigint as n_batches from o group by e, batch""")
def verify_batches(t):
    """Verification in batches of three: their items, and each envelope's number of batches."""
    facts, judged, metrics = E.verify_envelope(*envelopes(t), batched=True, most_items=3)
    items = judged.filter("batch is not null").groupBy("envelope_id", "batch").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("evidence_id")), ",").alias("evidence_ids"))
    return items.join(metrics.select("envelope_id", "n_batches").hint("merge"), "envelope_id")


@query(f"""with {_SQL_ENV}, fs as (select f.*, s.state, s.n_supports from f join s using (e, fact_id)),
x as (select e, 'fact' as object, pos::varchar as object_id, 'CONFIDENCE_OUT_OF_BOUNDS' as code, 'ERROR' as severity from f where confidence > 1 union all select e, 'fact', pos::varchar, 'FACT_NORMALIZED_VALUE_IMPLAUSIBLE', 'WARNING' from f where field = 'patient_age' and value::int > 130
 union all select e, 'evidence', evidence_id, 'EVIDENCE_DANGLING_SOURCE', 'ERROR' from j where source_id = 'other.pdf' union all select e, 'evidence', evidence_id, 'EVIDENCE_EMPTY_SNIPPET', 'ERROR' from j where trim(snippet) = ''
 union all select e, 'evidence', evidence_id, 'DUPLICATE_EVIDENCE_ID', 'ERROR' from j where e % 50 = 0 and i = 3
 union all select p_partkey, 'envelope', null, 'CATEGORY_PAYLOAD_MISMATCH_PQC', 'ERROR' from part where p_partkey % 60 = 0
 union all select e, 'fact', pos::varchar, case when state = 'CONTRADICTS' then 'FACT_RECONCILED_TO_CONFLICT' when state = 'SUPPORTS' then 'FACT_RECONCILED_TO_CONFIRMED' else 'FACT_RECONCILED_TO_UNCERTAIN' end, case when state = 'SUPPORTS' then 'INFO' else 'WARNING' end from fs where status <> 'NOT_STATED' and (state = 'CONTRADICTS' or (state = 'SUPPORTS' and status = 'UNCERTAIN') or (state = 'INSUFFICIENT' and status = 'CONFIRMED')))
select e as envelope_id, object, object_id, code, severity, count(*) as n from x group by all""")
def validate_envelope(t):
    return _validated(t)[1].groupBy("envelope_id", "object", "object_id", "code", "severity").agg(F.count("*").alias("n"))


def _validated(t):
    facts, evidence, _ = E.verify_envelope(*envelopes(t))
    k, text = F.col("p_partkey"), lambda when: F.when(when, F.lit("{}"))
    heads = t("part").select(k.alias("envelope_id"), F.lit("Unknown").alias("message_id"), F.concat(F.lit("m"), k.cast("string"), F.lit(".eml")).alias("source_filename"), F.array(F.lit("a.pdf")).alias("attachment_filenames"), F.lit(None).cast("array<string>").alias("source_filenames"), F.lit(0).alias("page_count"),
        F.lit(True).alias("has_icsr"), (k % 60 == 0).alias("has_pqc"), F.lit(False).alias("has_mi"), F.lit(False).alias("has_not_relevant"), F.lit("{}").alias("icsr"), text(F.lit(False)).alias("pqc"), text(F.lit(False)).alias("mi"), text(F.lit(False)).alias("not_relevant"))
    return E.validate_envelope(heads, facts, evidence)


@query(f"""with {_SQL_ENV}, fs as (select f.*, s.state from f join s using (e, fact_id)),
x as (select e, 'ERROR' as severity from f where confidence > 1 union all select e, 'WARNING' from f where field = 'patient_age' and value::int > 130 union all select e, 'ERROR' from j where source_id = 'other.pdf' union all select e, 'ERROR' from j where trim(snippet) = '' union all select e, 'ERROR' from j where e % 50 = 0 and i = 3 union all select p_partkey, 'ERROR' from part where p_partkey % 60 = 0
 union all select e, case when state = 'SUPPORTS' then 'INFO' else 'WARNING' end from fs where status <> 'NOT_STATED' and (state = 'CONTRADICTS' or (state = 'SUPPORTS' and status = 'UNCERTAIN') or (state = 'INSUFFICIENT' and status = 'CONFIRMED'))),
c as (select p_partkey as e, (select count(*) from x where x.e = p_partkey and severity = 'ERROR') as n_error, (select count(*) from x where x.e = p_partkey and severity = 'WARNING') as n_warning from part)
select e as envelope_id, 2::bigint as sources_checked, n_error = 0 as passed, 'Integrity validation completed: Gating=' || case when n_error > 0 then 'BLOCKED_BY_INTEGRITY_ERROR' when n_warning > 0 then 'REVIEW_WITH_WARNINGS' else 'READY_FOR_REVIEW' end || ' (' || n_error || ' errors, ' || n_warning || ' warnings across 4 facts and 16 evidence items).' as summary from c""")
def validation_report(t):
    return _validated(t)[0].select("envelope_id", "sources_checked", "passed", "summary")


@query(f"""with {_SQL_ENV}, w as (select e, field, pos from f where confidence > 1 or pos = 3), p as (select p_partkey as e, p_name, p_type, ['Safety Report (ICSR)', 'PQC', 'Not Relevant'][p_partkey % 3 + 1] as cat, p_partkey % 7 = 0 as photo, ['English', 'fr'][p_partkey % 2 + 1] as lang from part),
i as (select e, 2 as rank, pos, 'CATEGORY_AMBIGUITY' as category, field from f where status = 'UNCERTAIN' union all select e, 3, pos, 'MISSING_CRITICAL_FIELD', field from f join p using (e) where status = 'NOT_STATED' and cat = 'PQC' and field = 'lot_number'
 union all select e, 4, 0, 'PHOTO_DEFECT_INSPECTION', 'defect_photo' from p where photo union all select e, 5, 0, 'MULTILINGUAL_TRANSLATION', 'language_detected' from p where lang = 'fr' union all select e, 6, row_number() over (partition by e order by pos), 'CATEGORY_AMBIGUITY', field from w),
a as (select e, string_agg(category || ':' || field, '|' order by rank, pos) as items, count(*) as n from i group by e), c as (select e, count(*) filter (status = 'CONFIRMED') as confirmed, count(*) filter (status = 'UNCERTAIN') as uncertain, count(*) filter (status = 'NOT_STATED') as unstated from f group by e)
select e as envelope_id, case when e % 4 = 0 then 'file' else 'm' || e end as case_id, case when e % 3 = 0 then 'ICSR: ' || p_name || case when e % 2 = 0 then ' - ' || p_type else '' end when e % 3 = 1 then 'PQC: ' || p_type else 'Non-Pharmacovigilance Communication' end as subject, case when e % 5 = 0 then 'Dr. X (' || p_type || ')' else 'Healthcare Provider / Consumer' end as sender,
 case when photo then 'CRITICAL' when cat like '%ICSR%' then case when e % 2 = 0 then 'CRITICAL' else 'EXPEDITED' end else 'STANDARD' end as urgency, 'AI-prepared case brief for ' || cat || ' (' || confirmed || ' confirmed facts, ' || coalesce(n, 0) || ' attention items).' as summary, coalesce(items, '') as items, unstated as not_stated, case when e % 50 = 0 then 12 else 16 end as evidence_count from p left join a using (e) join c using (e)""")
def build_brief(t):
    facts, evidence = envelopes(t)
    facts, k, none = facts.filter("origin = 0"), F.col("p_partkey"), F.lit(None).cast("string")
    pick = lambda *values: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    cases = t("part").select(
        k.alias("envelope_id"), F.when(k % 4 != 0, F.concat(F.lit("m"), k.cast("string"))).alias("message_id"), F.lit("file").alias("source_filename"), none.alias("received_date"), pick("Safety Report (ICSR)", "PQC", "Not Relevant").alias("primary_category"), F.array().cast("array<string>").alias("categories"),
        (k % 2 == 0).alias("is_multi_label"), pick("English", "fr").alias("language"), (k % 7 == 0).alias("photo"), F.lit("Not stated").alias("document_summary"), F.lit("").alias("reviewer_summary"), F.when(k % 3 == 0, F.col("p_name")).otherwise("Not stated").alias("patient_identifier"), F.when(k % 2 == 0, F.col("p_type")).alias("adverse_event"),
        F.when(k % 3 == 1, F.col("p_type")).alias("pqc_product"), none.alias("defect_type"), none.alias("mi_topic"), none.alias("inquiry_type"), F.when(k % 5 == 0, "Dr. X").otherwise("Not stated").alias("reporter_name"), F.col("p_type").alias("reporter_institution"),
    )
    warnings = facts.filter("confidence > 1 or pos = 3").select("envelope_id", "pos", "field", F.lit("W").alias("code"))
    got = E.build_brief(cases, facts, evidence, warnings)
    return got.select("envelope_id", "case_id", "subject", "sender", "urgency", F.col("executive_summary").alias("summary"), F.array_join("review_focus", "|").alias("items"), "not_stated", F.col("evidence_count").cast("int"))
