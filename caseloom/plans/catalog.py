"""Registered queries: each applies library operators to whole tables; most have the same query in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evidence as E
from ..operators import ingest as I
from ..operators import ledger as L
from ..operators import retrieval as H
from ..operators import review as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    """Register a function of (table reader) under its name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


# Templated letters from orders, the same expression in both engines.
LETTER = """concat(case cast(o_orderkey % 8 as int) when 0 then 'Patient had an adverse reaction and was hospitalized; ' when 1 then 'Broken seal and particulate in the vial; '
 when 2 then 'Question on dosing and stability; ' when 3 then 'Conference invitation, early bird registration; ' when 4 then 'Adverse event and packaging breach of the lot; '
 when 5 then 'Crushed tablets through an ng tube; ' when 6 then 'The patient shows a new syndrome; ' else 'General letter; ' end, o_orderpriority)"""
# A parts ledger with faults by key, the same in both engines.
PART_FIELDS = ["p_name", "p_type", "p_brand", "p_partkey", "p_size"]
SQL_LEDGER = """led as (select p_partkey as envelope_id, u.pos, u.field, u.value from part, lateral (values (0, 'p_name', case when p_partkey % 7 = 0 then 'Not stated' else p_name end),
 (1, 'p_type', case when p_partkey % 11 = 0 then '' else p_type end), (2, 'p_brand', p_brand), (3, 'p_partkey', cast(p_partkey as varchar)), (4, 'p_size', cast(p_size as varchar))) as u(pos, field, value)),
st as (select *, case when lower(trim(value)) in ('not stated', 'none', 'unknown', '') then 'NOT_STATED' when (envelope_id + pos) % 5 = 0 then 'UNCERTAIN' when (envelope_id + pos) % 17 = 0 then 'CONFLICT' else 'CONFIRMED' end as status from led)"""
SQL_CHUNKS = """ln as (select doc_id as document_id, unnest(string_split(text, chr(10))) as text, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents),
ch as (select * from ln where trim(text) <> '')"""
SQL_TOKENS = """list_distinct(list_filter(regexp_extract_all(lower({}), '[a-z0-9._\\-]{{2,}}'), lambda x: true))"""
SQL_FACTS = """fa as (select doc_id as document_id, 'title' as field, string_split(text, chr(10))[1] as value from documents
 union all select doc_id, 'source', source from documents union all select doc_id - 1, 'foreign', string_split(text, chr(10))[1] from documents where doc_id > 0
 union all select doc_id, 'unstated', 'Not stated' from documents)"""


def letters(t) -> DataFrame:
    return t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.expr(LETTER).alias("text"))


def part_ledger(t) -> DataFrame:
    p = t("part").withColumn("p_name", F.when(F.col("p_partkey") % 7 == 0, "Not stated").otherwise(F.col("p_name"))).withColumn("p_type", F.when(F.col("p_partkey") % 11 == 0, "").otherwise(F.col("p_type")))
    facts = L.unfold(p, "p_partkey", PART_FIELDS)
    declared = F.when((F.col("envelope_id") + F.col("pos")) % 5 == 0, "UNCERTAIN").when((F.col("envelope_id") + F.col("pos")) % 17 == 0, "CONFLICT")
    return L.with_status(facts.withColumn("declared", declared), "declared").drop("declared")


def doc_facts(t) -> DataFrame:
    d = t("documents").withColumn("first", F.split("text", "\n")[0])
    row = lambda key, field, value: d.select(key.alias("document_id"), F.lit(field).alias("field"), value.alias("value"))
    own = F.col("doc_id")
    return row(own, "title", F.col("first")).unionByName(row(own, "source", F.col("source"))).unionByName(row(own - 1, "foreign", F.col("first")).filter("document_id >= 0")).unionByName(row(own, "unstated", F.lit("Not stated")))


@query("select page_id, length(regexp_replace(html, '<[^>]*>', ' ', 'g')) as n_chars, md5(regexp_replace(html, '<[^>]*>', ' ', 'g')) as body_md5 from pages")
def html_body_text(t):
    return t("pages").select("page_id", F.length(T.strip_tags(F.col("html"))).cast("long").alias("n_chars"), F.md5(T.strip_tags(F.col("html"))).alias("body_md5"))


@query("""with r as (select s_suppkey, case when s_suppkey % 3 = 0 then s_name else '"' || s_name || '" <supplier' || s_suppkey || '@example.org>' end as raw from supplier)
select s_suppkey, case when raw like '%<%' then trim(replace(split_part(raw, '<', 1), '"', '')) else raw end as sender, case when raw like '%<%' then trim(regexp_extract(raw, '<([^>]*)>', 1)) else raw end as sender_email from r""")
def sender_split(t):
    raw = F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).otherwise(F.concat(F.lit('"'), F.col("s_name"), F.lit('" <supplier'), F.col("s_suppkey").cast("string"), F.lit("@example.org>")))
    return t("supplier").withColumn("raw", raw).select("s_suppkey", T.sender_name(F.col("raw")).alias("sender"), T.sender_address(F.col("raw")).alias("sender_email"))


def _mail(t, where=None):
    m = t("documents").select(F.concat(F.lit("m-"), F.col("doc_id").cast("string")).alias("message_id"), F.element_at(F.array(*map(F.lit, ("RECEIVED", "PROCESSING", "TRIAGED", "FAILED", "REVIEWED"))), (F.col("doc_id") % 5 + 1).cast("int")).alias("status"), "doc_id")
    return m.filter(where) if where else m


SQL_MAIL = "mail as (select 'm-' || doc_id as message_id, ['RECEIVED', 'PROCESSING', 'TRIAGED', 'FAILED', 'REVIEWED'][(doc_id % 5 + 1)::int] as status, doc_id from documents)"


@query(f"with {SQL_MAIL} select message_id from mail where doc_id % 3 <> 0")
def ingest_new_only(t):
    return I.new_only(_mail(t), _mail(t, "doc_id % 3 = 0")).select("message_id")


@query(f"with {SQL_MAIL} select message_id from mail where doc_id % 3 = 0 and status = 'RECEIVED'")
def ingest_pending_retry(t):
    return I.pending(_mail(t), _mail(t, "doc_id % 3 = 0")).select("message_id")


@query(f"with {SQL_MAIL} select message_id, case when doc_id % 4 = 1 then 'RECEIVED' else status end as status from mail")
def replace_rows(t):
    return I.replace(_mail(t), _mail(t, "doc_id % 4 = 1").withColumn("status", F.lit("RECEIVED"))).select("message_id", "status")


@query(f"with {SQL_MAIL} select message_id, status from mail where status in ('TRIAGED', 'REVIEWED') or regexp_matches(message_id, '7$')")
def purge_stale(t):
    return I.purge(_mail(t), "7$").select("message_id", "status")


@query("""with d as (select doc_id, sha256(coalesce(text, '')) as content_hash from documents), c as (select content_hash, min(doc_id) as first_id from d group by content_hash having count(*) > 1)
select doc_id, first_id is not null as hit, first_id from d left join c using (content_hash)""")
def content_cache_hits(t):
    hashed = t("documents").withColumn("content_hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    cache = hashed.groupBy("content_hash").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return I.with_cached(t("documents"), cache).select("doc_id", F.col("first_id").isNotNull().alias("hit"), "first_id")


@query(f"""with {SQL_CHUNKS.replace("from ln where", ", sum(length(text) + 1) over (partition by document_id order by pos) - length(text) - 1 as s from ln qualify")}
select document_id, count(*) as n_chunks, sum(length(text))::bigint as n_chars, max(s)::bigint as last_start from ch group by document_id""")
def chunk_lines(t):
    return E.chunk_offsets(t("documents")).groupBy("document_id").agg(F.count("*").alias("n_chunks"), F.sum(F.length("text")).alias("n_chars"), F.max("char_start").alias("last_start"))


@query("""with r as (select o_orderkey, case (o_orderkey % 6)::int when 0 then strftime(o_orderdate, '%Y-%m-%d') when 1 then strftime(o_orderdate, '%d/%m/%Y') when 2 then strftime(o_orderdate, '%d.%m.%Y')
 when 3 then strftime(o_orderdate, '%d-%B-%Y') when 4 then 'on ' || strftime(o_orderdate, '%Y-%m-%d') || ' noted' else 'Not stated' end as raw, o_orderdate from orders)
select o_orderkey, raw, case when raw = 'Not stated' then null else strftime(o_orderdate, '%Y-%m-%d') end as iso from r""")
def normalize_dates(t):
    d, k = F.col("o_orderdate"), (F.col("o_orderkey") % 6).cast("int")
    raw = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "dd/MM/yyyy")).when(k == 2, F.date_format(d, "dd.MM.yyyy")).when(k == 3, F.date_format(d, "dd-MMMM-yyyy")).when(k == 4, F.concat(F.lit("on "), F.date_format(d, "yyyy-MM-dd"), F.lit(" noted"))).otherwise("Not stated")
    return t("orders").select("o_orderkey", raw.alias("raw")).withColumn("iso", T.iso_date(F.col("raw")))


@query("""select n_nationkey, case when lower(n_name) in ('united states', 'us', 'usa') then 'United States' when lower(n_name) = 'united kingdom' then 'United Kingdom' when lower(n_name) in ('germany', 'france', 'spain', 'italy', 'japan') then upper(n_name[1]) || lower(n_name[2:])
 else array_to_string(list_transform(string_split(trim(lower(n_name)), ' '), lambda w: upper(w[1]) || w[2:]), ' ') end as country from nation""")
def normalize_countries(t):
    return t("nation").select("n_nationkey", T.country(F.col("n_name")).alias("country"))


@query("""with c as (select c_custkey, case (c_custkey % 4)::int when 0 then c_custkey % 90 || ' YRS' when 1 then 'aged ' || c_custkey % 90 when 2 then 'unknown' else 'old' end as a, case (c_custkey % 3)::int when 0 then 'F' when 1 then 'male' else 'other' end as s from customer)
select c_custkey, case when a = 'unknown' then null else try_cast(regexp_extract(a, '([0-9]+)', 1) as int) end as age, case s when 'F' then 'Female' when 'male' then 'Male' else 'Other' end as sex from c""")
def normalize_age_sex(t):
    k = F.col("c_custkey")
    a = F.when(k % 4 == 0, F.concat((k % 90).cast("string"), F.lit(" YRS"))).when(k % 4 == 1, F.concat(F.lit("aged "), (k % 90).cast("string"))).when(k % 4 == 2, "unknown").otherwise("old")
    s = F.when(k % 3 == 0, "F").when(k % 3 == 1, "male").otherwise("other")
    return t("customer").select("c_custkey", T.age(a).alias("age"), T.sex(s).alias("sex"))


@query("""with m as (select o_orderkey, case (o_orderkey % 5)::int when 0 then 'given orally' when 1 then 'i.v. drip' when 2 then 'subcutaneous' when 3 then 'none given' else 'n/a' end as r from orders)
select o_orderkey, case r when 'given orally' then 'Oral' when 'i.v. drip' then 'Intravenous' when 'subcutaneous' then 'Subcutaneous' when 'n/a' then null when 'none given' then 'Intravenous' else 'Other' end as route from m""")
def normalize_routes(t):
    k = F.col("o_orderkey") % 5
    return t("orders").select("o_orderkey", T.route(F.when(k == 0, "given orally").when(k == 1, "i.v. drip").when(k == 2, "subcutaneous").when(k == 3, "none given").otherwise("n/a")).alias("route"))


@query("select p_partkey, lower(regexp_replace(regexp_replace(p_type, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '[^A-Za-z0-9]+', '_', 'g')) as snake, regexp_replace(lower(p_name), '[^a-zA-Z0-9_]', '_', 'g') as field_key from part")
def field_labels(t):
    return t("part").select("p_partkey", T.snake(F.col("p_type")).alias("snake"), T.field_key(F.col("p_name")).alias("field_key"))


_T = lambda words: "(" + " or ".join(f"contains(lower(text), '{w}')" for w in words) + ")"
_SQL_TRIAGE = f"""le as (select o_orderkey, o_orderstatus, {LETTER} as text from orders), fl as (select *, {_T(T.TRIAGE["ICSR"])} as i, {_T(T.TRIAGE["PQC"])} as q, {_T(T.TRIAGE["MI"])} as m, {_T(T.TRIAGE["SPAM"])} as s from le),
tr as (select *, case when i and q then 'ICSR' when q then 'PQC' when m and not i then 'MI' when s then 'Not Relevant' else 'ICSR' end as primary_category, i and q as multi, case when i and q then 0.95::double when q then 0.96::double when m and not i then 0.95::double when s then 0.99::double else 0.88::double end as confidence from fl)"""


@query(f"with {_SQL_TRIAGE} select o_orderkey, primary_category, multi, confidence from tr")
def keyword_triage(t):
    return letters(t).withColumn("x", T.triage(F.col("text"))).select("o_orderkey", F.col("x.primary").alias("primary_category"), "x.multi", "x.confidence")


@query(f"with {_SQL_TRIAGE} select primary_category, o_orderstatus, count(*) as n, count(*) filter (multi) as n_multi from tr group by all")
def triage_counts(t):
    return letters(t).withColumn("x", T.triage(F.col("text"))).groupBy(F.col("x.primary").alias("primary_category"), "o_orderstatus").agg(F.count("*").alias("n"), F.count_if("x.multi").alias("n_multi"))


@query(f"with {_SQL_TRIAGE} select o_orderkey, case when primary_category = 'ICSR' then 'icsr_reports' when primary_category = 'PQC' then 'pqc_reports' when primary_category = 'MI' then 'mi_reports' end as target, case when multi and confidence < 0 or (primary_category = 'ICSR' and multi) then 'CRITICAL' when primary_category = 'ICSR' then 'EXPEDITED' else 'STANDARD' end as urgency from tr where primary_category <> 'Not Relevant'")
def category_routing(t):
    rows = letters(t).withColumn("x", T.triage(F.col("text"))).filter("x.primary != 'Not Relevant'")
    target = F.concat(F.lower("x.primary"), F.lit("_reports"))
    return rows.select("o_orderkey", target.alias("target"), L.urgency(F.lit(False), F.col("x.primary") == "ICSR", F.col("x.multi")).alias("urgency"))


@query(f"with le as (select o_orderkey, {LETTER} as text from orders) select o_orderkey, contains(lower(text), 'patient') and (contains(lower(text), 'adverse') or contains(lower(text), 'syndrome')) as reportable from le")
def literature_reportable(t):
    low = F.lower("text")
    return letters(t).select("o_orderkey", (low.contains("patient") & (low.contains("adverse") | low.contains("syndrome"))).alias("reportable"))


@query(f"with {SQL_LEDGER} select envelope_id, pos, field, value, status from st")
def fact_ledger(t):
    return part_ledger(t)


@query(f"with {SQL_LEDGER} select envelope_id, max(value) filter (field = 'p_name') as p_name, max(value) filter (field = 'p_brand') as p_brand, max(value) filter (field = 'p_size') as p_size from led group by envelope_id")
def fact_wide_pivot(t):
    return L.fold(part_ledger(t), ["p_name", "p_brand", "p_size"])


_SQL_ISSUES = f"""{SQL_LEDGER}, f as (select *, case when envelope_id % 13 = 0 and pos = 2 then '' when envelope_id % 19 = 0 and pos > 2 then 'dup' else envelope_id || '-' || pos end as fact_id, case when envelope_id % 9 = 0 then 1.5::double when pos = 1 then null else 0.9::double end as confidence,
 case when envelope_id % 29 = 0 and pos = 3 then 'NOT_STATED' when envelope_id % 23 = 0 and pos = 4 then 'OPEN' else status end as st2 from st),
iss as (select envelope_id, pos, 'FACT_MISSING_ID' as code, 'ERROR' as severity from f where trim(fact_id) = '' union all select envelope_id, pos, 'FACT_INVALID_STATUS', 'ERROR' from f where st2 not in ('CONFIRMED', 'UNCERTAIN', 'CONFLICT', 'NOT_STATED')
 union all select envelope_id, pos, 'CONFIDENCE_OUT_OF_BOUNDS', 'ERROR' from f where confidence is not null and not confidence between 0 and 1
 union all select envelope_id, pos, 'NOT_STATED_INCONSISTENT_VALUE', 'ERROR' from f where st2 = 'NOT_STATED' and lower(trim(value)) not in ('not stated', 'unknown', 'none', 'n/a', '', 'not reported')
 union all select envelope_id, pos, 'DUPLICATE_FACT_ID', 'ERROR' from (select *, row_number() over (partition by envelope_id, fact_id order by pos) as rn from f where trim(fact_id) <> '') where rn > 1)"""


def faulty(t) -> DataFrame:
    e, p = F.col("envelope_id"), F.col("pos")
    rows = part_ledger(t).withColumn("fact_id", F.when((e % 13 == 0) & (p == 2), "").when((e % 19 == 0) & (p > 2), "dup").otherwise(F.concat_ws("-", e, p)))
    rows = rows.withColumn("confidence", F.when(e % 9 == 0, 1.5).when(p != 1, 0.9))
    return rows.withColumn("status", F.when((e % 29 == 0) & (p == 3), "NOT_STATED").when((e % 23 == 0) & (p == 4), "OPEN").otherwise(F.col("status")))


@query(f"with {_SQL_ISSUES} select * from iss")
def issues_facts(t):
    return L.fact_issues(faulty(t)).unionByName(L.repeated_ids(faulty(t)))


@query(f"with {_SQL_ISSUES} select envelope_id, count(*) filter (severity = 'ERROR') as n_error, count(*) filter (severity = 'WARNING') as n_warning, count(*) filter (severity = 'INFO') as n_info, case when count(*) filter (severity = 'ERROR') > 0 then 'BLOCKED' when count(*) filter (severity = 'WARNING') > 0 then 'REVIEW_WITH_WARNINGS' else 'READY_FOR_REVIEW' end as gate from iss group by envelope_id")
def gating(t):
    return L.gating(L.fact_issues(faulty(t)).unionByName(L.repeated_ids(faulty(t))))


@query("""with f as (select l_orderkey as envelope_id, l_linenumber as pos, lower(trim(l_returnflag)) as k, lower(trim(l_linestatus)) as v from lineitem)
select envelope_id, k as field_key, count(*) as n, case when count(distinct v) > 1 then 'DUPLICATE_CONFLICTING_FACT' else 'DUPLICATE_REDUNDANT_FACT' end as code, case when count(distinct v) > 1 then 'WARNING' else 'INFO' end as severity from f group by 1, 2 having count(*) > 1""")
def issues_duplicates(t):
    return L.duplicate_fields(t("lineitem").select(F.col("l_orderkey").alias("envelope_id"), F.col("l_linenumber").alias("pos"), F.col("l_returnflag").alias("field"), F.col("l_linestatus").alias("value")))


@query(f"with {SQL_LEDGER} select envelope_id, count(*) as total, count(*) filter (status = 'CONFIRMED') as confirmed, count(*) filter (status = 'UNCERTAIN') as uncertain, count(*) filter (status = 'CONFLICT') as conflict, count(*) filter (status = 'NOT_STATED') as not_stated from st group by 1")
def brief_stats(t):
    return L.status_counts(part_ledger(t))


@query(f"""with {SQL_LEDGER} select envelope_id, pos, field, case status when 'CONFLICT' then 1 when 'UNCERTAIN' then 2 else 3 end as "order", case status when 'CONFLICT' then 'conflict' when 'UNCERTAIN' then 'uncertain' else 'missing' end as kind from st where status in ('CONFLICT', 'UNCERTAIN') or (status = 'NOT_STATED' and field = 'p_name')""")
def focus_items(t):
    return L.focus_items(part_ledger(t), ["p_name"])


_SQL_STATE = f"""with {SQL_CHUNKS}, {SQL_FACTS}, sc as (select fa.document_id, field, value, pos, ch.text, greatest(case when length(trim(lower(value))) >= 3 and contains(lower(ch.text), trim(lower(value))) then 0.9::double else 0 end,
 case when len({SQL_TOKENS.format("value")}) > 0 then 0.75 * len(list_intersect({SQL_TOKENS.format("value")}, {SQL_TOKENS.format("ch.text")})) / len({SQL_TOKENS.format("value")}) else 0 end) as relevance
 from fa join ch on fa.document_id = ch.document_id where lower(trim(value)) not in ('not stated', 'none', 'unknown')),
rk as (select *, row_number() over (partition by document_id, field order by relevance desc, pos) as rank from sc where relevance >= 0.15)"""


@query(f"{_SQL_STATE} select document_id, field, rank, pos, round(relevance, 6) as relevance from rk where rank <= 3")
def lexical_topk(t):
    got = E.retrieve(doc_facts(t), E.chunk_lines(t("documents")))
    return got.select("document_id", "field", F.col("rank").cast("long"), F.col("pos").cast("long"), F.round("relevance", 6).alias("relevance"))


_NEG = " or ".join(f"contains(lower(text), '{p}')" for p in E.NEGATIONS)
_LOOSE = "regexp_replace({}, '[,.\\s\\-_/()]', '', 'g')"
_SQL_ENTAIL = f"""{_SQL_STATE}, en as (select document_id, field, rank, case when contains(lower(text), lower(trim(value))) then 'SUPPORTS' when length({_LOOSE.format("lower(trim(value))")}) >= 3 and contains({_LOOSE.format("lower(text)")}, {_LOOSE.format("lower(trim(value))")}) then 'SUPPORTS' when {_NEG} then 'CONTRADICTS' else 'INSUFFICIENT' end as result from rk where rank <= 3)"""


@query(f"{_SQL_ENTAIL} select document_id, field, case when bool_or(result = 'CONTRADICTS') then 'CONTRADICTS' when bool_or(result = 'SUPPORTS') then 'SUPPORTS' else 'INSUFFICIENT' end as state, count(*) as n_evidence from en group by 1, 2")
def fact_state(t):
    got = E.retrieve(doc_facts(t), E.chunk_lines(t("documents"))).withColumn("e", E.entails(F.col("value"), F.col("text")))
    return E.fact_state(got.select("document_id", "field", F.col("e.result").alias("result")), ["document_id", "field"])


@query(f"{_SQL_ENTAIL} select field, result, count(*) as n, count(distinct document_id) as n_documents from en group by 1, 2")
def verify_metrics(t):
    got = E.retrieve(doc_facts(t), E.chunk_lines(t("documents"))).withColumn("e", E.entails(F.col("value"), F.col("text")))
    return got.groupBy("field", F.col("e.result").alias("result")).agg(F.count("*").alias("n"), F.countDistinct("document_id").alias("n_documents"))


@query(f"""with {SQL_CHUNKS}, w as (select document_id, pos, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_full_match(x, '\\p{{L}}{{2,}}')) as w from ch),
g as (select document_id, unnest(w) as g, 2 as k from w union all select document_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), 3 from w),
b as (select document_id, ('0x' || substr(md5(g), 31, 2))::int & 127 as bucket, sum(k) as weight from g group by 1, 2)
select document_id, sum(weight * weight)::bigint as norm2, count(*) as n_buckets from b group by 1""")
def hash_embedding_norms(t):
    lines = H.gram_vectors(E.chunk_lines(t("documents")).select("document_id", "text"), F.col("text"), r"(?U)\b[^\W\d_]{2,}\b", (), " ")
    buckets = lines.select("document_id", F.posexplode("vector").alias("bucket", "weight")).filter("weight > 0").groupBy("document_id", "bucket").agg(F.sum("weight").alias("weight"))
    return buckets.groupBy("document_id").agg(F.sum(F.col("weight") * F.col("weight")).alias("norm2"), F.count("*").alias("n_buckets"))


@query("""with a as (select e.vec_id, e.embedding as x, f.embedding as y from embeddings e join embeddings f on f.vec_id = e.vec_id + 1)
select vec_id, round(greatest(0, list_sum(list_transform(range(1, len(x) + 1), lambda i: x[i]::double * y[i]::double)) / sqrt(list_sum(list_transform(x, lambda v: v::double * v::double)) * list_sum(list_transform(y, lambda v: v::double * v::double)))), 4) as cosine from a""")
def vector_cosine(t):
    v = t("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    pair = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)
    return pair.select("vec_id", F.round(F.greatest(F.lit(0.0), dot("x", "y") / F.sqrt(dot("x", "x") * dot("y", "y"))), 4).alias("cosine"))


@query(f"""with {SQL_CHUNKS}, c as (select *, row_number() over (partition by document_id, trim(lower(regexp_replace(text, '\\s+', ' ', 'g'))) order by pos) > 1 as copy from ch),
p as (select *, not copy and row_number() over (partition by document_id, copy order by pos) > 2 as pruned from c)
select document_id, count(*) as n, count(*) filter (copy) as copies, count(*) filter (pruned) as pruned from p group by 1""")
def evidence_dedupe_prune(t):
    rows = E.chunk_lines(t("documents")).withColumn("field", F.lit("any")).withColumn("source_id", F.lit("s")).withColumn("snippet", F.col("text"))
    return E.prune(rows).groupBy("document_id").agg(F.count("*").alias("n"), F.count_if("copy").alias("copies"), F.count_if("pruned").alias("pruned"))


@query("""with a as (select event_id as pos, user_id as fact_id, case event_id % 4 when 0 then 'SUPPORTS' when 1 then 'maybe' when 2 then 'CONTRADICTS' else 'INSUFFICIENT' end as result, case event_id % 5 when 0 then '1.7' when 1 then 'high' when 2 then '-3' when 3 then '0.5' else '0.25' end as confidence from events),
t as (select distinct user_id + 1 as fact_id from events), f as (select *, row_number() over (partition by fact_id order by pos) as rn from a)
select t.fact_id, case when result in ('SUPPORTS', 'CONTRADICTS', 'INSUFFICIENT') then result else 'INSUFFICIENT' end as result, case when try_cast(confidence as double) is null then 0 else greatest(0, least(1, try_cast(confidence as double))) end::double as confidence, f.fact_id is not null as answered from t left join f on t.fact_id = f.fact_id and rn = 1""")
def verifier_answer_hygiene(t):
    e = t("events")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("event_id") % len(values) + 1).cast("int"))
    answers = e.select(F.col("event_id").alias("pos"), F.col("user_id").alias("fact_id"), pick(("SUPPORTS", "maybe", "CONTRADICTS", "INSUFFICIENT")).alias("result"), pick(("1.7", "high", "-3", "0.5", "0.25")).alias("confidence"))
    return E.clean_answers(e.select((F.col("user_id") + 1).alias("fact_id")).distinct(), answers, ["fact_id"])


_SQL_QUEUE = """q as (select d.doc_id as id, source as sender, coalesce(case when toxic = 1 then 'ICSR' when quality = 0 then 'PQC' when quality = 1 then 'MI' end, 'Pending Triage') as primary_category, case when l.doc_id is null then 0.0::double when quality = 0 then 0.8::double else 0.95::double end as confidence,
 coalesce(toxic = 1 and quality = 0, false) as is_multi_label, coalesce(quality = 0, false) as requires_human_review, text from documents d left join labels l using (doc_id))"""


def queue(t) -> DataFrame:
    rows = t("documents").join(t("labels").withColumn("labelled", F.lit(True)), "doc_id", "left")
    category = F.when(F.col("toxic") == 1, "ICSR").when(F.col("quality") == 0, "PQC").when(F.col("quality") == 1, "MI")
    return rows.select(F.col("doc_id").alias("id"), F.col("source").alias("sender"), F.coalesce(category, F.lit("Pending Triage")).alias("primary_category"), F.when(F.col("labelled").isNull(), 0.0).when(F.col("quality") == 0, 0.8).otherwise(0.95).alias("confidence"), F.coalesce((F.col("toxic") == 1) & (F.col("quality") == 0), F.lit(False)).alias("is_multi_label"), F.coalesce(F.col("quality") == 0, F.lit(False)).alias("requires_human_review"), "text")


@query(f"""with {_SQL_QUEUE} select id, sender, primary_category, confidence, confidence > 0 and confidence < 0.85 as low_confidence, requires_human_review as image_review, case when requires_human_review or (is_multi_label and primary_category = 'ICSR') then 'CRITICAL' when primary_category = 'ICSR' then 'EXPEDITED' else 'STANDARD' end as priority,
 case when confidence <= 0 then 'Pending' else round(confidence * 100)::int || '%' end as shown from q""")
def queue_view(t):
    return R.flags(queue(t)).select("id", "sender", "primary_category", "confidence", "low_confidence", "image_review", "priority", T.percent_text(F.col("confidence")).alias("shown"))


@query(f"with {_SQL_QUEUE} select id, primary_category from q where primary_category in ('PQC', 'MI') and confidence > 0 and confidence < 0.85")
def queue_filters(t):
    rows = R.flags(queue(t)).filter(R.in_category(F.col("primary_category"), "PQC") | R.in_category(F.col("primary_category"), "MI")).filter("low_confidence")
    return rows.select("id", "primary_category")


@query(f"with {_SQL_QUEUE} select id from q where contains(lower(text), 'license') or contains(lower(sender), 'license') or contains(id::varchar, 'license')")
def queue_search(t):
    return R.search(queue(t), "License", ["text", "sender", "id"]).select("id")


@query(f"with {_SQL_QUEUE} select primary_category, count(*) as n, count(*) filter (confidence = 0) as pending, round(avg(confidence), 6) as mean_confidence from q group by 1")
def queue_counts(t):
    return queue(t).groupBy("primary_category").agg(F.count("*").alias("n"), F.count_if(F.col("confidence") == 0).alias("pending"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


@query(f"""with {SQL_MAIL}, a as (select doc_id, status from mail where doc_id % 10 <> 0), b as (select doc_id, case when doc_id % 7 = 0 then 'REVIEWED' else status end as status from mail where doc_id % 11 <> 0)
select coalesce(a.doc_id, b.doc_id) as doc_id, case when a.doc_id is null then 'new' when b.doc_id is null then 'gone' else 'changed' end as kind from a full join b using (doc_id) where a.doc_id is null or b.doc_id is null or a.status <> b.status""")
def snapshot_diff(t):
    after = _mail(t, "doc_id % 11 != 0").withColumn("status", F.when(F.col("doc_id") % 7 == 0, "REVIEWED").otherwise(F.col("status")))
    return R.changed(_mail(t, "doc_id % 10 != 0"), after, "doc_id", "status")


@query("select event_type as action, case when contains(upper(event_type), 'ACCEPT') or contains(upper(event_type), 'APPROVE') then 'ACCEPT' when contains(upper(event_type), 'OVERRIDE') then 'OVERRIDE' when contains(upper(event_type), 'EDIT') or contains(upper(event_type), 'UPDATE') then 'EDIT' when contains(upper(event_type), 'INGEST') or contains(upper(event_type), 'RECEIVE') then 'INGEST' else upper(event_type) end as bucket, count(*) as n from events group by 1, 2")
def audit_buckets(t):
    return t("events").groupBy(F.col("event_type").alias("action"), R.bucket(F.col("event_type")).alias("bucket")).agg(F.count("*").alias("n"))


@query("select user_id, event_id as action_id, event_type as action, round(value, 6) as value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as rn from events) where rn = 1")
def latest_actions(t):
    rows = t("events").select("user_id", F.col("event_id").alias("action_id"), F.col("event_type").alias("action"), "value", "ts")
    return R.latest_actions(rows, ["user_id", "action"]).select("user_id", "action_id", "action", F.round("value", 6).alias("value"))


_SQL_EDITS = """e as (select c_custkey, 'c_name' as field, 'Edited ' || c_custkey as new_value from customer where c_custkey % 3 = 0 union all select c_custkey, 'c_mktsegment', 'BUILDING' from customer where c_custkey % 5 = 0 union all select c_custkey, 'shoe_size', '42' from customer where c_custkey % 50 = 0)"""


def edits(t) -> DataFrame:
    c, k = t("customer"), F.col("c_custkey")
    row = lambda n, field, value: c.filter(k % n == 0).select("c_custkey", F.lit(field).alias("field"), value.alias("new_value"))
    return row(3, "c_name", F.concat(F.lit("Edited "), k.cast("string"))).unionByName(row(5, "c_mktsegment", F.lit("BUILDING"))).unionByName(row(50, "shoe_size", F.lit("42")))


@query(f"with {_SQL_EDITS} select c_custkey, coalesce((select new_value from e where e.c_custkey = c.c_custkey and field = 'c_name'), c_name) as c_name, coalesce((select new_value from e where e.c_custkey = c.c_custkey and field = 'c_mktsegment'), c_mktsegment) as c_mktsegment from customer c")
def override_edits(t):
    return R.apply_edits(t("customer").select("c_custkey", "c_name", "c_mktsegment"), edits(t), "c_custkey", ["c_name", "c_mktsegment"])


@query(f"with {_SQL_EDITS}, o as (select e.*, case field when 'c_name' then c_name when 'c_mktsegment' then c_mktsegment else '' end as original_value from e join customer using (c_custkey)) select c_custkey, 'EDIT_FIELD' as action, field, original_value, new_value from o where original_value <> new_value")
def audit_trail(t):
    return R.edit_log(t("customer").select("c_custkey", "c_name", "c_mktsegment"), edits(t), "c_custkey", ["c_name", "c_mktsegment"])


@query(f"""with {_SQL_QUEUE} select lang, count(*) as cases, count(*) filter (ok) as passed, round(100.0 * avg(ok::int), 6) as accuracy from (select d.lang, coalesce((l.toxic = 1) = regexp_matches(lower(d.text), 'idiot|moron|clown|pathetic'), false) as ok from documents d left join labels l using (doc_id)) group by 1""")
def eval_accuracy(t):
    ok = F.coalesce((F.col("toxic") == 1) == F.lower("text").rlike("idiot|moron|clown|pathetic"), F.lit(False))
    return t("documents").join(t("labels"), "doc_id", "left").withColumn("ok", ok).groupBy("lang").agg(F.count("*").alias("cases"), F.count_if("ok").alias("passed"), F.round(100 * F.avg(F.col("ok").cast("int")), 6).alias("accuracy"))


@query("""select 'documents' as check_name, count(*) >= 100 as passed, count(*) as n from documents union all select 'unique doc_id', count(*) = count(distinct doc_id), count(*) - count(distinct doc_id) from documents
 union all select 'labels known', count(*) filter (d.doc_id is null) = 0, count(*) filter (d.doc_id is null) from labels l left join documents d using (doc_id) union all select 'n_chars right', count(*) filter (n_chars <> length(text)) = 0, count(*) filter (n_chars <> length(text)) from documents""")
def dataset_audit(t):
    d, n = t("documents"), F.count("*")
    row = lambda df, name, value, passed: df.agg(value.alias("n")).select(F.lit(name).alias("check_name"), passed.alias("passed"), "n")
    none = F.col("n") == 0
    known = t("labels").join(d.select("doc_id", F.lit(1).alias("d")), "doc_id", "left")
    return row(d, "documents", n, F.col("n") >= 100).unionByName(row(d, "unique doc_id", n - F.countDistinct("doc_id"), none)).unionByName(row(known, "labels known", F.count_if(F.col("d").isNull()), none)).unionByName(row(d, "n_chars right", F.count_if(F.col("n_chars") != F.length("text")), none))


@query("""with q as (select conv_id, turn, case when text like '%?%' then list_filter(list_transform(list_filter(string_split(text, '?'), lambda x: length(trim(x)) > 5), lambda x: trim(x)), lambda x: true) else [trim(text)] end as qs from conversations where role = 'user')
select conv_id, turn, count(*) as n_questions, max(length(x))::bigint as longest from (select conv_id, turn, unnest(list_filter(case when len(qs) = 0 then [''] else qs end, lambda x: length(x) > 5)) as x from q) group by 1, 2""")
def question_split(t):
    rows = t("conversations").filter("role = 'user'").select("conv_id", "turn", F.explode(T.questions(F.col("text"))).alias("q"))
    return rows.groupBy("conv_id", "turn").agg(F.count("*").alias("n_questions"), F.max(F.length("q")).cast("long").alias("longest"))


@query("""with l as (select l_orderkey, l_linenumber, l_partkey, l_quantity from lineitem) select l_orderkey as case_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_quantity::int) - 1 as seq, 'lab_test_' || l_partkey as field, 'part ' || l_partkey || ': ' || l_quantity::int || ' units' as value from l""")
def labs_explode(t):
    lab = F.struct("l_linenumber", "l_partkey", F.col("l_quantity").cast("int").alias("q"))
    cases = t("lineitem").groupBy(F.col("l_orderkey").alias("case_id")).agg(F.array_sort(F.collect_list(lab)).alias("labs"))
    rows = cases.select("case_id", F.posexplode("labs").alias("seq", "lab"))
    return rows.select("case_id", F.col("seq").cast("long"), F.concat(F.lit("lab_test_"), F.col("lab.l_partkey").cast("string")).alias("field"), F.concat(F.lit("part "), F.col("lab.l_partkey").cast("string"), F.lit(": "), F.col("lab.q").cast("string"), F.lit(" units")).alias("value"))


@query("""select event_id, json_extract_string(props, '$') is not null as parsed, user_id from (select event_id, user_id, case when event_id % 4 = 0 then null when event_id % 4 = 1 then props else props end as props from events)""")
def model_json_parse(t):
    fenced = F.when(F.col("event_id") % 4 == 0, F.lit("no json here")).when(F.col("event_id") % 4 == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).otherwise(F.col("props"))
    return t("events").select("event_id", F.try_parse_json(T.json_candidate(fenced)).isNotNull().alias("parsed"), "user_id")
