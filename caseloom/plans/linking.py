"""Queries of messages with their reports and files, of single items, photos and the view's focus, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import view as V
from ..operators import cases as C
from ..operators import envelope as E
from ..operators import review as R
from ..operators import store as S
from ..operators import viewfocus as W
from ..operators.evidence import chunk_lines
from .casework import _SQL_ENV, envelopes
from .catalog import _SQL_QUEUE, query, queue


def _pick(k, *values):
    return F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))


@query("""select o_orderkey as id, o_orderstatus as status, case when o_orderkey % 3 = 0 then o_orderpriority end as event, case when o_orderkey % 4 = 0 then 'lot ' || o_custkey end as lot, case when o_orderkey % 5 = 0 then o_orderpriority end as topic,
 (o_orderkey % 3 = 0)::int + (o_orderkey % 4 = 0)::int + (o_orderkey % 5 = 0)::int as n_reports from orders""")
def message_reports(t):
    k, o = F.col("o_orderkey"), t("orders")
    report = lambda n, **columns: o.filter(k % n == 0).select(k.alias("message"), *(c.alias(name) for name, c in columns.items()))
    icsr, pqc, mi = report(3, event=F.col("o_orderpriority")), report(4, lot=F.concat(F.lit("lot "), F.col("o_custkey").cast("string"))), report(5, topic=F.col("o_orderpriority"))
    got = C.with_reports(o.select(k.alias("id"), F.col("o_orderstatus").alias("status")), icsr, pqc, mi)
    return got.select("id", "status", "icsr.event", "pqc.lot", "mi.topic", sum(F.col(c).isNotNull().cast("int") for c in ("icsr", "pqc", "mi")).alias("n_reports"))


@query("select l_orderkey as message, l_linenumber as line from lineitem where l_orderkey in (select o_orderkey from orders where o_orderstatus <> 'F')")
def cascade_rows(t):
    """Lines that stay when the orders of a status are deleted."""
    left = t("orders").filter("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("message"))
    return R.without_parent(t("lineitem").select(F.col("l_orderkey").alias("message"), F.col("l_linenumber").alias("line")), left)


@query("select o_orderkey as message, case when c_custkey is not null and c_custkey % 2 = 0 then 'cites ' || c_name else o_orderpriority end as citations from orders left join customer on o_orderkey = c_custkey")
def citation_updates(t):
    reports = t("orders").select(F.col("o_orderkey").alias("message"), F.col("o_orderpriority").alias("citations"))
    new = t("customer").select(F.col("c_custkey").alias("message"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("cites "), F.col("c_name"))).alias("citations"))
    return R.replace_citations(reports, new)


@query(f"with {_SQL_QUEUE} select id, sender, primary_category, md5(text) as text_md5 from q where id = 17")
def message_by_id(t):
    return R.by_id(queue(t), 17).select("id", "sender", "primary_category", F.md5("text").alias("text_md5"))


@query(f"""with {_SQL_QUEUE}, f as (select *, confidence > 0 and confidence < 0.85 as low, requires_human_review or (is_multi_label and primary_category = 'ICSR') as critical from q)
select 'CRITICAL' as flag, id from f where critical union all select 'LOW_CONFIDENCE', id from f where low union all select 'PHOTO_REVIEW', id from f where requires_human_review""")
def flag_filters(t):
    rows = R.flags(queue(t))
    one = lambda flag: R.flagged(rows, flag).select(F.lit(flag).alias("flag"), "id")
    return one("CRITICAL").unionByName(one("LOW_CONFIDENCE")).unionByName(one("PHOTO_REVIEW"))


_SQL_CITED = "case (p_partkey % 5)::int when 0 then upper(p_name) || '.PDF' when 1 then p_name when 2 then ' scan of ' || p_brand || '.jpg ' when 3 then '' else 'other.pdf' end"


@query(f"""with c as (select p_partkey as message, {_SQL_CITED} as cited from part), a as (select p_partkey as message, p_name || '.pdf' as filename from part union all select p_partkey, p_brand || '.jpg' from part)
select message, cited, filename from c join a using (message) where trim(cited) <> '' and (contains(lower(trim(filename)), lower(trim(cited))) or contains(lower(trim(cited)), lower(trim(filename))))""")
def attachment_matches(t):
    k, name, brand = F.col("p_partkey").alias("message"), F.col("p_name"), F.col("p_brand")
    n = F.col("p_partkey") % 5
    cited = F.when(n == 0, F.concat(F.upper(name), F.lit(".PDF"))).when(n == 1, name).when(n == 2, F.concat(F.lit(" scan of "), brand, F.lit(".jpg "))).when(n == 3, "").otherwise("other.pdf")
    files = F.array(F.concat(name, F.lit(".pdf")), F.concat(brand, F.lit(".jpg")))
    return R.with_files(t("part").select(k, cited.alias("cited")), t("part").select(k, F.explode(files).alias("filename"))).select("message", "cited", "filename")


@query("select l_orderkey, l_linenumber, l_linenumber % 5 in (0, 2) as elevated from lineitem")
def elevated_labs(t):
    said = _pick(F.col("l_linenumber"), "Elevated 3x ULN", "normal", "HIGH", "", None)
    return t("lineitem").select("l_orderkey", "l_linenumber", V.elevated(said).alias("elevated"))


@query("""with f as (select p_partkey as e, u.pos as fact_pos, 'lab_test_' || u.f as field from part, lateral (values (0, lower(p_brand) || '_2'), (1, lower(p_brand)), (3, replace(p_name, ' ', '_'))) as u(pos, f) union all select p_partkey, 0, lower(p_brand) from part),
l as (select p_partkey as e, u.pos, u.test_name from part, lateral (values (0, p_brand), (1, upper(string_split(p_name, ' ')[2])), (2, 'none')) as u(pos, test_name))
select e as envelope_id, pos, test_name, (select min_by(field, fact_pos) from f where f.e = l.e and field like 'lab\\_test\\_%' escape '\\' and contains(field, lower(test_name))) as lab_field from l""")
def lab_fact_links(t):
    k, row = F.col("p_partkey").alias("envelope_id"), lambda pos, c, name: F.struct(F.lit(pos).alias("pos"), c.alias(name))
    brand, named = F.lower("p_brand"), lambda c: F.concat(F.lit("lab_test_"), c)
    facts = t("part").select(k, F.inline(F.array(row(0, named(F.concat(brand, F.lit("_2"))), "field"), row(1, named(brand), "field"), row(3, named(F.translate("p_name", " ", "_")), "field"), row(0, brand, "field"))))
    labs = t("part").select(k, F.inline(F.array(row(0, F.col("p_brand"), "test_name"), row(1, F.upper(F.split("p_name", " ")[1]), "test_name"), row(2, F.lit("none"), "test_name"))))
    return C.lab_fact_of(labs, facts).select("envelope_id", "pos", "test_name", "lab_field")


@query("select p_partkey, case (p_partkey % 4)::int when 0 then p_brand when 1 then p_name when 2 then p_type end as photo from part")
def photo_evidence(t):
    k, image = F.col("p_partkey") % 4, lambda name, box: F.struct(F.col(name).alias("name"), F.lit(box).cast("string").alias("bbox"))
    images = F.when(k == 0, F.array(image("p_name", None), image("p_brand", "0,0,1,1"))).when(k == 1, F.array(image("p_name", None), image("p_brand", None))).when(k == 2, F.array(image("p_type", "0,0,1,1"))).otherwise(F.array().cast("array<struct<name:string,bbox:string>>"))
    return t("part").select("p_partkey", C.photo_evidence(images)["name"].alias("photo"))


@query(f"""with {_SQL_ENV} select e as envelope_id, fact_id, i::int as pos, rule, case when rule = 'deterministic' and e % 2 = 0 and evidence_id like '%-0' then 'SUPPORTS' else 'INSUFFICIENT' end as result,
 case when rule <> 'deterministic' then 0 when e % 2 = 0 and evidence_id like '%-0' then 0.7 when e % 2 = 1 and i = 1 then 1 else 0 end::double as confidence from j""")
def single_items(t):
    """Items judged by answers alone: without an answer, or with one of an unknown kind, nothing is borne out."""
    facts, evidence = envelopes(t)
    e, i = F.col("envelope_id"), F.col("pos")
    good, odd = (e % 2 == 0) & (i == 0), (e % 2 == 1) & (i == 1)
    answers = evidence.filter(good | odd).select("envelope_id", "fact_id", "evidence_id", "pos", F.when(good, "SUPPORTS").otherwise("maybe").alias("result"), F.when(good, "0.7").otherwise("2").alias("confidence"))
    judged = E.judge_candidates(E.distinct_facts(facts), evidence, answers=answers, cascade=False)
    return judged.select("envelope_id", "fact_id", "pos", "rule", "result", "confidence")


@query("select user_id as envelope_id, count(*) filter (event_id % 3 <> 0) as n_batches, coalesce(floor(avg(case when event_id % 3 <> 0 then event_id % 977 end)), 0)::bigint as mean_ms from events group by 1")
def batch_latency(t):
    return E.batch_latency(t("events").select(F.col("user_id").alias("envelope_id"), F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 977).alias("latency_ms")))


_SQL_VIEW = """m as (select p_partkey as e, ['Safety Report (ICSR)', 'PQC', 'Not Relevant', 'MI', 'Notes'][p_partkey % 5 + 1] as cat, p_partkey % 5 = 1 or p_partkey % 11 = 0 as multi, p_partkey % 7 = 0 as photo, p_partkey % 6 = 0 as has_mi, case p_partkey % 3 when 1 then 'English' when 2 then 'fr' end as lang, p_partkey % 13 = 0 as failed from part),
f as (select p_partkey as e, u.pos, u.field, upper(u.field) as label, ['CONFIRMED', 'UNCERTAIN', 'CONFLICT', 'NOT_STATED', 'NOT_STATED'][(p_partkey * 3 + u.pos) % 5 + 1] as status from part, lateral (values (0, 'patientAge'), (1, 'productName'), (2, 'lotNumber'), (3, 'questionText'), (4, 'other')) as u(pos, field)),
w as (select e, cat = 'Safety Report (ICSR)' as icsr, cat = 'PQC' or photo as pqc, e % 5 in (1, 3) or has_mi as mi, cat = 'Not Relevant' as irrelevant from m),
i as (select e, 1 as rank, 0 as pos, 'focus-photo-01' as item, 'PHOTO_DEFECT_INSPECTION' as category, 'defect_photo' as field, 'Mandatory Defect Photo Inspection' as headline, null as warning from m where photo
 union all select e, 2, 0, 'focus-multilabel-01', 'CATEGORY_AMBIGUITY', 'primaryCategory', 'Dual Regulatory Domain (Multi-Label)', null from m where multi union all select e, 3, 0, 'focus-lang-01', 'MULTILINGUAL_TRANSLATION', 'language', 'Foreign Language Intake (fr)', null from m where lang = 'fr'
 union all select e, 4, pos, 'focus-conflict-' || field, 'EVIDENCE_CONFLICT', field, 'Evidence Conflict: ' || label, null from f where status = 'CONFLICT' union all select e, 5, pos, 'focus-uncertain-' || field, 'UNCERTAIN_HANDWRITING', field, 'Uncertain Parameter: ' || label, null from f where status = 'UNCERTAIN'
 union all select e, 6, pos, 'focus-missing-' || field, 'MISSING_CRITICAL_FIELD', field, 'Critical Field Unstated: ' || label, 'Critical regulatory field ''' || label || ''' is NOT_STATED.' from f join w using (e) where status = 'NOT_STATED' and not irrelevant
  and ((icsr and field in ('patientAge', 'productName')) or (pqc and field in ('productName', 'lotNumber')) or (mi and field in ('productName', 'questionText'))))"""


def _view(t):
    k, pos = F.col("p_partkey"), F.col("pos")
    category = _pick(k, "Safety Report (ICSR)", "PQC", "Not Relevant", "MI", "Notes")
    messages = t("part").select(
        k.alias("envelope_id"), F.when(k % 13 == 0, "FAILED").otherwise("TRIAGED").alias("status"), category.alias("primary_category"), F.when(k % 5 == 1, F.array(category, F.lit("Medical Info Request"))).otherwise(F.array(category)).alias("categories"),
        (k % 11 == 0).alias("is_multi_label"), (k % 7 == 0).alias("photo"), (k % 6 == 0).alias("has_mi"), _pick(k, None, "English", "fr").alias("language"), F.array().cast("array<struct<language:string,flavor:string>>").alias("attachments"),
    )
    facts = t("part").select(k.alias("envelope_id"), F.posexplode(F.array(*map(F.lit, ("patientAge", "productName", "lotNumber", "questionText", "other")))).alias("pos", "field"))
    status = _pick(F.col("envelope_id") * 3 + pos, "CONFIRMED", "UNCERTAIN", "CONFLICT", "NOT_STATED", "NOT_STATED")
    return messages, facts.withColumns({"label": F.upper("field"), "status": status})


@query(f"with {_SQL_VIEW} select e as envelope_id, rank, pos, item, category, field, headline, warning from i")
def view_focus(t):
    return W.view_focus(*_view(t))


@query(f"""with {_SQL_VIEW}, n as (select e, count(*) as n_focus, count(warning) as n_warnings from i group by e)
select e as envelope_id, coalesce(n_focus, 0) as n_focus, coalesce(n_warnings, 0) as n_warnings, case when failed then 'BLOCKED_BY_INTEGRITY_ERROR' when cat <> 'Not Relevant' and n_focus > 0 then 'REVIEW_WITH_WARNINGS' else 'READY_FOR_REVIEW' end as gate from m left join n using (e)""")
def view_gates(t):
    messages, facts = _view(t)
    return W.view_gate(messages, W.view_focus(messages, facts))


@query("select source as filename, contains(lower(text), 'patient') and (contains(lower(text), 'adverse') or contains(lower(text), 'syndrome')) as is_reportable, 'PENDING' as review_status, '2025-01-01 00:00:00' as created_at, doc_id from documents")
def literature_pending(t):
    screened = t("documents").select("doc_id", F.col("source").alias("filename"), C.reportable(F.col("text")).alias("is_reportable"))
    return S.literature_rows(screened, F.lit("2025-01-01 00:00:00").cast("timestamp")).withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


@query("select source as filename, case when lang = 'en' then 'text/plain' else 'application/octet-stream' end as content_type, md5(text) as bytes_md5 from documents where doc_id = 5")
def attachment_file(t):
    files = t("documents").select(F.col("doc_id").alias("id"), F.col("source").alias("filename"), F.when(F.col("lang") == "en", "text/plain").alias("content_type"), F.encode("text", "utf-8").alias("bytes"))
    return S.attachment_bytes(files, 5).select("filename", "content_type", F.md5("bytes").alias("bytes_md5"))


@query(None)
def grounded_cases(t):
    """Two cases of each document as an article: its first and its last line as products, found again in its lines. A small table's test states the rows wanted."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != "")
    case = lambda n, at: F.struct(F.lit(n).alias("case_no"), F.lit(f"Patient {n}").alias("identifier"), F.try_element_at(lines, F.lit(at)).alias("suspect_product"))
    cases = t("documents").select(F.col("doc_id").alias("article_id"), F.inline(F.array(case(1, 1), case(2, -1))))
    chunks = chunk_lines(t("documents")).withColumns({"source_type": F.lit("pdf_text"), "page": (F.floor(F.col("pos") / 40) + 1).cast("int"), "has_box": F.col("pos") % 2 == 1, "char_start": F.lit(None).cast("int"), "char_end": F.lit(None).cast("int"), "is_table": F.lit(False)})
    return C.ground_cases(C.literature_facts(cases, ("suspect_product",)), chunks)
