"""Queries of case operators: ledgers from answers, citations, triage, routing, literature, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cases as C
from ..operators import review as R
from ..operators.shared import dealt
from .catalog import LETTER, _SQL_TRIAGE, letters, query

_UN = "('not stated', 'none', 'unknown', '')"
# Sections of answers made from parts.
_ST = "case k % 4 when 0 then 'uncertain' when 1 then 'odd' else null end"
_SQL_ANS = f"""p as (select p_partkey as k, p_name, p_type, p_brand, p_size from part), a as (
 select k, 'patient' as section, ['patient_identifier','patient_dob','patient_age','patient_sex','patient_weight','patient_height','patient_country','patient_medical_history','treated_indication'] as fields, [p_brand, null, p_size || ' years', case when k % 2 = 0 then 'F' else 'other' end, null, null, 'uk', p_name, 'Unknown'] as vals, {_ST} as st from p
 union all select k, 'mi', ['product_or_topic','inquiry_type','question_text','clinical_context','requester','explicit_no_ae_no_pqc'], [p_name, '', p_type, null, null, 'true'], null from p where k % 3 = 0
 union all select k, 'regulatory', ['mfr_control_number','date_received_by_mfr'], ['none', '2025-01-02'], null from p)"""


def _answers(t):
    k, s = F.col("p_partkey"), F.lit(None).cast("string")
    m = lambda **kw: F.map_from_arrays(F.array(*map(F.lit, kw)), F.array(*(v if not isinstance(v, str) else F.lit(v) for v in kw.values())))
    status = F.when(k % 4 == 0, "uncertain").when(k % 4 == 1, "odd")
    patient = m(identifier=F.col("p_brand"), age=F.concat(F.col("p_size").cast("string"), F.lit(" years")), sex=F.when(k % 2 == 0, "F").otherwise("other"), patient_country="uk", medical_history=F.col("p_name"), treated_indication="Unknown", status=status)
    mi = m(product_or_topic=F.col("p_name"), inquiry_type="", question_text=F.col("p_type"), explicit_no_ae_no_pqc="true")
    none = F.lit(None).cast("map<string,string>")
    return t("part").select(k.alias("envelope_id"), patient.alias("patient"), F.when(k % 3 == 0, mi).alias("mi"), m(mfr_control_number="none", date_received_by_mfr="2025-01-02").alias("regulatory"), *(none.alias(c) for c in ("reporter", "product", "reaction", "pqc", "not_relevant")))


@query(f"""with {_SQL_ANS}, u as (select k, section, generate_subscripts(fields, 1) - 1 as pos, unnest(fields) as field, coalesce(unnest(vals), 'Not stated') as value, st from a)
select k as envelope_id, section, pos, field, value, case field when 'patient_age' then regexp_extract(value, '[0-9]+') when 'patient_sex' then case value when 'F' then 'Female' else 'Other' end when 'patient_country' then 'United Kingdom' end as normalized,
 case when lower(trim(value)) in {_UN} then 'NOT_STATED' when st = 'uncertain' then 'UNCERTAIN' else 'CONFIRMED' end as status, case when lower(trim(value)) not in {_UN} and st = 'uncertain' then 0.85::double else 1.0::double end as confidence from u""")
def section_facts(t):
    return C.section_facts(_answers(t))


@query(f"""with {_SQL_ANS}, u as (select k, unnest(fields) as field, coalesce(unnest(vals), 'Not stated') as value from a)
select k as envelope_id, max(value) filter (field = 'patient_identifier') as patient_identifier, coalesce(max(value) filter (field = 'product_or_topic'), 'Not stated') as product_or_topic, 'Not stated' as reporter_name, 'Unknown' as treated_indication, 'Unknown' as indication from u group by k""")
def flat_record(t):
    return C.flat_record(C.section_facts(_answers(t)), ["patient_identifier", "product_or_topic", "reporter_name", "treated_indication", "indication"])


_SQL_PLACED = """ev as (select p_partkey as k, i as pos, ['patient', 'product'][i % 2 + 1] as part, ['email', 'pdf', 'image', 'table_cell'][(p_partkey + i) % 4 + 1] as source_type, ['SUPPORTS', 'CONTRADICTS', 'INSUFFICIENT', null][(p_partkey + 2 * i) % 4 + 1] as result, (i % 5)::double / 4 as confidence, (p_partkey * i % 7)::double / 7 as relevance,
 case when (p_partkey + i) % 2 = 1 then i + 1 end as page, (p_partkey + i) % 8 = 1 as has_box, case when (p_partkey + i) % 3 = 0 then 0 end as char_start, case when (p_partkey + i) % 3 = 0 then 5 end as char_end, case when (p_partkey + i) % 5 = 2 then 'body' end as section, p_name || ' ' || i as snippet from part, unnest(range(6)) as n(i) where p_partkey % 11 > 0),
sc as (select *, case when result = 'SUPPORTS' then 50 + 20 * confidence when result = 'INSUFFICIENT' then 10::double else 0 end + case when has_box and page is not null and source_type in ('pdf', 'image') then 100 when char_end > char_start and source_type not in ('pdf', 'image') then 80 when page is not null and source_type in ('pdf', 'image') then 40 when section <> '' then 20 else 5 end::double + 10 * relevance as score from ev where result is distinct from 'CONTRADICTS'),
be as (select *, case when (has_box and source_type in ('pdf', 'image')) or (source_type = 'email' and char_start is not null) then 'LEVEL_1_EXACT_VISUAL' when page > 0 then 'LEVEL_2_PAGE_TEXT' else 'LEVEL_3_SNIPPET_ONLY' end as level from sc qualify row_number() over (partition by k, part order by score desc, pos) = 1)"""


@query(f"""with {_SQL_ANS}, u as (select k, unnest(fields) as field, coalesce(unnest(vals), 'Not stated') as value from a), {_SQL_PLACED}
select u.k as envelope_id, max(value) filter (field = 'patient_identifier') as patient_identifier, case when u.k % 3 = 0 then 'Told ' || u.k when u.k % 3 = 1 and u.k % 2 = 0 then 'Summary' when u.k % 5 = 0 then 'Review' else 'Not stated' end as narrative,
 coalesce((select string_agg(part || ':' || pos || ':' || snippet || ':' || level, '|' order by part) from be where be.k = u.k), '') as cited from u group by u.k""")
def flat_case(t):
    """Records with the narrative that stands in for a missing one, and each section's best citation."""
    k, i = F.col("envelope_id"), F.col("pos")
    cases = t("part").select(F.col("p_partkey").alias("envelope_id")).select(k, F.when(k % 3 == 0, F.concat(F.lit("Told "), k.cast("string"))).otherwise("Not stated").alias("clinical_narrative"), F.when((k % 3 == 1) & (k % 2 == 0), "Summary").otherwise("").alias("document_summary"), F.when(k % 5 == 0, "Review").alias("reviewer_summary"))
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n % len(names) + 1).cast("int"))
    rows = dealt(t("part").filter("p_partkey % 11 > 0"), "p_partkey").select(F.col("p_partkey").alias("envelope_id"), "p_name", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("pos"))
    evidence = rows.select(
        "envelope_id", "pos", pick(("patient", "product"), i).alias("part"), pick(("email", "pdf", "image", "table_cell"), k + i).alias("source_type"), pick(("SUPPORTS", "CONTRADICTS", "INSUFFICIENT", None), k + 2 * i).alias("result"), ((i % 5) / 4.0).alias("confidence"), ((k * i % 7) / 7.0).alias("relevance"),
        F.when((k + i) % 2 == 1, i + 1).alias("page"), ((k + i) % 8 == 1).alias("has_box"), F.when((k + i) % 3 == 0, 0).alias("char_start"), F.when((k + i) % 3 == 0, 5).alias("char_end"), F.when((k + i) % 5 == 2, "body").alias("section"), F.concat_ws(" ", "p_name", i.cast("string")).alias("snippet"),
    )
    got = C.flat_case(C.section_facts(_answers(t)), ["patient_identifier"], cases, evidence)
    shown = F.transform(F.array_sort(F.map_entries("section_citations")), lambda e: F.concat_ws(":", e["key"], e["value"]["pos"].cast("string"), e["value"]["snippet"], e["value"]["level"]))
    return got.select("envelope_id", "patient_identifier", "narrative", F.coalesce(F.array_join(shown, "|"), F.lit("")).alias("cited"))


@query("""with a as (select l_orderkey as k, count(*) as n, string_agg(l_linenumber || ':' || l_partkey, ',' order by l_linenumber, l_partkey) as files from lineitem where l_linenumber % 3 > 0 group by 1)
select o_orderkey as message_id, o_orderstatus as status, coalesce(n, 0)::int as n_files, coalesce(files, '') as files from orders left join a on k = o_orderkey""")
def message_attachments(t):
    messages = t("orders").select(F.col("o_orderkey").alias("message_id"), F.col("o_orderstatus").alias("status"))
    files = t("lineitem").filter("l_linenumber % 3 > 0").select(F.col("l_orderkey").alias("message_id"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("file"))
    name = lambda a: F.concat_ws(":", a["pos"].cast("string"), a["file"].cast("string"))
    return R.with_attachments(messages, files).select("message_id", "status", F.size("attachments").alias("n_files"), F.array_join(F.transform("attachments", name), ",").alias("files"))


@query(f"""with l as (select l_orderkey as k, case when l_linenumber % 4 = 0 then '' else 'Test Nr ' || l_linenumber end as name, l_linenumber as n, l_partkey as p from lineitem), f as (select k, name, n, p from l where name <> '')
select k as envelope_id, 'lab' as kind, 'lab_test_' || replace(lower(name), ' ', '_') as field, name || ': ' || p || ' mg' as value from f
union all select k, 'drug', 'concomitant_drug_' || row_number() over (partition by k order by n, p), case when n % 2 = 0 then 'Drug ' || p else 'Not stated' end || ' (' || case when n % 3 = 0 then 'Not stated' else n || ' mg' end || ')' from l""")
def repeated_facts(t):
    n, p = F.col("l_linenumber"), F.col("l_partkey").cast("string")
    lab = F.struct(n.alias("n"), F.col("l_partkey").alias("p"), F.when(n % 4 == 0, "").otherwise(F.concat(F.lit("Test Nr "), n.cast("string"))).alias("test_name"), p.alias("value"), F.lit("mg").alias("unit"))
    dose = F.when(n % 3 != 0, F.concat(n.cast("string"), F.lit(" mg")))
    drug = F.map_from_arrays(F.array(F.lit("medication_name"), F.lit("dose")), F.array(F.when(n % 2 == 0, F.concat(F.lit("Drug "), p)), dose))
    cases = t("lineitem").groupBy(F.col("l_orderkey").alias("envelope_id")).agg(F.array_sort(F.collect_list(lab)).alias("labs"), F.transform(F.array_sort(F.collect_list(F.struct(n.alias("n"), F.col("l_partkey").alias("p"), F.map_entries(drug).alias("d")))), lambda x: F.map_from_entries(x["d"])).alias("drugs"))
    row = lambda df, kind: df.select("envelope_id", F.lit(kind).alias("kind"), "field", "value")
    return row(C.lab_facts(cases), "lab").unionByName(row(C.drug_facts(cases), "drug"))


@query("""with c as (select p_partkey as k, case p_partkey % 4 when 0 then '  ' || p_name || ' ' when 1 then 'None' when 2 then '' else p_type end as s, case when p_partkey % 3 = 0 then 'table' end as kind, case when p_partkey % 5 = 0 then '' else 'p. 2' end as loc from part)
select k, trim(s) as snippet, coalesce(case when kind = 'table' then 'table_cell' end, 'pdf_text') as source_type, case when loc = '' then 'Patient Section' else loc end as place from c where lower(trim(s)) not in ('not stated', 'none', '')""")
def cited_evidence(t):
    k = F.col("p_partkey")
    snippet = F.when(k % 4 == 0, F.concat(F.lit("  "), F.col("p_name"), F.lit(" "))).when(k % 4 == 1, "None").when(k % 4 == 2, "").otherwise(F.col("p_type"))
    citation = F.map_from_arrays(F.array(*map(F.lit, ("verbatim_snippet", "source_type", "page_or_location"))), F.array(snippet, F.when(k % 3 == 0, "table"), F.when(k % 5 == 0, "").otherwise("p. 2")))
    return t("part").select(k.alias("k"), C.cited_evidence(citation, F.lit("A.PDF"), "Patient Section").alias("e")).filter("e is not null").select("k", "e.snippet", "e.source_type", "e.place")


@query("""with s as (select p_partkey as e, 'lotNumber' as field, p_brand as value, 'CONFIRMED' as status from part union all select p_partkey, 'dose', '5 mg', 'CONFIRMED' from part), r as (select p_partkey as e, 'lot_number' as field, case when p_partkey % 3 = 0 then 'n/a' else p_name end as value, case when p_partkey % 4 = 0 then 'UNCERTAIN' end as status, case when p_partkey % 5 < 3 then (p_partkey % 10) / 10.0::double end as conf from part where p_partkey % 2 = 0 union all select p_partkey, 'newField', p_type, null, null from part where p_partkey % 7 = 0),
j as (select coalesce(s.e, r.e) as e, coalesce(s.field, r.field) as field, s.value as sv, s.status as ss, r.e is not null as new, r.value as rv, r.conf, lower(trim(r.value)) = 'n/a' as missing, coalesce(r.status, case when lower(trim(r.value)) = 'n/a' then 'NOT_STATED' else 'CONFIRMED' end) as rs from s full join r on s.e = r.e and case s.field when 'lotNumber' then 'lot_number' else s.field end = case r.field when 'newField' then 'new_field' else r.field end),
x as (select *, case when new and not missing and rs <> 'NOT_STATED' then coalesce(conf, case when rs = 'UNCERTAIN' then 0.65::double else 0.95::double end) end as score from j)
select e as envelope_id, field, case when new then case when missing then 'Not stated' else rv end else sv end as value, case when new then rs else ss end as status, score, case when score is not null then case when conf is null then case when rs = 'UNCERTAIN' then 'LOW' else 'HIGH' end when conf >= 0.85 then 'HIGH' when conf >= 0.6 then 'MEDIUM' else 'LOW' end end as level from x""")
def upsert_facts(t):
    k, none = F.col("p_partkey"), F.lit(None)
    row = lambda df, field, value, **more: df.select(k.alias("envelope_id"), F.lit(field).alias("field"), value.alias("value"), *(v.alias(n) for n, v in more.items()))
    p = t("part")
    shown = row(p, "lotNumber", F.col("p_brand"), status=F.lit("CONFIRMED")).unionByName(row(p, "dose", F.lit("5 mg"), status=F.lit("CONFIRMED")))
    raw = row(p.filter(k % 2 == 0), "lot_number", F.when(k % 3 == 0, "n/a").otherwise(F.col("p_name")), status=F.when(k % 4 == 0, "UNCERTAIN"), confidence=F.when(k % 5 < 3, (k % 10) / 10.0), pos=F.lit(0))
    raw = raw.unionByName(row(p.filter(k % 7 == 0), "newField", F.col("p_type"), status=none.cast("string"), confidence=none.cast("double"), pos=F.lit(1)))
    return C.upsert_facts(shown, raw)


@query("""with f as (select p_partkey as e, 'defect_type' as field, 'CONFIRMED' as status from part union all select p_partkey, 'lotNumber', case when p_partkey % 2 = 0 then 'NOT_STATED' else 'CONFIRMED' end from part),
c as (select p_partkey as e, 'defectType' as name, 'camel ' || p_name as snippet from part where p_partkey % 2 = 0 union all select p_partkey, 'physical_defect_type', 'physical' from part where p_partkey % 3 = 0 union all select p_partkey, 'lot_number', case when p_partkey % 4 = 0 then 'Lot number was not recorded' else 'Lot seen' end from part where p_partkey % 5 <> 0 union all select p_partkey, 'pqc', p_type || ' and lot ' || p_brand from part)
select e as envelope_id, field, case field when 'defect_type' then coalesce((select snippet from c where c.e = f.e and name = 'defectType'), (select snippet from c where c.e = f.e and name = 'physical_defect_type'), (select snippet from c join part on p_partkey = c.e where c.e = f.e and name = 'pqc' and contains(lower(snippet), lower(p_type))))
 else case when status = 'NOT_STATED' then (select snippet from c where c.e = f.e and name = 'lot_number' and snippet like '%not recorded%') else coalesce((select snippet from c where c.e = f.e and name = 'lot_number'), (select snippet from c join part on p_partkey = c.e where c.e = f.e and name = 'pqc')) end end as snippet from f""")
def resolve_citations(t):
    k, p = F.col("p_partkey"), t("part")
    fact = lambda field, value, status: p.select(k.alias("envelope_id"), F.lit(field).alias("field"), F.lit("Lot Number").alias("label"), value.alias("value"), status.alias("status"), F.lit("pqc").alias("section"))
    facts = fact("defect_type", F.col("p_type"), F.lit("CONFIRMED")).unionByName(fact("lotNumber", F.col("p_brand"), F.when(k % 2 == 0, "NOT_STATED").otherwise("CONFIRMED")))
    cited = lambda when, name, snippet: p.filter(when).select(k.alias("envelope_id"), F.lit(name).alias("name"), snippet.alias("snippet"))
    all_ = F.lit(True)
    citations = cited(k % 2 == 0, "defectType", F.concat(F.lit("camel "), "p_name")).unionByName(cited(k % 3 == 0, "physical_defect_type", F.lit("physical"))).unionByName(cited(k % 5 != 0, "lot_number", F.when(k % 4 == 0, "Lot number was not recorded").otherwise("Lot seen"))).unionByName(cited(all_, "pqc", F.concat("p_type", F.lit(" and lot "), "p_brand")))
    return C.resolve_citations(facts, citations).select("envelope_id", "field", "snippet")


@query("""with m as (select l_orderkey as e, l_linenumber % 3 as f, max_by(l_partkey, l_linenumber * 1000000 + l_partkey) as c from lineitem group by all)
select e as envelope_id, string_agg('f' || f || '=' || c, ';' order by f) as citations from m group by e""")
def citation_maps(t):
    rows = t("lineitem").select(F.col("l_orderkey").alias("envelope_id"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("pos"), F.concat(F.lit("f"), (F.col("l_linenumber") % 3).cast("string")).alias("field"), F.col("l_partkey").cast("string").alias("citation"))
    got = C.citation_map(rows).withColumn("m", C.merged_citations(F.create_map(F.lit("f0"), F.lit("old")), F.col("citations")))
    own = F.filter(F.map_entries("m"), lambda e: (e["value"] != "old"))
    return got.select("envelope_id", F.array_join(F.transform(F.array_sort(own), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("citations"))


@query(f"""with {_SQL_TRIAGE}, a as (select *, o_orderkey % 5 as md from tr)
select o_orderkey as message_id, case md when 0 then 'model' when 1 then 'model' when 2 then case when o_orderkey % 3 = 0 then 'truth' else 'keywords' end else case when o_orderkey % 3 = 0 then 'truth' else 'keywords' end end as by,
 case when md < 2 then 'MI' when o_orderkey % 3 = 0 then 'PQC' else primary_category end as primary_, case when md = 0 then 0.98::double when md = 1 then 0.5::double when o_orderkey % 3 = 0 then 0.98::double else confidence end as confidence, case when md = 0 then true when md = 1 then false when o_orderkey % 3 = 0 then false else multi end as multi from a""")
def triage_answers(t):
    k = F.col("o_orderkey")
    answer = F.when(k % 5 == 0, '```json\n{"primary_category": "MI", "is_multi_label": true, "labels": [{"category": "MI", "confidence": 1.0}]}\n```').when(k % 5 == 1, '{"primary_category": "MI", "labels": [{"confidence": 0.5}],}').when(k % 5 == 2, "no answer").when(k % 5 == 3, '{"labels": []}')
    rows = letters(t).select(k.alias("message_id"), "text", answer.alias("answer"))
    got = C.triage_answers(rows, t("orders").filter(k % 3 == 0).select(k.alias("message_id"), F.lit("PQC").alias("primary")))
    return got.withColumnRenamed("primary", "primary_")


@query("""with m as (select doc_id as id, ['RECEIVED', 'PROCESSING', 'REVIEWED'][doc_id % 3 + 1] as status, doc_id % 4 as r from documents)
select id as message_id, case when status = 'REVIEWED' then status when r = 0 then 'TRIAGED' else 'FAILED' end as status, case when status = 'REVIEWED' then null when r = 0 then 'Classified as MI with confidence 0.5' when r = 1 then 'Error: broken' else 'Error: Empty extraction result from AI service.' end as comments from m""")
def status_steps(t):
    k, none = F.col("doc_id"), F.lit(None).cast("string")
    m = t("documents").select(k.alias("message_id"), F.element_at(F.array(*map(F.lit, ("RECEIVED", "PROCESSING", "REVIEWED"))), (k % 3 + 1).cast("int")).alias("status"))
    results = t("documents").filter(k % 4 < 2).select(k.alias("message_id"), F.when(k % 4 == 0, "MI").otherwise(none).alias("primary"), F.lit(0.5).alias("confidence"), F.when(k % 4 == 1, "broken").alias("error"))
    done, audit = C.processed(m, results)
    return done.join(audit.select("message_id", F.col("reviewer_comments").alias("comments")).hint("merge"), "message_id", "left")


@query("""with c as (select o_orderkey as m, o_orderkey % 2 = 0 as icsr, o_orderkey % 3 = 0 as pqc, o_orderkey % 5 <> 0 as clinical from orders where o_orderkey % 7 <> 0), old as (select o_orderkey as m from orders where o_orderkey % 4 = 0)
select 'icsr' as report, m as message, 'old' as body from old where m not in (select m from c) union all select 'icsr', m, 'new' from c where icsr and clinical union all select 'pqc', m, 'old' from old where m not in (select m from c) union all select 'pqc', m, 'new' from c where pqc""")
def routed_reports(t):
    k = F.col("o_orderkey")
    both = F.array_compact(F.array(F.when(k % 2 == 0, "icsr"), F.when(k % 3 == 0, "pqc")))
    cases = t("orders").filter(k % 7 != 0).select(k.alias("message"), both.alias("categories"), (k % 5 != 0).alias("clinical"), F.lit("new").alias("body"))
    old = t("orders").filter(k % 4 == 0).select(k.alias("message"), F.lit("old").alias("body"))
    got = C.route(cases, {"icsr": old, "pqc": old})
    row = lambda name: got[name].select(F.lit(name).alias("report"), "message", "body")
    return row("icsr").unionByName(row("pqc"))


@query("""with p as (select p_partkey as k, [null, 'Adverse event', 'Not Relevant', 'MI'][p_partkey % 4 + 1] as pr, case when p_partkey % 3 = 0 then ['PQC', 'Safety Report (ICSR)'] when p_partkey % 3 = 1 then ['mi'] else [] end as ls, case when p_partkey % 5 = 0 then 'n/a' else p_name end as v from part)
select k, (pr is null or pr <> 'Not Relevant') and (coalesce(pr = 'Adverse event', false) or k % 3 = 0) as icsr, v <> 'n/a' as clinical, case when len(ls) > 0 then k % 3 = 0 else false end as flag_icsr, case when len(ls) > 0 then false else coalesce(pr = 'MI', false) end as flag_mi from p""")
def routing_flags(t):
    k = F.col("p_partkey")
    primary = F.element_at(F.array(F.lit(None), F.lit("Adverse event"), F.lit("Not Relevant"), F.lit("MI")), (k % 4 + 1).cast("int"))
    labels = F.when(k % 3 == 0, F.array(F.lit("PQC"), F.lit("Safety Report (ICSR)"))).when(k % 3 == 1, F.array(F.lit("mi"))).otherwise(F.array().cast("array<string>"))
    rows = t("part").select(k.alias("k"), primary.alias("pr"), labels.alias("ls"), F.when(k % 5 == 0, "n/a").otherwise(F.col("p_name")).alias("v"))
    flags = C.category_flags(F.col("ls"), F.col("pr"))
    return rows.select("k", C.is_icsr(F.col("pr"), F.col("ls")).alias("icsr"), C.has_clinical_data("v").alias("clinical"), F.coalesce(flags["icsr"], F.lit(False)).alias("flag_icsr"), F.coalesce(flags["mi"], F.lit(False)).alias("flag_mi"))


@query(f"""with le as (select o_orderkey as k, {LETTER} as text from orders), x as (select *, 'dir/Art' || k || case when k % 2 = 0 then '-Preclinical.pdf' else '.pdf' end as f, contains(lower(text), 'patient') and (contains(lower(text), 'adverse') or contains(lower(text), 'syndrome')) as word from le)
select f as filename, case when k % 4 = 0 then 'answer' when k % 3 = 0 then 'truth' else 'keywords' end as by, case when k % 4 = 0 then true when k % 3 = 0 then k % 5 = 0 else word end as is_reportable,
 case when k % 4 = 0 then 'Case Series' when k % 3 = 0 then case when k % 7 = 0 then 'Multi-Patient Case Series' when k % 5 = 0 then 'Single Case Report' when k % 2 = 0 then 'Preclinical Study' else 'Review Article' end when word then 'Single Case Report' else 'Review Article' end as study_type,
 case when k % 4 = 0 then 2 when k % 3 = 0 then (k % 5 = 0)::int else word::int end as n_cases, case when k % 4 = 0 then null when k % 3 = 0 then 'why' when not word then 'No identifiable human adverse event cases found in source text.' end as exclusion_reason from x""")
def literature_screen(t):
    k = F.col("o_orderkey")
    name = F.concat(F.lit("Art"), k.cast("string"), F.when(k % 2 == 0, "-Preclinical.pdf").otherwise(".pdf"))
    answer = F.when(k % 4 == 0, '{"is_reportable": true, "study_type": "Case Series", "cases": [{"a": 1}, {"a": 2}').otherwise("none")
    articles = letters(t).select(F.concat(F.lit("dir/"), name).alias("filename"), "text", answer.alias("answer"))
    truth = t("orders").filter(k % 3 == 0).select(F.concat(F.lit("x/y/"), F.upper(name)).alias("pdf_file"), (k % 5 == 0).alias("reportable"), (k % 7 == 0).alias("multicase"), F.lit(None).cast("int").alias("n_cases"), F.lit("why").alias("exclusion_reason"))
    return C.screen(articles, truth)


@query("""with c as (select l_orderkey as a, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) as n, l_partkey, l_linenumber as ln from lineitem), s as (select *, case when ln % 4 = 0 then 'Not stated' else 'P' || ln end as id, case when ln % 3 = 0 then '' else l_partkey::varchar end as dose from c)
select a as document_id, n::int as case_no, name || '#' || n as field, value, case when id = 'Not stated' then '' else id end as scope, array_to_string(list_sort(list_filter((select list(distinct b.id) from s b where b.a = s.a), lambda x: x not in ('Not stated', case when s.id = 'Not stated' then '' else s.id end))), ',') as others
from s, lateral (values ('identifier', id), ('dose', dose)) as f(name, value) where value not in ('', 'Not stated')""")
def literature_scopes(t):
    case = F.struct(F.col("l_linenumber").alias("ln"), "l_partkey", F.when(F.col("l_linenumber") % 4 == 0, "Not stated").otherwise(F.concat(F.lit("P"), F.col("l_linenumber").cast("string"))).alias("identifier"), F.when(F.col("l_linenumber") % 3 == 0, "").otherwise(F.col("l_partkey").cast("string")).alias("dose"))
    articles = t("lineitem").groupBy(F.col("l_orderkey").alias("article_id")).agg(F.array_sort(F.collect_list(case)).alias("cases"))
    got = C.literature_facts(C.split_cases(articles), ("identifier", "dose"))
    return got.select("document_id", "case_no", "field", "value", "scope", F.array_join(F.array_sort("others"), ",").alias("others"))


@query("""with a as (select p_partkey as k, p_partkey % 2 = 0 as rep from part), r as (select p_partkey as k, p_partkey % 3 = 0 as acc, case when p_partkey % 4 = 1 then true end as nr from part where p_partkey % 5 < 2)
select a.k as article_id, case when acc is null then 'PENDING' when acc then 'ACCEPTED' else 'OVERRIDDEN' end as review_status, case when acc = false then coalesce(nr, rep) else rep end as is_reportable, case when acc is not null then 'PENDING|' || rep end as before from a left join r using (k)""")
def article_reviews(t):
    k = F.col("p_partkey")
    articles = t("part").select(k.alias("article_id"), F.lit("PENDING").alias("review_status"), (k % 2 == 0).alias("is_reportable"), F.lit(None).cast("string").alias("exclusion_reason"))
    actions = t("part").filter(k % 5 < 2).select(k.alias("article_id"), (k % 3 == 0).alias("accept"), F.lit("rev").alias("reviewer"), F.when(k % 4 == 1, True).alias("is_reportable"), F.lit(None).cast("string").alias("exclusion_reason"))
    done, audit = C.review_articles(articles, actions, F.lit("2025-01-01").cast("timestamp"))
    return done.join(audit.select("article_id", F.col("original_value").alias("before")).hint("merge"), "article_id", "left").select("article_id", "review_status", "is_reportable", "before")


@query("""with c as (select 'CASE-' || s_suppkey as id, 'mail/' || s_suppkey || '.eml' as email, case when s_suppkey % 2 = 0 then 'pdf/' || s_suppkey // 2 || '.pdf' end as pdf from supplier),
k as (select key, min(id) as id from (select id as key, id from c union select email, id from c union select regexp_extract(email, '[^/]*$'), id from c union select pdf, id from c where pdf is not null union select regexp_extract(pdf, '[^/]*$'), id from c where pdf is not null) group by key),
i as (select s_suppkey as n, case s_suppkey % 3 when 0 then 'x/y/' || s_suppkey || '.eml' when 1 then 'CASE-' || s_suppkey else 'pdf/' || s_suppkey || '.pdf' end as item from supplier)
select n, item, coalesce((select id from k where key = regexp_extract(item, '[^/]*$')), (select id from k where key = item)) as case_id from i""")
def truth_lookup(t):
    k = F.col("s_suppkey").cast("string")
    cases = t("supplier").select(F.concat(F.lit("CASE-"), k).alias("case_id"), F.concat(F.lit("mail/"), k, F.lit(".eml")).alias("source_email"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("pdf/"), (F.col("s_suppkey") / 2).cast("int").cast("string"), F.lit(".pdf"))).alias("source_pdf"))
    n = F.col("s_suppkey") % 3
    item = F.when(n == 0, F.concat(F.lit("x/y/"), k, F.lit(".eml"))).when(n == 1, F.concat(F.lit("CASE-"), k)).otherwise(F.concat(F.lit("pdf/"), k, F.lit(".pdf")))
    return C.truth_of(t("supplier").select(F.col("s_suppkey").alias("n"), item.alias("item")), C.truth_keys(cases), "item")


@query("""with p as (select p_partkey as k, p_name, p_partkey % 6 = 0 as none from part), f as (select k, none, s.section, s.o, s.pos, s.field, case when s.pos = 1 and k % 2 = 0 then 'n/a' else p_name end as value from p, (values ('patient', 10, 0, 'patient_age'), ('patient', 10, 1, 'patientWeight'), ('product', 20 + 10, 1, 'lot_number'), ('triage_exclusion', 1, 0, 'exclusion_reason'), ('odd', 0, 0, 'x')) as s(section, o, pos, field))
select k as envelope_id, o as section_order, section, pos, case field when 'patient_age' then 'Patient Age' when 'patientWeight' then 'Patient Weight' when 'lot_number' then 'Lot Number' else 'Exclusion Reason' end as label, case when value = 'n/a' then 'Not stated' else value end as value from f where section <> 'odd' and none = (o <= 2) and (value <> 'n/a' or field = 'lot_number')""")
def report_rows(t):
    k = F.col("p_partkey")
    item = lambda section, pos, field: F.struct(F.lit(section).alias("section"), F.lit(pos).alias("pos"), F.lit(field).alias("field"))
    rows = F.array(item("patient", 0, "patient_age"), item("patient", 1, "patientWeight"), item("product", 1, "lot_number"), item("triage_exclusion", 0, "exclusion_reason"), item("odd", 0, "x"))
    facts = t("part").select(k.alias("envelope_id"), "p_name", F.inline(rows)).withColumn("value", F.when((F.col("pos") == 1) & (F.col("envelope_id") % 2 == 0), "n/a").otherwise(F.col("p_name")))
    return C.report_rows(facts, t("part").select(k.alias("envelope_id"), (k % 6 == 0).alias("not_relevant")))


@query("""with m as (select doc_id as id from documents), a as (select doc_id as message, i as pos, case when i = 1 then 'photo.png' else 'F' || i || '.PDF' end as filename, case when i = 2 then 'fr' end as language from documents, (values (0), (1), (2)) as n(i)),
x as (select doc_id as message, 'f2.pdf' as f, case when doc_id % 2 = 0 then 'de' else ' ' end as language from documents where doc_id % 3 = 0)
select a.message, a.pos, coalesce(nullif(trim(x.language), ''), a.language) as language, case when pos = 0 then 'case' when pos = 2 then 'own' end as summary from a left join x on x.message = a.message and x.f = lower(a.filename)""")
def attachments(t):
    k, none = F.col("doc_id"), F.lit(None).cast("string")
    rows = t("documents").select(k.alias("message"), F.explode(F.array(*map(F.lit, range(3)))).alias("pos"))
    rows = rows.select("message", "pos", F.when(F.col("pos") == 1, "photo.png").otherwise(F.concat(F.lit("F"), F.col("pos").cast("string"), F.lit(".PDF"))).alias("filename"), F.when(F.col("pos") == 2, "fr").alias("language"), none.alias("flavor"), F.lit("own").alias("own_summary"), F.lit("case").alias("case_summary"))
    found = t("documents").filter(k % 3 == 0).select(k.alias("message"), F.lit("f2.pdf").alias("filename"), F.when(k % 2 == 0, "de").otherwise(" ").alias("language"), none.alias("flavor"))
    return C.attachment_summaries(C.with_metadata(rows, found)).select("message", "pos", "language", "summary")


@query("""with c as (select p_partkey as k, p_partkey % 3 + 1 as n from part) select k as case_id, 'c1' as primary_category, n > 1 as is_multi_label, array_to_string(list_transform(range(n), lambda i: 'c' || (i + 1) || ':' || printf('%.2f', 0.98 - 0.02 * i)), ',') as labels, 'bio marker=' || k || case when n > 1 then ',x y z=' || n else '' end as labs from c""")
def truth_envelopes(t):
    k, n = F.col("p_partkey"), (F.col("p_partkey") % 3 + 1).cast("int")
    cases = t("part").select(k.alias("case_id"), F.slice(F.array(F.lit("c1"), F.lit("c2"), F.lit("c3")), 1, n).alias("categories"), F.create_map(F.lit("bio_marker"), k.cast("string"), F.lit("Biopsy"), F.lit("x")).alias("labs"), F.when(n > 1, F.create_map(F.lit("x_y_z"), n.cast("string"))).alias("diagnostics"))
    labs = C.lab_rows(cases, "case_id", "labs", "diagnostics").groupBy("case_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "test_name", "value"))), lambda x: F.concat_ws("=", x["test_name"], x["value"])), ",").alias("labs"))
    shown = F.array_join(F.transform("labels", lambda x: F.concat(x["category"], F.lit(":"), F.format_number(x["confidence"], 2))), ",")
    return C.truth_envelopes(cases).select("case_id", "primary_category", "is_multi_label", shown.alias("labels")).join(labs.hint("merge"), "case_id", "left")


@query("""with f as (select event_id as k, (event_id % 100) / 100.0::double as c from events where event_id % 3 = 0)
select k as envelope_id, 'NEEDS_REVIEW' as extraction_status, case when k % 2 = 0 then 'EXPEDITED' else 'STANDARD' end as urgency, '[EXTRACTION WARNING] Automated structured extraction could not produce validated facts: bad JSON. Primary triage classification is MI (confidence ' || printf('%.2f', c) || '). Manual clinical review of source communication (f' || k || ') is required.' as document_summary, 0 as total_facts from f""")
def fallback_envelopes(t):
    k = F.col("event_id")
    return C.fallback_envelope(t("events").filter(k % 3 == 0).select(k.alias("envelope_id"), F.concat(F.lit("f"), k.cast("string")).alias("source_filename"), F.lit("MI").alias("primary_category"), ((k % 100) / 100.0).alias("confidence"), (k % 2 == 0).alias("is_icsr"), F.lit("bad JSON").alias("error")))


@query("""select event_id as message_id, coalesce(case when event_id % 3 = 0 then 'u' || user_id end, 'Reviewer') as reviewer_username, event_type as action, true as is_immutable, '{"k":' || (event_id % 7) || ',"t":"x"}' as details, event_id % 7 as k from events""")
def audit_defaults(t):
    from ..operators import store as S

    k = F.col("event_id")
    rows = t("events").select(k.alias("message_id"), "ts", F.when(k % 3 == 0, F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("reviewer_username"), F.col("event_type").alias("action"))
    detail = F.struct((F.col("message_id") % 7).alias("k"), F.lit("x").alias("t"))
    got = S.as_json(S.audit_rows(rows, F.current_timestamp()).withColumn("details", detail), "details")
    back = S.from_json(got.withColumn("d", F.col("details")), d="k long, t string")
    return back.select("message_id", "reviewer_username", "action", "is_immutable", "details", F.col("d.k").alias("k"))
