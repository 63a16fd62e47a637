"""Queries of the view functions and the review queue, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import view as V
from ..operators import review as R
from .catalog import query

_LOW = "list_filter({}, lambda x: length(x) >= 4 and not list_contains(['with','from','this','that','have','been','were','also','daily','once','oral','null','none'], x))"
# Values, snippets and labels by key, the same expressions in both engines.
VALUE = "case cast(p_partkey % 7 as int) when 0 then p_name when 1 then 'aged 54 years' when 2 then 'Unknown' when 3 then concat(p_brand, ' (Hospitalized)') when 4 then 'with, from; this' when 5 then upper(p_type) else '' end"
SNIPPET = "case cast(p_partkey % 5 as int) when 0 then concat(p_name, ' given to a 54yo, lot not recorded') when 1 then concat(p_type, ' ', p_brand) when 2 then 'Dose was not stated; Outcome unknown' when 3 then '-' else concat('The ', p_type, ' Brand was n/a, grounding verified') end"


@query("""with e as (select event_id, ['REVIEWED', 'OVERRIDDEN', 'RECEIVED', 'TRIAGED', 'FAILED'][event_id % 5 + 1] as s, ['accept', 'EDIT_FIELD', 'INGESTION', 'Other', 'override', 'CATEGORY_OVERRIDE', 'AI_TRIAGE_COMPLETED'][event_id % 7 + 1] as a from events)
select event_id, case when s = 'REVIEWED' then 'Reviewed' when s = 'OVERRIDDEN' then 'Overridden' when s in ('RECEIVED', 'TRIAGED') then 'Needs Review' else s end as status_label,
 case upper(a) when 'ACCEPT' then 'Confirmed by Reviewer' when 'EDIT_FIELD' then 'Field Override' when 'INGESTION' then 'System Ingested' when 'OVERRIDE' then 'Reviewer Override' when 'CATEGORY_OVERRIDE' then 'Category Override' when 'AI_TRIAGE_COMPLETED' then 'AI Triage Complete' else a end as action_label from e""")
def view_labels(t):
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("event_id") % len(values) + 1).cast("int"))
    status, action = pick(("REVIEWED", "OVERRIDDEN", "RECEIVED", "TRIAGED", "FAILED")), pick(("accept", "EDIT_FIELD", "INGESTION", "Other", "override", "CATEGORY_OVERRIDE", "AI_TRIAGE_COMPLETED"))
    return t("events").select("event_id", V.status_label(status).alias("status_label"), V.action_label(action).alias("action_label"))


@query("""with f as (select p_partkey, case p_partkey % 4 when 0 then 'mi_' || replace(p_name, ' ', '_') when 1 then replace(p_name, ' ', '-') when 2 then 'lotNumberOf' || p_partkey else '' end as f from part),
s as (select *, regexp_replace(regexp_replace(f, '(?i)^(mi_|pqc_|icsr_)', ''), '([a-z0-9])([A-Z])', '\\1 \\2', 'g') as w, string_split(lower(f), '_') as c from f)
select p_partkey, case when f = '' then 'Parameter' else array_to_string(list_transform(string_split(trim(regexp_replace(w, '[_-]+', ' ', 'g')), ' '), lambda x: upper(x[1]) || x[2:]), ' ') end as label,
 c[1] || array_to_string(list_transform(c[2:], lambda x: case when regexp_matches(x, '^[a-z0-9]') then upper(x[1]) || x[2:] else '_' || x end), '') as camel from s""")
def field_names(t):
    k = F.col("p_partkey") % 4
    f = F.when(k == 0, F.concat(F.lit("mi_"), F.translate("p_name", " ", "_"))).when(k == 1, F.translate("p_name", " ", "-")).when(k == 2, F.concat(F.lit("lotNumberOf"), F.col("p_partkey").cast("string"))).otherwise("")
    return t("part").select("p_partkey", V.field_label(f).alias("label"), V.camel(f).alias("camel"))


@query(f"""with r as (select p_partkey, lower(trim({VALUE})) as v, lower({SNIPPET}) as s from part), w as (select *, {_LOW.format("regexp_split_to_array(v, '[ \\t\\n,;()/-]+')")} as ws, regexp_extract(v, '([0-9]+)', 1) as d from r)
select p_partkey, s <> '' and v not in ('', 'not stated', 'unknown') and (contains(s, v) or (length(d) >= 2 and contains(s, d)) or len(list_filter(ws, lambda x: contains(s, x))) > 0) as supports,
 regexp_matches(s, '\\b(not stated|not done|not performed|not attempted|unknown|unspecified|not recorded|omitted|none reported|n/a|not applicable)\\b') and trim(s) not in ('', 'not stated', 'null', '-', 'unknown') and not regexp_matches(s, 'grounding verified|verified against document source') and (contains(s, 'dose') or contains(s, 'given')) as absent from w""")
def value_support(t):
    rows = t("part").select("p_partkey", F.expr(VALUE).alias("v"), F.expr(SNIPPET).alias("s"))
    return rows.select("p_partkey", V.supports_value(F.col("s"), F.col("v")).alias("supports"), V.supports_absence(F.col("s"), F.lit("dose_given"), F.lit("Outcome")).alias("absent"))


_CRITERIA = ("Hospitalization", "Life-threatening", "Death", "non-serious", "Other medically important", "congenital defect", "unknown")
_SQL_SERIOUS = """o as (select o_orderkey as k, list_filter(['Hospitalization', 'Life-threatening', 'Death', 'non-serious', 'Other medically important', 'congenital defect', 'unknown'], lambda c, i: (o_orderkey // (2 ** (i - 1))::int) % 3 = 1) as c,
 case o_orderkey % 3 when 0 then true when 1 then false end as hosp, o_orderkey % 5 = 0 as life, o_orderkey % 7 = 0 as death, o_orderkey % 11 = 0 as med from orders),
l as (select *, lower(array_to_string(c, ' ')) as j from o)"""


@query(f"""with {_SQL_SERIOUS}, n as (select *, contains(j, 'non-serious') as non, case when contains(j, 'non-serious') then false else coalesce(hosp, false) or regexp_matches(j, 'hospital|inpatient') end as h2,
 case when contains(j, 'non-serious') then false else life or regexp_matches(j, 'life-threatening|life threatening') end as l2, case when contains(j, 'non-serious') then false else death or regexp_matches(j, 'death|fatal') end as d2, case when contains(j, 'non-serious') then false else med or contains(j, 'medically important') end as m2 from l),
v as (select *, case when non then c else list_concat(c, list_filter([case when h2 and not regexp_matches(j, 'hospital|inpatient') then 'Hospitalization' end, case when l2 and not contains(j, 'life-threatening') then 'Life-threatening' end, case when d2 and not contains(j, 'death') then 'Death' end, case when m2 and not contains(j, 'medically') then 'Other Medically Important Condition' end], lambda x: x is not null)) end as c2 from n)
select k, array_to_string(c2, ';') as criteria, h2 as hospitalization, l2 as life_threatening, d2 as death, m2 as medically_important, coalesce(hosp, false) or regexp_matches(j, 'hospital|inpatient') as extracted_hospitalization, contains(j, 'congenital') as extracted_congenital,
 case when coalesce(hosp, false) or regexp_matches(j, 'hospital|inpatient') then '2025-01-01' else 'Not stated' end as admission,
 case when len(list_filter(c, lambda x: not contains(lower(x), 'non-serious') and not contains(lower(x), 'unknown'))) > 0 then 'Serious (' || array_to_string(list_filter(c, lambda x: not contains(lower(x), 'non-serious') and not contains(lower(x), 'unknown')), ' / ') || ')' when hosp then 'Serious (Hospitalization)' when life then 'Serious (Life-threatening)' when death then 'Serious (Death/Fatal)' when med then 'Serious (Medically Significant)' else 'Non-Serious' end as shown from v""")
def seriousness(t):
    k = F.col("o_orderkey")
    c = F.array_compact(F.array(*(F.when(F.floor(k / 2**i) % 3 == 1, F.lit(name)) for i, name in enumerate(_CRITERIA))))
    rows = t("orders").select(k.alias("k"), c.alias("c"), F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("hosp"), (k % 5 == 0).alias("life"), (k % 7 == 0).alias("death"), (k % 11 == 0).alias("med"))
    criteria, new = V.reconciled_serious(F.col("c"), {"hospitalization": F.col("hosp"), "life_threatening": F.col("life"), "death": F.col("death"), "medically_important": F.col("med")})
    hospital = V.extracted_serious("hospitalization", F.col("hosp"), F.col("c"))
    return rows.select(
        "k", F.array_join(criteria, ";").alias("criteria"), *(v.alias(n) for n, v in new.items()), hospital.alias("extracted_hospitalization"), V.extracted_serious("congenital_anomaly", F.lit(None).cast("boolean"), F.col("c")).alias("extracted_congenital"),
        V.admission_date(F.lit("Not stated"), F.lit(" 2025-01-01"), hospital).alias("admission"), V.seriousness_text(F.lit("Unknown"), F.col("c"), F.col("hosp"), F.col("life"), F.col("death"), F.col("med")).alias("shown"),
    )


_ASKED = "case cast(o_orderkey % 6 as int) when 0 then concat('1. What is the dose of ', o_orderpriority, '?\n2) Is it stable at room heat?\n- ok') when 1 then concat('Please say: 1. is ', o_orderstatus, ' right? 2. When does it end?') when 2 then concat('Hello. Is ', o_orderstatus, ' there? And why? Bye') when 3 then 'Not stated' when 4 then concat('* Only a remark on ', o_orderstatus) else concat('No mark ', o_orderpriority) end"


@query(f"""with q as (select o_orderkey, {_ASKED} as text from orders),
l as (select *, list_filter(list_transform(regexp_split_to_array(text, '\\r?\\n'), lambda x: trim(regexp_extract(trim(x), '^(?:\\(?\\d+[.)]|-|\\*|•)\\s*(.+)$', 1))), lambda x: length(x) > 5) as lines,
 list_filter(list_transform(regexp_split_to_array(text, '(?:^|\\s+)(?:\\(?\\d+[.)]|-|\\*|•)\\s+'), lambda x: trim(x)), lambda x: length(x) > 5) as parts, regexp_extract_all(text, '([^.?!;]*\\?)', 1) as marks from q)
select o_orderkey, case when text = 'Not stated' then '' when len(lines) > 1 then array_to_string(lines, '|') when len(parts) > 1 then array_to_string(parts, '|')
 when len(marks) > 0 then array_to_string(list_filter(list_transform(marks, lambda x: trim(regexp_replace(x, '^(?:\\(?\\d+[.)]|-|\\*|•)\\s*', ''))), lambda x: length(x) > 5), '|') else trim(regexp_replace(text, '^(?:\\(?\\d+[.)]|-|\\*|•)\\s*', '')) end as questions from l""")
def question_tiers(t):
    return t("orders").select("o_orderkey", F.array_join(V.asked(F.expr(_ASKED)), "|").alias("questions"))


@query("""with m as (select p_partkey as k, [null, 'English', 'Spanish', 'und', 'DE'][p_partkey % 5 + 1] as lang, [{'language': ['English', 'French', null][p_partkey % 3 + 1], 'flavor': ['non_english', 'digital_form'][p_partkey % 2 + 1]}, {'language': ['', 'it'][p_partkey % 7 % 2 + 1], 'flavor': 'digital_form'}] as a from part),
f as (select *, list_filter(a, lambda x: coalesce(lower(trim(x.language)) not in ('', 'english', 'en', 'unknown', 'und'), false) or (x.flavor = 'non_english' and not coalesce(lower(trim(x.language)) in ('english', 'en'), false))) as odd, coalesce(lower(trim(lang)) not in ('', 'english', 'en', 'unknown', 'und'), false) as own from m)
select k, case when len(odd) > 0 and coalesce(lower(trim(odd[1].language)) not in ('', 'english', 'en', 'unknown', 'und'), false) then odd[1].language when own then lang when len(odd) > 0 then coalesce(nullif(odd[1].language, ''), 'Non-English') end as foreign_language from f""")
def foreign_languages(t):
    k = F.col("p_partkey")
    pick = lambda n, *values: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    one = F.struct(pick(k, "English", "French", None).alias("language"), pick(k, "non_english", "digital_form").alias("flavor"))
    two = F.struct(pick(k % 7, "", "it").alias("language"), F.lit("digital_form").alias("flavor"))
    return t("part").select(k.alias("k"), V.foreign_language(pick(k, None, "English", "Spanish", "und", "DE"), F.array(one, two)).alias("foreign_language"))


_SQL_ROWS = """r as (select l_orderkey as k, l_linenumber as n, [l_returnflag, case when l_linenumber % 3 = 0 then null else l_linestatus || chr(10) || 'x' end, case when l_linenumber % 2 = 0 then '' else l_linestatus end] as cells from lineitem where l_linenumber > 1)"""


@query(f"""with {_SQL_ROWS}, c as (select k, n, list_transform(cells, lambda x: trim(replace(coalesce(x, ''), chr(10), ' '))) as cells from r),
t as (select k, '| Flag | Mode |  |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || array_to_string(cells, ' | ') || ' |', chr(10) order by n, cells) as md,
 string_agg(array_to_string(list_filter([case when cells[1] <> '' then 'Flag: ' || cells[1] end, case when cells[2] <> '' then 'Mode: ' || cells[2] end, case when cells[3] <> '' then cells[3] end], lambda x: x is not null), ' | '), chr(10) order by n, cells) as texts from c group by k) select k, md, texts from t""")
def table_texts(t):
    rows = t("lineitem").filter("l_linenumber > 1")
    cells = F.array("l_returnflag", F.when(F.col("l_linenumber") % 3 != 0, F.concat("l_linestatus", F.lit("\nx"))), F.when(F.col("l_linenumber") % 2 == 0, "").otherwise(F.col("l_linestatus")))
    shown = F.transform(cells, lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "\n", " ")))
    head = F.array(*map(F.lit, ("Flag ", "Mode", "")))
    got = rows.groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), shown.alias("order"), cells.alias("cells")))).alias("r"))
    each = F.transform("r", lambda x: x["cells"])
    return got.select("k", V.markdown(F.concat(F.array(head), each)).alias("md"), F.array_join(F.transform(each, lambda c: V.row_text(head, c)), "\n").alias("texts"))


@query(f"""with r as (select p_partkey, {VALUE} as value, {SNIPPET} as snippet from part), n as (select *, lower(trim(value)) as v, lower(trim(regexp_replace(snippet, '[\\r\\n]+', ' ', 'g'))) as s from r),
u as (select *, v not in ('', 'not stated', 'null', 'n/a', '-', 'unknown', 'not done') and length(v) >= 2 as stated, lower(trim(snippet)) not in ('', 'not stated', 'null', 'n/a', '-', 'unknown', 'not done') as quoted, trim(regexp_extract(v, '\\(([^)]+)\\)', 1)) as inside from n),
w as (select *, list_filter(list_transform(string_split(s, ' '), lambda x: regexp_replace(x, '[(),;:."'']', '', 'g')), lambda x: (length(x) >= 4 or (length(x) >= 3 and regexp_matches(x, '[0-9]'))) and x not in ('stat', 'with', 'from', 'this', 'that', 'were', 'have', 'been')) as ws from u),
x as (select *, list_transform(list_sort(list_transform(ws, lambda x, i: {{'n': -length(x), 'i': i, 'w': x}})), lambda x: x.w) as ordered from w),
e as (select p_partkey, list_filter(list_concat([case when stated and inside <> '' then inside end, case when stated and inside like '%ed' then regexp_replace(inside, 'ed$', '') || 'ation' end, case when stated and v not in ('yes', 'no', 'unknown', 'none') then v end, case when quoted and length(s) >= 4 then s end], case when quoted then ordered else [] end), lambda x: x is not null) as terms from x)
select p_partkey, array_to_string(list_filter(terms, lambda x, i: list_position(terms, x) = i), '|') as terms from e""")
def highlight_terms(t):
    return t("part").select("p_partkey", F.array_join(V.highlight_terms(F.expr(VALUE), F.expr(SNIPPET)), "|").alias("terms"))


@query("""with m as (select event_id as id, case event_id % 5 when 0 then 'Re: CASE-0' || (event_id % 9 + 1) || ' reply' else 'Report ' || event_id end as subject, case event_id % 7 when 0 then '<case11.' || event_id || '@x>' else '<' || event_id || '@x>' end as mid, case event_id % 11 when 0 then 'case-' || (event_id % 90) else 'none' end as given from events),
r as (select *, row_number() over (order by id) + 12 as running from m)
select id, case when regexp_matches(given, '(?i)^CASE-\\d+$') then upper(given) else 'CASE-' || coalesce(nullif(regexp_extract(subject, '(?i)CASE-?(0[1-9]|1[0-2])\\b', 1), ''), nullif(regexp_extract(mid, '(?i)CASE-?(0[1-9]|1[0-2])\\b', 1), ''), case when running < 10 then '0' || running else running::varchar end) end as case_id from r""")
def case_ids(t):
    k = F.col("event_id")
    subject = F.when(k % 5 == 0, F.concat(F.lit("Re: CASE-0"), (k % 9 + 1).cast("string"), F.lit(" reply"))).otherwise(F.concat(F.lit("Report "), k.cast("string")))
    mid = F.concat(F.when(k % 7 == 0, "<case11.").otherwise("<"), k.cast("string"), F.lit("@x>"))
    rows = t("events").select(k.alias("id"), subject.alias("subject"), mid.alias("mid"), F.when(k % 11 == 0, F.concat(F.lit("case-"), (k % 90).cast("string"))).otherwise("none").alias("given"))
    return R.running_numbers(rows).select("id", V.case_id(F.col("given"), F.col("subject"), F.col("mid"), F.col("running")).alias("case_id"))


_RATIONALE = "case cast(event_id % 6 as int) when 0 then concat('[RapidFuzz: ', cast(event_id % 100 as string), '% ratio]') when 1 then 'directly contains the value' when 2 then concat(cast(event_id % 50 as string), '.5 % token match') when 3 then 'normalized form' when 4 then '' else 'semantic' end"


@query(f"""with e as (select event_id, {_RATIONALE.replace("as string", "as varchar")} as r, case when event_id % 4 <> 0 then 'SUPPORTS' else 'INSUFFICIENT' end as res, (event_id % 10) / 10.0::double as c from events),
f as (select *, coalesce(nullif(regexp_extract(r, '(?i)\\[RapidFuzz:\\s*([0-9]+)%', 1), ''), nullif(regexp_extract(r, '(?i)([0-9]+(?:\\.[0-9]+)?)\\s*%\\s*(?:token match|lexical|match)', 1), ''))::double as found from e)
select event_id, coalesce(floor(found + 0.5)::int, case when res = 'SUPPORTS' then case when contains(r, 'directly contains') then 100 when contains(r, 'normalized') then 98 when c > 0.8 then round(c * 100)::int else 85 end end) as score,
 array_to_string(list_filter([case when event_id % 3 > 0 then (event_id % 3) || ' Confirmed' end, case when event_id % 4 > 0 then (event_id % 4) || ' Not Stated' end, case when event_id % 5 > 0 then (event_id % 5) || ' Uncertain' end], lambda x: x is not null), ' · ') as stats,
 'Case ' || event_id || case event_id % 3 when 0 then ' — P-' || event_id when 1 then ' — 54yo F' else '' end as label,
 case event_id % 4 when 0 then 'ICSR|PQC' when 1 then 'MI|PQC' when 2 then 'MI' else 'Pending Triage' end as categories,
 case event_id % 4 when 0 then 'Yes (HCP Confirmed)' when 1 then 'No' when 2 then null else 'Nurse' end as professional, case when event_id % 2 = 0 then (event_id % 500)::int end as cohort,
 ['defect_image', 'scanned_page', 'table_cell', 'email_header', 'pdf_text', 'pdf_text', 'email_body'][event_id % 7 + 1] as source_kind from f""")
def view_texts(t):
    k = F.col("event_id")
    pick = lambda *values: F.element_at(F.array(*(v if isinstance(v, type(k)) else F.lit(v) for v in values)), (k % len(values) + 1).cast("int"))
    labels = F.when(k % 4 == 1, F.array(F.lit("MI"), F.lit("PQC"))).when(k % 4 == 2, F.array(F.lit("MI")))
    cohort = F.when(k % 2 == 0, F.concat(F.lit("A "), (k % 500).cast("string"), F.lit("-patient registry"))).otherwise("A series of 4 patients")
    return t("events").withColumn("r", F.expr(_RATIONALE)).select(
        "event_id", V.match_score(F.col("r"), F.when(k % 4 != 0, "SUPPORTS").otherwise("INSUFFICIENT"), (k % 10) / 10.0).alias("score"), V.stats_text(k % 3, k % 4, k % 5, F.lit(0)).alias("stats"),
        V.case_label(k, F.when(k % 3 == 0, F.concat(F.lit("P-"), k.cast("string"))).otherwise("Not stated"), F.when(k % 3 == 1, "54"), F.when(k % 3 == 1, "F")).alias("label"),
        F.array_join(V.categories(pick("ICSR + PQC", "MI", None, None), labels), "|").alias("categories"), V.professional(pick("true", " n ", "Not done", "Nurse")).alias("professional"), V.cohort_size(cohort, F.lit(2)).alias("cohort"),
        V.source_kind(pick("Photo of defect", "handwritten note", "Table 2", "mail header", "a pdf", None, "other"), pick("a", "b.pdf", "c", "d", "e", "f.PDF", "g.eml")).alias("source_kind"),
    )


@query("""with m as (select doc_id as id, case when doc_id % 4 > 0 then ['ICSR', 'PQC', 'MI'][doc_id % 4] end as category, case when doc_id % 4 > 0 then (doc_id % 10) / 10.0::double end as confidence, ['RECEIVED', 'TRIAGED', 'REVIEWED'][doc_id % 3 + 1] as status from documents),
a as (select doc_id as message from documents where doc_id % 2 = 0 union all select doc_id from documents where doc_id % 6 = 0)
select id, coalesce(category, 'Pending Triage') as primary_category, coalesce(confidence, 0.0) as confidence, (select count(*) from a where message = id) as attachment_count, id % 5 = 0 and id % 10 <> 0 as requires_human_review from m where status in ('RECEIVED', 'TRIAGED')""")
def queue_rows(t):
    k = F.col("doc_id")
    status = F.element_at(F.array(*map(F.lit, ("RECEIVED", "TRIAGED", "REVIEWED"))), (k % 3 + 1).cast("int"))
    m = t("documents").select(k.alias("id"), F.when(k % 4 > 0, F.element_at(F.array(*map(F.lit, ("ICSR", "PQC", "MI", "x"))), F.greatest((k % 4), F.lit(1)).cast("int"))).alias("primary_category"), F.when(k % 4 > 0, (k % 10) / 10.0).alias("confidence"), status.alias("status"))
    files = t("documents").filter(k % 2 == 0).select(k.alias("message")).unionByName(t("documents").filter(k % 6 == 0).select(k.alias("message")))
    pqc = t("documents").filter(k % 5 == 0).select(k.alias("message"), (k % 10 != 0).alias("requires_human_review"))
    return R.queue_rows(R.by_status(m, "NEEDS_REVIEW"), files, pqc).select("id", "primary_category", "confidence", "attachment_count", "requires_human_review")


@query("""select event_id as id, row_number() over (order by ts desc, event_id desc) as place from events where contains(lower(event_type), '77') or contains(lower(user_id::varchar), '77') or contains('case-' || event_id, '77') order by ts desc, event_id desc limit 500""")
def audit_search(t):
    rows = t("events").select(F.col("event_id").alias("message_id"), "ts", F.col("user_id").cast("string").alias("reviewer_username"), F.col("event_type").alias("action"))
    got = R.newest_first(R.audit_search(rows, "77"), "ts", "message_id").limit(500).select(F.col("message_id").alias("id"), F.struct(F.col("ts"), F.col("message_id")).alias("o"))
    from pyspark.sql.window import Window

    return got.withColumn("place", F.row_number().over(Window.orderBy(F.desc("o"))).cast("long")).drop("o")


@query("""with m as (select c_custkey as k, ['ICSR', 'PQC'][c_custkey % 2 + 1] as cat from customer) select k, case when k % 3 = 0 then 'MI' else cat end as category, case when k % 3 = 0 then 'OVERRIDDEN' else 'TRIAGED' end as status, case when k % 3 = 0 then cat end as original from m""")
def override_category(t):
    k = F.col("c_custkey")
    m = t("customer").select(k.alias("message_id"), F.when(k % 2 == 0, "ICSR").otherwise("PQC").alias("primary_category"), F.lit("TRIAGED").alias("status"))
    actions = t("customer").select(k.alias("message_id"), F.when(k % 3 == 0, "MI").alias("new_category"), F.lit(None).cast("string").alias("reviewer_username"), F.lit("why").alias("justification"))
    done, audit = R.override(m, actions)
    return done.join(audit.select("message_id", F.col("original_value").alias("original")).hint("merge"), "message_id", "left").select(F.col("message_id").alias("k"), F.col("primary_category").alias("category"), "status", "original")


@query("""with f as (select c_custkey as k, 'subject' as col, c_name as e, case when c_custkey % 4 = 0 then upper(c_name) || '!' else c_name end as g from customer union all select c_custkey, 'sender', c_mktsegment, case when c_custkey % 6 = 0 then null else c_mktsegment end from customer)
select k, col, e as expected, g as found from f where e is distinct from g""")
def header_mismatches(t):
    k = F.col("c_custkey")
    want = t("customer").select(k.alias("k"), F.col("c_name").alias("subject"), F.col("c_mktsegment").alias("sender"))
    found = t("customer").select(k.alias("k"), F.when(k % 4 == 0, F.concat(F.upper("c_name"), F.lit("!"))).otherwise(F.col("c_name")).alias("subject"), F.when(k % 6 != 0, F.col("c_mktsegment")).alias("sender"))
    return R.mismatched(found, want, "k", ["subject", "sender"]).withColumnRenamed("column", "col")


@query("""with c as (select doc_id, ['ICSR', 'MI'][toxic + 1] as cat, quality = 1 as multi from labels where toxic is not null and quality is not null), a as (select doc_id, case when length(text) % 3 = 0 then 'Medical Information' else 'icsr' end as cat, length(text) % 2 = 0 as multi, source, length(text) as ms from documents where doc_id % 9 <> 0),
j as (select c.doc_id, coalesce((case when a.cat = 'Medical Information' then 'MI' else upper(a.cat) end) = c.cat and a.multi = c.multi, false) and (c.doc_id % 2 = 1 or coalesce(contains(a.source, '1'), false)) as passed, ms from c left join a using (doc_id))
select count(*) as cases, count(*) filter (passed) as passed, round(100 * avg(passed::int), 1) as accuracy, floor(avg(ms))::bigint as mean_latency_ms from j""")
def evaluation(t):
    cases = t("labels").dropna(subset=["toxic", "quality"]).select(F.col("doc_id").alias("case_id"), F.when(F.col("toxic") == 0, "ICSR").otherwise("MI").alias("category"), (F.col("quality") == 1).alias("multi"))
    n = F.length("text")
    answers = t("documents").filter("doc_id % 9 != 0").select(F.col("doc_id").alias("case_id"), F.when(n % 3 == 0, "Medical Information").otherwise("icsr").alias("category"), (n % 2 == 0).alias("multi"), F.create_map(F.lit("source"), F.col("source")).alias("fields"), n.alias("latency_ms"))
    return R.evaluation(R.accuracy(cases, answers, cases.filter("case_id % 2 = 0").select("case_id", F.lit("source").alias("field"), F.lit("1").alias("expected"))))


@query("""with f as (select p_partkey as e, s.section, s.status from part, (values ('PATIENT', 'UNCERTAIN'), ('DEFECT', 'CONFLICT'), ('INQUIRY', 'CONFIRMED'), ('PRODUCT', 'CONFIRMED'), ('REPORTER', 'UNCERTAIN')) as s(section, status))
select e, section from f where status in ('UNCERTAIN', 'CONFLICT') and case e % 3 when 0 then section in ('PATIENT', 'REPORTER', 'PRODUCT') when 1 then section in ('PRODUCT', 'REPORTER', 'DEFECT', 'INQUIRY') else false end""")
def visible_facts(t):
    e = F.col("p_partkey")
    rows = F.array(*(F.struct(F.lit(a).alias("section"), F.lit(b).alias("status")) for a, b in (("PATIENT", "UNCERTAIN"), ("DEFECT", "CONFLICT"), ("INQUIRY", "CONFIRMED"), ("PRODUCT", "CONFIRMED"), ("REPORTER", "UNCERTAIN"))))
    facts = t("part").select(e.alias("envelope_id"), F.inline(rows))
    cases = t("part").select(e.alias("envelope_id"), F.when(e % 3 == 0, F.array(F.lit("ICSR"))).when(e % 3 == 1, F.array(F.lit("PQC"), F.lit("MI"))).otherwise(F.array(F.lit("NOT_RELEVANT"))).alias("categories"))
    return R.view_facts(R.visible_facts(facts, cases), status="ATTENTION").select(F.col("envelope_id").alias("e"), "section")
