"""Cases: answers to facts and back, triage, routing and status, citations, literature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions import view as V
from ..functions.jsonfix import parsed
from .ledger import STATUSES
from .retrieval import best_evidence, citation_level
from .shared import dealt

UNSTATED = "Not stated"
# Fields of each section in order, with the key of an answer that each is read from and what normalises it.
SECTIONS = {
    "patient": (("patient_identifier", "identifier"), ("patient_dob", "dob"), ("patient_age", "age"), ("patient_sex", "sex"), ("patient_weight", "weight"), ("patient_height", "height"), ("patient_country", "patient_country"), ("patient_medical_history", "medical_history"), ("treated_indication", "treated_indication")),
    "reporter": (("reporter_name", "name"), ("reporter_role", "role"), ("reporter_specialty", "specialty"), ("reporter_institution", "institution"), ("reporter_country", "country"), ("reporter_contact", "contact"), ("health_professional", "health_professional")),
    "product": (("suspect_product", "product_name"), ("product_formulation", "formulation"), ("product_dose", "dose"), ("product_frequency", "frequency"), ("product_route", "route"), ("indication", "indication"), ("lot_number", "lot_number"), ("expiry_date", "expiry_date"), ("treatment_start_date", "start_date"), ("treatment_stop_date", "stop_date"), ("treatment_duration", "duration"), ("action_taken", "action_taken")),
    "reaction": (("adverse_event", "adverse_event"), ("reaction_onset_date", "onset_date"), ("reaction_outcome", "outcome"), ("seriousness_criteria", "seriousness_criteria"), ("hospitalization", "hospitalization"), ("hospital_admission_date", "admission_date"), ("life_threatening", "life_threatening"), ("death", "death"), ("medically_important", "medically_important"), ("dechallenge", "dechallenge"), ("rechallenge", "rechallenge")),
    "regulatory": (("mfr_control_number", "mfr_control_number"), ("date_received_by_mfr", "date_received_by_mfr")),
    "pqc": (("product_name", "product_name"), ("lot_number", "lot_number"), ("expiry_date", "expiry_date"), ("defect_type", "defect_type"), ("defect_description", "defect_description"), ("packaging_breached", "packaging_breached"), ("sample_available", "sample_available"), ("quantity_affected", "quantity_affected"), ("storage_conditions", "storage_conditions"), ("photo_detected", "photo_detected")),
    "mi": (("product_or_topic", "product_or_topic"), ("inquiry_type", "inquiry_type"), ("question_text", "question_text"), ("clinical_context", "clinical_context"), ("requester", "requester"), ("explicit_no_ae_no_pqc", "explicit_no_ae_no_pqc")),
    "not_relevant": (("exclusion_reason", "exclusion_reason"), ("classification", "classification")),
}
NORMALISED = {"patient_age": T.age, "patient_sex": T.sex, "patient_country": T.country, "reporter_country": T.country, "product_route": T.route, "treatment_start_date": T.iso_date, "treatment_stop_date": T.iso_date, "reaction_onset_date": T.iso_date}
# Other names under which a citation may stand, by field, the likeliest first.
ALIASES = {
    "mi_product": ("mi_product_or_topic", "product_or_topic", "product_name", "product"), "inquiry_type": ("mi_inquiry_type", "inquiryType"), "inquiry_summary": ("mi_question_text", "question_text", "questionText", "question"),
    "clinical_context": ("mi_clinical_context", "clinicalContext"), "mi": ("medical_info", "medicalInfo"), "medical_info": ("mi", "medicalInfo"), "pqc_product_name": ("pqcProduct", "pqc_product", "product_name", "productName", "product"),
    "pqc_lot_number": ("pqcLot", "pqc_lot", "lot_number", "lotNumber", "lot"), "defect_type": ("pqc_defect_type", "defectType", "physical_defect_type"), "defect_description": ("pqc_defect_description", "defectDescription", "defect_desc"), "packaging_breached": ("packagingBreached",),
}


def fact_row(field: Column, value: Column, normalised: Column | None = None, declared: Column | None = None) -> Column:
    """A fact from an answer's value: unstated, else as declared where that is a status, else confirmed; less sure where uncertain."""
    said = F.coalesce(value, F.lit(UNSTATED))
    legal = F.upper(declared) if declared is not None else F.lit(None).cast("string")
    status = F.when(T.is_unstated(said, "extract"), "NOT_STATED").when(legal.isin(*STATUSES), legal).otherwise("CONFIRMED")
    norm = normalised.cast("string") if normalised is not None else F.lit(None).cast("string")
    return F.struct(field.alias("field"), said.alias("value"), norm.alias("normalized"), status.alias("status"), F.when(status == "UNCERTAIN", 0.85).otherwise(1.0).alias("confidence"))


def section_facts(answers: DataFrame, sections: tuple[str, ...] = tuple(SECTIONS), key_column: str = "envelope_id") -> DataFrame:
    """(key, section, pos, fact columns): the ledger of answers whose sections are maps from key to text; a null section has no facts."""
    rows = []
    for name in sections:
        get = lambda k, name=name: F.try_element_at(F.col(name), F.lit(k))
        facts = [fact_row(F.lit(field), get(k), NORMALISED[field](get(k)) if field in NORMALISED else None, get("status")) for field, k in SECTIONS[name]]
        placed = F.array(*(F.struct(F.lit(name).alias("section"), F.lit(i).alias("pos"), f.alias("f")) for i, f in enumerate(facts)))
        rows.append(F.when(F.col(name).isNotNull(), placed))
    return dealt(answers, key_column).select(key_column, F.inline(F.flatten(F.array_compact(F.array(*rows))))).select(key_column, "section", "pos", "f.*")


def lab_facts(cases: DataFrame, key_column: str = "envelope_id") -> DataFrame:
    """labs array<struct<test_name, value, unit>> to facts lab_test_<name>; tests without a name are left out."""
    rows = cases.select(key_column, F.posexplode("labs").alias("pos", "x")).filter(F.coalesce("x.test_name", F.lit("")) != "")
    said = lambda c: F.coalesce(F.col(f"x.{c}").cast("string"), F.lit(""))
    name = F.concat(F.lit("lab_test_"), F.translate(F.lower("x.test_name"), " ", "_"))
    return rows.select(key_column, "pos", fact_row(name, F.concat(F.col("x.test_name"), F.lit(": "), said("value"), F.lit(" "), said("unit"))).alias("f")).select(key_column, "pos", "f.*")


def lab_fact_of(labs: DataFrame, facts: DataFrame) -> DataFrame:
    """Lab rows (envelope_id, pos, test_name) with the first lab fact (envelope_id, pos, field) whose name holds the test's."""
    pairs = labs.join(facts.filter(F.col("field").startswith("lab_test_")).select("envelope_id", F.col("pos").alias("fact_pos"), "field").hint("merge"), "envelope_id")
    first = pairs.filter(F.col("field").contains(F.lower("test_name"))).groupBy("envelope_id", "pos").agg(F.min_by("field", "fact_pos").alias("lab_field"))
    return labs.join(first.hint("merge"), ["envelope_id", "pos"], "left")


def drug_facts(cases: DataFrame, key_column: str = "envelope_id") -> DataFrame:
    """drugs array<map<string,string>> to facts concomitant_drug_<i>: name and dose under either of their keys."""
    rows = cases.select(key_column, F.posexplode("drugs").alias("pos", "x"))
    get = lambda *keys: F.coalesce(*(F.nullif(F.try_element_at("x", F.lit(k)), F.lit("")) for k in keys), F.lit(UNSTATED))
    value = F.concat(get("drug_name", "medication_name"), F.lit(" ("), get("dose_and_route", "dose"), F.lit(")"))
    return rows.select(key_column, "pos", fact_row(F.concat(F.lit("concomitant_drug_"), (F.col("pos") + 1).cast("string")), value).alias("f"), get("dates", "start_date").alias("dates")).select(key_column, "pos", "f.*", "dates")


def question_facts(cases: DataFrame, key_column: str = "envelope_id", text: str = "question_text") -> DataFrame:
    rows = cases.select(key_column, F.posexplode(V.asked(F.col(text))).alias("pos", "q"))
    return rows.select(key_column, "pos", fact_row(F.concat(F.lit("mi_question_"), (F.col("pos") + 1).cast("string")), F.col("q")).alias("f")).select(key_column, "pos", "f.*")


def cited_evidence(citation: Column, filename: Column, place: str = "Source document") -> Column:
    """Evidence of a citation (map of texts): null where its snippet is empty or unstated."""
    get = lambda k: F.try_element_at(citation, F.lit(k))
    snippet = F.trim(get("verbatim_snippet"))
    return F.when(~F.lower(snippet).isin("not stated", "none", ""), F.struct(filename.alias("source_id"), V.source_kind(get("source_type"), filename).alias("source_type"), F.coalesce(F.nullif(get("page_or_location"), F.lit("")), F.lit(place)).alias("place"), snippet.alias("snippet")))


def flat_record(facts: DataFrame, fields: list[str]) -> DataFrame:
    """Facts to one record per envelope, unstated where a fact is missing; the indication falls back to the treated one."""
    wide = facts.groupBy("envelope_id").pivot("field", fields).agg(F.min_by("value", "pos"))
    out = wide.select("envelope_id", *(F.coalesce(f, F.lit(UNSTATED)).alias(f) for f in fields))
    if {"indication", "treated_indication"} <= set(fields):
        out = out.withColumn("indication", F.when(F.col("indication") == UNSTATED, F.col("treated_indication")).otherwise(F.col("indication")))
    return out


def narrative() -> Column:
    """The first that is stated of clinical_narrative, document_summary and reviewer_summary."""
    return F.coalesce(*(F.when(~F.col(c).isin(UNSTATED, ""), F.col(c)) for c in ("clinical_narrative", "document_summary", "reviewer_summary")), F.lit(UNSTATED))


def section_citations(evidence: DataFrame) -> DataFrame:
    """(envelope_id, part, citation): of all evidence of a section's facts the best, whatever value it bears out.

    evidence: envelope_id, part (patient, reporter, product, reaction, pqc, mi), and what ``best_evidence`` takes but for a value.
    """
    best = best_evidence(evidence.withColumn("value", F.lit("")), ["envelope_id", "part"])
    level = citation_level(F.col("source_type"), F.col("page"), F.col("has_box"), F.col("char_start"), F.col("char_end"))
    return best.select("envelope_id", "part", F.struct("pos", "source_type", "page", "snippet", level.alias("level")).alias("citation"))


def flat_case(facts: DataFrame, fields: list[str], cases: DataFrame, evidence: DataFrame) -> DataFrame:
    """``flat_record`` with the case's narrative and, by section, its citation (a map; sections without evidence are not in it)."""
    cited = section_citations(evidence).groupBy("envelope_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("part", "citation")))).alias("section_citations"))
    told = cases.select("envelope_id", narrative().alias("narrative"))
    return told.join(flat_record(facts, fields).hint("merge"), "envelope_id", "left").join(cited.hint("merge"), "envelope_id", "left")


def ground_questions(questions: DataFrame, citations: DataFrame) -> DataFrame:
    """questions (case_id, n from 0, question, body) with where they stand: tier, snippet, pos, char_start, char_end.

    Tiers: "key", a citation under the question's number; "snippet", the first citation whose snippet holds the question, or its first 20 characters if it is
    longer; "body", the question's place in the body, without its mark or with it, over 5 characters; else null. citations: case_id, pos, name, snippet. A
    case's citations come to each of its questions as one array, so no pairs are made.
    """
    held = citations.filter(F.coalesce("snippet", F.lit("")) != "").groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("pos", "name", "snippet"))).alias("_all"))
    rows = questions.join(held.hint("merge"), "case_id", "left").withColumn("_all", F.coalesce("_all", F.array().cast("array<struct<pos:int,name:string,snippet:string>>")))
    number = (F.col("n") + 1).cast("string")
    named = lambda name: F.get(F.filter("_all", lambda c: c["name"] == F.concat(F.lit(name), number)), F.lit(0))
    key = F.coalesce(*map(named, ("question_", "mi_question_", "question-", "mi_question-")))
    q = F.lower(F.trim("question"))
    said = F.get(F.filter("_all", lambda c: F.lower(c["snippet"]).contains(F.col("_q")) | ((F.length("_q") > 20) & F.lower(c["snippet"]).contains(F.left("_q", F.lit(20))))), F.lit(0))
    bare, whole = F.trim(F.regexp_replace("question", r"^(\(?[0-9]+[.)]|-|\*|•)\s*", "")), F.trim("question")
    place = lambda s: F.when(F.length(s) > 5, F.nullif(F.position(F.lower(s), F.lower("body")), F.lit(0)) - 1)
    rows = rows.withColumn("_q", q).withColumn("_key", key).withColumn("_said", said).withColumn("_at", F.coalesce(place(bare), place(whole))).withColumn("_n", F.when(place(bare).isNotNull(), F.length(bare)).otherwise(F.length(whole)))
    cited, in_body = F.coalesce("_key", "_said"), F.col("_at").isNotNull()
    tier = F.when(F.col("_key").isNotNull(), "key").when(F.col("_said").isNotNull(), "snippet").when(in_body, "body")
    own = F.when(tier == "body", F.col("_at"))
    snippet = F.coalesce(cited["snippet"], F.when(in_body, F.substring("body", F.col("_at") + 1, F.col("_n"))))
    return rows.select(*questions.columns, tier.alias("tier"), snippet.alias("snippet"), cited["pos"].alias("pos"), own.alias("char_start"), (own + F.col("_n")).alias("char_end"))


def fallback_envelope(failed: DataFrame) -> DataFrame:
    """What stands for an extraction that failed (envelope_id, source_filename, primary_category, confidence, is_icsr, error): to be reviewed, with nothing stated."""
    summary = F.concat(F.lit("[EXTRACTION WARNING] Automated structured extraction could not produce validated facts: "), F.col("error"), F.lit(". Primary triage classification is "), F.col("primary_category"), F.lit(" (confidence "), F.format_number("confidence", 2), F.lit("). Manual clinical review of source communication ("), F.col("source_filename"), F.lit(") is required."))
    return failed.select("envelope_id", F.lit("NEEDS_REVIEW").alias("extraction_status"), F.when(F.col("is_icsr"), "EXPEDITED").otherwise("STANDARD").alias("urgency"), summary.alias("document_summary"), F.lit(0).alias("total_facts"))


def upsert_facts(shown: DataFrame, raw: DataFrame) -> DataFrame:
    """View facts (envelope_id, field, value, status) updated from raw ones (…, confidence double or null), by field or its snake-case form; new ones added."""
    rows = raw.withColumn("_k", T.snake(F.col("field"))).groupBy("envelope_id", "_k").agg(F.max_by(F.struct("field", "value", "status", "confidence"), "pos").alias("r"))
    missing = T.is_unstated(F.col("r.value"), "view")
    status = F.coalesce("r.status", F.when(missing, "NOT_STATED").otherwise("CONFIRMED"))
    score = F.when(~missing & (status != "NOT_STATED"), F.coalesce("r.confidence", F.when(status == "UNCERTAIN", 0.65).otherwise(0.95)))
    level = F.when(F.col("r.confidence").isNull(), F.when(status == "UNCERTAIN", "LOW").otherwise("HIGH")).when(F.col("r.confidence") >= 0.85, "HIGH").when(F.col("r.confidence") >= 0.6, "MEDIUM").otherwise("LOW")
    rows = rows.withColumns({"_missing": missing, "_status": status, "score": score, "level": F.when(score.isNotNull(), level)})
    both = shown.withColumn("_k", T.snake(F.col("field"))).join(rows.hint("merge"), ["envelope_id", "_k"], "full_outer")
    new = F.col("r").isNotNull()
    return both.select("envelope_id", F.coalesce("field", "r.field").alias("field"), F.when(new, F.when(F.col("_missing"), UNSTATED).otherwise(F.col("r.value"))).otherwise(F.col("value")).alias("value"), F.when(new, F.col("_status")).otherwise(F.col("status")).alias("status"), "score", "level")


def photo_evidence(images: Column) -> Column:
    """Of images (array of struct with bbox) the first with a box, else the first."""
    return F.coalesce(F.get(F.filter(images, lambda x: x["bbox"].isNotNull()), F.lit(0)), F.get(images, F.lit(0)))


def merged_citations(*maps: Column) -> Column:
    """Maps from field to citation as one; later ones win."""
    every = F.concat(*(F.coalesce(F.map_entries(m), F.array().cast("array<struct<key:string,value:string>>")) for m in maps))
    keys = F.array_distinct(F.transform(every, lambda e: e["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(every, lambda e: e["key"] == k), -1)["value"]))


def citation_map(citations: DataFrame) -> DataFrame:
    """(envelope_id, pos, field, citation) to one map per envelope; of several citations of a field the last counts."""
    last = citations.groupBy("envelope_id", "field").agg(F.max_by("citation", "pos").alias("citation"))
    return last.groupBy("envelope_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "citation")))).alias("citations"))


def alias_rows(facts: DataFrame) -> DataFrame:
    """facts (envelope_id, field) with each name under which a citation may stand and its rank: itself, snake, camel, other names."""
    table = F.create_map(*(x for k, names in ALIASES.items() for x in (F.lit(k), F.array(*map(F.lit, names)))))
    names = F.concat(F.array("field", T.snake(F.col("field")), V.camel(F.col("field"))), F.coalesce(F.try_element_at(table, F.col("field")), F.array().cast("array<string>")))
    return facts.select("envelope_id", "field", F.posexplode(names).alias("rank", "name"))


def resolve_citations(facts: DataFrame, citations: DataFrame) -> DataFrame:
    """facts (envelope_id, field, label, value, status, section) with the snippet that may be shown for them, or null.

    citations: envelope_id, name, snippet. The best name counts; else the section's own citation, if it bears out the value. A fact that is not
    stated takes only a snippet that says so.
    """
    found = alias_rows(facts).join(citations.withColumnRenamed("snippet", "_s").hint("merge"), ["envelope_id", "name"]).groupBy("envelope_id", "field").agg(F.min_by("_s", "rank").alias("direct"))
    own = citations.select("envelope_id", F.col("name").alias("section"), F.col("snippet").alias("whole"))
    rows = facts.join(found.hint("merge"), ["envelope_id", "field"], "left").join(own.hint("merge"), ["envelope_id", "section"], "left")
    none = F.col("status") == "NOT_STATED"
    snippet = F.when(none, F.when(V.supports_absence(F.col("direct"), F.col("field"), F.col("label")), F.col("direct"))).otherwise(F.coalesce("direct", F.when(V.supports_value(F.col("whole"), F.col("value")), F.col("whole"))))
    return rows.select(*facts.columns, snippet.alias("snippet"))


def attachment_summaries(attachments: DataFrame) -> DataFrame:
    """Attachments (message, pos, filename, own_summary, case_summary): the first document of a message takes the case's summary."""
    is_pdf = F.lower("filename").endswith(".pdf")
    rank = F.row_number().over(Window.partitionBy("message", is_pdf).orderBy("pos"))
    return attachments.withColumn("_n", rank).withColumn("summary", F.when(is_pdf & (F.col("_n") == 1), F.col("case_summary")).when(is_pdf, F.col("own_summary"))).drop("_n")


def with_metadata(attachments: DataFrame, metadata: DataFrame) -> DataFrame:
    """Attachments (message, filename, language, flavor) with what extraction found by file name, whatever its case; blanks overwrite nothing."""
    found = metadata.groupBy("message", F.lower("filename").alias("_f")).agg(*(F.max(F.nullif(F.trim(c), F.lit(""))).alias(f"_{c}") for c in ("language", "flavor")))
    rows = attachments.withColumn("_f", F.lower("filename")).join(found.hint("merge"), ["message", "_f"], "left")
    return rows.withColumns({c: F.coalesce(f"_{c}", c) for c in ("language", "flavor")}).drop("_f", "_language", "_flavor")


def with_reports(messages: DataFrame, icsr: DataFrame, pqc: DataFrame, mi: DataFrame) -> DataFrame:
    """Messages (id) with their reports (message and one struct column each), null where there is none."""
    for name, report in (("icsr", icsr), ("pqc", pqc), ("mi", mi)):
        report = report.select(F.col("message").alias("id"), F.struct(*(c for c in report.columns if c != "message")).alias(name))
        messages = messages.join(report.hint("merge"), "id", "left")
    return messages


# Fields of which one must be stated for a case to be clinical.
CLINICAL = ("patient_identifier", "suspect_product", "adverse_event", "narrative")


def has_clinical_data(*columns: str) -> Column:
    out = F.lit(False)
    for c in columns or CLINICAL:
        out = out | ~T.is_unstated(F.col(c), "persist")
    return out


def is_icsr(primary: Column, labels: Column) -> Column:
    """A safety report by its primary category or any label, unless not relevant."""
    names = lambda c: F.lower(c).rlike("icsr|safety report|adverse event")
    none = F.coalesce(F.lower(primary).contains("not relevant"), F.lit(False))
    return ~none & (F.coalesce(names(primary), F.lit(False)) | F.coalesce(F.exists(labels, names), F.lit(False)))


def category_flags(labels: Column, primary: Column) -> dict[str, Column]:
    """Categories of an envelope by its labels, else its primary; MI by its exact letters."""
    active = F.when(F.coalesce(F.size(labels), F.lit(0)) > 0, labels).otherwise(F.array(primary))
    words = {"icsr": ("Safety Report", "ICSR"), "pqc": ("Quality Complaint", "PQC"), "mi": ("Info Request", "Medical Information", "MI"), "not_relevant": ("Not Relevant",)}
    return {name: _any_label(active, parts) for name, parts in words.items()}


def _any_label(labels: Column, parts: tuple[str, ...]) -> Column:
    return F.exists(labels, lambda c: c.rlike("|".join(parts)))


def route(cases: DataFrame, reports: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Report tables after cases (message, categories, clinical) are stored: reports of other categories are cleared, of their own replaced.

    reports: name (icsr, pqc, mi) to the rows stored so far (message, body); cases carry the new body. An ICSR needs clinical data.
    """
    out = {}
    for name, stored in reports.items():
        wanted = F.array_contains("categories", name) & (F.col("clinical") if name == "icsr" else F.lit(True))
        out[name] = stored.join(cases.select("message").hint("merge"), "message", "left_anti").unionByName(cases.filter(wanted).select("message", "body"))
    return out


def triage_answers(messages: DataFrame, truth: DataFrame) -> DataFrame:
    """Triage of messages (message_id, text, answer): the model's answer if it parses and names a category, else ground truth by id, else keywords.

    truth: message_id, primary. Confidences of answers are held to at most 0.98.
    """
    rows = parsed(messages, "answer", "_a")
    get = lambda path, kind: F.try_variant_get("_a", path, kind)
    named = F.nullif(get("$.primary_category", "string"), F.lit(""))
    rows = rows.withColumn("_named", named).withColumn("_conf", T.calibrated(F.coalesce(get("$.labels[0].confidence", "double"), F.lit(0.9)))).withColumn("_multi", F.coalesce(get("$.is_multi_label", "boolean"), F.lit(False)))
    rows = rows.join(truth.select("message_id", F.col("primary").alias("_truth")).hint("merge"), "message_id", "left").withColumn("_rule", T.triage(F.col("text")))
    by = F.when(F.col("_named").isNotNull(), "model").when(F.col("_truth").isNotNull(), "truth").otherwise("keywords")
    pick = lambda model, truth, rule: F.when(F.col("_named").isNotNull(), model).when(F.col("_truth").isNotNull(), truth).otherwise(rule)
    return rows.select("message_id", by.alias("by"), pick(F.col("_named"), F.col("_truth"), F.col("_rule.primary")).alias("primary"), pick(F.col("_conf"), F.lit(0.98), F.col("_rule.confidence")).alias("confidence"), pick(F.col("_multi"), F.lit(False), F.col("_rule.multi")).alias("multi"))


def processed(messages: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages (message_id, status) after processing, and an audit row each: TRIAGED with a result (message_id, primary, confidence, error null), else FAILED."""
    rows = messages.filter(F.col("status").isin("RECEIVED", "PROCESSING")).select("message_id").join(results.hint("merge"), "message_id", "left")
    ok = F.col("primary").isNotNull() & F.col("error").isNull()
    rows = rows.withColumn("_new", F.when(ok, "TRIAGED").otherwise("FAILED"))
    note = F.when(ok, F.concat(F.lit("Classified as "), F.col("primary"), F.lit(" with confidence "), F.col("confidence").cast("string"))).otherwise(F.concat(F.lit("Error: "), F.coalesce("error", F.lit("Empty extraction result from AI service."))))
    audit = rows.select("message_id", F.lit("SYSTEM_AI_ENGINE").alias("reviewer_username"), F.when(ok, "AI_TRIAGE_COMPLETED").otherwise("AI_PROCESSING_FAILED").alias("action"), F.lit("STATUS").alias("target_field"), F.lit("PROCESSING").alias("original_value"), F.col("_new").alias("new_value"), note.alias("reviewer_comments"))
    done = messages.join(rows.select("message_id", "_new").hint("merge"), "message_id", "left").withColumn("status", F.coalesce("_new", "status")).drop("_new")
    return done, audit


def split_cases(articles: DataFrame) -> DataFrame:
    """Articles (article_id, cases array<struct<…>>) to one row per case, numbered from 1, each triaged as a safety report on its own."""
    rows = articles.select("article_id", F.posexplode("cases").alias("pos", "c"))
    return rows.select("article_id", (F.col("pos") + 1).alias("case_no"), F.lit("Safety Report (ICSR)").alias("primary_category"), F.lit(0.98).alias("confidence"), "c.*")


def lab_rows(cases: DataFrame, key_column: str, *maps: str) -> DataFrame:
    """Maps of labs and diagnostics to rows, without biopsies; underscores in names become blanks."""
    entries = F.concat(*(F.coalesce(F.map_entries(m), F.array().cast("array<struct<key:string,value:string>>")) for m in maps))
    rows = cases.select(key_column, F.posexplode(entries).alias("pos", "e")).filter(F.lower("e.key") != "biopsy")
    return rows.select(key_column, "pos", F.translate("e.key", "_", " ").alias("test_name"), F.col("e.value").alias("value"))


def reportable(text: Column) -> Column:
    low = F.lower(text)
    return F.coalesce(low.contains("patient") & (low.contains("adverse") | low.contains("syndrome")), F.lit(False))


def study_type(multicase: Column, is_reportable: Column, filename: Column) -> Column:
    return F.when(multicase, "Multi-Patient Case Series").when(is_reportable, "Single Case Report").when(F.lower(filename).contains("preclinical"), "Preclinical Study").otherwise("Review Article")


NO_CASES = "No identifiable human adverse event cases found in source text."


def screen(articles: DataFrame, truth: DataFrame) -> DataFrame:
    """Screening of articles (filename, text, answer): the parsed answer, else ground truth by the file's base name, else keywords.

    truth: pdf_file, reportable, multicase, n_cases, exclusion_reason.
    """
    base = lambda c: F.lower(F.regexp_extract(c, r"([^/\\]*)$", 1))
    known = truth.groupBy(base(F.col("pdf_file")).alias("_base")).agg(F.first(F.struct("reportable", "multicase", "n_cases", "exclusion_reason")).alias("_t"))
    rows = parsed(articles, "answer", "_a").withColumn("_base", base(F.col("filename"))).join(known.hint("merge"), "_base", "left")
    get = lambda path, kind: F.try_variant_get("_a", path, kind)
    answered, true = F.col("_a").isNotNull(), F.col("_t").isNotNull()
    word = reportable(F.col("text"))
    pick = lambda a, b, c: F.when(answered, a).when(true, b).otherwise(c)
    n = F.size(F.coalesce(get("$.cases", "array<variant>"), F.array().cast("array<variant>")))
    return rows.select(
        "filename", pick(F.lit("answer"), F.lit("truth"), F.lit("keywords")).alias("by"), pick(F.coalesce(get("$.is_reportable", "boolean"), F.lit(False)), F.col("_t.reportable"), word).alias("is_reportable"),
        pick(F.coalesce(get("$.study_type", "string"), F.lit("Single Case Report")), study_type(F.col("_t.multicase"), F.col("_t.reportable"), F.col("filename")), study_type(F.lit(False), word, F.lit(""))).alias("study_type"),
        pick(n, F.coalesce("_t.n_cases", F.col("_t.reportable").cast("int")), word.cast("int")).alias("n_cases"), pick(get("$.exclusion_reason", "string"), F.col("_t.exclusion_reason"), F.when(~word, NO_CASES)).alias("exclusion_reason"),
    )


def literature_facts(cases: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Facts of each case of an article (article_id, case_no, identifier, fields), with its own scope and those of the other cases.

    document_id is the article; field holds the case's number, so that retrieval keeps cases apart.
    """
    known = F.when(~F.coalesce("identifier", F.lit("")).isin("", UNSTATED), F.col("identifier"))
    scopes = cases.groupBy("article_id").agg(F.collect_set(known).alias("_all"))
    rows = cases.join(scopes.hint("merge"), "article_id").withColumn("scope", F.coalesce(known, F.lit("")))
    facts = F.filter(F.array(*(F.struct(F.lit(f).alias("name"), F.col(f).cast("string").alias("value")) for f in fields)), lambda x: ~F.coalesce(x["value"], F.lit("")).isin("", UNSTATED))
    rows = rows.select(F.col("article_id").alias("document_id"), "case_no", "scope", F.array_except("_all", F.array("scope")).alias("others"), F.inline(facts))
    return rows.withColumn("field", F.concat(F.col("name"), F.lit("#"), F.col("case_no").cast("string")))


def review_articles(articles: DataFrame, actions: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """Articles (article_id, review_status, is_reportable, exclusion_reason) after reviews, and their audit rows.

    actions: article_id, accept (boolean), reviewer, is_reportable, exclusion_reason; what is given counts only where a review doesn't accept.
    """
    a = actions.select("article_id", "accept", "reviewer", F.col("is_reportable").alias("_r"), F.col("exclusion_reason").alias("_x"))
    rows = articles.join(a.hint("merge"), "article_id", "left")
    done, over = F.col("accept").isNotNull(), F.col("accept") == F.lit(False)
    new = rows.withColumns({
        "_old": F.concat_ws("|", F.col("review_status"), F.col("is_reportable").cast("string")), "review_status": F.when(over, "OVERRIDDEN").when(done, "ACCEPTED").otherwise(F.col("review_status")),
        "is_reportable": F.when(over, F.coalesce("_r", "is_reportable")).otherwise(F.col("is_reportable")), "exclusion_reason": F.when(over, F.coalesce("_x", "exclusion_reason")).otherwise(F.col("exclusion_reason")), "reviewed_by": F.when(done, F.coalesce("reviewer", F.lit("reviewer"))), "reviewed_at": F.when(done, at),
    })
    audit = new.filter(done).select("article_id", F.col("reviewed_by").alias("reviewer_username"), F.when(over, "LITERATURE_OVERRIDE").otherwise("LITERATURE_ACCEPT").alias("action"), F.col("_old").alias("original_value"), F.concat_ws("|", "review_status", F.col("is_reportable").cast("string")).alias("new_value"))
    return new.select(*articles.columns, "reviewed_by", "reviewed_at"), audit


def truth_envelopes(cases: DataFrame) -> DataFrame:
    """Ground truth (case_id, categories) as triage: labels in order, each 0.02 less sure than the one before, from 0.98."""
    labels = F.transform("categories", lambda c, i: F.struct(c.alias("category"), F.round(F.lit(0.98) - 0.02 * i, 2).alias("confidence")))
    return cases.select("case_id", labels.alias("labels"), F.get("categories", F.lit(0)).alias("primary_category"), (F.size("categories") > 1).alias("is_multi_label"))


def truth_keys(cases: DataFrame, columns: tuple[str, ...] = ("source_email", "source_pdf", "source_file")) -> DataFrame:
    """(key, case_id): a case under its id, and under path and base name of each of its files; of several cases of one key the least id."""
    names = [F.array(F.col(c), F.regexp_extract(F.col(c), r"([^/\\]*)$", 1)) for c in columns if c in cases.columns]
    keys = F.array_distinct(F.filter(F.flatten(F.array(F.array("case_id"), *names)), lambda x: F.coalesce(x != "", F.lit(False))))
    return cases.select(F.explode(keys).alias("key"), "case_id").groupBy("key").agg(F.min("case_id").alias("case_id"))


def truth_of(items: DataFrame, keys: DataFrame, identifier: str) -> DataFrame:
    """items with case_id: by base name first, then by the whole identifier."""
    base = F.regexp_extract(F.col(identifier), r"([^/\\]*)$", 1)
    one, two = keys.select(F.col("key").alias("_one"), F.col("case_id").alias("_a")), keys.select(F.col("key").alias("_two"), F.col("case_id").alias("_b"))
    rows = items.withColumn("_base", base).join(one.hint("merge"), F.col("_base") == F.col("_one"), "left").join(two.hint("merge"), F.col(identifier) == F.col("_two"), "left")
    return rows.select(*items.columns, F.coalesce("_a", "_b").alias("case_id"))


# Sections of a report in order; fields that are always shown.
REPORT = {"triage_exclusion": 1, "exclusion_excerpt": 2, "patient": 10, "reporter": 20, "product": 30, "reaction": 40, "concomitant_medications": 50, "lab_tests": 60, "narrative": 70, "regulatory": 80, "pqc_product": 100, "pqc_inspection": 110, "mi_inquiry": 200, "mi_questions": 210, "mi_context": 220}
EXPECTED = ("patient_identifier", "patient_age", "patient_sex", "reporter_name", "suspect_product", "lot_number", "adverse_event")


def report_rows(facts: DataFrame, cases: DataFrame, expected: tuple[str, ...] = EXPECTED) -> DataFrame:
    """Facts (envelope_id, section, pos, field, value) as a report's rows: sections in order, unstated fields only where they are expected.

    cases: envelope_id, not_relevant; such a case shows its exclusion alone.
    """
    order = V.one_of(F.col("section"), {k: str(v) for k, v in REPORT.items()}, F.lit(None).cast("string")).cast("int")
    rows = facts.join(cases.select("envelope_id", "not_relevant").hint("merge"), "envelope_id").withColumn("section_order", order).filter("section_order is not null")
    stated = ~T.is_unstated(F.col("value"), "view")
    rows = rows.filter((F.col("not_relevant") & (F.col("section_order") <= 2)) | (~F.col("not_relevant") & (F.col("section_order") > 2))).filter(stated | F.col("field").isin(*expected))
    return rows.select("envelope_id", "section_order", "section", "pos", V.field_label(F.col("field")).alias("label"), F.when(stated, F.col("value")).otherwise(UNSTATED).alias("value"))


# Other names under which the citation of a grounded fact is kept.
GROUNDED_AS = {"suspect_product": "product_name", "adverse_event": "reaction", "patient_age": "age", "patient_sex": "sex"}


def ground_cases(facts: DataFrame, chunks: DataFrame) -> DataFrame:
    """(document_id, case_no, name, snippet, level): the better of two candidates for each fact of ``literature_facts``, also under its other name.

    chunks: document_id, pos, text, source_type, page, has_box, char_start, char_end, is_table (see ``chunks.page_chunks``).
    """
    from .retrieval import citation_level, retrieve_hybrid

    best = retrieve_hybrid(facts, chunks, k=2).filter("rank = 1")
    level = citation_level(*map(F.col, ("source_type", "page", "has_box", "char_start", "char_end")))
    names = F.array_compact(F.array(F.col("name"), V.one_of(F.col("name"), GROUNDED_AS, F.lit(None).cast("string"))))
    return best.select("document_id", "case_no", F.explode(names).alias("name"), F.col("text").alias("snippet"), level.alias("level"))
