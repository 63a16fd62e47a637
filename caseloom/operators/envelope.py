"""Whole envelopes: verification of all their facts, validation of all their parts, the reviewer's brief.

facts: envelope_id, origin (0: the ledger, then payload sections in order), pos, fact_id, field, value, normalized, status, confidence, notes.
evidence: envelope_id, fact_id, evidence_id, pos, source_id, source_type, place, snippet, page, char_start, char_end.
All keys are joined on (envelope_id, fact_id), so every step of one envelope is near the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import collapse, is_unstated
from . import ledger as L
from .evidence import entails
from .retrieval import batches, entails_fuzzy
from .shared import DEALT, written

KEY = ["envelope_id", "fact_id"]
# Fields whose absence a reviewer must know of, by category.
CRITICAL = {"icsr": ("suspect_product", "adverse_event", "patient_age", "reporter_name"), "pqc": ("product_name", "defect_type", "lot_number"), "mi": ("question_text", "product_or_topic")}
READY, WARNED, BLOCKED = "READY_FOR_REVIEW", "REVIEW_WITH_WARNINGS", "BLOCKED_BY_INTEGRITY_ERROR"


def distinct_facts(facts: DataFrame) -> DataFrame:
    """One row for each fact id of an envelope: its first, the ledger before the payload sections."""
    first = Window.partitionBy(*KEY).orderBy("origin", "pos")
    return facts.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def distinct_evidence(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row for each evidence id of an envelope: its first, in the order of the facts."""
    placed = evidence.join(facts.select(*KEY, F.col("pos").alias("_fact")).hint("merge"), KEY)
    first = Window.partitionBy("envelope_id", "evidence_id").orderBy("_fact", "pos")
    return placed.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", "_fact")


def judge_candidates(facts: DataFrame, evidence: DataFrame, keep: int = 2, answers: DataFrame | None = None, cascade: bool = True, fuzzy: bool = False) -> DataFrame:
    """evidence with result, confidence and rule.

    In this order: evidence of an unstated fact and empty snippets support nothing; of copies in a fact the first counts; after ``keep``
    others the rest is left out; what remains is judged by the answers given for it (envelope_id, fact_id, evidence_id, result, confidence),
    else by the deterministic cascade, whose end is likeness of strings if ``fuzzy``, or, without ``cascade``, stays unverified.
    """
    # tasks by the number of rows: by size alone, as much as is read of packed rows would be sorted at once
    tasks = max(1, -(-evidence.count() // (4 * DEALT)))
    rows = evidence.repartition(tasks, *KEY).join(facts.select(*KEY, "value", "status").repartition(tasks, *KEY).hint("merge"), KEY)
    absent = (F.col("status") == "NOT_STATED") | is_unstated(F.col("value"))
    empty = is_unstated(F.col("snippet"))
    rows = rows.withColumn("rule", F.when(absent, "not_stated_guard").when(empty, "empty_evidence_guard"))
    print_ = F.concat_ws("|", F.coalesce("source_id", F.lit("")), F.coalesce("place", F.lit("")), collapse(F.col("snippet")))
    rows = rows.withColumn("print", F.when(F.col("rule").isNull(), F.sha2(print_, 256)))
    copy = F.row_number().over(Window.partitionBy(*KEY, "print").orderBy("pos")) > 1
    rows = rows.withColumn("rule", F.when(F.col("print").isNotNull() & copy, "duplicate_candidate_pruned").otherwise(F.col("rule")))
    kept = F.row_number().over(Window.partitionBy(*KEY, F.col("rule").isNull()).orderBy("pos"))
    rows = rows.withColumn("rule", F.when(F.col("rule").isNull() & (kept > keep), "excess_candidate_budget").otherwise(F.col("rule")))
    # rows that a guard took, or an answer judges, carry no strings to the likeness
    asks = F.when(F.col("rule").isNull(), F.col("snippet"))
    judged = (entails_fuzzy(F.col("value"), asks) if fuzzy else entails(F.col("value"), F.col("snippet"))) if cascade else F.struct(F.lit("INSUFFICIENT").alias("result"), F.lit(0.0).alias("confidence"))
    open_ = F.col("rule").isNull()
    if answers is not None:
        value = F.col("_c").try_cast("double")
        sure = F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))
        first = answers.groupBy(*KEY, "evidence_id").agg(F.min_by(F.struct(F.col("result").alias("_r"), F.col("confidence").cast("string").alias("_c")), "pos").alias("_a"))
        own = [*KEY, "evidence_id"]
        rows = rows.repartition(tasks, *own).join(first.repartition(tasks, *own).hint("merge"), own, "left").select("*", "_a.*").drop("_a")
        known = F.when(F.col("_r").isin(*L.RESULTS), F.col("_r")).otherwise("INSUFFICIENT")
        judged = F.when(F.col("_r").isNotNull(), F.struct(known.alias("result"), sure.alias("confidence"))).otherwise(judged)
    rows = rows.withColumn("_j", F.when(open_, judged).otherwise(F.struct(F.lit("INSUFFICIENT").alias("result"), F.lit(0.0).alias("confidence"))))
    return rows.withColumns({"result": F.col("_j.result"), "confidence": F.col("_j.confidence"), "rule": F.when(open_, "deterministic").otherwise(F.col("rule"))}).select(*evidence.columns, "result", "confidence", "rule", "print")


def fact_states(facts: DataFrame, judged: DataFrame) -> DataFrame:
    """facts with state: contradicted before supported; without evidence, or unstated, not enough."""
    against, support = F.bool_or(F.col("result") == "CONTRADICTS"), F.bool_or(F.col("result") == "SUPPORTS")
    states = judged.groupBy(*KEY).agg(F.when(against, "CONTRADICTS").when(support, "SUPPORTS").otherwise("INSUFFICIENT").alias("state"), F.count("*").alias("n_evidence"), F.count_if(F.col("result") == "SUPPORTS").alias("n_supports"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return facts.join(states.hint("merge"), KEY, "left").select(*facts.columns, F.coalesce("state", F.lit("INSUFFICIENT")).alias("state"), zero("n_evidence"), zero("n_supports"))


def verification_batches(facts: DataFrame, judged: DataFrame, most_items: int = 30, most_chars: int = 25_000) -> DataFrame:
    """(envelope_id, fact_id, evidence_id, pos, batch, chars): the candidates that no guard took, in the order of facts and evidence, in bounded batches of each envelope."""
    placed = judged.filter("rule = 'deterministic'").select(*KEY, "evidence_id", F.col("pos").alias("_place"), F.coalesce("snippet", F.lit("")).alias("snippet"))
    tasks = placed.join(facts.select(*KEY, "origin", "pos", "field", "value").hint("merge"), KEY)
    tasks = tasks.select("envelope_id", F.struct("origin", "pos", "fact_id", "_place", "evidence_id").alias("pos"), "evidence_id", "fact_id", "field", "value", "snippet")
    return batches(tasks, "envelope_id", most_items, most_chars).select(*KEY, "evidence_id", F.col("pos._place").alias("pos"), "batch", "chars")


def verify_envelope(facts: DataFrame, evidence: DataFrame, keep: int = 2, answers: DataFrame | None = None, cascade: bool = True, fuzzy: bool = False, batched: bool = False, most_items: int = 30) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts with state, evidence with result, metrics by envelope) for all facts of ledger and payloads, each once.

    batched: metrics have n_batches, of at most ``most_items`` candidates each, and the evidence its batch.
    """
    facts = distinct_facts(facts)
    # read by states, metrics, batches and whoever validates: judged once
    judged = written(judge_candidates(facts, evidence, keep, answers, cascade, fuzzy), "judged")
    if batched:
        dealt = verification_batches(facts, judged, most_items)
        judged = judged.join(dealt.drop("chars").hint("merge"), [*KEY, "evidence_id", "pos"], "left")
    counts = judged.groupBy("envelope_id").agg(F.countDistinct("print").alias("n_prints"), F.count("*").alias("n_before"), F.count_if(F.col("rule") == "deterministic").alias("n_after"))
    if batched:
        counts = counts.join(judged.groupBy("envelope_id").agg(F.countDistinct("batch").alias("n_batches")).hint("merge"), "envelope_id")
    metrics = facts.groupBy("envelope_id").agg(F.count("*").alias("n_facts")).join(counts.hint("merge"), "envelope_id", "left").na.fill(0)
    return fact_states(facts, judged), judged, metrics


def batch_latency(batches: DataFrame) -> DataFrame:
    """(envelope_id, n_batches, mean_ms): whole milliseconds that a batch (envelope_id, latency_ms) took on average, 0 without any."""
    return batches.groupBy("envelope_id").agg(F.count("latency_ms").alias("n_batches"), F.coalesce(F.floor(F.avg("latency_ms")), F.lit(0)).alias("mean_ms"))


def known_sources(envelopes: DataFrame) -> Column:
    """Everything an envelope's evidence may come from: its file, its message, attachments, sources."""
    none = F.array().cast("array<string>")
    own = F.array_compact(F.array(F.nullif(F.col("source_filename"), F.lit("")), F.when(F.col("message_id") != "Unknown", F.nullif(F.col("message_id"), F.lit("")))))
    return F.array_distinct(F.concat(own, F.coalesce("attachment_filenames", none), F.coalesce("source_filenames", none)))


def validate_envelope(envelopes: DataFrame, facts: DataFrame, evidence: DataFrame, reconcile: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(report by envelope, issues, facts after reconciliation) of the ledger and its verified evidence.

    envelopes: envelope_id, message_id, source_filename, attachment_filenames, source_filenames, page_count, has_* categories and their records
    (see ``ledger.payload_issues``); facts as ``fact_states`` gives them; evidence as ``judge_candidates`` does. Issues are those of
    the facts before reconciliation, and the reconciliation's own.
    """
    sized = envelopes.select("envelope_id", known_sources(envelopes).alias("known_sources"), "page_count")
    held = evidence.join(sized.hint("merge"), "envelope_id").withColumn("method", F.col("rule"))
    wide = lambda df, kind, object_: df.select("envelope_id", F.lit(kind).alias("object"), object_.cast("string").alias("object_id"), "code", "severity")
    none = F.lit(None).cast("string")
    missing = envelopes.filter(F.trim(F.coalesce(F.col("envelope_id").cast("string"), F.lit(""))) == "").select("envelope_id", F.lit("ENVELOPE_MISSING_ID").alias("code"), F.lit("ERROR").alias("severity"))
    typed = facts.filter("value is null").select("envelope_id", "pos", F.lit("FACT_INVALID_VALUE_TYPE").alias("code"), F.lit("ERROR").alias("severity"))
    structure = L.fact_issues(facts).filter("code != 'NOT_STATED_INCONSISTENT_VALUE'")
    rank = F.row_number().over(Window.partitionBy("envelope_id", "evidence_id").orderBy("fact_id", "pos"))
    again = evidence.filter(F.trim(F.coalesce("evidence_id", F.lit(""))) != "").withColumn("_n", rank).filter("_n > 1")
    parts = [
        wide(missing, "envelope", none), wide(L.payload_issues(envelopes), "envelope", none), wide(L.duplicate_fields(facts), "field", F.col("field_key")), wide(structure, "fact", F.col("pos")), wide(typed, "fact", F.col("pos")),
        wide(L.repeated_ids(facts), "fact", F.col("pos")), wide(L.unstated_issues(facts), "fact", F.col("pos")), wide(L.evidence_issues(held), "evidence", F.col("evidence_id")),
        wide(again.select("envelope_id", "evidence_id", F.lit("DUPLICATE_EVIDENCE_ID").alias("code"), F.lit("ERROR").alias("severity")), "evidence", F.col("evidence_id")),
    ]
    settled = L.reconcile(facts) if reconcile else facts.withColumns({"code": none, "severity": none})
    parts.append(wide(settled.filter("code is not null"), "fact", F.col("pos")))
    issues = parts[0]
    for more in parts[1:]:
        issues = issues.unionByName(more)
    n = lambda s: F.count_if(F.col("severity") == s)
    counts = issues.groupBy("envelope_id").agg(n("ERROR").alias("n_error"), n("WARNING").alias("n_warning"), n("INFO").alias("n_info"))
    checked = facts.groupBy("envelope_id").agg(F.count("*").alias("facts_checked")).join(evidence.groupBy("envelope_id").agg(F.count("*").alias("evidence_checked")).hint("merge"), "envelope_id", "left")
    report = sized.select("envelope_id", F.size("known_sources").cast("long").alias("sources_checked")).join(checked.hint("merge"), "envelope_id", "left").join(counts.hint("merge"), "envelope_id", "left").na.fill(0)
    gate = F.when(F.col("n_error") > 0, BLOCKED).when(F.col("n_warning") > 0, WARNED).otherwise(READY)
    report = report.withColumn("gate", gate).withColumn("passed", F.col("n_error") == 0)
    s = lambda c: F.col(c).cast("string")
    summary = F.concat(F.lit("Integrity validation completed: Gating="), F.col("gate"), F.lit(" ("), s("n_error"), F.lit(" errors, "), s("n_warning"), F.lit(" warnings across "), s("facts_checked"), F.lit(" facts and "), s("evidence_checked"), F.lit(" evidence items)."))
    return report.withColumn("summary", summary), issues, settled.drop("code", "severity")


def _stated(c: str) -> Column:
    return F.col(c).isNotNull() & (F.col(c) != "Not stated")


def subject(category: Column) -> Column:
    """First of: patient and event, product and defect, topic and inquiry; else the summary's beginning."""
    line = lambda head, one, two: F.concat(F.lit(f"{head}: "), F.col(one), F.when(_stated(two), F.concat(F.lit(" - "), F.col(two))).otherwise(""))
    short = F.when(_stated("document_summary"), F.left("document_summary", F.lit(80)))
    return (
        F.when(_stated("patient_identifier"), line("ICSR", "patient_identifier", "adverse_event")).when(_stated("pqc_product"), line("PQC", "pqc_product", "defect_type")).when(_stated("mi_topic"), line("MI", "mi_topic", "inquiry_type"))
        .otherwise(F.coalesce(short, F.when(F.lower(category).contains("not relevant"), "Non-Pharmacovigilance Communication").otherwise("Clinical Safety Intake")))
    )


def sender() -> Column:
    named = F.concat(F.col("reporter_name"), F.when(_stated("reporter_institution"), F.concat(F.lit(" ("), F.col("reporter_institution"), F.lit(")"))).otherwise(""))
    return F.when(_stated("reporter_name"), named).otherwise("Healthcare Provider / Consumer")


def focus(cases: DataFrame, facts: DataFrame, evidence: DataFrame, warnings: DataFrame) -> DataFrame:
    """(envelope_id, rank, pos, category, field, evidence_id): what a reviewer should look at, in order.

    cases: envelope_id, categories (array), primary_category, photo, language. warnings: envelope_id, pos, field, code; the first three count.
    """
    scanned = F.lower(F.coalesce("snippet", F.lit(""))).rlike("handwritten|ocr") | F.lower(F.coalesce("place", F.lit(""))).contains("scan")
    own = evidence.groupBy(*KEY).agg(F.min_by("evidence_id", "pos").alias("evidence_id"), F.bool_or(scanned).alias("scanned"))
    has = lambda *words: F.exists("categories", lambda c: F.lower(c).rlike("|".join(words)))
    cases = cases.select("*", has("icsr", "safety report").alias("_icsr"), has("pqc", "quality complaint").alias("_pqc"), has("mi", "medical info").alias("_mi"), F.lower("primary_category").contains("not relevant").alias("_none"))
    rows = facts.join(cases.select("envelope_id", "_icsr", "_pqc", "_mi", "_none").hint("merge"), "envelope_id").join(own.hint("merge"), KEY, "left")
    critical = (F.col("_icsr") & F.col("field").isin(*CRITICAL["icsr"])) | (F.col("_pqc") & F.col("field").isin(*CRITICAL["pqc"])) | (F.col("_mi") & F.col("field").isin(*CRITICAL["mi"]))
    item = lambda rank, category: F.struct(F.lit(rank).alias("rank"), category.alias("category"))
    status = F.col("status")
    kind = F.when(status == "CONFLICT", item(1, F.lit("EVIDENCE_CONFLICT"))).when(status == "UNCERTAIN", item(2, F.when(F.col("scanned"), "UNCERTAIN_HANDWRITING").otherwise("CATEGORY_AMBIGUITY")))
    kind = kind.when((status == "NOT_STATED") & critical & ~F.col("_none"), item(3, F.lit("MISSING_CRITICAL_FIELD")))
    out = rows.withColumn("k", kind).filter("k is not null").select("envelope_id", "k.rank", F.col("pos").cast("int").alias("pos"), "k.category", "field", F.when(F.col("k.rank") < 3, F.col("evidence_id")).alias("evidence_id"))
    one = lambda rank, when, category, field: cases.filter(when).select("envelope_id", F.lit(rank).alias("rank"), F.lit(0).alias("pos"), F.lit(category).alias("category"), F.lit(field).alias("field"), F.lit(None).cast("string").alias("evidence_id"))
    foreign = ~F.lower("language").isin("english", "en", "unknown")
    out = out.unionByName(one(4, F.coalesce("photo", F.lit(False)), "PHOTO_DEFECT_INSPECTION", "defect_photo")).unionByName(one(5, foreign, "MULTILINGUAL_TRANSLATION", "language_detected"))
    first = warnings.withColumn("_n", F.row_number().over(Window.partitionBy("envelope_id").orderBy("pos", "code"))).filter("_n <= 3")
    return out.unionByName(first.select("envelope_id", F.lit(6).alias("rank"), F.col("_n").alias("pos"), F.lit("CATEGORY_AMBIGUITY").alias("category"), "field", F.lit(None).cast("string").alias("evidence_id")))


def build_brief(cases: DataFrame, facts: DataFrame, evidence: DataFrame, warnings: DataFrame) -> DataFrame:
    """The brief of each case.

    cases: envelope_id, message_id, source_filename, received_date, primary_category, categories (array, may be empty), is_multi_label,
    language, photo, document_summary, reviewer_summary and the fields of ``subject`` and ``sender``.
    """
    cases = cases.withColumn("categories", F.when(F.size("categories") > 0, F.col("categories")).otherwise(F.array("primary_category")))
    items = focus(cases, facts, evidence, warnings)
    listed = items.groupBy("envelope_id").agg(F.array_sort(F.collect_list(F.struct("rank", "pos", "category", "field"))).alias("f"))
    stats = L.status_counts(facts)
    unique = distinct_evidence(facts, evidence).groupBy("envelope_id").agg(F.count("*").alias("evidence_count"))
    rows = cases.join(stats.hint("merge"), "envelope_id", "left").join(listed.hint("merge"), "envelope_id", "left").join(unique.hint("merge"), "envelope_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    n_focus = F.when(F.col("f").isNull(), 0).otherwise(F.size("f"))
    icsr = F.exists("categories", lambda c: c.contains("ICSR") | c.contains("Safety Report"))
    urgency = L.urgency(F.coalesce("photo", F.lit(False)), icsr, F.col("is_multi_label"))
    made = F.concat(F.lit("AI-prepared case brief for "), F.col("primary_category"), F.lit(" ("), zero("confirmed").cast("string"), F.lit(" confirmed facts, "), n_focus.cast("string"), F.lit(" attention items)."))
    said = lambda c: F.when(F.coalesce(F.col(c), F.lit("")).isin("", "Not stated"), None).otherwise(F.col(c))
    name = lambda c: F.nullif(F.col(c), F.lit(""))
    return rows.select(
        "envelope_id", F.coalesce(name("message_id"), name("source_filename"), F.col("envelope_id").cast("string")).alias("case_id"), F.coalesce(name("received_date"), F.lit("Not stated")).alias("received_date"), subject(F.col("primary_category")).alias("subject"), sender().alias("sender"),
        urgency.alias("urgency"), F.coalesce(said("reviewer_summary"), said("document_summary"), made).alias("executive_summary"), *(zero(c).alias(c) for c in ("total", "confirmed", "uncertain", "conflict", "not_stated", "evidence_count")),
        F.coalesce(F.transform("f", lambda x: F.concat_ws(":", x["category"], x["field"])), F.array().cast("array<string>")).alias("review_focus"),
    )
