"""Fact ledger: wide records to long facts, their status, integrity issues, reconciliation and the reviewer's brief."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import is_unstated, key, valid_confidence
from .shared import dealt

STATUSES = ("CONFIRMED", "UNCERTAIN", "CONFLICT", "NOT_STATED")


def unfold(records: DataFrame, key_column: str, fields: list[str]) -> DataFrame:
    """Wide records to (envelope_id, pos, field, value), in the order of the fields."""
    rows = F.array(*(F.struct(F.lit(i).alias("pos"), F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for i, f in enumerate(fields)))
    return dealt(records, key_column).select(F.col(key_column).alias("envelope_id"), F.inline(rows))


def with_status(facts: DataFrame, declared: str | None = None) -> DataFrame:
    """Unstated values are NOT_STATED; else a legal declared status; else CONFIRMED."""
    legal = F.when(F.col(declared).isin(*STATUSES), F.col(declared)) if declared else F.lit(None).cast("string")
    return facts.withColumn("status", F.when(is_unstated(F.col("value"), "extract"), "NOT_STATED").otherwise(F.coalesce(legal, F.lit("CONFIRMED"))))


def fold(facts: DataFrame, fields: list[str]) -> DataFrame:
    """Facts to one wide record per envelope."""
    return facts.groupBy("envelope_id").pivot("field", fields).agg(F.first("value"))


def fact_issues(facts: DataFrame) -> DataFrame:
    """(envelope_id, pos, code, severity) of each broken rule of a fact's structure."""
    age = F.col("value").try_cast("double")
    rules: list[tuple[Column, str, str]] = [
        (F.trim(F.coalesce("fact_id", F.lit(""))) == "", "FACT_MISSING_ID", "ERROR"),
        (F.trim(F.coalesce("field", F.lit(""))) == "", "FACT_EMPTY_FIELD", "ERROR"),
        (~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), "FACT_INVALID_STATUS", "ERROR"),
        (F.col("confidence").isNotNull() & ~valid_confidence(F.col("confidence")), "CONFIDENCE_OUT_OF_BOUNDS", "ERROR"),
        ((F.col("field") == "patient_age") & ((age < 0) | (age > 130)), "FACT_NORMALIZED_VALUE_IMPLAUSIBLE", "WARNING"),
        ((F.col("status") == "NOT_STATED") & ~is_unstated(F.col("value"), "validate"), "NOT_STATED_INCONSISTENT_VALUE", "ERROR"),
    ]
    found = F.array_compact(F.array(*(F.when(F.coalesce(rule, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for rule, code, severity in rules)))
    return facts.select("envelope_id", "pos", F.inline(found))


def duplicate_fields(facts: DataFrame) -> DataFrame:
    """Fields with several facts in an envelope: conflicting where a value differs from the first, else redundant."""
    same = facts.groupBy("envelope_id", key(F.col("field")).alias("field_key")).agg(F.count("*").alias("n"), F.min_by(key(F.col("value")), "pos").alias("first"), F.collect_set(key(F.col("value"))).alias("all"))
    conflict = F.size(F.array_except("all", F.array("first"))) > 0
    return same.filter("n > 1").select("envelope_id", "field_key", "n", F.when(conflict, "DUPLICATE_CONFLICTING_FACT").otherwise("DUPLICATE_REDUNDANT_FACT").alias("code"), F.when(conflict, "WARNING").otherwise("INFO").alias("severity"))


def repeated_ids(facts: DataFrame) -> DataFrame:
    """Second and later facts with one id in an envelope."""
    rank = F.row_number().over(Window.partitionBy("envelope_id", "fact_id").orderBy("pos"))
    return facts.filter(F.trim("fact_id") != "").withColumn("rn", rank).filter("rn > 1").select("envelope_id", "pos", F.lit("DUPLICATE_FACT_ID").alias("code"), F.lit("ERROR").alias("severity"))


def reconciled(status: Column, state: Column) -> Column:
    """A fact's status after verification."""
    return (
        F.when(status == "NOT_STATED", status).when(state == "CONTRADICTS", "CONFLICT").when((state == "SUPPORTS") & (status == "UNCERTAIN"), "CONFIRMED")
        .when((state == "INSUFFICIENT") & (status == "CONFIRMED"), "UNCERTAIN").otherwise(status)
    )


def gating(issues: DataFrame) -> DataFrame:
    """Counts by severity and the gate that they set."""
    counts = issues.groupBy("envelope_id").agg(*(F.count_if(F.col("severity") == s).alias(f"n_{s.lower()}") for s in ("ERROR", "WARNING", "INFO")))
    return counts.withColumn("gate", F.when(F.col("n_error") > 0, "BLOCKED").when(F.col("n_warning") > 0, "REVIEW_WITH_WARNINGS").otherwise("READY_FOR_REVIEW"))


def status_counts(facts: DataFrame) -> DataFrame:
    return facts.groupBy("envelope_id").agg(F.count("*").alias("total"), *(F.count_if(F.col("status") == s).alias(s.lower()) for s in STATUSES))


def focus_items(facts: DataFrame, critical: list[str]) -> DataFrame:
    """What a reviewer looks at: conflicts, uncertain facts, critical fields that are unstated, in that order."""
    kind = F.when(F.col("status") == "CONFLICT", F.struct(F.lit(1).alias("order"), F.lit("conflict").alias("kind")))
    kind = kind.when(F.col("status") == "UNCERTAIN", F.struct(F.lit(2).alias("order"), F.lit("uncertain").alias("kind")))
    kind = kind.when((F.col("status") == "NOT_STATED") & F.col("field").isin(*critical), F.struct(F.lit(3).alias("order"), F.lit("missing").alias("kind")))
    return facts.withColumn("k", kind).filter("k is not null").select("envelope_id", "pos", "field", "k.order", "k.kind")


def urgency(photo: Column, icsr: Column, multi: Column) -> Column:
    return F.when(photo | (icsr & multi), "CRITICAL").when(icsr, "EXPEDITED").otherwise("STANDARD")


# Types of evidence, results of a verification, codes of a status change with their severity and note.
EVIDENCE_TYPES = ("email", "pdf", "table_cell", "image", "scanned", "literature")
RESULTS = ("SUPPORTS", "CONTRADICTS", "INSUFFICIENT")
CHANGES = {
    "CONFLICT": ("WARNING", "to CONFLICT due to contradictory evidence."),
    "CONFIRMED": ("INFO", "to CONFIRMED based on supporting evidence."),
    "UNCERTAIN": ("WARNING", "to UNCERTAIN: candidate evidence is INSUFFICIENT to verify."),
}


def _issues(rows: DataFrame, keys: list[str], rules: list[tuple[Column, str, str]]) -> DataFrame:
    found = F.array_compact(F.array(*(F.when(F.coalesce(rule, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for rule, code, severity in rules)))
    return rows.select(*keys, F.inline(found))


def evidence_issues(evidence: DataFrame, types: tuple[str, ...] = EVIDENCE_TYPES) -> DataFrame:
    """Broken rules of evidence and of its verification.

    evidence: envelope_id, evidence_id, source_id, known_sources (array), source_type, snippet, page, page_count,
    char_start, char_end, result, confidence, method (null: never verified).
    """
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    source = key(F.col("source_id"))
    known = F.exists("known_sources", lambda s: source.contains(key(s)) | key(s).contains(source))
    start, end = F.col("char_start"), F.col("char_end")
    return _issues(evidence, ["envelope_id", "evidence_id"], [
        (blank("evidence_id"), "EVIDENCE_MISSING_ID", "ERROR"),
        (blank("source_id"), "EVIDENCE_EMPTY_SOURCE", "ERROR"),
        (~blank("source_id") & (F.size("known_sources") > 0) & ~known, "EVIDENCE_DANGLING_SOURCE", "ERROR"),
        (~F.coalesce(F.col("source_type").isin(*types), F.lit(False)), "EVIDENCE_INVALID_TYPE", "ERROR"),
        (blank("snippet"), "EVIDENCE_EMPTY_SNIPPET", "ERROR"),
        (F.col("page") < 1, "EVIDENCE_INVALID_PAGE", "ERROR"),
        ((F.col("page_count") > 0) & (F.col("page") > F.col("page_count")), "EVIDENCE_PAGE_EXCEEDS_TOTAL", "ERROR"),
        ((start < 0) | (end < start), "EVIDENCE_INVALID_OFFSETS", "ERROR"),
        (~F.coalesce(F.col("result").isin(*RESULTS), F.lit(False)), "VERIFICATION_UNKNOWN_RESULT", "ERROR"),
        (~valid_confidence(F.col("confidence")), "CONFIDENCE_OUT_OF_BOUNDS", "ERROR"),
        ((F.col("method") == "fallback") & (F.col("result") == "SUPPORTS"), "VERIFICATION_FALLBACK_ILLEGAL_SUPPORT", "ERROR"),
        (F.col("method").isNull() & (F.col("result") == "INSUFFICIENT") & (F.col("confidence") == 0), "VERIFICATION_UNVERIFIED_CANDIDATE", "WARNING"),
    ])


def unstated_issues(facts: DataFrame) -> DataFrame:
    """NOT_STATED facts that claim something: a value with a normalised one, supporting evidence (n_supports), a supported state."""
    none = F.col("status") == "NOT_STATED"
    return _issues(facts, ["envelope_id", "pos"], [
        (none & ~is_unstated(F.col("value"), "validate") & F.col("normalized").isNotNull(), "FACT_NOT_STATED_INCONSISTENT_VALUE", "ERROR"),
        (none & (F.col("n_supports") > 0), "FACT_NOT_STATED_HAS_SUPPORTING_EVIDENCE", "ERROR"),
        (none & (F.col("state") == "SUPPORTS"), "FACT_NOT_STATED_VERIFICATION_SUPPORTED", "ERROR"),
    ])


def reconcile(facts: DataFrame) -> DataFrame:
    """facts (status, state, notes) with the status that verification leaves, the note appended, and code and severity of a change."""
    new = reconciled(F.col("status"), F.col("state"))
    moved = new != F.col("status")
    note = F.concat(F.lit("Status reconciled from "), F.col("status"), F.lit(" "), F.element_at(F.create_map(*(F.lit(x) for k, (_, n) in CHANGES.items() for x in (k, n))), new))
    severity = F.element_at(F.create_map(*(F.lit(x) for k, (s, _) in CHANGES.items() for x in (k, s))), new)
    notes = F.when(moved, F.concat_ws(" | ", F.nullif(F.col("notes"), F.lit("")), note)).otherwise(F.col("notes"))
    return facts.select("*", F.when(moved, F.concat(F.lit("FACT_RECONCILED_TO_"), new)).alias("code"), F.when(moved, severity).alias("severity"), new.alias("_new"), notes.alias("_notes")).drop("status", "notes").withColumnsRenamed({"_new": "status", "_notes": "notes"})


def payload_issues(cases: DataFrame) -> DataFrame:
    """Categories whose record is missing, and irrelevant cases that carry one: has_<c> is the category, <c> the record (null: none)."""
    rules = [(F.col(f"has_{c}") & F.col(c).isNull(), f"CATEGORY_PAYLOAD_MISMATCH_{c.upper()}", "ERROR") for c in ("icsr", "pqc", "mi", "not_relevant")]
    polluted = F.col("has_not_relevant") & F.coalesce("icsr", "pqc", "mi").isNotNull()
    return _issues(cases, ["envelope_id"], [*rules, (polluted, "CATEGORY_NOT_RELEVANT_POLLUTED", "ERROR")])


def related(facts: DataFrame) -> DataFrame:
    """facts (envelope_id, pos, field, snippet) with the other fields, in order, that rest on the same snippet of their envelope."""
    stated = facts.filter(~is_unstated(F.col("snippet"), "view")).withColumn("_same", key(F.col("snippet")))
    groups = stated.groupBy("envelope_id", "_same").agg(F.array_sort(F.collect_list(F.struct("pos", "field"))).alias("all"))
    rows = groups.select("envelope_id", "all", F.inline("all"))
    others = F.transform(F.filter("all", lambda x: x["field"] != F.col("field")), lambda x: x["field"])
    return rows.select("envelope_id", "pos", "field", others.alias("related")).filter(F.size("related") > 0)


# Sentences for a reviewer.
CLOSE_IT = "Submission does not meet adverse event or quality complaint reportability thresholds; candidate for administrative closure."
CRITICAL_CASE = "Critical priority intake; expedited medical assessment and containment evaluation required."
EXPEDITED_CASE = "Potential 15-day expedited reporting consideration; subject to medical/regulatory review."
PHOTO = "Product defect image requires human visual inspection in viewer."
HANDWRITTEN = "Handwritten source documentation requires reviewer manual verification."


def attention(cases: DataFrame, facts: DataFrame, critical: list[str]) -> DataFrame:
    """Ordered, distinct sentences per case.

    cases: envelope_id, not_relevant, multi, categories (array), urgency, has_icsr, photo, language (null: no other one),
    handwritten. facts: envelope_id, pos, field, value, status.
    """
    low, status = F.lower("field"), F.col("status")
    missing = (
        F.when(low.contains("dose"), "Administered dose is not stated — reviewer confirmation required.").when(low.contains("lot"), "Product lot/batch is not stated.")
        .when(low.contains("age") & F.col("has_icsr"), "Patient age is not stated.").when(F.col("field").isin(*critical), F.concat("field", F.lit(" is not stated in source documentation.")))
    )
    doubt = F.when(~low.contains("dose"), F.concat("field", F.lit(" is marked uncertain ('"), "value", F.lit("') — reviewer verification required.")))
    clash = F.concat(F.lit("Discrepancy detected for "), "field", F.lit(" ('"), "value", F.lit("') across source materials — resolve conflict."))
    said = F.when(status == "NOT_STATED", F.struct(F.lit(7).alias("rule"), F.col("pos"), missing.alias("text"))).when(status == "UNCERTAIN", F.struct(F.lit(8).alias("rule"), F.col("pos"), doubt.alias("text"))).when(status == "CONFLICT", F.struct(F.lit(9).alias("rule"), F.col("pos"), clash.alias("text")))
    own = facts.join(cases.select("envelope_id", "has_icsr").hint("merge"), "envelope_id").withColumn("x", said).filter("x.text is not null")
    own = own.groupBy("envelope_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["text"]).alias("own"))
    dual = F.concat(F.lit("Dual regulatory domain ("), F.array_join("categories", " & "), F.lit("); review across both safety and quality workflows."))
    tongue = F.concat(F.lit("Non-English source documentation ("), F.col("language"), F.lit("); verify verbatim original text against extraction."))
    general = F.array_compact(F.array(
        F.when(F.col("multi"), dual), F.when(F.col("urgency") == "CRITICAL", CRITICAL_CASE).when(F.col("has_icsr") & (F.col("urgency") == "EXPEDITED"), EXPEDITED_CASE),
        F.when(F.col("photo"), PHOTO), tongue, F.when(F.col("handwritten"), HANDWRITTEN),
    ))
    every = F.array_distinct(F.concat(general, F.coalesce("own", F.array().cast("array<string>"))))
    return cases.join(own.hint("merge"), "envelope_id", "left").select("envelope_id", F.when(F.col("not_relevant"), F.array(F.lit(CLOSE_IT))).otherwise(every).alias("sentences"))
