"""What the view of a message asks a reviewer to look at: focus items, warnings, and the gate that follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import view as V
from .envelope import BLOCKED, READY, WARNED

# Fields of the view whose absence a reviewer must know of, by category.
VIEW_CRITICAL = {"icsr": ("patientAge", "reporterName", "productName", "adverseEvent", "productDose"), "pqc": ("pqcProduct", "productName", "defectType", "lotNumber", "pqcLot"), "mi": ("productName", "productOrTopic", "inquirySummary", "questionText")}
# Parts of a category's name, and of the name of what is not relevant.
NAMED = {"icsr": "icsr|safety report", "pqc": "pqc|quality complaint", "mi": "mi|medical info|info request"}
IRRELEVANT = "not relevant|not_relevant"


def _item(rank: int, id_: Column, category: str, field: Column, headline: Column) -> Column:
    return F.struct(F.lit(rank).alias("rank"), id_.alias("item"), F.lit(category).alias("category"), field.alias("field"), headline.alias("headline"))


def _any(names: str, words: str) -> Column:
    return F.exists(names, lambda c: F.lower(c).rlike(words))


def view_focus(messages: DataFrame, facts: DataFrame) -> DataFrame:
    """(envelope_id, rank, pos, item, category, field, headline, warning): items in order of rank and pos; a missing critical field also warns.

    messages: envelope_id, primary_category, categories (array), is_multi_label, photo, has_mi, language, attachments (array of
    struct(language, flavor)); facts: envelope_id, pos, field, label, status. Messages that are not relevant miss no field.
    """
    irrelevant = F.coalesce(F.lower("primary_category").rlike(IRRELEVANT), F.lit(False))
    named = {k: F.coalesce(_any("categories", words), F.lit(False)) for k, words in NAMED.items()}
    photo, multi = F.coalesce("photo", F.lit(False)), F.coalesce("is_multi_label", F.lit(False)) | F.coalesce(F.size("categories") > 1, F.lit(False))
    held = {"icsr": named["icsr"], "pqc": named["pqc"] | photo, "mi": named["mi"] | F.coalesce("has_mi", F.lit(False))}
    foreign = V.foreign_language(F.col("language"), F.col("attachments"))
    own = F.array_compact(F.array(
        F.when(photo, _item(1, F.lit("focus-photo-01"), "PHOTO_DEFECT_INSPECTION", F.lit("defect_photo"), F.lit("Mandatory Defect Photo Inspection"))),
        F.when(multi, _item(2, F.lit("focus-multilabel-01"), "CATEGORY_AMBIGUITY", F.lit("primaryCategory"), F.lit("Dual Regulatory Domain (Multi-Label)"))),
        F.when(foreign.isNotNull(), _item(3, F.lit("focus-lang-01"), "MULTILINGUAL_TRANSLATION", F.lit("language"), F.concat(F.lit("Foreign Language Intake ("), foreign, F.lit(")")))),
    ))
    whole = messages.select("envelope_id", F.inline(own)).select("envelope_id", "rank", F.lit(0).alias("pos"), "item", "category", "field", "headline", F.lit(None).cast("string").alias("warning"))
    field, label, status = F.col("field"), F.col("label"), F.col("status")
    named_item = lambda rank, kind, category, text: _item(rank, F.concat(F.lit(f"focus-{kind}-"), field), category, field, F.concat(F.lit(text), label))
    critical = F.lit(False)
    for k, fields in VIEW_CRITICAL.items():
        critical = critical | (F.col(f"_{k}") & field.isin(*fields))
    kind = (
        F.when(status == "CONFLICT", named_item(4, "conflict", "EVIDENCE_CONFLICT", "Evidence Conflict: ")).when(status == "UNCERTAIN", named_item(5, "uncertain", "UNCERTAIN_HANDWRITING", "Uncertain Parameter: "))
        .when((status == "NOT_STATED") & critical & ~F.col("_none"), named_item(6, "missing", "MISSING_CRITICAL_FIELD", "Critical Field Unstated: "))
    )
    of = messages.select("envelope_id", irrelevant.alias("_none"), *(c.alias(f"_{k}") for k, c in held.items()))
    rows = facts.join(of.hint("merge"), "envelope_id").withColumn("k", kind).filter("k is not null")
    warning = F.when(F.col("k.rank") == 6, F.concat(F.lit("Critical regulatory field '"), label, F.lit("' is NOT_STATED.")))
    return whole.unionByName(rows.select("envelope_id", F.col("k.rank"), F.col("pos").cast("int").alias("pos"), "k.item", "k.category", "k.field", "k.headline", warning.alias("warning")))


def view_gate(messages: DataFrame, items: DataFrame) -> DataFrame:
    """(envelope_id, n_focus, n_warnings, gate): failed messages are blocked; items (conflicts among them) warn unless the message is not relevant."""
    counts = items.groupBy("envelope_id").agg(F.count("*").alias("n_focus"), F.count("warning").alias("n_warnings"))
    rows = messages.select("envelope_id", "status", F.coalesce(F.lower("primary_category").rlike(IRRELEVANT), F.lit(False)).alias("_none")).join(counts.hint("merge"), "envelope_id", "left").na.fill(0, ["n_focus", "n_warnings"])
    gate = F.when(F.col("status") == "FAILED", BLOCKED).when(~F.col("_none") & (F.col("n_focus") > 0), WARNED).otherwise(READY)
    return rows.select("envelope_id", "n_focus", "n_warnings", gate.alias("gate"))
