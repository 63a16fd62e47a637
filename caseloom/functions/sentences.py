"""Sentences of summaries, and the gate on their number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abbreviations in the order and form in which they come back (any case is rewritten to it), least and
# most sentences, and the sentences and tags that the gate adds.
ABBREVIATIONS = ("Dr", "Mr", "Mrs", "Ms", "Prof", "Sr", "Sra", "Srta", "St", "vs", r"e\.g", r"i\.e", "No", "Ref", "Pt", "Fig", "approx", "dept", "vol", "ed", "inc", "ltd", "co", r"p\.m", r"a\.m")
LEAST, MOST = 10, 15
AUDIT_LOG = ("Full source verification records and evidence citations for ", " are preserved in the intake audit log.")
WORKSPACE = ("Complete primary source documentation and verbatim audit citations for ", " remain accessible in the case workspace for regulatory verification.")
NEEDS_REVIEW = (" [NEEDS_REVIEW: Document summary contains ", " sentences; regulatory standard requires 10-15]")
#: Stand for a dot that ends no sentence; from the private use area.
DOT, POINT = "\ue000", "\ue001"


def sentences(c: Column) -> Column:
    """Sentences in order; empty for null or blank text. Decimals, abbreviations and single capitals don't end one."""
    t = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))
    t = F.regexp_replace(t, r"(?U)(\d+)\.(\d+)", f"$1{POINT}$2")
    for a in ABBREVIATIONS:
        t = F.regexp_replace(t, rf"(?iU)\b{a}\.", a.replace("\\", r"\\") + DOT)
    t = F.regexp_replace(t, r"(?U)\b([A-Z])\.", f"$1{DOT}")
    parts = F.transform(F.split(t, r"(?U)(?<=[.!?])\s+"), lambda s: F.trim(F.translate(s, DOT + POINT, "..")))
    return F.filter(parts, lambda s: s != "")


def gated(summary: Column, own: Column, filename: Column, rewritten: Column | None = None, redone: Column | None = None) -> Column:
    """A summary of 10 to 15 sentences where that can be had.

    ``own`` is sentences(summary). ``rewritten`` is an optional second attempt by a model (null: it failed) and ``redone``
    its sentences. Blank and unstated summaries and those with an extraction warning stay as they are.
    """
    n, joined = F.size(own), lambda parts: F.array_join(parts, " ")
    with_ = lambda parts, ends: F.concat(parts, F.array(F.concat(F.lit(ends[0]), filename, F.lit(ends[1]))))
    alone = F.when(n == LEAST - 1, joined(with_(own, AUDIT_LOG))).otherwise(summary)
    first = joined(F.slice(own, 1, MOST))
    few, many = alone, first
    if rewritten is not None:
        m = F.size(redone)
        fits = m.between(LEAST, MOST)
        tagged = F.concat(rewritten, F.lit(NEEDS_REVIEW[0]), m.cast("string"), F.lit(NEEDS_REVIEW[1]))
        few = F.when(rewritten.isNull(), alone).when(fits, rewritten).when(m == LEAST - 1, joined(with_(redone, WORKSPACE))).when(m < LEAST, tagged).otherwise(joined(F.slice(redone, 1, MOST)))
        many = F.when(rewritten.isNotNull() & fits, rewritten).otherwise(first)
    untouched = F.coalesce(F.trim(summary).isin("", "Not stated"), F.lit(True)) | summary.startswith("[EXTRACTION WARNING]")
    return F.when(untouched | n.between(LEAST, MOST), summary).when(n < LEAST, few).otherwise(many)
