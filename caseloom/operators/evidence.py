"""Chunks, retrieval of evidence inside a document, verification of facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import collapse, is_unstated, key

# Phrases that negate, and the separators that a looser containment test leaves out.
NEGATIONS = ("no adverse event", "denies", "no signs of", "without reaction", "no defect observed", "negative for", "absent", "ruled out", "no known")
SEPARATORS = r"[,.\s\-_/()]"


def chunk_lines(docs: DataFrame, key_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per non-blank line: pos counts blank lines too."""
    lines = docs.select(F.col(key_column).alias("document_id"), F.posexplode(F.split(text, "\n")).alias("pos", "text"))
    return lines.filter(F.trim("text") != "")


def chunk_offsets(docs: DataFrame, key_column: str = "doc_id", text: str = "text") -> DataFrame:
    """chunk_lines with each chunk's place in its document, as a running sum over the document's lines."""
    lines = docs.select(F.col(key_column).alias("document_id"), F.posexplode(F.split(text, "\n")).alias("pos", "text"))
    before = Window.partitionBy("document_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    placed = lines.withColumn("char_start", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("long"))
    return placed.filter(F.trim("text") != "").withColumn("char_end", F.col("char_start") + F.length("text"))


def tokens(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9._\-]{2,}"), F.lit(0)))


def lexical(v: Column, t: Column, own: Column, held: Column) -> Column:
    """Containment of the whole value (as ``key`` gives it) in a lower-cased text, else the share of its words among the text's."""
    share = F.when(F.size(own) > 0, F.size(F.array_intersect(own, held)) / F.size(own)).otherwise(0.0)
    return F.greatest(F.when((F.length(v) >= 3) & t.contains(v), F.lit(0.9)).otherwise(0.0), share * 0.75)


def fused(lex: Column, sem: Column) -> Column:
    """Lexical and vector score in one: whichever is sure leads."""
    return (
        F.when(sem <= 0, lex).when(lex >= 0.7, 0.65 * lex + 0.35 * sem).when((lex < 0.3) & (sem >= 0.4), 0.3 * lex + 0.7 * sem)
        .when(lex > 0, 0.5 * lex + 0.5 * sem).when(sem >= 0.4, sem).otherwise(0.0)
    )


def retrieve(facts: DataFrame, chunks: DataFrame, k: int = 3, least: float = 0.15) -> DataFrame:
    """The k best chunks of each stated fact, in its own document only; ties go to the earlier chunk."""
    # What needs one side alone is computed before the join, once per fact or chunk.
    stated = facts.filter(~is_unstated(F.col("value"), "retrieve")).withColumn("_v", key(F.col("value"))).withColumn("_own", tokens(F.col("value")))
    held = chunks.withColumn("_t", F.lower("text")).withColumn("_held", tokens(F.col("text")))
    scored = stated.join(held.hint("merge"), "document_id").withColumn("relevance", lexical(*map(F.col, ("_v", "_t", "_own", "_held")))).drop("_v", "_t", "_own", "_held").filter(F.col("relevance") >= least)
    best = Window.partitionBy("document_id", "field").orderBy(F.desc("relevance"), "pos")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def entails(value: Column, snippet: Column, negation_first: bool = False) -> Column:
    """struct(result, confidence): containment, loose containment, negation, else not enough."""
    v, s = key(value), F.lower(F.coalesce(snippet, F.lit("")))
    loose_v, loose_s = F.regexp_replace(v, SEPARATORS, ""), F.regexp_replace(s, SEPARATORS, "")
    negated = F.lit(False)
    for phrase in NEGATIONS:
        negated = negated | s.contains(phrase)
    row = lambda name, conf: F.struct(F.lit(name).alias("result"), F.lit(conf).alias("confidence"))
    out = F.when(is_unstated(value), row("INSUFFICIENT", 1.0)).when(F.trim(s) == "", row("INSUFFICIENT", 0.0))
    if negation_first:
        out = out.when(negated, row("CONTRADICTS", 0.92))
    return out.when(s.contains(v), row("SUPPORTS", 0.99)).when((F.length(loose_v) >= 3) & loose_s.contains(loose_v), row("SUPPORTS", 0.98)).when(negated, row("CONTRADICTS", 0.92)).otherwise(row("INSUFFICIENT", 0.35))


def prune(candidates: DataFrame, keep: int = 2) -> DataFrame:
    """Mark copies (same source and normalised snippet in a fact) and what stands after the first ``keep`` others."""
    print_ = F.sha2(F.concat_ws("|", "source_id", collapse(F.col("snippet"))), 256)
    rows = candidates.withColumn("print", print_)
    copy = F.row_number().over(Window.partitionBy("document_id", "field", "print").orderBy("pos")) > 1
    rows = rows.withColumn("copy", copy)
    order = Window.partitionBy("document_id", "field", "copy").orderBy("pos")
    return rows.withColumn("pruned", ~F.col("copy") & (F.row_number().over(order) > keep))


def fact_state(results: DataFrame, by: list[str]) -> DataFrame:
    """Any contradiction, else any support, else not enough."""
    against, support = F.bool_or(F.col("result") == "CONTRADICTS"), F.bool_or(F.col("result") == "SUPPORTS")
    return results.groupBy(*by).agg(F.when(against, "CONTRADICTS").when(support, "SUPPORTS").otherwise("INSUFFICIENT").alias("state"), F.count("*").alias("n_evidence"))


def clean_answers(tasks: DataFrame, answers: DataFrame, by: list[str]) -> DataFrame:
    """Every task with its first answer: unknown results and unusable confidences made harmless, missing answers filled."""
    first = answers.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy("pos"))).filter("rn = 1")
    value = F.col("confidence").try_cast("double")
    usable = F.when(value.isNull() | F.isnan(value) | value.isin(float("inf"), float("-inf")), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))
    known = F.col("result").isin("SUPPORTS", "CONTRADICTS", "INSUFFICIENT")
    joined = tasks.join(first.withColumn("answered", F.lit(True)).hint("merge"), by, "left")
    return joined.select(*by, F.when(known, F.col("result")).otherwise("INSUFFICIENT").alias("result"), F.when(F.col("answered"), usable).otherwise(0.0).alias("confidence"), F.coalesce("answered", F.lit(False)).alias("answered"))
