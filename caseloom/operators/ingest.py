"""Idempotent loading of messages: known ids, pending ones, replacement, purge, results kept by content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def new_only(incoming: DataFrame, known: DataFrame, key: str = "message_id") -> DataFrame:
    return incoming.join(known.select(key).hint("merge"), key, "left_anti")


def pending(incoming: DataFrame, known: DataFrame, key: str = "message_id") -> DataFrame:
    """Known messages that were received but never processed: they are dispatched again."""
    return incoming.join(known.filter("status = 'RECEIVED'").select(key).hint("merge"), key, "left_semi")


def replace(table: DataFrame, rows: DataFrame, key: str = "message_id") -> DataFrame:
    return table.join(rows.select(key).hint("merge"), key, "left_anti").unionByName(rows)


def purge(table: DataFrame, protected: str) -> DataFrame:
    """Without unfinished rows, but for those whose id matches the pattern."""
    return table.filter(~F.col("status").isin("FAILED", "RECEIVED", "PROCESSING") | F.col("message_id").rlike(protected))


def with_cached(messages: DataFrame, cache: DataFrame, text: str = "text") -> DataFrame:
    """Messages with the result that is kept for their content, if any."""
    return messages.withColumn("content_hash", F.sha2(F.coalesce(text, F.lit("")), 256)).join(cache.hint("merge"), "content_hash", "left")


def message_id(column: str, number: str):
    """Brackets removed; a name from the running number where there is none."""
    bare = F.nullif(F.regexp_replace(F.trim(F.coalesce(column, F.lit(""))), "[<>]", ""), F.lit(""))
    return F.coalesce(bare, F.concat(F.lit("IMAP-UID-"), F.col(number).cast("string")))
