"""Tables of cases in a folder: stored whole, appended to, reset; columns kept as JSON; audit rows that are only ever added."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables and what each is stored by; a table of another name is refused.
TABLES = {"messages": "status", "attachments": None, "icsr_reports": None, "pqc_reports": None, "mi_reports": None, "audit_events": None, "literature_articles": None}


def store(df: DataFrame, folder: str, table: str, mode: str = "append") -> None:
    """Write a table as Parquet; messages lie by status, so that a queue reads its own part."""
    if mode != "append" and table == "audit_events":
        raise ValueError("audit rows are only ever added")
    writer = df.write.mode(mode)
    by = TABLES[table]
    (writer.partitionBy(by) if by else writer).parquet(f"{folder}/{table}")


def stored(spark: SparkSession, folder: str, table: str) -> DataFrame:
    if table not in TABLES:
        raise ValueError(f"no table {table}")
    return spark.read.parquet(f"{folder}/{table}")


def reset(df: DataFrame, folder: str, table: str) -> None:
    """Everything out, df in."""
    store(df, folder, table, "overwrite")


def audit_rows(events: DataFrame, now: Column) -> DataFrame:
    """Audit rows with their defaults: a reviewer's name, the time, no field and no values."""
    has = events.columns
    given = lambda c, default: F.coalesce(F.col(c), default) if c in has else default
    none = F.lit(None).cast("string")
    return events.select("message_id", given("ts", now).alias("ts"), given("reviewer_username", F.lit("Reviewer")).alias("reviewer_username"), "action", *(given(c, none).alias(c) for c in ("target_field", "original_value", "new_value", "reviewer_comments")), F.lit(True).alias("is_immutable"))


def as_json(df: DataFrame, *columns: str) -> DataFrame:
    """Nested columns as JSON text; null stays null."""
    return df.withColumns({c: F.to_json(c) for c in columns})


def from_json(df: DataFrame, **schemas: str) -> DataFrame:
    return df.withColumns({c: F.from_json(c, schema) for c, schema in schemas.items()})


def literature_rows(screened: DataFrame, now: Column) -> DataFrame:
    """Screened articles as rows of their table, awaiting review."""
    return screened.select("*", F.lit("PENDING").alias("review_status"), now.alias("created_at"))


def save_evaluation(summary: DataFrame, cases: DataFrame, folder: str) -> None:
    """An evaluation as JSON lines: its summary, and a line per case."""
    summary.write.mode("overwrite").json(f"{folder}/summary")
    cases.write.mode("overwrite").json(f"{folder}/cases")


def attachment_bytes(attachments: DataFrame, value: object) -> DataFrame:
    """Name, type and bytes of one attachment; a missing type is that of unknown bytes."""
    return attachments.filter(F.col("id") == F.lit(value)).select("filename", F.coalesce("content_type", F.lit("application/octet-stream")).alias("content_type"), "bytes")
