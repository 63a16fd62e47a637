"""A mailbox's table, filled by batches that can be run again: messages, their attachments and audit rows, each batch a partition.

A batch writes its own partition of each table (``batch=``), whole: what it wrote before, if it is run again, is replaced (dynamic partition
overwrite), and nothing of other batches is touched. So a batch that failed half-way, or whose checkpoint was lost, leaves no half and no double.
The highest message number in the table is its mark; a stream begins beyond it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.language import file_flavor
from ..operators.shared import written
from ..sources.mail import mail_stream

MESSAGES = "number long, filename string, message_id string, date string, sender string, sender_email string, recipient string, subject string, raw_body string, status string, n_attachments int, batch long"
ATTACHMENTS = "message_id string, pos int, filename string, content_type string, size_bytes long, flavor string, bytes binary, batch long"
AUDIT = "message_id string, reviewer_username string, action string, target_field string, original_value string, new_value string, reviewer_comments string, ts timestamp, batch long"
TABLES = {"messages": MESSAGES, "attachments": ATTACHMENTS, "audit_events": AUDIT}


def received(mail: DataFrame, source: str, now: Column) -> dict[str, DataFrame]:
    """What new mail becomes: messages with status RECEIVED, their attachments by place, an audit row for each."""
    n = F.greatest(F.coalesce(F.size("attachments"), F.lit(0)), F.lit(0))
    rows = mail.select(*(c for c in mail.columns if c not in ("body_text", "attachments")), F.col("body_text").alias("raw_body"), F.lit("RECEIVED").alias("status"), n.alias("n_attachments"))
    files = mail.select("message_id", F.posexplode("attachments").alias("pos", "a")).select("message_id", "pos", "a.filename", "a.content_type", "a.size_bytes", file_flavor(F.col("a.filename")).alias("flavor"), "a.bytes")
    said = F.concat(F.lit(f"Ingested from {source} ("), F.coalesce("filename", F.lit("")), F.lit(") with "), n.cast("string"), F.lit(" attachments"))
    lit = lambda value, name: F.lit(value).alias(name)
    audit = mail.select("message_id", lit("SYSTEM_INGESTOR", "reviewer_username"), lit("MESSAGE_INGESTED", "action"), lit("STATUS", "target_field"), lit("NEW", "original_value"), lit("RECEIVED", "new_value"), said.alias("reviewer_comments"), now.alias("ts"))
    return {"messages": rows, "attachments": files, "audit_events": audit}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the mailbox; without rows as long as no batch has come."""
    spark.createDataFrame([], TABLES[name]).write.mode("ignore").partitionBy("batch").parquet(f"{folder}/{name}")
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}")


def mark(spark: SparkSession, folder: str) -> int:
    """The highest message number in the table, -1 without any."""
    top = table(spark, folder, "messages").agg(F.max("number")).first()[0]
    return -1 if top is None else top


def put(mail: DataFrame, folder: str, batch: int, source: str = "mail", now: Column | None = None) -> None:
    """Write what of ``mail`` no other batch has: of messages with one id the first by number; messages last, as they are the mark."""
    spark = mail.sparkSession
    known = table(spark, folder, "messages").filter(F.col("batch") != batch).select("message_id").distinct()
    first = mail.groupBy("message_id").agg(F.min_by(F.struct(*mail.columns), F.struct("number", "filename")).alias("m")).select("m.*")
    # the tables below are written from the same rows, whatever happens to the mailbox meanwhile
    new = written(first.join(known.hint("merge"), "message_id", "left_anti"), "new-mail")
    rows = received(new, source, F.current_timestamp() if now is None else now)
    for name in ("attachments", "audit_events", "messages"):
        placed = rows[name].withColumn("batch", F.lit(batch).cast("long"))
        table(spark, folder, name)
        placed.select(*(c.split()[0] for c in TABLES[name].split(", "))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{folder}/{name}")


def fetch(spark: SparkSession, mailbox: str, folder: str, checkpoint: str, every: str | None = None, source: str = "mail", now: Column | None = None, **options: int):
    """Take in what a mailbox has beyond the table's mark: to its present end, or every so often ("15 seconds"; the query is returned).

    Batches are numbered on from the table's own: a new checkpoint, after a lost one, doesn't overwrite what is there.
    """
    last = table(spark, folder, "messages").agg(F.max("batch")).first()[0]
    offset = 0 if last is None else last + 1
    held = f"{checkpoint}/first-batch"
    spark.createDataFrame([(offset,)], "first long").write.mode("ignore").parquet(held)  # one for a checkpoint
    offset = spark.read.parquet(held).first()[0]
    stream = mail_stream(spark, mailbox, mark(spark, folder), **options)
    writer = stream.writeStream.foreachBatch(lambda rows, batch: put(rows, folder, offset + batch, source, now)).option("checkpointLocation", f"{checkpoint}/stream")
    if every:
        return writer.trigger(processingTime=every).start()
    writer.trigger(availableNow=True).start().awaitTermination()
