"""Message intake as a stream: copies by message id dropped, also those of items from before the start, known ids left out on arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def intake(spark: SparkSession, folder: str, schema: str, start: str, late: str = "15 seconds") -> DataFrame:
    """A stream over message files (message_id, ts, ...): the first item of each id, unless it is older than ``start`` by more than ``late``.

    Ids are keyed state, on disk and without expiry: a batch looks up its own ids only, however many came before. An item from before the start
    is remembered as well, so that a copy of it with a newer date is no new mail. Of copies in one batch any one counts as the first. Mail
    that arrives out of order is kept, however old next to the newest one seen.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    first = spark.readStream.schema(schema).parquet(folder).dropDuplicates(["message_id"])
    return first.filter(F.col("ts") >= F.to_timestamp(F.lit(start)) - F.expr(f"interval {late}"))


def baseline(messages: DataFrame, table: str) -> None:
    """Record the ids of what is there at the first start: none of it is taken in later."""
    messages.select("message_id").distinct().write.mode("overwrite").parquet(f"{table}/baseline")


def load(stream: DataFrame, table: str, checkpoint: str, every: str | None = None):
    """Append a stream of ``intake``: until its present end, or every so often ("15 seconds"; the query is returned).

    Its state knows what came through this checkpoint. What the table had before the checkpoint began (all, after a lost one) and the baseline
    are left out by a join with ids that are written once, when the checkpoint begins, and don't grow. A batch that is run again overwrites
    itself.
    """
    spark, none = stream.sparkSession, stream.sparkSession.createDataFrame([], "message_id string")
    none.write.mode("ignore").parquet(f"{table}/baseline")
    spark.createDataFrame([], stream.schema).write.mode("ignore").parquet(f"{table}/rows/none")
    had = spark.read.schema("message_id string").option("recursiveFileLookup", "true").parquet(f"{table}/rows").unionByName(spark.read.parquet(f"{table}/baseline"))
    before = f"{checkpoint}/ids-before"
    had.select("message_id").distinct().write.mode("ignore").parquet(before)
    # batches of another checkpoint keep their folders
    own = f"{spark.read.parquet(before).count():012d}"

    def store(rows: DataFrame, batch: int) -> None:
        known = rows.sparkSession.read.parquet(before)
        rows.join(known.hint("merge"), "message_id", "left_anti").write.mode("overwrite").parquet(f"{table}/rows/batch={own}-{batch:09d}")

    writer = stream.writeStream.foreachBatch(store).option("checkpointLocation", f"{checkpoint}/stream")
    if every:
        return writer.trigger(processingTime=every).start()
    writer.trigger(availableNow=True).start().awaitTermination()
