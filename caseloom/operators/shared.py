"""The folder that driver and executors share, and tables that are written there to cut their lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in spark.checkpoint.dir; a local one only where that isn't set and one machine does all."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written and read back: what reads it more than once computes it once, and a lost executor costs its tasks alone."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a table to a task, where each row becomes many.
DEALT = 10_000


def dealt(rows: DataFrame, *keys: str, most: int = DEALT) -> DataFrame:
    """rows dealt by their keys to so many tasks that each has about ``most``, before they become many more.

    A small file is one task, and what its rows become would be sorted there all at once; the number of tasks is given, so that none are put together
    again by the size of what they read. What is grouped or joined by these keys afterwards stays where it is. Reads rows once more, to count them.
    """
    return rows.repartition(max(1, -(-rows.count() // most)), *keys)
