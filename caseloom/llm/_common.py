"""Helpers shared by the operators of this subpackage: written stages, bounded Arrow batches, Arrow text slices."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words, as code points and as a Java character class (fixed by the contracts).
SPACE_CODES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
SPACE_CLASS = r"\x20\x09-\x0D"
SPACES = "".join(map(chr, SPACE_CODES))
#: Most text bytes that one numpy step looks at, unless a single text is longer.
SLICE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a local one only where none is set and one machine does all."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), f"caseloom-{os.getuid()}")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read back: its lineage ends here, and lost executors cost nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def forget(*stages: DataFrame) -> None:
    """Delete written stages, once everything that reads them is written itself."""
    for stage in stages:
        drop_path(stage.sparkSession, stage.written_path)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches small enough for long texts."""
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "1000"), ("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))):
        try:
            spark.conf.set(key, value)
        except Exception:  # noqa: BLE001  a setting that this Spark doesn't have
            pass


def text_of(column: str | Column) -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def text_slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, UTF-8 bytes, offsets from 0) of successive rows of a string array, nulls as empty.

    A slice has up to ``most`` bytes, or a single longer text.
    """
    texts = texts.fill_null("").cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + most, "right")) - 1)
        yield lo, hi, raw[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo]
        lo = hi


def runs_of(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Successive rows with one value of ``key`` as a table; the rows arrive sorted by it, a run may span batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(key)
        code = values.dictionary_encode().indices.to_numpy() if not pa.types.is_integer(values.type) else values.to_numpy()
        cuts = [0, *(np.flatnonzero(code[1:] != code[:-1]) + 1), batch.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            part = batch.slice(lo, hi - lo)
            if held and held[0].column(key)[0] != part.column(key)[0]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)
