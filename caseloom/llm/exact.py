"""Exact duplicates by a stateful stream with disk-backed keyed state.

Arriving documents are written to a content store, each with a locator: the number of its arrival and its place in it. A stream
over the store keeps one state row per digest in RocksDB, without expiry: copies so far, the identifier of the row that
stays, and the locator of the content that came first. Copies are combined before the shuffle, so a digest with a
third of all rows is no hot task. In each micro-batch every hit is checked on the full bytes against the content at the
locator; texts that merely share a digest are told apart. A store that is kept goes on where it stopped: later arrivals meet
the retained digests.

Defined results: texts are equal when identical after deleting white space; null counts as empty. Of equal texts the
row with the most code points stays, then the smallest doc_id (null last), then the one that came first, so exactly one row of
each group stays, also where rows are repeated. A text of any length is compared as a whole. Extra columns are ignored, or kept on request. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import SPACES, forget, new_path, text_of, written


@dataclass(frozen=True)
class Exact:
    """The digest of a normalised text (any function of it: full bytes are compared), arrivals that a table is dealt into, files to a micro-batch."""

    digest: Callable[[Column], Column] = lambda text: F.sha2(text, 256)
    arrivals: int = 2
    files: int = 1000


#: RocksDB keeps the state on disk, its memory bounded and nothing allocated ahead, and uploads changes only.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def normalised(text: Column) -> Column:
    """The text without white space."""
    return F.translate(text_of(text), SPACES, "")


def arrive(docs: DataFrame, store: str, arrival: int, p: Exact = Exact()) -> None:
    """Write docs as an arrival of the store: doc_id, digest, sha, n_chars, place, and the whole row as doc."""
    text = normalised(F.col("text"))
    rows = docs.select("doc_id", p.digest(text).alias("digest"), F.sha2(text, 256).alias("sha"), F.length(text_of("text")).alias("n_chars"), F.struct(*docs.columns).alias("doc"))
    rows.withColumn("place", F.monotonically_increasing_id()).write.mode("overwrite").option("compression", "zstd").parquet(f"{store}/content/arrival={arrival}")


def content(spark: SparkSession, store: str) -> DataFrame:
    """Everything that has arrived."""
    return spark.read.option("basePath", f"{store}/content").parquet(f"{store}/content").withColumn("arrival", F.col("arrival").cast("int"))


def _rank() -> Column:
    """What stays is the least of these."""
    return F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "arrival", "place")


def _differing(spark: SparkSession, fresh: DataFrame, store: str) -> DataFrame:
    """Digests of a micro-batch whose arrivals differ in their bytes from the content at the locator."""
    arrived = [r[0] for r in fresh.select("arrival").distinct().collect()]  # an arrival or a few
    hits = fresh.filter("n > 1").select("digest", "first")
    every = content(spark, store).select("digest", "arrival", "place", normalised(F.col("doc.text")).alias("bytes"))
    # The join feeds no grouping, so that a digest with many hits can be split.
    found = written(every.filter(F.col("arrival").isin(arrived)).join(hits.hint("merge"), "digest"), "hits")
    here = (F.col("arrival") == F.col("first.arrival")) & (F.col("place") == F.col("first.place"))
    at = found.filter(here).select("digest", F.col("bytes").alias("kept"))
    retained = hits.filter(~F.col("first.arrival").isin(arrived)).select(F.col("first.arrival").alias("arrival"), F.col("first.place").alias("place"))
    earlier = every.filter(~F.col("arrival").isin(arrived)).join(retained.hint("merge"), ["arrival", "place"]).select("digest", F.col("bytes").alias("kept"))
    differ = written(found.join(at.unionByName(earlier).hint("merge"), "digest").filter("bytes != kept").select("digest"), "differ")
    forget(found)
    return differ


def advance(spark: SparkSession, store: str, p: Exact = Exact()) -> None:
    """Run the stream over what has arrived since the last call."""
    schema = content(spark, store).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", p.files).parquet(f"{store}/content")
    kept = stream.groupBy("digest").agg(F.count("*").alias("n"), F.min(_rank()).alias("keep"), F.min(F.struct("arrival", "place")).alias("first"), F.max("arrival").alias("arrival"))

    def keep(rows: DataFrame, batch: int) -> None:
        classes, differ = f"{store}/classes/batch={batch}", f"{store}/differ/batch={batch}"
        rows.write.mode("overwrite").parquet(classes)
        _differing(spark, spark.read.parquet(classes), store).write.mode("overwrite").parquet(differ)

    with _settings(spark, _STATE):
        query = kept.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{store}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()


def seen(spark: SparkSession, store: str) -> DataFrame:
    """digest, n, keep (what stays), first (the locator) as they stand in the state."""
    batches = spark.read.option("basePath", f"{store}/classes").parquet(f"{store}/classes")
    return batches.groupBy("digest").agg(*(F.max_by(c, "batch").alias(c) for c in ("n", "keep", "first")))


def _judged(spark: SparkSession, store: str, arrivals: list[int], columns: list[Column], p: Exact) -> DataFrame:
    """columns of the rows of some arrivals, with keep_id, group_size, kept and text_sha256."""
    own = content(spark, store).filter(F.col("arrival").isin(arrivals))
    shown = [F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"), ((F.col("arrival") == F.col("keep.arrival")) & (F.col("place") == F.col("keep.place"))).alias("kept"), F.col("sha").alias("text_sha256")]
    names = [f"_{i}" for i in range(len(columns))]
    cut = lambda df: df.select(*(c.alias(n) for c, n in zip(columns, names, strict=True)), "digest", "sha", "arrival", "place")
    differ = written(spark.read.option("basePath", f"{store}/differ").parquet(f"{store}/differ").select("digest").distinct(), "differ")
    out = cut(own).join(written(seen(spark, store), "classes").hint("merge"), "digest")
    if differ.isEmpty():
        return out.select(*names, *shown)
    # Texts that share a digest but not their bytes: groups of equal bytes, for these digests alone.
    mixed = content(spark, store).join(differ.hint("merge"), "digest", "left_semi").withColumn("bytes", normalised(F.col("doc.text")))
    again = written(mixed.groupBy("bytes").agg(F.count("*").alias("n"), F.min(_rank()).alias("keep")), "again")
    apart = mixed.filter(F.col("arrival").isin(arrivals)).select(*(c.alias(n) for c, n in zip(columns, names, strict=True)), "sha", "arrival", "place", "bytes").join(again.hint("merge"), "bytes")
    return out.join(differ.hint("merge"), "digest", "left_anti").select(*names, *shown).unionByName(apart.select(*names, *shown))


def _run(docs: DataFrame, columns: list[Column], p: Exact, store: str | None) -> DataFrame:
    spark = docs.sparkSession
    if store is None:
        store, arrivals = new_path(spark, "exact"), range(p.arrivals)
        deal = F.pmod(F.xxhash64("doc_id", "text"), F.lit(p.arrivals))
    else:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/content")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        arrivals, deal = [len(files.listStatus(path)) if files.exists(path) else 0], F.lit(None)
    for k in arrivals:
        arrive(docs if deal is None or len(arrivals) == 1 else docs.filter(deal == k), store, k, p)
        advance(spark, store, p)
    return _judged(spark, store, list(arrivals), columns, p)


def exact_duplicates(docs: DataFrame, p: Exact = Exact(), store: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row.

    Without a store the table is dealt into ``Exact.arrivals`` arrivals of a new one, so that the later ones meet the state that the first
    left. With one, docs are its next arrival: their copies in earlier ones count, and may be what stays.
    """
    return _run(docs.select("doc_id", "text"), [F.col("doc_id")], p, store).withColumnRenamed("_0", "doc_id")


def without_copies(docs: DataFrame, p: Exact = Exact()) -> DataFrame:
    """The rows of docs that stay, in its columns."""
    return _run(docs, [F.col("doc")], p, None).filter("kept").select("_0.*")
