"""A training corpus from raw documents: each stage reads what the one before it kept, written as Parquet.

Defined results: a row is judged by its own text and number, so null and repeated doc_ids lose nothing and keep nothing they
should not. Null and empty texts are scored like others; one of all empty texts stays; mixing takes none of them, as their size is 0. An
empty table gives no rows. All columns of documents, also others than the usual ones, are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm._common import written
from caseloom.llm.exact import without_copies
from caseloom.llm.minhash import MinMax, near_duplicates
from caseloom.llm.mixing import mix_sources
from caseloom.llm.packing import Packing, pack
from caseloom.llm.queries import tokenizer_path
from caseloom.llm.toxicity import toxicity


def _whole(docs: DataFrame) -> Column:
    """A row of docs as one column, so that no name of its columns can clash."""
    return F.struct(*docs.columns).alias("doc")


def _numbered(docs: DataFrame) -> DataFrame:
    """(doc, row): whole rows with a number each: its doc_id; a number above all of them where doc_id is null, no number, or another row's as well."""
    known = F.col("doc_id").cast("long")
    counts = docs.groupBy(known.alias("id")).agg(F.count("*").alias("n"))
    odd = written(counts.filter("id is null or n > 1").select(F.col("id").alias("odd"), F.lit(True).alias("is_odd")), "odd")
    rows = docs.select(_whole(docs), known.alias("row"))
    if odd.isEmpty():
        return rows
    top = docs.agg(F.max(known)).first()[0]
    above = F.lit(0 if top is None else max(top + 1, 0)) + F.monotonically_increasing_id()
    return written(rows.join(odd.hint("merge"), F.col("row").eqNullSafe(F.col("odd")), "left").select("doc", F.when(F.col("is_odd"), above).otherwise(F.col("row")).alias("row")), "numbered")


def _by_number(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("row").alias("doc_id"), "doc.text", "doc.source")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; each row is judged by its own text, whatever its doc_id."""
    judged = toxicity(docs.select("doc_id", "text", _whole(docs)), spark.read.parquet(f"{sf_dir}/labels.parquet"), also=("doc",))
    return judged.filter("predicted = 0").select("doc.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, whatever their doc_ids; different texts under one doc_id, or none, stay."""
    return without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, on shingles of five words and a similarity of 0.8 or more."""
    rows = _numbered(docs)
    kept = written(near_duplicates(_by_number(rows), MinMax()).filter("kept").select("doc_id"), "verdicts")
    return rows.join(kept.hint("merge"), F.col("row") == F.col("doc_id"), "left_semi").select("doc.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    rows = _numbered(docs)
    taken = written(mix_sources(_by_number(rows)).filter("taken > 0").select("doc_id", (F.col("taken") / F.col("size")).cast("int").alias("times")), "verdicts")
    repeated = rows.join(taken.hint("merge"), F.col("row") == F.col("doc_id")).select("doc", F.explode(F.sequence(F.lit(1), "times")))
    return repeated.select("doc.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences."""
    return pack(docs, Packing(tokenizer_path()))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix),
    ("packing", pack_sequences),
]

#: SQL can express neither the classifier nor tokens; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
