"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

Each distinct word of a text, weighted by its count, draws for every sample two gamma variables and a uniform one from
its hash; the least value over the words wins, and two texts agree in a sample with a probability equal to the
generalised Jaccard similarity of their word counts. A sample is one 64-bit number, value above identity, so that the
winner is a plain minimum which is combined before anything moves. A text and its edited form share most words; a word with
one count in both is drawn for once.

Defined results: null and empty texts, and texts of white space, have the fingerprint of the empty word; a null doc_id
has no next document, its edited text just loses its end, and near_next is null. Rows with one doc_id are documents of their own with the
same next document; where the next doc_id has several rows, the least text start and fingerprint stand for it. Extra
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import SPACE_CLASS, text_of, written


@dataclass(frozen=True)
class Samples:
    """Samples to a fingerprint, seed."""

    count: int = 32
    seed: int = 41


def _uniform(bits: Column, upper: bool) -> Column:
    part = F.shiftrightunsigned(bits, 32) if upper else bits.bitwiseAND(F.lit(0xFFFFFFFF))
    return (part + F.lit(0.5)) * F.lit(2.0**-32)


def sample_of(term: Column, log_weight: Column, k: int, p: Samples = Samples()) -> Column:
    """Sample k of a weighted term: its value, order-preserving, in the upper bits, and its identity in the lower 32."""
    one, two = F.xxhash64(term, F.lit(p.seed * 1000 + k)), F.xxhash64(term, F.lit(p.seed * 1000 + 500 + k))
    # 64 bits give three uniform numbers of 21 bits, or two of 32.
    third = lambda i: (F.shiftrightunsigned(one, 21 * i).bitwiseAND(F.lit((1 << 21) - 1)) + F.lit(0.5)) * F.lit(2.0**-21)
    r = -F.log(third(0) * third(1))
    log_c = F.log(-F.log(_uniform(two, True) * _uniform(two, False)))
    beta = third(2)
    step = F.floor(log_weight / r + beta)
    value = ((log_c - r * (step - beta + 1) + F.lit(160.0)) * F.lit(float(1 << 22))).cast("long")
    return F.shiftleft(value, 32).bitwiseOR(F.xxhash64(one, step).bitwiseAND(F.lit(0xFFFFFFFF)))


def next_of(docs: DataFrame) -> DataFrame:
    """(doc_id, prev_id, prev_chars) of each doc_id in ascending order, the last before the first.

    The ids are dealt by range; each range looks back by itself, and the ranges' ends, one row each, are put in order.
    """
    ids = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.length(text_of("text"))).alias("n"))
    ids = written(ids.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()), "ids")
    ends = ids.groupBy("part").agg(F.max(F.struct("doc_id", "n")).alias("end"))
    order = Window.orderBy("part")
    ends = written(ends.withColumn("last", F.last("end").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).withColumn("end", F.coalesce(F.lag("end").over(order), "last")).select("part", "end"), "ends")
    own = F.lag(F.struct("doc_id", "n")).over(Window.partitionBy("part").orderBy("doc_id"))
    back = ids.withColumn("own", own).join(ends.hint("merge"), "part").withColumn("prev", F.coalesce("own", "end"))
    return written(back.select("doc_id", F.col("prev.doc_id").alias("prev_id"), F.col("prev.n").alias("prev_chars")), "next")


def fingerprints(docs: DataFrame, p: Samples = Samples()) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    links = next_of(docs)
    docs = docs.select("doc_id", text_of("text").alias("text"))
    heads = docs.join(links.hint("merge"), "doc_id").select(F.col("prev_id").alias("key"), F.expr("substring(text, 1, prev_chars div 4)").alias("head"), F.col("doc_id").alias("next_id"))
    heads = written(heads.groupBy("key").agg(F.min("head").alias("head"), F.min("next_id").alias("next_id")), "heads")
    rows = docs.withColumn("row", F.monotonically_increasing_id()).join(heads.hint("merge"), F.col("doc_id") == F.col("key"), "left")
    rows = rows.withColumn("n_chars", F.length("text")).withColumn("tail", F.expr("n_chars div 4"))
    rows = rows.withColumn("edited", F.concat(F.expr("substring(text, 1, n_chars - tail)"), F.coalesce(F.expr("substring(head, 1, tail)"), F.lit(""))))
    sha = F.sha2("edited", 256)
    # A text's few facts travel as terms of sides of their own, so that its words carry nothing but their keys.
    facts = [F.col("n_chars"), F.col("next_id")] + [F.conv(F.substring(sha, 1 + 16 * i, 16), 16, -10) for i in range(4)]
    words = lambda text: F.split(text, f"[{SPACE_CLASS}]+")
    # Words that end before the edit begins count for both sides (2) at once; what follows them counts for one.
    rows = rows.withColumn("common", F.regexp_extract(F.expr("substring(text, 1, n_chars - tail)"), f"(?s)^.*[{SPACE_CLASS}]", 0))
    after = lambda text: F.expr(f"substring({text}, length(common) + 1)")
    sides = [F.struct(F.lit(0).alias("side"), words(after("text")).alias("words")), F.struct(F.lit(1).alias("side"), words(after("edited")).alias("words")), F.struct(F.lit(2).alias("side"), words("common").alias("words"))]
    sides += [F.struct(F.lit(3 + i).alias("side"), F.array(fact.cast("string")).alias("words")) for i, fact in enumerate(facts)]
    parts = rows.select("doc_id", "row", F.inline(F.array(*sides))).select("doc_id", "row", "side", F.explode("words").alias("word"))
    # White space at either end of a text leaves an empty word there; it counts only where there is no other.
    terms = parts.select("doc_id", "row", "side", F.when(F.col("side") >= 3, F.expr("try_cast(word as bigint)")).otherwise(F.xxhash64("word")).alias("term"), (F.col("word") == "").alias("blank"))
    n = lambda *which: F.count_if(F.col("side").isin(*which))
    counts = terms.groupBy("doc_id", "row", F.greatest("side", F.lit(2)).alias("fact"), "term").agg(n(0, 2).alias("one"), n(1, 2).alias("two"), F.bool_or("blank").alias("blank"))
    same = F.col("blank") | (F.col("one") == F.col("two"))
    drawn = F.when(F.col("fact") > 2, F.array(F.struct(F.col("fact").alias("side"), F.lit(0).cast("long").alias("weight")))).when(same, F.array(F.struct(F.lit(2).alias("side"), F.col("one").alias("weight"))))
    drawn = drawn.otherwise(F.array(F.struct(F.lit(0).alias("side"), F.col("one").alias("weight")), F.struct(F.lit(1).alias("side"), F.col("two").alias("weight"))))
    counts = counts.select("doc_id", "row", "term", "blank", F.inline(drawn)).filter("weight > 0 or side > 2")
    counts = counts.withColumn("log_weight", F.when(~F.col("blank") & (F.col("side") <= 2), F.log("weight")))
    least = [F.min(sample_of(F.col("term"), F.col("log_weight"), k, p)).alias(f"s{k}") for k in range(p.count)]
    samples = counts.groupBy("doc_id", "row", "side").agg(F.min("term").alias("term"), *least)
    at = lambda side, column: F.max(F.when(F.col("side") == side, F.col(column)))
    both = lambda side, k: F.min(F.when(F.col("side").isin(side, 2), F.col(f"s{k}"))).alias(f"{'ab'[side]}{k}")
    whole = samples.groupBy("doc_id", "row").agg(*(both(side, k) for side in (0, 1) for k in range(p.count)), *(at(3 + i, "term").alias(f"f{i}") for i in range(len(facts))))
    shown = lambda side: F.concat(*(F.lpad(F.lower(F.hex(F.coalesce(f"{side}{k}", F.lit(0)).bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0") for k in range(p.count)))
    whole = whole.select("doc_id", shown("a").alias("fingerprint"), shown("b").alias("edited_fingerprint"), *(f"f{i}" for i in range(len(facts))))
    sha_back = F.lower(F.concat(*(F.lpad(F.hex(f"f{i}"), 16, "0") for i in range(2, 6))))
    whole = written(whole.select("doc_id", F.col("f0").alias("n_chars"), F.col("f1").alias("next_id"), sha_back.alias("edited_sha256"), "fingerprint", "edited_fingerprint"), "prints")
    after = written(whole.groupBy(F.col("doc_id").alias("key")).agg(F.min("fingerprint").alias("next_fingerprint")), "after")
    out = whole.join(after.hint("merge"), F.col("next_id") == F.col("key"), "left")
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint"), p).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint"), p).alias("near_next"))


def likeness(one: Column, two: Column, p: Samples = Samples()) -> Column:
    """Share of the samples in which two fingerprints agree."""
    equal = [(F.substring(one, 1 + 8 * k, 8) == F.substring(two, 1 + 8 * k, 8)).cast("int") for k in range(p.count)]
    total = equal[0]
    for more in equal[1:]:
        total = total + more
    return total / F.lit(float(p.count))
