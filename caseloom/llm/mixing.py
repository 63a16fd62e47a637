"""Mixing sources to target weights by subset-sum budget fitting.

A source takes whole passes over its documents while they fit its target. For the rest of the budget, documents are
counted by exact length: a proportional share of each length comes first, then one more of each length from the
longest down, and bounded-knapsack dynamic programming fits what is still missing, to the word where that is possible.
Which documents of a length are taken is decided by their seeded hash order. Only (source, length) counts are
gathered, never documents; hash buckets keep a frequent length from becoming one hot task.

Defined results: null and empty texts have size 0 and are taken 0 words; a null source is a source of its own, last in
order. Rows with one doc_id are documents of their own. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ._common import SPACE_CLASS, text_of, written


@dataclass(frozen=True)
class Mix:
    """Weights by source order, repeating; most times a document's size; seed; words fitted by dynamic programming; documents ranked by one task."""

    weights: tuple[float, ...] = (1, 2, 3)
    most: int = 3
    seed: int = 29
    fitted: int = 1 << 16
    bucket: int = 500


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[^{SPACE_CLASS}]+")).cast("long")


def targets(sizes: DataFrame, p: Mix) -> DataFrame:
    """(source, source_size) to the same with target: shares by weight, capped, the excess reshared until none is above.

    Caps are reached in order of cap by weight, so running sums over that order give the final share at once.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, map(float, p.weights))), ((F.row_number().over(order) - 1) % len(p.weights) + 1).cast("int"))
    placed = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * p.most).withColumn("at", F.col("cap") / F.col("weight"))
    by_cap = Window.orderBy("at", F.col("source").isNull(), "source")
    before, rest = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(rest)
    # The first source whose cap holds its share sets the level for all from there on.
    placed = placed.withColumn("level", F.when(level <= F.col("at"), level)).withColumn("level", F.first("level", ignorenulls=True).over(by_cap.rowsBetween(Window.unboundedPreceding, 0)))
    target = F.when(F.col("level").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("level") * F.col("weight"), F.col("cap").cast("double")))
    return placed.select("source", "source_size", target.alias("target"))


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, limit: int) -> np.ndarray:
    """How many of each length (distinct, positive) to take, at most counts, for a sum of at most budget and near it."""
    take = np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    if total <= budget:
        return counts.copy()
    order = np.argsort(-lengths)
    take[:] = [int(c) * budget // total for c in counts]
    left = budget - int((lengths * take).sum())
    for i in order:  # from the longest down, until dynamic programming can fit the rest
        if left <= limit:
            break
        more = min(int(counts[i] - take[i]), (left - limit) // int(lengths[i]) + 1, left // int(lengths[i]))
        take[i] += more
        left -= more * int(lengths[i])
    # Subset sums as bits, binary multiples of each length; the sets reached so far tell the way back.
    reached, steps, every = 1, [], (1 << (left + 1)) - 1
    for i in order[::-1]:
        spare, k = int(counts[i] - take[i]), 1
        while spare and int(lengths[i]) <= left and not reached >> left & 1:
            k = min(k, spare)
            steps.append((i, k, reached))
            reached |= (reached << (k * int(lengths[i]))) & every
            spare, k = spare - k, 2 * k
            if k * int(lengths[i]) > left:
                break
    at = reached.bit_length() - 1
    for i, k, had in reversed(steps):
        if not had >> at & 1:
            take[i] += k
            at -= k * int(lengths[i])
    return take


def mix_sources(docs: DataFrame, p: Mix = Mix()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words, repeats counted) of every document."""
    sized = written(docs.select(F.col("doc_id"), F.col("source"), word_count(text_of("text")).alias("size")).withColumn("h", F.xxhash64(F.lit(p.seed), "doc_id", "size")), "sized")
    lengths = written(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "lengths")
    goal = written(targets(lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), p), "goal")
    passes = F.floor(F.col("target") / F.col("source_size")).cast("long")
    budget = F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long")
    goal_ = goal.withColumn("passes", F.when(F.col("source_size") > 0, passes).otherwise(F.lit(0))).withColumn("budget", budget)
    same = lambda a, b: a["source"].eqNullSafe(b["source"])

    def chosen(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("size")
        take = fit(part["size"].to_numpy(np.int64), part["n"].to_numpy(np.int64), int(part["budget"].iloc[0]), p.fitted)
        return part.assign(take=take)[["source", "size", "n", "take"]]

    source = T._parse_datatype_string(lengths.schema["source"].dataType.simpleString())
    fields = T.StructType([T.StructField("source", source)] + [T.StructField(k, T.LongType()) for k in ("size", "n", "take")])
    counted = lengths.filter("size > 0").alias("l").join(F.broadcast(goal_).alias("g") if goal_.count() <= 100_000 else goal_.alias("g").hint("shuffle_hash"), F.col("l.source").eqNullSafe(F.col("g.source")))
    picks = written(counted.select("l.source", "size", "n", "budget").groupBy("source").applyInPandas(chosen, fields), "picks")

    # Rank by hash inside (source, length), by buckets of the hash: whole buckets come first, one bucket is ranked.
    buckets = F.ceil(F.col("n") / p.bucket)
    dealt = sized.filter("size > 0").alias("d").join(picks.alias("k").hint("merge"), F.col("d.source").eqNullSafe(F.col("k.source")) & (F.col("d.size") == F.col("k.size")))
    dealt = dealt.select("d.doc_id", "d.source", "d.size", "h", "take", F.pmod(F.shiftright("h", 20), buckets).alias("bucket"))
    dealt = written(dealt, "dealt")
    group = Window.partitionBy("source", "size").orderBy("bucket")
    before = dealt.groupBy("source", "size", "bucket").agg(F.count("*").alias("k"), F.first("take").alias("take"))
    before = written(before.select("source", "size", "bucket", (F.col("take") - F.sum("k").over(group) + F.col("k")).alias("room")), "before")
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("h", "doc_id")))
    ranked = ranked.alias("r").join(before.alias("b").hint("merge"), F.col("r.source").eqNullSafe(F.col("b.source")) & (F.col("r.size") == F.col("b.size")) & (F.col("r.bucket") == F.col("b.bucket")))
    extra = ranked.select("doc_id", "r.source", "r.size", (F.col("rank") <= F.col("room")).cast("long").alias("extra"))
    extra = extra.unionByName(sized.filter("size = 0").select("doc_id", "source", "size", F.lit(0).cast("long").alias("extra")))
    out = extra.alias("e").join(F.broadcast(goal_).alias("g") if goal_.count() <= 100_000 else goal_.alias("g").hint("merge"), F.col("e.source").eqNullSafe(F.col("g.source")))
    return out.select("doc_id", F.col("e.source").alias("source"), "size", "source_size", "target", (F.col("size") * (F.col("passes") + F.col("extra"))).alias("taken"))
