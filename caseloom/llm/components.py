"""Connected components of a link table, as joins on written label tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import written


def components(links: DataFrame) -> DataFrame:
    """(a, b) links to (id, component): for each linked id the least id that it can reach.

    Every round lowers each id's label to the least label among its neighbours, then to its label's label, so the
    number of rounds grows with the logarithm of the longest shortest path in practice. A hub with a third of all links is
    no hot task: minima are combined before the shuffle, and both joins read plain written tables, which adaptive
    execution splits where one key is heavy.
    """
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("component"), F.lit(True).alias("changed")), "labels")
    while True:
        low = both.join(labels.hint("merge"), F.col("b") == F.col("id")).groupBy("a").agg(F.min("component").alias("low"))
        labels = written(
            labels.drop("changed").join(low.hint("merge"), F.col("id") == F.col("a")).select("id", F.least("component", "low").alias("component"), (F.col("low") < F.col("component")).alias("changed")),
            "labels",
        )
        if labels.filter("changed").isEmpty():
            return labels.drop("changed")
        target = labels.select(F.col("id").alias("component"), F.col("component").alias("next"))
        labels = written(labels.join(target.hint("merge"), "component").select("id", F.col("next").alias("component"), F.lit(True).alias("changed")), "labels")
