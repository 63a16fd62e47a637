"""Audits of tables: any number of checks of rows and of counts, gathered by Spark while the table is written.

Checks become one set of observed aggregates on the rows on their way to the file, so a table is read once and written once, whatever
the number of checks. What a check needs from other rows, or other tables (how often a key occurs, what a manifest lists), are columns
that are joined before.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RESULTS = "scope string, check_name string, n long, least long, most long, passed boolean"


@dataclass(frozen=True)
class Check:
    """The rows for which ``where`` holds (a null doesn't) are ``least`` to ``most`` in number; None: no bound."""

    name: str
    where: Column
    least: int | None = None
    most: int | None = None


def never(name: str, where: Column) -> Check:
    """No row has this."""
    return Check(name, where, most=0)


def always(name: str, holds: Column) -> Check:
    """Every row has this: those without it, or for which it is null, are counted."""
    return Check(name, ~F.coalesce(holds, F.lit(False)), most=0)


def exactly(name: str, n: int, where: Column | None = None) -> Check:
    return Check(name, F.lit(True) if where is None else where, n, n)


def at_least(name: str, n: int, where: Column | None = None) -> Check:
    return Check(name, F.lit(True) if where is None else where, least=n)


def occurrences(rows: DataFrame, *key: str, out: str = "n_alike") -> DataFrame:
    """rows with how many rows have their key, so that a check can ask for single ones."""
    return rows.withColumn(out, F.count(F.lit(1)).over(Window.partitionBy(*key)))


def against_manifest(rows: DataFrame, manifest: DataFrame, key: str, digest: str) -> DataFrame:
    """rows and the manifest's (key, digest), each with or without the other: columns on_disk, listed, digest_listed."""
    given = manifest.select(F.col(key).alias("_key"), F.col(digest).alias("digest_listed"), F.lit(True).alias("listed"))
    both = rows.withColumn("on_disk", F.lit(True)).join(given.hint("merge"), F.col(key).eqNullSafe(F.col("_key")), "full")
    return both.withColumns({key: F.coalesce(key, "_key"), "on_disk": F.coalesce("on_disk", F.lit(False)), "listed": F.coalesce("listed", F.lit(False))}).drop("_key")


def write_audited(rows: DataFrame, path: str, scope: str, checks: Sequence[Check], mode: str = "errorifexists", **options: str) -> list[tuple]:
    """Write rows as Parquet, and give (scope, check_name, n, least, most, passed) of each check: one scan, one job.

    The write stands whatever the checks say: who asks decides what becomes of it.
    """
    if len({c.name for c in checks}) < len(checks):
        raise ValueError("checks of one name")
    seen = Observation()
    counted = [F.coalesce(F.count_if(c.where), F.lit(0)).alias(f"c{i}") for i, c in enumerate(checks)]
    rows.observe(seen, *counted, F.count(F.lit(1)).alias("rows")).write.mode(mode).options(**options).parquet(path)
    got = seen.get
    out = []
    for i, c in enumerate(checks):
        n = got[f"c{i}"]
        out.append((scope, c.name, n, c.least, c.most, (c.least is None or n >= c.least) and (c.most is None or n <= c.most)))
    return out


def report(spark: SparkSession, results: Sequence[tuple]) -> DataFrame:
    """Results of ``write_audited`` as a table: a row for each check."""
    return spark.createDataFrame(list(results), RESULTS)


def gate(results: DataFrame) -> DataFrame:
    """(scope, n_checks, n_failed, passed) of each scope."""
    failed = F.count_if(~F.col("passed"))
    return results.groupBy("scope").agg(F.count("*").alias("n_checks"), failed.alias("n_failed"), (failed == 0).alias("passed"))
