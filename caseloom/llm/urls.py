"""URL filters by a blocked Bloom filter over listed canonical URLs, in DataFrame functions only.

A listed entry is a host and the beginning of a path. The keys of a URL are its host's suffixes with those beginnings
of its path that have a listed length. A blocked Bloom filter, one row of eight 32-bit lanes for each block, lets
possible hits pass; an exact hash join with the list removes the false ones, and the longest entry decides.

Defined results: null URLs and those without "://" have an empty host and path; URLs that no entry fits get
``Filter.default``. Of several entries for one host and path the least verdict counts ("allow" before "block"); entries with a null
host, path or verdict are left out. Rows are judged one by one, repeated ones alike, whatever their page_id. A URL of any length is
probed at the listed lengths that it has; their set goes to the driver, bounded by the longest listed path. An empty
table gives no rows, an empty list the default for every page. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import written


@dataclass(frozen=True)
class Filter:
    """Verdict where nothing is listed, bits to an entry, most entries that are broadcast (more are joined by a shuffle whose hot keys can be split)."""

    default: str = "allow"
    bits: int = 16
    most_sent: int = 200_000


_LANES, _LANE_BITS, _MASK = 8, 32, 0x7FFFFFFF


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("block")), F.lit(blocks))


def _lanes(key: Column) -> list[Column]:
    """One bit in each lane of a key's block."""
    bits = F.xxhash64(key, F.lit("lanes"))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(bits, 5 * i).bitwiseAND(F.lit(_LANE_BITS - 1)).cast("int")) for i in range(_LANES)]


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """(key) to one row for each block in use: block, w0 to w7."""
    lanes = keys.select(_block(F.col("key"), blocks).alias("block"), *(x.alias(f"w{i}") for i, x in enumerate(_lanes(F.col("key")))))
    return lanes.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(_LANES)))


def judge(pages: DataFrame, listed: DataFrame, p: Filter = Filter()) -> DataFrame:
    """pages (page_id, url) and listed (host, path, verdict) to page_id, host, path, rule, verdict of every page."""
    listed = listed.dropna(subset=["host", "path", "verdict"])
    entry = listed.select(F.concat("host", "path").alias("rule"), F.length("path").alias("len"), F.concat_ws("\n", "host", "path").alias("key"), F.col("verdict").alias("says"))
    entry = written(entry.groupBy("key").agg(F.min("rule").alias("rule"), F.min("len").alias("len"), F.min("says").alias("says")), "listed")
    size = entry.count()
    lengths = entry.agg(F.sort_array(F.collect_set("len"))).first()[0]
    blocks = max(1, -(-size * p.bits // (_LANES * _LANE_BITS)))
    send = size <= p.most_sent
    near = (lambda df: F.broadcast(df)) if send else (lambda df: df.hint("merge"))

    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = rows.filter("host != ''").select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    known = known.select("host", "path", F.explode(suffixes).alias("suffix"))
    fitting = F.filter(F.lit(lengths).cast("array<int>"), lambda n: n <= F.length("path"))
    starts = F.transform(fitting, lambda n: F.substring(F.col("path"), F.lit(1), n))
    known = known.select("host", "path", "suffix", F.explode(starts).alias("start")).withColumn("key", F.concat_ws("\n", "suffix", "start"))
    words = written(bloom(entry, blocks), "bloom")
    passed = known.withColumn("block", _block(F.col("key"), blocks)).join(near(words), "block")
    test = F.lit(True)
    for i, lane in enumerate(_lanes(F.col("key"))):
        test = test & (F.col(f"w{i}").bitwiseAND(lane) == lane)
    possible = passed.filter(test).select("host", "path", "key")
    hits = possible.join(near(entry), "key")
    longest = hits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "says")).alias("best"))
    longest = written(longest.select("host", "path", "best.rule", "best.says"), "decided")
    out = rows.join(longest.hint("merge"), ["host", "path"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("says", F.lit(p.default)).alias("verdict"))
