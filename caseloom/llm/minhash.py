"""Near-duplicate documents by min-max hashing.

Each permutation of the shingle hashes is evaluated once and gives two signature values, the least and the greatest
hash; both agree between two sets with a probability equal to their Jaccard similarity. Bands of these values name
buckets. Inside a bucket no pairs are formed: members are compared with chosen members of the bucket, and what is
still apart afterwards is compared with the rest, in blocks, the likeliest pairs by their retained signatures first, so that most of the
others are already connected when their turn comes. No estimate decides: every link is confirmed on the full sets.

Defined results: null and empty texts have an empty set, stand alone and are kept. Rows with one doc_id are one
document each, with the same component. A row with a null doc_id has the component of the rows whose set it shares and isn't kept; where none
of these has a doc_id its component is null, it is linked with nothing and kept. A long text is worked on as a whole, in numpy. An
empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches, forget, runs_of, text_of, text_slices, written
from ._words import mix, words_of
from .components import components


@dataclass(frozen=True)
class MinMax:
    """Words to a shingle, least similarity in hundredths, bands, permutations to a band (two values each), seed.

    block: most members of a bucket that one numpy step compares with as many others.
    ids_to_send: most ids that are broadcast to pick texts; beyond it the texts are joined by a shuffle.
    """

    words: int = 5
    percent: int = 80
    bands: int = 20
    perms: int = 3
    seed: int = 17
    block: int = 512
    ids_to_send: int = 1_000_000


def shingles_of(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text with fewer words is one shingle, without words none."""
    words = words_of(data, offsets)
    hashes, first = words.hashes(), words.first
    odd = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    n = len(hashes)
    rolled = np.zeros(max(n - width + 1, 0), np.uint64)
    for k in range(width):
        rolled += hashes[k : n - width + 1 + k] * odd[k] if len(rolled) else np.uint64(0)
    rolled = mix(rolled)
    for lo, hi in zip(first[:-1], first[1:], strict=True):
        if hi - lo >= width:
            part = np.sort(rolled[lo : hi - width + 1])
            yield part[np.concatenate(([True], part[1:] != part[:-1]))]
        elif hi > lo:
            yield mix((hashes[lo:hi] * odd[: hi - lo]).sum(keepdims=True, dtype=np.uint64) + np.uint64(hi - lo))
        else:
            yield rolled[:0]


def signature_batches(batches: Iterator[pa.RecordBatch], p: MinMax) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, n_shingles, set_1, set_2, bands, values): two hashes of the whole set, the bands'
    buckets, and 16 bits of each signature value."""
    rng = np.random.default_rng(p.seed)
    factors, shifts = (rng.integers(0, 1 << 64, p.bands * p.perms, np.uint64) for _ in range(2))
    factors |= np.uint64(1)
    for batch in batches:
        sizes, one, two, bands, values = [], [], [], [], []
        for lo, hi, data, offsets in text_slices(batch.column("text")):
            sets = list(shingles_of(data, offsets, p.words))
            size = np.fromiter(map(len, sets), np.int64, hi - lo)
            every, full = np.concatenate(sets), np.flatnonzero(size)
            got, sums = np.zeros((hi - lo, p.bands), np.uint64), np.zeros((2, hi - lo), np.uint64)
            some = np.zeros((hi - lo, 2 * p.perms * p.bands), np.uint16)
            if len(full):
                at = (np.cumsum(size) - size)[full]
                sums[0, full], sums[1, full] = np.add.reduceat(every, at), np.add.reduceat(mix(every + np.uint64(1)), at)
                for band in range(p.bands):
                    key = np.full(len(full), band + 1, np.uint64)
                    for k in range(band * p.perms, (band + 1) * p.perms):
                        ranks = every * factors[k]
                        ranks += shifts[k]
                        for side, edge in enumerate((np.minimum, np.maximum)):
                            value = edge.reduceat(ranks, at)
                            some[full, 2 * k + side] = mix(value) >> np.uint64(48)
                            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + value)
                    got[full, band] = key
            sizes.append(size), one.append(sums[0]), two.append(sums[1]), bands.append(got), values.append(some)
        if not sizes:
            continue
        flat = np.concatenate(bands)
        keep = np.concatenate(sizes) > 0
        ends = np.concatenate(([0], np.cumsum(keep * p.bands))).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(one).view(np.int64)), pa.array(np.concatenate(two).view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat[keep].reshape(-1).view(np.int64))), pa.array([x.tobytes() for x in np.concatenate(values)], pa.binary())],
            ["doc_id", "n_shingles", "set_1", "set_2", "bands", "values"],
        )


def set_batches(batches: Iterator[pa.RecordBatch], p: MinMax) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, shingles): the full set as sorted 64-bit hashes."""
    for batch in batches:
        sets = [x.tobytes() for _, _, data, offsets in text_slices(batch.column("text")) for x in shingles_of(data, offsets, p.words)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.binary())], ["id", "shingles"])


def similar(x: np.ndarray, y: np.ndarray, p: MinMax) -> bool:
    if 100 * min(len(x), len(y)) < p.percent * max(len(x), len(y)):
        return False
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * shared >= p.percent * (len(x) + len(y) - shared)


def linked_batches(batches: Iterator[pa.RecordBatch], p: MinMax) -> Iterator[pa.RecordBatch]:
    """(a, b, set_a, set_b) to the pairs (a, b) whose full sets are similar enough."""
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        for i, (x, y) in enumerate(zip(batch.column("set_a"), batch.column("set_b"), strict=True)):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            keep[i] = similar(x, y, p)
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _root(parent: dict[int, int], x: int) -> int:
    while parent.setdefault(x, x) != x:
        parent[x] = x = parent[parent[x]]
    return x


def apart_batches(batches: Iterator[pa.RecordBatch], p: MinMax) -> Iterator[pa.RecordBatch]:
    """Blocks (unit, asks, id, component, bucket, bands, values, shingles), sorted by unit, to links (a, b) on full sets.

    The asking rows are compared with every row of their block on their full sets, those whose signatures agree most first.
    Pairs of one component, pairs whose sizes rule a link out, pairs that meet in an earlier band as well, and pairs that
    links found here already connect are left out, so a block gives fewer links than it has components.
    """
    for block in runs_of(batches, "unit"):
        asks = block.column("asks").to_numpy(zero_copy_only=False)
        ids, parts = (block.column(k).to_numpy() for k in ("id", "component"))
        values = np.frombuffer(b"".join(block.column("values").to_pylist()), np.uint16).reshape(len(ids), -1)
        bands = block.column("bands").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        sets = [np.frombuffer(v, np.uint64) for v in block.column("shingles").to_pylist()]
        bucket, (q, t) = block.column("bucket")[0].as_py(), (np.flatnonzero(asks), np.flatnonzero(~asks))
        same = np.zeros((len(q), len(t)), np.uint16)
        for k in range(values.shape[1]):
            same += values[q, k][:, None] == values[t, k][None, :]
        size = np.fromiter(map(len, sets), np.int64, len(sets))
        x, y = size[q][:, None], size[t][None, :]
        possible = 100 * np.minimum(x, y) >= p.percent * np.maximum(x, y)
        possible &= parts[q][:, None] != parts[t][None, :]
        i, j = np.nonzero(possible)
        order = np.argsort(-same[i, j].astype(np.int32), kind="stable")
        i, j = q[i[order]], t[j[order]]
        first = bands[i, np.argmax(bands[i] == bands[j], axis=1)] == bucket if len(i) else np.zeros(0, bool)
        parent: dict[int, int] = {}
        links = []
        for x, y in zip(i[first].tolist(), j[first].tolist(), strict=True):
            one, two = _root(parent, int(parts[x])), _root(parent, int(parts[y]))
            if one != two and similar(sets[x], sets[y], p):
                parent[one] = two
                links.append((int(ids[x]), int(ids[y])))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])


def cards_of(ids: DataFrame, firsts: DataFrame, docs: DataFrame, p: MinMax) -> DataFrame:
    """firsts of the given ids with their full sets, written; a text's set is made once."""
    ids = written(ids, "ids")
    few = ids.count() <= p.ids_to_send
    texts = docs.select(F.col("doc_id").alias("id"), text_of("text").alias("text"))
    texts = texts.join(F.broadcast(ids) if few else ids.hint("merge"), "id", "left_semi").dropDuplicates(["id"])
    sets = written(texts.mapInArrow(partial(set_batches, p=p), "id long, shingles binary"), "sets")
    cards = written(firsts.join(sets.hint("merge"), "id"), "cards")
    forget(ids, sets)
    return cards


def confirmed(pairs: DataFrame, cards: DataFrame, p: MinMax) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough, written. Each pair brings one set to where the other is."""
    right = cards.select(F.col("id").alias("b"), F.col("shingles").alias("set_b"))
    left = cards.select(F.col("id").alias("a"), F.col("shingles").alias("set_a"))
    near = written(pairs, "pairs").join(right.hint("merge"), "b").join(left.hint("merge"), "a").select("a", "b", "set_a", "set_b")
    return written(near.mapInArrow(partial(linked_batches, p=p), "a long, b long"), "confirmed")


def near_duplicates(docs: DataFrame, p: MinMax = MinMax()) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable by links) and kept (it is its component's least)."""
    bounded_batches(docs.sparkSession)
    marks = docs.select(F.col("doc_id").cast("long"), text_of("text").alias("text")).mapInArrow(
        partial(signature_batches, p=p), "doc_id long, n_shingles long, set_1 long, set_2 long, bands array<long>, values binary"
    )
    marks = written(marks, "marks")
    key = ["n_shingles", "set_1", "set_2"]
    full = marks.filter("n_shingles > 0")
    classes = written(full.groupBy(*key).agg(F.min("doc_id").alias("id")), "classes")
    # One row for each different set: its least doc_id stands for all rows with it.
    firsts = full.select(*key, F.col("doc_id").alias("id"), "bands", "values").join(classes.hint("merge"), [*key, "id"], "left_semi").dropDuplicates(["id"])
    firsts = written(firsts.select("id", "n_shingles", "bands", "values"), "firsts")

    members = firsts.select("id", "n_shingles", F.explode("bands").alias("bucket"))
    centres = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min_by(F.struct("id", "n_shingles"), F.xxhash64("id", "bucket")).alias("centre")).filter("n > 1")
    members = written(members.join(written(centres, "centres").hint("merge"), "bucket"), "members")
    pairs = members.filter((F.col("id") != F.col("centre.id")) & (100 * F.least("n_shingles", "centre.n_shingles") >= p.percent * F.greatest("n_shingles", "centre.n_shingles")))
    cards = cards_of(members.select("id").distinct(), firsts, docs, p)
    links = confirmed(pairs.select(F.least("id", "centre.id").alias("a"), F.greatest("id", "centre.id").alias("b")).distinct(), cards, p)
    parts = components(links)

    # Buckets that still hold several components: all but their largest one ask every member of another component.
    placed_ = written(members.select("bucket", "n", "id").join(parts.hint("merge"), "id", "left").select("bucket", "n", "id", F.coalesce("component", "id").alias("component")), "placed")
    counts = placed_.groupBy("bucket", "component").agg(F.count("*").alias("k"))
    mixed = written(counts.groupBy("bucket").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.count("*").alias("parts")).filter("parts > 1"), "mixed")
    placed = placed_.join(mixed.hint("merge"), "bucket").withColumn("blocks", F.ceil(F.col("n") / p.block)).withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    asking = placed.filter("component != main").select("*", every.alias("other")).select("bucket", "id", "component", F.col("block").alias("x"), F.col("other").alias("y"), F.lit(True).alias("asks"))
    asked = placed.select("*", every.alias("other")).select("bucket", "id", "component", F.col("other").alias("x"), F.col("block").alias("y"), F.lit(False).alias("asks"))
    units = written(asking.unionByName(asked), "units")
    held = units.join(cards.hint("merge"), "id").withColumn("unit", F.concat_ws(".", "bucket", "x", "y"))
    held = held.select("unit", "asks", "id", "component", "bucket", "bands", "values", "shingles")
    more = held.repartition("unit").sortWithinPartitions("unit").mapInArrow(partial(apart_batches, p=p), "a long, b long")
    more = written(more, "more")
    if not more.isEmpty():
        parts = components(links.unionByName(more))

    forget(members, cards, placed_, mixed, units)
    heads = classes.join(parts.hint("merge"), "id", "left").select(*key, F.coalesce("component", "id").alias("component_id"))
    out = marks.select("doc_id", *key).join(written(heads, "heads").hint("merge"), key, "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
