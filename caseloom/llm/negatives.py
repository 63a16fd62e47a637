"""Hard negatives of anchors by Fagin's threshold algorithm, block by block.

Rows become integer vectors and are packed into *blocks* of one label. A block keeps its vectors and, for every dimension, its rows sorted by
that entry. An anchor meets a block so:

1. Sorted access: from every dimension's list, from the top where the anchor's entry is positive, from the bottom where it is negative, the next
   rows are taken; lists of dimensions where the anchor is 0 are left alone.
2. Random access: rows seen for the first time are scored whole, by integer inner product.
3. The threshold is the score of the rows at which the lists stand: no unseen row has more. Once it lies strictly below the kth score of each window (or
   the window's lower end, while it has fewer than k), the block is done. A task carries the best rows of an anchor from block to block, so later
   blocks end sooner, many before the first access.

First the same-label blocks give each anchor its positives, then the other blocks its negatives, one window for each positive. Anchors are packed into groups of one
label; groups are copied to ``spread`` parts, over which the blocks are dealt, and joined with the blocks of each: blocks are never
copied, no table is broadcast. A join's row is a group and a block. Tasks give at most k rows for each window and block; Spark ranks these.

Work is anchors times rows at worst, as each anchor asks against all rows; with many dimensions and little structure the threshold
falls late and most rows are scored.

Defined results: rows with a null label, a null vector or an entry that is null or not finite take no part; nor do vectors whose length isn't the most common one
(the longer of two equally common), or whose squared length doesn't fit a long, so that every score fits. An id may be null (never an anchor; last among
equal scores) or repeated: "other rows" are told apart as rows, equal scores and ids come in the order of their rows, and anchors with one id and one
vector are one anchor less itself each. Fewer rows than asked for are returned as they are. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import bounded_batches, forget, written
from ._vectors import LONG_LIMIT, from_bytes, integers, matrix, to_bytes, usable

_NO_ID = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Mine:
    positives: int = 5
    negatives: int = 10
    low: int = 30  #: low * positive score <= whole * negative score
    high: int = 90  #: whole * negative score <= high * positive score
    whole: int = 100
    block: int = 4096  #: rows to a block
    group: int = 512  #: anchors to a group
    part: int = 64  #: blocks to a part
    parts: int = 32  #: parts at least, unless there are fewer blocks
    depth: int = 24  #: rows that the first sorted access takes from each list; each later one goes four times as deep


_BLOCK = "label long, block long, ids binary, rows binary, data binary, width int, lists binary"
_GROUP = "label long, group long, ids binary, rows binary, data binary, width int, marks binary"


def _packed(rows: DataFrame, dims: int, most: int, lists: bool) -> DataFrame:
    """Rows (label, id, row, x, marks), with those of a label together, as blocks of one label."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def block() -> pa.RecordBatch:
            got = pa.concat_tables(held)
            ids = got["id"].fill_null(_NO_ID).to_numpy()
            row = got["row"].to_numpy()
            order = np.lexsort((row, ids))  # a place in the block is a row's rank among equal scores
            x = matrix(got["x"].combine_chunks(), dims)[order]
            data, width = to_bytes(x)
            last = np.argsort(x, axis=0, kind="stable").T.astype("<i2").tobytes() if lists else b"".join(np.array(m, "<i8").tobytes() for m in got["marks"].take(pa.array(order)).to_pylist())
            number = int(row.min())  # rows are numbered once, so this is a block's own
            cells = [got["label"][0].as_py(), number, ids[order].astype("<i8").tobytes(), row[order].astype("<i8").tobytes(), data, width, last]
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, kinds, strict=True)], names=(_BLOCK if lists else _GROUP).replace(",", "").split()[::2])

        for batch in batches:
            rest = pa.Table.from_batches([batch])
            while rest.num_rows:
                label = rest["label"].to_numpy()
                same = int(np.searchsorted(label != label[0], True))  # sorted by label within a task
                if held and held[0]["label"][0].as_py() != label[0]:
                    yield block()
                    held = []
                room = min(same, most - sum(h.num_rows for h in held))
                held.append(rest.slice(0, room))
                rest = rest.slice(room)
                if sum(h.num_rows for h in held) == most:
                    yield block()
                    held = []
        if held:
            yield block()

    return rows.select("label", "id", "row", "x", "marks").mapInArrow(pack, _BLOCK if lists else _GROUP)


class Block:
    """A block's vectors and its rows sorted by each dimension."""

    def __init__(self, ids: bytes, rows: bytes, data: bytes, width: int, lists: bytes, dims: int):
        self.ids, self.rows = np.frombuffer(ids, "<i8"), np.frombuffer(rows, "<i8")
        self.x = from_bytes(data, width, dims)
        self.most = int(np.abs(self.x).max(initial=0))
        self.real = self.x.astype(float)
        self.lists = np.frombuffer(lists, "<i2").reshape(dims, -1)
        self.sorted = np.take_along_axis(self.x.T, self.lists.astype(np.int64), 1)

    def scores(self, at: np.ndarray, anchor: np.ndarray, exact: bool) -> np.ndarray:
        """Integer inner products; doubles hold them exactly where ``exact``, else they are taken modulo 2^64, in which each fits."""
        return (self.real[at] @ anchor.astype(float)).astype(np.int64) if exact else self.x[at] @ anchor

    def search(self, anchor: np.ndarray, row: int, windows: list[tuple[int, int]], known: list[np.ndarray], k: int, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window (least, most score) the (scores, places) of this block's rows that may be among the best k; known: the scores of rows that count already, falling."""
        n, used = len(self.rows), np.flatnonzero(anchor)
        signed = anchor[used]
        exact = len(anchor) * self.most * int(np.abs(anchor).max(initial=0)) < 1 << 53
        lists = [self.lists[d, ::-1] if a > 0 else self.lists[d] for d, a in zip(used, signed, strict=True)]
        seen = self.rows == row  # the anchor itself is never a candidate
        places, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = [(scores, places)] * len(windows)
        at = 0
        while True:
            if len(used):
                stand = np.where(signed > 0, self.sorted[used, n - 1 - min(at, n - 1)], self.sorted[used, min(at, n - 1)])
                threshold = sum(int(a) * int(b) for a, b in zip(signed, stand, strict=True)) if at < n else None
            else:
                threshold = 0 if at < n else None
            done = True
            for (least, _), (mine, _), other in zip(windows, found, known, strict=True):
                best = np.sort(np.concatenate((mine, other)))[::-1]
                bound = int(best[k - 1]) if len(best) >= k else least
                done &= threshold is None or threshold < bound
            if done:
                return found
            upto = min(n, depth if not at else at * 4)
            if len(used):
                fresh = np.zeros(n, bool)
                for one in lists:
                    fresh[one[at:upto]] = True
                fresh &= ~seen
                new = np.flatnonzero(fresh)
            else:  # an anchor of zeros: all scores are 0
                new = np.flatnonzero(~seen)
                upto = n
            seen[new] = True
            places = np.concatenate((places, new))
            scores = np.concatenate((scores, self.scores(new, anchor, exact)))
            order = np.lexsort((places, -scores))
            places, scores = places[order], scores[order]
            for i, (least, most) in enumerate(windows):
                first = int(np.searchsorted(-scores, -most))
                last = min(first + k, int(np.searchsorted(-scores, -least, "right")))
                found[i] = (scores[first:last], places[first:last])
            at = upto


def _searched(pairs: DataFrame, dims: int, how: Mine, k: int, windowed: bool) -> DataFrame:
    """(anchor, mark, id, row, score): what each group's anchors find in each block beside it; mark: the window's number, 0 if there is one for all."""

    def windows_of(marks: np.ndarray) -> list[tuple[int, int]]:
        if not windowed:
            return [(-_NO_ID, _NO_ID)]
        return [(-(-how.low * p // how.whole), how.high * p // how.whole) for p in map(int, marks)]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, best, blocks = None, {}, {}
        for batch in batches:
            out: list[list[np.ndarray]] = []
            for i in range(batch.num_rows):
                cell = {name: batch.column(name)[i].as_py() for name in ("group", "g_ids", "g_rows", "g_data", "g_width", "marks", "block")}
                if cell["group"] != group:
                    group, best = cell["group"], {}
                    anchors = from_bytes(cell["g_data"], cell["g_width"], dims)
                    rows = np.frombuffer(cell["g_rows"], "<i8")
                    marks = np.frombuffer(cell["marks"], "<i8").reshape(len(rows), -1)
                if (block := blocks.get(cell["block"])) is None:
                    if len(blocks) == 2:
                        blocks.clear()
                    block = blocks[cell["block"]] = Block(*(batch.column(name)[i].as_py() for name in ("ids", "rows", "data", "width", "lists")), dims)
                for a in range(len(rows)):
                    count = int(marks[a, 0]) if windowed else 1
                    windows = windows_of(marks[a, 1 : 1 + count])
                    open_ = [w for w in range(count) if windows[w][0] <= windows[w][1]]
                    if not open_:
                        continue
                    known = [best.get((a, w), np.zeros(0, np.int64)) for w in open_]
                    got = block.search(anchors[a], int(rows[a]), [windows[w] for w in open_], known, k, how.depth)
                    for w, old, (scores, places) in zip(open_, known, got, strict=True):
                        if not len(scores):
                            continue
                        if len(old) >= k:
                            keep = scores >= old[k - 1]
                            scores, places = scores[keep], places[keep]
                        if len(scores):
                            best[a, w] = np.sort(np.concatenate((old, scores)))[::-1][:k]
                            out.append([np.full(len(scores), rows[a]), np.full(len(scores), w), block.ids[places], block.rows[places], scores])
            if out:
                columns = [np.concatenate(c) for c in zip(*out, strict=True)]
                ids = pa.array(columns[2], mask=columns[2] == _NO_ID)
                yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1].astype(np.int32)), ids, pa.array(columns[3]), pa.array(columns[4])], names=["anchor", "mark", "id", "row", "score"])

    return pairs.mapInArrow(search, "anchor long, mark int, id long, row long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "mark").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(table: DataFrame, anchor: Column, label: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", how: Mine = Mine()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): see the module.

    anchor: which rows ask, and label: a row's label if it isn't ``label_col`` itself; both of the columns "id" and "label".
    """
    spark = table.sparkSession
    bounded_batches(spark)
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("vector"))
    rows = rows.filter(F.col("label").isNotNull() & usable(F.col("vector"))).withColumn("label", label if label is not None else F.col("label")).filter("label is not null")
    rows = rows.select("id", F.col("label").cast("long").alias("label"), integers(F.col("vector")).alias("x"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows.filter(F.aggregate("x", F.lit(0.0), lambda total, c: total + c.cast("double") * c.cast("double")) < LONG_LIMIT), "vectors")
    lengths = rows.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).limit(1).collect()
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not lengths:
        forget(rows)
        return spark.createDataFrame([], result)
    dims = lengths[0].dims
    same = rows.filter(F.size("x") == dims)
    count = lengths[0]["count"]
    tasks = max(1, -(-count // (4 * how.block)))
    none = F.array().cast("array<long>").alias("marks")
    ranged = same.select("label", "id", "row", "x", none).repartitionByRange(tasks, "label", F.xxhash64("row")).sortWithinPartitions("label")
    stored = written(_packed(ranged, dims, how.block, True), "blocks")
    n_blocks = stored.count()
    parts = min(n_blocks, max(how.parts, -(-n_blocks // how.part)))
    blocks = stored.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(parts)))

    def asked(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Anchors packed into groups, a copy for each part; and the written groups."""
        spread = marked.repartitionByRange(max(1, -(-count // (100 * how.group))), "label", F.xxhash64("row")).sortWithinPartitions("label")
        groups = written(_packed(spread, dims, how.group, False), "anchors")
        renamed = groups.select(F.col("label").alias("g_label"), "group", F.col("ids").alias("g_ids"), F.col("rows").alias("g_rows"), F.col("data").alias("g_data"), F.col("width").alias("g_width"), "marks")
        return renamed.withColumn("g_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<long>"))), groups

    anchors = same.filter(F.coalesce(anchor, F.lit(False)))
    groups, first = asked(anchors.withColumn("marks", none))
    on_part = F.col("part") == F.col("g_part")
    near = groups.join(blocks.hint("merge"), on_part & (F.col("label") == F.col("g_label")))
    positives = written(_best(_searched(near, dims, how, how.positives, False), how.positives).select("anchor", "rank", "id", "score"), "positives")

    # an anchor's marks: how many positives it has and their scores, filled up, so that all have one length
    scores = positives.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("all"))
    filled = F.concat(F.array(F.size("all").cast("long")), F.col("all.score"), F.array_repeat(F.lit(0).cast("long"), F.lit(how.positives) - F.size("all"))).alias("marks")
    marked = anchors.join(scores.hint("merge"), F.col("row") == F.col("anchor")).select("label", "id", "row", "x", filled)
    groups, second = asked(marked)
    # dealt out by number, as pairs are few and small but take long: they aren't to be coalesced by their bytes
    far = groups.repartition(parts, "g_part").join(blocks.repartition(parts, "part").hint("merge"), on_part & (F.col("label") != F.col("g_label")))
    negatives = written(_best(_searched(far, dims, how, how.negatives, True), how.negatives).select("anchor", "mark", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), "negatives")
    forget(first, second, stored)

    asking = anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    pairs = asking.join(positives.select("anchor", (F.col("rank") - 1).alias("mark"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).hint("merge"), "anchor")
    return pairs.join(negatives.hint("merge"), ["anchor", "mark"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
