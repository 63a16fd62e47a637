"""Best-fit packing of token sequences by hierarchical residual packing.

Each task tokenises its documents and packs their pieces best-fit, longest first. Nearly full bins are final. The
others become items of the next round, in which the bins of several tasks meet and are packed best-fit again, until
one group is left. Only lengths and places travel; a bin's pieces learn their place by one join at the end.

Where more underfull bins are left than one task may hold (``Packing.window``), a round deals them to several groups by hash, and those of the
last round never meet: each such group may leave its own underfull bins, at most a few to a group of 100,000 bins.

Defined results: null and empty texts are one piece, the end token. Rows with one doc_id, or none, are packed as documents of
their own. A long text is encoded as a whole and cut by tokens. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bpe import Encoder
from ._common import bounded_batches, text_of, written


@dataclass(frozen=True)
class Packing:
    """Tokenizer file, end token, tokens to a sequence, tokens that a final bin may lack, pieces packed at once, tasks that meet."""

    tokenizer: str
    end_id: int = 2
    size: int = 1024
    slack: int = 8
    window: int = 100_000
    fan_in: int = 8


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit decreasing: each item's bin, numbered from 0, and its place in the bin."""
    bins, places = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    some, made = 0, 0  # some: bit r is set if a bin has r tokens left
    order = np.argsort(-sizes, kind="stable")
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fits = some >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            b = free[left].pop()
            if not free[left]:
                some ^= 1 << left
        else:
            left, b, made = capacity, made, made + 1
        bins[i], places[i] = b, capacity - left
        if left > size:
            free[left - size].append(b)
            some |= 1 << (left - size)
    return bins, places


def cut(length: int, size: int) -> list[int]:
    """Piece lengths of a document: full ones, after a shorter first one."""
    return [length] if length <= size else [length % size] * (length % size > 0) + [size] * (length // size)


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long"


def piece_batches(batches: Iterator[pa.RecordBatch], p: Packing) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to pieces, packed among themselves; a bin's number holds its task's in the upper bits."""
    encoder, base = Encoder(p.tokenizer), TaskContext.get().partitionId() << 36
    held: list[tuple] = []

    def packed() -> pa.RecordBatch:
        nonlocal base, held
        doc, piece, start, length, crc = zip(*held, strict=True)
        sizes = np.array(length, np.int64)
        bins, places = best_fit(sizes, p.size)
        fill = np.bincount(bins, sizes).astype(np.int64)
        out = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(sizes), pa.array(crc, pa.int64()), pa.array(base + bins), pa.array(places), pa.array(fill[bins])]
        base, held = base + len(fill), []
        return pa.RecordBatch.from_arrays(out, [x.split()[0] for x in _PIECES.split(", ")])

    end = np.array([p.end_id], "<u4")
    for batch in batches:
        docs = batch.column("doc_id").to_pylist()
        for lo, hi, ids, ends in encoder.encode(batch.column("text")):
            begin = 0
            for doc, stop in zip(docs[lo:hi], ends.tolist(), strict=True):
                own, at = np.concatenate((ids[begin:stop].astype("<u4"), end)), 0
                for k, n in enumerate(cut(len(own), p.size)):
                    held.append((doc, k, at, n, zlib.crc32(own[at : at + n])))
                    at += n
                begin = stop
            if len(held) >= p.window:
                yield packed()
    if held:
        yield packed()


def merged_bins(part: pd.DataFrame, p: Packing) -> pd.DataFrame:
    """One group of a round: bins (bin, now, base, fill) as items; the same rows with the bin that now holds them."""
    items = part.drop_duplicates("now").sort_values("now")
    bins, places = best_fit(items["fill"].to_numpy(), p.size)
    fill = np.bincount(bins, items["fill"])
    name = np.zeros(len(fill), np.int64)
    name[bins[::-1]] = items["now"].to_numpy()[::-1]
    index = pd.Index(items["now"]).get_indexer(part["now"])
    return pd.DataFrame({"bin": part["bin"], "now": name[bins[index]], "base": part["base"] + places[index], "fill": fill[bins[index]].astype(np.int64), "grp": part["grp"]})


def pack(docs: DataFrame, p: Packing) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    bounded_batches(docs.sparkSession)
    pieces = written(docs.select(F.col("doc_id").cast("long"), text_of("text").alias("text")).mapInArrow(partial(piece_batches, p=p), _PIECES), "pieces")
    is_open = F.col("fill") < p.size - p.slack
    bins = written(pieces.filter(is_open & (F.col("offset") == 0)).select("bin", F.col("bin").alias("now"), F.lit(0).cast("long").alias("base"), "fill", F.shiftright("bin", 36).alias("grp")), "bins")
    done: list[DataFrame] = []
    groups = (bins.agg(F.max("grp")).first()[0] or 0) + 1
    while True:
        groups, count = -(-groups // p.fan_in), bins.count()
        if not count:
            break
        # More bins than a task may hold at once are dealt to several groups of this round.
        salt = max(1, -(-count // (groups * p.window)))
        dealt = bins.withColumn("grp", F.floor(F.col("grp") / p.fan_in)).withColumn("salt", F.pmod(F.xxhash64("now"), F.lit(salt)))
        bins = written(dealt.groupBy("grp", "salt").applyInPandas(lambda part: merged_bins(part, p), "bin long, now long, base long, fill long, grp long"), "bins")
        if groups == 1:
            done.append(bins)
            break
        done.append(bins.filter(~is_open))
        bins = bins.filter(is_open)
    final = pieces.filter(~is_open).withColumn("now", F.col("bin"))
    if done:
        moved = done[0]
        for more in done[1:]:
            moved = moved.unionByName(more)
        opened = pieces.filter(is_open).drop("fill").join(written(moved.select("bin", "now", "base"), "moved").hint("merge"), "bin")
        final = final.drop("fill").unionByName(opened.withColumn("offset", F.col("offset") + F.col("base")).drop("base"))
    return final.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("now").alias("sequence_id"), "offset")
