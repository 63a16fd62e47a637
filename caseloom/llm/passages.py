"""Substring deduplication by hashing short paragraphs.

A paragraph is a fixed number of words (``Passages.words``) that begins where a line, a sentence or a clause begins. Its
words are normalised (A-Z lower-cased, white space as one space) and hashed to 128 bits; digests are grouped over all
documents. The occurrence in the earliest document (by doc_id, then place) stays; every other one is cut, with its offset in
the original text retained. Paragraphs overlap, so a repeated passage is cut from its first clause on, wherever it stands in
a line: what may be left are the words before that clause and fewer words at the end than the last clause has.

Defined results: a cut reaches from a word to the next word that stays, or to the end of the text. Of a paragraph that
overlaps its own earlier occurrence (a word said a thousand times) only what lies beyond that occurrence is cut. Null and empty texts and those
with fewer words than a paragraph keep all they have. Identical rows with one doc_id count as one document. A null doc_id
ranks last. A text is worked on as a whole, in numpy, however long it is. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches, forget, text_of, text_slices, written
from ._words import Words, mix, words_of


@dataclass(frozen=True)
class Passages:
    """Words to a paragraph; the characters that end a clause or sentence as a word's last one; what ends a line."""

    words: int = 30
    stops: str = ".!?,;:|"
    end: str = "\n"


_STEP = (0x9E3779B97F4A7C15 | 1, 0xD1B54A32D192ED03 | 1)


def begins_of(data: np.ndarray, words: Words, p: Passages) -> np.ndarray:
    """Numbers of the words at which a paragraph begins: those that follow a stop or a line's end, with enough words after them in their text."""
    n = len(words.starts)
    begins = np.zeros(n, bool)
    if not n:
        return np.zeros(0, np.int64)
    stop, line = (np.isin(np.arange(256), list(s.encode())) for s in (p.stops, p.end))
    begins[1:] = stop[data[words.ends[:-1] - 1]]
    ends = np.append(0, np.cumsum(line[data]))
    begins[1:] |= ends[words.starts[1:]] > ends[words.ends[:-1]]
    begins[words.first[:-1][words.first[:-1] < n]] = True
    last = np.repeat(words.first[1:], words.first[1:] - words.first[:-1])
    return np.flatnonzero(begins & (np.arange(n) + p.words <= last))


def digests_of(words: Words, begins: np.ndarray, p: Passages) -> list[np.ndarray]:
    """Two 64-bit hashes of each paragraph, by its words' hashes and their order."""
    hashes, out = words.hashes(), []
    for k, step in enumerate(_STEP):
        total, power = np.zeros(len(begins), np.uint64), np.uint64(step)
        own = mix(hashes + np.uint64(k))
        for j in range(p.words):
            total = total * power + own[begins + j]
        out.append(mix(total).view(np.int64))
    return out


def paragraph_batches(batches: Iterator[pa.RecordBatch], p: Passages) -> Iterator[pa.RecordBatch]:
    """(doc_id, h, text) to (doc_id, h, at, d1, d2): each paragraph with the number of its first word in its text."""
    for batch in batches:
        for lo, _, data, offsets in text_slices(batch.column("text")):
            words = words_of(data, offsets)
            begins = begins_of(data, words, p)
            row = np.searchsorted(words.first, begins, "right") - 1
            at = pa.array(lo + row)
            d1, d2 = digests_of(words, begins, p)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("h").take(at), pa.array((begins - words.first[row]).astype(np.int32)), pa.array(d1), pa.array(d2)], ["doc_id", "h", "at", "d1", "d2"])


def _runs(parts: list[dict]) -> list[tuple[int, int]]:
    """Word ranges that overlap or touch as one, in order."""
    out: list[list[int]] = []
    for lo, hi in sorted((x["lo"], x["hi"]) for x in parts):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


def cut_batches(batches: Iterator[pa.RecordBatch], p: Passages) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, parts) to what is left of each text and what was cut; parts: ranges of words to cut."""
    for batch in batches:
        parts = batch.column("parts").to_pylist()
        units, spans, left = [], [], []
        for lo, hi, data, offsets in text_slices(batch.column("text")):
            words = words_of(data, offsets)
            begins = begins_of(data, words, p)
            units.extend(np.diff(np.searchsorted(begins, words.first)).tolist())
            for i in range(hi - lo):
                a, b = offsets[i], offsets[i + 1]
                if not parts[lo + i]:
                    spans.append([]), left.append(data[a:b].tobytes().decode())
                    continue
                starts = np.append(words.starts[words.first[i] : words.first[i + 1]], b)
                own, keep, at = [], [], a
                for first, stop in _runs(parts[lo + i]):
                    x, y = starts[first], starts[stop]
                    keep.append(data[at:x].tobytes().decode())
                    begin = sum(map(len, keep)) + sum(s["length"] for s in own)
                    own.append({"start": begin, "length": len(data[x:y].tobytes().decode())})
                    at = y
                keep.append(data[at:b].tobytes().decode())
                spans.append(own), left.append("".join(keep))
        fields = (pa.int32(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, t) for x, t in zip((units, spans, left), fields, strict=True))], ["doc_id", "n_units", "spans", "cleaned"])


def drop_repeated_passages(docs: DataFrame, p: Passages = Passages()) -> DataFrame:
    """doc_id, n_units (paragraphs compared), spans (start and length in code points of what is cut), cleaned of every document."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", text_of("text").alias("text")).withColumn("h", F.xxhash64("text"))
    units = written(docs.mapInArrow(partial(paragraph_batches, p=p), f"doc_id {kind}, h long, at int, d1 long, d2 long"), "paragraphs")
    # Half a digest, counted before anything else moves, leaves out what stands once.
    often = written(units.groupBy("d1").agg(F.count("*").alias("n")).filter("n > 1").select("d1"), "often")
    again = written(units.join(often.hint("merge"), "d1"), "repeated")
    forget(units, often)
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "h", "at")
    first = written(again.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "first")
    later = again.join(first.hint("merge"), ["d1", "d2"]).filter(place != F.col("first"))
    own = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("h") == F.col("first.h"))
    part = F.struct(F.when(own, F.greatest("at", F.col("first.at") + p.words)).otherwise(F.col("at")).alias("lo"), (F.col("at") + p.words).alias("hi"))
    gone = written(later.select("doc_id", "h", part.alias("part")).groupBy("doc_id", "h").agg(F.collect_set("part").alias("parts")), "gone")
    forget(again, first)
    marked = docs.alias("d").join(gone.alias("g").hint("merge"), F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.h") == F.col("g.h")), "left")
    return marked.select("d.doc_id", "text", "parts").mapInArrow(partial(cut_batches, p=p), f"doc_id {kind}, n_units int, spans array<struct<start:long,length:long>>, cleaned string")
