"""Substring deduplication by line hashing.

Lines are normalised (A-Z lower-cased, white space as one space), lines of ``Lines.words`` words or more are hashed, and
digests are grouped over all documents. The occurrence in the earliest document (by doc_id, then line) stays; every
other one is cut, with its offset in the original text retained. With ``Lines.stops`` a line is cut further into
sentences, so that a passage which begins or ends inside a line is found by the sentences that it holds whole.

Defined results: null and empty texts keep their one empty line. Identical rows with one doc_id count as one document. A null doc_id
ranks last. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from hashlib import blake2b
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import SPACE_CLASS, SPACES, bounded_batches, text_of, written


@dataclass(frozen=True)
class Lines:
    """Fewest words of a unit that is compared; what ends a line; the characters that, before white space, end a sentence in it."""

    words: int = 5
    end: str = "\n"
    stops: str = ""


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def lines_of(text: str, p: Lines) -> list[list[str]]:
    """The units of each line; a line is their concatenation."""
    lines = text.split(p.end)
    if not p.stops:
        return [[line] for line in lines]
    stop = re.compile(f"[{re.escape(p.stops)}][{SPACE_CLASS}]+")
    return [[line[a:b] for a, b in zip([0, *at], [*at, len(line)], strict=True)] for line in lines for at in [[m.end() for m in stop.finditer(line)]]]


def unit_batches(batches: Iterator[pa.RecordBatch], p: Lines) -> Iterator[pa.RecordBatch]:
    """(doc_id, h, text) to (doc_id, h, unit, digest) of the units that are compared."""
    for batch in batches:
        rows, units, digests = [], [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            for k, unit in enumerate(chain.from_iterable(lines_of(text, p))):
                words = unit.encode().translate(_LOWER).split()
                if len(words) >= p.words:
                    rows.append(i), units.append(k), digests.append(blake2b(b" ".join(words), digest_size=16).digest())
        at = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("h").take(at), pa.array(units, pa.int32()), pa.array(digests, pa.binary())], ["doc_id", "h", "unit", "digest"])


def cut_batches(batches: Iterator[pa.RecordBatch], p: Lines) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, units) to what is left of each text and what was cut."""
    for batch in batches:
        out: list[tuple] = []
        for text, units in zip(batch.column("text").to_pylist(), batch.column("units").to_pylist(), strict=True):
            gone, left, spans, at, k = set(units or ()), [], [], 0, 0
            for line in lines_of(text, p):
                stays, cuts = [], len(spans)
                for unit in line:
                    if k in gone:
                        spans.append({"start": at, "length": len(unit)})
                    else:
                        stays.append(unit)
                    at, k = at + len(unit), k + 1
                if len(spans) == cuts or "".join(stays).strip(SPACES):  # a line that is cut but for white space goes with its end
                    left.append("".join(stays))
                at += len(p.end)
            out.append((k, spans, p.end.join(left)))
        fields = (pa.int32(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([x[i] for x in out], t) for i, t in enumerate(fields))], ["doc_id", "n_units", "spans", "cleaned"])


def drop_repeated_lines(docs: DataFrame, p: Lines = Lines()) -> DataFrame:
    """doc_id, n_units, spans (start and length in code points of what is cut), cleaned of every document."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", text_of("text").alias("text")).withColumn("h", F.xxhash64("text"))
    units = written(docs.mapInArrow(partial(unit_batches, p=p), f"doc_id {kind}, h long, unit int, digest binary"), "units")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "h", "unit")
    first = written(units.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1"), "first")
    again = units.join(first.hint("merge"), "digest").filter(place != F.col("first"))
    gone = written(again.groupBy("doc_id", "h").agg(F.collect_set("unit").alias("units")), "gone")
    marked = docs.alias("d").join(gone.alias("g").hint("merge"), F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.h") == F.col("g.h")), "left")
    return marked.select("d.doc_id", "text", "units").mapInArrow(partial(cut_batches, p=p), f"doc_id {kind}, n_units int, spans array<struct<start:long,length:long>>, cleaned string")
