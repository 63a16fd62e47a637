"""Toxicity by a convolutional text classifier over hashed word embeddings, trained in numpy.

A word is embedded as the sum of the vectors of its hash and of the hashes of its first letters, so unseen words share
what their beginnings have in common. Filters of several widths run over the whole text, each is pooled to its greatest
value, and a linear layer gives a logit. Training starts the first dimension from smoothed log-odds; then all weights
are trained by gradient descent. Logits of documents outside the fold that trained them calibrate a threshold for each
language, which is told from the text's own letters; scores put that threshold at ``Toxicity.reject``.

Everything is learnt from all labelled rows outside the held-out third, whole texts: documents by bucket and label are counted in one pass;
each epoch is a pass in which every task trains three networks (one on all rows, one on each half) on its own rows, and
what they moved is averaged over the tasks that moved it; thresholds come from counts of all rows' logits, in steps of 1 / ``grid``. The driver holds the
networks: at most 2 ** ``bits`` buckets, whatever the corpus. Defined results: null and empty texts are scored from the bias alone; labels that
are null, and repeated ones but the greatest, are ignored; with no usable labels of both kinds every score is 0.1. Extra columns are ignored.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import bounded_batches, forget, text_of, text_slices, written
from ._words import words_of


#: Slots whose moves go together.
MOVES = 8192
#: Such blocks that the driver takes in at once.
BLOCKS = 16
#: Words of 64 bits that mark labelled documents.
MARKS = 1 << 18


@dataclass(frozen=True)
class Toxicity:
    """Sizes of the network, training; reject: the score from which a text counts as toxic.

    most_rows: clean and toxic rows that one task trains on, about; their sum decides how many tasks train. step_words: words to a training step,
    unless a text has more.
    """

    most_rows: tuple[int, int] = (3000, 1500)
    step_words: int = 100_000
    grid: int = 1024
    prefixes: tuple[int, ...] = (3, 4, 5, 6)
    bits: int = 22
    seen: int = 2
    width: int = 8
    filters: int = 8
    spans: tuple[int, ...] = (1, 2, 3)
    epochs: int = 3
    batch: int = 64
    rate: float = 0.02
    seed: int = 5
    reject: float = 0.7


#: Letters by which a text's language is told: UTF-8 pairs (fixed values of the alphabets).
LETTERS = {"de": "äöüß", "es": "ñáíóú", "fr": "éèêçàâîôû"}
LANGUAGES = ("en", *LETTERS)


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learnt from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def languages_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Index into LANGUAGES of each text: the one whose letters are most frequent, English under one in 200 bytes."""
    pairs = data[:-1].astype(np.uint16) << 8 | data[1:] if len(data) > 1 else np.zeros(0, np.uint16)
    votes = [np.zeros(len(offsets) - 1)]
    for letters in LETTERS.values():
        codes = [int.from_bytes(x.encode(), "big") for x in letters]
        total = np.append(0, np.cumsum(np.isin(pairs, codes)))
        votes.append(total[np.minimum(offsets[1:], len(pairs))] - total[np.minimum(offsets[:-1], len(pairs))])
    votes[0] = (offsets[1:] - offsets[:-1]) / 200
    return np.argmax(votes, axis=0)


def features_of(data: np.ndarray, offsets: np.ndarray, p: Toxicity) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (words x features) of all words, and where each text's words begin."""
    words = words_of(data, offsets)
    top = np.uint64(64 - p.bits)
    columns = [words.hashes() >> top] + [(words.hashes(k) + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15) >> top for k in p.prefixes]
    return np.stack(columns, 1).astype(np.int32) if len(words.starts) else np.zeros((0, 1 + len(p.prefixes)), np.int32), words.first


class Network:
    """Embedding rows of the buckets seen in training (row 0: all others), filters and a linear layer."""

    def __init__(self, buckets: np.ndarray, clean: np.ndarray, toxic: np.ndarray, n0: int, n1: int, p: Toxicity):
        """buckets: of rows 1 and on; clean, toxic: documents in which each stands, of n0 and n1."""
        self.p, self.buckets, rng = p, buckets, np.random.default_rng(p.seed)
        odds = np.log((toxic + 0.5) / (n1 + 1)) - np.log((clean + 0.5) / (n0 + 1))
        self.embed = np.empty((len(clean) + 1, p.width), np.float32)
        for lo in range(0, len(self.embed), MOVES):  # in parts, as doubles take twice the room
            part = self.embed[lo : lo + MOVES]
            part[:] = rng.normal(0, 0.05, part.shape)
        self.embed[0] = 0
        # Beginnings with few documents say little: their log-odds shrink.
        self.embed[1:, 0] = odds * (clean + toxic) / (clean + toxic + 4) / (1 + len(p.prefixes))
        self.embed[1:][clean + toxic == 0] = 0
        self.conv = [rng.normal(0, 0.3, (k, p.width, p.filters)).astype(np.float32) for k in p.spans]
        for k, w in zip(p.spans, self.conv, strict=True):
            w[:, :, 0] = 0
            w[:, 0, 0] = 1 / k
        self.out = rng.normal(0, 0.05, len(p.spans) * p.filters).astype(np.float32)
        self.out[:: p.filters] = 1.0 / len(p.spans)
        self.bias = np.float32(np.log(max(n1, 1) / max(n0, 1)) - 2)
        self.toxic_weight = min(4.0, max(1.0, n0 / max(n1, 1)))

    @cached_property
    def row(self) -> np.ndarray:
        """The row of each bucket."""
        rows = np.zeros(1 << self.p.bits, np.int32)
        rows[self.buckets] = np.arange(1, len(self.buckets) + 1)
        return rows

    def __getstate__(self) -> dict:
        """What is sent: not the table of rows, which is made again."""
        return {k: v for k, v in self.__dict__.items() if k != "row"}

    def dense(self) -> np.ndarray:
        """All parameters but the embedding, in rows of ``width`` with zeros at the end."""
        flat = np.concatenate([*(w.ravel() for w in self.conv), self.out, [self.bias]])
        return np.append(flat, np.zeros(-len(flat) % self.p.width)).reshape(-1, self.p.width)

    def move(self, slots: np.ndarray, by: np.ndarray) -> None:
        """Add to rows of the embedding (slots from 0) and of ``dense`` (-1 and below)."""
        own = slots >= 0
        self.embed[slots[own]] += by[own].astype(np.float32)
        flat = self.dense()
        flat[-1 - slots[~own]] += by[~own]
        flat, at = flat.ravel().astype(np.float32), 0
        for w in (*self.conv, self.out):
            w[:] = flat[at : at + w.size].reshape(w.shape)
            at += w.size
        self.bias = flat[at]

    def _values(self, buckets: np.ndarray, first: np.ndarray):
        """Embedding rows and vectors of all words, each text followed by blanks, filter values (filters x words), text starts.

        Blanks have the vector 0, so no filter sees two texts, and a pooled value is 0 at least.
        """
        blank, texts = max(self.p.spans) - 1, len(first) - 1
        place = np.arange(first[-1]) + blank * np.repeat(np.arange(texts), first[1:] - first[:-1])
        starts = first[:-1] + blank * np.arange(texts)
        rows = np.zeros((first[-1] + blank * texts + blank, buckets.shape[1]), np.int32)
        rows[place] = self.row[buckets]
        words = self.embed[rows[:, 0]]
        for k in range(1, rows.shape[1]):
            words += self.embed[rows[:, k]]
        across = np.ascontiguousarray(words.T)
        got = []
        for k, w in zip(self.p.spans, self.conv, strict=True):
            value = w[0].T @ across
            for j in range(1, k):
                value[:, :-j] += w[j].T @ across[:, j:]
            got.append(value)
        return rows, words, got, starts

    def logits(self, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
        _, _, got, starts = self._values(buckets, first)
        return np.concatenate([np.maximum.reduceat(v[:, : len(v[0]) - max(self.p.spans) + 1], starts, axis=1) for v in got]).T @ self.out + self.bias

    def step(self, docs: list[np.ndarray], y: np.ndarray, rate: float) -> np.ndarray:
        """A step of gradient descent on documents with their labels; the embedding's rows that it moved."""
        p = self.p
        first = np.append(0, np.cumsum([len(doc) for doc in docs]))
        rows, words, got, starts = self._values(np.concatenate(docs), first)
        stops = np.append(starts[1:], len(words) - max(p.spans) + 1)
        places = [np.stack([a + np.argmax(v[:, a:b], axis=1) for a, b in zip(starts, stops, strict=True)]) for v in got]
        values = np.concatenate([v[np.arange(p.filters), at] for v, at in zip(got, places, strict=True)], 1)
        weight = np.where(y, self.toxic_weight, 1.0)
        error = ((1 / (1 + np.exp(-np.clip(values @ self.out + self.bias, -30, 30))) - y) * weight / len(docs)).astype(np.float32)
        slopes = error[:, None] * self.out
        self.out -= rate * (values.T @ error + 1e-4 * self.out)
        self.bias -= rate * error.sum()
        at_rows, steps = [], []
        for s, (k, w) in enumerate(zip(p.spans, self.conv, strict=True)):
            slope = slopes[:, s * p.filters : (s + 1) * p.filters]
            for j in range(k):
                at = places[s] + j
                back = slope[:, :, None] * w[j].T[None]
                w[j] -= rate * np.einsum("nf,nfd->df", slope, words[at])
                at_rows.append(rows[at].reshape(-1))
                steps.append(np.repeat(back.reshape(-1, p.width), rows.shape[1], axis=0))
        used, inverse = np.unique(np.concatenate(at_rows), return_inverse=True)
        steps = np.concatenate(steps)
        for d in range(p.width):
            self.embed[used, d] -= rate * 20 * np.bincount(inverse, steps[:, d], len(used)).astype(np.float32)
        self.embed[0] = 0
        return used


@dataclass
class Model:
    """A network with a threshold of the logit for each of LANGUAGES."""

    network: Network | None
    thresholds: np.ndarray

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.network is None:
            return np.full(len(offsets) - 1, 0.1)
        buckets, first = features_of(data, offsets, self.network.p)
        away = self.network.logits(buckets, first) - self.thresholds[languages_of(data, offsets)]
        reject = self.network.p.reject
        return 1 / (1 + np.exp(-np.clip(away, -30, 30)) * (1 - reject) / reject)


def _best_threshold(bins: np.ndarray, clean: np.ndarray, toxic: np.ndarray, grid: int) -> float:
    """The middle of the gap that leaves the fewest errors, of rows counted by floor(logit * grid), bins rising; one beyond the last logit where that is all or none."""
    errors = np.append(0, np.cumsum(toxic)) + clean.sum() - np.append(0, np.cumsum(clean))
    k = int(np.argmin(errors))
    if k in (0, len(bins)):
        return float(bins[0] / grid - 1 if k == 0 else (bins[-1] + 1) / grid + 1)
    return float((bins[k - 1] + 1 + bins[k]) / 2 / grid)


def _documents(batch: pa.RecordBatch, p: Toxicity) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]]:
    """(buckets of each document, toxic, half, language) of labelled rows, a slice of texts at a time."""
    toxic, half = (batch.column(name).to_numpy(zero_copy_only=False) for name in ("toxic", "half"))
    for lo, hi, data, offsets in text_slices(batch.column("text")):
        buckets, first = features_of(data, offsets, p)
        yield [buckets[a:b] for a, b in zip(first[:-1], first[1:], strict=True)], toxic[lo:hi].astype(bool), half[lo:hi], languages_of(data, offsets)


def _bucket_counts(labelled: DataFrame, p: Toxicity) -> DataFrame:
    """(bucket, n00, n01, n10, n11): documents in which a bucket stands, by half and label."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        has = np.zeros((4, 1 << p.bits), np.int32)
        for batch in batches:
            for docs, toxic, half, _ in _documents(batch, p):
                for doc, kind in zip(docs, 2 * half + toxic, strict=True):
                    has[kind, np.unique(doc)] += 1
        at = np.flatnonzero(has.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(row[at].astype(np.int64)) for row in has)], names=["bucket", "n00", "n01", "n10", "n11"])

    names = ("n00", "n01", "n10", "n11")
    each = labelled.mapInArrow(count, "bucket int, " + ", ".join(f"{n} long" for n in names))
    return each.groupBy("bucket").agg(*(F.sum(n).alias(n) for n in names)).filter(" + ".join(names) + f" >= {p.seen}")


def _epoch(labelled: DataFrame, nets: list[Network], rate: float, p: Toxicity) -> None:
    """Train each network on its rows (the first on all, the others on a half), a task on its own, and move it by the average of those that moved a slot."""
    shared = labelled.sparkSession.sparkContext.broadcast(nets)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        old = shared.value
        nets = copy.deepcopy(old)  # the broadcast value is other tasks' as well
        for net in nets:
            net.row = nets[0].row
        held, seen, moved = [([], []) for _ in nets], [0 for _ in nets], [np.zeros(len(net.embed), bool) for net in nets]

        def train(k: int) -> None:
            docs, y = held[k]
            moved[k][nets[k].step(docs, np.array(y), rate)] = True
            seen[k] += len(docs)
            held[k] = ([], [])

        for batch in batches:
            for docs, toxic, half, _ in _documents(batch, p):
                for doc, y, h in zip(docs, toxic, half, strict=True):
                    for k in (0, 1 + h):
                        if held[k][0] and (len(held[k][0]) >= p.batch or sum(map(len, held[k][0])) + len(doc) > p.step_words):
                            train(k)
                        held[k][0].append(doc)
                        held[k][1].append(y)
        for k in range(len(nets)):
            if held[k][0]:
                train(k)
            if seen[k]:
                at = np.flatnonzero(moved[k])
                dense = nets[k].dense() - old[k].dense()
                slots = np.concatenate([-np.arange(len(dense), 0, -1), at]).astype(np.int32)
                by = np.concatenate([dense[::-1], nets[k].embed[at] - old[k].embed[at]]).astype(np.float16)
                block = np.floor_divide(slots, MOVES)
                for b in np.unique(block).tolist():
                    own = block == b
                    yield pa.RecordBatch.from_pylist([{"net": k, "block": b, "n": seen[k], "slots": slots[own].tobytes(), "moves": by[own].tobytes()}], pa.schema([("net", pa.int32()), ("block", pa.int32()), ("n", pa.int64()), ("slots", pa.binary()), ("moves", pa.binary())]))

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight, key = np.zeros((MOVES, p.width)), np.zeros(MOVES), None
        for batch in batches:
            key = key or (batch["net"][0].as_py(), batch["block"][0].as_py())
            for n, slots, moves in zip(batch["n"].to_pylist(), batch["slots"].to_pylist(), batch["moves"].to_pylist(), strict=True):
                at = np.frombuffer(slots, np.int32) - key[1] * MOVES
                total[at] += np.frombuffer(moves, np.float16).reshape(-1, p.width).astype(float) * n
                weight[at] += n
        at = np.flatnonzero(weight)
        by = (total[at] / weight[at, None]).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([(at + key[1] * MOVES).astype(np.int32).tobytes()]), pa.array([by.tobytes()])], names=["net", "slots", "moves"])

    each = labelled.mapInArrow(learn, "net int, block int, n long, slots binary, moves binary")
    parts = -(-sum(len(net.embed) for net in nets) // (MOVES * BLOCKS))
    moves = each.repartition(parts, "net", "block").groupBy("net", "block").applyInArrow(average, "net int, slots binary, moves binary")
    for r in moves.toLocalIterator():  # a part at a time, so the driver holds the networks and a few blocks
        nets[r.net].move(np.frombuffer(r.slots, np.int32), np.frombuffer(r.moves, np.float32).reshape(-1, p.width))
    shared.destroy()


def _logit_counts(labelled: DataFrame, nets: list[Network], p: Toxicity) -> pa.Table:
    """(lang, bin, clean, toxic): all labelled rows by language and logit, each from the network of the half that it isn't in."""
    shared = labelled.sparkSession.sparkContext.broadcast(nets)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nets = shared.value
        for batch in batches:
            for docs, toxic, half, lang in _documents(batch, p):
                bins = np.zeros(len(docs), np.int32)
                for i, (doc, h) in enumerate(zip(docs, half, strict=True)):
                    bins[i] = np.floor(np.clip(nets[2 - h].logits(doc, np.array([0, len(doc)]))[0], -1e5, 1e5) * p.grid)
                yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(bins), pa.array(toxic.astype(np.int32))], names=["lang", "bin", "toxic"])

    each = labelled.mapInArrow(judge, "lang int, bin int, toxic int")
    return each.groupBy("lang", "bin").agg(F.count_if(F.col("toxic") == 0).alias("clean"), F.count_if(F.col("toxic") == 1).alias("toxic")).orderBy("bin").toArrow()  # the networks' last use is in this job


def learn(labelled: DataFrame, p: Toxicity = Toxicity()) -> Model:
    """Train on all labelled rows (text, toxic 0 or 1, half 0 or 1)."""
    rows = {(r.half, r.toxic): r.n for r in labelled.groupBy("half", "toxic").agg(F.count("*").alias("n")).collect()}
    n = np.array([[rows.get((h, y), 0) for y in (0, 1)] for h in (0, 1)])
    if not n.sum(0).all():
        return Model(None, np.zeros(len(LANGUAGES)))
    tasks = labelled.coalesce(max(1, -(-int(n.sum()) // sum(p.most_rows))))
    got = _bucket_counts(tasks, p).orderBy("bucket").toArrow()
    buckets = got["bucket"].to_numpy()
    has = np.array([[got[f"n{h}{y}"].to_numpy() for y in (0, 1)] for h in (0, 1)])
    del got
    nets = [Network(buckets, *has.sum(0), *n.sum(0), p), *(Network(buckets, *has[h], *n[h], p) for h in (0, 1))]
    del has
    for epoch in range(p.epochs):
        _epoch(tasks, nets, p.rate * (1 - epoch / p.epochs), p)
    counts = _logit_counts(labelled, nets, p)
    lang, bins, clean, toxic = (counts[c].to_numpy() for c in ("lang", "bin", "clean", "toxic"))
    each, where = np.unique(bins, return_inverse=True)
    common = _best_threshold(each, np.bincount(where, clean), np.bincount(where, toxic), p.grid)
    thresholds = np.full(len(LANGUAGES), common)
    for k in range(len(LANGUAGES)):
        own = lang == k
        if toxic[own].any() and clean[own].any():
            thresholds[k] = (toxic[own].sum() * _best_threshold(bins[own], clean[own], toxic[own], p.grid) + 30 * common) / (toxic[own].sum() + 30)
    return Model(nets[0], thresholds)


def score_batches(batches: Iterator[pa.RecordBatch], model: object) -> Iterator[pa.RecordBatch]:
    """(scored_text, other columns) to (other columns, score)."""
    for batch in batches:
        got = [model.value.scores(data, offsets) for _, _, data, offsets in text_slices(batch.column("scored_text"))]
        if got:
            rest = batch.drop_columns(["scored_text"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(np.concatenate(got).astype(np.float64))], [*rest.schema.names, "score"])


def usable_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the documents that may be learnt from."""
    return labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def perhaps_labelled(rows: DataFrame, usable: DataFrame) -> DataFrame:
    """The rows whose doc_id may be among the usable ones: all that are and, by the bits of a hash, some others. The bits are a broadcast table of ``MARKS`` rows at most."""
    kinds = {df.schema["doc_id"].dataType.simpleString() for df in (rows, usable)}
    if len(kinds) > 1 or not kinds <= {"string", "int", "bigint"}:  # equal ids of other types may have other hashes
        return rows
    mark, bit = F.pmod(F.xxhash64("doc_id"), F.lit(MARKS)), F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(64)).cast("int")
    marks = usable.select(mark.alias("mark"), bit.alias("bit")).groupBy("mark").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    return rows.join(F.broadcast(marks), (mark == F.col("mark")) & (F.getbit("bits", bit) == 1), "left_semi")


def labelled_rows(docs: DataFrame, labels: DataFrame, p: Toxicity = Toxicity()) -> DataFrame:
    """(text, toxic, half): every document that may be learnt from, whole, and which half of the rows it is in; written, as each pass reads it.

    Texts are shuffled to meet their labels; those that can't have one stay behind.
    """
    usable = usable_labels(labels).select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))
    rows = perhaps_labelled(docs.filter(~held_out(F.col("doc_id"))).select("doc_id", text_of("text").alias("text")), usable)
    half = F.pmod(F.xxhash64(F.lit(p.seed), "doc_id"), F.lit(2)).cast("int")
    return written(rows.join(usable.hint("merge"), "doc_id").select("text", "toxic", half.alias("half")), "labelled")


def toxicity(docs: DataFrame, labels: DataFrame, p: Toxicity = Toxicity(), also: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``also``, held_out, score, predicted of every document."""
    spark = docs.sparkSession
    bounded_batches(spark)
    labelled = labelled_rows(docs, labels, p)
    model = spark.sparkContext.broadcast(learn(labelled, p))
    forget(labelled)
    shown = docs.select(*also, held_out(F.col("doc_id")).alias("held_out"), text_of("text").alias("scored_text"))
    fields = T.StructType([*shown.drop("scored_text").schema.fields, T.StructField("score", T.DoubleType())])
    scored = shown.mapInArrow(partial(score_batches, model=model), fields)
    return scored.withColumn("predicted", (F.col("score") >= p.reject).cast("int"))
