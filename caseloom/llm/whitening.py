"""Whitening of embeddings by their leading principal components, found by Jacobi-Davidson iteration.

1. Usable vectors (see ``_vectors``) of the table's dimension become integers. Each distinct one is kept once, on the *fit list*, which is
   written as blocks of bytes; its sums per dimension are exact.
2. The covariance is never formed. A *pass* is a Spark job over the blocks which multiplies the centred fit list, and its transpose, with a
   few vectors: tasks add up their blocks, Spark adds up the tasks.
3. Outer rounds: Rayleigh-Ritz in the search space; a Ritz pair whose residual is at rounding level is locked, in falling order; the
   correction equations (I-QQ')(V-tI)(I-QQ') z = -r of the leading pairs that remain are solved by MINRES, all in step, so that each inner
   step is a single pass; their solutions extend the search space, which restarts from its best Ritz vectors when it is full.
4. Rows are projected where they are read.

The driver holds vectors of one dimension's length, ``Whiten.space`` of them at most, whatever the number of rows. A pass starts from written
blocks, so lost executors cost their tasks only.

Defined results: rows with an unusable vector are dropped (nothing is returned for them), and so are rows whose vector has not the most common
length (the longer of two equally common). Null and repeated ids are returned as they are, equal vectors count once for the fit. There are
as many components as dimensions, if these are fewer than asked for. A component without variance (relative to the whole, at rounding level) has
``whitened`` null and ``explained`` 0 and takes no part in ``identity_error``, which is 0 if no component has variance. ``deviation`` is null where it
does not fit a long. An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches, forget, written
from ._vectors import from_bytes, integers, matrix, to_bytes, usable

_EPS = float(np.finfo(float).eps)
_RESULT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Whiten:
    components: int = 4  #: wanted
    ahead: int = 3  #: further Ritz pairs whose correction equations are solved with those of the wanted ones
    inner: int = 12  #: most MINRES steps to a correction equation
    reduce: float = 0.02  #: a correction equation ends once its residual is so much of what it was
    space: int = 40  #: most vectors of the search space; it restarts then
    rounds: int = 60  #: most outer rounds
    seed: int = 7
    rows: int = 2048  #: vectors to a block


@dataclass(frozen=True)
class Fit:
    n: int
    sums: tuple[int, ...]
    values: np.ndarray  #: eigenvalues, falling
    vectors: np.ndarray  #: unit eigenvectors as columns
    trace: float
    identity_error: float
    passes: int  #: Spark jobs over the fit list
    residuals: np.ndarray


def _centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n*x - sums, exactly: int64, or Python's integers where these don't hold them."""
    most = max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0
    if n * most + max(map(abs, sums)) < 1 << 62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


class Passes:
    """Sums over the fit list, each by one Spark job."""

    def __init__(self, blocks: DataFrame, dims: int, n: int, sums: tuple[int, ...]):
        self.blocks, self.dims, self.n, self.sums, self.count = blocks, dims, n, sums, 0

    def total(self, of: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
        """The sum of of(centred block), of ``size`` numbers, over all blocks."""
        dims, n, sums = self.dims, self.n, self.sums

        def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            added = None
            for batch in batches:
                for data, width in zip(batch.column(0), batch.column(1), strict=True):
                    got = of((_centred(from_bytes(data.as_py(), width.as_py(), dims), n, sums) / n).astype(float))
                    added = got if added is None else added + got
            if added is not None:
                yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(added.ravel())], names=["slot", "value"])

        self.count += 1
        added = self.blocks.select("data", "width").mapInArrow(tasks, "slot int, value double").groupBy("slot").agg(F.sum("value").alias("value")).collect()
        out = np.zeros(size)
        for slot, value in added:  # ``size`` rows
            out[slot] = value
        return out

    def product(self, w: np.ndarray) -> np.ndarray:
        """The covariance times the columns of w."""
        return self.total(lambda c: c.T @ (c @ w), w.size).reshape(w.shape) / self.n

    def covariance_of(self, w: np.ndarray) -> np.ndarray:
        """The covariance of the projections on the columns of w."""
        k = w.shape[1]

        def sums(c: np.ndarray) -> np.ndarray:
            z = c @ w
            return np.append((z.T @ z).ravel(), z.sum(0))

        got = self.total(sums, k * k + k)
        mean = got[k * k :] / self.n
        return got[: k * k].reshape(k, k) / self.n - np.outer(mean, mean)


def _without(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """x less its part in the span of q's orthonormal columns; done twice, as once leaves rounding errors."""
    for _ in range(2):
        x = x - q @ (q.T @ x)
    return x


def corrections(product: Callable[[np.ndarray], np.ndarray], shifts: np.ndarray, bases: list[np.ndarray], right: np.ndarray, steps: int, reduce: float) -> np.ndarray:
    """Solutions of (I-QQ')(A-tI)(I-QQ') z = right, one for each column with its own shift t and basis Q, by MINRES in step."""
    k = right.shape[1]
    held = np.column_stack([_without(right[:, i], bases[i]) for i in range(k)])
    beta = np.linalg.norm(held, axis=0)
    start, out = beta.copy(), np.zeros_like(held)
    v, before = held / np.where(beta > 0, beta, 1), np.zeros_like(held)
    d, d_before = np.zeros_like(held), np.zeros_like(held)
    rest, carried = beta.copy(), np.zeros(k)  # what is left of the residual; Lanczos' last beta
    c, s, c_before, s_before = np.ones(k), np.zeros(k), np.ones(k), np.zeros(k)
    active = beta > 0
    for _ in range(steps):
        if not active.any():
            break
        at = np.flatnonzero(active)
        av = product(v[:, at])
        for j, i in enumerate(at):
            w = _without(av[:, j] - shifts[i] * v[:, i], bases[i])
            alpha = v[:, i] @ w
            w = _without(w - alpha * v[:, i] - carried[i] * before[:, i], bases[i])
            beta_next = np.linalg.norm(w)
            # the rotations before the last and the last turn this column, a new one removes what lies below the diagonal
            far, turned = s_before[i] * carried[i], c_before[i] * carried[i]
            near, diagonal = c[i] * turned + s[i] * alpha, c[i] * alpha - s[i] * turned
            long = np.hypot(diagonal, beta_next)
            if long <= _EPS * abs(shifts[i]):
                active[i] = False
                continue
            c_new, s_new = diagonal / long, beta_next / long
            d_new = (v[:, i] - near * d[:, i] - far * d_before[:, i]) / long
            out[:, i] += c_new * rest[i] * d_new
            rest[i] *= -s_new
            d_before[:, i], d[:, i] = d[:, i], d_new
            c_before[i], s_before[i], c[i], s[i] = c[i], s[i], c_new, s_new
            before[:, i], v[:, i] = v[:, i], w / beta_next if beta_next > 0 else 0
            carried[i] = beta_next
            active[i] = abs(rest[i]) > reduce * start[i] and beta_next > _EPS * abs(shifts[i])
    return out


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], dims: int, trace: float, how: Whiten) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors, residuals) of the ``how.components`` largest eigenvalues of a symmetric operator, falling.

    Residuals end at the trace's last bit times the number of dimensions' root. Sums over very many rows carry more rounding than that: a pair whose
    residual is below 1e-11 of the trace and hasn't halved in four rounds is as exact as its products, and is locked too.
    """
    wanted = min(how.components, dims)
    tolerance = _EPS * trace * max(1.0, np.sqrt(dims) / 4)
    at_once = min(dims, wanted + how.ahead)
    space, _ = np.linalg.qr(np.random.default_rng(how.seed).standard_normal((dims, at_once)))
    images = product(space)
    locked, values, residuals = np.zeros((dims, 0)), [], []
    best, since = np.inf, 0
    for _ in range(how.rounds):
        small = space.T @ images
        theta, s = np.linalg.eigh((small + small.T) / 2)
        theta, s = theta[::-1], s[:, ::-1]
        ritz, moved = space @ s, images @ s
        residual = _without(moved, locked) - ritz * theta
        norms = np.linalg.norm(residual, axis=0)
        best, since = (norms[0], 0) if norms[0] < best / 2 else (best, since + 1)
        taken = 0
        while taken < len(theta) and len(values) < wanted and (norms[taken] <= tolerance or (taken == 0 and since >= 4 and norms[0] <= 1e-11 * trace)):
            locked = np.column_stack((locked, ritz[:, taken]))
            values.append(theta[taken])
            residuals.append(norms[taken])
            taken += 1
        if taken:
            best, since = np.inf, 0
        space, images, theta, residual, norms = ritz[:, taken:], moved[:, taken:], theta[taken:], residual[:, taken:], norms[taken:]
        if len(values) == wanted:
            return np.array(values), locked, np.array(residuals)
        k = min(at_once - locked.shape[1], space.shape[1])
        if space.shape[1] + k > max(how.space, 2 * at_once):
            space, images = space[:, : 2 * k], images[:, : 2 * k]
        bases = [np.linalg.qr(np.column_stack((locked, space[:, i])))[0] for i in range(k)]
        open_ = [i for i in range(k) if norms[i] > tolerance]
        new = corrections(product, theta[open_], [bases[i] for i in open_], -residual[:, open_], how.inner, how.reduce)
        free = dims - locked.shape[1] - space.shape[1]
        fresh = np.zeros((dims, 0))
        for z in new.T:
            around = np.column_stack((locked, space, fresh))
            length = np.linalg.norm(z)
            if fresh.shape[1] < free and length > 0 and (left := np.linalg.norm(z := _without(z / length, around))) > 1e-8:
                fresh = np.column_stack((fresh, _without(z / left, around)))
        if not fresh.shape[1] and free:  # nothing new from the equations: any direction that is missing
            z = _without(np.random.default_rng(how.seed + len(residuals) + since).standard_normal(dims), np.column_stack((locked, space)))
            fresh = (z / np.linalg.norm(z))[:, None]
        if fresh.shape[1]:
            fresh = np.linalg.qr(_without(fresh, np.column_stack((locked, space))))[0]
            space, images = np.column_stack((space, fresh)), np.column_stack((images, product(fresh)))
        elif since >= 1 and norms[0] <= 1e-11 * trace:  # the space is whole and its products as exact as they get
            since = 4
    raise ArithmeticError(f"{len(values)} of {wanted} components in {how.rounds} rounds; least residual {norms[0]:.3g}, trace {trace:.3g}")


def fit(vectors: DataFrame, dims: int, how: Whiten) -> Fit | None:
    """The whitening of ``vectors``, a table of one column x (arrays of ``dims`` longs); None if it has no rows."""
    bounded_batches(vectors.sparkSession)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def block() -> pa.RecordBatch:
            x = np.concatenate(held)
            packed, width = to_bytes(x)
            total = [sum(map(int, column)) for column in x.T] if width == 8 else x.sum(0).tolist()
            return pa.RecordBatch.from_arrays([pa.array([packed], pa.binary()), pa.array([width], pa.int32()), pa.array([len(x)], pa.int64()), pa.array([json.dumps(total)])], names=["data", "width", "n", "sums"])

        for batch in batches:
            x = matrix(batch.column(0), dims)
            while len(x):
                room = how.rows - sum(map(len, held))
                held.append(x[:room])
                x = x[room:]
                if sum(map(len, held)) == how.rows:
                    yield block()
                    held = []
        if held:
            yield block()

    stored = written(vectors.groupBy("x").agg(F.lit(1)).select("x").mapInArrow(blocks, "data binary, width int, n long, sums string"), "fit-list")
    per = stored.select("n", F.posexplode(F.from_json("sums", "array<decimal(38,0)>")).alias("at", "part")).groupBy("at").agg(F.sum("n").alias("n"), F.sum("part").alias("total")).collect()
    if not per:
        forget(stored)
        return None
    sums, n = tuple(int(r.total) for r in sorted(per, key=lambda r: r["at"])), per[0].n
    passes = Passes(stored, dims, n, sums)
    trace = float(passes.total(lambda c: np.square(c).sum(0), dims).sum()) / n
    wanted = min(how.components, dims)
    if trace == 0:
        forget(stored)
        return Fit(n, sums, np.zeros(wanted), np.eye(dims)[:, :wanted], 0.0, 0.0, passes.count, np.zeros(wanted))
    values, found, residuals = jacobi_davidson(passes.product, dims, trace, how)
    values = np.where(values > 4 * dims * _EPS * trace, values, 0.0)
    varied = values > 0
    covariance = passes.covariance_of(found[:, varied] / np.sqrt(values[varied]))
    forget(stored)
    return Fit(n, sums, values, found, trace, float(np.abs(covariance - np.eye(len(covariance))).max(initial=0)), passes.count, residuals)


def whiten(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", how: Whiten = Whiten()) -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error) for every remaining row and component.

    ``deviation``: the squared distance from the mean, times n squared, exactly. ``whitened``: the centred vector's projection on the component, over
    its standard deviation. ``identity_error``: how far the covariance of ``whitened`` on the fit list is from the identity.
    """
    bounded_batches(table.sparkSession)
    rows = table.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).filter(usable(F.col("vector")))
    lengths = rows.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).limit(1).collect()
    kind = table.schema[id_col].dataType.simpleString()
    if not lengths:
        return table.sparkSession.createDataFrame([], f"`{id_col}` {kind}, {_RESULT}")
    dims = lengths[0].dims
    rows = rows.filter(F.size("vector") == dims).select("id", integers(F.col("vector")).alias("x"))
    found = fit(rows.select("x"), dims, how)
    n, sums, values = found.n, found.sums, found.values
    k = len(values)
    axes = found.vectors / np.sqrt(np.where(values > 0, values, 1))
    explained = (values / found.trace if found.trace else values).tolist()
    missing = values <= 0

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            c = _centred(matrix(batch.column(1), dims), n, sums)
            most = max(abs(int(c.min())), abs(int(c.max())))
            if dims * most * most < 1 << 63:
                deviation: list[Any] = (c.astype(np.int64) ** 2).sum(1).tolist()
            else:
                deviation = [d if d < 1 << 63 else None for d in (sum(int(v) ** 2 for v in row) for row in c)]
            z = (c / n).astype(float) @ axes
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n)),
                    pa.array([d for d in deviation for _ in range(k)], pa.int64()),
                    pa.array(z.ravel(), mask=np.tile(missing, m)),
                    pa.array(np.tile(np.array(explained), m)),
                    pa.array(np.full(m * k, found.identity_error)),
                ],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(project, f"id {kind}, {_RESULT}").withColumnRenamed("id", id_col)
