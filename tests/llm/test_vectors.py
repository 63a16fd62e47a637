"""Whitening against a dense eigensolver, hard negatives against all pairs; both on odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom.llm._vectors import from_bytes, to_bytes
from caseloom.llm.negatives import Mine, hard_negatives
from caseloom.llm.whitening import Whiten, corrections, jacobi_davidson, whiten

SCHEMA = "vec_id long, embedding array<float>, label int, extra string, x string, id string"


def _rows(seed, n, dims, labels=3, coarse=False):
    rng = np.random.default_rng(seed)
    x = rng.integers(-3, 4, (n, dims)) / 8 if coarse else rng.standard_normal((n, dims)) / 4
    return [(i, [float(c) for c in x[i]], int(rng.integers(labels)), "e", "x", "id") for i in range(n)]


ODD = [(1_000, None, 1, None, None, None), (1_001, [], 1, "", "", ""), (1_002, [float("nan")] * 4, 0, "", "", ""), (1_003, [1.0, None, 0.0, 0.0], 0, "", "", ""), (1_004, [1.0, math.inf, 0.0, 0.0], 2, "", "", ""), (1_100, [0.5, 0.25, 0.0, -0.5], None, "", "", ""), (1_200, [3e37] * 4, 1, "", "", ""), (1_300, [1.0, 2.0], 1, "", "", "")]


def _integers(rows, dims):
    ok = [r for r in rows if r[1] and len(r[1]) == dims and all(c is not None and math.isfinite(c) and abs(c) < 2.0**55 for c in r[1])]
    return ok, np.array([[math.floor(256 * c) for c in r[1]] for r in ok])


def test_bytes_round_trip():
    for top in (3, 200, 70_000, 1 << 40):
        x = np.array([[-top, top, 0], [1, -1, top - 1]])
        assert (from_bytes(*to_bytes(x), 3) == x).all()


def test_minres_solves_projected_equations():
    rng = np.random.default_rng(3)
    a = rng.standard_normal((12, 12))
    a = a + a.T
    q = np.linalg.qr(rng.standard_normal((12, 2)))[0]
    project = np.eye(12) - q @ q.T
    right = project @ rng.standard_normal((12, 1))
    z = corrections(lambda w: a @ w, np.array([0.7]), [q], right, 30, 1e-13)
    assert np.abs(project @ (a - 0.7 * np.eye(12)) @ z - right).max() < 1e-9


@pytest.mark.parametrize("values", [[9, 5, 4, 3.99, 3, 2, 1, 0.5], [1, 1 - 1e-4, 1 - 2e-4, 0.5, 0.4, 0.3, 0.2, 0.1], [4, 2], [3, 1, 0, 0, 0]])
def test_jacobi_davidson_finds_the_largest(values):
    d = len(values)
    q = np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))[0]
    a = (q * np.array(values)) @ q.T
    found, vectors, residuals = jacobi_davidson(lambda w: a @ w, d, float(np.trace(a)), Whiten())
    assert np.abs(found - np.array(values)[: len(found)]).max() < 1e-13 * values[0] * d
    assert residuals.max() < 1e-12 and np.abs(vectors.T @ vectors - np.eye(len(found))).max() < 1e-13


def test_whitening_equals_dense_eigenvectors(spark):
    rows = _rows(1, 300, 4) + ODD
    rows += rows[:40] + [(None, rows[5][1], None, "", "", "")]  # repeated rows, and a vector again under no id
    got = whiten(spark.createDataFrame(rows, SCHEMA)).toPandas()
    kept, x = _integers(rows, 4)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    c = (fit * n - s) / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(got) == 4 * len(kept) and set(got.n) == {n} and got.identity_error.max() < 1e-9
    z = ((x * n - s) / n) @ vectors / np.sqrt(values)
    assert np.allclose(got.explained.to_numpy().reshape(-1, 4)[0], values / values.sum(), rtol=1e-9)
    by_id = got[got.vec_id == 7].sort_values("component").whitened.to_numpy()[:4]
    at = next(i for i, r in enumerate(kept) if r[0] == 7)
    whole = sorted(tuple(np.round(np.abs(v), 8)) for v in got.whitened.to_numpy().reshape(-1, 4))
    assert whole == sorted(tuple(np.round(np.abs(v), 8)) for v in z) and len(by_id) == 4
    assert set(got[got.vec_id == 7].deviation) == {int(((x[at] * n - s) ** 2).sum())}
    assert got.vec_id.isna().sum() == 4


def test_whitening_of_little(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert whiten(empty).count() == 0 and whiten(empty).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    same = whiten(spark.createDataFrame([(1, [0.5, 0.25], 0, "", "", ""), (2, [0.5, 0.25], 0, "", "", "")], SCHEMA)).collect()
    assert len(same) == 4 and all(r.whitened is None and r.explained == 0 and r.deviation == 0 and r.n == 1 and r.identity_error == 0 for r in same)
    line = whiten(spark.createDataFrame([(i, [i / 4, i / 4], 0, "", "", "") for i in range(5)], SCHEMA)).collect()
    assert {r.component for r in line if r.whitened is None} == {2} and all(abs(r.explained - (r.component == 1)) < 1e-12 for r in line)
    huge = whiten(spark.createDataFrame([(1, [2.0**50, 1.0], 0, "", "", ""), (2, [0.0, 0.0], 0, "", "", "")], SCHEMA)).collect()
    assert huge[0].deviation is None and huge[0].whitened is not None


def _all_pairs(rows, how, dims=4):
    ok, x = _integers([r for r in rows if r[2] is not None], dims)
    keep = [i for i in range(len(ok)) if sum(int(c) ** 2 for c in x[i]) < 1 << 63]
    ok, x = [ok[i] for i in keep], x[keep].astype(object)
    ids = [r[0] for r in ok]
    label = [(r[2] + 1) % 10 if r[0] is not None and r[0] % 7 == 0 else r[2] for r in ok]
    last = lambda i: (ids[i] is None, ids[i] or 0)
    out = []
    for a, i in enumerate(ids):
        if i is None or i % 5:
            continue
        score = [int(sum(p * q for p, q in zip(x[a], v, strict=True))) for v in x]
        best = sorted((b for b in range(len(ok)) if b != a and label[b] == label[a]), key=lambda b: (-score[b], *last(b)))[: how.positives]
        for p in best:
            fits = [b for b in range(len(ok)) if label[b] != label[a] and how.low * score[p] <= how.whole * score[b] <= how.high * score[p]]
            for rank, b in enumerate(sorted(fits, key=lambda b: (-score[b], *last(b)))[: how.negatives], 1):
                out.append((i, ids[p], rank, ids[b], score[p], score[b]))
    return out


@pytest.mark.parametrize("coarse", [False, True])
@pytest.mark.parametrize("how", [Mine(), Mine(block=8, group=3, part=2, parts=1, depth=2, negatives=3)])
def test_negatives_equal_all_pairs(spark, coarse, how):
    rows = [*_rows(2, 180, 4, coarse=coarse), *ODD, (None, [0.5, -0.25, 0.125, 1.0], 1, "", "", ""), (2_005, [0.0] * 4, 0, "", "", ""), (2_010, [2.0**26] * 4, 0, "", "", "")]
    anchor, label = F.col("id") % 5 == 0, F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = hard_negatives(spark.createDataFrame(rows, SCHEMA), anchor, label, how=how)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(_all_pairs(rows, how), key=key)


def test_negatives_of_nothing_and_of_copies(spark):
    assert hard_negatives(spark.createDataFrame([], SCHEMA), F.col("id") % 5 == 0).count() == 0
    copies = spark.createDataFrame([(5 * i, [0.5, 0.5], i % 2, "", "", "") for i in range(12)], SCHEMA)
    got = hard_negatives(copies, F.col("id") % 5 == 0, how=Mine(high=100, block=4, part=1)).collect()
    assert len(got) == 12 * 5 * 6 and [r.negative_id for r in sorted(got) if (r.anchor_id, r.positive_id) == (0, 10)] == [5, 15, 25, 35, 45, 55]
