"""Retrieval by blocks against all pairs, bounds, embedders that fail, batches against a plain fold, audits while writing."""

import random
from hashlib import md5

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from caseloom.operators import audit as A
from caseloom.operators import retrieval as H
from caseloom.operators.evidence import fused

WORDS = ["dose", "of", "the", "lab", "alpha", "beta", "10", "mg", "rash", "fever", "naïve", "x-ray", "level", "anna", "bert", "seen"]


def _pairs(seed, documents=4, facts=9, chunks=11):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    f, c = [], []
    for d in range(documents):
        for i in range(facts):
            f.append((d, f"{rng.choice(['lab_', '', 'test_'])}field{i}", rng.choice([text(rng.randint(1, 4)), "Not stated", "10 mg", ""]), rng.choice([None, text(1)]), rng.choice([None, "anna", "bert"]), rng.choice([[], ["anna"], ["bert", " "]])))
        for i in range(chunks):
            c.append((d, i * rng.choice([1, 40]), text(rng.randint(0, 9)), rng.random() < 0.3, rng.random() < 0.3))
    return f, list({(x[0], x[1]): x for x in c}.values())


def _all_pairs(facts, chunks, k, least):
    """Every fact with every chunk of its document, scored whole."""
    stated = H.gram_vectors(H.fact_terms(facts.filter(~F.lower(F.trim("value")).isin("not stated", "none", "unknown"))), F.concat_ws(" ", F.translate("field", "_", " "), "value")).withColumnRenamed("vector", "_a")
    scored = H.with_lexical(stated.join(H.gram_vectors(H.chunk_terms(chunks), F.col("text")).withColumnRenamed("vector", "_b"), "document_id"))
    out = []
    for r in scored.collect():
        a, b = np.array(r["_a"], float), np.array(r["_b"], float)
        sem = float(a @ b / np.sqrt((a @ a) * (b @ b))) if a.any() and b.any() else 0.0
        out.append((r.document_id, r.field, r.value, r.pos, r.lexical, sem, r.is_table and r.field.startswith(H.STRUCTURED), r.has_box))
    spark = facts.sparkSession
    rows = spark.createDataFrame(out, "document_id long, field string, value string, pos long, lexical double, sem double, t boolean, b boolean").withColumn("rel", fused(F.col("lexical"), F.col("sem"))).filter(F.col("rel") >= least).collect()
    best = {}
    for r in sorted(rows, key=lambda r: (-round(r.rel, 9), not r.t, not r.b, r.pos)):
        best.setdefault((r.document_id, r.field), []).append((r.pos, round(r.rel, 6)))
    return {key: v[:k] for key, v in best.items()}


@pytest.mark.parametrize(("seed", "block"), [(1, 2), (2, 64)])
def test_blocks_find_what_all_pairs_find(spark, monkeypatch, seed, block):
    monkeypatch.setattr(H, "BLOCK", block)
    f, c = _pairs(seed)
    facts = spark.createDataFrame(f, "document_id long, field string, value string, normalized string, scope string, others array<string>")
    chunks = spark.createDataFrame(c, "document_id long, pos long, text string, is_table boolean, has_box boolean")
    got = {}
    for r in H.retrieve_hybrid(facts, chunks).orderBy("rank").collect():
        got.setdefault((r.document_id, r.field), []).append((r.pos, round(r.relevance, 6)))
    assert got == _all_pairs(facts, chunks, 3, 0.15)


def test_few_rows_are_made_for_a_long_document(spark):
    rng = random.Random(3)
    chunks = spark.createDataFrame([(0, i, " ".join(f"w{rng.randrange(3000)}" for _ in range(12))) for i in range(2000)] + [(0, 2000, "the rare value")], "document_id long, pos long, text string")
    facts = H.gram_vectors(H.fact_terms(spark.createDataFrame([(0, f"field{i}", "rare value") for i in range(20)], "document_id long, field string, value string")), F.concat_ws(" ", "field", "value"))
    made = H.candidates(facts, H.gram_vectors(H.chunk_terms(chunks), F.col("text")), 3, 0.15).count()
    assert 20 <= made < 20 * 2001 / 8


def test_bounds_hold(spark):
    grid = [(s / 20, m / 20, scoped, structured, table, field, scope) for s in range(21) for m in range(21) for scoped in (True, False) for structured in (True, False) for table in (True, False) for field in (0.0, 0.1) for scope in ((0.4, -0.2, -0.6, 0.0) if scoped else (0.0,))]
    rows = spark.createDataFrame(grid, "s double, sem double, scoped boolean, structured boolean, is_table boolean, field double, scope double")
    whole = F.when(F.col("s") > 0, F.col("s") + F.col("field") + F.col("scope")).otherwise(0.0)
    lex = lambda w: F.greatest(F.lit(0.0), F.least(F.lit(1.0), w))
    low, high = H._bounds(F.col("s"), F.col("sem"), F.col("scoped"), F.col("structured"), F.col("is_table"))
    scores = [F.when(~F.col("structured"), whole).when(F.col("is_table"), row).otherwise(F.least(whole, F.lit(0.88))) for row in (whole, F.greatest(whole, F.lit(0.98)))]
    for score in scores:
        rel = fused(lex(score), F.col("sem"))
        assert rows.filter((rel < low - 1e-12) | (rel > high + 1e-12)).count() == 0


def test_a_failing_embedder_costs_its_own_vectors(spark):
    calls = []

    def encode(texts):
        calls.append(len(texts))
        if any("bad" in x for x in texts):
            raise RuntimeError("no")
        return [None if x == "none" else [float(len(x)), 1.0] for x in texts]

    rows = spark.createDataFrame([(i, x) for i, x in enumerate(["a", "bad", "none", None, "abc"] * 3)], "i int, x string").coalesce(1)
    got = [r.vector for r in H.embedder(encode, 4)(rows, F.col("x")).orderBy("i").collect()]
    assert got == [[1.0, 1.0], None, None, [0.0, 1.0], [3.0, 1.0]] * 3
    chunks = spark.createDataFrame([(0, 0, "alpha bad"), (0, 1, "beta none")], "document_id long, pos long, text string")
    facts = spark.createDataFrame([(0, "f", "alpha")], "document_id long, field string, value string")
    found = H.retrieve_hybrid(facts, chunks, embed=H.embedder(encode)).collect()
    assert sorted((r.pos, r.strategy, round(r.semantic)) for r in found) == [(0, "exact_lexical", 0), (1, "hybrid_semantic_lead", 1)]


def _fold(rows, most_items, most_chars):
    batch, items, chars, seen, out = 1, 0, 0, set(), []
    for e, field, value, snippet in rows:
        if items >= most_items or chars >= most_chars:
            batch, items, chars, seen = batch + 1, 0, 0, set()
        n = len(snippet.strip())
        chars += len(field) + len(value) + 80 + (0 if e in seen else (403 if n > 400 else n) + 80)
        items += 1
        seen.add(e)
        out.append((batch, chars))
    return out


@pytest.mark.parametrize(("items", "chars", "run"), [(30, 25_000, 1024), (4, 900, 5), (7, 500, 8), (1, 10, 4)])
def test_batches_equal_a_fold(spark, items, chars, run):
    rng = random.Random(items)
    rows = [(g, i, f"e{rng.randrange(6)}", "f" * rng.randrange(9), "v" * rng.randrange(40), " s" * rng.randrange(300)) for g in (None, "a", "b", "c") for i in range({"a": 1, "b": 33}.get(g, 70))]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "g string, pos int, evidence_id string, field string, value string, snippet string")
    got = {(r.g, r.pos): (r.batch, r.chars) for r in H.batches(table, "g", items, chars, run=run).collect()}
    want = {}
    for g in (None, "a", "b", "c"):
        own = sorted(r for r in rows if r[0] == g)
        want |= {(g, r[1]): x for r, x in zip(own, _fold([r[2:] for r in own], items, chars), strict=True)}
    assert got == want


def test_a_large_group_is_followed_in_many_tasks(spark):
    n = 1_000_000
    table = spark.range(n).select(F.lit("g").alias("g"), F.col("id").alias("pos"), (F.col("id") % 13).alias("evidence_id"), F.lit("f").alias("field"), F.lit("v").alias("value"), F.repeat(F.lit("x"), (F.col("id") % 5).cast("int")).alias("snippet"))
    got = H.batches(table, "g").groupBy("batch").agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.max("chars").alias("chars")).orderBy("batch").collect()
    assert [r.n for r in got[:-1]] == [30] * (n // 30) and got[-1].n == n % 30 and all(r.first == 30 * i for i, r in enumerate(got))
    tail = [(i % 13, "f", "v", "x" * (i % 5)) for i in range(30 * 999, 30 * 1000)]
    assert got[999].chars == _fold(tail, 30, 25_000)[-1][1]


def test_checks_are_counted_while_a_table_is_written(spark, tmp_path):
    rows = A.occurrences(spark.createDataFrame([(1, "a"), (1, None), (2, "c")], "k int, v string"), "k")
    checks = [A.always("single", F.col("n_alike") == 1), A.never("no value", F.col("v").isNull()), A.exactly("three", 3), A.at_least("two of c", 2, F.col("v") == "c"), A.always("letters", F.col("v").rlike("[a-z]"))]
    got = A.write_audited(rows, str(tmp_path / "t"), "t", checks)
    assert [(r[1], r[2], r[5]) for r in got] == [("single", 2, False), ("no value", 1, False), ("three", 3, True), ("two of c", 1, False), ("letters", 1, False)]
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3
    assert A.gate(A.report(spark, got)).first().asDict() == {"scope": "t", "n_checks": 5, "n_failed": 4, "passed": False}
    none = A.write_audited(rows.limit(0), str(tmp_path / "none"), "none", checks)
    assert [r[5] for r in none] == [True, True, False, False, True]
    with pytest.raises(ValueError, match="one name"):
        A.write_audited(rows, str(tmp_path / "x"), "x", checks[:1] * 2)


def test_copies_of_a_text_are_embedded_once(spark, tmp_path):
    folder = str(tmp_path)

    def noted(texts):
        with open(f"{folder}/calls", "a") as f:
            f.write(f"{len(texts)}\n")
        return [[float(len(x))] for x in texts]

    rows = spark.createDataFrame([("same",)] * 40 + [("other text",)], "t string").coalesce(1)
    got = [r.vector for r in H.embedder(noted)(rows, F.col("t")).collect()]
    assert got == [[4.0]] * 40 + [[10.0]]
    with open(f"{folder}/calls") as f:
        assert sum(map(int, f)) <= 8  # texts of all calls; 41 before


def test_each_part_and_pair_of_words_is_hashed_once(monkeypatch):
    """Digests of many texts at once are those of hashlib, at every length around a block's, and no text is hashed again for a second word that holds it."""
    rng = random.Random(5)
    texts = ["é" * (n % 40) + "".join(rng.choice("abc𝒳 ") for _ in range(n)) for n in range(130)] * 2
    assert H.md5_buckets(pa.array(texts)[3:]).tolist() == [md5(x.encode()).digest()[-1] % 128 for x in texts[3:]]
    hashed, plain = [], H.md5_buckets
    monkeypatch.setattr(H, "md5_buckets", lambda x: hashed.extend(x.to_pylist()) or plain(x))
    words = [["".join(rng.choice("ab𝒳") for _ in range(9)) for _ in range(60)] for _ in range(20)] + [None, []]
    got = H.hashed_vectors(pa.array(words, pa.list_(pa.string())))
    assert len(hashed) == len({(len(x) if len(x) < 5 else 9, x) for x in hashed})
    for row, own in zip(got, words, strict=True):
        grams = [g for w in own or [] for g in [w, w, *(w[i : i + n] for n in (3, 4) for i in range(len(w) - n + 1))]] + [g for a, b in zip(own or [], (own or [])[1:]) for g in [f"{a}_{b}"] * 3]
        assert row.tolist() == np.bincount([md5(g.encode()).digest()[-1] % 128 for g in grams] or [0], [1] * len(grams) or [0], 128).tolist()


def test_few_texts_take_no_digests_side_by_side(monkeypatch):
    """An embedder that fails is asked for a few texts at a time: these are hashed one by one, words that an earlier call had not again, with the same vectors."""
    rng = random.Random(6)
    words = [["".join(rng.choice("abé𝒳_1") for _ in range(rng.randrange(80))) for _ in range(rng.randrange(12))] for _ in range(50)] + [None, []]
    lists = pa.array(words, pa.list_(pa.string()))
    calls, plain = [], H.md5_buckets
    monkeypatch.setattr(H, "md5_buckets", lambda x: calls.append(len(x)) or plain(x))
    few = H.hashed_vectors(lists)
    assert not calls and few.shape == (52, 128) and H.hashed_vectors(lists[7:9]).tolist() == few[7:9].tolist()
    own = [["known", "words"], ["known"]]
    first = H.hashed_vectors(pa.array(own)).tolist()
    monkeypatch.setattr(H, "_bucket", lambda text: calls.append(text) or md5(text.encode()).digest()[-1] % 128)
    assert H.hashed_vectors(pa.array(own)).tolist() == first and calls == ["known_words"]
    calls.clear()
    monkeypatch.setattr(H, "FEW", 0)
    assert H.hashed_vectors(lists).tolist() == few.tolist() and calls


def test_cosines_of_broken_vectors_are_nothing():
    left = pa.array([[[1.0, 0.0], [], None, [float("nan"), 1.0], [1.0]], [], [[3.0, 4.0]]], pa.list_(pa.list_(pa.float64())))
    right = pa.array([[[2.0, 0.0], [-1.0, 0.0]], [[1.0]], []], pa.list_(pa.list_(pa.float64())))
    assert H.cosines.func(left, right).to_pylist() == [[[1.0, 0.0], [0.0, 0.0], [0.0, 0.0], [0.0, 0.0], [0.0, 0.0]], [], [[]]]


def test_words_stay_where_they_are_made(spark):
    """Neither Python nor a shuffle gets the words of chunks, which are larger than their texts."""
    facts = spark.createDataFrame([(0, "field", "rare value")], "document_id long, field string, value string")
    plan = H.retrieve_hybrid(facts, spark.createDataFrame([(0, 0, "a rare value")], "document_id long, pos long, text string"))._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if "MapInArrow" in line or "RepartitionByExpression" in line or "ArrowEvalPython" in line:
            assert "_held" not in line, line
    below = plan[plan.index("RepartitionByExpression") :]
    assert "_held" not in below


def test_batches_of_runs_are_those_of_a_plain_fold():
    """Sizes, ways through a run and batches' numbers, all rows at once: null ids are never alike, a null length leaves ``most_items`` as the only bound."""
    rng = random.Random(7)
    runs = [[(rng.choice([None, 1, 2, 3]), rng.choice([None, *range(1, 9)] if r % 2 else range(1, 9)), rng.randint(1, 40)) for _ in range(rng.randint(1, 90))] for r in range(40)]
    ids, items, onces = (pa.array([[x[i] for x in run] for run in runs], pa.list_(pa.int64())) for i in range(3))
    sizes = []
    for run in runs:
        for start in range(len(run)):
            chars, seen, n = 0, [], 0
            for own, item, once in run[start : start + 7]:
                if chars is not None and chars >= 90:
                    break
                added = 0 if own is not None and own in seen else once
                chars, n = None if chars is None or item is None else chars + item + added, n + 1
                seen.append(own)
            sizes.append(n)
    got = H.batch_sizes(ids, items, onces, 7, 90)
    assert got.tolist() == sizes
    lists = H._by_steps(ids, lambda part: H.batch_sizes(ids[part], items[part], onces[part], 7, 90))
    leads, starts = H.run_leads(lists, 7), [rng.randrange(7) for _ in runs]
    places = H._by_steps(lists, lambda part: H.batch_places(lists[part], pa.array(starts[part], pa.int32()))).to_pylist()
    for own, lead, start, place in zip(lists.to_pylist(), leads.tolist(), starts, places, strict=True):
        for first in range(7):
            at, begun = first, []
            while at < len(own):
                begun.append(at)
                at += own[at]
            assert lead[first] == at - len(own)
            if first == start:
                assert place == [sum(b <= i for b in begun) for i in range(len(own))]


def test_a_filter_on_vectors_does_not_make_them_twice(spark):
    texts = spark.createDataFrame([(0, "a b"), (1, "")], "document_id long, text string")
    for embed in (H.gram_vectors, H.embedder(lambda texts: [[1.0]] * len(texts))):
        rows = embed(texts, F.col("text")).select("document_id", F.posexplode("vector").alias("bucket", "weight")).filter("weight > 0")
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1, plan
