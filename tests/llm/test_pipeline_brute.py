"""The pipeline's stages against plain readings of their rules, on a small corpus with nulls, ties and repeated rows."""

import collections
import random

import pytest

import corpus_pipeline
from caseloom.llm.queries import tokenizer_path

FIELDS = "doc_id long, text string, lang string, source string, n_chars long, size string, row string, kept string"


def words(n, seed):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(3000)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    rows = [(i, words(40 + i, i)) for i in range(40)] + [(100 + i, words(30, 500 + i) + " vileword") for i in range(20)]
    rows += [(200, words(50, 10) + "  "), (201, "\n" + words(50, 10)), (202, words(50, 10)), (203, words(50, 10).replace(" ", "  ", 3)), (204, words(50, 10) + " x")]
    rows += [(None, None), (None, ""), (300, " "), (5, words(45, 5)), (5, words(70, 77)), (None, words(80, 78)), (None, words(80, 78) + " w7"), (301, words(20_000, 79)), (301, words(20_000, 79))]
    docs = spark.createDataFrame([(i, t, "en", f"s{k % 3}" if k % 7 else None, 0, "a", "b", "c") for k, (i, t) in enumerate(rows)], FIELDS)
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int("vileword" in (t or ""))) for i, t in rows if i is not None and i < 200], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def stage(spark, k, docs, folder):
    return corpus_pipeline.written(corpus_pipeline.STAGES[k][1](spark, docs, folder), "stage")


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    shown = lambda df: collections.Counter((r.doc_id, r.text) for r in df.collect())

    clean = stage(spark, 0, docs, corpus)
    assert clean.columns == docs.columns
    assert shown(clean) == collections.Counter({k: n for k, n in shown(docs).items() if "vileword" not in (k[1] or "")})

    one = stage(spark, 1, clean, corpus)
    groups = collections.defaultdict(list)
    for i, t in shown(clean).elements():
        groups["".join((t or "").split())].append((-len(t or ""), i is None, i or 0, t))
    best = [min(g, key=lambda x: x[:3]) for g in groups.values()]
    assert one.columns == docs.columns and sorted((x[0], x[1], x[2]) for x in best) == sorted((-len(t or ""), i is None, i or 0) for i, t in shown(one).elements())

    near = stage(spark, 2, one, corpus)
    rows = list(shown(one).elements())
    sets, group = [shingles(t) for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    kept = list(shown(near).elements())
    assert near.columns == docs.columns and sorted(repr(group[rows.index(x)]) for x in kept) == sorted(map(repr, set(group)))

    mixed = stage(spark, 3, near, corpus)
    size = lambda t: len((t or "").split())
    times, had = shown(mixed), shown(near)
    assert mixed.columns == docs.columns and set(times) <= set(had) and max(times.values()) <= 3 and not any(size(t) == 0 for _, t in times)
    by = lambda df: {s: sum(size(t) for _, t in rows) for s, rows in collect(df).items()}

    def collect(df):
        out = collections.defaultdict(list)
        for r in df.collect():
            out[r.source].append((r.doc_id, r.text))
        return out

    before, after = by(near), by(mixed)
    weights, left, target = {s: 1 + k % 3 for k, s in enumerate(sorted(before, key=lambda s: (s is None, s or "")))}, float(sum(before.values())), {}
    while weights:
        share = {s: left * w / sum(weights.values()) for s, w in weights.items()}
        over = [s for s in share if share[s] > 3 * before[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * before[s]
            left -= target[s]
            del weights[s]
    for s, goal in target.items():
        assert abs(after.get(s, 0) - goal) <= max([size(t) for _, t in collect(near)[s]], default=0)

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    pieces = stage(spark, 4, mixed, corpus).collect()
    want = sum(n * (len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1) for (_, t), n in times.items())
    bins = collections.defaultdict(list)
    for r in pieces:
        bins[r.sequence_id].append((r.offset, r.length))
    assert sum(r.length for r in pieces) == want and all(sum(n for _, n in b) <= 1024 for b in bins.values())
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length


def test_empty_table(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").limit(0)
    for name, run in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(run(spark, docs, corpus), "stage")
        assert docs.count() == 0, name
