"""Operators against brute force on small tables: nulls, empty and long texts, ties, repeated rows, extra columns."""

import collections
import hashlib
import json
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from caseloom.llm.chat import levels, link_tools, orphans
from caseloom.llm.exact import Exact, exact_duplicates, seen, without_copies
from caseloom.llm.lines import Lines, drop_repeated_lines
from caseloom.llm.minhash import MinMax, near_duplicates, signature_batches
from caseloom.llm.mixing import fit, mix_sources
from caseloom.llm.packing import Packing, best_fit, pack
from caseloom.llm.pagetext import extract, learn as learn_pages, main_text
from caseloom.llm.queries import tokenizer_path
from caseloom.llm.sampling import fingerprints
from caseloom.llm.toxicity import Toxicity, toxicity
from caseloom.llm.urls import Filter, judge

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, bin string, h string"


def words(n, seed, vocabulary=4000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, a hot group, empty, blank, null and long texts."""
    base = words(120, 1)
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "One"), (4, "one"), (5, "two words"), (6, words(30_000, 2))]
    rows += [(10 + i, base) for i in range(20)] + [(40 + i, base.replace(base.split()[5 * i], "edit")) for i in range(12)]
    chain = base.split()
    for i in range(12):  # each close to the one before, the ends far apart
        chain = [*chain[5:], *words(5, 100 + i).split()]
        rows.append((60 + i, " ".join(chain)))
    rows += [(100 + i, words(40 + i, 200 + i) + "\nshared line of exactly seven words here\nshort one\n" + words(9, i)) for i in range(60)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame([(i, t, "en", f"s{i % 4}" if i % 9 else None, 0, "x", "y", "z") for i, t in corpus], DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_pack(docs, corpus):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    got = pack(docs, Packing(tokenizer_path())).collect()
    pieces, bins = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    for i, text in corpus:
        ids, at = tokenizer.encode(text or "", add_special_tokens=False).ids + [2], 0
        for k, r in enumerate(sorted(pieces[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (r.length == 1024 or k == 0) and r.length <= 1024
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= -(-sum(r.length for r in got) // 1024) + 2


def test_best_fit_leaves_no_mergeable_bins():
    sizes = np.random.default_rng(0).integers(1, 1025, 500)
    bins, places = best_fit(sizes, 1024)
    fill = np.bincount(bins, sizes)
    assert (fill <= 1024).all() and sum(sorted(fill)[:2]) > 1024
    assert all(places[i] + sizes[i] <= 1024 for i in range(500))


def test_chunks_whose_hashes_meet_keep_their_own_ids():
    """Thue-Morse words of a length collide under every polynomial hash modulo 2^64."""
    from tokenizers import Tokenizer

    from caseloom.llm._bpe import Encoder

    a, b = "a", "b"
    for _ in range(12):
        a, b = a + b, b + a
    texts = [a, b, f"x {a} y {b}", f"{b} {a}", "plain text", ""]
    tokenizer, encoder = Tokenizer.from_file(tokenizer_path()), Encoder(tokenizer_path())
    for _ in range(2):  # the second time all chunks are known
        got = []
        for _, _, ids, ends in encoder.encode(pa.array(texts)):
            got += [x.tolist() for x in np.split(ids, ends[:-1])]
        assert got == [tokenizer.encode(x, add_special_tokens=False).ids for x in texts]


def test_encoder_gives_the_tokenizers_ids():
    from tokenizers import Tokenizer

    from caseloom.llm._bpe import Encoder

    texts = ["", " ", "  \n a  b\n\n c ", "x'll don't it's", "é×a ÷ñ <|endoftext|> z", "日本 語 a", "a\t\tb \x0b", "9a9 8", "tail  \n", " lead", "Ää öß ñ. ¿qué?", "a" * 5000]
    encoder, tokenizer, got = Encoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path()), []
    for _, _, ids, ends in encoder.encode(pa.array(texts)):
        got += [x.tolist() for x in np.split(ids, ends[:-1])]
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_mix(docs, corpus):
    got = mix_sources(docs).collect()
    assert sorted((r.doc_id, r["size"]) for r in got) == sorted((i, len((t or "").split())) for i, t in corpus)
    assert all(r.taken <= 3 * r["size"] and (not r["size"] or r.taken % r["size"] == 0) for r in got)
    total, by = sum(r["size"] for r in got), collections.defaultdict(list)
    for r in got:
        by[r.source].append(r)
    size = {s: sum(r["size"] for r in rows) for s, rows in by.items()}
    target, left, free = {}, float(total), {s: 1 + i % 3 for i, s in enumerate(sorted(size, key=lambda s: (s is None, s or "")))}
    while free:  # cap and reshare until none is above
        share = {s: left * w / sum(free.values()) for s, w in free.items()}
        over = [s for s in free if share[s] > 3 * size[s]]
        target |= {s: 3.0 * size[s] for s in over} if over else share
        left -= sum(3.0 * size[s] for s in over)
        free = {s: w for s, w in free.items() if s in over or over} if not over else {s: w for s, w in free.items() if s not in over}
        if not over:
            break
    for s, rows in by.items():
        assert rows[0].target == pytest.approx(target[s]) and rows[0].source_size == size[s]
        assert abs(sum(r.taken for r in rows) - target[s]) <= max(r["size"] for r in rows)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mix_sources(docs.repartition(7)).collect()), key=repr)


@pytest.mark.parametrize("limit", [20, 2000])
def test_fit_reaches_the_best_sum(limit):
    r = np.random.default_rng(1)
    for _ in range(60):
        lengths = np.unique(r.integers(1, 50, 7))
        counts, budget = r.integers(1, 8, len(lengths)), int(r.integers(0, 900))
        take = fit(lengths, counts, budget, limit)
        reached = {0}
        for length, count in zip(lengths.tolist(), counts.tolist(), strict=True):
            reached |= {x + k * length for x in reached for k in range(1, count + 1)}
        best = max(x for x in reached if x <= budget)
        assert (take >= 0).all() and (take <= counts).all() and best - 50 <= (take * lengths).sum() <= best


def test_toxicity(spark):
    r = random.Random(3)
    rows = []
    for i in range(600):
        bad = i % 5 == 0
        text = words(60, i, 500).split()
        if bad:
            text[r.randrange(60)] = "vileword" + r.choice(["a", "er", "ung"])
        rows.append((i, " ".join(text), int(bad)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000, None), (1001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(1000, None)], "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity(docs, labels, Toxicity(epochs=2)).collect()}
    assert len(got) == 602 and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7) and x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) for x in got.values())
    out = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert sum(p == y for p, y in out) >= 0.95 * len(out)
    assert {x.score for x in toxicity(docs, labels.filter("toxic = 0")).collect()} == {0.1}


def test_toxicity_moves_reach_the_driver_in_parts(spark, monkeypatch):
    from caseloom.llm import toxicity as module

    docs = spark.createDataFrame([(i, f"word{i % 7} filler{i % 11} " + ("vile" if i % 4 == 0 else "kind")) for i in range(300)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    scores = lambda: [x.score for x in toxicity(docs, labels, Toxicity(epochs=1)).orderBy("doc_id").collect()]
    wanted, real, taken = scores(), type(docs).collect, []
    monkeypatch.setattr(module, "MOVES", 16)
    monkeypatch.setattr(module, "BLOCKS", 1)
    monkeypatch.setattr(type(docs), "collect", lambda self: (taken.append(self.columns), real(self))[1])
    got = scores()
    assert got == pytest.approx(wanted, abs=1e-3)
    assert taken and not any("moves" in columns for columns in taken)  # neither all networks' moves at once


def test_toxicity_shuffles_texts_that_may_have_a_label(spark):
    from caseloom.llm.toxicity import labelled_rows, perhaps_labelled, usable_labels

    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    labels = docs.filter("doc_id % 5 = 0").select("doc_id", F.lit(1).alias("toxic"))
    usable = {r.doc_id for r in usable_labels(labels).collect()}
    assert usable <= (kept := {r.doc_id for r in perhaps_labelled(docs, usable_labels(labels)).collect()}) and len(kept) < len(usable) + 30
    assert {r.text for r in labelled_rows(docs, labels).collect()} == {f"text {i}" for i in usable}
    named = labels.select(F.col("doc_id").cast("string"), "toxic")  # ids of another type
    assert labelled_rows(docs, named).count() == len(usable)
    assert labelled_rows(docs.withColumn("doc_id", F.col("doc_id").cast("string")), named).count() == len(usable)


def test_toxicity_thresholds_follow_the_whole_tables_ratio(spark):
    r, rows = random.Random(4), []
    for i in range(2700):  # of nine rows one is toxic; sign0 to sign9 say so less and less
        bad = i % 9 == 0
        sign = r.choices(range(10), range(10, 0, -1) if bad else range(1, 11))[0]
        rows.append((i, " ".join(r.choice("abcdefgh") * 3 for _ in range(8)) + f" {sign}sign", int(bad)))
    docs, labels = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string"), spark.createDataFrame([x[::2] for x in rows], "doc_id long, toxic int")
    got = {x.doc_id: x.predicted for x in toxicity(docs, labels, Toxicity(most_rows=(150, 150))).collect()}
    # Signs 0 to 4 are likelier in toxic rows, but only sign 0 stands in more toxic rows than clean ones.
    assert np.mean([got[i] for i, _, y in rows if not y]) < 0.15 and np.mean(list(got.values())) > 0


def test_exact_with_and_without_colliding_digests(docs, corpus, empty):
    norm = lambda t: "".join(c for c in (t or "") if c not in " \t\n\x0b\x0c\r")
    groups = collections.defaultdict(list)
    for i, t in corpus:
        groups[norm(t)].append((-len(t or ""), i))
    want = sorted((i, min(groups[norm(t)])[1], len(groups[norm(t)]), min(groups[norm(t)])[1] == i, hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in corpus)
    short = Exact(digest=lambda text: F.substring(F.sha2(text, 256), 1, 1), arrivals=3)
    for p in (Exact(), short):
        assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_duplicates(docs, p).collect()) == want
    kept = without_copies(docs, short)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [x[0] for x in want if x[3]]
    assert exact_duplicates(empty).count() == 0


def test_exact_state_outlives_a_run(spark, tmp_path):
    """Later arrivals meet retained digests; their bytes are checked against the content at the locator, in an earlier arrival."""
    store, p = str(tmp_path / "store"), Exact(digest=lambda text: F.when(text.isin("x", "y"), F.lit("same")).otherwise(F.sha2(text, 256)))
    batch = lambda *rows: {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), p, store).collect()}
    assert batch((5, "a b"), (7, "c"), (20, "x")) == {(5, 5, 1, True), (7, 7, 1, True), (20, 20, 1, True)}
    assert {(r.first.arrival, r.n) for r in seen(spark, store).collect()} == {(0, 1)}
    assert batch((2, "ab"), (3, "a  b"), (9, "d")) == {(2, 3, 3, False), (3, 3, 3, True), (9, 9, 1, True)}
    assert {(r.first.arrival, r.n, r.keep.doc_id) for r in seen(spark, store).collect()} == {(0, 3, 3), (0, 1, 7), (1, 1, 9), (0, 1, 20)}
    assert batch((21, "y"), (22, " y"), (23, "x")) == {(21, 22, 2, False), (22, 22, 2, True), (23, 20, 2, False)}


def test_repeated_rows_keep_one(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (None, None), (None, ""), (None, " ")], "doc_id long, text string")
    got = exact_duplicates(docs).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got if r.doc_id) == [(1, 1, 3, False), (1, 1, 3, True), (2, 1, 3, False)]
    assert sorted((r.keep_id, r.group_size, r.kept) for r in got if not r.doc_id) == [(None, 3, False), (None, 3, False), (None, 3, True)]


@pytest.mark.parametrize("p", [MinMax(words=3, percent=85), MinMax(), MinMax(block=4)])
def test_near_duplicates(docs, corpus, p):
    sets = {}
    for i, t in corpus:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + p.words]) for k in range(len(w) - p.words + 1)} if len(w) >= p.words else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= p.percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = {r.doc_id: r for r in near_duplicates(docs, p).collect()}
    assert {i: (len(sets[i]), root(i), root(i) == i) for i in sets} == {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()}


def test_near_duplicates_without_ids_and_with_repeated_rows(spark):
    one, two, three = (words(60, k) for k in (301, 302, 303))
    rows = [(4, one), (4, one), (None, one), (9, one + " more"), (None, two), (None, two), (None, two + " more"), (5, three), (None, None), (6, "")]
    got = near_duplicates(spark.createDataFrame([(i, t, 1, "b") for i, t in rows], "doc_id long, text string, id int, bands string"), MinMax()).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in got), key=repr) == sorted(
        [(4, 4, True), (4, 4, True), (None, 4, False), (9, 4, False), (None, None, True), (None, None, True), (None, None, True), (5, 5, True), (None, None, True), (6, 6, True)], key=repr
    )


def test_signatures_estimate_the_similarity():
    one = words(400, 310).split()
    other = one[:300] + words(100, 311).split()
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([" ".join(one), " ".join(other)])], ["doc_id", "text"])
    x, y = (np.frombuffer(v, np.uint16) for v in next(signature_batches(iter([batch]), MinMax(words=1))).column("values").to_pylist())
    true = len(set(one) & set(other)) / len(set(one) | set(other))
    assert len(x) == 120 and len(set(x.tolist())) > 100 and abs((x == y).mean() - true) < 0.15


def test_lines(docs, corpus):
    first, want = {}, {}
    for i, t in sorted(corpus):
        spans, left, at = [], [], 0
        for line in (t or "").split("\n"):
            key = " ".join(line.lower().split())
            if len(key.split()) >= 5 and first.setdefault(key, (i, at)) != (i, at):
                spans.append((at, len(line)))
            else:
                left.append(line)
            at += len(line) + 1
        want[i] = (len((t or "").split("\n")), spans, "\n".join(left))
    assert {r.doc_id: (r.n_units, [tuple(s) for s in r.spans], r.cleaned) for r in drop_repeated_lines(docs).collect()} == want


def test_sentences_inside_lines(spark):
    passage = "A passage of several words stands here. Its second sentence is also quite long! "
    texts = {1: passage + "Only the first one says this much.", 2: "Other prose comes first in this one. " + passage + "Then 3.5 more words follow it.\n" + passage.strip() + "\nEnd"}
    texts |= {3: None, 4: passage * 2}
    first, want = {}, {}
    for i, t in texts.items():
        spans, lines, at, n = [], [], 0, 0
        for line in (t or "").split("\n"):
            units, begin = [], 0
            for k, c in enumerate(line):
                if c == " " and line[k - 1] in ".!?":
                    units.append(line[begin : k + 1])
                    begin = k + 1
            left, cut = "", False
            for unit in [*units, line[begin:]]:
                key = " ".join(unit.lower().split())
                if len(key.split()) >= 5 and first.setdefault(key, (i, at)) != (i, at):
                    spans.append((at, len(unit)))
                    cut = True
                else:
                    left += unit
                at, n = at + len(unit), n + 1
            lines += [left] if left.strip() or not cut else []
            at += 1
        want[i] = (n, spans, "\n".join(lines))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert want[2][2] == "Other prose comes first in this one. Then 3.5 more words follow it.\nEnd"
    assert {r.doc_id: (r.n_units, [tuple(s) for s in r.spans], r.cleaned) for r in drop_repeated_lines(docs, Lines(stops=".!?")).collect()} == want


def test_sentence_query_gives_what_its_sql_gives(spark):
    import duckdb

    from caseloom.llm.queries import ORACLES, QUERIES

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    got, want = QUERIES["op1_sentence_dedup"](spark, sf), con.execute(ORACLES["op1_sentence_dedup"])
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_fingerprints(docs, corpus):
    got = sorted(fingerprints(docs).collect(), key=lambda r: r.doc_id)
    rows, errors = sorted(corpus), []
    for k, ((_, text), r) in enumerate(zip(rows, got, strict=True)):
        a, b = text or "", rows[(k + 1) % len(rows)][1] or ""
        edited = a[: len(a) - len(a) // 4] + b[: len(a) // 4]
        assert r.n_chars == len(a) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        x, y = collections.Counter(a.split()), collections.Counter(edited.split())
        if a.split():
            errors.append(r.near_edited - sum((x & y).values()) / sum((x | y).values()))
    assert abs(np.mean(errors)) < 0.05 and np.std(errors) < 0.15
    assert len({r.fingerprint for r in got if 10 <= r.doc_id < 30}) == 1


def test_urls(spark):
    listed = spark.createDataFrame([("org", "/", "allow"), ("example.org", "/es/", "block"), ("com", "/de/", "block")], "host string, path string, verdict string")
    urls = ["http://A.Example.ORG/es/1?q", "https://example.org/x", "http://notexample.org/es/", "http://x.com/de/1", "http://x.com/de", "x.com/de/", None, "http://org", "http://org/", "http://y.net/z#f", "://?"]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), listed).collect()}
    assert got == {
        0: ("a.example.org", "/es/1", "example.org/es/", "block"), 1: ("example.org", "/x", "org/", "allow"), 2: ("notexample.org", "/es/", "org/", "allow"), 3: ("x.com", "/de/1", "com/de/", "block"), 4: ("x.com", "/de", None, "allow"),
        5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("org", "", None, "allow"), 8: ("org", "/", "org/", "allow"), 9: ("y.net", "/z", None, "allow"), 10: ("", "", None, "allow"),
    }


def test_urls_with_many_listed_lengths_repeats_and_odd_rows(spark, tmp_path):
    path = "/" + "abcdefghij" * 130
    listed = [("x.org", path[:n], "block" if n % 2 else "allow") for n in range(1, 1200)] + [("y.org", "/", "block"), ("y.org", "/", "allow"), (None, "/", "block"), ("z.org", None, "block")]
    listed = spark.createDataFrame(listed, "host string, path string, verdict string")
    urls = [(1, "http://a.x.org" + path[:1150]), (1, "http://a.x.org" + path[:1150]), (2, "http://x.org" + path), (None, "http://y.org/"), (3, None), (4, "http://z.org/" + "q" * 50_000)]
    pages = spark.createDataFrame([(i, u, "r", "h", 1) for i, u in urls], "page_id long, url string, rule string, host string, len int")
    want = [(None, "y.org/", "allow"), (1, "x.org" + path[:1150], "allow"), (1, "x.org" + path[:1150], "allow"), (2, "x.org" + path[:1199], "block"), (3, None, "allow"), (4, None, "allow")]
    for p in (Filter(), Filter(most_sent=0)):
        assert sorted(((r.page_id, r.rule, r.verdict) for r in judge(pages, listed, p).collect()), key=repr) == sorted(want, key=repr)
    assert judge(pages.limit(0), listed).count() == 0 and {r.verdict for r in judge(pages, listed.limit(0), Filter(default="block")).collect()} == {"block"}


def test_tools(spark):
    rows = [
        ("a", "f", '{"z": 1, "q": "x"}', None), ("b", "f", '{"q": ""}', ["a", "a", None]), ("c", "f", "[1]", ["b"]), ("d", "g", "{}", ["nobody"]), ("e", "f", '{"q": "y", "z": 9}', ["h"]), ("h", "f", '{"q": "y", "z": 1.5}', ["e"]),
        ("i", "f", '{"q": 5}', ["a", "c"]), ("j", "f", '{"q": "y", "on": "no"}', ["i", "d"]), ("k", "f", '{"q": "y", "on": true, "more": [1]}', ["j"]), ("l", "f", None, ["e", "a"]), ("m", "f", "", ["l"]), ("n", "f", '{"q": "' + "long " * 50_000 + '"}', ["n"]),
        ("d", "g", "{}", ["k"]), (None, "f", "{}", ["a"]),
    ]
    calls = spark.createDataFrame([(*r, 0, "x") for r in rows], "call_id string, name string, arguments string, after array<string>, level int, content string").repartition(3)
    results = spark.createDataFrame([("a", "r2"), ("a", "r1"), ("x", "lost"), (None, "none")], "call_id string, content string")
    tools = spark.createDataFrame([("f", [("q", "string", True, None), ("z", "integer", False, 5.0), ("on", "boolean", False, None), ("more", "object", False, None)])], "name string, fields array<struct<field:string,type:string,required:boolean,most:double>>")
    out = link_tools(calls, results, tools).collect()
    got = {r.call_id: r for r in out}
    assert len(out) == len(rows) and {k: (r.linked, r.level, r.errors) for k, r in got.items()} == {
        "a": (True, 0, ""), "b": (False, 1, "q is empty"), "c": (False, 2, "no object"), "d": (False, None, "no schema"), "e": (False, None, "z is too large"), "h": (False, None, "z is no integer"),
        "i": (False, 3, "q is no string"), "j": (False, None, "on is no boolean"), "k": (False, None, "more is no object"), "l": (False, None, "no object"), "m": (False, None, "no object"), "n": (False, None, ""), None: (False, None, "q is missing"),
    }
    assert [r.call_id for r in out][:4] == ["a", "b", "c", "i"]
    assert got["a"].json == '{"arguments":{"q":"x","z":1},"id":"a","level":0,"name":"f","result":"r1"}' and json.loads(got["b"].json)["arguments"] == {"q": ""}
    assert [r.content for r in orphans(calls, results).collect()].count("lost") == 1
    assert link_tools(calls.limit(0), results, tools).count() == 0 and link_tools(calls, results.limit(0), tools.limit(0)).filter("errors = 'no schema'").count() == len(rows)


def test_levels_are_the_longest_ways(spark):
    r, names = random.Random(6), [f"c{i:03d}" for i in range(120)]
    waits = {n: r.sample(names[:i], min(i, r.choice([0, 1, 1, 1, 2, 3]))) for i, n in enumerate(names)}
    waits |= {f"x{i:03d}": [f"x{i - 1:03d}"] if i else [] for i in range(300)}
    waits["x150"] = ["x149", "c119", "x003"]
    want: dict[str, int] = {}
    for n, others in waits.items():
        want[n] = 1 + max((want[o] for o in others), default=-1)
    got = levels(spark.createDataFrame(list(waits.items()), "call_id string, after array<string>")).collect()
    assert {x.call_id: x.level for x in got} == want


def test_pages(spark):
    page = '<html><head><title>T</title></head><body><nav><ul><li><a href="/x">Home</a></li></ul></nav><div class="ad">Buy this now, it is cheap.</div><article><h1>Head &amp; line</h1><p><b>Some  words\nof the story, and more.<br><p>Second paragraph here.</p></article><footer>&copy; us &middot; All words reserved.</footer></body></html>'
    want = "Head & line\n\nSome words of the story, and more.\n\nSecond paragraph here."
    pages = spark.createDataFrame([(i, "u", page) for i in range(30)] + [(50, None, None), (51, "u", ""), (52, "u", page[: page.index("</article>") + 4])], "page_id long, url string, html string")
    got = {r.page_id: r for r in extract(pages).collect()}
    assert {got[i].text for i in range(30)} == {want} and got[50].text == got[51].text == "" and got[52].text == want and got[0].n_chars == len(want)
    model = learn_pages([page] * 30)
    plain = '<body><header><h1>Site</h1></header><div class="content"><h2>Head</h2><p>First long paragraph of the story with many words in it, and more.</p><form><label>Name</label></form></div><aside>Aside words are here, quite long ones.</aside><section class="comments"><p>I think that this was a great article, really great.</p></section></body>'
    assert main_text(plain, model) == "Head\n\nFirst long paragraph of the story with many words in it, and more."


@pytest.mark.parametrize(
    "before, after",
    [
        ("<html class='no-js has-sidebar'><body class='single has-sidebar'><article>", "</article></body></html>"),
        ("<body><div id='content' class='with-sidebar'>", "</div></body>"),
        ("<body><div class='with-sidebar'><article>", "</article></div></body>"),
        ("<body><article class='post category-social'>", "</article></body>"),
        ("<body class='has-sidebar'><div class='with-sidebar'><main><article class='post tag-ads'>", "</article></main></div></body>"),
    ],
)
def test_names_do_not_empty_the_page(before, after):
    first, second = "First long paragraph of the story with many words in it, and more.", "Second paragraph of it, also with many words, and then it ends."
    ad, menu = "<div class='ad'>Buy this now, it is cheap.</div>", "<nav><a href='/'>Home</a></nav>"
    talk = "<div id='comments' class='comments-area'><ol class='comment-list'><li class='comment'><article class='comment-body'><p>I think that this was a great article, really great.</p></article></li></ol></div>"
    model = learn_pages([f"<body>{menu}{ad}<article><h1>Head</h1><p>{first}</p><p>{second}</p></article><footer>All words reserved.</footer></body>"] * 30)
    assert main_text(f"{before}{menu}{ad}<p>{first}</p><p>{second}</p>{talk}{after}", model) == f"{first}\n\n{second}"


@pytest.mark.parametrize("run", [lambda d: pack(d, Packing(tokenizer_path())), mix_sources, near_duplicates, drop_repeated_lines, fingerprints, lambda d: toxicity(d, d.select("doc_id", F.lit(1).alias("toxic")))])
def test_empty_tables(empty, run):
    assert run(empty).count() == 0


def test_fingerprints_are_those_of_each_text_alone(spark):
    """The fingerprint of an edited text is what the same text has as a document; likeness is the share of equal samples."""
    texts = [words(200, 400), words(90, 401) + " " + words(50, 402), "one two three four", "a", "", None, " \n", "x" * 5000, words(30, 403) + "\n", words(200, 400), "ab cd"]
    rows = [(3 * i, t) for i, t in enumerate(texts)]
    got = sorted(fingerprints(spark.createDataFrame([(i, t, 1, "s", 2) for i, t in rows], "doc_id long, text string, side int, term string, row int")).collect(), key=lambda r: r.doc_id)
    edited = []
    for k, (_, t) in enumerate(rows):
        a, b = t or "", texts[(k + 1) % len(texts)] or ""
        edited.append(a[: len(a) - len(a) // 4] + b[: len(a) // 4])
    alone = sorted(fingerprints(spark.createDataFrame(list(enumerate(edited)), "doc_id long, text string")).collect(), key=lambda r: r.doc_id)
    share = lambda x, y: sum(x[8 * k : 8 * k + 8] == y[8 * k : 8 * k + 8] for k in range(32)) / 32
    for k, r in enumerate(got):
        assert r.edited_fingerprint == alone[k].fingerprint and r.near_edited == share(r.fingerprint, r.edited_fingerprint)
        assert r.near_next == share(r.fingerprint, got[(k + 1) % len(got)].fingerprint)
    assert len({got[k].fingerprint for k in (4, 5, 6)}) == 1 and got[0].fingerprint == got[9].fingerprint != got[1].fingerprint
