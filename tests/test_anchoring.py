"""Snippets placed in their documents: against a plain vote in Python, and how near changed lines come to where they were."""

import collections
import re

from pyspark.sql import functions as F

from caseloom.operators.anchoring import place_snippets, shared_runs
from caseloom.operators.cases import ground_questions, narrative
from caseloom.operators.review import with_attachments
from caseloom.plans.reading import changed_snippets

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"


def _vote(text, snippet, k=3, slack=2):
    spans = [(m.start(), m.end()) for m in re.finditer(WORD, text)]
    words, own = re.findall(WORD, text.lower()), re.findall(WORD, snippet.lower())
    where = collections.defaultdict(list)
    for i in range(len(words) - k + 1):
        where[tuple(words[i : i + k])].append(i)
    votes = collections.defaultdict(lambda: [set(), [], 0])
    for at in range(len(own) - k + 1):
        for place in where[tuple(own[at : at + k])]:
            votes[place - at][0].add(at)
            votes[place - at][1].append(place)
    if votes:
        total = lambda d: sum(len(votes[x][0]) for x in range(d - slack, d + slack + 1) if x in votes)
        best = min(list(votes), key=lambda d: (-total(d), -len(votes[d][0]), d))
        places = [p for x in range(best - slack, best + slack + 1) if x in votes for p in votes[x][1]]
        return "runs", spans[min(places)][0], spans[max(places) + k - 1][1]
    at = text.lower().find(snippet.strip().lower()) if snippet.strip() else -1
    return ("clause", at, at + len(snippet.strip())) if at >= 0 else (None, None, None)


def test_texts_move_and_their_runs_do_not(spark, capsys):
    snippets = spark.createDataFrame([(0, 1, "b c d e"), (0, 2, "b c d"), (None, 1, "a b c")], "document_id long, n int, snippet string")
    texts = spark.createDataFrame([(0, "a b c d e"), (0, "b c d"), (None, "a b c"), (1, "b c d")], "document_id long, text string")
    got = shared_runs(snippets, texts, 3)
    assert sorted(map(tuple, got.collect())) == [(0, 1, 0, 0), (0, 1, 0, 1), (0, 1, 1, 2), (0, 2, 0, 0), (0, 2, 0, 1)]
    place_snippets(snippets, texts).explain()
    moved = [x for x in capsys.readouterr().out.splitlines() if "Exchange hashpartitioning" in x]
    assert moved and not any("run#" in x for x in moved)


def test_places_equal_a_plain_vote(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    snippets = changed_snippets(lambda name: docs)
    texts = docs.select(F.col("doc_id").alias("document_id"), "text")
    got = place_snippets(snippets, texts).collect()
    whole = {r.document_id: r.text for r in texts.collect()}
    near = cut = 0
    for r in got:
        assert (r.tier, r.char_start, r.char_end) == _vote(whole[r.document_id], r.snippet), (r.document_id, r.n)
        if r.n == 1 and len(r.snippet.split()) >= 8:
            lines = [x for x in whole[r.document_id].split("\n") if len(x.strip()) > 40]
            line = lines[len(lines) // 2] if lines else whole[r.document_id]
            true = whole[r.document_id].find(line)
            cut += 1
            near += r.char_start is not None and any(abs(m.start() + len(line) - len(line.lstrip()) - r.char_start) <= 60 for m in re.finditer(re.escape(line), whole[r.document_id])) and true >= 0
    assert cut > 100 and near / cut >= 0.98, (near, cut)


def test_odd_snippets(spark):
    texts = spark.createDataFrame([(1, "  The cat sat on a mat. The dog sat on a log."), (2, ""), (3, None)], "document_id int, text string")
    rows = [(1, 1, "cat sat on"), (1, 2, "The dog"), (1, 3, " "), (1, 4, "the dog quickly sat on a log."), (1, 5, "nowhere to be seen"), (2, 1, "a b c"), (3, 1, "a"), (9, 1, "x y z"), (1, 6, None)]
    got = {(r.document_id, r.n): (r.tier, r.char_start, r.char_end) for r in place_snippets(spark.createDataFrame(rows, "document_id int, n int, snippet string"), texts).collect()}
    assert got[1, 1] == ("runs", 6, 16) and got[1, 2] == ("clause", 24, 31) and got[1, 4][0] == "runs"
    assert all(got[k] == (None, None, None) for k in ((1, 3), (1, 5), (2, 1), (3, 1), (9, 1), (1, 6)))


def test_questions_meet_their_citations(spark):
    body = "Dear all,\n1. Is it safe with milk? And (2) how long does it keep at home in the fridge? ok?"
    asked = [("c", 0, "Is it safe with milk", body), ("c", 1, "(2) how long does it keep at home in the fridge", body), ("c", 2, "ok", body), ("d", 0, "1. Is it safe with milk", body), ("e", 0, "where is my parcel now", "nothing")]
    cited = [("c", 1, "question_1", ""), ("c", 2, "mi_question_1", "By number"), ("c", 3, "other", "He said: (2) HOW LONG DOES IT keep, roughly")]
    got = ground_questions(spark.createDataFrame(asked, "case_id string, n int, question string, body string"), spark.createDataFrame(cited, "case_id string, pos int, name string, snippet string"))
    rows = {(r.case_id, r.n): (r.tier, r.snippet, r.char_start, r.char_end) for r in got.collect()}
    assert rows["c", 0] == ("key", "By number", None, None) and rows["c", 1][0] == "snippet"
    assert rows["c", 2] == ("snippet", "He said: (2) HOW LONG DOES IT keep, roughly", None, None) or rows["c", 2] == (None, None, None, None)
    assert rows["d", 0] == ("body", "Is it safe with milk", 13, 33) and rows["e", 0] == (None, None, None, None)


def test_narratives_and_attachments(spark):
    cases = spark.createDataFrame([("Told", "s", "r"), ("", "Not stated", "r"), (None, None, None), ("Not stated", "s", "")], "clinical_narrative string, document_summary string, reviewer_summary string")
    assert [r[0] for r in cases.select(narrative()).collect()] == ["Told", "r", "Not stated", "s"]
    files = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("gone", 1, "z")], "message_id string, pos int, filename string")
    got = {r.message_id: [(a.pos, a.filename) for a in r.attachments] for r in with_attachments(spark.createDataFrame([("a",), ("b",)], "message_id string"), files).collect()}
    assert got == {"a": [(1, "x"), (2, "y")], "b": []}
