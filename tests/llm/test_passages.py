"""Passage deduplication against a plain reading of its rule: passages inside lines, overlaps, nulls, repeated rows, long texts."""

import random
import re

import pytest

from caseloom.llm.passages import Passages, drop_repeated_passages

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed, sentences):
    r = random.Random(seed)
    return " ".join(" ".join(f"v{r.randrange(3000)}" for _ in range(r.randrange(6, 18))) + r.choice([".", "!", ", and", ";", "?"]) for _ in range(sentences))


def plain(rows, p):
    """What the rule says, paragraph by paragraph, in order of doc_id (null last)."""
    first, out = {}, {}
    for i, text in sorted(set(rows), key=lambda x: (x[0] is None, x[0] or 0)):
        text = text or ""
        found = list(WORD.finditer(text))
        words = [m[0].lower() for m in found]
        begins = [k for k in range(len(words)) if (k == 0 or words[k - 1][-1] in p.stops or p.end in text[found[k - 1].end() : found[k].start()]) and k + p.words <= len(words)]
        gone = set()
        for k in begins:
            doc, at = first.setdefault(tuple(words[k : k + p.words]), ((i, text), k))
            gone |= set(range(k if doc != (i, text) else max(k, at + p.words) if at != k else k + p.words, k + p.words))
        starts, spans, left, at = [m.start() for m in found] + [len(text)], [], [], 0
        for k in sorted(gone):
            if k - 1 in gone:
                spans[-1] = (spans[-1][0], starts[k + 1] - spans[-1][0])
            else:
                spans.append((starts[k], starts[k + 1] - starts[k]))
        for start, length in spans:
            left.append(text[at:start])
            at = start + length
        out[i, text] = (len(begins), spans, "".join([*left, text[at:]]))
    return out


@pytest.mark.parametrize("p", [Passages(), Passages(words=8, stops=".")])
def test_passages(spark, p):
    passage = prose(1, 6)
    rows = [(1, prose(2, 4) + " " + passage + "\n" + prose(3, 3)), (2, prose(4, 5) + " mid line " + passage + " and on. " + prose(5, 2)), (3, passage), (4, passage.upper().replace(" ", "\n")), (5, None), (6, ""), (7, " \n\t"), (8, "short one."), (9, "is, " * 200 + "end"), (10, "same " * 300), (11, prose(6, 4) + " é日本 " + passage)]
    rows += [(12, prose(1, 6) + " " + prose(1, 6)), (13, prose(7, 4000) + " " + passage), (14, prose(8, 5)), (14, prose(8, 5)), (None, passage + " tail."), (None, passage + " tail.")]
    docs = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], "doc_id long, text string, at string, parts string, h int").repartition(3)
    got = drop_repeated_passages(docs, p).collect()
    want = plain(rows, p)
    texts = {i: t for i, t in rows}
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_units, [tuple(s) for s in r.spans], r.cleaned) == want[r.doc_id, texts[r.doc_id] or ""], r.doc_id
    assert want[2, rows[1][1]][1] and want[1, rows[0][1]][1] == [] and (p != Passages() or len(want[3, passage][2]) < len(passage) / 2)


def test_empty_table(spark):
    assert drop_repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("name", ["op1_line_dedup", "op5_tool_linking", "op6_exact_dedup", "op7_url_filter"])
def test_query_gives_what_its_sql_gives(spark, name):
    import duckdb

    from caseloom.llm.queries import ORACLES, QUERIES

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("documents", "pages", "conversations"):
        con.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(tuple(r[c] for c in names) for r in QUERIES[name](spark, sf).collect()) == sorted(want.fetchall())
