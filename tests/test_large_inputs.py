"""Inputs that are odd by their size: long lines, many rows in one file."""

import re

from pyspark.sql import functions as F

from caseloom.functions.anchors import anchor


def _anchored(spark, rows):
    none = F.lit(None).cast("int")
    got = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, text string, snippet string").select("i", anchor(F.col("text"), F.col("snippet"), none, none).alias("x"))
    return [tuple(r.x) for r in got.orderBy("i").collect()]


def test_a_long_respaced_line_is_anchored(spark):
    line = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
    text = "Before it.\n" + line + "\nand after"
    assert _anchored(spark, [(text, line.replace(" ", "  "))]) == [("EXACT", "spaced", 11, 11 + len(line))]


def test_respaced_snippets_equal_a_pattern(spark):
    texts = ["\n\n  one  two\t\tthree (four) \\d five.  One two three (four) \\d six", "a\nb  a b c d e f  a  b c d e f g", "x" * 12 + " \n y ?+* z", "one two three four"]
    snippets = ["two three  (four)", "THREE  (four) \\d  five.", "a b  c d e  f", " b  a b\tc d", "\n\n  one  two\t", "xxxxxx  y ?+*  z", "two\nthree four\n", "one  two three five", "\ttwo  three \\d"]
    rows = [(t, s) for t in texts for s in snippets]
    for (text, snippet), got in zip(rows, _anchored(spark, rows), strict=True):
        if got[1] in ("exact", "clause") or snippet.strip(" ").lower() in text.lower():
            continue
        found = list(re.finditer(r"\s+".join(map(re.escape, re.split(r"\s+", snippet.strip(" ").lower()))), text.lower()))
        want = ("EXACT", "spaced", *found[0].span()) if len(found) == 1 else ("MULTIPLE_OCCURRENCES" if found else "NOT_FOUND", None, None, None)
        assert got == want or len(re.sub(r"\s+", " ", snippet.strip(" "))) < 10, (text, snippet)


def test_toxicity_learns_from_rows_beyond_any_sample(spark):
    from caseloom.llm.toxicity import Toxicity, toxicity

    # 5,400 labelled rows; a second sign of toxic texts stands in long ones only, over 2,000 words
    filler = [f"w{i}" for i in range(50)]
    rows = []
    for i in range(7200):
        long_, bad = i % 60 == 0, i % 9 == 0
        text = [filler[(i * 7 + j * (1 + i % 5)) % 50] for j in range(2100 if long_ else 12)]
        if bad or (long_ and i % 120 == 0):
            text[i % 11] = "latevile" if long_ else "vileword"
        rows.append((i, " ".join(text), int(bad or (long_ and i % 120 == 0))))
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([r[::2] for r in rows], "doc_id long, toxic int")
    probe = docs.unionByName(spark.createDataFrame([(10_000, "w1 latevile w2"), (10_001, "w1 w3 w2")], "doc_id long, text string"))
    got = {r.doc_id: r for r in toxicity(probe, labels, Toxicity()).collect()}
    assert got[10_000].score > got[10_001].score and got[10_000].predicted == 1 and got[10_001].predicted == 0
    out = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert sum(p == y for p, y in out) >= 0.97 * len(out)


def test_records_are_dealt_before_they_become_facts(spark):
    from caseloom.operators.ledger import unfold
    from caseloom.operators.shared import DEALT, dealt

    rows = spark.range(3 * DEALT).coalesce(1).select(F.col("id").alias("k"), F.col("id").cast("string").alias("a"), F.lit("x").alias("b"))
    facts = unfold(rows, "k", ["a", "b"])
    sizes = [n for (n,) in facts.groupBy(F.spark_partition_id().alias("p")).count().select("count").collect()]
    assert len(sizes) == 3 and sum(sizes) == 6 * DEALT and max(sizes) < 3 * DEALT
    assert dealt(rows.limit(0), "k").count() == 0


def test_candidates_are_judged_in_tasks_by_number_of_rows(spark):
    from caseloom.operators.envelope import distinct_facts, judge_candidates
    from caseloom.plans.casework import envelopes

    facts, evidence = envelopes(lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet"))
    judged = judge_candidates(distinct_facts(facts), evidence)
    plan = judged._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression [envelope_id") >= 2  # else as much as is read of packed rows would be sorted at once
    assert judged.count() == evidence.count()
