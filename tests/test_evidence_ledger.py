from pyspark.sql import functions as F

from caseloom.operators import evidence as E
from caseloom.operators import ledger as L


def chunks(spark):
    docs = spark.createDataFrame([(1, "Lot ABC-123 was bad\n\nPatient is 58-year-old"), (2, "Lot XYZ-999 here")], "doc_id long, text string")
    return E.chunk_lines(docs)


def test_offsets_count_blank_lines(spark):
    docs = spark.createDataFrame([(1, "ab\n\ncd")], "doc_id long, text string")
    assert [(r.pos, r.char_start, r.char_end) for r in E.chunk_offsets(docs).orderBy("pos").collect()] == [(0, 0, 2), (2, 4, 6)]


def test_facts_never_find_evidence_in_another_document(spark):
    facts = spark.createDataFrame([(1, "lot", "ABC-123"), (2, "lot", "ABC-123"), (1, "x", "Not stated")], "document_id long, field string, value string")
    got = E.retrieve(facts, chunks(spark)).collect()
    assert [(r.document_id, r.field, r.pos, r["rank"]) for r in got] == [(1, "lot", 0, 1)]


def test_entailment_order(spark):
    rows = [("adverse event", "no adverse event"), ("ABC123", "lot abc-123"), ("fever", "patient denies pain"), ("fever", "sunny"), ("n/a", "x"), ("fever", "")]
    got = [tuple(r.e) for r in spark.createDataFrame(rows, "v string, s string").select(E.entails(F.col("v"), F.col("s")).alias("e")).collect()]
    assert got == [("SUPPORTS", 0.99), ("SUPPORTS", 0.98), ("CONTRADICTS", 0.92), ("INSUFFICIENT", 0.35), ("INSUFFICIENT", 1.0), ("INSUFFICIENT", 0.0)]
    first = spark.createDataFrame(rows[:1], "v string, s string").select(E.entails(F.col("v"), F.col("s"), True).alias("e")).first().e
    assert first.result == "CONTRADICTS"


def test_state_and_reconciliation(spark):
    rows = spark.createDataFrame([(1, "SUPPORTS"), (1, "CONTRADICTS"), (2, "SUPPORTS"), (3, "INSUFFICIENT")], "f int, result string")
    assert {r.f: r.state for r in E.fact_state(rows, ["f"]).collect()} == {1: "CONTRADICTS", 2: "SUPPORTS", 3: "INSUFFICIENT"}
    cases = [("UNCERTAIN", "SUPPORTS"), ("CONFIRMED", "CONTRADICTS"), ("CONFIRMED", "INSUFFICIENT"), ("NOT_STATED", "SUPPORTS")]
    got = spark.createDataFrame(cases, "s string, v string").select(L.reconciled(F.col("s"), F.col("v")).alias("x")).collect()
    assert [r.x for r in got] == ["CONFIRMED", "CONFLICT", "UNCERTAIN", "NOT_STATED"]


def test_issues_and_gate(spark):
    facts = spark.createDataFrame([(1, 0, "a", "patient_age", "150", "CONFIRMED", 0.9), (2, 0, "", "x", "1", "odd", 2.0), (3, 0, "c", "x", "1", "CONFIRMED", None)], "envelope_id int, pos int, fact_id string, field string, value string, status string, confidence double")
    issues = L.fact_issues(facts)
    assert {(r.envelope_id, r.code) for r in issues.collect()} == {(1, "FACT_NORMALIZED_VALUE_IMPLAUSIBLE"), (2, "FACT_MISSING_ID"), (2, "FACT_INVALID_STATUS"), (2, "CONFIDENCE_OUT_OF_BOUNDS")}
    assert {r.envelope_id: r.gate for r in L.gating(issues).collect()} == {1: "REVIEW_WITH_WARNINGS", 2: "BLOCKED"}
