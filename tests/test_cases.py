"""Small tables of the reference's own tests, and what SQL can't express."""

import pytest
from pyspark.sql import functions as F

from caseloom.functions import view as V
from caseloom.operators import cases as C
from caseloom.operators import chunks, envelope
from caseloom.operators import store as S
from caseloom.operators import viewfocus as W


def one(spark, column, schema, *values):
    return spark.createDataFrame([values], schema).select(column.alias("x")).first().x


def test_paragraphs_are_numbered_and_placed(spark):
    body = "\n\n  First one.\nstill it \n \n\n\n  Second\n\n   \n\nThird"
    rows = chunks.paragraphs(spark.createDataFrame([(1, body), (2, None), (3, "")], "document_id int, text string"), ["document_id"]).orderBy("pos").collect()
    assert [(r.pos, r.text) for r in rows] == [(1, "First one.\nstill it"), (2, "Second"), (3, "Third")]
    assert all(body[r.char_start : r.char_end] == r.text for r in rows)


def test_questions_keep_their_order(spark):
    ask = lambda text: one(spark, V.asked(F.col("t")), "t string", text)
    assert ask("1. What is the dose?\n2. Is it stable?") == ["What is the dose?", "Is it stable?"]
    assert ask("We ask: 1. What is the dose? 2. Is it stable?") == ["We ask:", "What is the dose?", "Is it stable?"]
    assert ask("Hello. What is it? And then?") == ["What is it?", "And then?"] and ask("Not stated") == [] and ask(None) == [] and ask("No question") == ["No question"]


def test_highlight_stands_between_other_signs(spark):
    hit = lambda text, term: one(spark, V.highlighted(F.col("a"), F.col("b")), "a string, b string", text, term)
    assert hit("The stat. was", "stat") and not hit("States", "stat") and hit("hyperbilirubinemia seen", "bilirubin") and not hit("x", "") and hit("a (b.c) d", "(b.c)")


def test_seriousness_is_reconciled(spark):
    criteria, flags = V.reconciled_serious(F.col("c"), {"hospitalization": F.col("h"), "death": F.col("d")})
    rows = spark.createDataFrame([(["Death"], None, False), ([], True, None), (["Non-Serious"], True, True)], "c array<string>, h boolean, d boolean").select(criteria.alias("c"), flags["hospitalization"].alias("h"), flags["death"].alias("d")).collect()
    assert [(r.c, r.h, r.d) for r in rows] == [(["Death"], False, True), (["Hospitalization"], True, False), (["Non-Serious"], False, False)]


def envelopes(spark):
    facts = [("e", 0, 0, "f1", "lot", "LOT-1", "UNCERTAIN"), ("e", 0, 1, "f2", "dose", "Not stated", "NOT_STATED"), ("e", 1, 0, "f1", "lot", "other", "CONFIRMED"), ("e", 0, 2, "f3", "event", "rash", "CONFIRMED"), ("e", 0, 3, "f4", "sex", "F", "CONFIRMED")]
    facts = spark.createDataFrame(facts, "envelope_id string, origin int, pos int, fact_id string, field string, value string, status string").withColumns({"normalized": F.lit(None).cast("string"), "confidence": F.lit(1.0), "notes": F.lit(None).cast("string")})
    rows = [("f1", "a", 0, "lot LOT-1"), ("f1", "b", 1, "Lot  lot-1"), ("f1", "c", 2, ""), ("f1", "d", 3, "x"), ("f1", "g", 4, "y"), ("f2", "h", 0, "dose"), ("f3", "i", 0, "denies it"), ("f3", "j", 1, "the rash")]
    evidence = spark.createDataFrame([("e", *r, "m.eml") for r in rows], "envelope_id string, fact_id string, evidence_id string, pos int, snippet string, source_id string").withColumns({"source_type": F.lit("email"), "place": F.lit("Scan 1"), "page": F.lit(1), "char_start": F.lit(0), "char_end": F.lit(3)})
    return facts, evidence


def test_verification_of_an_envelope(spark):
    facts, judged, metrics = envelope.verify_envelope(*envelopes(spark))
    assert {r.fact_id: r.state for r in facts.collect()} == {"f1": "SUPPORTS", "f2": "INSUFFICIENT", "f3": "CONTRADICTS", "f4": "INSUFFICIENT"}
    assert {r.evidence_id: (r.result, r.rule) for r in judged.collect()} == {
        "a": ("SUPPORTS", "deterministic"), "b": ("INSUFFICIENT", "duplicate_candidate_pruned"), "c": ("INSUFFICIENT", "empty_evidence_guard"), "d": ("INSUFFICIENT", "deterministic"), "g": ("INSUFFICIENT", "excess_candidate_budget"),
        "h": ("INSUFFICIENT", "not_stated_guard"), "i": ("CONTRADICTS", "deterministic"), "j": ("SUPPORTS", "deterministic"),
    }
    assert tuple(metrics.first()) == ("e", 4, 5, 8, 4)
    answers = spark.createDataFrame([("e", "f1", "a", 0, "CONTRADICTS", "7"), ("e", "f1", "a", 1, "SUPPORTS", "1"), ("e", "f3", "i", 0, "maybe", "nan"), ("e", "zz", "a", 0, "SUPPORTS", "1")], "envelope_id string, fact_id string, evidence_id string, pos int, result string, confidence string")
    given = envelope.verify_envelope(*envelopes(spark), answers=answers, cascade=False)[1]
    assert {r.evidence_id: (r.result, r.confidence) for r in given.filter("rule = 'deterministic'").collect()} == {"a": ("CONTRADICTS", 1.0), "d": ("INSUFFICIENT", 0.0), "i": ("INSUFFICIENT", 0.0), "j": ("INSUFFICIENT", 0.0)}


@pytest.mark.parametrize("gate, snippet", [("REVIEW_WITH_WARNINGS", "lot LOT-1"), ("BLOCKED_BY_INTEGRITY_ERROR", "")])
def test_gate_of_an_envelope(spark, gate, snippet):
    facts, evidence = envelopes(spark)
    facts, evidence = facts.filter("fact_id = 'f1' and origin = 0"), evidence.filter("evidence_id = 'a'").withColumn("snippet", F.lit(snippet))
    if snippet:
        facts = facts.withColumn("value", F.lit("LOT-2"))
        facts = facts.withColumn("status", F.lit("CONFIRMED"))
    facts, judged, _ = envelope.verify_envelope(facts, evidence)
    heads = spark.createDataFrame([("e", "Unknown", "m.eml", None, None, 0, True, False, False, False, "{}", None, None, None)], "envelope_id string, message_id string, source_filename string, attachment_filenames array<string>, source_filenames array<string>, page_count int, has_icsr boolean, has_pqc boolean, has_mi boolean, has_not_relevant boolean, icsr string, pqc string, mi string, not_relevant string")
    report, issues, settled = envelope.validate_envelope(heads, facts, judged)
    assert report.first().gate == gate, issues.collect()
    assert settled.first().status == ("UNCERTAIN")


def test_tables_are_stored_and_audit_rows_only_added(spark, tmp_path):
    folder = str(tmp_path)
    rows = S.audit_rows(spark.createDataFrame([(1, "ACCEPT"), (2, "EDIT")], "message_id int, action string"), F.lit("2025-01-01").cast("timestamp"))
    S.store(rows, folder, "audit_events")
    S.store(rows, folder, "audit_events")
    assert S.stored(spark, folder, "audit_events").count() == 4 and {r.reviewer_username for r in rows.collect()} == {"Reviewer"}
    with pytest.raises(ValueError):
        S.reset(rows, folder, "audit_events")
    messages = spark.createDataFrame([(1, "RECEIVED"), (2, "TRIAGED")], "id int, status string")
    S.store(messages, folder, "messages")
    S.reset(messages.filter("id = 2"), folder, "messages")
    assert [r.id for r in S.stored(spark, folder, "messages").filter("status = 'TRIAGED'").collect()] == [2] and S.stored(spark, folder, "messages").count() == 1
    S.save_evaluation(messages, messages, folder + "/eval")
    S.store(S.literature_rows(spark.createDataFrame([("a", True)], "filename string, is_reportable boolean"), F.current_timestamp()), folder, "literature_articles")
    assert spark.read.json(folder + "/eval/cases").count() == 2 and S.stored(spark, folder, "literature_articles").first().review_status == "PENDING"
    files = spark.createDataFrame([(1, "f", None, bytearray(b"x"))], "id int, filename string, content_type string, bytes binary")
    assert tuple(S.attachment_bytes(files, 1).first()) == ("f", "application/octet-stream", bytearray(b"x"))


def test_photo_with_a_box_comes_first(spark):
    rows = spark.createDataFrame([([("a", None), ("b", "box")],), ([("a", None)],), ([],)], "i array<struct<name:string,bbox:string>>")
    assert [r.x and r.x.name for r in rows.select(C.photo_evidence(F.col("i")).alias("x")).collect()] == ["b", "a", None]


def test_lab_rows_find_their_facts(spark):
    labs = spark.createDataFrame([("e", 0, "ALT"), ("e", 1, "none")], "envelope_id string, pos int, test_name string")
    facts = spark.createDataFrame([("e", 3, "lab_test_alt_2"), ("e", 1, "lab_test_alt"), ("e", 0, "alt")], "envelope_id string, pos int, field string")
    assert {r.test_name: r.lab_field for r in C.lab_fact_of(labs, facts).collect()} == {"ALT": "lab_test_alt", "none": None}


def test_literature_cases_are_grounded_apart(spark):
    rows = [("art", 1, "Patient A", "drugol", "Not stated"), ("art", 2, "Patient B", "drugol", "rash")]
    cases = spark.createDataFrame(rows, "article_id string, case_no int, identifier string, suspect_product string, adverse_event string")
    facts = C.literature_facts(cases, ("suspect_product", "adverse_event"))
    texts = [(0, "Patient A took drugol daily for a month."), (1, "Patient B took drugol and then had a rash."), (2, "Nothing else was seen.")]
    held = spark.createDataFrame([("art", i, t, "pdf_text", 3, i == 1, None, None, False) for i, t in texts], "document_id string, pos int, text string, source_type string, page int, has_box boolean, char_start int, char_end int, is_table boolean")
    got = {(r.case_no, r.name): (r.snippet[:9], r.level) for r in C.ground_cases(facts, held).collect()}
    assert got == {(1, "suspect_product"): ("Patient A", "LEVEL_2_PAGE_TEXT"), (1, "product_name"): ("Patient A", "LEVEL_2_PAGE_TEXT"), (2, "suspect_product"): ("Patient B", "LEVEL_1_EXACT_VISUAL"), (2, "product_name"): ("Patient B", "LEVEL_1_EXACT_VISUAL"), (2, "adverse_event"): ("Patient B", "LEVEL_1_EXACT_VISUAL"), (2, "reaction"): ("Patient B", "LEVEL_1_EXACT_VISUAL")}


def test_focus_of_the_view(spark):
    schema = "envelope_id int, status string, primary_category string, categories array<string>, is_multi_label boolean, photo boolean, has_mi boolean, language string, attachments array<struct<language:string,flavor:string>>"
    rows = [(1, "TRIAGED", "ICSR", ["ICSR"], False, False, False, "en", []), (2, None, None, None, None, None, None, None, None), (3, "FAILED", "Not Relevant", ["Not Relevant"], True, True, True, "de", []), (4, "TRIAGED", "not_relevant", ["x"], None, True, None, None, [])]
    messages = spark.createDataFrame(rows, schema)
    facts = spark.createDataFrame([(k, i, f, f.upper(), s) for k in (1, 2, 3) for i, (f, s) in enumerate([("patientAge", "NOT_STATED"), ("other", "NOT_STATED"), ("productDose", "CONFLICT"), ("adverseEvent", None)])], "envelope_id int, pos int, field string, label string, status string")
    items = W.view_focus(messages, facts)
    got = {}
    for r in items.orderBy("envelope_id", "rank", "pos").collect():
        got.setdefault(r.envelope_id, []).append(r.item)
    conflict = "focus-conflict-productDose"
    assert got == {1: [conflict, "focus-missing-patientAge"], 2: [conflict], 3: ["focus-photo-01", "focus-multilabel-01", "focus-lang-01", conflict], 4: ["focus-photo-01"]}
    gates = {r.envelope_id: (r.n_focus, r.n_warnings, r.gate) for r in W.view_gate(messages, items).collect()}
    assert gates == {1: (2, 1, "REVIEW_WITH_WARNINGS"), 2: (1, 0, "REVIEW_WITH_WARNINGS"), 3: (4, 0, "BLOCKED_BY_INTEGRITY_ERROR"), 4: (1, 0, "READY_FOR_REVIEW")}
    none = messages.limit(0)
    assert W.view_focus(none, facts).count() == 0 and W.view_gate(none, items).count() == 0
