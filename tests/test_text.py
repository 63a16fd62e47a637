from pyspark.sql import functions as F

from caseloom.functions import text as T


def one(spark, column, *values):
    rows = spark.createDataFrame([(v,) for v in values], "v string").select(column(F.col("v")).alias("x")).collect()
    return [r.x for r in rows]


def test_age(spark):
    assert one(spark, T.age, "71 YRS", "54 ans", "Not stated", None) == [71, 54, None, None]


def test_route_country_sex(spark):
    assert one(spark, T.route, "p.o.", "oralmente", "i.v.", "by HAND", "n/a") == ["Oral", "Oral", "Intravenous", "By hand", None]
    assert one(spark, T.country, "España", "USA", "new zealand", "") == ["Spain", "United States", "New Zealand", None]
    assert one(spark, T.sex, "weiblich", "M", "other") == ["Female", "Male", "Other"]


def test_dates(spark):
    assert one(spark, T.iso_date, "2025-11-14", "14/11/2025", "November 14, 2025", "14-NOV-2025", "on 2025-11-14 noted", "seen 14.11.2025 then", "11/14/2025", "soon", "unknown") == ["2025-11-14"] * 7 + [None, None]


def test_sender(spark):
    assert one(spark, T.sender_name, '"A B" <a@b.org>', "a@b.org") == ["A B", "a@b.org"]
    assert one(spark, T.sender_address, '"A B" <a@b.org>', "a@b.org") == ["a@b.org", "a@b.org"]


def test_questions_keep_their_order(spark):
    assert one(spark, T.questions, "1. How is it dosed\n2. Is it stable\nthanks", "May it be crushed? And diluted?", "No question here") == [["How is it dosed", "Is it stable"], ["May it be crushed", "And diluted"], ["No question here"]]


def test_triage_by_substring_and_token(spark):
    got = lambda token: one(spark, lambda c: T.triage(c, token)["primary"], "adverse event, broken seal", "particulate matter", "dosing question", "early bird summit", "nothing")
    assert got(False) == ["ICSR", "ICSR", "MI", "Not Relevant", "ICSR"]  # "particulate" holds "icu"
    assert got(True)[1] == "PQC"


def test_confidence_and_json(spark):
    assert one(spark, lambda c: T.percent_text(c.cast("double")), "0", "1.0", "0.5", None) == ["Pending", "98%", "50%", "Pending"]
    assert one(spark, T.json_candidate, '```json\n{"a": 1}\n```', "none") == ['{"a": 1}', None]
