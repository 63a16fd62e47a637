import tempfile
from datetime import datetime

from caseloom.sources.mail import read_mail
from caseloom.streaming.intake import baseline, intake, load


def test_stream_drops_late_and_repeated_messages(spark):
    folder, table, state = (tempfile.mkdtemp() for _ in range(3))
    at = lambda s: datetime(2025, 1, 1, 12, 0, s)
    schema = "message_id string, ts timestamp"
    spark.createDataFrame([("a", at(20)), ("a", at(21)), ("b", datetime(2025, 1, 1, 11, 0, 0))], schema).write.mode("overwrite").parquet(folder)
    load(intake(spark, folder, schema, "2025-01-01 12:00:00"), table, state)
    spark.createDataFrame([("a", at(40)), ("c", at(41))], schema).write.mode("append").parquet(folder)
    load(intake(spark, folder, schema, "2025-01-01 12:00:00"), table, state)
    got = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{table}/rows")
    assert sorted(r.message_id for r in got.collect()) == ["a", "c"]


def test_mail_out_of_order_and_a_restart(spark):
    folder, table, state = (tempfile.mkdtemp() for _ in range(3))
    at = lambda m, s=0: datetime(2025, 1, 1, 12, m, s)
    schema, start = "message_id string, ts timestamp, subject string", "2025-01-01 12:00:00"
    put = lambda *rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    got = lambda: sorted(r.message_id for r in spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{table}/rows").collect())
    baseline(spark.createDataFrame([("old", at(1), "s")], schema), table)
    put(("a", at(5), "s"), ("old", at(6), "s"), ("edge", datetime(2025, 1, 1, 11, 59, 46), "s"), ("gone", datetime(2025, 1, 1, 11, 59, 44), "s"))
    load(intake(spark, folder, schema, start), table, state)
    put(("b", at(2), "late, but after the start"), ("a", at(7), "again"), ("c", at(0, 1), "x"), ("c", at(0, 2), "y"))
    load(intake(spark, folder, schema, start), table, state)
    load(intake(spark, folder, schema, start), table, state)
    assert got() == ["a", "b", "c", "edge"]
    load(intake(spark, folder, schema, start), table, tempfile.mkdtemp())  # a lost checkpoint: everything is read again, nothing doubled
    assert got() == ["a", "b", "c", "edge"]


def test_mail_parts(spark, tmp_path):
    (tmp_path / "m.eml").write_bytes(b'From: "A B" <a@b.org>\nTo: c@d.org\nSubject: S\nMessage-ID: <1@x>\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=q\n\n--q\nContent-Type: text/html\n\n<p>Hello</p>\n--q\nContent-Type: application/pdf\nContent-Disposition: attachment; filename=f.pdf\n\nabc\n--q--\n')
    row = read_mail(spark, str(tmp_path)).first()
    assert (row.sender, row.sender_email, row.body_text, row.attachments[0].filename, row.attachments[0].size_bytes) == ("A B", "a@b.org", "Hello", "f.pdf", 3)
