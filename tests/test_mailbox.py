"""Mail as a source and a stream, and a mailbox's table whose batches can be run again."""

import pickle
import shutil

import pytest
from pyspark.sql import functions as F

from caseloom.sources.mail import MailSource, mail_stream, read_mail, write_mail
from caseloom.streaming import mailbox

NOW = None  # the present


def _put(folder, number, message_id=None, text="hello", extra=b"", name="inbox_{:06d}.eml"):
    head = f"From: A{number} <a{number}@b.org>\nTo: c@d.org\nSubject: S{number}\n" + (f"Message-ID: <{message_id}>\n" if message_id else "")
    (folder / name.format(number)).write_bytes(head.encode() + b"MIME-Version: 1.0\n" + (extra or b"Content-Type: text/plain; charset=utf-8\n\n" + text.encode()))


PARTS = b'Content-Type: multipart/mixed; boundary=q\n\n--q\nContent-Type: text/html\n\n<p>Hi &amp; bye</p>\n--q\nContent-Type: application/pdf\nContent-Disposition: attachment; filename=Article_1.pdf\n\nabc\n--q\nContent-Type: image/png\nContent-Disposition: attachment; filename=x.png\n\nz\n--q--\n'


@pytest.fixture
def box(tmp_path):
    folder = tmp_path / "box"
    folder.mkdir()
    return folder


def _state(spark, folder):
    rows = mailbox.table(spark, folder, "messages").collect()
    return sorted((r.number, r.message_id, r.status, r.n_attachments, r.batch) for r in rows)


def test_table_of_mail(spark, box):
    _put(box, 1, "one@x")
    _put(box, 2, None, extra=PARTS)
    _put(box, 3, "three@x", extra=b"Content-Type: text/plain; charset=no-such-set\n\nx")
    _put(box, 4, "four@x", "été", name="note{}.txt")
    (box / "plain.eml").write_bytes(b"")
    got = {r.filename: r for r in read_mail(spark, str(box)).collect()}
    assert sorted(got) == ["inbox_000001.eml", "inbox_000002.eml", "plain.eml"]
    two = got["inbox_000002.eml"]
    assert (two.message_id, two.sender, two.sender_email, [a.filename for a in two.attachments], two.attachments[0].size_bytes) == ("IMAP-UID-2", "A2", "a2@b.org", ["Article_1.pdf", "x.png"], 3)
    assert got["plain.eml"].number == 0 and got["plain.eml"].body_text == "" and "Hi" in two.body_text
    bad = spark.read.format("mail").load(str(box)).filter("error is not null").collect()
    assert [(r.number, r.error.split(":")[0]) for r in bad] == [(3, "LookupError")]
    assert spark.read.format("mail").option("after", 1).option("most", 1).load(str(box)).rdd.getNumPartitions() == 2
    assert read_mail(spark, str(box / "none")).count() == 0


def test_a_lost_checkpoint_takes_nothing_under_the_mark(spark, box, tmp_path):
    table, state = str(tmp_path / "t"), str(tmp_path / "c")
    for n in (1, 2):
        _put(box, n, f"m{n}@x")
    _put(box, 3, "m1@x")  # a message again under a new number
    mailbox.fetch(spark, str(box), table, state, now=NOW)
    assert _state(spark, table) == [(1, "m1@x", "RECEIVED", 0, 0), (2, "m2@x", "RECEIVED", 0, 0)] and mailbox.mark(spark, table) == 2
    mailbox.fetch(spark, str(box), table, state, now=NOW)  # nothing new
    shutil.rmtree(state)
    for n in (1, 2):
        _put(box, n, f"other{n}@x")  # what is under the mark isn't looked at again, whatever it is now
    _put(box, 7, None, extra=PARTS)
    mailbox.fetch(spark, str(box), table, state, now=NOW)
    assert _state(spark, table) == [(1, "m1@x", "RECEIVED", 0, 0), (2, "m2@x", "RECEIVED", 0, 0), (7, "IMAP-UID-7", "RECEIVED", 2, 1)]
    files = mailbox.table(spark, table, "attachments").orderBy("pos").collect()
    assert [(f.message_id, f.pos, f.filename, f.flavor, bytes(f.bytes)) for f in files] == [("IMAP-UID-7", 0, "Article_1.pdf", "literature_article", b"abc"), ("IMAP-UID-7", 1, "x.png", "digital_form", b"z")]
    audit = mailbox.table(spark, table, "audit_events").filter("message_id = 'IMAP-UID-7'").first()
    assert (audit.action, audit.original_value, audit.new_value) == ("MESSAGE_INGESTED", "NEW", "RECEIVED") and audit.reviewer_comments == "Ingested from mail (inbox_000007.eml) with 2 attachments"


def test_a_batch_run_twice_is_one_batch(spark, box, tmp_path):
    table = str(tmp_path / "t")
    for n in (1, 2, 3):
        _put(box, n, f"m{n}@x", extra=PARTS if n == 2 else b"")
    mail = read_mail(spark, str(box))
    mailbox.put(mail.filter("number < 3"), table, 0, now=NOW)
    first = _state(spark, table)
    mailbox.put(mail.filter("number < 3"), table, 0, now=NOW)
    assert _state(spark, table) == first and mailbox.table(spark, table, "attachments").count() == 2 and mailbox.table(spark, table, "audit_events").count() == 2
    mailbox.put(mail, table, 1, now=NOW)  # a later batch adds what is new, and leaves the first alone
    assert _state(spark, table) == [*first, (3, "m3@x", "RECEIVED", 0, 1)]


def test_stream_takes_so_many_files_a_batch(spark, box, tmp_path):
    for n in range(1, 6):
        _put(box, n, f"m{n}@x")
    seen = []
    query = mail_stream(spark, str(box), after=1, per_batch=2).writeStream.foreachBatch(lambda rows, batch: seen.append(sorted(r.number for r in rows.collect()))).option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert [s for s in seen if s] == [[2, 3], [4, 5]]
    assert MailSource.name() == "mail"


def test_the_driver_holds_shelves_not_mails(spark, box, tmp_path):
    """What planning gives for mails that are written grows by the shelf, and tables and streams have every mail once, beside those without a shelf."""
    numbers = spark.range(2500).selectExpr("id * 2 as number", "null as message_id", "'a@b' as sender", "'s' as subject", "'t' as text", "null as attachment", "null as content")
    write_mail(numbers, str(box))
    reader = MailSource({"path": str(box)}).reader(None)
    assert sum(len(pickle.dumps(p)) for p in reader.partitions()) < 3000
    _put(box, 1, "one@x")
    _put(box, 7001, "last@x")
    (box / "old").mkdir()
    _put(box / "old", 3, "three@x")  # no shelf
    every = sorted([*range(0, 5000, 2), 1, 7001])
    assert sorted(r.number for r in read_mail(spark, str(box)).select("number").collect()) == every
    for options in ({"after": 1998}, {"after": 2001, "most": 300}, {"after": 4999, "most": 2500}):
        frame = spark.read.format("mail").options(**options).load(str(box))
        assert sorted(r.number for r in frame.select("number").collect()) == [n for n in every if n > options["after"]]
    seen = []
    query = mail_stream(spark, str(box), after=10, per_batch=900).writeStream.foreachBatch(lambda rows, batch: seen.append(sorted(r.number for r in rows.select("number").collect()))).option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    later = [n for n in every if n > 10]
    assert [s for s in seen if s] == [later[i : i + 900] for i in range(0, len(later), 900)]
    table = str(tmp_path / "t")
    mailbox.fetch(spark, str(box), table, str(tmp_path / "c2"))
    assert mailbox.mark(spark, table) == 7001 and mailbox.table(spark, table, "messages").count() == len(every)
    write_mail(numbers.filter("number < 4").withColumn("number", numbers.number + 10_000), str(box))
    mailbox.fetch(spark, str(box), table, str(tmp_path / "c2"))
    assert [r.number for r in mailbox.table(spark, table, "messages").filter("batch > 0").orderBy("number").collect()] == [10_000, 10_002]
