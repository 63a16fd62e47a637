"""Registered queries on mail, intake, stored batches and audits: tables are written to the session's shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as A
from ..operators.shared import scratch
from ..sources.mail import read_mail, write_mail
from ..streaming import mailbox
from ..streaming.intake import intake, load
from .catalog import query


def _letters(t, where: str, number):
    d = t("documents").filter(where)
    own = F.col("doc_id").cast("string")
    return d.select(
        number.alias("number"), F.when(F.col("doc_id") % 7 > 0, F.concat(F.lit("d"), own, F.lit("@x.org"))).alias("message_id"), F.concat(F.lit("Desk "), F.col("source"), F.lit(" <"), F.col("source"), F.lit("@x.org>")).alias("sender"),
        F.concat(F.lit("Document "), own).alias("subject"), F.coalesce("text", F.lit("")).alias("text"), F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("article_"), own, F.lit(".txt"))).alias("attachment"), F.col("lang").alias("content"),
    )


_SQL_LETTERS = """lt as (select doc_id, doc_id + 1 as number, case when doc_id % 7 > 0 then 'd' || doc_id || '@x.org' else 'IMAP-UID-' || {} end as message_id, case when doc_id % 5 = 0 then 1 else 0 end as n_files, * exclude (doc_id) from documents)"""


@query(f"""with {_SQL_LETTERS.format("(doc_id + 1)")} select number, 'inbox_' || lpad(number::varchar, 12, '0') || '.eml' as filename, message_id, 'Desk ' || source as sender, source || '@x.org' as sender_email, 'Document ' || doc_id as subject,
 case when trim(coalesce(text, '')) <> '' then md5(text) else md5('') end as body_md5, n_files, case when n_files > 0 then 'article_' || doc_id || '.txt' end as file, case when n_files > 0 then length(lang) else 0 end as size_bytes from lt""")
def mail_table(t):
    """Every document written as a mail file, and the folder read as a table of mail."""
    mails = _letters(t, "true", F.col("doc_id") + 1)
    folder = scratch(mails.sparkSession, "mails")
    write_mail(mails, folder)
    file = F.try_element_at("attachments", F.lit(1))
    return read_mail(mails.sparkSession, folder).select("number", "filename", "message_id", "sender", "sender_email", "subject", F.md5("body_text").alias("body_md5"), F.size("attachments").alias("n_files"), file["filename"].alias("file"), F.coalesce(file["size_bytes"], F.lit(0)).alias("size_bytes"))


@query("""with m as (select doc_id, 0 as batch, doc_id + 1 as number, case when doc_id % 7 > 0 then 'd' || doc_id || '@x.org' else 'IMAP-UID-' || (doc_id + 1) end as message_id from documents where doc_id % 2 = 0
 union all select doc_id, 1, doc_id + 1000000001, case when doc_id % 7 > 0 then 'd' || doc_id || '@x.org' else 'IMAP-UID-' || (doc_id + 1000000001) end from documents where doc_id % 2 = 1 or doc_id % 7 = 0),
f as (select message_id, count(*) as n_files from (select message_id from m where doc_id % 5 = 0) group by 1)
select message_id, number, batch::bigint as batch, 'RECEIVED' as status, coalesce(n_files, 0)::int as n_attachments, coalesce(n_files, 0) as n_files, 'Ingested from mail (inbox_' || lpad(number::varchar, 12, '0') || '.eml) with ' || coalesce(n_files, 0) || ' attachments' as said from m left join f using (message_id)""")
def mailbox_batches(t):
    """A mailbox in two arrivals: the even documents; then all again under new numbers, with the checkpoint lost. Mail without an id of its own counts as new."""
    first = _letters(t, "doc_id % 2 = 0", F.col("doc_id") + 1)
    spark = first.sparkSession
    box, table = scratch(spark, "mailbox"), scratch(spark, "table")
    write_mail(first, box)
    mailbox.fetch(spark, box, table, scratch(spark, "state"))
    write_mail(_letters(t, "true", F.col("doc_id") + 1_000_000_001), box)
    mailbox.fetch(spark, box, table, scratch(spark, "state"))
    files = mailbox.table(spark, table, "attachments").groupBy("message_id").agg(F.count("*").alias("n_files"))
    audit = mailbox.table(spark, table, "audit_events").filter("new_value = 'RECEIVED'").select("message_id", F.col("reviewer_comments").alias("said"))
    rows = mailbox.table(spark, table, "messages").select("message_id", "number", "batch", "status", "n_attachments")
    return rows.join(files.hint("merge"), "message_id", "left").join(audit.hint("merge"), "message_id", "left").na.fill(0, ["n_files"])


_ARRIVAL = "select o_custkey, min(o_orderdate) as d from orders where o_orderkey % 3 {} 0 group by 1"


@query(f"""with a as ({_ARRIVAL.format("=")}), b as ({_ARRIVAL.format("<>")}), x as (select *, 1 as arrival from a union all select *, 2 from b where o_custkey not in (select o_custkey from a))
select 'c' || o_custkey as message_id, strftime(d, '%Y-%m-%d') as day from x where d >= date '1994-01-01' and o_custkey % 10 > 0""")
def intake_first_seen(t):
    """Customers' first orders in two arrivals of a stream: who came first before the start stays out, whatever comes later; so does the baseline."""
    message = lambda where: t("orders").filter(where).groupBy(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("message_id")).agg(F.min("o_orderdate").cast("timestamp").alias("ts"))
    first = message("o_orderkey % 3 = 0")
    spark, schema = first.sparkSession, "message_id string, ts timestamp"
    folder, table, state = (scratch(spark, name) for name in ("arrivals", "intake", "state"))
    t("orders").filter("o_custkey % 10 = 0").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("message_id")).distinct().write.parquet(f"{table}/baseline")
    for where in ("o_orderkey % 3 = 0", "o_orderkey % 3 != 0"):
        message(where).write.mode("append").parquet(folder)
        load(intake(spark, folder, schema, "1994-01-01 00:00:00"), table, state)
    got = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{table}/rows")
    return got.select("message_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))


def _checks() -> dict[str, list[A.Check]]:
    c = F.col
    return {
        "documents": [
            A.at_least("100 documents", 100, c("on_disk")), A.always("single ids", c("n_alike") == 1), A.never("missing on disk", ~c("on_disk")), A.never("not in the manifest", ~c("listed")), A.never("digest differs", c("digest") != c("digest_listed")),
            A.never("n_chars wrong", c("n_chars") != F.length("text")), A.always("known language", c("lang").isin("en", "de", "fr", "es") | ~c("on_disk")), A.at_least("two in other languages", 2, c("lang") != "en"), A.never("blank", F.trim("text") == ""),
        ],
        "labels": [A.always("of known documents", c("known")), A.always("toxic 0 or 1", c("toxic").isin(0, 1)), A.always("quality 0 or 1", c("quality").isin(0, 1)), A.at_least("two toxic", 2, c("toxic") == 1), A.exactly("three of none", 3, c("toxic").isNull())],
        "conversations": [A.always("known role", c("role").isin("user", "assistant", "system", "tool")), A.always("single turns", c("n_alike") == 1), A.never("blank", F.trim("text") == ""), A.at_least("ten by users", 10, c("role") == "user")],
        "pages": [A.always("single ids", c("n_alike") == 1), A.always("url with a host", c("url").rlike("^[a-z]+://[^/?#]+")), A.never("no html", F.length("html") == 0), A.at_least("ten without scripts", 10, ~c("html").contains("<script"))],
        "benchmark": [A.always("single ids", c("n_alike") == 1), A.at_least("five words", 5, F.size(F.split("text", " ")) >= 5), A.exactly("no blank", 0, F.trim("text") == "")],
    }


_SQL_CHECKS = """with f as (select doc_id, sha256(case when doc_id % 8 = 0 then text || 'x' else text end) as listed from documents where doc_id % 11 <> 0 union all select 10000000 + s_suppkey, 'gone' from supplier),
d as (select coalesce(a.doc_id, f.doc_id) as doc_id, a.doc_id is not null as on_disk, f.doc_id is not null as is_listed, f.listed, sha256(a.text) as digest, a.text, a.lang, a.n_chars, count(*) over (partition by coalesce(a.doc_id, f.doc_id)) as n_alike from documents a full join f on a.doc_id = f.doc_id),
l as (select l.*, k.doc_id is not null as known from labels l left join documents k using (doc_id)), c as (select *, count(*) over (partition by conv_id, turn) as n_alike from conversations), p as (select *, count(*) over (partition by page_id) as n_alike from pages), b as (select *, count(*) over (partition by item_id) as n_alike from benchmark),
r as (select 'documents' as scope, unnest([('100 documents', count(*) filter (on_disk), 100, null), ('single ids', count(*) filter (n_alike <> 1), null, 0), ('missing on disk', count(*) filter (not on_disk), null, 0), ('not in the manifest', count(*) filter (not is_listed), null, 0), ('digest differs', count(*) filter (digest <> listed), null, 0),
  ('n_chars wrong', count(*) filter (n_chars <> length(text)), null, 0), ('known language', count(*) filter (not coalesce(lang in ('en', 'de', 'fr', 'es') or not on_disk, false)), null, 0), ('two in other languages', count(*) filter (lang <> 'en'), 2, null), ('blank', count(*) filter (trim(text) = ''), null, 0)]) as x from d
 union all select 'labels', unnest([('of known documents', count(*) filter (not known), null, 0), ('toxic 0 or 1', count(*) filter (not coalesce(toxic in (0, 1), false)), null, 0), ('quality 0 or 1', count(*) filter (not coalesce(quality in (0, 1), false)), null, 0), ('two toxic', count(*) filter (toxic = 1), 2, null), ('three of none', count(*) filter (toxic is null), 3, 3)]) from l
 union all select 'conversations', unnest([('known role', count(*) filter (not coalesce(role in ('user', 'assistant', 'system', 'tool'), false)), null, 0), ('single turns', count(*) filter (n_alike <> 1), null, 0), ('blank', count(*) filter (trim(text) = ''), null, 0), ('ten by users', count(*) filter (role = 'user'), 10, null)]) from c
 union all select 'pages', unnest([('single ids', count(*) filter (n_alike <> 1), null, 0), ('url with a host', count(*) filter (not coalesce(regexp_matches(url, '^[a-z]+://[^/?#]+'), false)), null, 0), ('no html', count(*) filter (html = ''), null, 0), ('ten without scripts', count(*) filter (not contains(html, '<script')), 10, null)]) from p
 union all select 'benchmark', unnest([('single ids', count(*) filter (n_alike <> 1), null, 0), ('five words', count(*) filter (len(string_split(text, ' ')) >= 5), 5, null), ('no blank', count(*) filter (trim(text) = ''), 0, 0)]) from b),
q as (select scope, x[1] as check_name, x[2]::bigint as n, x[3]::bigint as least, x[4]::bigint as most, (x[3] is null or x[2] >= x[3]) and (x[4] is null or x[2] <= x[4]) as passed from r)"""


def _audited(t):
    docs = t("documents").withColumn("digest", F.sha2("text", 256))
    spark = docs.sparkSession
    own = F.col("doc_id")
    manifest = t("documents").filter("doc_id % 11 != 0").select("doc_id", F.sha2(F.when(own % 8 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("digest"))
    gone = t("supplier").select((F.col("s_suppkey") + 10_000_000).alias("doc_id"), F.lit("gone").alias("digest"))
    known = t("documents").select("doc_id", F.lit(True).alias("known"))
    tables = {
        "documents": A.occurrences(A.against_manifest(docs, manifest.unionByName(gone), "doc_id", "digest"), "doc_id"), "labels": t("labels").join(known.hint("merge"), "doc_id", "left"),
        "conversations": A.occurrences(t("conversations"), "conv_id", "turn"), "pages": A.occurrences(t("pages"), "page_id"), "benchmark": A.occurrences(t("benchmark"), "item_id"),
    }
    folder = scratch(spark, "audited")
    return A.report(spark, [r for scope, checks in _checks().items() for r in A.write_audited(tables[scope], f"{folder}/{scope}", scope, checks)])


@query(f"{_SQL_CHECKS} select scope, check_name, n, coalesce(least, -1) as least, coalesce(most, -1) as most, passed from q")
def dataset_checks(t):
    """25 checks of five tables, each table read once while it is written; -1: no bound."""
    return _audited(t).na.fill(-1, ["least", "most"])


@query(f"{_SQL_CHECKS} select scope, count(*) as n_checks, count(*) filter (not passed) as n_failed, count(*) filter (not passed) = 0 as passed from q group by 1")
def dataset_gate(t):
    return A.gate(_audited(t))
