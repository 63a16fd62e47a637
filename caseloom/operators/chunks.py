"""Chunks of mails and of the pages of documents, with where each stands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.view import header_text

BLANK_LINE = r"\n\s*\n"


def paragraphs(texts: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """(by, pos, text, char_start, char_end): what stands between blank lines, trimmed; pos counts empty ones too, which are left out."""
    pieces = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(rf"(?s).*?(?:{BLANK_LINE}|\z)"), F.lit(0))
    rows = texts.select(*by, F.posexplode(pieces).alias("pos", "_piece"))
    before = Window.partitionBy(*by).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_at", F.coalesce(F.sum(F.length("_piece")).over(before), F.lit(0)))
    own = F.regexp_replace("_piece", r"^\s+|\s+$", "")
    start = (F.col("_at") + F.length("_piece") - F.length(F.regexp_replace("_piece", r"^\s+", ""))).cast("int")
    return rows.select(*by, "pos", own.alias("text"), start.alias("char_start"), (start + F.length(own)).alias("char_end")).filter("text != ''")


def _chunk(kind: str, name: Column, place: Column, text: Column, section: Column, page: Column, **more: Column) -> list[Column]:
    none = F.lit(None)
    given = {"char_start": none.cast("int"), "char_end": none.cast("int"), "has_box": F.lit(False), "is_table": F.lit(False), "is_image": F.lit(False)} | more
    return [F.concat(F.col("filename"), F.lit(":"), name).alias("chunk_id"), F.col("filename").alias("source_id"), F.lit(kind).alias("source_type"), place.alias("place"), text.alias("text"), section.alias("section"), page.cast("int").alias("page"), *(c.alias(n) for n, c in given.items())]


def mail_chunks(mails: DataFrame) -> DataFrame:
    """Header, paragraphs and attached images of mails, in this order (part, pos).

    mails: document_id, filename, sender, sender_email, date, subject, message_id, body, attachments (array of file names).
    Attached documents are chunked by ``page_chunks``.
    """
    head = header_text(F.col("sender"), F.col("sender_email"), F.col("date"), F.col("subject"), F.col("message_id"))
    key = lambda part, pos: [F.col("document_id"), F.lit(part).alias("part"), pos.cast("int").alias("pos")]
    header = mails.select(*key(0, F.lit(0)), *_chunk("email_header", F.lit("header"), F.lit("Email Header"), head, F.lit("Email Header"), F.lit(1), char_start=F.lit(0), char_end=F.length(head)))
    n = (F.col("pos") + 1).cast("string")
    body = paragraphs(mails, ["document_id", "filename"], "body")
    body = body.select(*key(1, F.col("pos")), *_chunk("email_body", F.concat(F.lit("body:p"), n), F.concat(F.lit("Email Body, Paragraph "), n), F.col("text"), F.concat(F.lit("Paragraph "), n), F.lit(1), char_start=F.col("char_start"), char_end=F.col("char_end")))
    files = mails.select("document_id", F.posexplode("attachments").alias("pos", "filename")).filter(F.lower("filename").rlike(r"\.(jpe?g|png)$"))
    images = files.select(*key(2, F.col("pos")), *_chunk("defect_image", F.lit("image"), F.concat(F.lit("Attached Defect Photo: "), F.col("filename")), F.concat(F.lit("Photographic exhibit asset: "), F.col("filename")), F.lit("Exhibit Photo"), F.lit(1), is_image=F.lit(True)))
    return header.unionByName(body).unionByName(images)


def page_chunks(elements: DataFrame, shortest: int = 3) -> DataFrame:
    """Text blocks of pages, or paragraphs where a page has none; rows of tables, whole tables, images.

    elements: document_id, filename, page, kind (block, text, table_row, table, image), seq (from 0), table_no, row_no, text, box (struct or
    null), scanned (boolean).
    """
    page, seq, text = F.col("page").cast("string"), (F.col("seq") + 1).cast("string"), F.trim("text")
    keys = lambda part, pos="seq": [F.col("document_id"), F.lit(part).alias("part"), F.col(pos).cast("int").alias("pos")]
    boxed = F.col("box").isNotNull()
    long_ = F.length(text) >= shortest
    p = lambda *rest: F.concat(F.lit("p"), page, *rest)
    where = lambda *rest: F.concat(F.lit("Page "), page, *rest)
    blocks = elements.filter("kind = 'block'")
    no = F.col("seq").cast("string")
    block = blocks.filter(long_)
    kind = lambda scanned: _chunk("scanned_page" if scanned else "pdf_text", p(F.lit(":b"), no), where(F.lit(", Block "), no), text, F.concat(F.lit("Block "), no), F.col("page"), has_box=boxed)
    out = [block.filter(F.col("scanned") == s).select(*keys(0), *kind(s)) for s in (False, True)]
    plain = elements.filter("kind = 'text'").join(blocks.select("document_id", "page").distinct().hint("merge"), ["document_id", "page"], "left_anti")
    plain = paragraphs(plain, ["document_id", "filename", "page"]).filter(F.length("text") >= shortest)
    n = (F.col("pos") + 1).cast("string")
    out.append(plain.select(*keys(0, "pos"), *_chunk("pdf_text", p(F.lit(":para"), n), where(F.lit(", Paragraph "), n), F.col("text"), F.concat(F.lit("Paragraph "), n), F.col("page"))))
    table, row = (F.col("table_no") + 1).cast("string"), F.col("row_no").cast("string")
    rows = elements.filter(F.col("kind") == "table_row").filter(long_)
    out.append(rows.select(*keys(1), *_chunk("table_cell", p(F.lit(":t"), table, F.lit(":r"), row), where(F.lit(", Table "), table, F.lit(" Row "), row), text, F.concat(F.lit("Table "), table, F.lit(" Row "), row), F.col("page"), has_box=boxed, is_table=F.lit(True))))
    whole = elements.filter(F.col("kind") == "table").filter(text != "")
    out.append(whole.select(*keys(2), *_chunk("table_cell", p(F.lit(":tbl"), seq), where(F.lit(", Structured Table "), seq), text, F.concat(F.lit("Table "), seq), F.col("page"), is_table=F.lit(True))))
    said = F.concat(F.lit("Embedded photographic exhibit asset on page "), page, F.lit(" of "), F.col("filename"), F.lit(": defect photograph"))
    images = elements.filter(F.col("kind") == "image")
    out.append(images.select(*keys(3), *_chunk("defect_image", p(F.lit(":img"), seq), where(F.lit(", Defect Photograph")), said, F.lit("Defect Photograph"), F.col("page"), has_box=boxed, is_image=F.lit(True))))
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    return every
