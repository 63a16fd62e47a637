"""Review queue, reviewer actions and the append-only audit log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import view as V

# Audit buckets by substring of the action, in order.
BUCKETS = (("ACCEPT", ("ACCEPT", "APPROVE")), ("OVERRIDE", ("OVERRIDE",)), ("EDIT", ("EDIT", "UPDATE")), ("INGEST", ("INGEST", "RECEIVE")))


def flags(messages: DataFrame) -> DataFrame:
    """Low confidence, image to review, conflicting categories; and the priority that follows."""
    category = F.upper("primary_category")
    rows = messages.withColumn("low_confidence", (F.col("confidence") > 0) & (F.col("confidence") < 0.85)).withColumn("image_review", F.coalesce("requires_human_review", F.lit(False)))
    rows = rows.withColumn("conflict", F.col("is_multi_label") & category.contains("ICSR") & category.contains("PQC"))
    return rows.withColumn("priority", F.when(F.col("image_review") | (F.col("is_multi_label") & category.contains("ICSR")), "CRITICAL").when(category.contains("ICSR"), "EXPEDITED").otherwise("STANDARD"))


def in_category(category: Column, wanted: str) -> Column:
    parts = {"ICSR": ("ICSR", "SAFETY"), "PQC": ("PQC", "QUALITY"), "MI": ("MI", "MEDICAL"), "NOT_RELEVANT": ("NOT RELEVANT", "IRRELEVANT")}[wanted]
    return F.upper(category).contains(parts[0]) | F.upper(category).contains(parts[1])


def search(rows: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows that have the text in one of the columns, whatever the case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(F.col(c).cast("string")).contains(text.lower()), F.lit(False))
    return rows.filter(hit)


def bucket(action: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, parts in BUCKETS:
        hit = F.upper(action).contains(parts[0])
        for part in parts[1:]:
            hit = hit | F.upper(action).contains(part)
        out = out.when(hit, F.lit(name))
    return out.otherwise(F.upper(action))


def latest_actions(actions: DataFrame, by: list[str]) -> DataFrame:
    """The last action for each key, later ids first where times are equal."""
    order = Window.partitionBy(*by).orderBy(F.desc("ts"), F.desc("action_id"))
    return actions.withColumn("rn", F.row_number().over(order)).filter("rn = 1").drop("rn")


def apply_edits(records: DataFrame, edits: DataFrame, key_column: str, fields: list[str]) -> DataFrame:
    """Wide records after (key, field, new_value) edits; edits of unknown fields change nothing."""
    wide = edits.groupBy(key_column).pivot("field", fields).agg(F.first("new_value"))
    wide = wide.select(key_column, *(F.col(f).alias(f"new_{f}") for f in fields))
    return records.join(wide.hint("merge"), key_column, "left").select(*(F.coalesce(f"new_{c}", F.col(c).cast("string")).alias(c) if c in fields else F.col(c) for c in records.columns))


def edit_log(records: DataFrame, edits: DataFrame, key_column: str, fields: list[str]) -> DataFrame:
    """An audit row for each edit that changes something, with the value before it (empty for unknown fields)."""
    old = records.select(key_column, F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("original_value")) for f in fields))))
    joined = edits.join(old.hint("merge"), [key_column, "field"], "left").withColumn("original_value", F.coalesce("original_value", F.lit("")))
    return joined.filter(~F.col("original_value").eqNullSafe(F.col("new_value"))).select(key_column, F.lit("EDIT_FIELD").alias("action"), "field", "original_value", "new_value")


def changed(before: DataFrame, after: DataFrame, key_column: str, column: str) -> DataFrame:
    """Keys that are new, gone, or have another value in two snapshots."""
    b, a = before.select(key_column, F.col(column).alias("old"), F.lit(1).alias("b")), after.select(key_column, F.col(column).alias("new"), F.lit(1).alias("a"))
    both = b.join(a.hint("merge"), key_column, "full_outer")
    kind = F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "gone").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return both.withColumn("kind", kind).filter("kind is not null").select(key_column, "kind")


def accept(messages: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages after acceptance (REVIEWED), and an audit row for each action on a message that exists."""
    known = actions.join(messages.select("message_id").hint("merge"), "message_id", "left_semi")
    done = messages.join(known.select("message_id").distinct().withColumn("done", F.lit(True)).hint("merge"), "message_id", "left")
    audit = known.select("message_id", F.coalesce("reviewer_username", F.lit("reviewer")).alias("reviewer_username"), F.lit("ACCEPT").alias("action"), "ts")
    return done.withColumn("status", F.when(F.col("done"), "REVIEWED").otherwise(F.col("status"))).drop("done"), audit


def matched(expected: DataFrame, found: DataFrame, key_column: str, digest: str) -> DataFrame:
    """Entries of a manifest against files: missing, unlisted, or with another digest."""
    e, f = expected.select(key_column, F.col(digest).alias("want")), found.select(key_column, F.col(digest).alias("got"))
    kind = F.when(F.col("got").isNull(), "missing").when(F.col("want").isNull(), "unlisted").when(F.col("got") != F.col("want"), "changed")
    return e.join(f.hint("merge"), key_column, "full_outer").withColumn("kind", kind).filter("kind is not null").select(key_column, "kind")


def running_numbers(messages: DataFrame, key_column: str = "id", first: int = 13, deal: int = 1 << 20) -> DataFrame:
    """messages with ``running``: their place by ascending id, from ``first`` on.

    Ids are counted by ranges of ``deal`` and the ranges' counts summed, so no task ranks more than one range.
    """
    part = F.floor(F.col(key_column) / deal)
    ids = messages.select(F.col(key_column).alias("_id"), part.alias("_part")).distinct()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ids.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    ranked = ids.withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy("_id"))).join(counts.hint("merge"), "_part")
    return messages.join(ranked.select(F.col("_id").alias(key_column), (F.col("_before") + F.col("_rank") + first - 1).alias("running")).hint("merge"), key_column, "left")


def by_status(messages: DataFrame, status: str) -> DataFrame:
    """Messages of a status; NEEDS_REVIEW stands for those received or triaged."""
    return messages.filter(F.col("status").isin("RECEIVED", "TRIAGED") if status == "NEEDS_REVIEW" else F.col("status") == status)


def flagged(messages: DataFrame, flag: str) -> DataFrame:
    """Messages (with ``flags``) that are CRITICAL, LOW_CONFIDENCE or PHOTO_REVIEW."""
    return messages.filter({"CRITICAL": F.col("priority") == "CRITICAL", "LOW_CONFIDENCE": F.col("low_confidence"), "PHOTO_REVIEW": F.col("image_review")}[flag])


def by_id(rows: DataFrame, value: object, key_column: str = "id") -> DataFrame:
    return rows.filter(F.col(key_column) == F.lit(value))


def newest_first(rows: DataFrame, ts: str = "ts", key_column: str = "id") -> DataFrame:
    """Latest first, the later key first where times are equal."""
    return rows.orderBy(F.col(ts).desc_nulls_last(), F.desc(key_column))


def queue_rows(messages: DataFrame, attachments: DataFrame, pqc: DataFrame) -> DataFrame:
    """Messages as the queue lists them: defaults for category and confidence, number of attachments, photo to review.

    attachments and pqc have message ids as ``message``; pqc has requires_human_review.
    """
    n = attachments.groupBy(F.col("message").alias("id")).agg(F.count("*").alias("attachment_count"))
    photo = pqc.groupBy(F.col("message").alias("id")).agg(F.bool_or("requires_human_review").alias("requires_human_review"))
    rows = messages.join(n.hint("merge"), "id", "left").join(photo.hint("merge"), "id", "left")
    return rows.withColumns({"primary_category": F.coalesce("primary_category", F.lit("Pending Triage")), "confidence": F.coalesce("confidence", F.lit(0.0)), "attachment_count": F.coalesce("attachment_count", F.lit(0)), "requires_human_review": F.coalesce("requires_human_review", F.lit(False))})


def view_facts(facts: DataFrame, sections: list[str] | None = None, status: str = "ALL") -> DataFrame:
    """Facts of some sections and of a status; ATTENTION stands for uncertain and conflicting ones."""
    rows = facts.filter(F.col("section").isin(*sections)) if sections else facts
    return rows if status == "ALL" else rows.filter(F.col("status").isin("UNCERTAIN", "CONFLICT") if status == "ATTENTION" else F.col("status") == status)


# Sections that a category shows.
VISIBLE = {"ICSR": ("PATIENT", "REPORTER", "PRODUCT", "REACTION", "LABS", "CONCOMITANT", "REGULATORY"), "PQC": ("PRODUCT", "REPORTER", "DEFECT"), "MI": ("INQUIRY", "REPORTER", "PRODUCT"), "NOT_RELEVANT": ("EXCLUSION",)}


def visible_facts(facts: DataFrame, cases: DataFrame) -> DataFrame:
    """Facts in the sections that one of their case's categories shows (cases: envelope_id, categories)."""
    shown = F.flatten(F.transform("categories", lambda c: F.coalesce(F.try_element_at(F.create_map(*(x for k, v in VISIBLE.items() for x in (F.lit(k), F.array(*map(F.lit, v))))), c), F.array().cast("array<string>"))))
    return facts.join(cases.select("envelope_id", shown.alias("_shown")).hint("merge"), "envelope_id").filter(F.array_contains("_shown", F.col("section"))).drop("_shown")


def audit_search(events: DataFrame, text: str) -> DataFrame:
    """Audit rows with the text in a column or in the case's name, case-<message id>."""
    named = events.withColumn("_case", F.concat(F.lit("case-"), F.col("message_id").cast("string")))
    return search(named, text, [c for c in ("reviewer_username", "action", "target_field", "original_value", "new_value", "reviewer_comments", "_case") if c in named.columns]).drop("_case")


def override(messages: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages after category overrides (message_id, new_category, reviewer_username, justification), and their audit rows."""
    known = actions.filter("new_category is not null").join(messages.select("message_id", F.col("primary_category").alias("original_value")).hint("merge"), "message_id")
    done = messages.join(known.select("message_id", "new_category").hint("merge"), "message_id", "left")
    done = done.withColumn("status", F.when(F.col("new_category").isNotNull(), "OVERRIDDEN").otherwise(F.col("status"))).withColumn("primary_category", F.coalesce("new_category", "primary_category")).drop("new_category")
    return done, known.select("message_id", F.coalesce("reviewer_username", F.lit("reviewer")).alias("reviewer_username"), F.lit("OVERRIDE_CATEGORY").alias("action"), F.lit("primary_category").alias("target_field"), F.coalesce("original_value", F.lit("")).alias("original_value"), F.col("new_category").alias("new_value"), "justification")


def replace_citations(reports: DataFrame, citations: DataFrame) -> DataFrame:
    """Reports with the citations (message, citations) that are given for them; citations without a report change nothing."""
    return reports.join(citations.select("message", F.col("citations").alias("_new")).hint("merge"), "message", "left").withColumn("citations", F.coalesce("_new", "citations")).drop("_new")


def without_parent(children: DataFrame, parents: DataFrame, key_column: str = "message") -> DataFrame:
    """Children that a deletion of parents takes along are left out: those whose parent is gone."""
    return children.join(parents.select(key_column).hint("merge"), key_column, "left_semi")


def with_files(cited: DataFrame, attachments: DataFrame) -> DataFrame:
    """Names that a message cites (message, cited) with those of its attachments (message, filename) that they stand for."""
    return cited.join(attachments.select("message", "filename").hint("merge"), "message").filter(V.same_file(F.col("filename"), F.col("cited")))


def mismatched(found: DataFrame, expected: DataFrame, key_column: str, columns: list[str]) -> DataFrame:
    """(key, column, expected, found) where headers differ from what is expected of them."""
    e = expected.select(key_column, *(F.col(c).alias(f"_want_{c}") for c in columns))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"_want_{c}").cast("string").alias("expected"), F.col(c).cast("string").alias("found")) for c in columns))
    return e.join(found.hint("merge"), key_column, "left").select(key_column, F.inline(rows)).filter(~F.col("expected").eqNullSafe(F.col("found")))


def accuracy(cases: DataFrame, answers: DataFrame, assertions: DataFrame) -> DataFrame:
    """Evaluation by case: category (MI stands for medical information), multi flag, and assertions on fields; a missing answer fails.

    cases: case_id, category, multi; answers: case_id, category, multi, fields (map), latency_ms; assertions: case_id, field, expected.
    """
    alias = lambda c: F.when(F.upper(c).isin("MI", "MEDICAL INFO REQUEST", "MEDICAL INFORMATION"), "MI").otherwise(F.upper(c))
    joined = cases.select("case_id", F.col("category").alias("_c"), F.col("multi").alias("_m")).join(answers.hint("merge"), "case_id", "left")
    held = assertions.join(answers.select("case_id", "fields").hint("merge"), "case_id", "left").withColumn("ok", F.coalesce(F.lower(F.try_element_at("fields", F.col("field"))).contains(F.lower("expected")), F.lit(False)))
    held = held.groupBy("case_id").agg(F.bool_and("ok").alias("_held"))
    ok = F.coalesce((alias(F.col("category")) == alias(F.col("_c"))) & (F.col("multi") == F.col("_m")), F.lit(False)) & F.coalesce("_held", F.lit(True))
    return joined.join(held.hint("merge"), "case_id", "left").select("case_id", ok.alias("passed"), "latency_ms")


def evaluation(judged: DataFrame) -> DataFrame:
    """Passed cases, percentage of all, whole mean latency."""
    return judged.agg(F.count("*").alias("cases"), F.count_if("passed").alias("passed"), F.round(100 * F.avg(F.col("passed").cast("int")), 1).alias("accuracy"), F.floor(F.avg("latency_ms")).alias("mean_latency_ms"))


def with_attachments(messages: DataFrame, attachments: DataFrame, key_column: str = "message_id") -> DataFrame:
    """messages with their attachment rows (key, pos, …) as an array in their order, empty without any; attachments of no message are left out."""
    rows = [c for c in attachments.columns if c != key_column]
    held = attachments.groupBy(key_column).agg(F.array_sort(F.collect_list(F.struct("pos", *(c for c in rows if c != "pos")))).alias("attachments"))
    joined = messages.join(held.hint("merge"), key_column, "left")
    return joined.withColumn("attachments", F.coalesce("attachments", F.array().cast(held.schema["attachments"].dataType)))
