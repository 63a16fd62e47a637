"""Where snippets stand in their documents, also with words changed: runs of words vote for the place of the snippet's first word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import dealt

SPACE = r"\x20\x09-\x0D"
#: Texts and snippets to a task, before they become runs.
TEXTS = 5_000


def words(text: Column) -> Column:
    """Lower-cased words of a text."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"[^{SPACE}]+"), F.lit(0))


def word_runs(rows: DataFrame, by: list[str], text: str, k: int) -> DataFrame:
    """(by, place, run): every ``k`` words in a row, by the number of the first from 0; none for shorter texts."""
    held = rows.select(*by, words(F.col(text)).alias("_w")).filter(F.size("_w") >= k)
    runs = F.transform(F.sequence(F.lit(1), F.size("_w") - k + 1), lambda i: F.array_join(F.slice("_w", i, k), " "))
    return held.select(*by, F.posexplode(runs).alias("place", "run"))


def shared_runs(snippets: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(document_id, n, at, place): each run of a snippet (document_id, n, snippet), wherever its document's text (document_id, text) has it too.

    Texts and snippets are dealt by document before they become runs, which are many times their size and stay where they are.
    """
    own = snippets.select("document_id", "n", F.col("snippet").alias("text"), F.lit(True).alias("_asks"))
    there = texts.select("document_id", F.lit(None).cast(snippets.schema["n"].dataType).alias("n"), "text", F.lit(False).alias("_asks"))
    both = dealt(own.unionByName(there).filter(F.col("document_id").isNotNull()), "document_id", most=TEXTS)
    runs = word_runs(both, ["document_id", "n", "_asks"], "text", k)
    asks, places = F.collect_list(F.when(F.col("_asks"), F.struct("n", F.col("place").alias("at")))), F.collect_list(F.when(~F.col("_asks"), F.col("place")))
    met = runs.groupBy("document_id", "run").agg(asks.alias("_of"), places.alias("_places")).filter((F.size("_of") > 0) & (F.size("_places") > 0))
    return met.select("document_id", "_places", F.inline("_of")).select("document_id", "n", "at", F.explode("_places").alias("place"))


def place_snippets(snippets: DataFrame, texts: DataFrame, k: int = 3, slack: int = 2) -> DataFrame:
    """snippets (document_id, n, snippet) with tier, share, char_start and char_end in their document's text (document_id, text).

    Tier "runs": each run of ``k`` words that snippet and text share votes for a diagonal, its place in the text less its place in the snippet. A word put in, or
    left out, moves the diagonal by one, so votes within ``slack`` count together; most votes win, then the diagonal's own, then the earlier place. The
    span is that of the runs that voted; share: how many of the snippet's runs did. Tier "clause": a snippet without a run in common, or of fewer words,
    where it stands as it is. Else all are null.
    Texts move, their runs don't.
    """
    own = ["document_id", "n"]
    met = shared_runs(snippets, texts, k)
    votes = met.groupBy(*own, (F.col("place") - F.col("at")).alias("diagonal")).agg(F.countDistinct("at").alias("votes"), F.min("place").alias("first"), F.max("place").alias("last"))
    near = Window.partitionBy(*own).orderBy("diagonal").rangeBetween(-slack, slack)
    near_votes = votes.select(*own, "diagonal", "votes", F.sum("votes").over(near).alias("all"), F.min("first").over(near).alias("first"), F.max("last").over(near).alias("last"))
    best = Window.partitionBy(*own).orderBy(F.desc("all"), F.desc("votes"), "diagonal")
    placed = near_votes.withColumn("_rank", F.row_number().over(best)).filter("_rank = 1").select(*own, "all", "first", "last")
    rows = snippets.join(placed.hint("merge"), own, "left").join(texts.select("document_id", F.col("text").alias("_text")).hint("merge"), "document_id", "left")
    # the text's words with the space after them: a column of its own, so that it is made once for a row
    rows = rows.withColumn("_raw", F.when(F.col("all").isNotNull(), F.regexp_extract_all(F.col("_text"), F.lit(f"[^{SPACE}]+[{SPACE}]*"), F.lit(0))))
    raw = F.col("_raw")
    lead = F.length(F.regexp_extract(F.col("_text"), f"^[{SPACE}]*", 0))
    length = lambda part: F.aggregate(part, F.lit(0), lambda total, w: total + F.length(w))
    bare = lambda w: F.length(F.regexp_replace(w, f"[{SPACE}]+$", ""))
    start = lead + length(F.slice(raw, F.lit(1), F.col("first")))
    final = F.col("last") + k
    end = lead + length(F.slice(raw, F.lit(1), final - 1)) + bare(F.element_at(raw, final))
    clause = F.nullif(F.position(F.lower(F.trim("snippet")), F.lower("_text")), F.lit(0)) - 1
    said = (F.trim("snippet") != "") & clause.isNotNull()
    by_runs = F.col("all").isNotNull()
    n_runs = F.greatest(F.size(words(F.col("snippet"))) - (k - 1), F.lit(1))
    return rows.select(
        *snippets.columns, F.when(by_runs, "runs").when(said, "clause").alias("tier"), F.when(by_runs, F.least(F.lit(1.0), F.col("all") / n_runs)).when(said, 1.0).alias("share"),
        F.when(by_runs, start).when(said, clause).alias("char_start"), F.when(by_runs, end).when(said, clause + F.length(F.trim("snippet"))).alias("char_end"),
    )
