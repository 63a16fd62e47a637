"""The one place in a text that a snippet stands for, or none where there are several."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _place(tier: str, start: Column, length: Column) -> Column:
    return F.struct(F.lit("EXACT").alias("state"), F.lit(tier).alias("tier"), start.cast("int").alias("char_start"), (start + length).cast("int").alias("char_end"))


def _nowhere(state: str) -> Column:
    none = F.lit(None).cast("int")
    return F.struct(F.lit(state).alias("state"), F.lit(None).cast("string").alias("tier"), none.alias("char_start"), none.alias("char_end"))


def _spread(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"\s+", " "))


def _unspread(text: Column, spread: Column, n: Column) -> Column:
    """How many characters of a text the first ``n`` of it have been, before each run of white space became one space."""
    runs = F.slice(F.regexp_extract_all(text, F.lit(r"\s+"), F.lit(0)), F.lit(1), F.regexp_count(F.substring(spread, F.lit(1), n), F.lit(" ")))
    return F.aggregate(runs, n.cast("int"), lambda total, run: total + F.length(run) - 1)


def anchor(text: Column, snippet: Column, start: Column, end: Column) -> Column:
    """struct(state, tier, char_start, char_end), places from 0.

    In order: given offsets whose text agrees on 15 characters; the only occurrence, whatever the case; the only one
    with white space free (10 characters or more); the only one of a clause (20 or more). Several occurrences give
    MULTIPLE_OCCURRENCES, never the first; an empty snippet or text NONE; else NOT_FOUND.
    """
    s, low = F.trim(snippet), F.lower(text)
    ls = F.lower(s)
    given = F.substring(text, start + 1, end - start)
    inside = (start >= 0) & (end > start) & (end <= F.length(text))
    agrees = _spread(given).contains(F.left(_spread(s), F.lit(15))) | _spread(s).contains(F.left(_spread(given), F.lit(15)))
    first = F.position(ls, low)
    again = F.position(ls, low, first + 1)
    # white space made one space on both sides and looked for as it is: a pattern of a long snippet would go too deep
    spread, one = F.regexp_replace(low, r"\s+", " "), F.regexp_replace(ls, r"\s+", " ")
    loose = F.position(one, spread)
    loose_again = F.position(one, spread, loose + F.length(one))
    loose_start, loose_end = _unspread(low, spread, loose - 1), _unspread(low, spread, loose - 1 + F.length(one))
    long_ = F.length(_spread(s)) >= 10
    clauses = F.filter(F.transform(F.split(s, r"[.;\n]+"), lambda c: F.lower(F.trim(c))), lambda c: F.length(c) >= 20)
    seen = F.transform(clauses, lambda c: F.struct(F.position(c, low).alias("at"), F.length(c).alias("n"), c.alias("c")))
    only = F.filter(seen, lambda x: (x["at"] > 0) & (F.position(x["c"], low, x["at"] + 1) == 0))
    many = F.exists(seen, lambda x: x["at"] > 0)
    return (
        F.when(F.coalesce(s == "", F.lit(True)) | F.coalesce(text == "", F.lit(True)), _nowhere("NONE"))
        .when(F.coalesce(inside & agrees, F.lit(False)), _place("offsets", start, end - start))
        .when((first > 0) & (again == 0), _place("exact", first - 1, F.length(s)))
        .when(first > 0, _nowhere("MULTIPLE_OCCURRENCES"))
        .when(long_ & (loose > 0) & (loose_again == 0), _place("spaced", loose_start, loose_end - loose_start))
        .when(long_ & (loose > 0), _nowhere("MULTIPLE_OCCURRENCES"))
        .when(F.size(only) > 0, _place("clause", F.get(only, F.lit(0))["at"] - 1, F.get(only, F.lit(0))["n"]))
        .when(many, _nowhere("MULTIPLE_OCCURRENCES")).otherwise(_nowhere("NOT_FOUND"))
    )
