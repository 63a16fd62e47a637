"""Column helpers for the text of messages, facts and fields."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as unstated, by place of use (after trimming and lower-casing).
UNSTATED = {
    "verify": ("not stated", "unknown", "none", "n/a", ""),
    "retrieve": ("not stated", "none", "unknown"),
    "extract": ("not stated", "none", "unknown", ""),
    "validate": ("not stated", "unknown", "none", "n/a", "", "not reported"),
    "normalize": ("not stated", "unknown", "n/a", ""),
    "persist": ("", "not stated", "unknown", "null", "n/a", "none"),
    "view": ("", "not stated", "null", "n/a", "-", "unknown", "not done"),
    "hull": ("", "not stated", "none", "unknown", "n/a", "-"),
}

# Routes by substring, in order; countries and sexes by synonym.
ROUTES = (
    ("Oral", ("oral", "p.o.", "po", "oralmente", "per os", "tablets", "capsules")),
    ("Intravenous", ("intravenous", "i.v.", "iv", "intravenosa", "infusion")),
    ("Intramuscular", ("intramuscular", "i.m.", "im")),
    ("Subcutaneous", ("subcutaneous", "s.c.", "sc")),
    ("Topical", ("topical", "derm", "cutaneous")),
    ("Inhalation", ("inhalation", "inh")),
)
COUNTRIES = {
    "United States": ("usa", "us", "united states", "united states of america", "u.s.", "u.s.a."),
    "Spain": ("spain", "españa", "espana"),
    "Germany": ("germany", "deutschland"),
    "France": ("france", "francia"),
    "United Kingdom": ("uk", "united kingdom", "great britain", "england"),
    "Italy": ("italy", "italia"),
    "Japan": ("japan", "nippon"),
}
SEXES = {"Female": ("f", "female", "fem", "mujer", "weiblich", "femenino", "w"), "Male": ("m", "male", "masc", "hombre", "männlich", "masculino")}


def key(c: Column) -> Column:
    return F.lower(F.trim(c))


def is_unstated(c: Column, place: str = "verify") -> Column:
    return F.coalesce(key(c).isin(*UNSTATED[place]), F.lit(True))


def collapse(c: Column) -> Column:
    """White space as one space, lower-cased, trimmed."""
    return F.trim(F.lower(F.regexp_replace(c, r"\s+", " ")))


def sender_name(c: Column) -> Column:
    parts = F.trim(F.translate(F.substring_index(c, "<", 1), '"', ""))
    return F.when(c.contains("<") & c.contains(">"), parts).otherwise(c)


def sender_address(c: Column) -> Column:
    return F.when(c.contains("<") & c.contains(">"), F.trim(F.regexp_extract(c, "<([^>]*)>", 1))).otherwise(c)


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]*>", " ")


def age(c: Column) -> Column:
    return F.when(is_unstated(c, "normalize"), F.lit(None).cast("int")).otherwise(F.regexp_extract(c, r"([0-9]+)", 1).try_cast("int"))


def _by_synonym(c: Column, table: dict[str, tuple[str, ...]], other: Column) -> Column:
    out = F.when(is_unstated(c, "normalize"), F.lit(None).cast("string"))
    for name, words in table.items():
        out = out.when(key(c).isin(*words), F.lit(name))
    return out.otherwise(other)


def capital(c: Column) -> Column:
    """First letter upper, the rest lower case."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def country(c: Column) -> Column:
    return _by_synonym(c, COUNTRIES, F.initcap(F.trim(c)))


def sex(c: Column) -> Column:
    return _by_synonym(c, SEXES, capital(c))


def route(c: Column) -> Column:
    out = F.when(is_unstated(c, "normalize"), F.lit(None).cast("string"))
    for name, parts in ROUTES:
        hit = F.lit(False)
        for part in parts:
            hit = hit | key(c).contains(part)
        out = out.when(hit, F.lit(name))
    return out.otherwise(capital(c))


# Date formats in the order in which they are tried, with the shape that each needs.
DATES = (
    (r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$", "yyyy-M-d"),
    (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "d/M/yyyy"),
    (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "M/d/yyyy"),
    (r"^[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}$", "d.M.yyyy"),
    (r"^[0-9]{1,2}-[A-Za-z]{3}-[0-9]{4}$", "d-MMM-yyyy"),
    (r"^[0-9]{1,2}-[A-Za-z]{3,}-[0-9]{4}$", "d-MMMM-yyyy"),
    (r"^[A-Za-z]{3,} [0-9]{1,2}, [0-9]{4}$", "MMMM d, yyyy"),
    (r"^[A-Za-z]{3} [0-9]{1,2}, [0-9]{4}$", "MMM d, yyyy"),
    (r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$", "yyyy/M/d"),
    (r"^[0-9]{4}\.[0-9]{1,2}\.[0-9]{1,2}$", "yyyy.M.d"),
)


def iso_date(c: Column) -> Column:
    """The first format that fits, else an ISO date inside the text, else a dotted one; null if unstated or none."""
    t = F.trim(c)
    tried = [F.when(t.rlike(shape), F.date_format(F.try_to_timestamp(t, F.lit(form)), "yyyy-MM-dd")) for shape, form in DATES]
    inside = F.nullif(F.regexp_extract(t, r"([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), F.lit(""))
    dotted = F.when(t.rlike(r"[0-9]{2}\.[0-9]{2}\.[0-9]{4}"), F.regexp_replace(F.regexp_extract(t, r"([0-9]{2}\.[0-9]{2}\.[0-9]{4})", 1), r"([0-9]{2})\.([0-9]{2})\.([0-9]{4})", "$3-$2-$1"))
    return F.when(~is_unstated(c, "normalize"), F.coalesce(*tried, inside, dotted))


def snake(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1_$2"), "[^A-Za-z0-9]+", "_"))


def field_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-zA-Z0-9_]", "_")


def valid_confidence(c: Column) -> Column:
    return F.coalesce(~F.isnan(c) & c.between(0, 1), F.lit(False))


def calibrated(c: Column, most: float = 0.98) -> Column:
    return F.least(c, F.lit(most))


def percent_text(c: Column) -> Column:
    shown = F.concat(F.round(c * 100).cast("int").cast("string"), F.lit("%"))
    return F.when(F.coalesce(c, F.lit(0.0)) <= 0, "Pending").when(c >= 1, "98%").otherwise(shown)


def page_number(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(?i)page\s*([0-9]+)", 1), F.lit("")).cast("int")


def json_candidate(c: Column) -> Column:
    """From the first opening to the last closing brace, code fences left out."""
    return F.nullif(F.regexp_extract(F.regexp_replace(c, "```[a-z]*", ""), r"(?s)(\{.*\})", 1), F.lit(""))


def questions(c: Column) -> Column:
    """Numbered or bulleted lines if there are several, else what stands before question marks; over 5 characters."""
    lines = F.filter(F.split(c, "\n"), lambda x: x.rlike(r"^\s*([0-9]+[.)]|[-*])\s+"))
    lines = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"^\s*([0-9]+[.)]|[-*])\s+", "")))
    asked = F.transform(F.filter(F.split(c, r"\?"), lambda x: F.length(F.trim(x)) > 5), lambda x: F.trim(x))
    return F.filter(F.when(F.size(lines) > 1, lines).when(F.size(asked) > 0, asked).otherwise(F.array(F.trim(c))), lambda x: F.length(x) > 5)


# Keyword rules of triage (substrings of the lower-cased text) and of document flavour.
TRIAGE = {
    "ICSR": ("adverse", "reaction", "hospitalized", "shock", "rash", "toxicity", "seizure", "icu", "dili", "steven-johnson", "aki", "angioödem"),
    "PQC": ("defect", "contamination", "particulate", "broken seal", "crimp", "counterfeit", "packaging breach", "crushed"),
    "MI": ("question", "inquiry", "dosing", "dilution", "stability", "crushed", "ng tube"),
    "SPAM": ("conference", "summit", "sponsorship", "marketing", "webinar", "early bird", "registration"),
}


def any_of(c: Column, words: tuple[str, ...], token: bool = False) -> Column:
    words = "|".join(re.escape(w) for w in words)
    return F.lower(c).rlike(rf"(^|[^\p{{L}}\p{{N}}])({words})($|[^\p{{L}}\p{{N}}])" if token else words)


def triage(c: Column, token: bool = False) -> Column:
    """struct(primary, multi, confidence): complaint and reaction together, then complaint, question, promotion, else report."""
    icsr, pqc, spam = (any_of(c, TRIAGE[k], token) for k in ("ICSR", "PQC", "SPAM"))
    mi = any_of(c, TRIAGE["MI"], token) & ~icsr
    row = lambda name, multi, conf: F.struct(F.lit(name).alias("primary"), F.lit(multi).alias("multi"), F.lit(conf).alias("confidence"))
    return F.when(icsr & pqc, row("ICSR", True, 0.95)).when(pqc, row("PQC", False, 0.96)).when(mi, row("MI", False, 0.95)).when(spam, row("Not Relevant", False, 0.99)).otherwise(row("ICSR", False, 0.88))
