"""JSON of model answers: found, parsed, and repaired where it doesn't parse; the checks on what an answer must hold."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import UNSTATED, any_of, json_candidate, key

#: Quotes and what closes them; typographic ones come in any mix.
QUOTES = {'"': '"', "'": "'", "\u201c": '"\u201c\u201d', "\u201d": '"\u201c\u201d', "\u2018": "'\u2018\u2019", "\u2019": "'\u2018\u2019"}
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
#: The value of a key at which the text breaks off.
LOST = "Not stated"
_BARE = re.compile(r"[A-Za-z_]\w*")
_PLAIN = re.compile(r"true|false|null|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?")


class _Lenient:
    """Reads one value from damaged JSON in a single pass: what is missing is supplied, what can't be read is a ValueError.

    Strings may hold raw control characters; keys may be bare; members may stand on lines of their own without commas, and a comma
    may follow the last; where the text ends everything still open is closed.
    """

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def peek(self) -> str:
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1
        return self.text[self.at : self.at + 1]

    def string(self) -> str:
        closing, out = QUOTES[self.text[self.at]], []
        self.at += 1
        while self.at < len(self.text):
            c = self.text[self.at]
            self.at += 1
            if c in closing:
                break
            if c == "\\" and self.at < len(self.text):
                c = self.text[self.at]
                self.at += 1
                code = self.text[self.at : self.at + 4]
                if c == "u" and len(code) == 4 and all(x in "0123456789abcdefABCDEF" for x in code):
                    c, self.at = chr(int(code, 16)), self.at + 4
                else:
                    c = ESCAPES.get(c, c)
            out.append(c)
        return "".join(out)

    def word(self, shape: re.Pattern) -> str:
        m = shape.match(self.text, self.at)
        if not m:
            raise ValueError(f"unexpected text at {self.at}")
        self.at = m.end()
        return m[0]

    def value(self):
        c = self.peek()
        if c == "{":
            return dict(self.members(self.pair, "}"))
        if c == "[":
            return list(self.members(self.value, "]"))
        return self.string() if c in QUOTES and c else json.loads(self.word(_PLAIN))

    def pair(self) -> tuple:
        name = self.string() if self.peek() in QUOTES else self.word(_BARE)
        colon = self.peek()
        if colon and colon != ":":
            raise ValueError(f"no colon at {self.at}")
        self.at += len(colon)
        return name, self.value() if self.peek() else LOST

    def members(self, read: Callable[[], object], end: str):
        self.at += 1
        while (c := self.peek()) not in ("", end):
            yield read()
            before = self.at
            c = self.peek()
            if c == ",":
                self.at += 1
            elif c not in ("", end) and "\n" not in self.text[before : self.at]:
                raise ValueError(f"no comma at {self.at}")
        self.at += len(c)


def repair(text: str | None) -> str | None:
    """An object's JSON from a damaged one, or null."""
    reader = _Lenient(text or "")
    try:
        found = reader.value()
    except (ValueError, RecursionError):
        return None
    return json.dumps(found, ensure_ascii=False) if isinstance(found, dict) and not reader.peek() else None


@F.pandas_udf(StringType())
def _repaired(texts: pd.Series) -> pd.Series:
    return texts.map(lambda s: None if s is None else repair(s))


def parsed(answers: DataFrame, text: str, out: str = "answer") -> DataFrame:
    """answers with columns ``out`` (variant object or null), ``{out}_error`` and ``{out}_repaired``.

    Null or blank answers, those without an object and those beyond repair give null and an error. Only answers that
    don't parse as they are go to Python.
    """
    found = F.coalesce(json_candidate(F.col(text)), F.concat(F.regexp_extract(F.regexp_replace(text, "```[a-z]*", ""), r"(?s)(\{.*)", 1)))
    rows = answers.withColumn("_found", F.nullif(found, F.lit(""))).withColumn("_plain", F.try_parse_json("_found"))
    rows = rows.withColumn("_mended", _repaired(F.when(F.col("_plain").isNull(), F.col("_found"))))
    value = F.coalesce("_plain", F.try_parse_json("_mended"))
    blank = F.trim(F.coalesce(F.col(text), F.lit(""))) == ""
    error = F.when(blank, "Empty LLM response text").when(F.col("_found").isNull(), "Expected JSON object").when(value.isNull(), "JSONDecodeError")
    return rows.withColumn(out, value).withColumn(f"{out}_error", error).withColumn(f"{out}_repaired", F.col("_plain").isNull() & value.isNotNull()).drop("_found", "_plain", "_mended")


# Sections by category, of which an answer needs one; fields that don't count as content; words that mark clinical text.
SECTIONS = {
    "icsr": ("patient", "product", "reaction", "reporter"),
    "pqc": ("product_name", "lot_number", "defect_type", "defect_description"),
    "mi": ("product_or_topic", "inquiry_type", "question_text"),
}
MISSING = {
    "icsr": "'icsr' object is missing essential sections (patient, product, reaction, reporter)",
    "pqc": "'pqc' object is missing essential fields (product_name, lot_number, defect_type)",
    "mi": "'mi' object is missing essential fields (product_or_topic, question_text)",
}
NO_CONTENT = {"icsr": ("status", "citation"), "pqc": ("citation", "packaging_breached", "photo_detected", "requires_human_review"), "mi": ("citation", "explicit_no_ae_no_pqc")}
CLINICAL = ("patient", "adverse", "reaction", "hospital", "mg", "dose", "tablet", "vial", "batch", "lot", "defect", "complaint", "inquiry", "sepsis", "anaphylaxis", "seizure", "angioedema", "rash", "fever", "pain", "doctor", "dr.")
CATEGORY = {"icsr": "ICSR", "pqc": "PQC", "mi": "MI", "not_relevant": "Not Relevant"}


def _fields(answer: Column, path: str) -> Column:
    """A section as map from field to text, null if it is no object; nested values as JSON."""
    section = F.try_variant_get(answer, path, "variant")
    return F.when(F.schema_of_variant(section).startswith("OBJECT"), F.from_json(section.cast("string"), "map<string,string>"))


def _content(fields: Column, without: tuple[str, ...]) -> Column:
    return F.map_values(F.map_filter(fields, lambda k, v: ~k.isin(*without)))


def schema_fault(answer: Column, active: dict[str, Column], text: Column) -> Column:
    """The first reason why a parsed answer won't do, or null: a missing or empty section of an active category, or
    nothing but unstated values for a long clinical text."""
    out = F.when(answer.isNull(), "Expected JSON object root, got NoneType")
    held = []
    for name, wanted in active.items():
        fields = _fields(answer, f"$.{name}")
        out = out.when(wanted & fields.isNull(), f"Missing or invalid '{name}' object for active {CATEGORY[name]} category")
        if name in SECTIONS:
            out = out.when(wanted & ~F.arrays_overlap(F.map_keys(fields), F.array(*map(F.lit, SECTIONS[name]))), MISSING[name])
            parts = [_fields(answer, f"$.icsr.{s}") for s in ("patient", "reporter", "product", "reaction")] if name == "icsr" else [fields]
            for part in parts:
                values = _content(part, NO_CONTENT[name])
                held.append(F.when(wanted & values.isNotNull(), values).otherwise(F.array().cast("array<string>")))
    values = F.flatten(F.array(*held))
    words = F.size(F.filter(F.array(*(F.when(any_of(text, (w,)), 1) for w in CLINICAL)), lambda x: x.isNotNull()))
    empty = (F.size(values) > 0) & ~F.exists(values, lambda v: ~key(v).isin(*UNSTATED["hull"], "[]"))
    clinical = (F.length(F.trim(text)) > 300) & (words >= 2) & ~active.get("not_relevant", F.lit(False))
    return out.when(clinical & empty, F.concat(F.lit("Suspicious empty extraction hull: all "), F.size(values).cast("string"), F.lit(" fields are unstated")))
