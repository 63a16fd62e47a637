"""Column helpers for what a reviewer sees: labels, likeness of names, support of values, seriousness, tables as text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_unstated, key

# Labels of statuses and actions.
STATUS_LABELS = {"REVIEWED": "Reviewed", "OVERRIDDEN": "Overridden", "RECEIVED": "Needs Review", "TRIAGED": "Needs Review"}
ACTION_LABELS = {
    "REVIEWER_CONFIRM": "Confirmed by Reviewer", "CONFIRM_CASE": "Confirmed by Reviewer", "ACCEPT": "Confirmed by Reviewer", "OVERRIDE_CATEGORY": "Category Override", "CATEGORY_OVERRIDE": "Category Override",
    "OVERRIDE_FIELD": "Field Override", "EDIT_FIELD": "Field Override", "OVERRIDE": "Reviewer Override", "INGESTION": "System Ingested", "TRIAGE_COMPLETE": "AI Triage Complete", "AI_TRIAGE_COMPLETED": "AI Triage Complete",
}
# Kinds of source by words in their description, in order; words that support nothing; phrases of absence.
SOURCE_KINDS = (("defect_image", "defect|photo|image"), ("scanned_page", "scanned|handwritten"), ("table_cell", "table"), ("email_header", "header"), ("email_body", "email"), ("pdf_text", "pdf"))
COMMON = ("with", "from", "this", "that", "have", "been", "were", "also", "daily", "once", "oral", "null", "none")
ABSENT = ("not stated", "not done", "not performed", "not attempted", "unknown", "unspecified", "not recorded", "omitted", "none reported", "n/a", "not applicable")
NO_SNIPPETS = ("not stated", "null", "-", "unknown")
VERIFIED = ("grounding verified", "verified against document source")
NO_HIGHLIGHTS = ("stat", "with", "from", "this", "that", "were", "have", "been")
#: Reaction booleans: criteria that set them (extraction; reconciliation) and the criterion that stands for them.
SERIOUS = {
    "hospitalization": ("hospital|inpatient", "hospital|inpatient", "hospital|inpatient", "Hospitalization"),
    "life_threatening": ("life", "life-threatening|life threatening", "life-threatening|life threatening", "Life-threatening"),
    "death": ("death|fatal", "death|fatal", "death|fatal", "Death"),
    "disability": ("disab", "disab|incapacit", "disab", "Disability/Incapacity"),
    "congenital_anomaly": ("congenital", "congenital|birth defect", "congenital", "Congenital Anomaly"),
    "medically_important": ("medically|significant", "medically important|medically significant|other medically", "medically", "Other Medically Important Condition"),
}


def one_of(c: Column, table: dict[str, str], other: Column) -> Column:
    """The table's entry for a value, else ``other``."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), c), other)


def status_label(c: Column) -> Column:
    return one_of(c, STATUS_LABELS, c)


def action_label(c: Column) -> Column:
    return one_of(F.upper(c), ACTION_LABELS, c)


def camel(c: Column) -> Column:
    """snake_case as camelCase, lower-cased first."""
    parts = F.split(F.lower(c), "_")
    rest = F.transform(F.slice(parts, 2, 1 << 20), lambda p: F.when(p.rlike("^[a-z0-9]"), F.concat(F.upper(F.left(p, F.lit(1))), F.substring(p, 2, 1 << 20))).otherwise(F.concat(F.lit("_"), p)))
    return F.concat(parts[0], F.array_join(rest, ""))


def field_label(c: Column) -> Column:
    """A field's name as words, each with its first letter upper; capitals inside stay, a category's prefix goes."""
    words = F.regexp_replace(F.regexp_replace(c, "(?i)^(mi_|pqc_|icsr_)", ""), "([a-z0-9])([A-Z])", "$1 $2")
    words = F.split(F.trim(F.regexp_replace(words, "[_-]+", " ")), " ")
    shown = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 1 << 20))), " ")
    return F.when(F.coalesce(c, F.lit("")) == "", "Parameter").otherwise(shown)


def source_kind(kind: Column, filename: Column) -> Column:
    """Kind of source from its description, else from the file's name."""
    by_name = F.when(F.lower(filename).endswith(".pdf"), "pdf_text").otherwise("email_body")
    out = F.when(F.coalesce(kind, F.lit("")) == "", by_name)
    for name, words in SOURCE_KINDS:
        out = out.when(F.lower(kind).rlike(words), name)
    return out.otherwise(by_name)


def professional(c: Column) -> Column:
    """Health professional: yes, no, the text itself, or null where unstated."""
    return F.when(key(c).isin("yes", "true", "y", "confirmed"), "Yes (HCP Confirmed)").when(key(c).isin("no", "false", "n"), "No").when(~is_unstated(c, "view"), c)


def supports_value(snippet: Column, value: Column) -> Column:
    """The snippet has the value, its first number of two digits or more, or one of its words of four letters or more."""
    v, s = key(value), F.lower(snippet)
    digits = F.regexp_extract(v, r"([0-9]+)", 1)
    words = F.filter(F.split(v, r"[\s,;()/-]+"), lambda w: (F.length(w) >= 4) & ~w.isin(*COMMON))
    found = s.contains(v) | ((F.length(digits) >= 2) & s.contains(digits)) | F.exists(words, lambda w: s.contains(w))
    return F.coalesce((s != "") & ~v.isin("", "not stated", "unknown") & found, F.lit(False))


def supports_absence(snippet: Column, field: Column, label: Column) -> Column:
    """The snippet says that something is absent, and names the field (or the field has no word to name)."""
    s = key(snippet)
    names = F.filter(F.split(F.lower(F.concat_ws(" ", field, label)), r"[\s,;()_/-]+"), lambda w: (F.length(w) >= 4) & ~w.isin("field", "datum", "outcome", "value"))
    says = s.rlike(r"\b(" + "|".join(ABSENT) + r")\b") & ~s.isin("", *NO_SNIPPETS) & ~s.rlike("|".join(VERIFIED))
    return F.coalesce(says & ((F.size(names) == 0) | F.exists(names, lambda w: s.contains(w))), F.lit(False))


def match_score(rationale: Column, result: Column, confidence: Column) -> Column:
    """Percentage in a rationale, else by how the support is worded; null without support."""
    r = F.coalesce(rationale, F.lit(""))
    found = [F.nullif(F.regexp_extract(r, p, 1), F.lit("")) for p in (r"(?i)\[RapidFuzz:\s*([0-9]+)%", r"(?i)RapidFuzz.*?([0-9]+)%", r"(?i)([0-9]+(?:\.[0-9]+)?)\s*%\s*(?:token match|lexical|match)")]
    low = F.lower(r)
    worded = F.when(low.rlike("verbatim|directly contains|exact"), 100).when(low.contains("normalized"), 98).when(confidence > 0.8, F.round(confidence * 100).cast("int")).otherwise(85)
    return F.coalesce(F.floor(F.coalesce(*found).cast("double") + 0.5).cast("int"), F.when(result == "SUPPORTS", worded))


def cohort_size(text: Column, cases: Column) -> Column:
    """Patients of a cohort that a text names, where single cases stand beside it."""
    one = F.nullif(F.regexp_extract(text, r"(?i)([0-9]+)[-\s]patient\s+(?:cohort|registry|population|study)", 1), F.lit(""))
    two = F.nullif(F.regexp_extract(text, r"(?i)cohort of\s+([0-9]+)\s+patients", 1), F.lit(""))
    return F.when(cases > 0, F.coalesce(one, two)).cast("int")


def seriousness_text(given: Column, criteria: Column, hospital: Column, life: Column, death: Column, medical: Column) -> Column:
    valid = F.filter(criteria, lambda c: (c != "") & ~F.lower(c).contains("non-serious") & ~F.lower(c).contains("unknown"))
    return (
        F.when(~F.coalesce(given, F.lit("")).isin("", "Non-Serious", "Unknown"), given).when(F.size(valid) > 0, F.concat(F.lit("Serious ("), F.array_join(valid, " / "), F.lit(")")))
        .when(hospital, "Serious (Hospitalization)").when(life, "Serious (Life-threatening)").when(death, "Serious (Death/Fatal)").when(medical, "Serious (Medically Significant)").otherwise("Non-Serious")
    )


def extracted_serious(name: str, given: Column, criteria: Column) -> Column:
    """A reaction's boolean: what is given, or what the criteria say; for a stay in hospital and medical importance criteria outweigh a given no."""
    said = F.coalesce(F.lower(F.array_join(criteria, " ")).rlike(SERIOUS[name][0]), F.lit(False))
    return F.coalesce(given | said, said) if name in ("hospitalization", "medically_important") else F.coalesce(given, said)


def reconciled_serious(criteria: Column, flags: dict[str, Column]) -> tuple[Column, dict[str, Column]]:
    """(criteria, booleans) after each has been brought in line with the other; an explicit non-serious clears all booleans."""
    low = F.transform(criteria, lambda c: F.lower(F.trim(c)))
    says = lambda words: F.exists(low, lambda c: c.rlike(words))
    none = F.exists(low, lambda c: c.contains("non-serious") | c.contains("nonserious"))
    new = {name: F.when(none, False).otherwise(F.coalesce(flag, F.lit(False)) | says(SERIOUS[name][1])) for name, flag in flags.items()}
    more = F.array_compact(F.array(*(F.when(new[name] & ~says(SERIOUS[name][2]), SERIOUS[name][3]) for name in flags)))
    return F.when(none, criteria).otherwise(F.concat(criteria, more)), new


def admission_date(given: Column, onset: Column, hospital: Column) -> Column:
    return F.when(~is_unstated(given, "extract"), F.trim(given)).when(hospital & ~F.coalesce(key(onset).isin("not stated", "none", ""), F.lit(True)), F.trim(onset)).otherwise("Not stated")


def stats_text(confirmed: Column, unstated: Column, uncertain: Column, conflict: Column) -> Column:
    parts = ((confirmed, "Confirmed"), (unstated, "Not Stated"), (uncertain, "Uncertain"), (conflict, "Conflict"))
    return F.array_join(F.array_compact(F.array(*(F.when(n > 0, F.concat(n.cast("string"), F.lit(" " + name))) for n, name in parts))), " · ")


def case_label(number: Column, identifier: Column, age: Column, sex: Column) -> Column:
    """Number of a case with its identifier, else with age and sex, else alone."""
    head = F.concat(F.lit("Case "), number.cast("string"))
    person = F.concat_ws(" ", F.when(age != "", F.concat(age, F.lit("yo"))), F.nullif(sex, F.lit("")))
    known = ~F.coalesce(identifier, F.lit("")).isin("", "Not stated", "Unknown")
    return F.when(known, F.concat(head, F.lit(" — "), identifier)).when(person != "", F.concat(head, F.lit(" — "), person)).otherwise(head)


def categories(primary: Column, labels: Column) -> Column:
    """Parts of a joined primary category; else it and the labels, each once; else that triage is pending."""
    every = F.array_distinct(F.filter(F.concat(F.array(primary), F.coalesce(labels, F.array().cast("array<string>"))), lambda c: F.coalesce(c != "", F.lit(False))))
    return F.when(primary.contains("+"), F.transform(F.split(primary, r"\+"), lambda c: F.trim(c))).when(F.size(every) > 0, every).otherwise(F.array(F.lit("Pending Triage")))


_MARK = r"(?:\(?\d+[.)]|-|\*|•)"


def asked(text: Column) -> Column:
    """Questions of a text: marked lines if there are several, else marked parts of a line, else what ends with a question mark, else all of it."""
    lines = F.transform(F.split(text, r"\r?\n"), lambda x: F.regexp_extract(F.trim(x), f"^{_MARK}\\s*(.+)$", 1))
    long_ = lambda parts: F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: F.length(x) > 5)
    bare = lambda x: F.trim(F.regexp_replace(x, f"^{_MARK}\\s*", ""))
    parts, marked = F.split(text, f"(?:^|\\s+){_MARK}\\s+"), F.regexp_extract_all(text, F.lit(r"([^.?!;]*\?)"), F.lit(1))
    none = F.array().cast("array<string>")
    return (
        F.when(F.coalesce(text, F.lit("")).isin("", "Not stated"), none).when(F.size(long_(lines)) > 1, long_(lines)).when(F.size(long_(parts)) > 1, long_(parts))
        .when(F.size(marked) > 0, F.filter(F.transform(marked, bare), lambda x: F.length(x) > 5)).otherwise(F.array(bare(text)))
    )


def is_foreign(language: Column) -> Column:
    return F.coalesce(~key(language).isin("", "english", "en", "unknown", "und"), F.lit(False))


def foreign_language(language: Column, attachments: Column) -> Column:
    """Language other than English of a message or of its first such attachment (array of struct(language, flavor)); null if there is none.

    A flavor of another language counts unless the attachment's language says English.
    """
    odd = lambda a: is_foreign(a["language"]) | F.coalesce((a["flavor"] == "non_english") & ~F.coalesce(key(a["language"]).isin("english", "en"), F.lit(False)), F.lit(False))
    first = F.get(F.filter(attachments, odd), F.lit(0))
    own = F.nullif(F.coalesce(first["language"], F.lit("")), F.lit(""))
    return F.when(first.isNotNull() & is_foreign(first["language"]), first["language"]).when(is_foreign(language), language).when(first.isNotNull(), F.coalesce(own, F.lit("Non-English")))


def elevated(interpretation: Column) -> Column:
    return F.coalesce(F.lower(interpretation).rlike("elevated|high"), F.lit(False))


def same_file(one: Column, two: Column) -> Column:
    """Names of one file: equal, or one within the other."""
    a, b = key(one), key(two)
    return F.coalesce((a != "") & (b != "") & (a.contains(b) | b.contains(a)), F.lit(False))


def highlight_terms(value: Column, snippet: Column) -> Column:
    """What to look for in a page, in order: what a value has in brackets, the value, the snippet, its long words."""
    v, s = key(value), F.lower(F.trim(F.regexp_replace(snippet, r"[\r\n]+", " ")))
    inner = F.nullif(F.trim(F.regexp_extract(v, r"\(([^)]+)\)", 1)), F.lit(""))
    stated = ~is_unstated(value, "view") & (F.length(v) >= 2)
    quoted = ~is_unstated(snippet, "view")
    own = F.array(F.when(stated, inner), F.when(stated & inner.endswith("ed"), F.concat(F.regexp_replace(inner, "ed$", ""), F.lit("ation"))), F.when(stated & ~v.isin("yes", "no", "unknown", "none"), v), F.when(quoted & (F.length(s) >= 4), s))
    words = F.filter(F.transform(F.split(s, r"\s+"), lambda w: F.regexp_replace(w, r"[(),;:.\"']", "")), lambda w: ((F.length(w) >= 4) | ((F.length(w) >= 3) & w.rlike("[0-9]"))) & ~w.isin(*NO_HIGHLIGHTS))
    longest = F.transform(F.array_sort(F.transform(words, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w")))), lambda x: x["w"])
    return F.array_distinct(F.concat(F.array_compact(own), F.when(quoted, longest).otherwise(F.array().cast("array<string>"))))


def highlighted(text: Column, term: Column) -> Column:
    """A term stands in a text between other signs than letters and digits; a term of eight characters or more may stand anywhere."""
    t, low = F.lower(term), F.lower(text)
    parts = F.concat(F.array(F.lit("")), F.split(low, F.concat(F.lit(r"\Q"), t, F.lit(r"\E"))))
    whole = F.exists(F.sequence(F.lit(2), F.size(parts) - 1), lambda i: ~F.element_at(parts, i).rlike("[a-z0-9]$") & ~F.element_at(parts, i + 1).rlike("^[a-z0-9]"))
    return F.coalesce((F.size(parts) > 2) & (whole | (F.length(t) >= 8)), F.lit(False))


def _cells(row: Column) -> Column:
    return F.transform(row, lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "\n", " ")))


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """What ``then`` makes of a value: a lambda's variable, so that it isn't computed again wherever, and for each element for which, it is used."""
    return F.transform(F.array(value), then)[0]


def row_text(headers: Column, cells: Column) -> Column:
    """A table's row as "header: value" parts; its cells where all are empty."""
    pairs = F.zip_with(_cells(headers), _cells(cells), lambda h, v: F.when(F.coalesce(v, F.lit("")) != "", F.when(F.coalesce(h, F.lit("")) != "", F.concat(h, F.lit(": "), v)).otherwise(v)))
    said = F.array_compact(F.slice(pairs, 1, F.least(F.size(headers), F.size(cells))))
    return _once(said, lambda x: F.when(F.size(x) > 0, F.array_join(x, " | ")).otherwise(F.array_join(_cells(cells), " ")))


def markdown(rows: Column) -> Column:
    """A table (array of rows, the first one the header) as markdown; short rows are padded, long ones cut."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    def table(head: Column) -> Column:
        width = F.size(head)
        fitted = lambda r: F.slice(F.concat(_cells(r), F.array_repeat(F.lit(""), F.greatest(F.lit(0), width - F.size(r)))), 1, width)
        body = F.transform(F.slice(rows, F.lit(2), F.size(rows)), lambda r: line(fitted(r)))
        return F.array_join(F.concat(F.array(line(head), line(F.array_repeat(F.lit("---"), width))), body), "\n")

    return _once(_cells(rows[0]), table)


def header_text(sender: Column, address: Column, date: Column, subject: Column, message_id: Column) -> Column:
    s = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(F.lit("From: "), s(sender), F.lit(" <"), s(address), F.lit(">\nDate: "), s(date), F.lit("\nSubject: "), s(subject), F.lit("\nMessage-ID: "), s(message_id))


def page_marked(pages: Column) -> Column:
    """Texts of pages (array of struct(page, text)) in order, each under a marker; a page without text is its marker alone."""
    marked = F.transform(F.array_sort(pages), lambda p: F.concat_ws("\n\n", F.concat(F.lit("--- PAGE "), p["page"].cast("string"), F.lit(" ---")), F.nullif(F.trim(p["text"]), F.lit(""))))
    return F.array_join(marked, "\n\n")


def case_id(given: Column, subject: Column, message_id: Column, running: Column) -> Column:
    """CASE-<n> as given, else as the subject or message id says, else the running number (see ``review.running_numbers``)."""
    said = F.coalesce(*(F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?i)CASE-?(0[1-9]|1[0-2])\b", 1), F.lit("")) for c in (subject, message_id)))
    return F.when(given.rlike(r"(?i)^CASE-\d+$"), F.upper(given)).otherwise(F.concat(F.lit("CASE-"), F.coalesce(said, F.lpad(running.cast("string"), F.greatest(F.lit(2), F.length(running.cast("string"))), F.lit("0")))))
