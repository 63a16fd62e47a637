"""Language of a text by the function words in it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Function words by language, in the order that settles ties.
PROFILES = {
    "English": "the and is in at of with this for that from on have not by as are was were been has had will would can could should patient dose report date",
    "Spanish": "de la el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde paciente notificación",
    "German": "der die und in den von zu das mit sich des ist im für auf dem nicht eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen bericht",
    "French": "le la les de un une des à être et en avoir que pour dans ce il qui ne sur se pas plus pouvoir par je avec tout faire son sa ses autre mais",
    "Italian": "il la lo i gli le di e a da in per tra fra un uno una con su che non si ha sono questo quello più anche come ma del della delle",
    "Portuguese": "de a o que e do da em um para é com não uma os no se na por mais as dos como mas foi ao ele das tem à seu sua ou ser",
}
CODES = {"English": "en", "Spanish": "es", "German": "de", "French": "fr", "Italian": "it", "Portuguese": "pt"}
WORD = r"(?U)\b[^\W\d_]{2,}\b"


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def scores(found: Column) -> Column:
    """array of struct(score, order, language) from an array of words: hits, and half as much again for each different hit."""

    def score(own: list[str]) -> Column:
        return F.size(F.filter(found, lambda w: w.isin(*own))) + F.size(F.array_intersect(F.array(*map(F.lit, own)), found)) * 1.5

    return F.array(*(F.struct(score(p.split()).alias("score"), F.lit(-i).alias("order"), F.lit(name).alias("language")) for i, (name, p) in enumerate(PROFILES.items())))


def language(text: Column, found: Column) -> Column:
    """The best language; Unknown for null, under ten characters, or a score under three.

    ``found`` is words(text): give a column that holds it, so that the text is split once.
    """
    best = F.array_max(scores(found))
    short = F.length(F.trim(F.coalesce(text, F.lit("")))) < 10
    return F.when(short | (best["score"] < 3), "Unknown").otherwise(best["language"])


def flavor(text: Column, chars: Column, pages: Column, lang: Column) -> Column:
    """Kind of document: another language, a scan, a form, an article, else a form; unknown languages of 50 characters on count as English."""
    low = F.lower(F.coalesce(text, F.lit("")))
    # What marks forms and articles.
    form = low.rlike("fda 3500a|form 3500a|cioms-i|cioms i|cioms form|medwatch|yellow card|adverse reaction report|defect report")
    article = low.rlike("abstract|references|case series|case report|cohort|journal|doi:")
    return (
        F.when(~lang.isin("English", "Unknown"), "non_english").when((chars < 200) & (pages <= 3), "scanned_handwritten")
        .when(form, "digital_form").when(article, "literature_article").otherwise("digital_form")
    )


def file_flavor(name: Column) -> Column:
    """Kind of document by its file name."""
    low = F.lower(name)
    return F.when(low.rlike("cioms|fda|form"), "digital_form").when(low.rlike("clinic|handwritten"), "scanned_handwritten").when(low.rlike("article|journal"), "literature_article").otherwise("digital_form")
