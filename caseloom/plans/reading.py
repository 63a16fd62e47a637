"""Registered queries on reading texts and answers: language, sentences, JSON, anchors, questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import anchors, jsonfix
from ..functions import language as G
from ..functions import sentences as S
from ..functions import text as T
from ..operators import anchoring as P
from ..operators import cases as C
from .catalog import query

_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words.split()) + "]"
_SCORES = ", ".join(f"len(list_filter(w, lambda x: list_contains({_LIST(p)}, x))) + 1.5 * len(list_intersect({_LIST(p)}, w)) as s{i}" for i, p in enumerate(G.PROFILES.values()))
_BEST = "greatest(" + ", ".join(f"s{i}" for i in range(6)) + ")"
SQL_LANGUAGE = f"""wd as (select *, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_full_match(x, '\\p{{L}}{{2,}}')) as w from documents), sc as (select *, {_SCORES} from wd),
la as (select * exclude (w), case when length(trim(text)) < 10 or {_BEST} < 3 then 'Unknown' {" ".join(f"when s{i} = {_BEST} then '{n}'" for i, n in enumerate(G.PROFILES))} end as language from sc)"""


def with_language(docs):
    return docs.withColumn("found", G.words(F.col("text"))).withColumn("language", G.language(F.col("text"), F.col("found"))).drop("found")


@query(f"with {SQL_LANGUAGE} select doc_id, language from la")
def detect_language(t):
    return with_language(t("documents")).select("doc_id", "language")


@query(f"with {SQL_LANGUAGE} select lang, language, count(*) as n, sum(n_chars)::bigint as n_chars from la group by 1, 2")
def language_vs_declared(t):
    return with_language(t("documents")).groupBy("lang", "language").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


_FORMS = "fda 3500a|form 3500a|cioms-i|cioms i|cioms form|medwatch|yellow card|adverse reaction report|defect report"


@query(f"""with {SQL_LANGUAGE} select doc_id, case when language not in ('English', 'Unknown') then 'non_english' when length(text) < 200 then 'scanned_handwritten' when regexp_matches(lower(text), '{_FORMS}') then 'digital_form'
 when regexp_matches(lower(text), 'abstract|references|case series|case report|cohort|journal|doi:') then 'literature_article' else 'digital_form' end as flavor from la""")
def flavor_rules(t):
    rows = with_language(t("documents"))
    return rows.select("doc_id", G.flavor(F.col("text"), F.length("text"), F.lit(1), F.col("language")).alias("flavor"))


_WS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_EDGE = r"(^|[^\p{L}\p{N}\p{M}_])"


def _sql_sentences(c: str) -> str:
    t = f"trim(regexp_replace({c}, '{_WS}+', ' ', 'g'))"
    t = f"regexp_replace({t}, '([0-9]+)\\.([0-9]+)', '\\1\ue001\\2', 'g')"
    for a in S.ABBREVIATIONS:
        back = a.replace("\\", "\\\\")
        t = f"regexp_replace({t}, '{_EDGE}{a}\\.', '\\1{back}\ue000', 'gi')"
    for _ in range(2):  # capitals that follow each other share their edges
        t = f"regexp_replace({t}, '{_EDGE}([A-Z])\\.', '\\1\\2\ue000', 'g')"
    t = f"regexp_replace({t}, '([.!?])\\s+', '\\1\ue002', 'g')"
    return f"list_filter(list_transform(string_split({t}, '\ue002'), lambda s: trim(translate(s, '\ue000\ue001', '..'))), lambda s: s <> '')"


@query(f"""with s as (select doc_id, text, {_sql_sentences("text")} as own from documents), g as (select doc_id, len(own) as n_sentences, case when trim(text) in ('', 'Not stated') or starts_with(text, '[EXTRACTION WARNING]') or len(own) between 10 and 15 then text
 when len(own) = 9 then array_to_string(own, ' ') || ' {S.AUDIT_LOG[0]}' || source || '{S.AUDIT_LOG[1]}' when len(own) < 9 then text else array_to_string(own[1:15], ' ') end as summary from s join documents using (doc_id, text))
select doc_id, n_sentences, length(summary)::bigint as n_chars, md5(summary) as summary_md5 from g""")
def sentence_gate(t):
    rows = t("documents").withColumn("own", S.sentences(F.col("text")))
    rows = rows.withColumn("summary", S.gated(F.col("text"), F.col("own"), F.col("source")))
    return rows.select("doc_id", F.size("own").cast("long").alias("n_sentences"), F.length("summary").cast("long").alias("n_chars"), F.md5("summary").alias("summary_md5"))


@query("select event_id, case when event_id % 8 = 7 then null else json_extract(props, '$.k')::int end as k, event_id % 8 not in (0, 1, 7) as repaired, case when event_id % 8 = 7 then 'Expected JSON object' end as error from events")
def model_json_repair(t):
    p = F.col("props")
    broken = [p, F.concat(F.lit("Here:\n```json\n"), p, F.lit("\n```")), F.regexp_replace(p, r"\}$", ",}"), F.regexp_replace(p, r"\}$", ""), F.regexp_replace(p, '"k"', "“k”"), F.regexp_replace(p, '"k"', "k"), F.regexp_replace(p, '"', "'"), F.lit("no object")]
    damaged = F.coalesce(*(F.when(F.col("event_id") % 8 == i, b) for i, b in enumerate(broken)))
    rows = jsonfix.parsed(t("events").select("event_id", damaged.alias("text")), "text")
    return rows.select("event_id", F.try_variant_get("answer", "$.k", "int").alias("k"), F.col("answer_repaired").alias("repaired"), F.col("answer_error").alias("error"))


_KEYWORDS = " + ".join(f"contains(lower(text), '{w}')::int" for w in jsonfix.CLINICAL)


@query(f"""select doc_id, case (doc_id % 6)::int when 0 then 'Expected JSON object root, got NoneType' when 1 then 'Missing or invalid ''icsr'' object for active ICSR category' when 2 then '{jsonfix.MISSING["icsr"].replace("'", "''")}'
 when 3 then case when length(trim(text)) > 300 and {_KEYWORDS} >= 2 then 'Suspicious empty extraction hull: all 2 fields are unstated' end when 4 then '{jsonfix.MISSING["pqc"].replace("'", "''")}' end as fault from documents""")
def schema_gate(t):
    answers = ["none", '{"icsr": 4}', '{"icsr": {"narrative": "x"}}', '{"icsr": {"patient": {"age": "Not stated", "sex": "Unknown", "citation": "p. 1"}}}', '{"icsr": {"patient": {"age": "5"}}, "pqc": {"x": 1}}', '{"icsr": {"patient": {"age": "5"}}}']
    k = F.col("doc_id") % 6
    given = F.coalesce(*(F.when(k == i, F.lit(a)) for i, a in enumerate(answers)))
    rows = jsonfix.parsed(t("documents").select("doc_id", "text", given.alias("given")), "given")
    active = {"icsr": F.lit(True), "pqc": k == 4}
    return rows.select("doc_id", jsonfix.schema_fault(F.col("answer"), active, F.col("text")).alias("fault"))


def _runs(text):
    """Hashes of all runs of five words, whatever their case and punctuation."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    runs = lambda ws: F.transform(F.sequence(F.lit(1), F.size(ws) - 4), lambda i: F.xxhash64(F.slice(ws, i, 5)))
    return F.array_distinct(F.flatten(F.transform(F.array(words), lambda ws: F.when(F.size(ws) >= 5, runs(ws)).otherwise(F.array().cast("array<bigint>")))))


@query(None)
def snippet_anchor(t):
    """A line of a document looked for in it, as it is, respaced, or with one clause only; and every benchmark item that shares five words in a row with it."""
    items = t("benchmark").select(F.col("item_id").alias("n"), F.col("text").alias("item"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x)) > 40)
    line = F.coalesce(F.try_element_at(lines, F.lit(-1)), F.col("text"))
    docs = t("documents").select("doc_id", "text", line.alias("line"))
    k = F.col("doc_id") % 4
    own = F.when(k == 0, F.col("line")).when(k == 1, F.regexp_replace("line", " ", "  ")).when(k == 2, F.concat(F.lit("Seen: x; "), F.col("line")))
    pairs = docs.select("doc_id", F.explode(_runs(F.col("text"))).alias("run")).join(items.select("n", F.explode(_runs(F.col("item"))).alias("run")).hint("merge"), "run").select("doc_id", "n").distinct()
    found = docs.join(pairs.hint("merge"), "doc_id").join(items.hint("merge"), "n").select("doc_id", "text", F.col("item").alias("snippet"))
    rows = docs.select("doc_id", "text", own.alias("snippet")).unionByName(found)
    place = anchors.anchor(F.col("text"), F.col("snippet"), F.lit(None).cast("int"), F.lit(None).cast("int"))
    return rows.withColumn("x", place).select("doc_id", "snippet", "x.state", "x.tier", "x.char_start", "x.char_end")


@query("""with q as (select conv_id, turn, text, case when text like '%?%' then list_transform(list_filter(string_split(text, '?'), lambda x: length(trim(x)) > 5), lambda x: trim(x)) else [trim(text)] end as qs from conversations where role = 'user'),
u as (select conv_id, turn, text, unnest(f) as q, generate_subscripts(f, 1) as n from (select *, list_filter(case when len(qs) = 0 then [''] else qs end, lambda x: length(x) > 5) as f from q))
select conv_id, turn, n::bigint as n, position(lower(s) in lower(text))::bigint - 1 as char_start, length(s)::bigint as n_chars from (select *, trim(regexp_replace(q, '^([(]?[0-9]+[.)]|-|[*]|•)\\s*', '')) as s from u)""")
def question_grounding(t):
    rows = t("conversations").filter("role = 'user'").select("conv_id", "turn", "text", F.posexplode(T.questions(F.col("text"))).alias("n", "q"))
    bare = F.trim(F.regexp_replace("q", r"^(\(?[0-9]+[.)]|-|\*|•)\s*", ""))
    return rows.withColumn("bare", bare).select("conv_id", "turn", (F.col("n") + 1).cast("long").alias("n"), (F.position(F.lower("bare"), F.lower("text")) - 1).cast("long").alias("char_start"), F.length("bare").cast("long").alias("n_chars"))


# Citations of a user's turn: what the assistant says to it, under the second question's number, and the turn itself in a note.
@query("""with q as (select conv_id, turn, text, case when text like '%?%' then list_transform(list_filter(string_split(text, '?'), lambda x: length(trim(x)) > 5), lambda x: trim(x)) else [trim(text)] end as qs from conversations where role = 'user'),
u as (select conv_id, turn, text, unnest(f) as q, generate_subscripts(f, 1) as n from (select *, list_filter(case when len(qs) = 0 then [''] else qs end, lambda x: length(x) > 5) as f from q)),
k as (select conv_id, turn - 1 as turn, text as reply from conversations where role = 'assistant' and conv_id % 2 = 0 and text <> ''),
r as (select u.*, trim(regexp_replace(q, '^([(]?[0-9]+[.)]|-|[*]|•)\\s*', '')) as bare, n = 2 and reply is not null as by_key, conv_id % 3 = 0 and turn % 4 = 0 as by_turn, reply is not null and (contains(lower(reply), lower(trim(q))) or (length(trim(q)) > 20 and contains(lower(reply), lower(trim(q))[1:20]))) as by_reply from u left join k using (conv_id, turn))
select conv_id, turn, n::bigint as n, case when by_key then 'key' when by_reply or by_turn then 'snippet' when length(bare) > 5 and contains(lower(text), lower(bare)) then 'body' end as tier, case when not (by_key or by_reply or by_turn) and length(bare) > 5 and contains(lower(text), lower(bare)) then position(lower(bare) in lower(text))::bigint - 1 else -1 end as char_start from r""")
def question_citations(t):
    turns = t("conversations")
    users = turns.filter("role = 'user'")
    case = lambda turn: F.struct("conv_id", turn.alias("turn")).alias("case_id")
    asked = users.select(case(F.col("turn")), F.col("text").alias("body"), F.posexplode(T.questions(F.col("text"))).alias("n", "question"))
    replies = turns.filter("role = 'assistant' and conv_id % 2 = 0").select(case(F.col("turn") - 1), F.lit(0).alias("pos"), F.lit("mi_question_2").alias("name"), F.col("text").alias("snippet"))
    own = users.filter("conv_id % 3 = 0 and turn % 4 = 0").select(case(F.col("turn")), F.lit(1).alias("pos"), F.lit("note").alias("name"), F.concat(F.lit("Note: "), F.col("text")).alias("snippet"))
    got = C.ground_questions(asked, replies.unionByName(own))
    return got.select("case_id.conv_id", "case_id.turn", (F.col("n") + 1).cast("long").alias("n"), "tier", F.coalesce(F.col("char_start").cast("long"), F.lit(-1)).alias("char_start"))


# A line of each document with every sixth word changed and one left out, its first two words, and a text that is nowhere.
_SQL_SNIPPETS = """d as (select doc_id, text, list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) > 40) as ls from documents),
l as (select doc_id, text, regexp_extract_all(coalesce(ls[len(ls) // 2 + 1], text), '[^\x20\x09-\x0D]+') as w from d),
sn as (select doc_id, text, 1 as n, array_to_string(list_filter(list_transform(w, lambda x, i: case when i % 6 = 0 then 'zz' when i = 9 then null else x end), lambda x: x is not null), ' ') as snippet from l
 union all select doc_id, text, 2, array_to_string(w[1:2], ' ') from l union all select doc_id, text, 3, 'qq qq qq qq' from l),
tw as (select doc_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') as w from documents), tr as (select doc_id, unnest(range(0, len(w) - 2)) as place, w from tw where len(w) >= 3), tk as (select doc_id, place, array_to_string(w[place + 1:place + 3], ' ') as run from tr),
sw as (select doc_id, n, regexp_extract_all(lower(snippet), '[^\x20\x09-\x0D]+') as w from sn), sr as (select doc_id, n, unnest(range(0, len(w) - 2)) as p0, w from sw where len(w) >= 3), sk as (select doc_id, n, p0, array_to_string(w[p0 + 1:p0 + 3], ' ') as run from sr),
v as (select sk.doc_id, n, place - p0 as diagonal, count(distinct p0) as votes, min(place) as f, max(place) as l from sk join tk using (doc_id, run) group by all),
nv as (select doc_id, n, diagonal, votes, sum(votes) over w as alls, min(f) over w as f, max(l) over w as l from v window w as (partition by doc_id, n order by diagonal range between 2 preceding and 2 following)),
be as (select * from nv qualify row_number() over (partition by doc_id, n order by alls desc, votes desc, diagonal) = 1),
raw as (select doc_id, length(regexp_extract(text, '^[\x20\x09-\x0D]*')) as lead, regexp_extract_all(text, '[^\x20\x09-\x0D]+[\x20\x09-\x0D]*') as raws from documents)"""


@query(f"""with {_SQL_SNIPPETS} select sn.doc_id as document_id, sn.n, case when alls is not null then 'runs' when trim(snippet) <> '' and contains(lower(text), lower(trim(snippet))) then 'clause' end as tier,
 case when alls is not null then lead + coalesce(list_sum(list_transform(raws[1:f], lambda x: length(x))), 0) when trim(snippet) <> '' and contains(lower(text), lower(trim(snippet))) then position(lower(trim(snippet)) in lower(text)) - 1 else -1 end::bigint as char_start,
 case when alls is not null then lead + coalesce(list_sum(list_transform(raws[1:l + 2], lambda x: length(x))), 0) + length(regexp_replace(raws[l + 3], '[\x20\x09-\x0D]+$', '')) when trim(snippet) <> '' and contains(lower(text), lower(trim(snippet))) then position(lower(trim(snippet)) in lower(text)) - 1 + length(trim(snippet)) else -1 end::bigint as char_end
 from sn left join be on be.doc_id = sn.doc_id and be.n = sn.n join raw on raw.doc_id = sn.doc_id""")
def snippet_placing(t):
    """Changed lines, short clauses and strange texts looked for in their documents."""
    got = P.place_snippets(changed_snippets(t), t("documents").select(F.col("doc_id").alias("document_id"), "text"))
    end = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(-1)).alias(c)
    return got.select("document_id", "n", "tier", end("char_start"), end("char_end"))


def changed_snippets(t):
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x)) > 40)
    middle = F.coalesce(F.try_element_at(lines, (F.floor(F.size(lines) / 2) + 1).cast("int")), F.col("text"))
    w = F.regexp_extract_all(middle, F.lit(f"[^{P.SPACE}]+"), F.lit(0))
    changed = F.array_join(F.filter(F.transform(w, lambda x, i: F.when((i + 1) % 6 == 0, "zz").when(i == 8, F.lit(None)).otherwise(x)), lambda x: x.isNotNull()), " ")
    texts = F.array(F.struct(F.lit(1).alias("n"), changed.alias("snippet")), F.struct(F.lit(2).alias("n"), F.array_join(F.slice(w, 1, 2), " ").alias("snippet")), F.struct(F.lit(3).alias("n"), F.lit("qq qq qq qq").alias("snippet")))
    return t("documents").select(F.col("doc_id").alias("document_id"), F.inline(texts))
