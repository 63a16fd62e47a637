"""Queries of this subpackage: each applies its operator, with production parameters, to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The public tokenizer file of the packing query."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _digest(got: DataFrame) -> DataFrame:
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("+", s["start"], s["length"])), ",")
    cut = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["length"])
    return got.select("doc_id", "n_units", F.size("spans").alias("n_removed"), cut.alias("removed_chars"), spans.alias("spans"), F.length("cleaned").cast("long").alias("n_chars"), F.sha2("cleaned", 256).alias("text_sha256"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of 30 words from the beginning of every line, sentence and clause."""
    from .passages import drop_repeated_passages

    return _digest(drop_repeated_passages(_table(spark, sf_dir, "documents")))


def op1_sentence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of each line as units."""
    from .lines import Lines, drop_repeated_lines

    return _digest(drop_repeated_lines(_table(spark, sf_dir, "documents"), Lines(stops=".!?")))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import Packing, pack

    return pack(_table(spark, sf_dir, "documents"), Packing(tokenizer_path()))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(_table(spark, sf_dir, "documents")).drop("source")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


#: The tool that the conversations' questions call, and what it takes.
_TOOLS = "name string, fields array<struct<field:string,type:string,required:boolean,most:double>>"
_REPLY = [("reply", [("query", "string", True, None), ("turn", "integer", True, 4.0)])]


def op5_tool_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn as a call of the tool "reply", the turn after it as its result; a call waits for the user turn before."""
    from .chat import link_tools

    turns = _table(spark, sf_dir, "conversations")
    name = lambda turn: F.concat_ws("-", "conv_id", turn)
    arguments = F.to_json(F.struct("turn", F.col("text").alias("query")))
    calls = turns.filter("role = 'user'").select(name(F.col("turn")).alias("call_id"), F.lit("reply").alias("name"), arguments.alias("arguments"), F.array(name(F.col("turn") - 2)).alias("after"))
    results = turns.filter("role = 'assistant'").select(name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return link_tools(calls, results, spark.createDataFrame(_REPLY, _TOOLS))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact import exact_duplicates

    return exact_duplicates(_table(spark, sf_dir, "documents"))


#: (host, path, verdict) of the listed entries.
_LISTED = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import judge

    return judge(_table(spark, sf_dir, "pages"), spark.createDataFrame(_LISTED, "host string, path string, verdict string"))


def op8_min_max_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import MinMax, near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), MinMax(words=3, percent=85))


def op9_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sampling import fingerprints

    return fingerprints(_table(spark, sf_dir, "documents"))


def op10_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pagetext import extract

    return extract(_table(spark, sf_dir, "pages"))


def op11_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .causal import Causal, score_texts

    return score_texts(_table(spark, sf_dir, "documents"), Causal(tokenizer_path()), F.crc32(F.col("id").cast("string")) % 7 == 2)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector asks; a seventh of the labels are the next class's first."""
    from .negatives import hard_negatives

    moved = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, moved)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    return whiten(_table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op1_sentence_dedup,
        op2_best_fit_packing,
        op3_source_mixing,
        op4_toxicity,
        op5_tool_linking,
        op6_exact_dedup,
        op7_url_filter,
        op8_min_max_near_dedup,
        op9_weighted_fingerprints,
        op10_page_text,
        op11_language_model,
        op12_hard_negatives,
        op13_whitening,
        pipeline,
    )
}

ORACLES: dict[str, str] = {
    "op1_line_dedup": r"""
with d as (select doc_id, coalesce(text, '') as text from documents),
l as (select doc_id, regexp_extract(text, '^[\x20\x09-\x0D]*') as lead, regexp_extract_all(text, '[^\x20\x09-\x0D]+[\x20\x09-\x0D]*') as toks from d),
n as (select *, list_transform(toks, lambda t: translate(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as norms from l),
w as (select doc_id, lead, len(toks) as n, unnest(toks) as raw, unnest(norms) as norm, generate_subscripts(toks, 1) - 1 as pos from n),
o as (select *, length(lead) + sum(length(raw)) over (partition by doc_id order by pos) - length(raw) as start,
  coalesce(lag(right(norm, 1) in ('.', '!', '?', ',', ';', ':', '|') or contains(raw, chr(10))) over (partition by doc_id order by pos), true) as begins from w),
p as (select doc_id, pos, md5(array_to_string(norms[pos + 1:pos + 30], ' ')) as digest from o join n using (doc_id) where begins and pos + 30 <= n),
r as (select *, row_number() over first as rank, first_value(doc_id) over first as first_doc, first_value(pos) over first as first_pos from p window first as (partition by digest order by doc_id, pos)),
c as (select doc_id, case when doc_id = first_doc then greatest(pos, first_pos + 30) else pos end as lo, pos + 30 as hi from r where rank > 1),
e as (select doc_id, pos, sum(step) as step from (select doc_id, lo as pos, 1 as step from c union all select doc_id, hi, -1 from c) group by all),
g as (select o.*, coalesce(sum(step) over (partition by doc_id order by o.pos), 0) > 0 as gone from o left join e using (doc_id, pos)),
s as (select *, sum((not gone)::int) over (partition by doc_id order by pos) as island from g),
i as (select doc_id, min(start) as start, sum(length(raw)) as length from s where gone group by doc_id, island),
x as (select doc_id, count(*)::int as n_removed, sum(length)::bigint as removed_chars, string_agg(start::bigint || '+' || length::bigint, ',' order by start) as spans from i group by doc_id),
t as (select doc_id, string_agg(raw, '' order by pos) filter (not gone) as rest from g group by doc_id),
u as (select doc_id, count(*)::int as n_units from p group by doc_id),
f as (select doc_id, lead || coalesce(rest, '') as cleaned from l left join t using (doc_id))
select doc_id, coalesce(n_units, 0) as n_units, coalesce(n_removed, 0) as n_removed, coalesce(removed_chars, 0) as removed_chars, coalesce(spans, '') as spans, length(cleaned) as n_chars, sha256(cleaned) as text_sha256
from f left join u using (doc_id) left join x using (doc_id)""",
    "op1_sentence_dedup": r"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
l as (select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as at_line from d),
s as (select doc_id, at_line, string_split(regexp_replace(line, '([.!?][\x20\x09\x0B-\x0D]+)', '\1' || chr(10), 'g'), chr(10)) as parts from l),
u as (select doc_id, at_line, unnest(parts) as raw, generate_subscripts(parts, 1) as part, len(parts) as n_parts from s),
n as (select *, sum(length(raw) + (part = n_parts)::int) over (partition by doc_id order by at_line, part) - length(raw) - (part = n_parts)::int as start,
  trim(regexp_replace(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') as norm from u),
m as (select *, length(norm) - length(replace(norm, ' ', '')) + 1 >= 5 as compared from n),
f as (select *, compared and row_number() over (partition by norm, compared order by doc_id, at_line, part) > 1 as gone from m),
g as (select doc_id, at_line, coalesce(string_agg(raw, '' order by part) filter (not gone), '') as stays, bool_or(gone) as cut from f group by doc_id, at_line),
c as (select doc_id, coalesce(string_agg(stays, chr(10) order by at_line) filter (not cut or regexp_matches(stays, '[^\x20\x09-\x0D]')), '') as cleaned from g group by doc_id),
r as (select doc_id, count(*)::int as n_units, (count(*) filter (gone))::int as n_removed, coalesce(sum(length(raw)) filter (gone), 0)::bigint as removed_chars,
  coalesce(string_agg(start::bigint || '+' || length(raw), ',' order by at_line, part) filter (gone), '') as spans from f group by doc_id)
select doc_id, n_units, n_removed, removed_chars, spans, length(cleaned) as n_chars, sha256(cleaned) as text_sha256 from r join c using (doc_id)""",
    "op5_tool_linking": """
with c as (select conv_id, turn, conv_id || '-' || turn as call_id, text from conversations where role = 'user'),
r as (select conv_id || '-' || (turn - 1) as call_id, text from conversations where role = 'assistant'),
l as (select c.*, turn - 2 in (select turn from c as b where b.conv_id = c.conv_id) as waits from c),
v as (select *, turn - 2 * row_number() over (partition by conv_id order by turn) as chain from l),
w as (select *, row_number() over (partition by conv_id, chain order by turn) - 1 as level from v),
e as (select w.*, r.text as content, r.call_id is not null as linked,
  concat_ws('; ', case when w.text = '' then 'query is empty' end, case when turn > 4 then 'turn is too large' end) as errors
  from w left join r using (call_id))
select call_id, 'reply' as name, linked, level, errors = '' as valid, errors,
  case when linked then to_json({'arguments': {'query': text, 'turn': turn}, 'id': call_id, 'level': level, 'name': 'reply', 'result': content})
  else to_json({'arguments': {'query': text, 'turn': turn}, 'id': call_id, 'level': level, 'name': 'reply'}) end::varchar as json from e""",
    "op6_exact_dedup": r"""
with d as (select doc_id, coalesce(text, '') as text from documents),
n as (select doc_id, length(text) as n_chars, sha256(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as sha from d),
g as (select sha, count(*) as group_size, first(doc_id order by n_chars desc, doc_id) as keep_id from n group by sha)
select n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id as kept, n.sha as text_sha256 from n join g using (sha)""",
    "op7_url_filter": r"""
with u as (select page_id, case when url like '%://%' then substring(url, position('://' in url) + 3) else '' end as rest from pages),
h as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
l(h, p, says) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
d as (select host, path, max_by(l.h || l.p, length(l.h || l.p)) as rule, max_by(says, length(l.h || l.p)) as says
  from (select distinct host, path from h), l where (host = l.h or ends_with(host, '.' || l.h)) and starts_with(path, l.p) group by host, path)
select page_id, host, path, rule, coalesce(says, 'allow') as verdict from h left join d using (host, path)""",
    "op12_hard_negatives": """
with v as (select vec_id, (case when vec_id % 7 = 0 then (label + 1) % 10 else label end) as label, list_transform(embedding, lambda c: floor(256 * c::double)) as x
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
s as (select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_dot_product(a.x, b.x)::bigint as score from v as a join v as b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, (row_number() over (partition by anchor_id, positive_id order by score desc, s.vec_id))::int as rank, s.vec_id as negative_id, positive_score, score as negative_score
from p join s using (anchor_id) where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, s.vec_id) <= 10""",
}
