"""Retrieval by words and hashed vectors, choice and merging of evidence, bounded batches for verification."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType
from pyspark.sql.window import Window

from ..functions.fuzzy import fuzzy_score
from ..functions.text import collapse, is_unstated, key
from .evidence import entails, fused
from .shared import written

# Words that carry nothing in a value, words that carry nothing in a field's name, prefixes of structured fields, units.
STOPWORDS = ("the", "a", "an", "and", "or", "in", "on", "at", "to", "for", "with", "is", "was", "are", "were", "of", "by", "as", "from", "it", "this", "patient", "level", "levels", "test", "tests", "value", "values")
FIELD_WORDS = ("lab", "test", "biomarker", "diagnostic", "level", "levels")
STRUCTURED = ("lab_", "biomarker_", "diagnostic_", "test_")
UNITS = ("fl", "iu", "ul", "l", "ml")
TOKEN = r"(?U)\b[a-zA-Z0-9.\-_]{2,}\b"
DIMENSION = 128


def tokens(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0)))


def _strings() -> Column:
    return F.array().cast("array<string>")


def _has(text: str, words: Column) -> Column:
    """Any of the words, or the first four characters of a longer one, in a text."""
    return F.exists(words, lambda w: F.col(text).contains(F.left(w, F.lit(4))) & ((F.length(w) >= 4) | F.col(text).contains(w)))


def fact_terms(facts: DataFrame) -> DataFrame:
    """facts (value, field; optional: normalized, scope, structured) with what their scores need of them, once per fact."""
    has, none = facts.columns, F.lit(None).cast("string")
    given = lambda name, default: F.col(name) if name in has else default
    rows = facts.withColumn("_v", key(F.col("value"))).withColumns({
        "_own": F.array_except(tokens(F.col("_v")), F.array(*map(F.lit, STOPWORDS))), "_norm": key(given("normalized", none).cast("string")), "_scope": key(given("scope", none)),
        "_words": F.filter(F.split(F.lower(F.translate("field", "_", " ")), r"\s+"), lambda w: ~w.isin(*FIELD_WORDS) & (F.length(w) >= 2)),
        "_structured": F.col("field").rlike("^(" + "|".join(STRUCTURED) + ")") | given("structured", F.lit(False)),
    })
    numbers = F.regexp_extract_all(F.col("_v"), F.lit(r"(?U)\b\d+(?:\.\d+)?(?::\d+)?\b"), F.lit(0))
    letters = lambda c, drop: F.filter(F.regexp_extract_all(c, F.lit("[a-zA-Z]+"), F.lit(0)), lambda w: ~w.isin(*drop) & (F.length(w) >= 2))
    return rows.withColumns({"_numbers": F.when(F.size(numbers) > 0, numbers).otherwise(F.filter("_own", lambda w: w.rlike("[0-9]"))), "_analytes": F.concat(letters(F.lower("field"), FIELD_WORDS), letters(F.col("_v"), STOPWORDS + UNITS))})


def chunk_terms(chunks: DataFrame) -> DataFrame:
    """chunks (text) with its lower-cased form and its words, once per chunk."""
    return chunks.withColumn("_t", F.lower("text")).withColumn("_held", tokens(F.col("_t")))


def _base(f: Callable[[str], Column], c: Callable[[str], Column]) -> Column:
    """The value in the text, its normal form in it, or the share of its words there."""
    whole = F.when((F.length(f("_v")) >= 3) & c("_t").contains(f("_v")), 0.9).otherwise(0.0)
    normal = F.when((F.length(f("_norm")) >= 2) & c("_t").contains(f("_norm")), 0.8).otherwise(0.0)
    share = F.when(F.size(f("_own")) > 0, F.size(F.array_intersect(f("_own"), c("_held"))) / F.size(f("_own")) * 0.75).otherwise(0.0)
    return F.greatest(whole, normal, share)


def with_lexical(pairs: DataFrame, out: str = "lexical") -> DataFrame:
    """pairs of fact (value, field) and chunk (text) with their lexical score.

    Optional columns: normalized, scope, others (array of other scopes), structured and is_table (booleans), and those of ``fact_terms``
    and ``chunk_terms``, which are added here if the pairs don't have them.
    """
    has = pairs.columns
    given = lambda name, default: F.col(name) if name in has else default
    rows = pairs if "_own" in has else fact_terms(pairs)
    rows = rows if "_held" in has else chunk_terms(rows)
    rows = rows.withColumn("_s", _base(F.col, F.col))
    other = F.exists(given("others", _strings()), lambda o: (F.trim(o) != "") & F.col("_t").contains(key(o)))
    rows = rows.withColumn("_other", F.coalesce(F.col("_scope").isNotNull() & (F.col("_s") > 0) & other, F.lit(False)))
    mine = (F.length("_scope") >= 2) & F.col("_t").contains(F.col("_scope"))
    field = F.when((F.col("_s") > 0) & _has("_t", F.col("_words")), 0.1).otherwise(0.0)
    scope = F.when((F.col("_s") <= 0) | F.col("_scope").isNull(), 0.0).when(mine, F.when(F.col("_other"), -0.2).otherwise(0.4)).when(F.col("_other"), -0.6).otherwise(0.0)
    rows = rows.withColumn("_s", F.col("_s") + field + scope)
    analyte = _has("_t", F.col("_analytes"))
    number = F.when(F.size("_numbers") > 0, F.exists("_numbers", lambda n: F.col("_t").contains(n))).otherwise(F.col("_s") > 0.5)
    row = F.when(analyte & number & ~F.col("_other"), F.greatest("_s", F.lit(0.98))).otherwise(F.col("_s"))
    score = F.when(~F.col("_structured"), F.col("_s")).when(given("is_table", F.lit(False)), row).otherwise(F.least("_s", F.lit(0.88)))
    return rows.withColumn(out, F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).drop("_v", "_t", "_own", "_held", "_norm", "_scope", "_words", "_structured", "_numbers", "_analytes", "_s", "_other")


#: Most words that one step of gram_vectors looks at, unless a single text has more.
STEP = 500_000
#: Texts whose digests are computed side by side: so many that their words stay in a core's cache.
LANES = 8192
_SINES = (np.abs(np.sin(np.arange(1, 65))) * 2.0**32).astype(np.uint32)
_SHIFTS = tuple(np.uint32(s) for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4)
_PLACES = (*range(16), *((5 * i + 1) % 16 for i in range(16)), *((3 * i + 5) % 16 for i in range(16)), *(7 * i % 16 for i in range(16)))


def _md5_ends(x: np.ndarray) -> np.ndarray:
    """The last byte of each message's md5; x: its one padded block as 16 rows of little-endian numbers."""
    start = np.array([0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476], np.uint32)
    a, b, c, d = (np.full(x.shape[1], v, np.uint32) for v in start)
    for i in range(64):
        if i < 16:
            f = d ^ (b & (c ^ d))
        elif i < 32:
            f = c ^ (d & (b ^ c))
        elif i < 48:
            f = b ^ c ^ d
        else:
            f = c ^ (b | ~d)
        f += a
        f += x[_PLACES[i]]
        f += _SINES[i]
        turned = f << _SHIFTS[i]
        f >>= np.uint32(32) - _SHIFTS[i]
        turned |= f
        turned += b
        a, d, c, b = d, c, b, turned
    return (d + start[3]) >> np.uint32(24)


def md5_buckets(texts: pa.Array) -> np.ndarray:
    """The last byte of each text's md5, modulo 128. Texts of 55 bytes or fewer fill one block, and thousands of them are digested at once."""
    raw = texts.cast(pa.large_binary())
    out = np.zeros(len(raw), np.int64)
    if not len(raw):
        return out
    _, places, data = raw.buffers()
    at = np.frombuffer(places, np.int64)[raw.offset : raw.offset + len(raw) + 1]
    flat, size = np.frombuffer(data or b"", np.uint8), np.diff(at)
    for i in np.flatnonzero(size > 55).tolist():
        out[i] = md5(flat[at[i] : at[i + 1]].tobytes(), usedforsecurity=False).digest()[-1]
    short = np.flatnonzero(size <= 55)
    for low in range(0, len(short), LANES):
        these = short[low : low + LANES]
        many, n = size[these], len(these)
        lane = np.repeat(np.arange(n), many)
        inside = np.arange(len(lane)) - np.repeat(np.cumsum(many) - many, many)
        block = np.zeros((n, 64), np.uint8)
        block[lane, inside] = flat[at[these][lane] + inside]
        block[np.arange(n), many] = 0x80
        x = block.view("<u4")
        x[:, 14] = many * 8
        out[these] = _md5_ends(np.ascontiguousarray(x.T))
    return out % DIMENSION


def _parts_of(spelt: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of every part of n characters of every word; a part is hashed once, however many words hold it."""
    text, size = "".join(spelt.to_pylist()), pc.utf8_length(spelt).to_numpy().astype(np.int64)
    known, letter = np.unique(np.frombuffer(text.encode("utf-32-le"), np.uint32), return_inverse=True)
    word = np.repeat(np.arange(len(size)), size)
    at = np.flatnonzero(np.cumsum(size)[word] - np.arange(len(word)) >= n)
    code, span = np.zeros(len(at), np.int64), 1
    for i in range(n):
        if span > 2**62 // max(1, len(known)):
            spans, code = np.unique(code, return_inverse=True)
            span = len(spans)
        code, span = code * len(known) + letter[at + i], span * len(known)
    _, first, which = np.unique(code, return_index=True, return_inverse=True)
    return word[at], md5_buckets(pa.array([text[i : i + n] for i in at[first].tolist()], pa.string()))[which]


#: Words up to which a call of hashed_vectors takes them one by one: digests side by side cost the same for one word as for hundreds.
FEW = 1000
#: Most words whose buckets such calls keep from one to the next, and the longest kept.
KEPT, LONGEST = 1 << 16, 64
_kept: dict[tuple, np.ndarray] = {}


def _bucket(text: str) -> int:
    return md5(text.encode(), usedforsecurity=False).digest()[-1] % DIMENSION


def _few_vectors(words: list[list[str] | None], parts: tuple[int, ...], joint: str) -> np.ndarray:
    """``hashed_vectors`` of few words: the buckets of a word and its parts are looked up if an earlier call had it."""
    out = np.zeros((len(words), DIMENSION), np.int32)
    for i, own in enumerate(words):
        if not own:
            continue
        held = []
        for w in own:
            if (got := _kept.get((w, parts))) is None:
                got = np.array([_bucket(w)] * 2 + [_bucket(w[k : k + n]) for n in parts for k in range(len(w) - n + 1)], np.int8)
                if len(w) <= LONGEST:
                    if len(_kept) >= KEPT:
                        _kept.clear()
                    _kept[w, parts] = got
            held.append(got)
        out[i] = np.bincount(np.concatenate(held), minlength=DIMENSION)
        if len(own) > 1:
            out[i] += 3 * np.bincount([_bucket(a + joint + b) for a, b in zip(own[:-1], own[1:], strict=True)], minlength=DIMENSION)
    return out


def hashed_vectors(words: pa.ListArray, parts: tuple[int, ...] = (3, 4), joint: str = "_") -> np.ndarray:
    """A row of 128 sums for each list of words: words (2), their parts of so many characters (1) and neighbouring words (3), each in the bucket of its md5.

    Each distinct word, part and pair is hashed once, all of them together; a text adds up its words by their numbers. Few words are taken one by one.
    """
    if len(pc.list_flatten(words)) <= FEW:
        return _few_vectors(words.to_pylist(), parts, joint)
    n, coded = len(words), pc.list_flatten(words).dictionary_encode()
    spelt, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(words), 0).to_numpy())
    whole, own = np.arange(len(spelt)), md5_buckets(spelt)
    held = [(whole, own), (whole, own), *(_parts_of(spelt, size) for size in parts)]
    word = np.concatenate([w for w, _ in held])
    flat, size = np.concatenate([b for _, b in held])[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(spelt))
    first, many = np.cumsum(size) - size, size[code]
    of_word = np.repeat(first[code] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    got = np.bincount(np.repeat(owner, many) * DIMENSION + flat[of_word], minlength=n * DIMENSION)
    near = np.flatnonzero(owner[1:] == owner[:-1])
    pair, which = np.unique(code[near] * max(1, len(spelt)) + code[near + 1], return_inverse=True)
    one, two = np.divmod(pair, max(1, len(spelt)))
    of_pair = md5_buckets(pc.binary_join_element_wise(spelt.take(pa.array(one)), spelt.take(pa.array(two)), joint))
    got += 3 * np.bincount(owner[near] * DIMENSION + of_pair[which], minlength=n * DIMENSION)
    return got.astype(np.int32).reshape(n, DIMENSION)


def gram_vectors(texts: DataFrame, text: Column, word: str = r"(?U)\b\w+\b", parts: tuple[int, ...] = (3, 4), joint: str = "_", out: str = "vector") -> DataFrame:
    """texts with the integer form of a hashed embedding (see ``hashed_vectors``); nothing is shuffled, and rows stay where they are known to be."""

    @F.arrow_udf(ArrayType(IntegerType()))
    def vectors(words: pa.Array) -> pa.Array:
        sizes = np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy())
        low, flat = 0, [np.zeros(0, np.int32)]
        while low < len(words):
            high = max(low + 1, int(np.searchsorted(sizes, (sizes[low - 1] if low else 0) + STEP, "right")))
            flat.append(hashed_vectors(words.slice(low, high - low), parts, joint).ravel())
            low = high
        return pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1, dtype=np.int32) * DIMENSION), pa.array(np.concatenate(flat)))

    # not deterministic to the planner: a filter on a vector would otherwise be pushed below and make all vectors twice
    return texts.withColumn(out, vectors.asNondeterministic()(F.regexp_extract_all(F.lower(text), F.lit(word), F.lit(0))))


def embedder(encode: Callable[[list[str]], list[Sequence[float] | None]], most: int = 100) -> Callable[..., DataFrame]:
    """What ``retrieve_hybrid`` takes as ``embed``, of a function from texts to their vectors.

    ``most`` distinct texts go to a call. Where a call fails, its halves are tried, down to single texts; a text that fails alone, or has no vector,
    gets null, and its pairs are scored by words alone. So a broken text costs its own vector and nobody else's.
    """

    def attempt(texts: list[str]) -> list[Sequence[float] | None]:
        try:
            got = encode(texts)
            if len(got) != len(texts):
                raise ValueError(f"{len(got)} vectors of {len(texts)} texts")
            return got
        except Exception:  # noqa: BLE001  whatever an embedder raises
            if len(texts) == 1:
                return [None]
            middle = len(texts) // 2
            return attempt(texts[:middle]) + attempt(texts[middle:])

    @F.arrow_udf(ArrayType(DoubleType()))
    def vectors(texts: pa.Array) -> pa.Array:
        coded = texts.dictionary_encode()
        spelt = coded.dictionary.to_pylist()
        parts = (attempt(spelt[low : low + most]) for low in range(0, len(spelt), most))
        known = pa.concat_arrays([pa.array(part, pa.list_(pa.float64())) for part in parts] or [pa.array([], pa.list_(pa.float64()))])
        return known.take(coded.indices)

    def embed(texts: DataFrame, text: Column, out: str = "vector") -> DataFrame:
        return texts.withColumn(out, vectors.asNondeterministic()(F.coalesce(text, F.lit(""))))

    return embed


@F.arrow_udf(ArrayType(ArrayType(DoubleType())))
def cosines(left: pa.Array, right: pa.Array) -> pa.Array:
    """What each vector on the left has in common with each on the right, a row's with its own: 0 and up, and 0 where either is empty, null or not of finite numbers, or they differ in length.

    Products are added up in one order whatever stands beside them, so equal vectors score alike.
    """

    def matrices(side: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i in range(len(side)):
            vectors = side[i].values
            size = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy()
            place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            full = np.zeros((len(size), int(size.max(initial=0))))
            full[np.repeat(np.arange(len(size)), size), place] = pc.list_flatten(vectors).cast(pa.float64()).to_numpy(zero_copy_only=False)
            size = np.where(np.isfinite(full).all(axis=1), size, 0)
            full[size == 0] = 0
            yield full, size

    out, many, inner = [np.zeros(0)], [], []
    for (a, of_a), (b, of_b) in zip(matrices(left), matrices(right), strict=True):
        square, width = np.outer((a * a).sum(axis=1), (b * b).sum(axis=1)), min(a.shape[1], b.shape[1])
        dot = np.stack([(x[:width] * b[:, :width]).sum(axis=1) for x in a]) if len(a) else square
        fit = (square > 0) & np.equal.outer(of_a, of_b)
        out.append(np.maximum(0.0, np.divide(dot, np.sqrt(square), out=np.zeros_like(square), where=fit)).ravel())
        many.append(len(a))
        inner.append(np.full(len(a), len(b)))
    ends = lambda sizes: pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    rows = pa.ListArray.from_arrays(ends(np.concatenate(inner) if inner else np.zeros(0)), pa.array(np.concatenate(out)))
    return pa.ListArray.from_arrays(ends(many), rows)


def strategy(lex: Column, sem: Column) -> Column:
    return (
        F.when(sem <= 0, "exact_lexical").when(lex >= 0.7, "hybrid_lexical_lead").when((lex < 0.3) & (sem >= 0.4), "hybrid_semantic_lead")
        .when(lex > 0, "hybrid_balanced").otherwise("semantic")
    )


def _lexical_bounds(s: Column, scoped: Column, structured: Column, table: Column) -> tuple[Column, Column]:
    """(least, most) lexical score of a pair by its base score alone, whatever field, scope and row add or take."""
    zero = F.lit(0.0)
    low = F.when(s <= 0, zero).otherwise(F.greatest(zero, s - F.when(scoped, 0.6).otherwise(0.0)))
    high = F.when(s <= 0, zero).otherwise(F.least(F.lit(1.0), s + 0.1 + F.when(scoped, 0.4).otherwise(0.0)))
    low = F.when(structured & ~table, F.least(low, F.lit(0.88))).otherwise(low)
    high = F.when(structured & table, F.greatest(high, F.lit(0.98))).when(structured, F.least(high, F.lit(0.88))).otherwise(high)
    return low, high


def _relevance_bounds(low: Column, high: Column, sem: Column) -> tuple[Column, Column]:
    """(least, most) relevance by the lexical score's; each branch of ``fused`` is taken at its own ends, and those that can apply decide."""
    sure, lead = high >= 0.7, (low < 0.3) & (sem >= 0.4)
    middle = (high > 0) & (low < 0.7) & ((sem < 0.4) | (high >= 0.3))
    never = F.lit(None).cast("double")
    most = F.greatest(
        F.when(sure, 0.65 * high + 0.35 * sem).otherwise(never), F.when(lead, 0.3 * F.least(high, F.lit(0.3)) + 0.7 * sem).otherwise(never),
        F.when(middle, 0.5 * F.least(high, F.lit(0.7)) + 0.5 * sem).otherwise(never), F.when(low <= 0, F.when(sem >= 0.4, sem).otherwise(0.0)).otherwise(never),
    )
    least = F.least(
        F.when(sure, 0.65 * F.greatest(low, F.lit(0.7)) + 0.35 * sem).otherwise(never), F.when(lead, 0.3 * low + 0.7 * sem).otherwise(never),
        F.when(middle, 0.5 * low + 0.5 * sem).otherwise(never), F.when((low <= 0) & (sem < 0.4), 0.0).otherwise(never),
    )
    return F.when(sem <= 0, low).otherwise(least), F.when(sem <= 0, high).otherwise(most)


def _bounds(s: Column, sem: Column, scoped: Column, structured: Column, table: Column) -> tuple[Column, Column]:
    return _relevance_bounds(*_lexical_bounds(s, scoped, structured, table), sem)


#: Chunks, and facts, of a document that meet at once.
BLOCK = 64
#: What sums of doubles may differ by, so that bounds drop nothing that is level.
SLACK = 1e-9


def candidates(facts: DataFrame, chunks: DataFrame, k: int, least: float) -> DataFrame:
    """Facts with the chunks of their document that can be among their k best, and the cosine of both.

    facts have what ``fact_terms`` gives, both a vector; chunks get what ``chunk_terms`` gives here. Only vectors go to Python, block by block. Blocks of facts meet blocks of chunks; of a fact's pairs in
    a block those stay whose most possible relevance reaches ``least`` and the kth of the least possible ones. A row is made for these only.
    """
    def packed(rows: DataFrame, block: Column, name: str) -> DataFrame:
        inside = F.struct(*[F.col(c) for c in rows.columns if c not in ("document_id", "vector")])
        vector = F.coalesce("vector", F.array().cast(rows.schema["vector"].dataType))  # lists leave out nulls
        both = rows.select("document_id", block.alias("_block"), inside.alias("_row"), vector.alias("_vector")).groupBy("document_id", "_block")
        return both.agg(F.collect_list("_row").alias(name), F.collect_list("_vector").alias(name + "_v")).drop("_block")

    # vectors move once: blocks of a document are packed and met where its rows are; words, which are larger than their text, don't move
    placed = chunks.repartition("document_id")
    chunks = placed if "_held" in chunks.columns else chunk_terms(placed)
    order = Window.partitionBy("document_id").orderBy("field", F.xxhash64("value"))
    sides = packed(facts.withColumn("_n", F.row_number().over(order)), F.floor((F.col("_n") - 1) / BLOCK), "_facts"), packed(chunks, F.floor(F.col("pos") / BLOCK), "_chunks")
    met = sides[1].join(sides[0].hint("merge"), "document_id").withColumn("_sem", cosines("_facts_v", "_chunks_v"))
    flag = lambda c, name: F.coalesce(c[name], F.lit(False)) if name in chunks.columns else F.lit(False)
    shown = [c for c in chunks.columns if c not in ("document_id", "vector") and c not in facts.columns]

    # steps refer to the one before by a lambda's variable, so that none is computed again for every element
    def pairs(f: Column, i: Column) -> Column:
        row = F.get("_sem", i)
        scored = F.transform("_chunks", lambda c, j: F.struct(c.alias("c"), F.get(row, j).alias("sem"), _base(lambda n: f[n], lambda n: c[n]).alias("s"), flag(c, "is_table").alias("table")))
        ends = lambda x: _lexical_bounds(x["s"], f["_scope"].isNotNull(), f["_structured"], x["table"])
        lexical = F.transform(scored, lambda x: F.struct(x["c"].alias("c"), x["sem"].alias("sem"), *(e.alias(n) for e, n in zip(ends(x), ("low", "high"), strict=True))))
        bound = lambda x: _relevance_bounds(x["low"], x["high"], x["sem"])
        bounded = F.transform(lexical, lambda x: F.struct(x["c"].alias("c"), x["sem"].alias("sem"), *(e.alias(n) for e, n in zip(bound(x), ("low", "high"), strict=True))))
        return F.struct(f.alias("f"), bounded.alias("of"))

    def with_kth(x: Column) -> Column:
        kth = F.coalesce(F.try_element_at(F.sort_array(F.transform(x["of"], lambda y: y["low"]), asc=False), F.lit(k)), F.lit(0.0))
        return F.struct(x["f"].alias("f"), x["of"].alias("of"), F.greatest(kth, F.lit(least)).alias("enough"))

    steps = F.transform(F.transform("_facts", pairs), with_kth)
    kept = F.transform(steps, lambda x: F.struct(x["f"].alias("f"), F.filter(x["of"], lambda y: y["high"] >= x["enough"] - SLACK).alias("of")))
    rows = met.select("document_id", F.explode(kept).alias("x")).select("document_id", "x.f", F.explode("x.of").alias("y"))
    own = [c for c in facts.columns if c not in ("document_id", "vector")]
    return rows.select("document_id", *(F.col("f")[c].alias(c) for c in own), *(F.col("y.c")[c].alias(c) for c in shown), F.col("y.sem").alias("semantic"))


def retrieve_hybrid(facts: DataFrame, chunks: DataFrame, k: int = 3, least: float = 0.15, by: tuple[str, ...] = ("field",), embed: Callable[[DataFrame, Column], DataFrame] = gram_vectors) -> DataFrame:
    """The k best chunks of each stated fact of a document, by words and vectors together.

    facts: document_id, field, value and what with_lexical takes, told apart by document_id and ``by``; chunks: document_id, pos, text, optionally is_table
    and has_box. Ties: table rows for structured facts, then boxes, then the earlier chunk. embed(rows, text) adds a column "vector".
    """
    stated = facts.filter(~is_unstated(F.col("value"), "retrieve"))
    asked = fact_terms(embed(stated, F.concat_ws(" ", F.translate("field", "_", " "), "value")))
    # vectors cost more than moving the texts, so a few large files are dealt out first
    dealt = embed(chunks.repartition("document_id"), F.col("text"))
    scored = with_lexical(candidates(asked, dealt, k, least))
    lex, sem = F.col("lexical"), F.col("semantic")
    scored = scored.withColumn("relevance", fused(lex, sem)).withColumn("strategy", strategy(lex, sem))
    flag = lambda name: F.col(name) if name in chunks.columns else F.lit(False)
    table = flag("is_table") & F.col("field").rlike("^(" + "|".join(STRUCTURED) + ")")
    best = Window.partitionBy("document_id", *by).orderBy(F.desc("relevance"), F.desc(table), F.desc(flag("has_box")), "pos")
    # what is under ``least`` comes last, so it is left out after ranking: a filter before it would be pushed into the scores and multiply their expressions
    return scored.withColumn("rank", F.row_number().over(best)).filter((F.col("rank") <= k) & (F.col("relevance") >= least))


def retrieve_for_envelopes(facts: DataFrame, evidence: DataFrame, chunks: DataFrame, k: int = 3, least: float = 0.15) -> DataFrame:
    """Evidence of every fact of an envelope, ledger and payload sections alike, with what its document has for it.

    facts: envelope_id, document_id, origin, pos, field, value, status; evidence: envelope_id, origin, pos, place, source_id, snippet; chunks as above. A
    fact that several sections hold is looked for once. Facts that are not stated keep what they have. Gives the facts with ``items``: an array
    of source_id, snippet, relevance, rank; rank is null for what retrieval didn't find.
    """
    key = ["document_id", "field", "value"]
    asks = facts.filter(~F.col("status").eqNullSafe("NOT_STATED"))
    got = retrieve_hybrid(asks.select(*key).distinct(), chunks, k, least, ("field", "value"))
    item = lambda source, snippet, relevance, rank: F.struct(source.alias("source_id"), snippet.alias("snippet"), relevance.cast("double").alias("relevance"), rank.cast("int").alias("rank"))
    found = got.withColumn("_item", item(F.col("document_id").cast("string"), F.col("text"), F.col("relevance"), F.col("rank")))
    found = found.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("rank", "_item"))).alias("_found")).withColumn("_found", F.transform("_found", lambda x: x["_item"]))
    fact, none = ["envelope_id", "origin", "pos"], F.lit(None)
    had = evidence.groupBy(*fact).agg(F.array_sort(F.collect_list(F.struct("place", item(F.col("source_id"), F.col("snippet"), none, none).alias("_item")))).alias("_had"))
    had = had.withColumn("_had", F.transform("_had", lambda x: x["_item"]))
    rows = facts.join(had.hint("merge"), fact, "left").join(found.withColumn("_asks", F.lit(True)).hint("merge"), key, "left")
    empty = F.array().cast("array<struct<source_id:string,snippet:string,relevance:double,rank:int>>")
    new = F.when(F.col("status").eqNullSafe("NOT_STATED"), empty).otherwise(F.coalesce("_found", empty))
    return rows.withColumn("items", merge_evidence(F.coalesce("_had", empty), new)).drop("_had", "_found", "_asks")


def entails_fuzzy(value: Column, snippet: Column, negation_first: bool = False) -> Column:
    """entails, with likeness of strings for what it leaves open: 80 supports with its score, 60 with 0.78."""
    plain = entails(value, snippet, negation_first)
    open_ = F.coalesce((plain["result"] == "INSUFFICIENT") & ~is_unstated(value) & (F.trim(snippet) != ""), F.lit(False))
    score = fuzzy_score(value, snippet, open_)
    row = lambda conf: F.struct(F.lit("SUPPORTS").alias("result"), conf.alias("confidence"))
    return F.when(score >= 80, row(score / 100.0)).when(score >= 60, row(F.lit(0.78))).otherwise(plain)


def grounded(value: Column, snippet: Column) -> Column:
    """A snippet has the value, one of its numbers of two digits or more, or one of its words of three letters or more."""
    v, s = key(F.coalesce(value, F.lit(""))), F.lower(F.coalesce(snippet, F.lit("")))
    digits = F.filter(F.regexp_extract_all(v, F.lit("([0-9]+)")), lambda d: F.length(d) >= 2)
    words = F.filter(F.split(v, r"(?U)[^\w]+"), lambda w: F.length(w) >= 3)
    return v.isin("", "not stated", "unknown", "none") | s.contains(v) | F.exists(digits, lambda d: s.contains(d)) | F.exists(words, lambda w: s.contains(w))


def best_evidence(evidence: DataFrame, by: list[str]) -> DataFrame:
    """The best row of evidence per fact, contradictions left out; the first one where none bears the fact out.

    evidence: by, pos, value, snippet, source_type, result, confidence, relevance, page, has_box, char_start, char_end, section.
    """
    visual = F.lower("source_type").rlike("pdf|scanned|image")
    supports = F.col("result") == "SUPPORTS"
    span = F.col("char_start").isNotNull() & (F.col("char_end") > F.col("char_start"))
    page = F.col("page").isNotNull()
    place = F.when(F.col("has_box") & page & visual, 100.0).when(span & ~visual, 80.0).when(page & visual, 40.0).when(F.coalesce(F.col("section"), F.lit("")) != "", 20.0).otherwise(5.0)
    verified = F.when(supports, 50 + 20 * F.greatest(F.coalesce("confidence", F.lit(0.0)), F.lit(0.0))).when(F.col("result") == "INSUFFICIENT", 10.0).otherwise(0.0)
    score = F.when(supports | grounded(F.col("value"), F.col("snippet")), verified + place + 10 * F.coalesce("relevance", F.lit(0.0))).otherwise(-500.0)
    rows = evidence.filter(~F.col("result").eqNullSafe("CONTRADICTS")).withColumn("score", score)
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "pos")
    return rows.withColumn("rn", F.row_number().over(order)).filter("rn = 1").drop("rn")


def citation_level(source_type: Column, page: Column, box: Column, start: Column, end: Column) -> Column:
    """How exactly a citation can be shown."""
    visual, mail = F.lower(source_type).rlike("pdf|image"), F.lower(source_type).contains("email")
    exact = (box & visual) | (mail & start.isNotNull() & end.isNotNull())
    return F.when(F.coalesce(exact, F.lit(False)), "LEVEL_1_EXACT_VISUAL").when(page > 0, "LEVEL_2_PAGE_TEXT").otherwise("LEVEL_3_SNIPPET_ONLY")


def merge_evidence(existing: Column, found: Column) -> Column:
    """Evidence of an extraction with retrieved candidates, in their order, both arrays of struct(source_id, snippet, relevance, rank).

    A candidate of the same source whose snippet holds, or is held by, that of an item already there (candidates taken
    before it included) gives the first such item its relevance and rank; else it is appended.
    """

    # snippets are compared many times, so they are collapsed once each, beside their item
    def beside(items: Column) -> Column:
        return F.transform(items, lambda x: F.struct(x.alias("item"), collapse(x["snippet"]).alias("said")))

    def same(x: Column, c: Column) -> Column:
        return F.coalesce((x["item"]["source_id"] == c["item"]["source_id"]) & (x["said"].contains(c["said"]) | c["said"].contains(x["said"])), F.lit(False))

    def add(items: Column, c: Column) -> Column:
        first = F.array_position(F.transform(items, lambda x: same(x, c)), F.lit(True))
        marked = lambda x: x.withField("item", x["item"].withField("relevance", c["item"]["relevance"]).withField("rank", c["item"]["rank"]))
        return F.when(first > 0, F.transform(items, lambda x, i: F.when(i + 1 == first, marked(x)).otherwise(x))).otherwise(F.concat(items, F.array(c)))

    return F.aggregate(beside(found), beside(existing), add, lambda items: F.transform(items, lambda x: x["item"]))


#: Rows of a group that are followed at once.
RUN = 1024


def numbered(rows: DataFrame, by: str, order: str, number: str = "n") -> DataFrame:
    """rows with their number in their group, from 1, without a group in one task: ranges of (by, order) are counted and numbered each for itself.

    Ranges are found by sampling, so the rows are written with their range first.
    """
    ranged = written(rows.repartitionByRange(by, order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy(by, "_range").agg(F.count("*").alias("_many"))  # a row for each range that a group spans
    before = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col(by).alias("_by"), F.col("_range").alias("_at"), F.coalesce(F.sum("_many").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(by, "_range").orderBy(order))
    joined = ranged.withColumn(number, own).join(sizes.hint("merge"), F.col(by).eqNullSafe(F.col("_by")) & (F.col("_range") == F.col("_at")))
    return joined.withColumn(number, F.col(number) + F.col("_before")).drop("_range", "_by", "_at", "_before")


#: Rows of runs that one step of the functions below looks at, unless a single run has more.
ROWS = 200_000


def _by_steps(lists: pa.Array, take: Callable[[slice], np.ndarray]) -> pa.Array:
    """What ``take`` gives for slices of lists of about ``ROWS`` rows, as lists of the same lengths."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
    low, flat = 0, [np.zeros(0, np.int32)]
    while low < len(lists):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + ROWS, "right")))
        flat.append(take(slice(low, high)).astype(np.int32))
        low = high
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(np.concatenate(flat)))


def batch_sizes(ids: pa.ListArray, items: pa.ListArray, onces: pa.ListArray, most_items: int, most_chars: int) -> np.ndarray:
    """Rows of the batch that starts at each row of runs; an id that the batch has counts no more. A null length leaves the sum unknown, so that ``most_items`` alone ends it."""
    many = pc.list_value_length(ids).to_numpy()
    run = np.repeat(np.arange(len(many)), many)
    end = np.cumsum(many)[run]
    flat = pc.list_flatten(ids)
    code = pc.fill_null(flat.dictionary_encode().indices, -1).to_numpy().astype(np.int64)
    item, once = (pc.list_flatten(x).cast(pa.float64()).to_numpy(zero_copy_only=False) for x in (items, onces))
    order = np.lexsort((code, run))  # stable: rows of one id in one run stand in order
    alike = (code[order][1:] == code[order][:-1]) & (run[order][1:] == run[order][:-1]) & (code[order][1:] >= 0)
    last = np.full(len(code), -1)  # the row before with the same id; a null one is like no other
    last[order[1:][alike]] = order[:-1][alike]
    size, chars, open_ = np.zeros(len(code), np.int32), np.zeros(len(code)), np.arange(len(code))
    for k in range(most_items):
        at = open_ + k
        inside = (at < end[open_]) & ~(chars[open_] >= most_chars)
        open_, at = open_[inside], at[inside]
        chars[open_] += item[at] + np.where(last[at] >= open_, 0.0, once[at])
        size[open_] += 1
    return size


def run_leads(sizes: pa.ListArray, most_items: int) -> np.ndarray:
    """Where the first batch beyond a run starts, less the run's length, for each of the ``most_items`` rows at which the run's first batch may start."""
    many, size = pc.list_value_length(sizes).to_numpy().astype(np.int64)[:, None], pc.list_flatten(sizes).to_numpy()
    first, at = np.cumsum(many)[:, None] - many, np.tile(np.arange(most_items), (len(many), 1))
    while (inside := at < many).any():
        at[inside] += size[(first + at)[inside]]
    return at - many


def batch_places(sizes: pa.ListArray, starts: pa.Array) -> np.ndarray:
    """How many batches have started in its run up to each row, given where the run's first one starts."""
    many, size = pc.list_value_length(sizes).to_numpy().astype(np.int64), pc.list_flatten(sizes).to_numpy()
    first, at, begun = np.cumsum(many) - many, starts.to_numpy().astype(np.int64), np.zeros(len(size), np.int32)
    while (inside := at < many).any():
        places = (first + at)[inside]
        begun[places] = 1
        at[inside] += size[places]
    total = np.cumsum(begun)
    return total - np.repeat(total[first] - begun[first], many) if len(total) else total


def batches(tasks: DataFrame, by: str, most_items: int = 30, most_chars: int = 25_000, longest: int = 400, run: int = RUN) -> DataFrame:
    """tasks (by, pos, evidence_id, field, value, snippet) with their batch, from 1 in each group, and its running size.

    A batch closes with the row that reaches either bound; a snippet counts once per batch. So a batch that starts at a row ends within ``most_items``
    rows: where the next one starts is known for every row from these alone. Rows are followed in runs of ``run`` rows: for each row of a run's head at
    which a batch may start, where the first batch of the next run starts. Such maps compose, so the runs' true starts are found by doubling,
    in as many rounds as the longest group's number of runs has binary digits. A group's rows are spread over its runs throughout. Inside
    runs, all rows' batches are followed side by side in numpy. evidence_id: a number or a string.
    """
    numbers = ArrayType(IntegerType())

    @F.arrow_udf(numbers)
    def sizes_of(ids: pa.Array, items: pa.Array, onces: pa.Array) -> pa.Array:
        return _by_steps(ids, lambda part: batch_sizes(ids[part], items[part], onces[part], most_items, most_chars))

    @F.arrow_udf(numbers)
    def leads_of(sizes: pa.Array) -> pa.Array:
        flat = np.concatenate([np.zeros(0, np.int32), *(run_leads(sizes[low : low + ROWS // RUN + 1], most_items).ravel() for low in range(0, len(sizes), ROWS // RUN + 1))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * most_items), pa.array(flat))

    @F.arrow_udf(numbers)
    def places_of(sizes: pa.Array, starts: pa.Array) -> pa.Array:
        return _by_steps(sizes, lambda part: batch_places(sizes[part], starts[part]))

    snippet = F.length(F.trim("snippet"))
    sized = tasks.withColumn("_item", F.length("field") + F.length("value") + 80).withColumn("_once", F.when(snippet > longest, longest + 3).otherwise(snippet) + 80)
    placed = written(numbered(sized, by, "pos", "_n").withColumn("_run", F.floor((F.col("_n") - 1) / run)), "placed")
    small = placed.select(by, "_n", "_run", "evidence_id", "_item", "_once")

    # the rows that follow a run's last ones stand at its end too, beyond its own
    ahead = small.filter((F.col("_run") > 0) & ((F.col("_n") - 1) % run < most_items - 1)).withColumn("_run", F.col("_run") - 1)
    rows = F.array_sort(F.collect_list(F.struct("_n", "evidence_id", "_item", "_once")))
    runs = small.unionByName(ahead).groupBy(by, "_run").agg(rows.alias("_rows"), F.count_if(F.floor((F.col("_n") - 1) / run) == F.col("_run")).cast("int").alias("_own"))
    # the last batch of a group may end before a bound is reached
    runs = runs.select(by, "_run", F.slice(sizes_of("_rows.evidence_id", "_rows._item", "_rows._once"), F.lit(1), F.col("_own")).alias("_sizes"))
    maps = written(runs.withColumn("_to", leads_of("_sizes")), "runs")
    deepest = maps.agg(F.max("_run")).first()[0] or 0
    whole = maps.select(by, "_run", F.col("_to").alias("_path"))  # after round i: from 2^i runs back, or the group's first, to beyond this run
    step_ = 1
    while step_ <= deepest:
        back = whole.select(F.col(by).alias("_by"), (F.col("_run") + step_).alias("_at"), F.col("_path").alias("_from"))
        joined = whole.join(back.hint("merge"), F.col(by).eqNullSafe(F.col("_by")) & (F.col("_run") == F.col("_at")), "left")
        composed = F.when(F.col("_from").isNull(), F.col("_path")).otherwise(F.transform("_from", lambda i: F.element_at("_path", i + 1)))
        whole = written(joined.select(by, "_run", composed.alias("_path")), "paths")
        step_ *= 2
    entry = whole.select(F.col(by).alias("_by"), (F.col("_run") + 1).alias("_at"), F.col("_path")[0].alias("_entry"))
    entered = maps.join(entry.hint("merge"), F.col(by).eqNullSafe(F.col("_by")) & (F.col("_run") == F.col("_at")), "left")
    started = entered.withColumn("_places", places_of("_sizes", F.coalesce("_entry", F.lit(0)).cast("int")))
    before = Window.partitionBy(by).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    started = started.select(F.col(by).alias("_by"), F.col("_run").alias("_at"), "_places", F.coalesce(F.sum(F.element_at("_places", -1)).over(before), F.lit(0)).alias("_batches"))
    joined = placed.join(started.hint("merge"), F.col(by).eqNullSafe(F.col("_by")) & (F.col("_run") == F.col("_at")))
    place = ((F.col("_n") - 1) % run).cast("int")
    # both windows below find a batch's rows where this puts them
    numbered_ = joined.withColumn("batch", (F.col("_batches") + F.element_at("_places", place + 1)).cast("int")).drop("_places", "_batches", "_by", "_at").repartition(by, "batch")
    again = F.row_number().over(Window.partitionBy(by, "batch", "evidence_id").orderBy("_n")) > 1
    running = F.sum(F.col("_item") + F.when(F.col("_again"), 0).otherwise(F.col("_once"))).over(Window.partitionBy(by, "batch").orderBy("_n"))
    return numbered_.withColumn("_again", again).withColumn("chars", running.cast("long")).select(*tasks.columns, "batch", "chars")
