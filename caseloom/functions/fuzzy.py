"""Likeness of short strings by common subsequences, for the rows that plainer tests leave open."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType


def places(a: str) -> dict[str, int]:
    """Where each character of a string stands, as bits."""
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    return at


def common(a: str, b: str, at: dict[str, int] | None = None) -> int:
    """Length of the longest common subsequence, a row of bits at a time; at: ``places(a)``, if known."""
    if not a or not b:
        return 0
    get = (places(a) if at is None else at).get
    full = left = (1 << len(a)) - 1
    for ch in b:
        hit = left & get(ch, 0)
        if hit:
            left = (left + hit | left - hit) & full
    return len(a) - left.bit_count()


def ratio(a: str, b: str) -> float:
    """Share of characters in the common subsequence, as a percentage; two empty strings are alike."""
    return 100.0 if not a and not b else 200.0 * common(a, b) / (len(a) + len(b))


#: Bits of pieces that one pass over the shorter string goes through, unless a single piece has more.
LANES = 1 << 16


def _beside(a: str, b: str, starts: np.ndarray, size: int) -> np.ndarray:
    """(piece, width): how much ``a`` has in common with the first characters of each piece of b, size characters from each of starts, for every width up to size.

    The first row is for both strings turned round, so for the ends of b. The pieces stand beside each other in one row of bits, with a bit between that keeps
    carries apart, so one pass over ``a`` is for all of them.
    """
    number = {ch: i for i, ch in enumerate(dict.fromkeys(a))}
    none, kind = len(number), np.uint8 if len(number) < 256 else np.uint32
    points = np.frombuffer(b.encode("utf-32-le", "surrogatepass"), np.uint32)
    known = np.array([ord(ch) for ch in number])
    top = int(known.max()) + 1
    code = np.full(top + 1, none, kind)
    code[known] = np.arange(none)
    laid = np.full(len(b) + size + 1, none, kind)
    laid[: len(b)] = code[np.minimum(points, top)]
    turned = np.full(size + 1, none, kind)
    turned[: min(size, len(b))] = laid[: len(b)][: -size - 1 : -1]
    laid = laid[starts[:, None] + np.arange(size + 1)]
    laid[:, size] = none

    def bits(codes: np.ndarray, before: int) -> list[int]:
        """Where each character of ``a`` stands, beyond so many bits."""
        rows = np.packbits(codes == np.arange(none, dtype=kind)[:, None], axis=1, bitorder="little")
        raw, wide = rows.tobytes(), rows.shape[1]
        return [int.from_bytes(raw[i : i + wide], "little") << before for i in range(0, len(raw), wide)]

    hits, ends, text = bits(laid.ravel(), size + 1), bits(turned, 0), [number[ch] for ch in a]
    many = len(starts) + 1
    full = left = ((1 << size) - 1) * (((1 << many * (size + 1)) - 1) // ((1 << size + 1) - 1))
    for i, j in zip(text, reversed(text), strict=True):
        hit = left & (hits[i] | ends[j])
        left = (left + hit | left - hit) & full
    raw = np.frombuffer(left.to_bytes(many * (size + 1) // 8 + 1, "little"), np.uint8)
    ended = np.unpackbits(raw, count=many * (size + 1), bitorder="little").reshape(many, size + 1)[:, :size]
    return np.cumsum(ended == 0, axis=1, dtype=np.int32)


def _grown(n: int, hits: list[int], most: int) -> int:
    """``most``, or the most that a string of n characters has in common with a window of another one, if that is more; hits: where in the first each character of the other stands.

    From each place a piece grows until it has more in common than the best window so far: all windows that lie within what came before are left out.
    """
    full, at = (1 << n) - 1, 0
    while at + n <= len(hits) and most < n:
        left, had = full, 0
        for here in hits[at : at + n]:
            hit = left & here
            grown = left + hit
            if grown > full:  # one more in common
                had += 1
            left = (grown | left - hit) & full
        most = max(most, had)
        for here in hits[at + n :]:
            at += 1
            hit = left & here
            grown = left + hit
            if grown > full:
                had += 1
                if had > most:
                    break
            left = (grown | left - hit) & full
        else:
            break
    return most


def partial(a: str, b: str, floor: float = 0.0) -> float:
    """Best ratio of the shorter string to a window of the longer one, windows cut by its ends included; ``floor`` if none is over it.

    A string has no less in common with a piece than with any window inside it. So pieces a quarter longer than the windows, which together hold all of
    them, are looked at first, all at once; windows that a piece leaves open are looked at after that.
    """
    a, b = sorted((a, b), key=len)
    if not a:
        return max(floor, 0.0 if b else 100.0)
    if a in b:
        return 100.0
    n, m, best = len(a), len(b), floor
    step = n // 4 + 1
    size = n + step - 1
    starts = np.arange(0, m - n + 1, step)
    many = max(1, LANES // (size + 1))
    pieces = []
    for low in range(0, len(starts), many):
        common = _beside(a, b, starts[low : low + many], size)
        if not low:  # what the longer string's ends leave of a window
            best = max(best, float((200.0 * common[:2, : n - 1] / np.arange(n + 1, 2 * n)).max(initial=0.0)))
        common = common[1:]
        best = max(best, 100.0 * int(common[:, n - 1].max()) / n)
        most = int(best * n / 100.0) + 1
        while 100.0 * most > best * n:  # most: characters in common up to which a window isn't better
            most -= 1
        within = (common <= most).sum(axis=1)  # the widest part of each piece that has no better window
        pieces += [(int(starts[low + i] + within[i] - n + 1), int(starts[low + i]) + size) for i in np.flatnonzero(within < size)]
    if pieces:
        own = places(a)
        for low, high in pieces:
            had = _grown(n, [own.get(ch, 0) for ch in b[low:high]], most)
            if had > most:
                most, best = had, 100.0 * had / n
    return best


def token_set(a: str, b: str, floor: float = 0.0) -> float:
    """Best ratio of the words in both to those with the words of one only; 0 where one has no words. What can't be over ``floor`` counts as 0."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not only_x or not only_y):
        return 100.0
    one, other = (f"{both} {only}".strip() for only in (only_x, only_y))
    # the words in both are a beginning of either, so they have all of themselves in common with it
    best = 200.0 * len(both) / (len(both) + min(len(one), len(other)))
    if 200.0 * min(len(one), len(other)) > max(best, floor) * (len(one) + len(other)):
        best = max(best, ratio(one, other))
    return best


#: Below this no likeness counts; scores are whole numbers, so half a point less may be rounded up to it.
LEAST = 60
#: The most that is rounded to less.
UNDER = float(np.nextafter(LEAST - 0.5, 0))


@F.arrow_udf(IntegerType())
def _score(pairs: pa.Array) -> pa.Array:
    out, known = np.full(len(pairs), -1, np.int32), {}
    for i, pair in enumerate(zip(*(pc.struct_field(pairs, name).to_pylist() for name in ("value", "snippet")), strict=True)):
        if None in pair:
            continue
        if pair not in known:
            known[pair] = np.rint(partial(*pair, max(UNDER, token_set(*pair, UNDER))))
        out[i] = known[pair]
    return pa.array(out)


def _with(of: Callable[..., Column], *values: Column) -> Column:
    """of(values), with each value computed once for a row, however often ``of`` uses it."""
    held = F.struct(*(v.alias(f"v{i}") for i, v in enumerate(values)))
    return F.transform(F.array(held), lambda r: of(*(r[f"v{i}"] for i in range(len(values)))))[0]


def shared_characters(a: Column, b: Column) -> Column:
    """How many characters two strings have in common, each as often as it stands in both: no subsequence of both is longer."""
    times = lambda s, ch: F.length(s) - F.length(F.replace(s, ch, F.lit("")))
    each = F.filter(F.array_distinct(F.split(a, "")), lambda ch: ch != "")
    # both strings stand beside each character: a lambda that uses another's variable can't be in what a Python function takes
    beside = F.arrays_zip(each.alias("ch"), F.array_repeat(a, F.size(each)).alias("a"), F.array_repeat(b, F.size(each)).alias("b"))
    return F.aggregate(beside, F.lit(0), lambda total, x: total + F.least(times(x["a"], x["ch"]), times(x["b"], x["ch"])))


def most_likeness(a: Column, b: Column) -> Column:
    """The likeness of two lower-cased, trimmed strings is this at most.

    A window of w characters of the longer string, w up to the n of the shorter one, has c = min(w, shared) characters in common with it at most, and
    200 c / (n + w) is largest at w = shared. Sets of words: the words in both are known, and so are the lengths of what is compared.
    """
    words = lambda s: F.filter(F.array_distinct(F.split(s, r"(?U)[\s\x1c-\x1f\x85]+")), lambda w: w != "")
    long = lambda s: F.length(s).cast("double")

    def part(a: Column, b: Column, shared: Column) -> Column:
        n = F.least(F.length(a), F.length(b))
        return F.when(n == 0, F.when(F.length(a) == F.length(b), 100.0).otherwise(0.0)).otherwise(200.0 * shared / (n + shared))

    def sets(x: Column, y: Column) -> Column:
        every = (F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0)
        with_both = lambda both, s: F.when(long(both) > 0, 200.0 * long(both) / (long(both) + long(s))).otherwise(0.0)
        one = lambda both, p, q: F.greatest(200.0 * shared_characters(p, q) / (long(p) + long(q)), with_both(both, p), with_both(both, q))
        joined = _with(one, F.array_join(F.array_intersect(x, y), " "), F.array_join(x, " "), F.array_join(y, " "))
        return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).when(every & F.arrays_overlap(x, y), 100.0).otherwise(joined)

    whole = lambda a, b: F.greatest(_with(part, a, b, shared_characters(a, b)), _with(sets, words(a), words(b)))
    return _with(whole, a, b)


#: Characters up to which strings are held against the bound: longer ones in one alphabet share too many for it to tell.
SHORT = 64


def fuzzy_score(value: Column, snippet: Column, open_: Column) -> Column:
    """0 to 100 (under 60: at most 59, as nothing hangs on it) for open rows whose likeness can reach 60, else -1: only those carry strings to Python.

    Short strings are held against the bound first.
    """
    low = lambda c: F.lower(F.trim(c))
    most = F.when(F.greatest(F.length(low(value)), F.length(low(snippet))) <= SHORT, most_likeness(low(value), low(snippet))).otherwise(100.0)
    asks = F.coalesce(F.when(open_, most) >= LEAST - 0.5, F.lit(False))
    return _score(F.when(asks, F.struct(low(value).alias("value"), low(snippet).alias("snippet"))))  # both in one column, so that what opens a row is computed once
