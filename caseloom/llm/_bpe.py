"""Token ids of whole texts by a public byte-level BPE file, with the work done once for each distinct chunk.

The byte-level splitter cuts a text into chunks that are encoded independently of each other. For texts in ASCII and
Latin letters the cuts are found in numpy and each distinct chunk goes to the tokenizer once per task; other texts
(and those with an apostrophe or a special token's opening) go to the tokenizer whole. Both ways give the same ids.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from ._common import text_slices
from ._words import _powers_to, mix

_LETTER, _DIGIT, _SPACE, _OTHER = range(4)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[48:58] = _DIGIT
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
for _low, _high in ((65, 91), (97, 123), (0x80, 0xC0), (0xC3, 0xC9)):
    _CLASS[_low:_high] = _LETTER
#: Lead bytes of other scripts and signs, the apostrophe (contractions) and "<" (special tokens): texts with these go whole.
_WHOLE = np.zeros(256, bool)
_WHOLE[0xC9:] = _WHOLE[0xC0:0xC3] = True
_WHOLE[[39, 60]] = True


def _byte_of() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, turned round."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _ranks(path: str) -> dict[bytes, int] | None:
    """The vocabulary as bytes to ids, if its merges are in the order of their ids, so that ids serve as merge ranks."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    made = [model["vocab"].get(a + b, -1) for a, b in pairs]
    if any(x >= y for x, y in zip(made, made[1:], strict=False)) or made[:1] != [256]:
        return None
    byte_of = _byte_of()
    return {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items()}


class Encoder:
    """encode() gives (first row, row after the last, ids, ends) for successive slices of a string array; ends are by row."""

    def __init__(self, path: str, most_cached: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most_cached = Tokenizer.from_file(path), most_cached
        self.merge, self.ranks = None, _ranks(path)
        if self.ranks:  # merges one chunk in a tenth of the time; the tests hold it against the tokenizer
            import tiktoken

            self.merge = tiktoken.Encoding("chunks", pat_str=r"\S+", mergeable_ranks=self.ranks, special_tokens={})._core_bpe.encode_single_piece
        self._forget()

    def _forget(self) -> None:
        self.keys, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.at, self.count, self.used = np.zeros(1 << 16, np.uint32), np.zeros(1, np.int64), np.zeros(0, np.int64), 0
        self.text, self.text_at = np.zeros(1 << 16, np.uint8), np.zeros(1, np.int64)  # bytes of the chunks that are known

    def _learn(self, chunks: list[bytes]) -> np.ndarray:
        """Places of the ids of new chunks."""
        if self.merge:
            rank, merge = self.ranks.get, self.merge
            got = [merge(c) if (r := rank(c)) is None else (r,) for c in chunks]
        else:
            got = [x.ids for x in self.tokenizer.encode_batch_fast([c.decode() for c in chunks], add_special_tokens=False)]
        count = np.fromiter(map(len, got), np.int64, len(got))
        ids = np.fromiter(chain.from_iterable(got), np.uint32, int(count.sum()))
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat[: self.used], np.zeros(self.used + 2 * len(ids), np.uint32)))
        self.flat[self.used : self.used + len(ids)] = ids
        size, had = np.fromiter(map(len, chunks), np.int64, len(chunks)), int(self.text_at[-1])
        whole = int(size.sum())
        if had + whole > len(self.text):
            self.text = np.concatenate((self.text[:had], np.zeros(had + 2 * whole, np.uint8)))
        self.text[had : had + whole] = np.frombuffer(b"".join(chunks), np.uint8)
        self.text_at = np.concatenate((self.text_at, had + np.cumsum(size)))
        first = len(self.count)
        self.at = np.concatenate((self.at, self.used + np.cumsum(count)))
        self.count = np.concatenate((self.count, count))
        self.used += len(ids)
        return np.arange(first, first + len(got))

    def _other(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The chunks that aren't, byte for byte, those at their places: hashes meet by chance, or by design."""
        size, known = ends - starts, self.text_at[place]
        same = size == self.text_at[place + 1] - known
        at = np.flatnonzero(same)
        n = size[at]
        last = np.cumsum(n)
        kind = np.int32 if len(data) + len(self.text) < 1 << 31 else np.int64
        step = np.arange(int(last[-1]) if len(last) else 0, dtype=kind)
        here = np.take(data, np.repeat((starts[at] - last + n).astype(kind), n) + step)
        differs = np.flatnonzero(here != np.take(self.text, np.repeat((known[at] - last + n).astype(kind), n) + step))
        same[at[np.searchsorted(last, differs, "right")]] = False
        return np.flatnonzero(~same)

    def _chunks(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts, and where each text's end."""
        n = len(data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        kind, flag = _CLASS[data], np.zeros(n, bool)
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        changes = first[:n].copy()
        changes[1:] |= kind[1:] != kind[:-1]
        space, after_blank = kind == _SPACE, np.zeros(n, bool)
        after_blank[1:] = data[:-1] == 32
        flag[:] = changes & (space | ~after_blank | first[:n])
        last = space.copy()  # the last white space before other text of the same text is a chunk's start
        last[:-1] &= ~space[1:] & ~first[1:n]
        last[-1] = False
        flag |= last
        starts = np.flatnonzero(flag)
        ends = np.append(starts[1:], n)
        up, down = _powers_to(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        keys, index, inverse = np.unique(mix((sums[ends] - sums[starts]) * down[starts]), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > self.most_cached:
            self._forget()
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        near = at < len(self.keys)
        known[near] = self.keys[at[near]] == keys[near]
        if not known.all():
            new, raw = ~known, data.tobytes()
            places = self._learn([raw[a:b] for a, b in zip(starts[index[new]].tolist(), ends[index[new]].tolist(), strict=True)])
            self.place = np.insert(self.place, at[new], places)
            self.keys = np.insert(self.keys, at[new], keys[new])
        place = self.place[np.searchsorted(self.keys, keys)][inverse]
        if len(other := self._other(data, starts, ends, place)):
            raw = [data[starts[i] : ends[i]].tobytes() for i in other]
            distinct = {c: i for i, c in enumerate(dict.fromkeys(raw))}
            place[other] = self._learn(list(distinct))[[distinct[c] for c in raw]]
        count = self.count[place]
        total = np.cumsum(count)
        ids = self.flat[np.repeat(self.at[place] - (total - count), count) + np.arange(total[-1])]
        return ids, np.append(0, total)[np.searchsorted(starts, offsets[1:])]

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        for lo, hi, data, offsets in text_slices(texts):
            odd = np.append(0, np.cumsum(_WHOLE[data]))
            times = np.flatnonzero((data == 0x97) | (data == 0xB7))  # a sign among the Latin letters, after 0xC3
            whole = odd[offsets[1:]] > odd[offsets[:-1]]
            whole[np.searchsorted(offsets, times[data[times - 1] == 0xC3], "right") - 1] = True
            if not whole.any():
                yield lo, hi, *self._chunks(data, offsets)
                continue
            for i in range(hi - lo):
                part = data[offsets[i] : offsets[i + 1]]
                if whole[i]:
                    ids = np.array(self.tokenizer.encode(part.tobytes().decode(), add_special_tokens=False).ids, np.uint32)
                    yield lo + i, lo + i + 1, ids, np.array([len(ids)])
                else:
                    yield lo + i, lo + i + 1, *self._chunks(part, np.array([0, len(part)]))
