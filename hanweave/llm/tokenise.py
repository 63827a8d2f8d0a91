"""Exact batch tokenisation with the tokenizers library, each distinct chunk once.

The pre-tokenisers of the supported files never join text across the cuts made here,
so a text's ids are its chunks' ids one after another: cuts lie before each run of
blanks (space, tab, line feed, carriage return) that follows a character which is neither
white space of any kind nor a control or format character, and between a plain ASCII
letter and an ASCII sign or digit after it.  Neither place looks at what lies further off.

Chunks are found and hashed with numpy over code points; a worker keeps the ids of the
chunks that it has met in sorted arrays, up to a fixed size, and asks the library only
for new ones, many at a time with a special token between them, which the library treats
like the end of a text.  Two independent 64-bit hashes tell chunks apart; where two chunks share
the first of them, the texts are encoded directly.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np

from hanweave.llm import ragged

ASCII_ODD = [*range(0, 9), 11, 12, *range(14, 32), 127]
_LOW = 128
_BLANK = np.zeros(_LOW, bool)
_BLANK[[9, 10, 13, 32]] = True
_LETTER = np.zeros(_LOW, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_ODD = np.zeros(_LOW, bool)
_ODD[ASCII_ODD] = True
#: White space and format characters outside ASCII, after which nothing is cut.
_WIDE_ODD = np.array([0x85, 0xA0, 0x1680, *range(0x2000, 0x2010), *range(0x2028, 0x2030), 0x205F, 0x2060, 0x3000, 0xFEFF, 0x180E], np.uint32)

_BEFORE_BLANK = re.compile("[^ \t\n\r" + "".join(re.escape(chr(c)) for c in [*ASCII_ODD, *_WIDE_ODD.tolist()]) + "](?=[ \t\n\r])")


class Clash(ValueError):
    """Two chunks share a hash."""


class Encoder:
    """One tokenizer file; ``encode`` gives the ids of many texts at once."""

    def __init__(self, path: str, keep: int = 1_500_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True  # their strings in a text are ordinary text
        # a special token that takes no white space with it can set many chunks in one text apart
        known = self.model.get_added_tokens_decoder()
        self.signs = [t.content for t in known.values()]
        self.mark, self.between = next(((i, t.content) for i, t in known.items() if t.special and not (t.lstrip or t.rstrip or t.single_word or t.normalized)), (None, None))
        self.keep = keep
        self._clear()

    def _clear(self) -> None:
        self.hash = np.zeros(0, np.uint64)
        self.check = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.pool = np.zeros(1024, np.uint32)
        self.used = 0

    def _raw(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes

    def _many(self, texts: list[str], group: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """The same for many short texts; those that hold a special token's string go by themselves."""
        if self.between is None or any(s in t for t in texts for s in self.signs):
            return self._raw(texts)
        joined = [self.between.join(texts[i : i + group]) for i in range(0, len(texts), group)]
        self.model.encode_special_tokens = False
        try:
            found = [np.fromiter(e.ids, np.uint32) for e in self.model.encode_batch_fast(joined, add_special_tokens=False)]
        finally:
            self.model.encode_special_tokens = True
        ids = np.concatenate([x for own in found for x in (own, np.array([self.mark], np.uint32))])
        ends = np.flatnonzero(ids == self.mark)
        return ids[ids != self.mark], np.diff(ends, prepend=-1) - 1

    def encode(self, texts: list[str], long: int = 4 << 20) -> tuple[np.ndarray, np.ndarray]:
        """``(ids of all texts one after another, number of ids of each text)``.

        A text of over ``long`` characters is encoded in stretches, so that memory stays
        bounded; they end before blanks, where chunks do too.
        """
        if all(len(t) <= long for t in texts):
            return self._encode(texts)
        out = []
        for t in texts:
            parts, at = [] if len(t) > long else [t], 0
            while len(t) > long and at < len(t):
                end = _BEFORE_BLANK.search(t, at + long // 4)
                parts.append(t[at : end.end() if end else len(t)])
                at += len(parts[-1])
            found = [self._encode([p]) for p in parts]
            out.append((np.concatenate([ids for ids, _ in found]), np.array([sum(int(n.sum()) for _, n in found)], np.int64)))
        return np.concatenate([ids for ids, _ in out]), np.concatenate([n for _, n in out])

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        low = np.minimum(points, _LOW - 1)
        plain = points < _LOW
        odd = _ODD[low] & plain
        wide = np.flatnonzero(~plain)
        if len(wide):
            odd[wide] = np.isin(points[wide], _WIDE_ODD)
        try:
            return self._cut(points, low, plain, odd, bounds)
        except Clash:
            return self._raw(texts)

    def _cut(self, points: np.ndarray, low: np.ndarray, plain: np.ndarray, odd: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(points):
            return np.zeros(0, np.uint32), np.zeros(len(bounds) - 1, np.int64)
        blank = _BLANK[low] & plain
        letter = _LETTER[low]
        start = np.zeros(len(points), bool)
        start[1:] = ~blank[:-1] & ~odd[:-1] & (blank[1:] | (letter[:-1] & plain[:-1] & plain[1:] & ~letter[1:]))
        start[bounds[:-1][bounds[:-1] < len(points)]] = True
        starts = np.flatnonzero(start)
        sizes = np.diff(np.append(starts, len(points)))
        h, c = ragged.cover_hashes(points, starts)
        known, first, back = np.unique(h, return_index=True, return_inverse=True)
        if (c[first][back] != c).any():
            raise Clash
        at, n = self._find(known, c[first], points, starts[first], sizes[first])
        per = n[back]
        ids = self.pool[ragged.ranges(at[back], per)]
        ends = np.concatenate([[0], np.cumsum(per)])
        cut = np.searchsorted(starts, bounds)
        return ids, np.diff(ends[cut])

    def _find(self, known, check, points, starts, sizes) -> tuple[np.ndarray, np.ndarray]:
        """Place and length in the pool of each of the sorted hashes."""
        if len(self.hash) + len(known) > self.keep:
            self._clear()
        near = np.minimum(np.searchsorted(self.hash, known), max(len(self.hash) - 1, 0))
        have = self.hash[near] == known if len(self.hash) else np.zeros(len(known), bool)
        if (self.check[near[have]] != check[have]).any():
            raise Clash
        new = np.flatnonzero(~have)
        if len(new):
            text = [points[s : s + z].tobytes().decode("utf-32-le", "surrogatepass") for s, z in zip(starts[new].tolist(), sizes[new].tolist())]
            ids, n = self._many(text)
            while self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.uint32)])
            self.pool[self.used : self.used + len(ids)] = ids
            at = self.used + np.cumsum(n) - n
            self.used += len(ids)
            place = np.searchsorted(self.hash, known[new])
            self.hash = np.insert(self.hash, place, known[new])
            self.check = np.insert(self.check, place, check[new])
            self.at = np.insert(self.at, place, at)
            self.size = np.insert(self.size, place, n)
            near = np.searchsorted(self.hash, known)
        return self.at[near], self.size[near]


_OPEN: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file; it lives as long as the worker."""
    if path not in _OPEN:
        _OPEN.clear()
        _OPEN[path] = Encoder(path)
    return _OPEN[path]


def text_groups(batches, columns: tuple[str, ...], limit: int = 1 << 20):
    """Groups of rows of about ``limit`` characters of text: lists by column; null texts are empty.

    The text is the last of ``columns``.  A longer text is a group by itself.
    """
    held: list[tuple] = []
    size = 0
    for batch in batches:
        rows = zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns))
        for row in rows:
            text = row[-1] or ""
            if held and size + len(text) > limit:
                yield [list(x) for x in zip(*held)]
                held, size = [], 0
            held.append((*row[:-1], text))
            size += len(text)
    if held:
        yield [list(x) for x in zip(*held)]
