"""Texts to integer arrays with numpy: words, their hashes, shingles, chunks.

A run of texts becomes one array of code points. Classes of characters come
from tables, edges of words from comparing neighbours, and 64-bit hashes of all
words at once from prefix sums of ``code * P**i`` (mod 2**64; ``P`` is odd, so
dividing by ``P**start`` makes them independent of the place). Nothing loops
over characters or words in Python. Texts beyond ``SEGMENT`` characters are cut
at blanks into segments and put together again, so memory stays bounded by the
slice, not by the longest text.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np

#: Characters worked on at once.
SLICE = 1_500_000
SEGMENT = 1_000_000

U = np.uint64
MULT = U(0x9E3779B97F4A7C15)
_P = 0xD6E8FEB86659FD93
_P_INVERSE = pow(_P, -1, 1 << 64)

WORD, BLANK, LINE_END, SPACE, LETTER, PUNCT = 1, 2, 4, 8, 16, 32


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """Bits of each code point. SPACE is wide: whatever some library may take
    for white space. LETTER is narrow: Latin letters up to U+024F; PUNCT too:
    ASCII characters that are neither letters, digits nor white space."""
    out = np.zeros(0x110000, np.uint8)
    word = re.compile(r"\w")
    for i in range(0x110000):
        if 0xD800 <= i < 0xE000:
            continue
        c = chr(i)
        kind = unicodedata.category(c)
        bits = WORD if word.match(c) else 0
        if c.isspace() or kind[0] in "Z" or kind == "Cc":
            bits |= SPACE
        elif i < 0x250 and kind[0] == "L":
            bits |= LETTER
        elif i < 0x80 and not c.isalnum():
            bits |= PUNCT
        out[i] = bits
    out[32] |= BLANK
    out[10] |= LINE_END
    return out


class _Powers:
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 1 << 16)
            for name, base in (("up", _P), ("down", _P_INVERSE)):
                table = np.full(size, U(base))
                table[0] = 1
                setattr(cls, name, np.multiply.accumulate(table))
        return cls.up, cls.down


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a bijection that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Buffer:
    """Texts in one array of code points."""

    def __init__(self, texts: list[str]):
        self.joined = "".join(texts)
        self.codes = np.frombuffer(self.joined.encode("utf-32-le", "replace"), "<u4")
        self.edges = np.cumsum([0, *map(len, texts)])
        self.kinds = char_classes()[self.codes]

    def hashes(self, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(self.codes)
        up, down = _Powers.upto(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.codes.astype(np.uint64) + U(1)) * up[:n], out=sums[1:])
        return mixed((sums[ends] - sums[begins]) * down[begins] + (ends - begins).astype(np.uint64) * MULT)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begins and ends of maximal runs of word characters within a text,
        and how many words each text has."""
        word = (self.kinds & WORD) > 0
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        inner = self.edges[1:-1]
        inner = inner[(inner > 0) & (inner < len(word))]
        first[inner] |= word[inner]
        last[inner - 1] |= word[inner - 1]
        begins, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        return begins, ends, np.diff(np.searchsorted(begins, self.edges))

    def chunks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begins and ends of chunks that cover every text, and how many each
        text has. Cuts: at the first white space after something else; between
        a letter and punctuation; behind a lone line end. No pre-token of the
        byte-level or word-wise BPE patterns in ``tokens`` spans such a place."""
        k = self.kinds
        cut = np.zeros(len(k), bool)
        if len(k) > 1:
            cut[1:] = ((k[1:] & (BLANK | LINE_END)) > 0) & ((k[:-1] & SPACE) == 0)
            cut[1:] |= ((k[:-1] & LETTER) > 0) & ((k[1:] & PUNCT) > 0)
        if len(k) > 2:
            cut[2:] |= ((k[1:-1] & LINE_END) > 0) & ((k[:-2] & SPACE) == 0) & ((k[2:] & SPACE) == 0)
        begin = self.edges[:-1]
        cut[begin[begin < len(k)]] = True
        begins = np.flatnonzero(cut)
        return begins, np.append(begins[1:], len(k)), np.diff(np.searchsorted(begins, self.edges))


    def blank_chunks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``chunks``, cut only at the first white space, of any kind, after
        something else."""
        k = self.kinds
        cut = np.zeros(len(k), bool)
        cut[1:] = ((k[1:] & SPACE) > 0) & ((k[:-1] & SPACE) == 0)
        begin = self.edges[:-1]
        cut[begin[begin < len(k)]] = True
        begins = np.flatnonzero(cut)
        return begins, np.append(begins[1:], len(k)), np.diff(np.searchsorted(begins, self.edges))


def segments(text: str) -> list[str]:
    """Cut a long text before blanks that follow something else."""
    out, at = [], 0
    while len(text) - at > SEGMENT:
        cut = at + SEGMENT
        while cut < len(text) and not (text[cut] == " " and not text[cut - 1].isspace()):
            cut += 1
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]] if out else [text]


def in_slices(texts: list[str], chars: int = SLICE) -> Iterator[tuple[int, int]]:
    """Cut a list of texts into runs of about ``chars`` characters; a longer
    text is a run of its own."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > chars:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def _by_segment(texts: list[str], one: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
    """``one`` maps texts to their values and numbers of values; long texts go
    through it segment by segment."""
    if sum(map(len, texts)) <= max(SLICE, SEGMENT):
        return one(texts)
    cut = [segments(t) for t in texts]
    flat = [s for c in cut for s in c]
    got = [one(flat[i:j]) for i, j in in_slices(flat)]
    values = np.concatenate([v for v, _ in got])
    lens = np.concatenate([n for _, n in got])
    first = np.cumsum([0, *map(len, cut)])
    return values, np.diff(np.concatenate([[0], np.cumsum(lens)])[first])


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (``re.findall(r"\\w+", text.lower())``) of all
    texts, and how many words each text has."""

    def one(part):
        b = Buffer([t.lower() for t in part])
        begins, ends, n = b.words()
        return b.hashes(begins, ends), n

    return _by_segment(texts, one)


def shingle_hashes(words: np.ndarray, lens: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words of each text, in order, and how
    many each text has. A shorter text with words has one: all its words."""
    lens = np.asarray(lens, np.int64)
    counts = np.where(lens >= size, lens - size + 1, np.minimum(lens, 1))
    n, total = len(words), int(counts.sum())
    if not total:
        return np.zeros(0, np.uint64), counts
    at = np.repeat(np.cumsum(lens) - lens - (np.cumsum(counts) - counts), counts) + np.arange(total)
    # prefix sums of word * P**i give each run's polynomial hash, as for characters
    up, down = _Powers.upto(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mixed(words) * up[:n], out=sums[1:])
    width = np.repeat(np.minimum(lens, size), counts)
    return mixed((sums[at + width] - sums[at]) * down[at] + width.astype(np.uint64) * MULT), counts


class ChunkCoder:
    """Values of texts that are those of their chunks one after another. Each
    distinct chunk is mapped once and kept by hash, up to ``limit`` chunks; then
    the store is emptied. It never changes a result."""

    def __init__(self, values_of: Callable[[list[str]], list], dtype=np.uint32, limit: int = 1_500_000, cut: str = "chunks"):
        self.values_of, self.dtype, self.limit, self.cut = values_of, dtype, limit, cut
        self._empty()

    def _empty(self) -> None:
        self.known, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.values, self.used = np.zeros(1 << 16, self.dtype), 0

    def _learn(self, new: np.ndarray, chunks: list[str]) -> None:
        got = self.values_of(chunks)
        size = np.fromiter(map(len, got), np.int64, len(got))
        total = int(size.sum())
        if self.used + total > len(self.values):
            self.values = np.concatenate([self.values, np.zeros(max(total, len(self.values)), self.dtype)])
        self.values[self.used : self.used + total] = np.fromiter((v for g in got for v in g), self.dtype, total)
        at = np.searchsorted(self.known, new)
        self.known = np.insert(self.known, at, new)
        self.size = np.insert(self.size, at, size)
        self.place = np.insert(self.place, at, self.used + np.cumsum(size) - size)
        self.used += total

    def _one(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        b = Buffer(texts)
        begins, ends, n = getattr(b, self.cut)()
        if not len(begins):
            return np.zeros(0, self.dtype), n
        keys, first, back = np.unique(b.hashes(begins, ends), return_index=True, return_inverse=True)

        def unknown():
            at = np.searchsorted(self.known, keys)
            hit = np.zeros(len(keys), bool)
            inside = at < len(self.known)
            hit[inside] = self.known[at[inside]] == keys[inside]
            return ~hit

        new = unknown()
        if new.any():
            if len(self.known) and len(self.known) + int(new.sum()) > self.limit:
                self._empty()
                new = unknown()
            i = first[new]
            self._learn(keys[new], [b.joined[s:e] for s, e in zip(begins[i].tolist(), ends[i].tolist())])
        at = np.searchsorted(self.known, keys)[back]
        lens = self.size[at]
        upto = np.cumsum(lens)
        out = self.values[np.repeat(self.place[at] - (upto - lens), lens) + np.arange(int(upto[-1]))]
        return out, np.diff(np.concatenate([[0], upto])[np.cumsum([0, *n])])

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return _by_segment(texts, self._one)
