"""Vectorised word splitting and hashing over Arrow string arrays.

Every Python step of this subpackage works on whole Arrow batches with numpy: a
batch is cut into pieces of about ``PIECE`` bytes so that the temporaries stay
small whatever the batch holds (a single longer text is a piece of its own),
and within a piece all words and all word k-grams are hashed at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE = 1 << 18
U = np.uint64

#: Words end at white space only: the tokens of exact substring work.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 12, 13, 32]] = True
#: Words end at any ASCII sign that is neither letter nor digit.
SIGNS = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])

_BASES = 0x9E3779B97F4A7C15, 0xA0761D6478BD642F
_GRAMS = 0xD1342543DE82EF95, 0xE7037ED1A0B428DB


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as long as asked for."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = U(base), U(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16, 2 * len(self.up))
            with np.errstate(over="ignore"):
                for name, b in (("up", self.base), ("down", self.inverse)):
                    x = np.full(size, b, U)
                    x[0] = 1
                    setattr(self, name, np.cumprod(x, dtype=U))
        return self.up[:n], self.down[:n]


_bytes, _grams = [_Powers(b) for b in _BASES], [_Powers(b) for b in _GRAMS]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n+1 offsets of the texts; null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    large = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2] if len(texts) else None
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """The words of some rows: byte ranges, and ``first[r] : first[r + 1]`` are row r's."""

    buf: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def text(self, i: int) -> str:
        return self.buf[self.start[i] : self.end[i]].tobytes().decode()

    def hashes(self, kind: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes; there are two independent kinds."""
        up, down = _bytes[kind].get(len(self.buf) + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(self.buf) + 1, U)
            np.cumsum((self.buf.astype(U) + U(1)) * up[:-1], out=sums[1:])
            return mix((sums[self.end] - sums[self.start]) * down[self.start])

    def gram_sums(self, hashes: np.ndarray, kind: int = 0) -> np.ndarray:
        up, _ = _grams[kind].get(len(hashes) + 1)
        sums = np.zeros(len(hashes) + 1, U)
        with np.errstate(over="ignore"):
            np.cumsum(hashes * up[:-1], out=sums[1:])
        return sums

    def gram_at(self, sums: np.ndarray, at: np.ndarray, k: int, kind: int = 0) -> np.ndarray:
        """Hashes of the k words from each of the word positions ``at``."""
        _, down = _grams[kind].get(len(sums))
        with np.errstate(over="ignore"):
            return mix((sums[at + k] - sums[at]) * down[at])

    def gram_starts(self, k: int) -> np.ndarray:
        """Positions (in this piece) from which k words of one row follow."""
        n = len(self)
        ok = np.zeros(n, bool)
        if n:
            left = np.repeat(self.first[1:], self.counts) - np.arange(n)
            ok = left >= k
        return np.flatnonzero(ok)


def split(buf: np.ndarray, offsets: np.ndarray, seps: np.ndarray = SPACE) -> Words:
    n = len(buf)
    word = ~seps[buf]
    begins, ends = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    begins[:n] = word
    begins[1:n] &= ~word[:-1]
    ends[1:] = word
    ends[1:n] &= ~word[1:]
    edge = np.unique(offsets)
    edge = edge[edge < n]
    begins[edge] |= word[edge]
    edge = edge[edge > 0]
    ends[edge] |= word[edge - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    return Words(buf, offsets, start, end, np.searchsorted(start, offsets))


def pieces(texts: pa.Array | pa.ChunkedArray, size: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows lo:hi with their bytes and offsets, about ``size`` bytes at a time."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    buf, offsets = text_buffer(texts)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def fold(buf: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with the capitals of ASCII and Latin-1 made small; lengths stay."""
    out = buf + (((buf >= 65) & (buf <= 90)) * np.uint8(32))
    if len(buf) > 1:
        second = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
        out[1:] += second * np.uint8(32)
    return out


def words_of(texts: pa.Array, size: int = PIECE) -> Iterator[tuple[int, int, Words]]:
    """The words of the texts as all matching here takes them: letters and digits (any sign
    beyond ASCII counts as a letter), without case."""
    for lo, hi, buf, offsets in pieces(texts, size):
        yield lo, hi, split(fold(buf), offsets, SIGNS)


def row_hashes(texts: pa.Array) -> Iterator[np.ndarray]:
    """The word hashes of each row in turn; only a piece of the rows is held at once."""
    for _, _, x in words_of(texts):
        h = x.hashes()
        for r in range(len(x.first) - 1):
            yield h[x.first[r] : x.first[r + 1]]


#: The same words in DuckDB's SQL, as a list, for texts whose capitals are Latin-1.
SQL_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\x{80}-\x{10FFFF}]+')"
