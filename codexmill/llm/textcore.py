"""Vectorised text kernels shared by the Arrow-based operators.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D. All kernels work on the UTF-8
bytes of an Arrow batch, never on single Python strings, and cover whole texts. A null text
counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (two multiply-xorshift rounds)."""
    x = np.asarray(x, U64).copy()
    with np.errstate(over="ignore"):
        x ^= x >> U64(32)
        x *= U64(0xD6E8FEB86659FD93)
        x ^= x >> U64(32)
        x *= U64(0xD6E8FEB86659FD93)
        x ^= x >> U64(32)
    return x


_LANE = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], U64)
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
#: ASCII letters, digits and all bytes from 0x80.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

#: Texts are handled in slices of about so many bytes; one longer text is a slice of its own.
SLICE_BYTES = 4 << 20


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls become empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes each."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to
        at = to


class Words:
    """Words of some whole texts: `hash` of each, its row `doc`, byte span `start`/`end`
    (relative to the slice) and `first`, where the words of each row begin (rows + 1).
    With `letters`, words are runs of ASCII letters, digits and bytes from 0x80."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, lower: bool = True, letters: bool = False):
        n = len(offsets) - 1
        self.rows = n
        data = _LOWER[raw] if lower else raw
        self.data = data
        word = (LETTERS if letters else _IS_WORD)[data]
        edge = np.empty(len(data) + 1, bool)
        edge[1:] = word
        edge[0] = False
        begins = offsets[:-1][np.diff(offsets) > 0]
        before = edge[:-1].copy()
        before[begins] = False
        self.start = np.flatnonzero(word & ~before)
        after = np.empty(len(data), bool)
        if len(data):
            after[:-1] = word[1:]
            after[-1] = False
            after[begins[1:] - 1] = False
        self.end = np.flatnonzero(word & ~after) + 1
        self.first = np.searchsorted(self.start, offsets, "left")
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(n), self.count)
        self.hash = self.hash_spans(self.start, self.end)

    def hash_spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte spans, eight bytes of every one at a time."""
        data = self.data
        if not len(start):
            return np.empty(0, U64)
        padded = np.zeros(len(data) + 8, np.uint8)
        padded[: len(data)] = data
        lanes = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
        size = end - start
        with np.errstate(over="ignore"):
            out = size.astype(U64) * U64(0xA0761D6478BD642F)
            at, left, into = start, size, None
            while len(at):
                lane = (lanes[at] & _LANE[np.minimum(left, 8)]) * U64(0x9FB21C651E98DF25)
                lane ^= lane >> U64(29)
                held = ((out if into is None else out[into]) ^ lane) * U64(0xE7037ED1A0B428DB)
                held ^= held >> U64(32)
                if into is None:
                    out = held
                else:
                    out[into] = held
                more = np.flatnonzero(left > 8)
                into = more if into is None else into[more]
                at, left = at[more] + 8, left[more] - 8
        return mix64(out)


def argsort64(x: np.ndarray) -> np.ndarray:
    """argsort of 64-bit keys: a plain sort of their first bits packed with positions, then
    the few runs that those bits leave undecided."""
    n = len(x)
    bits = max(1, n.bit_length())
    if n < 64 or bits > 24:
        return np.argsort(x)
    low = U64((1 << bits) - 1)
    at = (np.sort((x & ~low) | np.arange(n, dtype=U64)) & low).astype(np.int64)
    s = x[at]
    wrong = np.flatnonzero(s[1:] < s[:-1])
    if not len(wrong):
        return at
    if len(wrong) > 4000:
        return np.argsort(x)
    s &= ~low
    runs = np.unique(s[wrong])
    for a, b in zip(np.searchsorted(s, runs, "left"), np.searchsorted(s, runs, "right")):
        at[a:b] = at[a:b][np.argsort(x[at[a:b]])]
    return at


def unique_inverse(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct keys, index of each entry's key)."""
    if not len(x):
        return x, np.empty(0, np.int64)
    at = argsort64(x)
    s = x[at]
    new = np.empty(len(x), bool)
    new[0] = True
    np.not_equal(s[1:], s[:-1], out=new[1:])
    inverse = np.empty(len(x), np.int64)
    inverse[at] = np.cumsum(new) - 1
    return s[new], inverse


def text_slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) for slices of a column."""
    raw, offsets = text_buffers(column)
    for a, b in slices(offsets):
        yield a, b, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every k-word shingle; a row of 1 to k-1 words has one of all its words."""
    h, n = words.hash, len(words.hash)
    if not n:
        return np.empty(0, U64), np.empty(0, np.int64)
    mult = mix64(np.arange(1, k + 1, dtype=U64)) | U64(1)
    size = np.minimum(words.count, k)
    many = np.where(words.count > 0, np.maximum(words.count - k + 1, 1), 0)
    doc = np.repeat(np.arange(words.rows), many)
    begin = np.zeros(words.rows, np.int64)
    np.cumsum(many[:-1], out=begin[1:])
    at = words.first[:-1][doc] + (np.arange(len(doc)) - begin[doc])
    out = np.zeros(len(doc), U64)
    with np.errstate(over="ignore"):
        for j in range(k):
            if (full := bool((size[doc] > j).all())):
                out += h[at + j] * mult[j]
            else:
                has = size[doc] > j
                out[has] += h[at[has] + j] * mult[j]
        out += size[doc].astype(U64) * U64(0xE7037ED1A0B428DB)
    del full
    return mix64(out), doc


def crc_mod(ids: list, modulus: int) -> np.ndarray:
    """crc32 of each id written as text, modulo `modulus`; a null id counts as empty text."""
    from zlib import crc32

    return np.fromiter((crc32(b"" if x is None else str(x).encode()) % modulus for x in ids), np.int64, len(ids))
