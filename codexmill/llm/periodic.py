"""Periodic runs of words: maximal stretches that repeat with a smallest period, and texts with
the repeats collapsed.

A run of period p is a maximal stretch of positions j whose words j and j + p agree, with the p
words after it. Such a stretch is at least step = max(p, least - p) long, so it holds a point of
the grid 0, step, 2 * step, ... of its text. All (period, grid point) pairs of a slice of texts
stand in flat arrays: n / 1 + n / 2 + n / 3 + ... of them, so n log n. Pairs whose words differ,
or whose neighbours on both sides do, fall out; of the rest those that the point before already
stands for. What remains is extended to both sides by binary search over prefix hashes modulo
2^61 - 1, all pairs at once. A stretch that several periods find has the least of them. Words of
the runs that are left are then compared by their bytes.

Rows never leave their task: no shuffle, and memory grows with the longest text only.

Defined results: a null or empty text has no words, no runs and an empty collapsed text;
repeated rows get a result each; rows of a null doc_id are rows like others; an empty table
gives no rows; input columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .textcore import U64, Words, mix64, text_slices, unique_inverse

#: Shortest run, in words.
LEAST = 12
#: So many pairs of period and grid point are looked at together.
PAIRS = 1 << 20
P61 = U64((1 << 61) - 1)
_LOW31, _LOW30 = U64((1 << 31) - 1), U64((1 << 30) - 1)
_BASES = (0x123456789ABCDEF, 0xFEDCBA987654321, 0x0F1E2D3C4B5A697)


def _fold(x: np.ndarray) -> np.ndarray:
    x = (x & P61) + (x >> U64(61))
    return np.where(x >= P61, x - P61, x)


def mul61(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2^61 - 1 for numbers below it."""
    au, ad, bu, bd = a >> U64(31), a & _LOW31, b >> U64(31), b & _LOW31
    mid = ad * bu + au * bd
    return _fold(((au * bu) << U64(1)) + (mid >> U64(30)) + ((mid & _LOW30) << U64(31)) + ad * bd)


class Prefixes:
    """Prefix hashes of a sequence: `equal` tells of many (place, shift, length) at once whether
    the stretch at the place and the one `shift` further agree."""

    def __init__(self, keys: np.ndarray, base: int):
        n = len(keys)
        self.power = np.ones(n + 1, U64)
        grown, by = 1, np.array([base], U64)
        while grown <= n:
            to = min(2 * grown, n + 1)
            self.power[grown:to] = mul61(self.power[: to - grown], by)
            grown, by = 2 * grown, mul61(by, by)
        terms = mul61(_fold(mix64(keys)), self.power[:n])
        self.sums = np.zeros(n + 1, U64)
        high = _fold(np.cumsum(terms >> U64(31)))
        self.sums[1:] = _fold(mul61(high, np.full(1, 1 << 31, U64)) + _fold(np.cumsum(terms & _LOW31)))

    def equal(self, at: np.ndarray, shift: np.ndarray, length: np.ndarray) -> np.ndarray:
        span = lambda a: _fold(self.sums[a + length] + (P61 - self.sums[a]))
        return mul61(span(at), self.power[shift]) == span(at + shift)


def _longest(fits, most: np.ndarray) -> np.ndarray:
    """The largest length up to `most` that fits, for each entry, by binary search."""
    low, high = np.zeros(len(most), np.int64), most.copy()
    while (open_ := np.flatnonzero(low < high)).size:
        middle = (low[open_] + high[open_] + 1) >> 1
        ok = fits(open_, middle)
        low[open_[ok]] = middle[ok]
        high[open_[~ok]] = middle[~ok] - 1
    return low


def find(keys: np.ndarray, first: np.ndarray, least: int = LEAST, base: int = _BASES[0]) -> np.ndarray:
    """Columns (row, start, length, period) of all runs, in the order of row, start, period.
    Row r holds the words first[r] to first[r + 1] of `keys`."""
    rows, counts = len(first) - 1, np.diff(first)
    # each row begins after a separator, which equals nothing else
    begin = first[:-1] + np.arange(rows) + 1
    symbol, word = unique_inverse(keys)
    line = np.empty(len(keys) + rows + 1, np.int64)
    place = np.arange(len(keys)) + np.repeat(np.arange(rows), counts) + 1
    line[place] = word
    walls = np.ones(len(line), bool)
    walls[place] = False
    line[walls] = len(symbol) + np.arange(rows + 1)
    hashes = Prefixes(line.astype(U64), base)
    periods = np.where(counts >= least, counts // 2, 0)
    row = np.repeat(np.arange(rows), periods)
    period = np.arange(len(row)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    step = np.maximum(period, least - period)
    points = np.maximum((counts[row] - 1 - period) // step + 1, 0)
    until = np.cumsum(points)
    found = []
    for a, b in zip(cuts := _cuts(until), cuts[1:]):
        own = np.repeat(np.arange(a, b), points[a:b])
        nth = np.arange(len(own)) - np.repeat(until[a:b] - points[a:b] - (until[a - 1] if a else 0), points[a:b])
        at, p = begin[row[own]] + nth * step[own], period[own]
        same = line[at] == line[at + p]
        own, nth, at, p = own[same], nth[same], at[same], p[same]
        near = (step[own] == 1) | (line[at + 1] == line[at + p + 1]) | (line[at - 1] == line[at + p - 1])
        own, nth, at, p = own[near], nth[near], at[near], p[near]
        back = np.where(nth > 0, step[own], 0)
        told = (nth > 0) & hashes.equal(at - back, p, back)
        own, at, p = own[~told], at[~told], p[~told]
        start, end = begin[row[own]], begin[row[own]] + counts[row[own]]
        ahead = _longest(lambda i, n: hashes.equal(at[i], p[i], n), end - at - p)
        behind = _longest(lambda i, n: hashes.equal(at[i] - n, p[i], n), at - start)
        long = ahead + behind >= step[own]
        found.append(np.stack([(at - behind)[long], (at + ahead + p)[long], p[long], row[own][long]]))
    runs = np.concatenate(found, 1) if found else np.empty((4, 0), np.int64)
    runs = runs[:, np.lexsort((runs[2], runs[1], runs[0]))]
    new = np.ones(runs.shape[1], bool)
    new[1:] = (runs[0, 1:] != runs[0, :-1]) | (runs[1, 1:] != runs[1, :-1])
    start, end, period, row = runs[:, new]
    order = np.lexsort((period, start))
    return np.stack([row, start - begin[row], end - start, period])[:, order]


def _cuts(until: np.ndarray) -> list[int]:
    """Where to cut a list with running totals `until` for about PAIRS in each part."""
    out = [0]
    while out[-1] < len(until):
        done = until[out[-1] - 1] if out[-1] else 0
        out.append(max(out[-1] + 1, int(np.searchsorted(until, done + PAIRS, "right"))))
    return out


def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each entry, `count` of them."""
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count - start, count)


def _verified(words: Words, runs: np.ndarray) -> bool:
    """Whether all words of the runs equal the ones a period on, by their bytes."""
    row, start, length, period = runs
    base = words.first[row] + start
    for a, b in zip(cuts := _cuts(np.cumsum(length - period)), cuts[1:]):
        at = _spread(base[a:b], (length - period)[a:b])
        to = at + np.repeat(period[a:b], (length - period)[a:b])
        size = words.end[at] - words.start[at]
        if (size != words.end[to] - words.start[to]).any():
            return False
        x, y = words.start[at], words.start[to]
        for k in range(int(size.max(initial=0))):
            more = size > k
            x, y, size = x[more], y[more], size[more]
            if (words.data[x + k] != words.data[y + k]).any():
                return False
    return True


def runs_of(words: Words, least: int = LEAST) -> np.ndarray:
    """`find` for the words of some texts, with verified words."""
    for base in _BASES:
        if _verified(words, runs := find(words.hash, words.first, least, base)):
            return runs
        spans = zip(words.start.tolist(), words.end.tolist())  # hashes of words or ranges met: number the words
        number: dict[bytes, int] = {}
        words.hash = np.array([number.setdefault(words.data[a:b].tobytes(), len(number)) for a, b in spans], U64)
    raise RuntimeError("prefix hashes of three bases met")


def _collapsed(words: Words, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts without the words after the first period of any run."""
    row, start, length, period = runs
    turn = np.zeros(len(words.start) + 1, np.int64)
    base = words.first[row] + start
    np.add.at(turn, base + period, 1)
    np.add.at(turn, base + length, -1)
    kept = np.flatnonzero(np.cumsum(turn[:-1]) == 0)
    count = np.bincount(words.doc[kept], minlength=words.rows)
    size = words.end[kept] - words.start[kept]
    last = np.cumsum(count)[count > 0] - 1
    wide = size + 1  # a space after each word but the last of its text
    wide[last] -= 1
    to = np.cumsum(wide) - wide
    out = np.full(int(wide.sum()), 0x20, np.uint8)
    for a, b in zip(cuts := _cuts(np.cumsum(size)), cuts[1:]):
        out[_spread(to[a:b], size[a:b])] = words.data[_spread(words.start[kept[a:b]], size[a:b])]
    offsets = np.zeros(words.rows + 1, np.int64)
    np.cumsum(np.bincount(words.doc[kept], wide, words.rows), out=offsets[1:])
    return out, offsets


def _kernel(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, offsets in text_slices(batch.column(1)):
                words = Words(raw, offsets, lower=False)
                runs = runs_of(words, least)
                ends = np.zeros(words.rows + 1, np.int32)
                np.cumsum(np.bincount(runs[0], minlength=words.rows), out=ends[1:])
                fields = [pa.array(x) for x in runs[1:]]
                listed = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
                out, at = _collapsed(words, runs)
                text = pa.LargeStringArray.from_buffers(words.rows, pa.py_buffer(at), pa.py_buffer(out)).cast(pa.string())
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(words.count), listed, text], ["doc_id", "n_words", "runs", "collapsed"])

    return run


def repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed (the
    kept words, joined by one space) of every row."""
    common.bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_kernel(least), f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def looped(docs: DataFrame) -> DataFrame:
    """doc_id and text, where one text in ten (by its id's checksum) goes round in a loop of its
    own words from some word on; a null id counts as empty text."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    n, a, p = (F.col(f"_m.{x}") for x in "nap")
    facts = F.struct(F.size(words).cast("long").alias("n"), (g % F.size(words)).alias("a"), g.alias("g"))
    some = docs.select("doc_id", "text", F.when((h % 10 == 0) & (common.word_count(F.col("text")) > 0), facts).alias("_m"))
    some = some.withColumn("_m", F.when(F.col("_m").isNotNull(), F.struct("_m.n", "_m.a", (F.floor((n - a) / (3 + F.col("_m.g") % 8)) + 1).alias("p"))))
    int_ = lambda x: x.cast("int")
    times = int_(F.ceil((n - a) / p))
    loop = F.slice(F.flatten(F.array_repeat(F.slice(words, int_(a + 1), int_(p)), times)), F.lit(1), int_(n - a))
    text = F.array_join(F.concat(F.slice(words, F.lit(1), int_(a)), loop), " ")
    return some.select("doc_id", F.when(F.col("_m").isNull(), F.col("text")).otherwise(text).alias("text"))


def longest(runs: Column) -> Column:
    """The run of greatest length; of equal ones the first, then the one of the least period."""
    ranked = F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    return F.array_max(ranked)
