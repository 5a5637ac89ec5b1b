"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters and digits, A-Z lower-cased. At each position of a test item the seed
is the shortest n-gram of 3, 5 or 8 words that is rare: chance alone would put fewer than RARE of
it into PER_WORDS words of the training documents, by their words' counts. Copies of a passage
hardly change that number, so a widely copied item keeps its seeds, and as it is a rate the seeds
don't depend on the size of the corpus. Where no n-gram is rare the longest is taken. An item
shorter than three words is its own seed if chance would put less than one of it into all
documents, so a single common word is none.

Seeds join documents by equality of n-gram hashes: documents send the n-grams that pass a bit
filter of all seeds, each with its place. A text with a seed of an item is aligned with that item
around the seeds: Smith-Waterman over words (match 2, mismatch -1, gap -1). The score is the best
alignment's share of the whole item's, 1 for a full copy; at THRESHOLD or more the document is
contaminated. Texts stand by their md5: equal texts are aligned once.

Tables are broadcast only where they are small; the filter has at most FILTER_BITS bits and the
join removes what it lets through.

Defined results: null and empty texts are clean; items without words or without item_id match
nothing; item ids keep their type (whole numbers become long); repeated items are reported once
for each item_id, repeated rows for each row; an empty benchmark leaves all documents clean; among
equal scores the least item_id is named; extra columns are ignored by `scan` and kept by
`drop_contaminated`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .textcore import U64, Words, mix64, text_slices, unique_inverse

LENGTHS = (3, 5, 8)
RARE, PER_WORDS, THRESHOLD = 0.01, 10_000_000, 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
#: Bits of the filter: so many for each seed, in all at least and at most so many.
SEED_BITS, LEAST_BITS, FILTER_BITS = 128, 1 << 16, 1 << 28
_MULT = mix64(np.arange(1, max(LENGTHS) + 1, dtype=U64)) | U64(1)


def grams(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that begin at `at`."""
    with np.errstate(over="ignore"):
        out = np.full(len(at), U64(n * 0x9FB21C651E98DF25 & (1 << 64) - 1))
        for j in range(n):
            out += h[at + j] * _MULT[j]
    return mix64(out)


def align(a: np.ndarray, b: np.ndarray) -> int:
    """Best local alignment score of two word sequences (linear gaps)."""
    steps = np.arange(len(b) + 1) * -GAP
    row, best = np.zeros(len(b) + 1, np.int64), 0
    for x in a:
        new = np.zeros(len(b) + 1, np.int64)
        np.maximum(row[:-1] + np.where(b == x, MATCH, MISMATCH), row[1:] + GAP, out=new[1:])
        np.maximum(new, 0, out=new)
        # gaps along the row: the best earlier cell less the way from it
        row = np.maximum.accumulate(new + steps) - steps
        best = max(best, int(row.max()))
    return best


def near_seeds(item: np.ndarray, text: np.ndarray, diagonals: np.ndarray) -> int:
    """Best alignment score of an item with a text around its seeds. `diagonals`: places in the
    text less places in the item, in ascending order; near ones share a window."""
    slack, full, best = len(item) // 4 + 2, MATCH * len(item), 0
    begins = np.flatnonzero(np.r_[True, np.diff(diagonals) > slack])
    ends = np.r_[begins[1:], len(diagonals)] - 1
    # windows of most seeds first; a full copy ends the search
    for k in np.argsort(begins - ends, kind="stable").tolist():
        first, last = int(diagonals[begins[k]]), int(diagonals[ends[k]])
        if first >= 0 and np.array_equal(text[first : first + len(item)], item):
            return full
        best = max(best, align(item, text[max(0, first - slack) : last + len(item) + slack]))
        if best == full:
            break
    return best


def choose(words: np.ndarray, counts: np.ndarray, total: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """[(hashes, places), ...] of an item's seeds, by its words' counts over all documents."""
    n, out = len(words), []
    if not n:
        return out
    log = np.log((counts + 0.5) / (total + 1.0))
    if n < LENGTHS[0]:
        return [(grams(words, np.zeros(1, np.int64), n), np.zeros(1, np.int64))] if log.sum() + np.log(max(total, 1)) < 0 else out
    sums = np.concatenate([[0.0], np.cumsum(log)])
    open_ = np.arange(n - LENGTHS[0] + 1)
    for i, length in enumerate(LENGTHS):
        fits = open_[open_ + length <= n]
        rare = sums[fits + length] - sums[fits] + np.log(PER_WORDS) < np.log(RARE)
        take = fits if length == LENGTHS[-1] or LENGTHS[i + 1] > n else fits[rare]
        if len(take):
            out.append((grams(words, take, length), take))
        open_ = np.setdiff1d(open_, take)
    return out


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, item_id, words) of items with words."""
    for batch in batches:
        for a, b, raw, offsets in text_slices(batch.column(2)):
            w = Words(raw, offsets, letters=True)
            words = [w.hash[w.first[i] : w.first[i + 1]].tobytes() for i in range(w.rows)]
            yield pa.record_batch([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(words, pa.binary())], ["item", "item_id", "words"]).filter(pa.array(w.count > 0))


def _spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, at, word): every word of every item."""
    for batch in batches:
        words = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(1)]
        size = [len(w) for w in words]
        at = np.concatenate([np.arange(n) for n in size]) if size else np.empty(0, np.int64)
        yield pa.record_batch([pa.array(np.repeat(batch.column(0).to_numpy(), size)), pa.array(at, pa.int32()), pa.array(np.concatenate(words) if words else at)], ["item", "at", "word"])


def _count(known):
    """(word, n) of each slice, and (null, words in all); only of known words where those are given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            for _, _, raw, offsets in text_slices(batch.column(0)):
                h = Words(raw, offsets, letters=True).hash
                total += len(h)
                if known is not None:
                    at = np.minimum(np.searchsorted(known.value, h), max(len(known.value) - 1, 0))
                    h = h[known.value[at] == h] if len(known.value) else h[:0]
                words, back = unique_inverse(h)
                if len(words):
                    yield pa.record_batch([pa.array(words.view(np.int64)), pa.array(np.bincount(back))], ["word", "n"])
        yield pa.record_batch([pa.array([None], pa.int64()), pa.array([total], pa.int64())], ["word", "n"])

    return run


def _choose(total: int):
    """(gram, item, at): the seeds of items given as (item, [(at, word, n), ...])."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for item, spots in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = np.array([s["word"] for s in spots], np.int64).view(U64)
                for hashes, places in choose(words, np.array([s["n"] for s in spots], np.int64), total):
                    out += [(g, item, p) for g, p in zip(hashes.view(np.int64).tolist(), places.tolist())]
            gram, item, at = zip(*out) if out else ((),) * 3
            yield pa.record_batch([pa.array(gram, pa.int64()), pa.array(item, pa.int64()), pa.array(at, pa.int32())], ["gram", "item", "at"])

    return run


def _bits(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two filter bits of each hash."""
    return (h & U64(bits - 1)).astype(np.int64), (h >> U64(34) & U64(bits - 1)).astype(np.int64)


def _emit(known, seen, bits: int, lengths: tuple[int, ...]):
    """(text, gram, at): n-grams that may be seeds, by the md5 of their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = seen.value
        for batch in batches:
            for a, b, raw, offsets in text_slices(batch.column(1)):
                w = Words(raw, offsets, letters=True)
                h, stop = w.hash, w.first[1:][w.doc]
                if known is not None:
                    place = np.minimum(np.searchsorted(known.value, h), max(len(known.value) - 1, 0))
                    ok = known.value[place] == h if len(known.value) else np.zeros(len(h), bool)
                else:
                    ok = np.ones(len(h), bool)
                until = np.concatenate([[0], np.cumsum(ok)])
                for length in lengths:
                    begin = np.flatnonzero(ok)
                    begin = begin[begin + length <= stop[begin]]
                    begin = begin[until[begin + length] - until[begin] == length]
                    g = grams(h, begin, length)
                    one, two = _bits(g, bits)
                    hit = np.flatnonzero((held[one >> 3] >> (one & 7) & 1) & (held[two >> 3] >> (two & 7) & 1))
                    if len(hit):
                        row = w.doc[begin[hit]]
                        keys = batch.column(0).slice(a, b - a).take(pa.array(row))
                        yield pa.record_batch([keys, pa.array(g[hit].view(np.int64)), pa.array(begin[hit] - w.first[row], pa.int32())], ["text", "gram", "at"])

    return run


def _align(threshold: float):
    """(text, item_id, score, items) of texts with their candidates [(item_id, words, diagonals), ...]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, offsets in text_slices(batch.column(1)):
                w = Words(raw, offsets, letters=True)
                found = []
                for row, near in enumerate(batch.column(2).slice(a, b - a).to_pylist()):
                    text = w.hash[w.first[row] : w.first[row + 1]]
                    best: dict[int, float] = {}
                    for c in near:
                        item = np.frombuffer(c["words"], U64)
                        score = near_seeds(item, text, np.array(c["diagonals"], np.int64)) / (MATCH * len(item))
                        best[c["item_id"]] = max(score, best.get(c["item_id"], 0.0))
                    top = min(best, key=lambda i: (-best[i], i))
                    found.append((top, best[top], sorted(i for i, s in best.items() if s >= threshold)))
                item_id, score, items = zip(*found)
                kind = batch.column(2).type.value_type.field("item_id").type
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(item_id, kind), pa.array(score, pa.float64()), pa.array(items, pa.list_(kind))], ["text", "item_id", "score", "items"])

    return run


def _key(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _id_kind(benchmark: DataFrame) -> str:
    kind = benchmark.schema["item_id"].dataType.simpleString()
    return "long" if kind in ("tinyint", "smallint", "int", "bigint") else kind


def findings(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """text (md5), item_id, score and items of each distinct text that holds a seed. A written
    table."""
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    texts = docs.select("text").where("text is not null")
    kind = _id_kind(benchmark)
    rows = benchmark.where("item_id is not null").select(F.col("item_id").cast(kind).alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    items = common.written(rows.select(F.xxhash64("item_id", "text").alias("item"), "item_id", "text").mapInArrow(_items, f"item long, item_id {kind}, words binary"), "items")
    lengths = {r[0] for r in items.select(F.least(F.octet_length("words") / 8, F.lit(LENGTHS[0])).cast("int")).distinct().collect()}  # at most LENGTHS[0] rows
    if not lengths:
        return spark.createDataFrame([], f"text binary, item_id {kind}, score double, items array<{kind}>")
    spots = items.select("item", "words").mapInArrow(_spots, "item long, at int, word long")
    words = common.written(spots.select("word").distinct(), "item-words")
    # a word costs 24 bytes by the measure of `fits`, and 8 in the array that is broadcast
    known = share(np.sort(np.array([r[0] for r in words.collect()], np.int64).view(U64))) if common.fits(words) else None
    counts = texts.mapInArrow(_count(known), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = common.written(counts, "word-counts")
    total = counts.where("word is null").agg(F.sum("n")).first()[0] or 0
    told = spots.join(common.small(counts.where("word is not null")), "word", "left").select("item", F.struct("at", "word", F.coalesce("n", F.lit(0)).alias("n")).alias("s"))
    told = told.groupBy("item").agg(F.array_sort(F.collect_list("s")).alias("spots"))  # as long as the item
    seeds = common.written(told.mapInArrow(_choose(total), "gram long, item long, at int"), "seeds")
    bits = min(FILTER_BITS, max(LEAST_BITS, 1 << (SEED_BITS * seeds.count()).bit_length()))
    both = F.explode(F.array(F.col("gram").bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned("gram", 34).bitwiseAND(F.lit(bits - 1)))).alias("bit")
    octets = seeds.select(both).groupBy(F.shiftright("bit", 3).alias("octet")).agg(F.bit_or(F.expr("shiftleft(1, cast(bit % 8 as int))")).alias("set"))
    seen = np.zeros(bits >> 3, np.uint8)
    for octet, value in common.written(octets, "seed-bits").toLocalIterator():  # at most bits / 8 rows
        seen[octet] = value
    found = texts.select(_key(F.col("text")).alias("key"), "text").mapInArrow(_emit(known, share(seen), bits, (*sorted(lengths - {LENGTHS[0]}), *LENGTHS)), "text binary, gram long, at int")
    # copies of a text send the same rows: once a task, then once in all
    hits = found.distinct().join(common.small(seeds.withColumnRenamed("at", "of")), "gram")
    pairs = hits.groupBy("text", "item").agg(F.array_sort(F.collect_set(F.col("at") - F.col("of"))).alias("diagonals"))
    near = pairs.join(common.small(items), "item").groupBy("text").agg(F.collect_list(F.struct("item_id", "words", "diagonals")).alias("near"))
    near = common.written(near.withColumnRenamed("text", "key"), "candidates")
    held = texts.select(_key(F.col("text")).alias("key"), "text").join(common.small(near.select("key")), "key", "left_semi").dropDuplicates(["key"])
    return common.written(held.join(near, "key").select("key", "text", "near").mapInArrow(_align(threshold), f"text binary, item_id {kind}, score double, items array<{kind}>"), "findings")


def scan(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, contaminated, item_id (of the best score), score and items of every row; item_id
    only where the row is contaminated."""
    found = findings(docs, benchmark, threshold).withColumnRenamed("text", "key")
    rows = docs.select("doc_id", _key(F.col("text")).alias("key"))
    rows = common.attach(rows, found, ["key"], rows.groupBy("key").count().where(F.col("count") > common.HOT_ROWS))
    hit = F.coalesce(F.size("items") > 0, F.lit(False))
    return rows.select("doc_id", hit.alias("contaminated"), F.when(hit, F.col("item_id")).alias("item_id"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("items", F.array().cast(f"array<{_id_kind(benchmark)}>")).alias("items"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows without a benchmark item, with the input's columns."""
    (key,) = common.fresh(docs.columns, "key")
    gone = common.written(findings(docs, benchmark, threshold).where(F.size("items") > 0).select(F.col("text").alias(key)), "contaminated")
    return docs.join(common.small(gone), _key(F.col("text")) == F.col(key), "left_anti")
