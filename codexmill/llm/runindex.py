"""Repeated byte strings: a run-length index of what may repeat, matching statistics, long
matches marked.

All occurrences of a string of LENGTH bytes that starts more than once in the corpus are marked.

1. Windows of LENGTH bytes are named by their least k-byte hash (a minimizer); successive windows
   of one name are a segment, some hundred bytes more than a window. Equal windows have equal
   names. Segments are counted by name: a name that one segment bears, once, holds no repeat; a
   name all of whose segments are equal (by a second hash) is repeated whole.
2. Of other names every distinct segment is indexed, once: segments are dealt by name to blocks
   of about BLOCK bytes. A block's suffix array gives its Burrows-Wheeler transform, of which runs
   are kept, with the text places of each run's first and last row and the match lengths there.
   From these samples matching statistics stream over the text: along it a suffix's match with its
   neighbour in the order shortens by one at each place, until the next sample. The longer of the
   two neighbours' matches is the longest match anywhere else in the block; where it reaches
   LENGTH, a window repeats. Bytes are compared, not hashes.
3. A name that very many different segments share (a common line in different surroundings) would
   be too much for one block. Such segments are named again by longer hashes, up to whole windows,
   where equal names are equal windows. No segment is left out.
4. Marks come back to the rows, are joined into spans, and cut out.

Lineage is cut by written tables; segments of a name that very many rows bear are only counted
or joined, which Spark splits, never gathered.

Defined results: a null text is an empty one and of 0 bytes; matches never cross rows; a repeated
row of LENGTH bytes or more is removed wholly, in all its copies; rows of a null doc_id are rows
like others; removed bytes may cut characters, so what is kept is binary; an empty table gives
no rows; input columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .textcore import U64, Words, mix64, text_buffers

LENGTH = 200
#: Bytes of a name's hash at first, and for names that too many segments share.
NAMES = (32, 116, 180, LENGTH)
#: A block of the index has about so many bytes.
BLOCK = 1 << 18
#: A name with more bytes of different segments is named again.
SHARED = 1 << 20
#: Texts are read in pieces of so many bytes (a piece's last windows reach into the next).
PIECE = 1 << 20


class Bytes(Words):
    """Byte spans of a piece, to hash."""

    def __init__(self, data: np.ndarray):
        self.data = data


def byte_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary column, whose entries may cut characters."""
    return text_buffers(column.cast(pa.large_binary()).view(pa.large_string()))


def _names(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k >= 8 bytes from each place on (none for the last k - 1)."""
    out = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), 0, (1,)) * U64(0x9FB21C651E98DF25)
    held = 8
    while held < k:
        step = min(held, k - held)
        out = mix64(out[:-step] * U64(0xD6E8FEB86659FD93) + (out[step:] ^ U64(held)))
        held += step
    return out


def _sliding(x: np.ndarray, w: int, least: bool = True) -> np.ndarray:
    """The least (or greatest) of each w successive values."""
    if w == 1:
        return x
    pick, fill = (np.minimum, ~U64(0)) if least else (np.maximum, U64(0))
    pad = np.full(-len(x) % w, fill, U64)
    grid = np.concatenate([x, pad]).reshape(-1, w)
    ahead = pick.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    behind = pick.accumulate(grid, 1).ravel()
    return pick(ahead[: len(x) - w + 1], behind[w - 1 : len(x)])


def segments(data: np.ndarray, offsets: np.ndarray, k: int, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(name, begin, end, twice) of the segments of some texts: `twice` where the name's k bytes
    stand more than once in the segment, which may then hold a window twice."""
    none = np.empty(0, np.int64)
    size = np.diff(offsets)
    if not (size >= length).any():
        return none.astype(U64), none, none, none.astype(bool)
    w = length - k + 1
    hashed = _names(data, k)
    least = _sliding(hashed, w)  # of the window that starts at each place
    turn = np.zeros(len(least) + 1, np.int64)
    long = size >= length
    turn[offsets[:-1][long]] += 1
    np.add.at(turn, np.minimum(offsets[1:][long] - length + 1, len(least)), -1)
    valid = np.cumsum(turn[:-1]) > 0
    begins = valid.copy()
    begins[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    ends = valid.copy()
    ends[:-1] &= ~valid[1:] | (least[1:] != least[:-1])
    begin, last = np.flatnonzero(begins), np.flatnonzero(ends)
    name = least[begin]
    if w == 1:
        return name, begin, last + length, last > begin
    # places whose hash is the least of some window: about two in w
    low = least.copy()
    low[~valid] = 0
    wide = np.concatenate([np.zeros(w - 1, U64), low, np.zeros(len(hashed) - len(low), U64)])
    spots = np.flatnonzero(_sliding(wide, w, False) == hashed)
    first, until = np.searchsorted(spots, begin), np.searchsorted(spots, last + w)
    many = until - first
    own = np.repeat(np.arange(len(begin)), many)
    spot = spots[np.arange(len(own)) - np.repeat(np.cumsum(many) - many - first, many)]
    times = np.bincount(own[hashed[spot] == name[own]], minlength=len(begin))
    return name, begin, last + length, times > 1


def _pieces(rows: np.ndarray, raw: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets, base) in pieces of about PIECE bytes: `base` is what to add to a
    place of a row. Longer rows are cut with an overlap that keeps every window in one piece."""
    n, at = len(rows), 0
    while at < n:
        to = min(n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, "right")) - 1))
        if to == at + 1 and offsets[to] - offsets[at] > PIECE:
            for cut in range(int(offsets[at]), max(int(offsets[to]) - length + 1, int(offsets[at]) + 1), PIECE):
                until = min(cut + PIECE + length - 1, int(offsets[to]))
                yield rows[at:to], raw[cut:until], np.array([0, until - cut]), np.array([cut - offsets[at]])
        else:
            yield rows[at:to], raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], np.zeros(to - at, np.int64)
        at = to


def _emit(k: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = byte_buffers(batch.column(1))
            for rows, data, own, base in _pieces(batch.column(0).to_numpy(), raw, offsets, length):
                name, begin, end, twice = segments(data, own, k, length)
                digest = Bytes(data).hash_spans(begin, end)
                doc = np.searchsorted(own, begin, "right") - 1
                columns = [name.view(np.int64), digest.view(np.int64), rows[doc], begin - own[doc] + base[doc], end - begin, twice]
                yield pa.record_batch([pa.array(x) for x in columns], ["name", "digest", "row", "begin", "size", "twice"])

    return run


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the chosen segments of each row."""
    for batch in batches:
        text, chosen = batch.column(0), batch.column(1)
        flat, counts = chosen.flatten(), np.diff(chosen.offsets.to_numpy())
        begin, size = flat.field("begin").to_numpy(), flat.field("size").to_numpy()
        own = np.repeat(np.arange(len(counts)), counts)
        raw, offsets = byte_buffers(text)
        data, start = memoryview(raw), offsets[own] + begin
        parts = [bytes(data[a:b]) for a, b in zip(start.tolist(), (start + size).tolist())]
        yield pa.record_batch([flat.field("name"), flat.field("digest"), flat.field("copies"), pa.array(parts, pa.binary())], ["name", "digest", "copies", "bytes"])


def suffixes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The suffix array of segments, each with a wall of its own behind it, walls before bytes and
    in the order of segments: seven bytes at once, then prefix doubling that sorts only what is
    still tied."""
    parts = len(offsets) - 1
    n = len(data) + parts
    of = np.repeat(np.arange(parts), np.diff(offsets))
    place = np.arange(len(data)) + of
    left = np.minimum(offsets[of + 1] - np.arange(len(data)), 7)
    lanes = np.ndarray((len(data),), ">u8", np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,)).astype(U64)
    drop = U64(64) - left.astype(U64) * U64(8)
    key = np.zeros(n, U64)
    key[place] = (lanes >> drop << drop) | left.astype(U64)
    ends = np.ones(n, bool)  # a wall is among the first seven symbols
    ends[place] = left < 7
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    new = ends[order]
    new[1:] |= (ranked[1:] != ranked[:-1]) | new[:-1]
    new[0] = True
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    tied, h = np.arange(n), 7
    while True:
        alone = new[tied] & np.concatenate([new, [True]])[tied + 1]
        tied = tied[~alone]
        if not len(tied):
            return order
        at = order[tied]
        key = (rank[at] << 32) | rank[at + h]  # a tied suffix has no wall among its first h symbols
        by = np.argsort(key)
        order[tied], key = at[by], key[by]
        new[tied] = np.concatenate([[True], key[1:] != key[:-1]])
        rank[order[tied]] = np.maximum.accumulate(np.where(new[tied], tied, 0))
        h *= 2


def agreed(data: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """For how many bytes, up to `most`, what stands at a and at b agrees."""
    lanes = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))
    out, open_, done = most.copy(), np.arange(len(a)), 0
    while len(open_):
        open_ = open_[most[open_] > done]
        differ = lanes[a[open_] + done] ^ lanes[b[open_] + done]
        low = differ & (~differ + U64(1))
        end = differ != 0
        # the lowest set bit tells the first byte that differs
        out[open_[end]] = np.minimum(most[open_[end]], done + (np.log2(low[end].astype(np.float64)).astype(np.int64) >> 3))
        open_ = open_[~end]
        done += 8
        if done >= 1 << 16 and len(open_) < 256:  # a few very long ones
            view = memoryview(data)
            for i in open_.tolist():
                x, y, low_, high = int(a[i]), int(b[i]), done, int(most[i])
                while low_ < high:
                    middle = (low_ + high + 1) >> 1
                    low_, high = (middle, high) if view[x + low_ : x + middle] == view[y + low_ : y + middle] else (low_, middle - 1)
                out[i] = low_
            break
    return out


class RunIndex:
    """The run-compressed transform of some segments: `symbol` and `length` of each run, and of
    its first and last row the text place and the length of the match with the row before or
    after it, which lies in another run."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        parts, size = len(offsets) - 1, np.diff(offsets)
        of = np.repeat(np.arange(parts), size)
        text = np.empty(len(data) + parts, np.int64)  # a wall of its own after each segment
        self.place = np.arange(len(data)) + of  # of each byte
        text[self.place] = data.astype(np.int64) + parts
        walls = offsets[1:] + np.arange(parts)
        text[walls] = np.arange(parts)
        order = suffixes(data, offsets)
        before = text[order - 1]
        head = np.ones(len(text), bool)
        head[1:] = before[1:] != before[:-1]
        heads = np.flatnonzero(head)
        self.symbol, self.length = before[heads], np.diff(np.append(heads, len(text)))
        self.first, self.last = order[heads], order[np.append(heads[1:], len(text)) - 1]
        # matches at the borders of runs: of the last row of one and the first of the next
        byte = np.zeros(len(text), np.int64)
        byte[self.place] = np.arange(len(data))
        left = np.zeros(len(text), np.int64)  # bytes from a place to the end of its segment
        left[self.place] = offsets[of + 1] - np.arange(len(data))
        x, y = self.last[:-1], self.first[1:]
        self.match = agreed(data, byte[x], byte[y], np.minimum(left[x], left[y]))
        self.size = len(text)

    def statistics(self) -> np.ndarray:
        """For each byte, how long its longest match elsewhere is."""
        none = np.zeros(1, np.int64)
        up = self._streamed(self.first, np.concatenate([none, self.match]))
        down = self._streamed(self.last, np.concatenate([self.match, none]))
        return np.maximum(up, down)[self.place]

    def _streamed(self, sample: np.ndarray, match: np.ndarray) -> np.ndarray:
        """Match lengths at all places from those at the sampled ones: one less at each place on."""
        end = np.full(self.size, -1, np.int64)  # where the match from a sampled place ends
        end[sample] = np.arange(len(sample))
        at = np.arange(self.size)
        near = np.maximum.accumulate(np.where(end >= 0, at, 0))
        return match[end[near]] - (at - near)


def repeated(parts: list[bytes], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """Spans of each segment that strings of `length` bytes cover which start more than once in
    the segments."""
    data = np.frombuffer(b"".join(parts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    long = np.flatnonzero(RunIndex(data, offsets).statistics() >= length)
    out: list[list[tuple[int, int]]] = [[] for _ in parts]
    if len(long):
        of = np.searchsorted(offsets, long, "right") - 1
        edge = np.flatnonzero(np.concatenate([[True], (long[1:] > long[:-1] + length) | (of[1:] != of[:-1])]))
        last = np.append(edge[1:], len(long)) - 1
        for i, a, b in zip(of[edge].tolist(), (long[edge] - offsets[of[edge]]).tolist(), (long[last] - offsets[of[edge]] + length).tolist()):
            out[i].append((a, b))
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _index(length: int):
    """Blocks of the index from segments in the order of their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush():
            names, digests, parts = zip(*held)
            found = [(n, d, s) for n, d, s in zip(names, digests, repeated(list(parts), length)) if s]
            columns = zip(*found) if found else ([], [], [])
            spans = lambda x: [[{"start": a, "end": b} for a, b in s] for s in x]
            a, b, c = columns
            return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(spans(c), _SPANS)], ["name", "digest", "spans"])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if size >= BLOCK and row[0] != held[-1][0]:
                    yield flush()
                    held, size = [], 0
                held.append(row)
                size += len(row[2])
        if held:
            yield flush()

    return run


def joined(marked: DataFrame) -> DataFrame:
    """row, start, end of marks that overlap or touch, put together."""
    by = Window.partitionBy("row").orderBy("start", "end")
    far = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    begins = marked.withColumn("begins", F.when(far.isNull() | (F.col("start") > far), 1).otherwise(0))
    nth = F.sum("begins").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return begins.withColumn("nth", nth).groupBy("row", "nth").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("nth")


def marks(texts: DataFrame, level: int = 0, length: int = LENGTH, names: tuple[int, ...] = NAMES, shared: int | None = None) -> DataFrame:
    """row, start, end of stretches that cover all windows of texts (row, bytes) which start more
    than once. A written table; stretches may overlap."""
    shared, spark = SHARED if shared is None else shared, texts.sparkSession
    final = level == len(names) - 1
    kind = "name long, digest long, row long, begin long, size long, twice boolean"
    found, at_found = common.written_at(texts.mapInArrow(_emit(names[level], length), kind), "segments")
    facts = found.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("digest").alias("low"), F.max("digest").alias("high"), F.max("twice").alias("again"))
    # under the last names equal names are equal windows
    equal = F.lit(True) if final else F.col("low") == F.col("high")
    whole = equal & ((F.col("n") > 1) | F.lit(final))
    facts = common.written(facts.where("n > 1 or again").select("name", whole.alias("whole")), "names")
    kept, at_kept = common.written_at(found.join(common.small(facts), "name").drop("twice"), "kept")
    common.remove(spark, at_found)
    out = kept.where("whole").select("row", F.col("begin").alias("start"), (F.col("begin") + F.col("size")).alias("end"))
    mixed = kept.where("not whole")
    if not final and not mixed.isEmpty():
        one = mixed.groupBy("name", "digest").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("row", "begin", "size")).alias("one"))
        one = common.written(one.select("name", "digest", "copies", "one.*"), "distinct")
        hot = common.written(one.groupBy("name").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > shared).select("name"), "hot-names")
        chosen = one.groupBy("row").agg(F.collect_list(F.struct("name", "digest", "copies", "begin", "size")).alias("chosen"))
        fetched = texts.join(common.small(chosen), "row").select("bytes", "chosen").mapInArrow(_fetch, "name long, digest long, copies long, bytes binary")
        fetched, at_fetched = common.written_at(fetched, "fetched")
        few = fetched.join(common.small(hot), "name", "left_anti").select("name", "digest", "bytes")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        spans = few.repartition(parts, "name").sortWithinPartitions("name").mapInArrow(_index(length), "name long, digest long, spans array<struct<start:long,end:long>>")
        spans = spans.select("name", "digest", F.inline("spans"))
        if not hot.isEmpty():
            many = fetched.join(common.small(hot), "name").withColumn("row", F.monotonically_increasing_id())
            many = common.written(many, "hot-segments")
            again = joined(marks(many.select("row", "bytes"), level + 1, length, names, shared))
            spans = spans.unionByName(again.join(many, "row").select("name", "digest", "start", "end"))
        # a segment with copies repeats whole, whatever else matches it
        copied = one.where("copies > 1").select("name", "digest", F.lit(0).cast("long").alias("start"), F.col("size").alias("end"))
        single = one.where("copies = 1").select("name", "digest")
        spans = common.written(spans.join(single, ["name", "digest"], "left_semi").unionByName(copied), "spans")
        placed = mixed.join(common.small(spans), ["name", "digest"])
        out = out.unionByName(placed.select("row", (F.col("begin") + F.col("start")).alias("start"), (F.col("begin") + F.col("end")).alias("end")))
        out = common.written(out, "marks")
        common.remove(spark, at_fetched)
    else:
        out = common.written(out, "marks")
    common.remove(spark, at_kept)
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join each row's marks into spans and take them out."""
    for batch in batches:
        texts, marked = batch.column(1), batch.column(2)
        n_bytes, spans, kept = [], [], []
        for text, found in zip(texts, marked):
            raw, found = text.as_buffer(), found.values
            raw = memoryview(raw) if raw is not None else b""
            n_bytes.append(len(raw))
            joined, left, at = [], [], 0
            if found is not None and len(found):
                start, end = found.field("start").to_numpy(), found.field("end").to_numpy()
                by = np.argsort(start, kind="stable")
                start, far = start[by], np.maximum.accumulate(end[by])
                edge = np.flatnonzero(np.concatenate([[True], start[1:] > far[:-1]]))
                for a, b in zip(start[edge].tolist(), far[np.append(edge[1:], len(start)) - 1].tolist()):
                    joined.append({"start": a, "end": b})
                    left.append(raw[at:a])
                    at = b
            left.append(raw[at:])
            spans.append(joined)
            kept.append(b"".join(left))
        yield pa.record_batch([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(spans, _SPANS), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])


def drop_repeats(docs: DataFrame, length: int = LENGTH, names: tuple[int, ...] | None = None) -> DataFrame:
    """doc_id, n_bytes, spans (start, end of what is removed, in bytes) and kept (the other
    bytes) of every row."""
    names = names or (*(k for k in NAMES if k < length), length)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    common.bound_batches(docs.sparkSession)
    # row numbers must not change when a stage is run again
    texts, at_texts = common.written_at(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text.alias("bytes")), "texts")
    found = marks(texts.select("row", "bytes"), 0, length, names).groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("marks"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = texts.join(found, "row", "left").select("doc_id", "bytes", "marks")
    return out.mapInArrow(_cut, f"doc_id {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
