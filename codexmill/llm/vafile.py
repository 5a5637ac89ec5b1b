"""Exact top-k search by vector-approximation files.

Vectors become integer rows floor(scale * x). The file is written once, in segments: the exact
rows, and beside them their cells, one byte for each component. A segment cuts each dimension
between its least and greatest value into at most 256 equal cells.

Queries are searched in blocks. A block first scans the cells of all segments: with c the least
corner of a row's cell and w the cells' widths, the inner product with q lies between q*c + the
sum of q*(w-1) over q's negative parts and q*c + the same over its positive parts. The kth best
lower bound over all segments read so far rules rows out; after the scan it is that over all
rows. Exact rows are then read from the file, those of the highest upper bounds first, until the
kth exact score is above every bound that is left.

A block of queries reads cells, not vectors, of all rows, and returns k rows for each query, so
neither shuffles nor results grow faster than rows and queries. Segments and blocks bound what a
task holds. The file lies in the shared folder and is mapped into memory.

Defined results: null vectors, and those with a null or non-finite component, without components
or with one whose integer does not fit 64 bits, take no part; scores need vectors of equal length, so vectors of another length are
no candidates; rows of a null vec_id take no part, as nothing can name them; rows that repeat a
vec_id are rows of their own, so each is a candidate for the others, and each that is a query is
answered; ties go to the smaller vec_id; a query without candidates gives no rows; extra columns are
ignored. Ranks are by exact scores at any size; a score that does not fit 64 bits is null.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Rows of a segment, queries searched together, rows whose bounds are computed at once.
SEGMENT, QUERIES, STEP = 65_536, 256, 8192
CELLS = 256
_LONG = 1 << 63


def whole(vectors: pa.Array, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, integer rows) of the vectors that take part, for each length that occurs."""
    size = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(size)])
    flat = pc.list_flatten(vectors).cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null becomes NaN
    with np.errstate(over="ignore", invalid="ignore"):
        cells = np.floor(flat * scale)
        bad = np.concatenate([[0], np.cumsum(~(np.abs(cells) < _LONG))])
    good = (size > 0) & (bad[first[1:]] == bad[first[:-1]])
    for dim in np.unique(size[good]):
        at = np.flatnonzero(good & (size == dim))
        yield at, cells[first[at][:, None] + np.arange(dim)].astype(np.int64)


def _most(x: np.ndarray) -> int:
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


def product(a: np.ndarray, b: np.ndarray, room: int = 1) -> np.ndarray:
    """Exact inner products of all rows of a with all of b, in the fastest arithmetic that is
    exact for them and for the sum of `room` of them: floating point, 64-bit or unbounded
    integers."""
    bound = _most(a) * _most(b) * a.shape[1] * room
    if a.dtype != object and bound < 1 << 53:
        kind = np.float32 if bound < 1 << 24 else np.float64
        return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)
    if a.dtype != object and bound < _LONG:
        return a @ b.astype(np.int64).T
    return a.astype(object) @ b.astype(object).T


class Segment:
    """Some rows of one length: ids, exact rows, cells, and the cells' least values and widths."""

    def __init__(self, path: str):
        load = lambda name: np.load(f"{path}/{name}.npy", mmap_mode="r")
        self.path, self.ids, self.rows, self.cells, self.base, self.width, self.asked = path, *map(load, ("ids", "rows", "cells", "base", "width", "asked"))

    @staticmethod
    def write(path: str, ids: np.ndarray, rows: np.ndarray, asked: np.ndarray) -> None:
        """All files of the segment, then its name: a repeated task writes another one."""
        part = f"{path}.part"
        os.makedirs(part)
        base = rows.min(0)
        width = np.array([-(-(int(t) - int(b) + 1) // CELLS) for t, b in zip(rows.max(0), base)], np.int64)
        cells = ((rows.view(np.uint64) - base.view(np.uint64)) // width.astype(np.uint64)).astype(np.uint8)  # differences modulo 2**64 are right
        for name, x in (("ids", ids), ("rows", rows), ("cells", cells), ("base", base), ("width", width), ("asked", asked)):
            np.save(f"{part}/{name}.npy", x)
        os.rename(part, path)


@lru_cache(maxsize=512)
def _segment(path: str) -> Segment:
    return Segment(path)


def _write(folder: str, scale: int):
    """Rows (vec_id, embedding, whether a query) to segments: path, dim, n, queries of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def flush(dim: int) -> pa.RecordBatch:
            ids, asked, rows = (np.concatenate(x) for x in zip(*held.pop(dim)))
            path = f"{folder}/{uuid.uuid4().hex}"
            Segment.write(path, ids, rows, asked)
            return pa.record_batch([pa.array([path]), pa.array([dim], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([int(asked.sum())], pa.int64())], ["path", "dim", "n", "queries"])

        for batch in batches:
            ids, asked = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 2))
            for at, rows in whole(batch.column(1), scale):
                dim = rows.shape[1]
                held.setdefault(dim, []).append((ids[at].astype(np.int64), asked[at].astype(bool), rows))
                if sum(len(x[0]) for x in held[dim]) >= SEGMENT:
                    yield flush(dim)
        for dim in list(held):
            yield flush(dim)

    return run


def search(queries: np.ndarray, own: tuple[str, np.ndarray], segments: list[Segment], k: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(number of the query, [(vec_id, score), ...]) of the k best rows for each query; `own`
    names the segment and places that the queries come from."""
    q = len(queries)
    reach = max((max(_most(s.base), _most(s.base.astype(object) + s.width.astype(object) * CELLS)) for s in segments), default=0)
    wide = _most(queries) * reach * queries.shape[1] * 4 >= _LONG  # sums of bounds need more than 64 bits
    queries = queries.astype(object) if wide else queries
    never = -(1 << 200) if wide else np.iinfo(np.int64).min
    up, down, each = np.maximum(queries, 0), np.minimum(queries, 0), np.arange(q)
    low = np.empty((q, 0), queries.dtype)  # the k best lower bounds of each query
    floor = np.full(q, never, queries.dtype)  # the kth of them
    left: list[tuple[np.ndarray, int, np.ndarray, np.ndarray]] = []  # (query, segment, place, upper bound)
    for s, seg in enumerate(segments):
        shift, slack = product(queries, seg.base[None, :]), (seg.width - 1)[None, :]
        scaled, under, over = queries * seg.width, shift + product(down, slack), shift + product(up, slack)
        for a in range(0, len(seg.ids), STEP):
            corner = product(scaled, seg.cells[a : a + STEP])
            bottom, top = corner + under, corner + over
            if seg.path == own[0]:
                here = (own[1] >= a) & (own[1] < a + corner.shape[1])
                bottom[each[here], own[1][here] - a] = top[each[here], own[1][here] - a] = never
            low = np.concatenate([low, bottom], 1)
            if low.shape[1] >= k:
                low = np.sort(low, 1)[:, -k:] if wide else np.partition(low, low.shape[1] - k, 1)[:, low.shape[1] - k :]
                floor = low.min(1)
            at, place = np.nonzero((top >= floor[:, None]) & (top > never))
            left.append((at, s, place + a, top[at, place]))
    if not left:
        return
    of, place, top = np.concatenate([np.full(len(x[0]), x[1]) for x in left]), np.concatenate([x[2] for x in left]), np.concatenate([x[3] for x in left])
    query = np.concatenate([x[0] for x in left])
    keep = np.flatnonzero(top >= floor[query])  # the bound is now that over all rows
    keep = keep[np.lexsort((-top[keep], query[keep]))]
    query, of, place, top = query[keep], of[keep], place[keep], top[keep]
    cut = np.searchsorted(query, np.arange(q + 1))
    for i in range(q):
        found: list[tuple[int, int]] = []  # (-score, vec_id), the k best
        for a in range(cut[i], cut[i + 1], 2 * k):
            if len(found) >= k and -found[k - 1][0] > top[a]:
                break  # no bound that is left reaches the kth score
            z = min(a + 2 * k, cut[i + 1])
            for s in np.unique(of[a:z]):
                at = place[a:z][of[a:z] == s]
                found += zip((-product(queries[i : i + 1], np.asarray(segments[s].rows[at]))[0]).tolist(), segments[s].ids[at].tolist())
            found = sorted(found)[:k]
        yield i, [(vec_id, -x) for x, vec_id in found]


def _search(manifest, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, dim, first in zip(*(batch.column(c).to_pylist() for c in range(3))):
                mine = _segment(path)
                at = np.flatnonzero(mine.asked)[first : first + QUERIES]
                segments = [_segment(p) for p in manifest.value[dim]]
                out = [(int(mine.ids[at[i]]), rank, vec_id, score) for i, best in search(np.asarray(mine.rows[at]), (path, at), segments, k) for rank, (vec_id, score) in enumerate(best, 1)]
                query, rank, vec, score = zip(*out) if out else ((),) * 4
                score = [x if -_LONG <= x < _LONG else None for x in score]
                yield pa.record_batch([pa.array(query, pa.int64()), pa.array(rank, pa.int32()), pa.array(vec, pa.int64()), pa.array(score, pa.int64())], ["query_id", "rank", "vec_id", "score"])

    return run


def build(vectors: DataFrame, is_query: Column, scale: int = 64, folder: str | None = None) -> DataFrame:
    """Write the file below `folder` (one that all nodes mount; by default a new one in the
    shared folder): path, dim, n and queries of each segment."""
    folder = folder or common.mounted(common.shared_path(vectors.sparkSession, "vectors"))
    os.makedirs(folder, exist_ok=True)
    rows = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.coalesce(is_query, F.lit(False)).alias("asked"))
    return common.written(rows.mapInArrow(_write(folder, scale), "path string, dim int, n long, queries long"), "segments")


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, folder: str | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for every row that `is_query` (a condition on vec_id)
    picks, the k rows of highest inner product, its own row left out."""
    spark = vectors.sparkSession
    segments = build(vectors, is_query, scale, folder)
    names: dict[int, list[str]] = {}
    for r in segments.select("path", "dim").orderBy("path").toLocalIterator():  # a row per SEGMENT vectors
        names.setdefault(r["dim"], []).append(r["path"])
    manifest = spark.sparkContext.broadcast(names)
    # a row for each block of queries
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("queries") - 1, F.lit(QUERIES).cast("long")))
    blocks = segments.where("queries > 0").select("path", "dim", first.alias("first"))
    tasks = max(1, int(segments.agg(F.sum(F.ceil(F.col("queries") / QUERIES))).first()[0] or 0))
    blocks = blocks.repartition(min(tasks, 4096), "path", "first")
    return blocks.mapInArrow(_search(manifest, k), "query_id long, rank int, vec_id long, score long")
