"""LM scoring: an interpolated modified Kneser-Ney n-gram model.

Words: map tasks fold the words of their rows and send one block per shard (a range of hashes);
a shard becomes a sorted array of hashes with counts. A word's number follows from its shard and
its rank by count there, so frequent words have small numbers.

Counting: map tasks write n-grams as word numbers, fold them and send one packed block per shard,
a range of context hashes, so one task sees all n-grams of its contexts and a frequent n-gram
costs one entry per map task. The reducer of one order sends on the counts of the order below.

Storing: each shard becomes sorted arrays of n-gram and context hashes with counts in the shared
folder. A shard's arrays keep the next bits of the hashes: buckets of about eight keys by the
first of them, 24 bits in three bytes for each key, so an absent n-gram is taken for a present
one about once in two million look-ups. Where there are more than 2**6 shards, the files of
neighbours are put together to so many, so that a look-up of a batch opens and searches a number
of files that does not grow with the corpus. Scoring: workers map the arrays into memory and
search the buckets of sorted batches of keys.

Every order below the highest counts distinct preceding words (continuation counts); the
lowest interpolates with the uniform distribution over the vocabulary and one unknown word.

Defined results: a null or empty text is just its end token; repeated rows are counted as
often as they occur; an empty training set scores every token as the uniform distribution;
extra columns are ignored.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .textcore import U64, Words, argsort64, crc_mod, mix64, text_slices, unique_inverse

END = U64(0x243F6A8885A308D3)
#: Word numbers that no word of the vocabulary has.
BEGIN, UNKNOWN, FIRST = 0, 1, 2
#: A shard holds the n-grams of about so many bytes of text; there are at least 2**6 shards and
#: at most 2**22 (32 TB of text, beyond which shards grow).
SHARD_TEXT, LEAST_BITS, MOST_BITS = 8 << 20, 6, 22
#: Stored tables lie in at most 2**JOIN files each, whatever the number of shards.
JOIN = 6
#: Bits of a key beside those of its shard and bucket.
PRINT = 24
#: A map task folds its n-grams after so many tokens.
FOLD_TOKENS = 900_000
BLOCK = "kind int, shard int, block binary"
STATS = "kind int, entries long, total long, n1 long, n2 long, n3 long, n4 long"
#: Layers of a table of counts: all ones, those below 256, the rest.
LAYERS = ("a", "b", "c")


def tokens(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, first) of all tokens: the words of each row, then one end."""
    count = words.count + 1
    first = np.zeros(words.rows + 1, np.int64)
    np.cumsum(count, out=first[1:])
    out = np.empty(first[-1], U64)
    ends = first[1:] - 1
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner] = words.hash
    out[ends] = END
    return out, np.repeat(np.arange(words.rows), count), first


def before(numbers: np.ndarray, rows: np.ndarray, first: np.ndarray, order: int) -> list[np.ndarray]:
    """[the word one back, two back, ...] of each token, up to order - 1."""
    out, place = [], np.arange(len(numbers)) - first[:-1][rows]
    for back in range(1, order):
        word = np.full(len(numbers), BEGIN, numbers.dtype)
        has = place >= back
        word[has] = numbers[np.flatnonzero(has) - back]
        out.append(word)
    return out


def chain(words: list[np.ndarray]) -> list[np.ndarray]:
    """[length-1 contexts, length-2 contexts, ...] of the words one back, two back, ..."""
    out, ctx = [], U64(0)
    for word in words:
        with np.errstate(over="ignore"):
            ctx = mix64(ctx * U64(0x9E3779B97F4A7C15) + word.astype(U64) + U64(1))
        out.append(ctx)
    return out


def gram_key(ctx: np.ndarray, word: np.ndarray, bits: int) -> np.ndarray:
    """The shard of the context in the first bits, then a hash of context and word."""
    with np.errstate(over="ignore"):
        mixed = mix64(ctx * U64(0xD1342543DE82EF95) + word.astype(U64))
    return (ctx >> U64(64 - bits) << U64(64 - bits)) | (mixed >> U64(bits))


def narrow(a: np.ndarray) -> np.ndarray:
    """The same numbers (none below 0) in the narrowest type that holds them all."""
    return a.astype(np.min_scalar_type(int(a.max(initial=0))))


def _edges(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    return np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]) if len(sorted_keys) else np.empty(0, np.int64)


def parts(sorted_keys: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """The shards that sorted keys fall into, and where."""
    shard = sorted_keys >> U64(64 - bits)
    edge = _edges(shard)
    for a, z in zip(edge.tolist(), [*edge[1:].tolist(), len(shard)]):
        yield int(shard[a]), slice(a, z)


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns of unsigned numbers as planes of bytes, compressed; the first, in ascending order,
    as differences."""
    held = [narrow(np.diff(columns[0], prepend=columns[0].dtype.type(0))), *map(narrow, columns[1:])]
    body = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1).T).tobytes() for c in held)
    head = np.array([len(columns[0]), len(held), *(c.itemsize for c in held)], np.int64)
    return head.tobytes() + pa.compress(body, codec="zstd", asbytes=True)


def unpack(block: bytes) -> list[np.ndarray]:
    n, width = (int(x) for x in np.frombuffer(block, np.int64, 2))
    sizes = np.frombuffer(block, np.int64, width, 16).tolist()
    body = pa.decompress(block[16 + 8 * width :], n * sum(sizes), codec="zstd", asbytes=True)
    out, at = [], 0
    for size in sizes:
        planes = np.frombuffer(body, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(f"u{size}").ravel().astype(U64))
        at += n * size
    with np.errstate(over="ignore"):
        out[0] = np.cumsum(out[0], dtype=U64)
    return out


def pack_grams(ids: list[np.ndarray], counts: np.ndarray) -> bytes:
    """n-grams of one shard in the order of the oldest word, then of the one after it."""
    oldest, *rest = ids[::-1]
    at = argsort64(oldest << U64(32) | rest[0] & U64(0xFFFFFFFF)) if rest and int(oldest.max(initial=0)) < 1 << 32 else argsort64(oldest)
    return pack([oldest[at], *(x[at] for x in rest), counts[at].astype(U64)])


def unpack_grams(block: bytes) -> list[np.ndarray]:
    """[word, the word one back, ..., counts]"""
    *ids, counts = unpack(block)
    return [*ids[::-1], counts.astype(np.int64)]


def fold(ids: list[np.ndarray], counts: np.ndarray, bits: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """(sorted keys, their n-grams' words, contexts, summed counts) of distinct n-grams."""
    ctx = chain(ids[1:])[-1] if len(ids) > 1 else ids[0] << U64(64 - bits)
    key = gram_key(ctx, ids[0], bits)
    at = argsort64(key)
    edge = _edges(key[at])
    first = at[edge]
    return key[first], [x[first] for x in ids], ctx[first], np.add.reduceat(counts[at], edge) if len(edge) else counts


def blocks(kind: int, key: np.ndarray, ids: list[np.ndarray], counts: np.ndarray, bits: int) -> Iterator[tuple[int, int, bytes]]:
    """Folded n-grams cut into one block per shard."""
    for s, part in parts(key, bits):
        yield kind, s, pack_grams([x[part] for x in ids], counts[part])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kind, shard, block = zip(*rows) if rows else ((), (), ())
    return pa.record_batch([pa.array(kind, pa.int32()), pa.array(shard, pa.int32()), pa.array(block, pa.binary())], ["kind", "shard", "block"])


def _save(path: str, arrays: list[np.ndarray | list[np.ndarray]]) -> None:
    """Arrays in one file, whole or not at all: a repeated task writes the same file again. A list
    of arrays is written as one, in the widest of their types, piece by piece."""
    part = f"{path}.{uuid.uuid4().hex}"
    pieces = [a if isinstance(a, list) else [a] for a in arrays]
    kinds = [max((x.dtype for x in a), key=lambda t: t.itemsize) for a in pieces]
    with open(part, "wb") as f:
        f.write(np.array([len(pieces), *(x for a, kind in zip(pieces, kinds) for x in (kind.itemsize, sum(map(len, a))))], np.int64).tobytes())
        for a, kind in zip(pieces, kinds):
            for x in a:
                f.write(x.astype(kind, copy=False).tobytes())
            f.write(bytes(-kind.itemsize * sum(map(len, a)) % 8))
    os.replace(part, path)


@lru_cache(maxsize=8192)
def _open(path: str) -> list[np.ndarray] | None:
    """The arrays of a file, mapped into memory; None where there is no such file."""
    if not os.path.exists(path):
        return None
    raw = np.memmap(path, np.uint8, "r")
    n = int(raw[:8].view(np.int64)[0])
    head = raw[8 : 8 + 16 * n].view(np.int64)
    out, at = [], 8 + 16 * n
    for size, length in zip(head[::2].tolist(), head[1::2].tolist()):
        out.append(raw[at : at + size * length].view(f"u{size}"))
        at += -(-size * length // 8) * 8
    return out


def store(folder: str, name: str, shard: int, bits: int, key: np.ndarray, columns: list[np.ndarray]) -> None:
    """A table of one shard: sorted keys with columns of counts, the first of which is the
    largest, in layers."""
    most = columns[0]
    for layer, take in zip(LAYERS, (most == 1, (most > 1) & (most < 256), most > 255)):
        some = key[take]
        if not len(some):
            continue
        spare = max(0, (len(some) >> 3).bit_length() - 1)
        rest = some << U64(bits) >> U64(64 - PRINT - spare)
        ends = np.searchsorted(rest >> U64(PRINT), np.arange((1 << spare) + 1).astype(U64)).astype(np.uint32)
        values = [] if layer == LAYERS[0] else [narrow(c[take]) for c in columns]
        _save(f"{folder}/{name}{layer}-{shard:07d}", [ends, rest.astype(np.uint16), (rest >> U64(16)).astype(np.uint8), *values])


def _file(model: Model, name: str, number: int) -> str:
    """The file of one shard's table, or of neighbouring ones put together."""
    return f"{model.folder}/{name}{'~' if model.join < model.bits else '-'}{number:07d}"


def _put_together(folder: str, names: list[str], bits: int, join: int):
    """For each number of 2**join, one file of the tables of its shards: where the buckets of each
    shard begin and how many bits name one, then the arrays of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column(0).to_pylist():
                shards = range(number << bits - join, number + 1 << bits - join)
                for name in names:
                    path = f"{folder}/{name}~{number:07d}"
                    held = [] if os.path.exists(path) else [_open.__wrapped__(f"{folder}/{name}-{s:07d}") for s in shards]
                    some = [x for x in held if x is not None]
                    if some and name == "w":
                        _save(path, [list(x) for x in zip(*some)])
                    elif some:
                        begin, spare, ends, rows = [], [], [], 0
                        at = 0
                        for x in held:
                            own = x[0].astype(np.uint64) + U64(rows) if x is not None else np.full(2, rows, U64)
                            begin.append(at)
                            spare.append((len(own) - 1).bit_length() - 1)
                            ends.append(own)
                            at, rows = at + len(own), rows + (len(x[1]) if x is not None else 0)
                        _save(path, [np.array(begin, np.uint64), np.array(spare, np.uint8), narrow(np.concatenate(ends)), *(list(x) for x in zip(*(x[1:] for x in some)))])
            yield batch

    return run


def _search(arrays: list[np.ndarray], query: np.ndarray, bits: int, join: int) -> tuple[np.ndarray, np.ndarray]:
    """(which queries are found, where) in one layer."""
    if join < bits:
        begin, spares, ends, low, high = arrays[:5]
        shard = (query >> U64(64 - bits) & U64((1 << bits - join) - 1)).astype(np.int64)
        rest = query << U64(bits) >> (U64(64 - PRINT) - spares[shard].astype(U64))
        bucket = (rest >> U64(PRINT)).astype(np.int64) + begin[shard].astype(np.int64)
    else:
        ends, low, high = arrays[:3]
        rest = query << U64(bits) >> U64(64 - PRINT - ((len(ends) - 1).bit_length() - 1))
        bucket = (rest >> U64(PRINT)).astype(np.int64)
    want = (rest & U64((1 << PRINT) - 1)).astype(np.int32)
    a, stop = ends[bucket].astype(np.int64), ends[bucket + 1].astype(np.int64)
    left, last = stop - a, len(low) - 1
    for _ in range(int(left.max(initial=0)).bit_length()):
        half = left >> 1
        at = np.minimum(a + half, last)
        less = (left > 0) & ((low[at] | high[at].astype(np.int32) << 16) < want)
        a += np.where(less, half + 1, 0)
        left = np.where(less, left - half - 1, half)
    at = np.minimum(a, last)
    return np.flatnonzero((a < stop) & ((low[at] | high[at].astype(np.int32) << 16) == want)), at


def find(model: Model, name: str, query: np.ndarray, width: int) -> np.ndarray:
    """`width` columns of counts of each key; 0 where absent. Ones of the first layer stand in
    the first two columns."""
    unique, back = unique_inverse(query)
    out = np.zeros((len(unique), width), np.int64)
    for s, part in parts(unique, model.join):
        left = np.arange(part.start, part.stop)  # a key is in one layer only
        for layer in LAYERS:
            arrays = _open(_file(model, name + layer, s)) if len(left) else None
            if arrays is None:
                continue
            hit, at = _search(arrays, unique[left], model.bits, model.join)
            if layer == LAYERS[0]:
                out[left[hit], : min(2, width)] = 1
            else:
                for k, values in enumerate(arrays[5 if model.join < model.bits else 3 :]):
                    out[left[hit], k] = values[at[hit]]
            left = np.delete(left, hit)
    return out[back]


def vocabulary(model: Model, h: np.ndarray) -> np.ndarray:
    """(number, count, continuation count) of each word; (UNKNOWN, 0, 0) outside. Words are
    compared by all bits of their hashes."""
    unique, back = unique_inverse(h)
    out = np.zeros((len(unique), 3), np.int64)
    out[:, 0] = UNKNOWN
    for s, part in parts(unique, model.join):
        arrays = _open(_file(model, "w", s))
        if arrays is None:
            continue
        keys, counts, rank = arrays
        at = np.minimum(np.searchsorted(keys, unique[part]), len(keys) - 1)
        hit = np.flatnonzero(keys[at] == unique[part])
        place = rank[at[hit]].astype(np.int64)
        shard = (unique[part][hit] >> U64(64 - model.bits)).astype(np.int64)
        out[part.start + hit, 0] = FIRST + (place << model.bits) + shard
        out[part.start + hit, 1] = counts[at[hit]]
        lower = _open(_file(model, "l", s)) if model.stats else None
        if lower is not None:
            begin, after = lower
            out[part.start + hit, 2] = after[begin[shard & (1 << model.bits - model.join) - 1].astype(np.int64) + place]
    return out[back]


def _count_words(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush():
            every = np.sort(np.concatenate(held))
            edge = _edges(every)
            keys, counts = every[edge], np.diff(np.r_[edge, len(every)])
            return _batch([(0, s, pack([keys[part], counts[part].astype(U64)])) for s, part in parts(keys, bits)])

        for batch in batches:
            for _, _, raw, offsets in text_slices(batch.column(0)):
                held.append(tokens(Words(raw, offsets))[0])
                if sum(map(len, held)) >= FOLD_TOKENS:
                    yield flush()
                    held = []
        if held:
            yield flush()

    return run


def _vocabulary(folder: str):
    """One shard of words: hashes in order, counts, ranks by count."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        keys, counts = (np.concatenate(x) for x in zip(*map(unpack, pdf["block"])))
        at = argsort64(keys)
        edge = _edges(keys[at])
        own, n = keys[at][edge], np.add.reduceat(counts[at].astype(np.int64), edge)
        rank = np.empty(len(own), np.int64)
        rank[np.argsort(-n, kind="stable")] = np.arange(len(own))
        _save(f"{folder}/w-{int(key[0]):07d}", [own, narrow(n), narrow(rank)])
        return pd.DataFrame([(0, *_tally(n))], columns=["kind", "entries", "total", "n1", "n2", "n3", "n4"])

    return run


def _count_grams(model: Model):
    """Blocks of the n-grams of the highest order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0

        def flush():
            ids = [np.concatenate(x).astype(U64) for x in zip(*held)]
            key, ids, _, n = fold(ids, np.ones(len(ids[0]), np.int64), model.bits)
            return _batch([*blocks(model.order, key, ids, n, model.bits)])

        for batch in batches:
            for _, _, raw, offsets in text_slices(batch.column(0)):
                h, rows, first = tokens(Words(raw, offsets))
                numbers = vocabulary(model, h)[:, 0]
                held.append([numbers, *before(numbers, rows, first, model.order)])
                size += len(h)
                if size >= FOLD_TOKENS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def _tally(counts: np.ndarray) -> list[int]:
    few = np.bincount(np.minimum(counts, 5), minlength=6)
    return [len(counts), int(counts.sum()), *(int(x) for x in few[1:5])]


def _reduce(folder: str, bits: int, join: int):
    """One shard of one order >= 2: store its arrays; send on the continuation counts."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        kind, shard = int(key[0]), int(key[1])
        *ids, counts = [np.concatenate(x) for x in zip(*map(unpack_grams, pdf["block"]))]
        keys, ids, ctx, counts = fold(ids, counts, bits)
        store(folder, f"g{kind}", shard, bits, keys, [counts])
        at = argsort64(ctx)
        n, edge = counts[at], _edges(ctx[at])
        per = [np.add.reduceat(x.astype(np.int64), edge) for x in (n, n == 1, n == 2, n >= 3)]
        store(folder, f"c{kind}", shard, bits, ctx[at][edge], per)
        # without the oldest word; a single word goes to the file that its number names
        below = ids[:-1] if kind > 2 else [ids[0] - U64(FIRST)]
        low, below, _, n = fold(below, np.ones(len(counts), np.int64), bits)
        out = [(kind, -1, np.array(_tally(counts), np.int64).tobytes()), *blocks(kind - 1, low, below, n, bits if kind > 2 else join)]
        return pd.DataFrame(out, columns=["kind", "shard", "block"])

    return run


def _lowest(model: Model):
    """Continuation counts of one file of words: where each shard begins, counts by rank."""
    bits, join = model.bits, model.join

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        number = int(key[0])
        ids, counts = (np.concatenate(x) for x in zip(*map(unpack_grams, pdf["block"])))
        keys = _open(_file(model, "w", number))[0]
        own = 1 << bits - join
        begin = np.searchsorted(keys, (np.arange(own).astype(U64) + U64(number * own)) << U64(64 - bits))
        after = np.zeros(len(keys), np.int64)
        np.add.at(after, begin[(ids & U64(own - 1)).astype(np.int64)] + (ids >> U64(bits)).astype(np.int64), counts)
        _save(_file(model, "l", number), [begin.astype(np.uint64), narrow(after)])
        return pd.DataFrame([(1, *_tally(after[after > 0]))], columns=["kind", "entries", "total", "n1", "n2", "n3", "n4"])

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """[0, D1, D2, D3+] of modified Kneser-Ney; 0.5, 1 and 1.5 where too few counts exist."""
    out, spare = [0.0], (0.5, 1.0, 1.5)
    y = n1 / (n1 + 2 * n2) if n1 and n2 else None
    for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        d = k - (k + 1) * y * b / a if y and a and b else spare[k - 1]
        out.append(d if 0 < d <= k else spare[k - 1])
    return out


class Model:
    """What a worker needs: the folder of arrays, discounts and totals."""

    def __init__(self, folder: str, order: int, bits: int, stats: dict[int, list[int]], join: int | None = None):
        self.folder, self.order, self.bits, self.stats = folder, order, bits, stats
        self.join = bits if join is None else join  # bits that name a file
        self.words, self.total = stats.get(0, [0, 0])[:2]
        self.kinds = stats.get(1, [0, 0])[1]
        self.discount = {k: discounts(*v[2:]) for k, v in stats.items()}
        low = self.discount.get(1, [0.0] * 4)
        n, _, n1, n2, *_ = stats.get(1, [0] * 6)
        self.free = (low[1] * n1 + low[2] * n2 + low[3] * (n - n1 - n2)) / self.kinds if self.kinds else 1.0


def probability(model: Model, words: np.ndarray, ctx: list[np.ndarray]) -> np.ndarray:
    """Interpolated probability of each token, from its row of `vocabulary` and its contexts."""
    number, plain, lower = words.T
    uniform = 1.0 / (model.words + 1)
    p = np.full(len(words), uniform)
    if model.kinds:
        cut = np.array(model.discount[1])[np.minimum(lower, 3)]
        p = np.maximum(lower - cut, 0) / model.kinds + model.free * uniform
    elif model.order == 1 and model.total:
        p = (plain + 0.1) / (model.total + 0.1 * (model.words + 1))
    for k in range(2, model.order + 1):
        c = ctx[k - 2]
        seen = find(model, f"c{k}", c, 4)
        known = np.flatnonzero(seen[:, 0])  # an unseen context has no n-grams
        count = np.zeros(len(words), np.int64)
        count[known] = find(model, f"g{k}", gram_key(c[known], number[known], model.bits), 1)[:, 0]
        d = np.array(model.discount.get(k, [0.0] * 4))
        total = np.maximum(seen[:, 0], 1)
        mixed = (np.maximum(count - d[np.minimum(count, 3)], 0) + (seen[:, 1] * d[1] + seen[:, 2] * d[2] + seen[:, 3] * d[3]) * p) / total
        p = np.where(seen[:, 0] > 0, mixed, p)
    return p


def _score(model: Model, held_modulus: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(1)
            for a, b, raw, offsets in text_slices(batch.column(0)):
                h, rows, first = tokens(Words(raw, offsets))
                words = vocabulary(model, h)
                p = probability(model, words, chain(before(words[:, 0], rows, first, model.order)))
                plain = words[:, 1]
                base = np.log10((plain + 0.1) / (model.total + 0.1 * (model.words + 1)))
                add = lambda x: np.add.reduceat(x, first[:-1])  # noqa: E731  no row is without tokens
                part = ids.slice(a, b - a)
                n = np.diff(first)
                total = add(np.log10(p))
                yield pa.record_batch(
                    [part, pa.array(crc_mod(part.to_pylist(), held_modulus) == 0), pa.array(n), pa.array(add((plain > 0).astype(np.int64))), pa.array(np.full(b - a, model.total, np.int64)), pa.array(add(base)), pa.array(total), pa.array(10 ** (-total / n))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
                )

    return run


def train(texts: DataFrame, text_col: str = "text", order: int = 3, folder: str | None = None) -> Model:
    """Count the n-grams of whole texts and store the model's arrays below `folder` (a folder
    that all nodes mount; by default a new one in the shared folder)."""
    spark = texts.sparkSession
    rows = texts.select(F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, int(size // SHARD_TEXT).bit_length()))
    folder = folder or common.mounted(common.shared_path(spark, "lm"))
    os.makedirs(folder, exist_ok=True)
    stats: dict[int, list[int]] = {}

    def gather(table: DataFrame) -> None:
        table = common.written(table, "lm-stats")
        for r in table.groupBy("kind").agg(*(F.sum(c).alias(c) for c in table.columns[1:])).collect():  # a row per kind
            _add(stats, r["kind"], np.array(r[1:]))

    join = min(bits, JOIN)

    def put_together(names: list[str]) -> None:
        if join == bits:
            return
        spark.range(0, 1 << join, 1, 1 << join).mapInArrow(_put_together(folder, names, bits, join), "id long").count()
        for x in os.listdir(folder):
            if "-" in x:
                os.remove(f"{folder}/{x}")

    gather(rows.mapInArrow(_count_words(bits), BLOCK).groupBy("shard").applyInPandas(_vocabulary(folder), STATS))
    put_together(["w"])
    if order < 2 or not stats:
        return Model(folder, order, bits, stats, join)
    counting = Model(folder, order, bits, {}, join)
    level, path = rows.mapInArrow(_count_grams(counting), BLOCK), None
    for k in range(order, 1, -1):
        reduced, made = common.written_at(level.groupBy("kind", "shard").applyInPandas(_reduce(folder, bits, join), BLOCK), "lm-level")
        if path:
            common.remove(spark, path)
        path = made
        for r in reduced.where("shard < 0").toLocalIterator():
            _add(stats, int(r["kind"]), np.frombuffer(r["block"], np.int64))
        level = reduced.where("shard >= 0")
    gather(level.groupBy("shard").applyInPandas(_lowest(counting), STATS))
    common.remove(spark, path)
    put_together([f"{table}{k}{layer}" for k in range(order, 1, -1) for table in "gc" for layer in LAYERS])
    return Model(folder, order, bits, stats, join)


def _add(stats: dict[int, list[int]], kind: int, values: np.ndarray) -> None:
    stats[kind] = [int(a + b) for a, b in zip(stats.get(kind, [0] * 6), values)]


def score(docs: DataFrame, model: Model, held_modulus: int = 10) -> DataFrame:
    """log10 probability and perplexity of every whole text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("text", "doc_id").mapInArrow(_score(model, held_modulus), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def lm_score(docs: DataFrame, order: int = 3, held_modulus: int = 10) -> DataFrame:
    """Train on the rows that are not held out, score all rows."""
    return score(docs, train(docs.where(common.crc_mod(F.col("doc_id"), held_modulus) != 0), order=order), held_modulus)
