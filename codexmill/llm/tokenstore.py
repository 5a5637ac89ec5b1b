"""Token-ID output: raw id payloads in shards, found by a minimal perfect hash index.

Format of a store (a folder):
- `ids-<shard>.bin`: the ids of the shard's documents, one after the other in ascending doc_id
  order, as little-endian unsigned integers of `width` bytes. Shards follow each other in order.
- `index-<group>.npz`: a minimal perfect hash over the document keys of a group (keys are dealt
  to groups by hash). `bits` and `rank` hold the hash's levels: a key is placed at the first
  level where it alone hashes to a bit; its slot is the number of set bits before. Per slot:
  `print` (fingerprint), `shard`, `offset` and `count` in ids. `rest` lists hashes that no level
  separates, with their slots behind all others.
- `meta.json`: width, groups, shards and the shards' sizes in ids.

A look-up costs a few bit tests and one read, whatever the size of the store.

Encoding: the text is cut at ASCII white space, which the tokenizer's own splitting never
crosses, and each distinct word, or its letters and punctuation, is encoded by the library once
per worker; the ids equal those of the whole text.

Defined results: a null or empty text is its end id alone; null doc_ids come first; rows that
share a doc_id are keyed by their number in the order of their texts; an empty table gives a
store without shards; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .textcore import U64, mix64

#: A worker forgets its words or pieces when it holds so many.
KNOWN_WORDS, KNOWN_PIECES = 600_000, 1_200_000
SHARD_BYTES = 32 << 20
GROUP_KEYS = 500_000
LEVELS, SPARE = 48, 2
_PUNCTUATION = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"


class Encoder:
    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(True)
        self.width = 2 if max(size, end_id + 1) <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.end = np.array([end_id], self.kind).tobytes()
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.closing = np.zeros(size, bool)  # tokens that end a piece
        for token, i in self.tokenizer.get_vocab(True).items():
            self.closing[i] = token.endswith("</w>")
        self.exact = self._splits()

    def _splits(self) -> bool:
        """Whether pieces may be told apart: a probe of letters and punctuation, whole and cut."""
        ids = lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids
        whole = ids('"Trial, (Höhe) ran...\n\tOn!')
        parts = [i for x in ('"', "trial", ",", "(", "höhe", ")", "ran", "...", "on", "!") for i in ids(x)]
        return whole == parts and all(self.closing[ids(x)[-1]] for x in ("trial", ",", "...", "höhe"))

    def _bytes(self, ids) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def _pieces(self, word: str) -> list[str] | None:
        """Letters and the punctuation around them, where their encodings just follow each other."""
        core = word.strip(_PUNCTUATION)
        if not core:
            return [word]
        if not core.isalpha() or max(core) >= "ɐ":
            return None
        at = word.index(core)
        return [x for x in (word[:at], core.lower(), word[at + len(core) :]) if x]

    def _learn(self, words: set[bytes]) -> None:
        if len(self.words) > KNOWN_WORDS:
            self.words.clear()
        if len(self.pieces) > KNOWN_PIECES:
            self.pieces.clear()
        cut, whole = {}, []
        for w in words:
            parts = self._pieces(w.decode("utf-8", "replace")) if self.exact else None
            if parts is None:
                whole.append(w)
            else:
                cut[w] = parts
        new = list({p for parts in cut.values() for p in parts if p not in self.pieces})
        for i in range(0, len(new), 4096):
            some = new[i : i + 4096]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, np.int64)
            ends = np.flatnonzero(self.closing[ids]) + 1
            if len(ends) == len(some):
                begin = 0
                for p, end in zip(some, ends.tolist()):
                    self.pieces[p] = ids[begin:end].astype(self.kind).tobytes()
                    begin = end
            else:
                for p, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                    self.pieces[p] = self._bytes(e.ids)
        for w, parts in cut.items():
            self.words[w] = b"".join([self.pieces[p] for p in parts])
        for w, e in zip(whole, self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in whole], add_special_tokens=False)):
            self.words[w] = self._bytes(e.ids)

    def encode(self, text: bytes) -> bytes:
        """The ids of a whole text, with the end id, as bytes."""
        if text.isascii() and b"<|" not in text:
            text = text.lower()
        words = text.split()
        try:
            return b"".join(map(self.words.__getitem__, words)) + self.end
        except KeyError:
            self._learn({w for w in words if w not in self.words} | (set(words) if len(self.words) > KNOWN_WORDS else set()))
            return b"".join(map(self.words.__getitem__, words)) + self.end


@lru_cache(maxsize=2)
def encoder(path: str, end_id: int) -> Encoder:
    return Encoder(path, end_id)


def key_hash(doc_ids: list, numbers: np.ndarray) -> np.ndarray:
    """64-bit hashes of (doc_id, number); without collisions for integer ids of number 0."""
    whole = np.array([0 if x is None else x if isinstance(x, int) else crc32(str(x).encode()) | crc32(str(x).encode(), 77) << 32 for x in doc_ids], dtype=object)
    ids = np.array([int(x) & (1 << 64) - 1 for x in whole], U64)
    none = np.array([x is None for x in doc_ids], bool)
    with np.errstate(over="ignore"):
        return mix64(mix64(ids) + numbers.astype(U64) * U64(0x9E3779B97F4A7C15) + none.astype(U64) * U64(0xD1342543DE82EF95))


def _whole(path: str, put) -> None:
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        put(f)
    os.replace(part, path)


def _write(folder: str, path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        enc = encoder(path, end_id)
        part, at, last, number, out = f"{folder}/.ids-{shard}-{uuid.uuid4().hex}", 0, object(), 0, None
        try:
            for batch in batches:
                out = out or open(part, "wb")
                counts, numbers, offsets = [], [], []
                texts = batch.column(1).cast(pa.binary())
                for doc_id, text in zip(batch.column(0).to_pylist(), texts):
                    ids = enc.encode(text.as_py() or b"")
                    out.write(ids)
                    number = number + 1 if doc_id == last else 0
                    last = doc_id
                    counts.append(len(ids) // enc.width)
                    offsets.append(at)
                    numbers.append(number)
                    at += counts[-1]
                n = batch.num_rows
                yield pa.record_batch([batch.column(0), pa.array(numbers, pa.int64()), pa.array(np.full(n, shard, np.int32)), pa.array(offsets, pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "number", "shard", "offset", "count"])
            if out:
                out.close()
                os.replace(part, f"{folder}/ids-{shard:06d}.bin")
        finally:
            if out and os.path.exists(part):
                os.remove(part)

    return run


def perfect_hash(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(levels' ends in bits, bit words, rank before each word, hashes left over)."""
    ends, rows, left, at = [], [], h, 0
    for level in range(LEVELS):
        if not len(left):
            break
        size = max(64, -(-SPARE * len(left) // 64) * 64)
        place = (_level(left, level) % U64(size)).astype(np.int64)
        once = np.bincount(place, minlength=size) == 1
        rows.append(np.packbits(once, bitorder="little"))
        left = left[~once[place]]
        at += size
        ends.append(at)
    words = np.concatenate(rows).view("<u8") if rows else np.empty(0, "<u8")
    rank = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.bitwise_count(words), out=rank[1:])
    return np.array(ends, np.int64), words, rank, np.sort(left)


def _level(h: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(h + U64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


def slots(h: np.ndarray, ends: np.ndarray, words: np.ndarray, rank: np.ndarray, rest: np.ndarray) -> np.ndarray:
    out = np.full(len(h), -1, np.int64)
    open_ = np.arange(len(h))
    begin = 0
    for level, end in enumerate(ends.tolist()):
        if not len(open_):
            break
        bit = begin + (_level(h[open_], level) % U64(end - begin)).astype(np.int64)
        word, low = words[bit >> 6], (bit & 63).astype(U64)
        hit = (word >> low & U64(1)) == 1
        below = np.bitwise_count(word[hit] & ((U64(1) << low[hit]) - U64(1))).astype(np.int64)
        out[open_[hit]] = rank[bit[hit] >> 6] + below
        open_ = open_[~hit]
        begin = end
    if len(open_) and len(rest):
        at = np.minimum(np.searchsorted(rest, h[open_]), len(rest) - 1)
        out[open_] = np.where(rest[at] == h[open_], (rank[-1] if len(rank) else 0) + at, -1)
    return out


def _index(folder: str):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        group = int(key[0])
        h = key_hash([None if pd.isna(x) else x for x in pdf["doc_id"].astype(object)], pdf["number"].to_numpy())
        ends, words, rank, rest = perfect_hash(h)
        slot = slots(h, ends, words, rank, rest)
        n = len(h)
        if len(np.unique(slot)) != n or (n and (slot.min() < 0 or slot.max() != n - 1)):
            raise ValueError(f"group {group}: two documents have one key")
        columns = {"print": (h >> U64(32)).astype(np.uint32), "shard": pdf["shard"].to_numpy(np.uint32), "offset": pdf["offset"].to_numpy(np.uint64), "count": pdf["count"].to_numpy(np.uint32)}
        placed = {}
        for name, x in columns.items():
            placed[name] = np.empty_like(x)
            placed[name][slot] = x
        _whole(f"{folder}/index-{group:06d}.npz", lambda f: np.savez(f, ends=ends, words=words, rank=rank, rest=rest, **placed))
        return pd.DataFrame({"group": [group], "n": [n]})

    return run


class TokenStore:
    """Keyed access to a store."""

    def __init__(self, folder: str):
        self.folder = folder
        with open(f"{folder}/meta.json") as f:
            self.meta = json.load(f)
        self.kind = np.dtype(f"<u{self.meta['width']}")
        sizes = self.meta["sizes"]
        self.start = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self._groups: dict[int, dict] = {}
        self._shards: dict[int, np.ndarray] = {}

    def _group(self, g: int) -> dict:
        if g not in self._groups:
            if len(self._groups) > 64:
                self._groups.clear()
            with np.load(f"{self.folder}/index-{g:06d}.npz") as z:
                self._groups[g] = dict(z)
        return self._groups[g]

    def _shard(self, s: int) -> np.ndarray:
        if s not in self._shards:
            if len(self._shards) > 64:
                self._shards.clear()
            size = self.meta["sizes"][s]
            self._shards[s] = np.memmap(f"{self.folder}/ids-{s:06d}.bin", self.kind, "r", shape=(size,)) if size else np.empty(0, self.kind)
        return self._shards[s]

    def locate(self, doc_ids: list, numbers: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(shard, offset, count) of each document; an unknown key raises KeyError."""
        numbers = np.zeros(len(doc_ids), np.int64) if numbers is None else numbers
        h = key_hash(doc_ids, numbers)
        groups = (h % U64(self.meta["groups"])).astype(np.int64)
        out = np.zeros((3, len(h)), np.int64)
        for g in np.unique(groups):
            at = np.flatnonzero(groups == g)
            if not os.path.exists(f"{self.folder}/index-{g:06d}.npz"):
                raise KeyError(doc_ids[at[0]])
            z = self._group(int(g))
            slot = slots(h[at], z["ends"], z["words"], z["rank"], z["rest"])
            wrong = (slot < 0) | (z["print"][np.maximum(slot, 0)] != (h[at] >> U64(32)).astype(np.uint32))
            if wrong.any():
                raise KeyError(doc_ids[at[np.flatnonzero(wrong)[0]]])
            out[:, at] = z["shard"][slot], z["offset"][slot], z["count"][slot]
        return out[0], out[1], out[2]

    def get(self, doc_id, number: int = 0) -> np.ndarray:
        """The ids of one document, its end id included."""
        (shard,), (offset,), (count,) = self.locate([doc_id], np.array([number]))
        return np.array(self._shard(int(shard))[offset : offset + count])


@lru_cache(maxsize=2)
def opened(folder: str) -> TokenStore:
    return TokenStore(folder)


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = opened(folder)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            shard, offset, count = store.locate(ids, batch.column(1).to_numpy())
            sums = []
            for s, o, n in zip(shard.tolist(), offset.tolist(), count.tolist()):
                sums.append(crc32(store._shard(s)[o : o + n].astype("<u4").tobytes()))
            yield pa.record_batch([batch.column(0), pa.array(store.start[shard] + offset), pa.array(count), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def write_store(docs: DataFrame, tokenizer: str, end_id: int = 1, folder: str | None = None) -> tuple[str, DataFrame]:
    """Encode all whole texts to a store below `folder` (one that all nodes mount; by default a
    new one in the shared folder). Returns the folder and the keys (doc_id, number)."""
    spark = docs.sparkSession
    folder = folder or common.mounted(common.shared_path(spark, "tokens"))
    os.makedirs(folder, exist_ok=True)
    kind = docs.schema["doc_id"].dataType.simpleString()
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    ordered = docs.select("doc_id", "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    keys = common.written(ordered.mapInArrow(_write(folder, tokenizer, end_id), f"doc_id {kind}, number long, shard int, offset long, count long"), "keys")
    sums = {r[0]: r[1] for r in keys.groupBy("shard").agg(F.sum("count")).collect()}  # a row per shard
    total = keys.count()
    groups = max(64, -(-total // GROUP_KEYS))
    width = encoder(tokenizer, end_id).width
    shards = max(sums, default=-1) + 1
    grouped = keys.mapInArrow(_dealt(groups), keys.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ") + ", group int")
    made = grouped.groupBy("group").applyInPandas(_index(folder), "group int, n long").agg(F.sum("n")).first()[0] or 0
    if made != total:
        raise ValueError(f"{made} of {total} keys indexed")
    _whole(f"{folder}/meta.json", lambda f: f.write(json.dumps({"width": width, "groups": groups, "shards": shards, "sizes": [sums.get(s, 0) for s in range(shards)]}).encode()))
    return folder, keys.select("doc_id", "number")


def _dealt(groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = key_hash(batch.column(0).to_pylist(), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((h % U64(groups)).astype(np.int32))], [*batch.schema.names, "group"])

    return run


def read_store(folder: str, keys: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each key, from the files."""
    kind = keys.schema["doc_id"].dataType.simpleString()
    return keys.select("doc_id", "number").mapInArrow(_read(folder), f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
