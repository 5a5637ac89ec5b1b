"""Alignment of two tokenizers: minimal groups of tokens that cover the same bytes, links between
overlapping tokens, and corpus-wide counts of linked ids.

Texts are cut into units before a space that follows a character which is no white space: neither
tokenizer has a token across that place (byte-level splitting begins a piece there; no entry of
the other holds a space after anything else, which is looked up when it is loaded; if one does,
units are whole texts). A worker aligns each distinct unit once:

- the ends of both tokenizers' tokens cut the unit's bytes into stretches; each stretch is an
  overlap of one token of either side, and all overlaps are such stretches;
- union-find over the bipartite graph of tokens and overlaps; its components are the minimal
  groups, as two tokens lie in one component exactly if no common end parts them;
- members of the components, in order, make the group's text; the graph's edges are the links.

Texts are encoded once. Rows are stored with their links, whose pairs Spark counts. The counted
pairs, ranges of ascending codes in arrays of their own, lie in the shared folder, where workers
map them into memory to sum up each row's links; they are bounded by the product of the
vocabularies, whatever the corpus. The best count of each id of the second tokenizer comes to the
driver, a row per id.

Defined results: a text that is null, empty, or that either tokenizer does not give back byte for
byte (after a space) has no tokens: zeros and empty groups; repeated rows count each time; rows
of a null doc_id are rows like others; an empty table gives no rows and no pairs; input columns
other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .textcore import slices, text_buffers

#: A worker forgets its units when it holds so many, or so many bytes of them.
KNOWN_UNITS, KNOWN_BYTES = 280_000, 32 << 20
#: Texts are taken together up to so many bytes; longer ones in pieces of about so many characters.
PIECE = 1 << 20
#: Units of characters below this, whose classes no version of Unicode changes, are encoded joined.
_PLAIN_END = "\u0250"
_CUT = re.compile(r"(?<=\S) (?=.)", re.S)
#: Fixed: how byte-level splitting cuts a text.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Printable bytes stand for themselves in byte-level entries, the others, in order, for 256 on.
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def _byte_entries(tokenizer) -> list[bytes]:
    rest = [b for b in range(256) if b not in set(_PLAIN)]
    own = {chr(b): b for b in _PLAIN} | {chr(256 + i): b for i, b in enumerate(rest)}
    out = [b""] * tokenizer.get_vocab_size(True)
    for token, i in tokenizer.get_vocab(True).items():
        out[i] = bytes(own[c] for c in token) if all(c in own for c in token) else token.encode()
    return out


def _joined(path: str, entries: list[bytes]):
    """The same vocabulary and merges for long joined texts, or None where the file asks for more
    than byte-level splitting and merges in the order of their ids."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split, model, vocabulary = spec.get("pre_tokenizer") or {}, spec["model"], spec["model"]["vocab"]
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model.get("merges", [])]
    ids = [vocabulary[m] for m in merged]
    alphabet = [i for token, i in vocabulary.items() if len(token) == 1]
    plain = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and not spec.get("normalizer")
    if not (plain and ids == sorted(ids) and len(alphabet) == 256 and max(alphabet) < ids[0] and not model.get("ignore_merges")):
        return None
    ranks = {entries[i]: i for i in [*alphabet, *ids]}
    return tiktoken.Encoding("joined", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


def _piece_entries(model) -> list[bytes]:
    out = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        out.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    return out


def components(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """The least node of each node's component, for n nodes and edges left-right: union-find in
    rounds. Every edge hooks the larger of two roots to the smaller; paths are halved to the end."""
    root = np.arange(n)
    while True:
        a, b = root[left], root[right]
        open_ = a != b
        if not open_.any():
            return root
        left, right, a, b = left[open_], right[open_], a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up


class Entries:
    """Byte lengths, and the decimal ids as text, of one tokenizer's entries."""

    def __init__(self, entries: list[bytes]):
        self.entries = entries
        self.width = np.array([len(x) for x in entries], np.int64)
        digits = [str(i).encode() for i in range(len(entries))]
        self.size = np.array([len(x) for x in digits], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.digits = np.frombuffer(b"".join(digits), np.uint8)


class Aligner:
    """Two tokenizers and the units that a worker has met. By the slot of a unit: its groups'
    text, facts (broken, n_a, n_b, n_groups, n_links) and links, flat."""

    def __init__(self, byte_path: str, piece_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.of_a, self.of_b = Entries(_byte_entries(self.a)), Entries(_piece_entries(self.b))
        self.joined = _joined(byte_path, self.of_a.entries)
        self.cuts = not any(b" " in x.lstrip(b" ") for x in self.of_b.entries)
        self._keep(np.empty(0, np.int64))

    def _keep(self, slots: np.ndarray) -> None:
        """Go on with some of the units met so far."""
        old = getattr(self, "names", [])
        self.names = [old[i] for i in slots.tolist()]
        self.slot = {u: i for i, u in enumerate(self.names)}
        self.texts = [self.texts[i] for i in slots.tolist()] if old else []
        self.facts = self.facts[:, slots] if old else np.zeros((5, 0), np.int64)
        self.links = self.links[_ranges(self.link_at[slots], self.facts[4])] if old else np.empty(0, np.int64)
        self.link_at = np.cumsum(self.facts[4]) - self.facts[4]
        self.met = np.zeros(len(slots), np.int64)
        self.bytes = sum(map(len, self.texts))

    def rest(self) -> None:
        """Make room: units that came but once since the last time go, or all if that is too few."""
        if len(self.texts) > KNOWN_UNITS or self.bytes > KNOWN_BYTES:
            again = np.flatnonzero(self.met > 1)
            self._keep(again if len(again) < KNOWN_UNITS // 2 else again[:0])

    def units(self, text: str) -> Iterator[list[str]]:
        """The units of a text, a piece of it at a time."""
        at = 0
        while self.cuts and len(text) - at > PIECE and (cut := _CUT.search(text, at + PIECE)):
            yield _CUT.split(text[at : cut.start()])
            at = cut.end()
        yield _CUT.split(text[at:] if at else text) if self.cuts else [text]

    def slots(self, units: list[str]) -> np.ndarray:
        known = self.slot
        if new := [u for u in dict.fromkeys(units) if u not in known]:
            # a few thousand at once: numpy's calls cost little, its arrays stay in the cache
            fast = self.joined and self.cuts
            told = [fast and max(u) < _PLAIN_END and not u[-1].isspace() for u in new]
            plain, rest = list(compress(new, told)), [u for u, t in zip(new, told) if not t]
            new = [*plain, *rest]
            found = [self._learned(some[i : i + 8000], some is plain) for some in (plain, rest) for i in range(0, len(some), 8000)]
            texts, facts, links = zip(*found)
            known.update(zip(new, range(len(self.names), len(self.names) + len(new))))
            self.names += new
            self.texts += [t for some in texts for t in some]
            self.facts = np.concatenate([self.facts, *facts], 1)
            self.links = np.concatenate([self.links, *links])
            self.link_at = np.cumsum(self.facts[4]) - self.facts[4]
            self.met = np.concatenate([self.met, np.zeros(len(new), np.int64)])
            self.bytes += sum(len(t) for some in texts for t in some)
        out = np.fromiter(map(known.__getitem__, units), np.int64, len(units))
        self.met += np.bincount(out, minlength=len(self.met))
        return out

    def _first(self, units: list[str], plain: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each unit) of the first tokenizer."""
        if plain:
            ids = self.joined.encode_to_numpy(" " + " ".join(units), allowed_special=set(), disallowed_special=()).astype(np.int64)
            ends = np.cumsum(self.of_a.width[ids])
            until = np.cumsum(np.fromiter((len(u.encode()) + 1 for u in units), np.int64, len(units)))
            at = np.searchsorted(ends, until)
            if np.array_equal(ends[np.minimum(at, len(ends) - 1)], until):
                return ids, np.diff(at + 1, prepend=0)
        return _flat([e.ids for e in self.a.encode_batch_fast([" " + u for u in units], add_special_tokens=False)])

    def _learned(self, units: list[str], plain: bool) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """(groups, facts, links) of some units."""
        (a, n_a), (b, n_b) = self._first(units, plain), _flat(self.b.encode(units, num_threads=1))
        raw = [b" " + u.encode() for u in units]
        count = lambda x, w=None: np.bincount(x, w, len(units)).astype(np.int64)
        unit_a, unit_b = np.repeat(np.arange(len(units)), n_a), np.repeat(np.arange(len(units)), n_b)
        size, line = np.fromiter(map(len, raw), np.int64, len(raw)), b"".join(raw)
        whole = lambda entries, ids: b"".join(map(entries.__getitem__, ids))
        broken = np.zeros(len(units), np.int64)
        same = (count(unit_a, self.of_a.width[a]) == size).all() and (count(unit_b, self.of_b.width[b]) == size).all()
        if not (same and whole(self.of_a.entries, a.tolist()) == line and whole(self.of_b.entries, b.tolist()) == line):
            parts = lambda ids, n: [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
            broken[:] = [whole(self.of_a.entries, x) != r or whole(self.of_b.entries, y) != r for x, y, r in zip(parts(a, n_a), parts(b, n_b), raw)]
            a, b = a[broken[unit_a] == 0], b[broken[unit_b] == 0]
            n_a, n_b = n_a * (1 - broken), n_b * (1 - broken)
            unit_a, unit_b = np.repeat(np.arange(len(units)), n_a), np.repeat(np.arange(len(units)), n_b)
        end_a, end_b = np.cumsum(self.of_a.width[a]), np.cumsum(self.of_b.width[b])
        ends = np.sort(np.concatenate([end_a, end_b]), kind="stable")
        ends = ends[np.diff(ends, prepend=-1) > 0]
        left, right = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        group = components(left, len(a) + right, len(a) + len(b))
        # tokens in the order of group, side and place
        order = np.argsort(group, kind="stable")
        ids, side = np.concatenate([a, b])[order], (np.arange(len(group)) >= len(a))[order]
        group = group[order]
        last = np.ones(len(group), bool)
        last[:-1] = group[1:] != group[:-1]
        closing = np.full(len(group), ord(","), np.uint8)
        closing[:-1][~side[:-1] & side[1:]] = ord("|")
        closing[last] = ord(";")
        wide = np.where(side, self.of_b.size[ids * side], self.of_a.size[ids * ~side])
        to = np.cumsum(wide + 1) - wide - 1
        out = np.empty(int((wide + 1).sum()), np.uint8)
        out[to + wide] = closing
        for entries, own in ((self.of_a, ~side), (self.of_b, side)):
            out[_ranges(to[own], wide[own])] = entries.digits[_ranges(entries.at[ids[own]], wide[own])]
        token_unit = np.concatenate([unit_a, unit_b])[order]
        facts = np.stack([broken, n_a, n_b, count(token_unit[last]), count(unit_a[left])])
        cut, text = np.concatenate([[0], np.cumsum(count(token_unit, wide + 1))]).tolist(), out.tobytes()
        return [text[x:y] for x, y in zip(cut, cut[1:])], facts, a[left] * len(self.of_b.entries) + b[right]


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.fromiter(chain.from_iterable(lists), np.int64), np.fromiter(map(len, lists), np.int64, len(lists))


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each entry, `count` of them."""
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count - start, count)


@lru_cache(maxsize=1)
def _aligner(byte_path: str, piece_path: str) -> Aligner:
    return Aligner(byte_path, piece_path)


def _encode(byte_path: str, piece_path: str):
    """Counts, groups and links of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = _aligner(byte_path, piece_path)
        for batch in batches:
            _, offsets = text_buffers(batch.column(1))
            for x, y in slices(offsets, PIECE):
                yield some(at, batch.slice(x, y - x))
                at.rest()

    def some(at: Aligner, batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        slots, docs, units, of = [], [], [], []

        def take():
            slots.append(at.slots(units))
            docs.append(np.repeat([d for d, _ in of], [n for _, n in of]))
            units.clear(), of.clear()

        for doc, text in enumerate(texts):
            for piece in at.units(text) if text else ():
                units.extend(piece)
                of.append((doc, len(piece)))
                if len(units) > PIECE:
                    take()
        take()
        slot, doc = np.concatenate(slots).astype(np.int64), np.concatenate(docs).astype(np.int64)
        bad = np.bincount(doc, at.facts[0][slot], len(texts)) > 0
        slot, doc = slot[~bad[doc]], doc[~bad[doc]]
        sums = [np.bincount(doc, f[slot], len(texts)).astype(np.int64) for f in at.facts[1:]]
        until = np.cumsum(np.bincount(doc, minlength=len(texts))).tolist()
        every = [at.texts[i] for i in slot.tolist()]
        groups = [b"".join(every[x:y])[:-1].decode() for x, y in zip([0, *until], until)]
        links = at.links[_ranges(at.link_at[slot], at.facts[4][slot])]
        listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sums[3])]), pa.int32()), pa.array(links))
        return pa.record_batch([batch.column(0), *map(pa.array, sums), pa.array(groups, pa.string()), listed], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "links"])

    return run


class Pairs:
    """The corpus's counted pairs: ranges of ascending codes, their counts, and the best count of
    each id of the second tokenizer."""

    def __init__(self, folder: str):
        load = lambda name: np.load(f"{folder}/{name}", mmap_mode="r")
        names = sorted(x for x in os.listdir(folder) if x.startswith("codes-"))
        self.codes, self.counts, self.best = [load(x) for x in names], [load(x.replace("codes-", "counts-")) for x in names], load("best.npy")

    def of(self, codes: np.ndarray) -> np.ndarray:
        asked, back = np.unique(codes, return_inverse=True)
        edges = np.searchsorted(asked, [int(x[0]) for x in self.codes] + [1 << 62])
        out = np.zeros(len(asked), np.int64)
        for own, counts, a, b in zip(self.codes, self.counts, edges, edges[1:]):
            if a < b:
                out[a:b] = counts[np.searchsorted(own, asked[a:b])]
        return out[back]


@lru_cache(maxsize=1)
def _pairs(folder: str) -> Pairs:
    return Pairs(folder)


def _save(folder: str):
    """Store ranges of pairs; files appear whole or not at all, and a repeated task's are the
    same. Ranges are named by their first code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if held:
            codes, counts = (np.concatenate(x) for x in zip(*held))
            for name, x in (("counts", counts), ("codes", codes)):
                part = f"{folder}/.{uuid.uuid4().hex}.npy"
                np.save(part, x)
                os.replace(part, f"{folder}/{name}-{int(codes[0]):020d}.npy")
            yield pa.record_batch([pa.array([len(codes)])], ["n"])

    return run


def _sum(folder: str, size: int):
    """n_best and count_sum of each row's links, in the place of the links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column(0)
            codes, ends = listed.flatten().to_numpy(), np.diff(listed.offsets.to_numpy())
            n_best = count_sum = np.zeros(len(listed), np.int64)
            if len(codes):
                pairs, row = _pairs(folder), np.repeat(np.arange(len(listed)), ends)
                n = pairs.of(codes)
                n_best = np.bincount(row[n == pairs.best[codes % size]], minlength=len(listed))
                sums = np.concatenate([[0], np.cumsum(n)])  # whole numbers, exact
                until = np.cumsum(ends)
                count_sum = sums[until] - sums[until - ends]
            yield pa.record_batch([*batch.columns[1:], pa.array(n_best), pa.array(count_sum)], [*batch.schema.names[1:], "n_best", "count_sum"])

    return run


def encoded(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups (`a1,a2|b1;a3|b2,b3`) and links of every row. A
    link is a code: id of the first * size of the second vocabulary + id of the second."""
    common.bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_encode(byte_path, piece_path), f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, links array<long>")


def align(docs: DataFrame, byte_path: str, piece_path: str, folder: str | None = None, groups: Column | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups, n_best and count_sum of every row. `groups`:
    what is to be kept of the column groups, by default its text. `folder`: a folder that all nodes
    mount, for the pairs."""
    import sentencepiece

    spark = docs.sparkSession
    size = sentencepiece.SentencePieceProcessor(model_file=piece_path).get_piece_size()
    folder = folder or common.mounted(common.shared_path(spark, "pairs"))
    os.makedirs(folder, exist_ok=True)
    rows = encoded(docs, byte_path, piece_path).withColumn("groups", F.col("groups") if groups is None else groups)
    short = size * _entries(byte_path) <= 1 << 31  # codes that fit four bytes are stored in four
    rows = common.written(rows.withColumn("links", F.col("links").cast("array<int>")) if short else rows, "aligned")
    counts = rows.select(F.explode("links").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    counts = common.written(counts.select(F.col("code").cast("long").alias("code"), "n"), "pair-counts")
    best = np.zeros(size, np.int64)
    for b, n in counts.groupBy((F.col("code") % size).alias("b")).agg(F.max("n")).collect():  # a row per id
        best[b] = n
    np.save(f"{folder}/best.npy", best)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts.repartitionByRange(parts, "code").sortWithinPartitions("code").mapInArrow(_save(folder), "n long").agg(F.sum("n")).collect()
    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"]
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.select("links", *kept).mapInArrow(_sum(folder, size), f"{kinds}, n_best long, count_sum long")


def _entries(byte_path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(byte_path).get_vocab_size(True)
