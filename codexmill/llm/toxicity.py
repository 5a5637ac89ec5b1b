"""Toxicity: a linear-chain conditional random field over the words of a text.

Token labels: documents carry labels, tokens don't, so tokens are labelled from the training
rows: a word of a toxic row is toxic where the word, or its stem (first letters), is found in
a hundredth of the toxic rows or more and far more often than in clean ones, near copies of rows
with one label counted once; words of clean rows are not toxic.

Model: two states; features of a word are its letters, its stems of 3 to 6 letters and its
end, hashed; transitions couple neighbours. Trained by Adam on the exact log-likelihood
(forward-backward), with words outside the training rows reached by their stems. Chains are
windows of CHAIN words, cut at fixed places over the whole text.

Score: forward-backward marginals of all words; the largest and the sum of those above a tenth
go through a logistic curve fitted on the training rows. Spans of words of marginal 0.5 or more
are reported as byte offsets.

The model is fitted on a bounded sample of whole rows: in the order of a hash of doc_id, up to
`sample` rows of each label, and of those as many as come to `sample_bytes` of text. Of a sampled
row every word takes part in training.

Defined results: null and empty texts score the curve at no toxic word; without training rows
of both labels every score is the share of toxic rows (0.5 where there are none); repeated rows
score alike; a doc_id with several labels counts as toxic if any is, and one with several texts
is trained on the one of the least hash; extra columns are ignored.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .textcore import LETTERS, U64, Words, crc_mod, mix64, shingles, text_slices, unique_inverse

CHAIN = 64
HASH_BITS = 20
#: Stems by number of bytes, and the last bytes of a word.
STEMS, END = (3, 4, 5, 6), 4
#: The fit takes up to so many rows of each label, and up to so many bytes of text in all.
SAMPLE, SAMPLE_BYTES = 2500, 24 << 20
SPAN = 0.5
#: A mark of toxic rows is found in this share of them at least.
SUPPORT = 0.01


class _Letters:
    """The words of a slice without leading and trailing ASCII punctuation, as features; a word
    of punctuation alone stays as it is."""

    def __init__(self, words: Words):
        data = words.data
        letters = np.append(np.flatnonzero(LETTERS[data]), len(data))
        at = np.searchsorted(letters, words.start)
        some = letters[at] < words.end
        start = np.where(some, letters[at], words.start)
        end = np.where(some, letters[np.maximum(np.searchsorted(letters, words.end) - 1, 0)] + 1, words.end)
        size = end - start
        padded = np.zeros(len(data) + 16, np.uint8)
        padded[: len(data)] = data
        lanes = np.ndarray((len(data) + 9,), "<u8", padded, 0, (1,))
        keep = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], U64)
        first = lanes[start]
        columns = []
        with np.errstate(over="ignore"):
            for i, n in enumerate(STEMS):
                part = first & keep[np.minimum(size, n)]
                columns.append(mix64(part + U64((i + 1) << 56)))
            tail = lanes[np.maximum(end - END, start)] & keep[np.minimum(size, END)]
            columns.append(mix64(tail + U64(9 << 56)))
            columns.append(words.hash_spans(start, end))  # the whole word
        self.columns = columns
        self.keys = np.stack([(c >> U64(64 - HASH_BITS)).astype(np.int32) for c in columns], 1) if len(start) else np.empty((0, len(STEMS) + 2), np.int32)


def chains(first: np.ndarray, chain: int = CHAIN) -> tuple[np.ndarray, np.ndarray]:
    """(begin, size) of the windows of all rows, over positions of words."""
    count = np.diff(first)
    many = -(-count // chain)
    row = np.repeat(np.arange(len(count)), many)
    begin0 = np.zeros(len(count), np.int64)
    np.cumsum(many[:-1], out=begin0[1:])
    nth = np.arange(len(row)) - begin0[row]
    begin = first[:-1][row] + nth * chain
    return begin, np.minimum(chain, first[1:][row] - begin)


def forward_backward(lift: np.ndarray, begin: np.ndarray, size: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(marginals of state 1, pair marginals per chain summed as 2 x 2, log partition).

    `lift`: score of state 1 over state 0 for each word; `trans`: 2 x 2 scores of neighbours.
    Chains advance together, one position at a time, longest first."""
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    longest = int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(1, longest + 1), "right") if longest else []
    up = np.exp(np.clip(lift, -30, 30))
    t = np.exp(trans)
    n = len(begin)
    a = np.empty((longest, n))  # P(state 1) in the normalised forward messages
    z = np.zeros(n)
    for k in range(longest):
        m = live[k]
        e = up[begin[:m] + k]
        if k:
            p1 = a[k - 1, :m]
            p0 = 1 - p1
            f0, f1 = p0 * t[0, 0] + p1 * t[1, 0], (p0 * t[0, 1] + p1 * t[1, 1]) * e
        else:
            f0, f1 = np.ones(m), e.copy()
        total = f0 + f1
        a[k, :m] = f1 / total
        z[:m] += np.log(total)
    marginal = np.zeros(len(lift))
    pairs = np.zeros((2, 2))
    b1 = np.full(n, 0.5)  # backward messages, normalised to sum 1
    for k in range(longest - 1, -1, -1):
        m = live[k]
        f1 = a[k, :m]
        if k + 1 < longest:
            # chains that end at this position have a flat message
            after = live[k + 1]
            e = up[begin[:after] + k + 1]
            n1, n0 = b1[:after] * e, 1 - b1[:after]
            g0, g1 = t[0, 0] * n0 + t[0, 1] * n1, t[1, 0] * n0 + t[1, 1] * n1
            p1 = a[k, :after]
            p0 = 1 - p1
            joint = np.stack([p0 * t[0, 0] * n0, p0 * t[0, 1] * n1, p1 * t[1, 0] * n0, p1 * t[1, 1] * n1])
            pairs += (joint / joint.sum(0)).sum(1).reshape(2, 2)
            b1[:after] = g1 / (g0 + g1)
        up1, up0 = f1 * b1[:m], (1 - f1) * (1 - b1[:m])
        marginal[begin[:m] + k] = up1 / (up0 + up1)
    return marginal, pairs, z


class Tagger:
    def __init__(self):
        self.weight = np.zeros(1 << HASH_BITS, np.float32)
        self.bias, self.trans = -4.0, np.zeros((2, 2))
        self.curve, self.plain = (0.0, 0.0, 0.0), 0.5
        self.fitted = False

    def lift(self, keys: np.ndarray) -> np.ndarray:
        return self.weight[keys].sum(1, dtype=np.float64) + self.bias

    def marginals(self, keys: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Marginals of all words. Windows in which no word is lifted differ only in length."""
        begin, size = chains(first)
        return forward_backward(self.lift(keys), begin, size, self.trans)[0]

    def _summary(self, marginal: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        full = np.flatnonzero(np.diff(first))
        top, total = np.zeros(len(first) - 1), np.zeros(len(first) - 1)
        if len(full):
            top[full] = np.maximum.reduceat(marginal, first[:-1][full])
            total[full] = np.add.reduceat(np.where(marginal >= 0.1, marginal, 0.0), first[:-1][full])
        return top, np.log1p(total)

    def score(self, marginal: np.ndarray, first: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(first) - 1, self.plain)
        top, total = self._summary(marginal, first)
        c, a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(c + a * top + b * total, -35, 35)))

    def fit(self, texts: list[str], labels: list[int], epochs: int = 6, seed: int = 7) -> Tagger:
        y = np.array(labels, np.int64)
        self.plain = float(y.mean()) if len(y) else 0.5
        if not len(y) or y.min() == y.max():
            return self
        keys, hashes, rows, firsts, at, kept, seen = [], [], [], [0], 0, [], ({}, {})
        for a, b, raw, offsets in text_slices(pa.array(texts, pa.string())):
            w = Words(raw, offsets)
            letters = _Letters(w)
            fresh = _fresh(w, y[a:b], seen)  # of near copies one row: copies would make all their words tell
            take = fresh[w.doc]
            keys.append(letters.keys[take])
            hashes.append([c[take] for c in letters.columns[1:]])
            number = np.cumsum(fresh) - 1 + len(kept)
            rows.append(number[w.doc[take]].astype(np.int32))
            firsts.extend((np.cumsum(w.count[fresh]) + at).tolist())
            at = firsts[-1]
            kept.extend((np.flatnonzero(fresh) + a).tolist())
        y = y[kept]
        keys, rows, first = np.concatenate(keys), np.concatenate(rows), np.array(firsts)
        del texts
        toxic = self._label(hashes, rows, y) & (y[rows] == 1)
        del hashes
        begin, size = chains(first)
        pick = np.arange(len(begin))  # every window of every row
        rng = np.random.default_rng(seed)
        w, extra = np.zeros(len(self.weight)), np.array([self.bias, 0, 0, 0, 0.0])
        m, v = np.zeros(len(w)), np.zeros(len(w))
        me, ve = np.zeros(5), np.zeros(5)
        step = 0
        for _ in range(epochs):
            rng.shuffle(pick)
            for part in np.array_split(pick, max(1, len(pick) // 1500)):
                step += 1
                b, s = begin[part], size[part]
                place = np.repeat(b, s) + (np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s))
                local = np.cumsum(s) - s
                k, gold = keys[place], toxic[place]
                self.trans = extra[1:].reshape(2, 2)
                marginal, pairs, _ = forward_backward(w[k].sum(1) + extra[0], local, s, self.trans)
                diff = (marginal - gold) / len(part)
                g = np.bincount(k.ravel(), np.repeat(diff, k.shape[1]), len(w)) + 1e-6 * w
                inner = np.ones(len(gold), bool)
                inner[local] = False
                now, before = gold[inner], gold[np.flatnonzero(inner) - 1]
                seen = np.bincount(before * 2 + now, minlength=4)
                ge = np.r_[diff.sum(), (pairs.ravel() - seen) / len(part)]
                for grad, x, mm, vv in ((g, w, m, v), (ge, extra, me, ve)):
                    mm *= 0.9
                    mm += 0.1 * grad
                    vv *= 0.99
                    vv += 0.01 * grad * grad
                    x -= 0.1 * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.99**step)) + 1e-8)
        self.weight, self.bias, self.trans = w.astype(np.float32), float(extra[0]), extra[1:].reshape(2, 2).copy()
        top, total = self._summary(self.marginals(keys, first), first)
        self.curve = _logistic(np.stack([np.ones(len(y)), top, total], 1), y)
        self.fitted = True
        return self

    @staticmethod
    def _label(hashes: list[list[np.ndarray]], rows: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Words that mark toxic rows, by rows with the word or one of its stems of four or more;
        `hashes`: the hashes of both for each slice."""
        share = max(int(y.sum()), 1) / max(int((1 - y).sum()), 1)
        least = max(3, int(np.ceil(SUPPORT * y.sum())))
        out = np.zeros(len(rows), bool)
        for column in zip(*hashes):
            names, key = unique_inverse(np.concatenate(column))
            pair = np.unique(key * len(y) + rows)
            bad = np.bincount(pair // len(y), y[pair % len(y)], len(names))
            good = np.bincount(pair // len(y), 1 - y[pair % len(y)], len(names))
            out |= ((bad >= least) & (bad > 12 * share * (good + 0.25)))[key]
        return out


def _fresh(w: Words, labels: np.ndarray, seen: tuple[dict, dict], marks: int = 20, same: int = 16) -> np.ndarray:
    """Which rows are no near copies of an earlier row of their label: fewer than `same` of
    `marks` min-hashes of five-word shingles agree with any one of those (a similarity of 0.8)."""
    h, doc = shingles(w, 5)
    out = np.ones(w.rows, bool)
    if not len(h):
        return out
    begin = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    least = np.stack([np.minimum.reduceat(mix64(h ^ U64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)), begin) for k in range(1, marks + 1)], 1)
    for row, mine in zip(doc[begin].tolist(), least.tolist()):
        known = seen[int(labels[row])]  # (which min-hash, its value) -> kept rows that have it
        with_ = Counter(r for k, v in enumerate(mine) for r in known.get((k, v), ()))
        out[row] = not with_ or max(with_.values()) < same
        if out[row]:
            name = known["rows"] = known.get("rows", 0) + 1
            for k, v in enumerate(mine):
                known.setdefault((k, v), []).append(name)
    return out


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Newton steps with a small ridge; the curve stays finite where the labels are separable."""
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-3, 0.05, 0.05])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def train(docs: DataFrame, labels: DataFrame, usable=None, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Tagger:
    """Fit on up to `sample` labelled rows of each label among those that `usable` (a condition
    on doc_id) lets through, and of those on as many as come to `sample_bytes` of text. Rows longer
    than a thirty-second of that stand behind all others, and each label keeps its first row, so no
    single text displaces the rest."""
    known = labels.where("doc_id is not null and toxic is not null")
    known = known.where(usable) if usable is not None else known
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = [known.where(F.col("toxic") == t).orderBy(*order).limit(sample) for t in (0, 1)]
    chosen = common.written(picked[0].unionByName(picked[1]), "labelled")  # at most 2 * sample rows
    held = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    each = held.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("t"))
    each = common.written(each.select("doc_id", "toxic", F.coalesce("t.text", F.lit("")).alias("text")), "sample")
    # the labels take turns, so a bound on bytes keeps both
    turn = Window.partitionBy("toxic").orderBy(F.col("size") > sample_bytes // 32, *order)
    sizes = each.select("doc_id", "toxic", F.octet_length("text").cast("long").alias("size")).withColumn("turn", F.row_number().over(turn))
    until = Window.orderBy("turn", "toxic", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # 2 * sample rows
    fits = sizes.withColumn("until", F.sum("size").over(until)).where((F.col("until") <= sample_bytes) | (F.col("turn") == 1)).select("doc_id")
    # the bounded sample meets in one task, which returns the model (4 MB)
    fitted = each.join(F.broadcast(fits), "doc_id", "left_semi").repartition(1).mapInPandas(_fit, "model binary").first()
    return pickle.loads(fitted["model"]) if fitted else Tagger()


def _fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    frames = [b for b in batches if len(b)]
    tagger = Tagger()
    if frames:
        rows = pd.concat(frames).sort_values("doc_id", kind="stable")
        tagger.fit(rows["text"].tolist(), rows["toxic"].tolist())
    yield pd.DataFrame({"model": [pickle.dumps(tagger)]})


def _score(tagger, held_modulus: int, held: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Tagger = tagger.value
        for batch in batches:
            for a, b, raw, offsets in text_slices(batch.column(1)):
                w = Words(raw, offsets)
                marginal = model.marginals(_Letters(w).keys, w.first) if len(w.hash) else np.empty(0)
                score = model.score(marginal, w.first)
                ids = batch.column(0).slice(a, b - a)
                yield pa.record_batch([ids, pa.array(crc_mod(ids.to_pylist(), held_modulus) == held), pa.array(score), pa.array((score >= threshold).astype(np.int32)), _spans(w, marginal, offsets)], ["doc_id", "held_out", "score", "predicted", "spans"])

    return run


def _spans(w: Words, marginal: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Runs of toxic words of each row as [begin, end) byte offsets in its text."""
    on = marginal >= SPAN
    edge = np.r_[True, w.doc[1:] != w.doc[:-1]] if len(on) else np.empty(0, bool)
    begin = np.flatnonzero(on & (edge | ~np.r_[False, on[:-1]])) if len(on) else np.empty(0, np.int64)
    last = np.r_[edge[1:], True] if len(on) else edge
    end = np.flatnonzero(on & (last | ~np.r_[on[1:], False])) if len(on) else begin
    doc = w.doc[begin]
    base = offsets[:-1][doc]
    pairs = pa.StructArray.from_arrays([pa.array(w.start[begin] - base, pa.int64()), pa.array(w.end[end] - base, pa.int64())], ["begin", "end"])
    cut = np.searchsorted(doc, np.arange(w.rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(cut), pairs)


def score(docs: DataFrame, tagger: Tagger, held_modulus: int = 3, held: int = 1, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted and spans of every row. The model is broadcast: its
    size is fixed by HASH_BITS (4 MB)."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_score(shared, held_modulus, held, threshold), f"doc_id {kind}, held_out boolean, score double, predicted int, spans array<struct<begin: long, end: long>>")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from rows whose crc32(doc_id) mod 3 is not 1; score all rows."""
    return score(docs, train(docs, labels, common.crc_mod(F.col("doc_id"), 3) != 1))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that are not predicted toxic, with the input's columns."""
    tagger = train(docs, labels, common.crc_mod(F.col("doc_id"), 3) != 1)
    shared = docs.sparkSession.sparkContext.broadcast(tagger)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, offsets in text_slices(batch.column(at)):
                w = Words(raw, offsets)
                marginal = shared.value.marginals(_Letters(w).keys, w.first) if len(w.hash) else np.empty(0)
                clean = shared.value.score(marginal, w.first) < 0.7
                yield batch.slice(a, b - a).filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)
