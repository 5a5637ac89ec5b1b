import math
from collections import Counter
from zlib import crc32

import pytest
from brute import words_of

from codexmill.llm import lm


def brute(rows, order, modulus=10):
    """{doc_id: (held_out, n_tokens, n_known, base, score)} with dictionaries."""
    held = {i: crc32(str(i).encode()) % modulus == 0 for i, _ in rows}
    texts = {i: [*words_of(t), "</s>"] for i, t in rows}
    train = [texts[i] for i, _ in rows if not held[i]]
    plain = Counter(w for t in train for w in t)
    total, vocabulary = sum(plain.values()), len(plain)
    counts = {order: Counter()}
    for t in train:
        padded = ["<s>"] * (order - 1) + t
        for k in range(len(t)):
            counts[order][tuple(padded[k : k + order])] += 1
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    cut = {}
    for k, c in counts.items():
        few = [sum(v == n for v in c.values()) for n in (1, 2, 3, 4)]
        cut[k] = lm.discounts(*few)
    sums = {k: {} for k in counts}
    for k, c in counts.items():
        for g, v in c.items():
            sums[k].setdefault(g[:-1], []).append(v)

    def p(k, context, word):
        if k == 0:
            return 1 / (vocabulary + 1)
        low = p(k - 1, context[1:], word)
        seen = sums[k].get(context)
        if not seen:
            return low
        d = cut[k]
        c = counts[k].get((*context, word), 0)
        return (max(c - d[min(c, 3)], 0) + sum(d[min(v, 3)] for v in seen) * low) / sum(seen)

    out = {}
    for i, _ in rows:
        t, padded = texts[i], ["<s>"] * (order - 1) + texts[i]
        base = sum(math.log10((plain[w] + 0.1) / (total + 0.1 * (vocabulary + 1))) for w in t)
        score = sum(math.log10(p(order, tuple(padded[k : k + order - 1]), w)) for k, w in enumerate(t))
        out[i] = (held[i], len(t), sum(plain[w] > 0 for w in t), total, base, score)
    return out


@pytest.mark.parametrize("order", [2, 3])
def test_matches_dictionaries(spark, docs, prose, order):
    base = prose(60)
    rows = [(i, prose(40) + " " + " ".join(base.split()[i % 7 :])) for i in range(40)] + [(100, None), (101, ""), (102, "ONE"), (103, "one " * 500)]
    got = {r.doc_id: r for r in lm.lm_score(docs(rows), order=order).collect()}
    for i, want in brute(rows, order).items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[:4]
        assert r.base_score == pytest.approx(want[4], rel=1e-9)
        assert r.score == pytest.approx(want[5], rel=1e-6)


def test_probabilities_sum_to_one(spark, docs, prose):
    import numpy as np

    from codexmill.llm.textcore import U64, Words, text_slices

    texts = [prose(30) for _ in range(10)]
    model = lm.train(docs([(i, t) for i, t in enumerate(texts)]))
    vocabulary = sorted({w for t in texts for w in words_of(t)})
    import pyarrow as pa

    ((_, _, raw, offsets),) = text_slices(pa.array([" ".join(vocabulary)]))
    every = np.append(Words(raw, offsets).hash, lm.END)
    every = np.append(every, U64(12345))  # one unknown word
    words = lm.vocabulary(model, every)
    assert (words[:-1, 0] >= lm.FIRST).all() and words[-1].tolist() == [lm.UNKNOWN, 0, 0] and len(set(words[:, 0])) == len(words)
    for one, two in zip(words[:5, 0], words[5:10, 0]):
        ctx = lm.chain([np.full(len(every), one), np.full(len(every), two)])
        assert lm.probability(model, words, ctx).sum() == pytest.approx(1.0, abs=1e-9)


def test_tables_hold_what_was_stored(tmp_path):
    import numpy as np

    from codexmill.llm.textcore import U64, mix64

    keys = np.sort(mix64(np.arange(1, 60001).astype(U64)))
    keys = keys[keys >> U64(58) == 5]
    counts = np.arange(len(keys)) % 700 + 1
    counts[3] = 1 << 40
    lm.store(str(tmp_path), "g2", 5, 6, keys, [counts])
    model = lm.Model(str(tmp_path), 2, 6, {})
    assert lm.find(model, "g2", keys[::-1], 1)[:, 0].tolist() == counts[::-1].tolist()
    absent = mix64(np.arange(100_000, 160_000).astype(U64))
    assert lm.find(model, "g2", absent, 1).sum() == 0


def test_blocks_keep_their_columns():
    import numpy as np

    from codexmill.llm.textcore import U64

    rng = np.random.default_rng(1)
    ids = [rng.integers(0, m, 500).astype(U64) for m in (9, 70_000, 1 << 33)]
    counts = rng.integers(1, 1 << 20, 500)
    got = lm.unpack_grams(lm.pack_grams(ids, counts))
    assert sorted(zip(*(x.tolist() for x in got))) == sorted(zip(*(x.tolist() for x in [*ids, counts])))


def test_empty_tables_and_repeated_rows(spark, docs):
    assert lm.lm_score(docs([])).count() == 0
    got = lm.lm_score(docs([(1, "a b"), (1, "a b"), (None, "a")])).collect()
    assert len(got) == 3 and all(math.isfinite(r.score) for r in got)


def test_the_query_sees_more_than_one_word_back(spark, docs, prose, tmp_path):
    from codexmill.llm import queries

    base = prose(60).split()
    rows = [(i, " ".join(base[i % 7 :]) + " " + prose(20)) for i in range(40)] + [(100, None), (101, "one " * 300)]
    docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    want = brute(rows, 3)
    got = {r.doc_id: r.score for r in queries.op1_lm_score(spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i][5], rel=1e-6) for i in want)


def test_files_do_not_grow_with_the_shards(spark, docs, prose, tmp_path, monkeypatch):
    import os

    base = prose(60)
    rows = [(i, prose(40) + " " + " ".join(base.split()[i % 7 :])) for i in range(40)] + [(100, None), (101, "one " * 300)]
    few = {r.doc_id: tuple(r) for r in lm.lm_score(docs(rows)).collect()}
    monkeypatch.setattr(lm, "LEAST_BITS", 9)
    model = lm.train(docs(rows).where("crc32(cast(doc_id as string)) % 10 <> 0"), folder=str(tmp_path / "model"))
    assert len(os.listdir(tmp_path / "model")) <= 14 << lm.JOIN and model.bits == 9
    many = {r.doc_id: tuple(r) for r in lm.score(docs(rows), model).collect()}
    assert few.keys() == many.keys() and all(many[i][:5] == few[i][:5] and many[i][5:] == pytest.approx(few[i][5:], rel=1e-9) for i in few)
