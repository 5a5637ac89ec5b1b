import hashlib
import random
import re
from zlib import crc32

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from codexmill.llm import periodic, queries
from codexmill.llm.textcore import text_slices, Words

import pyarrow as pa


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(w, least=12):
    """All runs by comparing words, period by period."""
    out = {}
    for p in range(1, len(w) // 2 + 1):
        j = 0
        while j + p < len(w):
            if w[j] != w[j + p]:
                j += 1
                continue
            e = j
            while e + p < len(w) and w[e] == w[e + p]:
                e += 1
            if e + p - j >= max(least, 2 * p):
                out.setdefault((j, e + p), p)
            j = e + 1
    return sorted((s, e - s, p) for (s, e), p in out.items())


def looped(doc_id, w):
    h = crc32(b"" if doc_id is None else str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    w = looped(doc_id, split(text))
    runs = brute(w)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *best, best[1] * 1000 // best[2] if runs else None, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def kernel(texts, least=12):
    ((_, _, raw, offsets),) = text_slices(pa.array(texts))
    got = periodic.runs_of(Words(raw, offsets, lower=False), least)
    return [[tuple(r[1:]) for r in got.T.tolist() if r[0] == i] for i in range(len(texts))]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=70), min_size=1, max_size=4), st.integers(2, 14))
def test_runs_of_two_letters(words, least):
    texts = [" ".join(w) for w in words]
    assert kernel(texts, least) == [brute(list(w), least) for w in words]


def test_runs_across_pieces(monkeypatch):
    monkeypatch.setattr(periodic, "PAIRS", 50)
    rng = random.Random(3)
    texts = []
    for _ in range(40):
        w = []
        while len(w) < 150:
            w += [rng.choice("abcd") for _ in range(rng.randint(1, 9))] * rng.randint(1, 6)
        texts.append(" ".join(w))
    assert kernel(texts) == [brute(split(t)) for t in texts]


def test_long_words_that_differ_late():
    w = ["x" * 30 + "a", "x" * 30 + "b"] * 10 + ["x" * 30 + "c"]
    assert kernel([" ".join(w)]) == [[(0, 20, 2)]]


def test_hash_clash_is_found(monkeypatch):
    texts = ["a b c d e f g h i j k l m n", "a b " * 9]
    ((_, _, raw, offsets),) = text_slices(pa.array(texts))
    words = Words(raw, offsets, lower=False)
    words.hash = np.zeros(len(words.hash), np.uint64)  # all words meet
    assert periodic.runs_of(words).T.tolist() == [[1, 0, 18, 2]]


def test_query_matches_brute_force(spark, docs, prose, tmp_path):
    rng = random.Random(11)
    rows = [(i, prose(rng.randint(0, 160))) for i in range(60)]
    rows += [(100 + i, " ".join(prose(rng.randint(1, 7)).split() * rng.randint(2, 9) + prose(20).split())) for i in range(40)]
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "É é É " * 13), (204, "a\x0bb\nc " * 5), (None, prose(50)), (None, None), (7, rows[7][1]), (300, "same " * 3000)]
    docs(rows).withColumnRenamed("lang", "runs").withColumnRenamed("source", "collapsed").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op11_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted((expected(*r) for r in rows), key=key)
    docs([]).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert queries.op11_periodic_runs(spark, str(tmp_path / "none")).count() == 0


def test_text_ids_keep_their_type(spark):
    got = periodic.repeats(spark.createDataFrame([("x-1", "go on " * 9)], "doc_id string, text string")).first()
    assert (got.doc_id, got.n_words, [tuple(r) for r in got.runs], got.collapsed) == ("x-1", 18, [(0, 18, 2)], "go on")
