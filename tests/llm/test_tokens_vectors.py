import math
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from codexmill.llm import tokenstore, vafile

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")

TEXTS = [None, "", " \n ", "Hello, World!", "don't WON'T it's 's", "naïve Été HÖHE ß ǅ", "é H̱ İ", "<|endoftext|> <|ENDOFTEXT|> a<|endoftext|>b", "x1y22 3.14 ½ ² ٣", "日本語 テキスト", "a b c\x1cd\x85e", "tabs\tand\x0bvt\x0cff\r\n", "(paren) \"quo.te\" -- ... ###", "emoji 😀👍🏽 end", "word " * 3000, "ſ K Å Σίσυφος"]


def test_ids_equal_those_of_whole_texts():
    whole = tokenizers.Tokenizer.from_file(PATH)
    e = tokenstore.Encoder(PATH, 1)
    assert e.exact
    for t in [*TEXTS, *[x.upper() for x in TEXTS if x]]:
        got = np.frombuffer(e.encode((t or "").encode()), e.kind).tolist()
        assert got == [*whole.encode(t or "", add_special_tokens=False).ids, 1], t


def test_store_round_trip(spark, docs, prose):
    rows = [*enumerate(TEXTS), *[(100 + i * 3, prose(i)) for i in range(60)], (None, "no id"), (5, "second of five"), (5, "second of five")]
    whole = tokenizers.Tokenizer.from_file(PATH)
    folder, keys = tokenstore.write_store(docs(rows), PATH)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokenstore.read_store(folder, keys).collect())
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at = 0
    for (start, doc_id, n, crc), (want_id, text) in zip(got, order, strict=True):
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 1]
        assert (start, doc_id, n, crc) == (at, want_id, len(ids), crc32(np.array(ids, "<u4").tobytes()))
        at += n
    store = tokenstore.TokenStore(folder)
    assert store.get(103).tolist() == [*whole.encode(dict(rows)[103], add_special_tokens=False).ids, 1]
    with pytest.raises(KeyError):
        store.get(999_999)


def test_empty_store(spark, docs):
    folder, keys = tokenstore.write_store(docs([]), PATH)
    assert tokenstore.read_store(folder, keys).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 20000])
def test_hash_is_minimal_and_perfect(n):
    h = tokenstore.key_hash(list(range(n)), np.zeros(n, np.int64))
    slots = tokenstore.slots(h, *tokenstore.perfect_hash(h))
    assert sorted(slots.tolist()) == list(range(n))


def best_rows(rows, k=20):
    """[(query_id, rank, vec_id, score)] by comparing all pairs of rows."""
    whole = []
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) and abs(64 * x) < 1 << 63 for x in v):
            whole.append((i, [math.floor(64 * x) for x in v]))
    out = []
    for n, (q, mine) in enumerate(whole):
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(mine, v)), i) for m, (i, v) in enumerate(whole) if m != n and len(v) == len(mine))[:k]
            out += [(q, r, i, -s if abs(s) < 1 << 63 else None) for r, (s, i) in enumerate(best, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("spread", [0.125, 40.0])
def test_top_k_is_exact(spark, monkeypatch, spread):
    monkeypatch.setattr(vafile, "SEGMENT", 64)
    monkeypatch.setattr(vafile, "QUERIES", 3)
    monkeypatch.setattr(vafile, "STEP", 50)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, spread, 16)]) for i in range(400)]
    rows += [(1000 + i, rows[20][1]) for i in range(60)]  # ties
    rows += [(2000, None), (2020, [1.0, None] + [0.0] * 14), (2040, [math.nan] * 16), (2060, [math.inf] + [0.0] * 15), (2080, [0.5] * 3), (2100, []), (None, rows[1][1])]
    rows += [(20, rows[20][1]), (40, rows[7][1]), (2120, [1e30] + [0.0] * 15)]  # repeated ids, and one too large
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("clash"))
    got = sorted(((r.query_id, r.rank, r.vec_id, r.score) for r in vafile.top_k(d, d.vec_id % 20 == 0).collect()), key=str)
    assert got == best_rows(rows)
    assert vafile.top_k(d.limit(0), d.vec_id % 20 == 0).count() == 0


def test_top_k_of_large_components(spark):
    rows = [(0, [5e6, 0.0]), (1, [5e6, 0.0]), (2, [4.9e6, 0.0]), (3, [-5e6, 1.0]), (20, [1e14, 1.0]), (21, [1e14, -1.0]), (22, [1e14, 3e15])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(((r.query_id, r.rank, r.vec_id, r.score) for r in vafile.top_k(d, d.vec_id % 20 == 0, k=3).collect()), key=str)
    assert got == best_rows(rows, 3)
    assert any(r[3] is None for r in got) and (20, 1, 22, None) in got
    few = spark.createDataFrame(rows[:4], "vec_id long, embedding array<double>")
    assert [r.score for r in vafile.top_k(few, few.vec_id % 20 == 0, k=2).orderBy("rank").collect()] == [102400000000000000, 100352000000000000]


def test_bounds_hold_and_few_exact_rows_are_read(tmp_path):
    rng = np.random.default_rng(5)
    rows = rng.integers(-5000, 5000, (3000, 8))
    vafile.Segment.write(str(tmp_path / "s"), np.arange(3000), rows, np.ones(3000, bool))
    seg = vafile.Segment(str(tmp_path / "s"))
    corner = seg.base + seg.cells.astype(np.int64) * seg.width
    assert (corner <= rows).all() and (rows < corner + seg.width).all() and seg.cells.dtype == np.uint8
    reads = []

    class Counted:
        def __getitem__(self, at):
            reads.extend(at.tolist())
            return rows[at]

    seg.rows = Counted()
    ((_, best),) = vafile.search(rows[:1], (seg.path, np.array([0])), [seg], 10)
    scores = sorted((-(rows[1:] @ rows[0])).tolist())[:10]
    assert [-s for _, s in best] == scores and len(reads) < 300
