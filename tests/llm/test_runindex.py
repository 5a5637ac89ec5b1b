import hashlib
import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from codexmill.llm import queries, runindex


def brute(texts, length):
    """Covered places of each text, by counting all windows."""
    raw = [(t or "").encode() if not isinstance(t, bytes) else t for t in texts]
    count = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append((r, gone))
    return out


def spans_of(gone):
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def expected(rows, length=200):
    out = []
    for (doc_id, _), (raw, gone) in zip(rows, brute([t for _, t in rows], length)):
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        out.append((doc_id, len(raw), int(gone.sum()), len(spans_of(gone)), hashlib.sha256(kept).hexdigest()))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab", max_size=60), min_size=1, max_size=6), st.integers(1, 12))
def test_index_of_two_letters(texts, length):
    parts = [t.encode() for t in texts]
    assert runindex.repeated(parts, length) == [spans_of(g) for _, g in brute(parts, length)]


def test_matching_statistics_and_samples():
    parts = [b"abracadabra" * 4, b"cadabraabra", b"zz", b"xabracadabrax"]
    data = np.frombuffer(b"".join(parts), np.uint8)
    offsets = np.cumsum([0, *map(len, parts)])
    index = runindex.RunIndex(data, offsets)
    rests = [(p[i:], n, i) for n, p in enumerate(parts) for i in range(len(p))]
    same = lambda a, b: next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
    assert index.statistics().tolist() == [max(same(a, b) for b, *y in rests if y != x) for a, *x in rests]
    assert len(index.length) < int(index.length.sum()) == len(data) + len(parts)  # runs are fewer than rows


def test_suffixes_are_in_order():
    rng = random.Random(1)
    for n, letters in ((1, 1), (50, 2), (3000, 3), (900, 1), (400, 0)):
        parts = [bytes(rng.randint(0, letters) for _ in range(rng.choice((0, 3, 9, 60)))) for _ in range(n // 30 + 2)]
        line = [x for i, p in enumerate(parts) for x in [*(b + len(parts) for b in p), i]]
        got = runindex.suffixes(np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])).tolist()
        assert got == sorted(range(len(line)), key=lambda i: line[i:])


def test_agreement_of_long_and_unlike_stretches():
    data = np.frombuffer(b"q" * 200_000 + b"r" + b"q" * 150_000 + b"s" + b"q" * 5, np.uint8)
    a, b = np.array([0, 0, 3, 199_999]), np.array([200_001, 1, 350_002, 200_000])
    most = len(data) - np.maximum(a, b)
    assert runindex.agreed(data, a, b, most).tolist() == [150_000, 199_999, 5, 0]


def test_segments_hold_every_window_once():
    rng = random.Random(2)
    for k in (8, 20, 39, 40):
        texts = [bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 400))) for _ in range(12)] + [b"a" * 300, b"ab" * 200, b""]
        data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
        name, begin, end, twice = runindex.segments(data, offsets, k, 40)
        seen, where = Counter(), {}
        for n, a, b, t in zip(name.tolist(), begin.tolist(), end.tolist(), twice.tolist()):
            windows = [bytes(data[i : i + 40]) for i in range(a, b - 39)]
            seen.update(range(a, b - 39))
            for w in windows:
                assert where.setdefault(w, n) == n  # equal windows have one name
            assert t or len(set(windows)) == len(windows)
        assert seen == Counter(i for a, b in zip(offsets, offsets[1:]) for i in range(a, b - 39))


def run(spark, docs, rows, path):
    docs(rows).withColumnRenamed("lang", "row").withColumnRenamed("source", "spans").write.parquet(f"{path}/documents.parquet")
    got = queries.op12_repeated_substrings(spark, str(path))
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return order(map(tuple, got.collect()))


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def corpus(prose):
    rng = random.Random(6)
    passage, line, short = prose(60), prose(24)[:150], prose(60)[:199]
    rows = [(i, prose(rng.randint(1, 300))) for i in range(40)]
    rows += [(100 + i, f"{prose(30)} {passage} {prose(rng.randint(1, 90))}") for i in range(12)]
    rows += [(200 + i, f"{prose(30)}\n{line}\n{prose(40)}") for i in range(30)]
    rows += [(250 + i, f"{i}{short}{i}") for i in range(5)]
    base = prose(200).split()
    rows += [(300 + i, " ".join("edit" if j == 7 * i else w for j, w in enumerate(base))) for i in range(20)]
    rows += [(400 + i, rows[3][1]) for i in range(5)]
    accents = base[:90]
    rows += [(600 + i, " ".join("édité" if j == 9 * i else w.replace("e", "é").replace("n", "語") for j, w in enumerate(accents))) for i in range(10)]
    half = prose(80)
    rows += [(500, f"{half} {half}"), (501, "a" * 900), (502, "a" * 205), (503, "b" * 200), (504, "b" * 199), (505, "xy" * 150), (506, "é" * 130), (507, prose(50) + "é" * 99 + "ü"), (508, None), (509, ""), (None, passage), (None, None), (7, rows[7][1])]
    return rows


def test_query_matches_brute_force(spark, docs, prose, tmp_path):
    rows = corpus(prose)
    assert run(spark, docs, rows, tmp_path / "x") == order(expected(rows))
    assert run(spark, docs, [], tmp_path / "none") == []
    assert run(spark, docs, [(1, "short"), (2, None)], tmp_path / "short") == order(expected([(1, "short"), (2, None)]))


def test_names_that_many_segments_share(spark, docs, prose, monkeypatch):
    """With a tiny bound nearly all names are named again, down to whole windows."""
    monkeypatch.setattr(runindex, "SHARED", 900)
    rows = corpus(prose)
    got = [(r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in runindex.drop_repeats(docs(rows)).collect()]
    want = [(i, len(raw), spans_of(g), bytes(np.frombuffer(raw, np.uint8)[~g])) for (i, _), (raw, g) in zip(rows, brute([t for _, t in rows], 200))]
    assert order(got) == order(want)


def test_texts_longer_than_a_piece(prose, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(runindex, "PIECE", 500)
    text = prose(400)
    batch = pa.record_batch([pa.array([5, 6]), pa.array([text.encode(), b"x" * 250])], ["row", "bytes"])
    got = [r for b in runindex._emit(32, 200)(iter([batch])) for r in b.to_pylist()]
    windows = Counter(i for r in got if r["row"] == 5 for i in range(r["begin"], r["begin"] + r["size"] - 199))
    assert windows == Counter(range(len(text.encode()) - 199))
    assert sum(r["size"] - 199 for r in got if r["row"] == 6) == 51
