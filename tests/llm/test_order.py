"""Sharding and mixing."""

from collections import Counter, defaultdict
from zlib import crc32

import pytest
from brute import words_of
from pyspark.sql import functions as F

from codexmill.llm import mixing, sharding


def test_shards_match_prefix_sums(spark, docs, prose):
    rows = [(i * 7 % 300, prose(i % 40)) for i in range(300)] + [(500, None), (501, ""), (None, "x"), (7, "again"), (502, "y" * 60000)]
    got = sharding.assign(docs(rows), 24).collect()
    order = sorted((-1 if i is None else i, crc32((t or "").encode()), len((t or "").encode()) + 8) for i, t in rows)
    total, before, want, slot = sum(x[2] for x in order), 0, [], Counter()
    for i, crc, size in order:
        s = min(23, (2 * before + size) * 24 // (2 * total))
        want.append((i, size, crc, s, slot[s]))
        slot[s] += 1
        before += size
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got) == sorted(want)


def test_shards_are_balanced_and_gapless(spark, docs, prose):
    got = sharding.assign(docs([(i, prose(20 + i % 9)) for i in range(600)]), 8).collect()
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in got:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r.size for r in got)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shard_rows_keep_columns_and_repeats(spark, docs):
    d = docs([(i % 5, "same") for i in range(40)] + [(None, None)]).withColumn("shard", F.lit("clash"))
    got = sharding.shard_rows(d, 4)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "text_crc32", "shard", "slot"]
    rows = got.collect()
    assert len(rows) == 41 and sorted((r.shard, r.slot) for r in rows) == sorted((r.shard, r.slot) for r in sharding.assign(d, 4).collect())
    assert sharding.assign(docs([]), 4).count() == 0


def water(sizes, weights, share=1.5, most=2):
    """Targets by resharing the excess round after round."""
    total = sum(sizes) * share
    target, full = [0.0] * len(sizes), set()
    while True:
        left = total - sum(most * sizes[i] for i in full)
        w = sum(weights[i] for i in range(len(sizes)) if i not in full)
        target = [most * sizes[i] if i in full else left * weights[i] / w for i in range(len(sizes))]
        over = {i for i in range(len(sizes)) if i not in full and target[i] > most * sizes[i] + 1e-9}
        if not over:
            return target
        full |= over
        if len(full) == len(sizes):
            return [most * s for s in sizes]


@pytest.fixture(scope="module")
def mixture(prose):
    rows, i = [], 0
    for source, n in (("a", 200), ("b", 10), ("c", 60), ("d", 3), (None, 40)):
        for _ in range(n):
            rows.append((i, prose(1 + (i * 37) % 90), source))
            i += 1
    return [*rows, (i, None, "a"), (i + 1, "", "b"), (0, rows[0][1], "a")]


def test_mix_meets_targets(spark, docs, mixture):
    got = mixing.plan(docs(mixture)).collect()
    assert len(got) == len(mixture)
    sizes = Counter()
    for _, t, s in mixture:
        sizes[s] += len(words_of(t))
    names = sorted((s for s in sizes if s is not None)) + [None]
    want = dict(zip(names, water([sizes[s] for s in names], [(3, 1, 2)[k % 3] for k in range(len(names))])))
    taken, largest = Counter(), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - want[s]) <= 2 * largest[s] for s in names)
    again = sorted((r.doc_id, r.taken) for r in mixing.plan(docs(list(reversed(mixture)))).collect())
    assert again == sorted((r.doc_id, r.taken) for r in got)


def test_mix_rows_emit_the_plan(spark, docs, mixture):
    d = docs(mixture).withColumn("size", F.lit("clash"))
    want = Counter()
    for r in mixing.plan(d).collect():
        want[r.doc_id] += r.copies
    got = mixing.mix_rows(d)
    assert got.columns == d.columns
    assert Counter(r.doc_id for r in got.collect()) == +want


def test_mix_edge_tables(spark, docs):
    assert mixing.plan(docs([])).count() == 0
    only = mixing.plan(docs([(1, None), (2, "")])).collect()
    assert all((r.target, r.taken) == (0.0, 0) for r in only)
    assert mixing.mix_rows(docs([(1, None)])).count() == 0


def clash(d, *names):
    for name in names:
        d = d.withColumn(name, F.lit(f"user's {name}"))
    return d


def test_columns_of_any_name_are_kept(spark, docs, mixture):
    names = ("_crc", "_copies", "_rows", "_id", "_source", "_TIMES", "number", "row_index", "shard", "_none", "_skip", "_first")
    d = clash(docs(mixture[:40] + [mixture[0]] * 3), *names)
    mixed = mixing.mix_rows(d)
    assert mixed.columns == d.columns and mixed.count() > 0
    assert all(r[n] == f"user's {n}" for r in mixed.collect() for n in names)
    placed = sharding.shard_rows(d, 4)
    kept = [n for n in names if n != "shard"]
    assert placed.count() == 43 and all(r[n] == f"user's {n}" for r in placed.collect() for n in kept)
    assert sorted(r.shard for r in placed.collect()) == sorted(r.shard for r in sharding.assign(d, 4).collect())


def test_many_sources(spark, docs):
    rows = [(i, "w " * (i % 7 + 1), f"host{i % 97}") for i in range(500)]
    got = {r.source: r for r in mixing.plan(docs(rows)).collect()}
    names = sorted({s for _, _, s in rows})
    sizes = [sum(len(words_of(t)) for _, t, s in rows if s == n) for n in names]
    want = water(sizes, [(3, 1, 2)[k % 3] for k in range(len(names))])
    assert all(got[n].target == pytest.approx(w) and got[n].source_size == z for n, w, z in zip(names, want, sizes))


def test_mix_of_texts_with_one_checksum(spark, docs):
    """Different texts of equal crc32 under a null id keep the planned number of rows."""
    import random
    from zlib import crc32

    seen, pair, rng = {}, None, random.Random(1)
    while pair is None:
        text = "%014x x" % rng.getrandbits(56)
        if (other := seen.setdefault(crc32(text.encode()), text)) != text:
            pair = (other, text)
    rows = [(None, pair[i % 2], "a") for i in range(5)] + [(None, pair[0], "b"), (1, "one two three", "b")]
    d = docs(rows).withColumn("extra", F.monotonically_increasing_id())
    planned = Counter()
    for r in mixing.plan(d).collect():
        planned[r.doc_id, r.source] += r.copies
    got = mixing.mix_rows(d)
    first = sorted(map(str, got.collect()))
    assert Counter((r.doc_id, r.source) for r in got.collect()) == +planned
    assert first == sorted(map(str, mixing.mix_rows(d.repartition(7)).collect()))
