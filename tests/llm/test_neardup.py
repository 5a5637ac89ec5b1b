import random

import numpy as np
import pyarrow as pa

from codexmill.llm import neardup as nd
from codexmill.llm.textcore import Words, text_slices

from brute import words_of


def brute(rows, percent):
    """{doc_id: (n_shingles, component)} by comparing all pairs."""
    sets = {}
    for i, text in rows:
        w = words_of(text)
        sets[i] = frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)])
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def family(prose, first, n, length, edits, seed):
    """n copies of one text, each with some words replaced."""
    rng = random.Random(seed)
    base = prose(length).split()
    out = []
    for i in range(n):
        w = list(base)
        for k in rng.sample(range(length), rng.randint(*edits)):
            w[k] = f"edit{seed}x{i}x{k}"
        out.append((first + i, " ".join(w)))
    return out


def check(spark, docs, rows, percent=85):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.group(docs(rows), percent).collect()}
    want = brute(rows, percent)
    assert got == want
    return want


def test_groups_match_brute_force(spark, docs, prose):
    rows = family(prose, 0, 70, 140, (0, 6), 1) + family(prose, 100, 40, 60, (1, 4), 2) + family(prose, 200, 30, 300, (8, 16), 3)
    rows += [(300 + i, prose(80)) for i in range(30)] + [(400 + i, rows[5][1]) for i in range(20)]
    want = check(spark, docs, rows)
    assert len({c for _, c in want.values()}) > 40
    check(spark, docs, rows, 80)


def test_pivots_beyond_small_buckets(spark, docs, prose, monkeypatch):
    monkeypatch.setattr(nd, "SMALL_BUCKET", 4)
    check(spark, docs, family(prose, 0, 60, 100, (0, 5), 9) + family(prose, 100, 30, 100, (3, 9), 8))


def test_edge_cases(spark, docs):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One"), (5, "one"), (6, "a b c d e"), (7, "A B C D E"), (8, "b"), (9, "x " * 20000)]
    check(spark, docs, rows)
    same = docs([(1, "p q r"), (1, "p q r"), (1, "other words"), (None, "p q r"), (2, "other words")])
    got = sorted(((r.doc_id or -1, r.component_id, r.kept) for r in nd.group(same).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (1, 1, True), (-1, 1, False), (2, 1, False)], key=str)
    kept = nd.drop_duplicates(same).collect()
    assert len(kept) <= 2 and {r.doc_id for r in kept} == {1}
    assert nd.group(docs([])).count() == 0
    assert nd.drop_duplicates(docs([])).count() == 0


def test_one_row_of_each_group_stays(spark, docs, prose):
    rows = family(prose, 10, 20, 100, (0, 1), 4) + [(1, ""), (2, None), (3, prose(50))] + [(3, "x y z")]
    kept = sorted(r.doc_id for r in nd.drop_duplicates(docs(rows)).collect())
    assert kept == [1, 2, 3, 10]


def test_signature_estimates_similarity(prose):
    a = prose(400).split()
    errors = []
    for share in (0, 4, 10, 25):
        b = list(a)
        for k in range(share):
            b[k * (len(a) // max(share, 1))] = f"z{k}"
        sets, sigs = [], []
        for _, _, raw, offsets in text_slices(pa.array([" ".join(a), " ".join(b)])):
            h, doc, first = nd.distinct_shingles(Words(raw, offsets))
            sigs = nd.superminhash(h, doc, 2)
            sets = [set(h[first[i] : first[i + 1]].tolist()) for i in range(2)]
        true = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        errors.append(abs(float(np.mean(sigs[0] == sigs[1])) - true))
    assert max(errors) < 0.2
    assert (sigs < np.iinfo(np.uint64).max).all()


def test_extra_columns_are_kept(spark, docs, prose):
    from pyspark.sql import functions as F

    d = docs([(1, prose(30)), (2, prose(30))]).withColumn("set_id", F.lit(1)).withColumn("bands", F.lit("x"))
    assert nd.drop_duplicates(d).columns == d.columns
    assert nd.group(d).count() == 2


def test_columns_of_any_name_are_kept(spark, docs, prose):
    from pyspark.sql import functions as F

    text = prose(30)
    d = docs([(1, text), (1, text), (2, text + " x"), (1, prose(30)), (None, text)])
    names = ("_doc_id", "_text_key", "_id", "_key", "component_id", "kept", "_stay", "_rows")
    for name in names:
        d = d.withColumn(name, F.lit(f"user's {name}"))
    kept = nd.drop_duplicates(d, 80)
    assert kept.columns == d.columns
    assert kept.count() == 1 and all(r[n] == f"user's {n}" for r in kept.collect() for n in names)


def test_nothing_fits_a_broadcast(spark, docs, prose, monkeypatch):
    monkeypatch.setattr(nd.common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(nd.common, "HOT_ROWS", 5)
    rows = family(prose, 0, 30, 80, (0, 3), 1) + [(100 + i, prose(1) if i % 2 else None) for i in range(9)] + [(200 + i, "a b c d e f") for i in range(9)]
    check(spark, docs, rows)


def test_many_rows_of_one_id(spark, docs, prose, monkeypatch):
    """Texts meet the classes that they lead, not all classes of their id."""
    rows = [(None, t) for _, t in family(prose, 0, 300, 60, (0, 2), 7)] * 2 + [(None, prose(30)) for _ in range(400)] + [(5, prose(30)), (5, prose(40))]
    seen = []
    written = nd.common.written
    monkeypatch.setattr(nd.common, "written", lambda df, label="cut": seen.append((label, out.count())) or out if (out := written(df, label)) is not None else None)
    got = nd.group(docs(rows)).collect()
    assert len(got) == len(rows) and all(r.component_id is None or r.component_id == 5 for r in got)
    assert dict(seen)["sets"] <= 300
    assert max(n for _, n in seen) < 40 * len(rows)
    named = brute(list(enumerate(t for _, t in rows)), 85)
    kept = nd.drop_duplicates(docs(rows), percent=85).count()
    assert kept == len({c for _, c in named.values()}) - 1  # the two texts of id 5 are one document


def test_few_jobs_and_broadcasts(spark, docs, prose, monkeypatch):
    """What the driver holds follows the jobs and broadcasts: no table is measured that another
    bounds, and nothing has a wider bound than BROADCAST_BYTES (133 jobs before, 100 now)."""
    rows = family(prose, 0, 70, 60, (0, 2), 1) + family(prose, 100, 40, 60, (1, 4), 2) + [(300 + i, prose(80)) for i in range(30)]
    bounds, fits = [], nd.common.fits
    monkeypatch.setattr(nd.common, "fits", lambda df, bound=None: bounds.append(bound) or fits(df, bound))
    spark.sparkContext.setJobGroup("few-jobs", "near duplicates")
    try:
        assert nd.drop_duplicates(docs(rows), 80).count() < 100
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-jobs"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 120
    assert sum(b is not None for b in bounds) >= 8 and max(b or 0 for b in bounds) < nd.common.BROADCAST_BYTES
