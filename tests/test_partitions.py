"""Agreement of two partitions against all pairs."""

import random
from itertools import combinations

import duckdb
import pytest

from codexmill import queries as own
from codexmill.operators import partitions as H


@pytest.mark.parametrize("n", [0, 1, 40])
def test_agreement_over_all_pairs(spark, n):
    rng = random.Random(n)
    a = {i: rng.randint(100, 104) for i in range(n) if rng.random() < 0.8}
    b = {i: rng.randint(200, 206) for i in range(n) if rng.random() < 0.8}
    frame = lambda g: spark.createDataFrame(list(g.items()), "k long, g long")
    rows = spark.createDataFrame([(i,) for i in range(n)], "k long")
    table = H.contingency(rows, frame(a), frame(b), "k", "g")
    x, y = ({i: g.get(i, i) for i in range(n)} for g in (a, b))
    pairs = [(x[i] == x[j], y[i] == y[j]) for i, j in combinations(range(n), 2)]
    got = H.agreement(table).first()
    parts = lambda p, q: sum(len({q[i] for i in p if p[i] == g}) > 1 for g in set(p.values()))
    assert (got.rows, got.groups_a, got.groups_b, got.splits, got.merges) == (n, len(set(x.values())), len(set(y.values())), parts(x, y), parts(y, x))
    assert (got.pairs_a, got.pairs_b, got.pairs_both) == (sum(p for p, _ in pairs), sum(q for _, q in pairs), sum(p and q for p, q in pairs))
    assert got.rand == pytest.approx(sum(p == q for p, q in pairs) / len(pairs) if pairs else 1)
    assert H.parted(table, "a", "b").count() == got.splits


@pytest.mark.parametrize(
    "rows,want",
    [
        # copies with no other neighbour, copies of a linked vector, and one without any link
        ([(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 2), (3, [0.0, 1.0], 3), (4, [0.1, 1.0], 3), (5, [0.1, 1.0], 4), (6, [0.1, 1.0], 4), (7, [-1.0, 0.0], 5)], [(1, 2, 2, 1), (3, 4, 2, 2)]),
        # a key with two vectors links the copies of both; zeros of either sign are equal
        ([(5, [1.0, 0.0, 0.0], 1), (9, [1.0, 0.0, 0.0], 1), (9, [0.0, 1.0, 0.0], 2), (11, [-0.0, 1.0, 0.0], 2)], [(5, 4, 2, 2)]),
        # components that are null count as none; labels that are null are one label
        ([(1, [1.0, None], 1), (2, [1.0, None], 2), (3, [1.0, 0.1], 1), (4, [0.0, 1.0], None), (5, [0.0, 1.0], None)], [(1, 3, 2, 2)]),
        # vectors and keys that are missing have no copies
        ([(1, None, 1), (2, None, 2), (3, [], 1), (4, [], 2), (None, [1.0, 0.0], 1), (None, [1.0, 0.0], 2), (5, [1.0, 0.0], 3)], [(None, 2, 2, None)]),
    ],
)
def test_splits_of_copies(spark, tmp_path, rows, want):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = own.queries()["linkage_splits"](spark, str(tmp_path)).select("group", "members", "parts", "largest")
    assert sorted(map(tuple, got.collect()), key=repr) == want
    with duckdb.connect() as c:
        c.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
        assert sorted(c.execute(own.oracle_sql()["linkage_splits"]).fetchall(), key=repr) == want


def test_copies_of_vectors_without_a_norm(spark, tmp_path):
    rows = [(1, [0.0, 0.0], 1), (2, [0.0, 0.0], 2), (3, [float("nan"), 1.0], 1), (4, [float("nan"), 1.0], 2)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert own.queries()["linkage_splits"](spark, str(tmp_path)).count() == 0
