"""The stored vector index against all distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from codexmill.operators import vectors as W


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(40, 16)) * 4
    return [(i, i % 3, [float(x) for x in middles[i % 40] + rng.normal(size=16)]) for i in range(3000)]


def brute(rows, query, k, keep=lambda r: True):
    each = sorted((round(float(((np.array(v) - query) ** 2).sum()), 6), i) for i, g, v in rows if keep((i, g, v)))
    return [(i, d) for d, i in each[:k]]


def test_search_look_up_upsert_and_purge(spark, cloud, tmp_path):
    kind = "k long, g int, v array<double>"
    index = W.build(spark.createDataFrame(cloud, kind), "k", "v", str(tmp_path), ["g"])
    assert len(index.centroids) == 55
    rng, hits = np.random.default_rng(5), 0
    for n in range(12):
        q = np.array(cloud[n * 200][2]) + rng.normal(size=16) / 3
        want = brute(cloud, q, 20)
        if n < 4:
            assert [tuple(r) for r in W.nearest(spark, index, q.tolist(), 20).collect()] == want
        near = {r.k for r in W.nearest(spark, index, q.tolist(), 20, probes=8, exact=False).collect()}
        hits += len(near & {i for i, _ in want})
    assert hits >= 0.9 * 12 * 20
    read = lambda df: len(df.inputFiles())
    assert read(W.fetch(spark, index, [3, 43])) < 8 < read(index.rows(spark, list(range(55))))
    changed = [(5, 9, [9.0] * 16), (7000, 9, [9.5] * 16), (7001, 9, None), (7002, 9, [1.0]), (7003, 9, [float("nan")] * 16)]
    index = W.purge(W.upsert(index, spark.createDataFrame(changed, kind)), spark.createDataFrame([(6,), (99999,)], "k long"))
    now = [r for r in cloud if r[0] not in (5, 6)] + changed[:2]
    q = np.full(16, 9.0)
    assert [tuple(r) for r in W.nearest(spark, index, q.tolist(), 5).collect()] == brute(now, q, 5)
    only = W.nearest(spark, index, q.tolist(), 5, where=F.col("g") == 1)
    assert [tuple(r) for r in only.collect()] == brute(now, q, 5, lambda r: r[1] == 1)
    got = {r.k: list(r.v) for r in W.fetch(spark, index, [5, 6, 7, 7000, 7001]).collect()}
    assert got == {5: [9.0] * 16, 7: cloud[7][2], 7000: [9.5] * 16}


def test_odd_tables(spark, tmp_path):
    kind = "k long, v array<double>"
    none = W.build(spark.createDataFrame([], kind), "k", "v", str(tmp_path / "a"))
    assert W.nearest(spark, none, [1.0], 3).count() == W.fetch(spark, none, [1]).count() == 0
    same = W.build(spark.createDataFrame([(i, [1.0, 2.0]) for i in (4, 2, 9, 2)], kind), "k", "v", str(tmp_path / "b"))
    assert [tuple(r) for r in W.nearest(spark, same, [1.0, 2.0], 3).collect()] == [(2, 0.0), (2, 0.0), (4, 0.0)]
