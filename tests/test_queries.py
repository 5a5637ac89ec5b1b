"""Every query with SQL against DuckDB on the smallest tables, and the others for shape."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from codexmill import queries as own

SF = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return round(v, 6) if math.isfinite(v) else str(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v.isoformat() if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"create view {name.split('.')[0]} as select * from '{SF}/{name}'")
    return c


def linkage(spark, changed=None):
    """(class -> cluster, edges) of the vectors by plain loops; of what `changed` reaches if given."""
    import numpy as np

    seen = {}
    for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect():
        v = tuple(r.embedding)
        seen[v] = min(r.vec_id, seen.get(v, r.vec_id))
    ids = sorted(seen.values())
    at = {i: np.array(v, float) for v, i in seen.items()}
    edges = {}
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            s = round(float(at[a] @ at[b] / (np.linalg.norm(at[a]) * np.linalg.norm(at[b]))), 9)
            if s >= 0.33:
                edges[a, b] = s
    group = {x: {x} for p in edges for x in p}
    pair = lambda a, b: min(edges.get((min(x, y), max(x, y)), -1) for x in group[a] for y in group[b])
    sims = {(a, b): edges[a, b] for a, b in edges}
    while sims:
        _, (a, b) = min((-s, p) for p, s in sims.items())
        group[a] |= group.pop(b)
        for x in group:
            if x != a:
                sims[min(a, x), max(a, x)] = pair(a, x)
        sims = {p: s for p, s in sims.items() if b not in p and s >= 0.33}
    return {x: min(g) for g in group.values() for x in g}, edges


def brute_clusters(spark):
    clusters, edges = linkage(spark)
    out = []
    for c in set(clusters.values()):
        members = sorted(x for x in clusters if clusters[x] == c)
        inside = [edges[a, b] for n, a in enumerate(members) for b in members[n + 1 :]]
        mean, least = (round(sum(inside) / len(inside), 6), round(min(inside), 6)) if inside else (1.0, 1.0)
        out.append({"cluster": c, "members": len(members), "mean_similarity": mean, "min_similarity": least, "reason": "size" if len(members) > 5 else "chain" if least < 0.55 else "cohesion" if mean < 0.6 else None})
    return out


def brute_affected(spark):
    clusters, edges = linkage(spark)
    near = {}
    for a, b in [*edges, *clusters.items()]:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    todo = [r.vec_id for r in spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 7 = 0").collect()]
    reach = set()
    while todo:
        x = todo.pop()
        if x not in reach:
            reach.add(x)
            todo += near.get(x, ())
    return [{"class": x} for x in reach]


#: Queries beyond SQL, held against plain loops.
BRUTE = {"cosine_clusters": brute_clusters, "affected_clusters": brute_affected}


@pytest.mark.parametrize("name", list(own.queries()))
def test_query(spark, duck, name):
    df = own.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    sql = own.oracle_sql().get(name)
    assert sql or name in BRUTE, f"{name} is held against nothing"
    if sql is None:
        want = [tuple(norm(r[c]) for c in columns) for r in BRUTE[name](spark)]
    else:
        r = duck.execute(sql)
        names = [d[0] for d in r.description]
        assert sorted(names) == columns
        want = [tuple(norm(x[names.index(c)]) for c in columns) for x in r.fetchall()]
    assert got == sorted(want, key=repr)
