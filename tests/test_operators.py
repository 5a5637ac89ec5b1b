import json

from pyspark.sql import functions as F

from codexmill.operators import access as A
from codexmill.operators import cluster as K
from codexmill.operators import folds as D
from codexmill.operators import incremental as I
from codexmill.operators import ledger as L
from codexmill.operators import resolve as E
from codexmill.operators import retrieval as R
from codexmill.operators import rules as U


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_keyword_weights_and_filter_before_limit(spark):
    d = spark.createDataFrame([(1, "alpha", "beta"), (2, "", "alpha alpha"), (3, "alpha alpha", ""), (4, "x", "y")], "id int, head string, body string")
    got = R.keyword_search(d, "id", F.col("head"), F.col("body"), "alpha", 2)
    assert [tuple(r) for r in got.collect()] == [(3, 6.0), (1, 3.0)]
    got = R.keyword_search(d, "id", F.col("head"), F.col("body"), "alpha", 2, F.col("id") != 3)
    assert [r.id for r in got.collect()] == [1, 2]
    assert R.keyword_search(d, "id", F.col("head"), F.col("body"), "!", 2).count() == 0


def test_keyword_counts_do_not_overlap(spark):
    d = spark.createDataFrame([(1, "aaaa", "")], "id int, head string, body string")
    assert R.keyword_search(d, "id", F.lit(""), F.col("head"), "aa", 1).first().score == 2.0


def test_enumerate_numbers_before_text_and_pages(spark):
    d = spark.createDataFrame([("a", "10"), ("b", "9"), ("c", "zz"), ("d", "9"), (None, "5")], "uid string, v string")
    order = [r.uid for r in R.enumerate_rows(d, "uid", F.col("v"), F.lit(True)).collect()]
    assert order == ["a", "b", "d", "c"]
    page = R.enumerate_rows(d, "uid", F.col("v"), F.lit(True), 2, after=R.cursor(1, 9.0, "", "b"))
    assert [r.uid for r in page.collect()] == ["d", "c"]


def test_cosine_zero_on_mismatch(spark):
    d = spark.createDataFrame([([1.0, 0.0], [1.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    r = d.select(R.cosine(F.col("a"), F.col("a")), R.cosine(F.col("a"), F.col("b")), R.cosine(F.col("a"), F.col("z"))).first()
    assert tuple(r) == (1.0, 0.0, 0.0)


def test_access_fails_closed(spark):
    d = spark.createDataFrame([(1, "open", None), (2, None, ["x"]), (3, "internal", ["y"]), (4, None, None)], "id int, access string, aud array<string>")
    got = d.where(A.authorized(F.col("access"), F.col("aud"), ["x"])).select("id")
    assert rows(got, "id") == [(1,), (2,)]


def test_duplicates_first_signal_and_name_bucket(spark):
    d = spark.createDataFrame([(1, "a", None, "n", 0.0), (2, "a", "l", "n", 5.0), (3, None, "l", "m", 1.0), *[(10 + i, None, None, "common", 0.0) for i in range(4)]], "uid int, apollo string, linkedin string, name string, warm double")
    got = E.duplicates(d, ["apollo", "linkedin"], "name", ["warm"])
    assert rows(got, "absorbed", "canonical", "signal") == [(1, 2, "apollo"), (3, 2, "linkedin")]


def test_longest_prefix(spark):
    d = spark.createDataFrame([("m-1-x",), ("m-2",), ("z",)], "model string")
    rates = spark.createDataFrame([("m", 1.0), ("m-1", 2.0)], "prefix string, rate double")
    got = E.longest_prefix(d, "model", rates, "prefix", [1, 3])
    assert {r.model: r.rate for r in got.collect()} == {"m-1-x": 2.0, "m-2": 1.0, "z": None}


def test_fold_drops_retracted_and_keeps_latest(spark):
    o = spark.createDataFrame([(1, "k", 1, "a"), (2, "k", 2, "b"), (3, "k", 3, "c")], "id int, key string, at int, v string")
    gone = spark.createDataFrame([(3,)], "id int")
    assert rows(D.fold_observations(o, gone, "id", ["key"], ["at", "id"]), "key", "v") == [("k", "b")]


def test_streaks_reset_on_success(spark):
    d = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("a", 3, True), ("a", 4, True), ("b", 1, False)], "k string, seq int, bad boolean")
    assert rows(D.streaks(d, "k", F.col("bad"), "seq"), "k", "failures") == [("a", 2)]


def test_delta_equals_full(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, t string")
    new = spark.createDataFrame([(1, "a"), (2, "B"), (4, "d")], "id int, t string")
    before, after = I.manifest(old, "id", F.col("t")), I.manifest(new, "id", F.col("t"))
    changes = I.delta(before, after, "id")
    assert rows(changes, "id", "change") == [(2, "changed"), (3, "removed"), (4, "added")]
    assert rows(I.apply_delta(before, changes, after, "id"), "id", "hash") == rows(after, "id", "hash")


def test_rules_first_match_and_observe(spark):
    d = spark.createDataFrame([("a", "x.md"), ("b", "y.txt"), ("c", "z")], "kind string, name string")
    rules = [U.Rule("2", "emit", globs={"name": "*.md"}), U.Rule("1", "skip", equals={"kind": "a"}), U.Rule("3", "rollup", within={"kind": ("b",)}, live=False)]
    got = U.apply_rules(d, rules, {c: F.col(c) for c in d.columns})
    assert rows(got, "kind", "disposition") == [("a", "skip"), ("b", "observed-rollup"), ("c", "no-match")]


def test_rule_values(spark):
    d = spark.createDataFrame([(["b", "b", "a"], ["a"], "2024-01-02T23:00:00+05:00")], "x array<string>, y array<string>, d string")
    row = {c: F.col(c) for c in d.columns}
    r = d.select(U.value({"fn": "set_diff", "args": ["$x", "$y"]}, row), U.value({"fn": "first", "args": ["$x"]}, row), U.value({"fn": "date_of", "args": ["$d"]}, row).cast("string"), U.value("lit", row)).first()
    assert tuple(r) == (["b", "b"], "b", "2024-01-02", "lit")


def test_spend_buckets_always_there(spark):
    d = spark.createDataFrame([("api", 10, 1.5), ("subscription", 20, 9.0)], "bucket string, tokens int, cost double")
    got = {r.bucket: (r.records, r.tokens, r.cost) for r in L.summarize(d, "bucket", "tokens", "cost").collect()}
    assert got == {"api": (1, 10, 1.5), "subscription": (1, 20, 0.0), "unknown": (0, 0, 0.0)}


def test_precision_is_null_without_records(spark):
    empty = spark.createDataFrame([], "s string, p int, r int")
    assert L.precision(empty, "p", "r", "s").first().precision is None


def test_components_and_linkage(spark):
    edges = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.8), (4, 5, 0.7)], "a long, b long, similarity double")
    roots = K.components(edges)
    assert rows(roots, "node", "root") == [(2, 1), (3, 1), (5, 4)]
    whole = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    # 1 and 3 have no edge, so complete linkage keeps them apart
    assert rows(K.complete_linkage(edges, whole, 0.55), "class", "cluster") == [(1, 1), (2, 1), (3, 3), (4, 4), (5, 4)]


def test_cosine_edges_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(K, "BLOCK", 2)
    d = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [1.0, 0.0]), (5, [0.1, 0.9])], "id long, v array<double>")
    named = K.classes(d, "id", "v")
    assert rows(named, "class", "size") == [(1, 2), (2, 1), (3, 1), (5, 1)]
    assert rows(K.cosine_edges(named, 0.9), "a", "b") == [(1, 2), (3, 5)]


def test_cursor_is_opaque_json():
    import base64

    assert json.loads(base64.urlsafe_b64decode(R.cursor(1, 2.0, "", "u"))) == [1, 2.0, "", "u"]


def test_delta_clustering_equals_full(spark):
    old = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.7), (5, 6, 0.8), (8, 9, 0.9)], "a long, b long, similarity double")
    new = spark.createDataFrame([(1, 2, 0.9), (2, 4, 0.95), (5, 6, 0.8), (8, 9, 0.9), (4, 5, 0.6)], "a long, b long, similarity double")

    def clusters(edges):
        roots = K.components(edges)
        whole = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
        return K.complete_linkage(edges, whole, 0.55)

    prior = clusters(old)
    reach = K.affected(prior, new, spark.createDataFrame([(4,), (3,)], "class long"))
    assert rows(reach, "class") == [(x,) for x in (1, 2, 3, 4, 5, 6)]
    inside = new.join(reach.withColumnRenamed("class", "a"), "a", "left_semi")
    assert rows(K.spliced(prior, reach, clusters(inside)), "class", "cluster") == rows(clusters(new), "class", "cluster")


def test_json_and_blocks(spark):
    from codexmill.operators import compile as M

    d = spark.createDataFrame([('say {"b": 1, "a": "x\ny"} done',), ("{broken {\"k\": [1]}",), ("none",), (None,)], "t string")
    assert [r[0] for r in d.select(M.json_object()(F.col("t"))).collect()] == ['{"a":"x\\ny","b":1}', '{"k":[1]}', None, None]
    assert list(M.FencedBlocks().eval("lead\n## A\n```\n## not\n```\n## B\nx")) == [(0, "", "lead"), (1, "A", "```\n## not\n```"), (2, "B", "x")]
    texts = ["Dr. Who came. It was 3.14 then! Yes? nay. End.", "  See e.g. The cat... Then U.S. Law.\n2 more?! ", "", None, "etc.. A b. C", "No. One", "Ends here ... "]
    want = [["Dr. Who came", "It was 3.14 then", "Yes? nay", "End"], ["See e.g. The cat", "Then U.S. Law", "2 more"], [], [], ["etc.. A b", "C"], ["No. One"], ["Ends here"]]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string").select("i", M.sentences(F.col("t")).alias("s")).orderBy("i").collect()
    assert [r.s for r in got] == want


def test_corrections_apply_in_order(spark):
    from codexmill.operators import compile as M

    pages = spark.createDataFrame([("p", "f", "old", 5)], "k string, f string, v string, r int")
    news = spark.createDataFrame([("p", "f", "low", 7, 1), ("p", "f", "api", 3, 2), ("p", "f", "script", 7, 3), ("p", "f", "user", 1, 4)], "k string, f string, v string, r int, n long")
    got = M.corrections(news, pages, "k", "f", "v", "r", "n").first()
    assert (got.value, got["rank"], got.applied) == ("user", 1, 2)


def test_routing_leaves_no_value(spark):
    from codexmill.functions import privacy as P

    text, vault = P.routed(F.col("k"), F.col("t"), "email", P.EMAIL)
    r = spark.createDataFrame([(1, "a@x.io b.a@x.io a@x.io")], "k int, t string").select(text.alias("t"), vault.alias("v")).first()
    assert "@" not in r.t and sorted(x.value for x in r.v) == ["a@x.io", "b.a@x.io"] and all(x.pointer in r.t for x in r.v)
    streets = spark.createDataFrame([("at 12 N. Main Street, or 5 Oak Hill Rd. but 7 days a week",)], "t string").select(P.street_addresses(F.col("t"))).first()[0]
    assert streets == ["12 N. Main Street", "5 Oak Hill Rd."]


def test_stored_index_update_equals_rebuild(spark, tmp_path):
    from codexmill.operators import lexical as X

    from scan import bm25

    rows = [(i, f"alpha {'beta ' * (i % 4)}gamma{i % 3}", f"title {i % 5}", "en" if i % 2 else "de") for i in range(60)]
    pages = spark.createDataFrame(rows, "k int, body string, name string, lang string")
    fields = {"name": F.col("name"), "body": F.col("body")}
    index = X.build(pages, "k", fields, str(tmp_path / "a"), ["lang"])
    edited = spark.createDataFrame([(3, "beta delta", "title", "en"), (70, "beta beta beta beta", "new", "en"), (71, None, None, None)], pages.schema)
    gone = spark.createDataFrame([(5,), (7,)], "k int")
    after = X.update(index, edited, fields, gone)
    whole = pages.where("k not in (3, 5, 7)").unionByName(edited)
    fresh = X.build(whole, "k", fields, str(tmp_path / "b"), ["lang"])
    assert (after.pages, after.mean) == (fresh.pages, fresh.mean) == (60, fresh.mean)
    for query, where in (("beta gamma1", None), ("delta title", None), ("beta", F.col("lang") == "en"), ("nothing", None), ("", None)):
        got, want = (X.search(spark, x, query, 9, where).collect() for x in (after, fresh))
        assert got == want
    assert X.search(spark, after, "delta", 5).first().k == 3
    assert [r.k for r in X.search(spark, index, "beta", 60).collect()] != [r.k for r in X.search(spark, after, "beta", 60).collect()]
    assert sorted(map(tuple, X.dictionary(spark, after).collect())) == sorted(map(tuple, X.dictionary(spark, fresh).collect()))
    assert X.search(spark, after, "title", 1, weights=(5.0, 1.0)).first().score > X.search(spark, after, "title", 1).first().score
    scan = bm25(whole, "k", F.concat_ws(" ", "name", "body"), "beta gamma1", 9).collect()
    assert scan == X.search(spark, fresh, "beta gamma1", 9).collect()


def test_stored_index_of_many_parts(spark, tmp_path, monkeypatch):
    """A common word's list lies in several parts; only the parts of a query's words are read."""
    from codexmill.operators import lexical as X

    monkeypatch.setattr(X, "PART_ROWS", 60)
    rows = [(i, f"Común running word{i} other{i % 9}", None if i % 3 else f"Headed {i}") for i in range(300)]
    pages = spark.createDataFrame(rows, "k int, body string, name string")
    index = X.build(pages, "k", {"name": F.col("name"), "body": F.col("body")}, str(tmp_path), [])
    ranges = spark.read.parquet(f"{tmp_path}/ranges").collect()
    assert len(ranges) > 15 and sum(r.low <= "run" <= r.high for r in ranges) > 3
    files = lambda q: len(index.postings(spark, X.query_terms(q)).inputFiles())
    assert files("word250") < 3 < files("runs comun")
    assert [r.k for r in X.search(spark, index, "WORD17 comun", 2).collect()] == [17, 1]
    assert X.search(spark, index, "heads", 500).count() == 100
    assert X.search(spark, index, "run", 500, floor=1e-6).count() == 300
    assert {r.term: (r.df, r.cf) for r in X.dictionary(spark, index).collect()}["run"] == (300, 300)


def test_linkage_against_a_matrix():
    import random

    rng = random.Random(4)
    for _ in range(30):
        n = rng.randint(2, 12)
        edges = {(a, b): round(rng.random(), 2) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.6}
        edges = {p: s for p, s in edges.items() if s >= 0.3}
        group = {x: {x} for p in edges for x in p}
        while True:
            pairs = []
            for a in group:
                for b in group:
                    if a < b:
                        least = [edges.get((min(x, y), max(x, y)), -1) for x in group[a] for y in group[b]]
                        if min(least) >= 0.3:
                            pairs.append((-min(least), a, b))
            if not pairs:
                break
            _, a, b = min(pairs)
            group[a] |= group.pop(b)
        assert K.linked([(a, b, s) for (a, b), s in edges.items()], 0.3) == {x: min(g) for g in group.values() for x in g}


def test_linkage_in_rounds_equals_one_by_one(spark, monkeypatch):
    import random

    assert K.complete_linkage(spark.createDataFrame([], "a long, b long, similarity double"), None, 0.3).count() == 0
    run = K.linked
    monkeypatch.setattr(K, "FEW", 0)
    for seed in range(3):
        rng = random.Random(seed)
        edges = [(a, b, round(rng.random(), 1)) for a in range(25) for b in range(a + 1, 25) if rng.random() < 0.6]
        want = run(edges, 0.3)
        found = K.complete_linkage(spark.createDataFrame([(b, a, s) if (a + b) % 3 else (a, b, s) for a, b, s in edges], "a long, b long, similarity double"), None, 0.3)
        assert {r["class"]: r["cluster"] for r in found.collect()} == {x: want.get(x, x) for a, b, s in edges if s >= 0.3 for x in (a, b)}


def test_a_task_cuts_its_edges_to_a_forest(spark, monkeypatch):
    import random

    import pyarrow as pa

    monkeypatch.setattr(K, "FOREST", 50)
    rng = random.Random(1)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(900)]
    batches = [pa.record_batch([pa.array([a for a, _ in edges[i : i + 30]]), pa.array([b for _, b in edges[i : i + 30]])], ["a", "b"]) for i in range(0, 900, 30)]
    (out,) = K._forest(iter(batches))
    assert out.num_rows <= 60
    long = [(i, i + 1) for i in range(100, 400)] + [(1000 - i, 3) for i in range(50)]
    got = K.components(spark.createDataFrame(long, "a long, b long").repartition(5)).collect()
    assert {r.node: r.root for r in got} == {**{i: 100 for i in range(101, 401)}, **{1000 - i: 3 for i in range(50)}}


def test_known_pairs_as_a_condition(spark):
    edges = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.8), (4, 6, 0.7)], "a long, b long, similarity double")
    settled = spark.createDataFrame([(2,), (3,)], "id long")
    table = spark.createDataFrame([(4, 6)], "a long, b long")
    assert rows(K.cross_pairs(edges, settled, "id", F.col("a") + F.col("b") == 10), "a", "b") == rows(K.cross_pairs(edges, settled, "id", table), "a", "b") == [(1, 2)]


def test_a_pair_is_declared_once(spark):
    from codexmill.operators import ladder

    members = spark.createDataFrame([(1, "x"), (1, "y"), (1, "z"), (2, "p"), (2, "q"), (3, "alone")], "g int, k string")
    # stated twice, both ways round, against itself and against one that is no member
    pairs = spark.createDataFrame([(1, "x", "y"), (1, "x", "y"), (1, "y", "x"), (1, "z", "z"), (1, "z", "w"), (1, "z", "v"), (2, "q", "p")], "g int, a string, b string")
    left = {tuple(r) for r in ladder.undeclared(members, "g", "k", pairs).collect()}
    assert left == {(1, "x"), (1, "y"), (1, "z")}
