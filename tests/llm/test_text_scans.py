import pickle
"""Toxicity, decontamination, licenses and the pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codexmill.llm import decontaminate as dc
from codexmill.llm import licenses, toxicity


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(0)
    lift, trans = rng.normal(0, 1, 9), rng.normal(0, 1, (2, 2))
    begin, size = np.array([0, 5, 8]), np.array([5, 3, 1])
    marginal, _, z = toxicity.forward_backward(lift, begin, size, trans)
    for b, s in zip(begin, size):
        weights = {}
        for path in range(1 << s):
            y = [path >> k & 1 for k in range(s)]
            weights[path] = np.exp(sum(lift[b + k] * y[k] for k in range(s)) + sum(trans[y[k], y[k + 1]] for k in range(s - 1)))
        total = sum(weights.values())
        for k in range(s):
            assert np.isclose(marginal[b + k], sum(w for p, w in weights.items() if p >> k & 1) / total)


def toxic_docs(prose, n=240):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        w, toxic = prose(60).split(), i % 4 == 0
        if toxic:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["zorg", "Blurk!", "vexil" + rng.choice(["an", "er", "on", "ith"])]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_spans(spark, docs, prose):
    rows, labels = toxic_docs(prose)
    rows += [(1000, None), (1001, ""), (1002, "zorg blurk zorg"), (1003, "the " * 30000), (0, rows[0][1])]
    d = docs(rows).withColumn("score", F.lit("clash"))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(d, lab).collect()
    truth = {i: t for i, _, t in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and all(r.predicted == truth[r.doc_id] for r in held)
    by = {r.doc_id: r for r in got}
    assert by[1000].score == by[1001].score and by[1001].predicted == 0 and by[1003].predicted == 0 and by[1002].predicted == 1
    text = dict(rows)
    spans = [text[r.doc_id].encode()[s.begin : s.end].decode().lower() for r in held if truth[r.doc_id] for s in r.spans]
    assert spans and sum(any(k in s for k in ("zorg", "blurk", "vexil")) for s in spans) / len(spans) > 0.95
    kept = toxicity.drop_toxic(d, lab)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.predicted}


def test_one_long_labelled_text_displaces_no_others(spark, docs, prose):
    rows, labels = toxic_docs(prose)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    clean = [i for i, _, t in labels if not t]
    for long in (clean[0], clean[1]):  # wherever the order of hashes puts it
        some = [(i, t if i != long else prose(20_000)) for i, t in rows]
        without = [(i, t) for i, t in rows if i != long]
        fit = lambda r, known: toxicity.train(docs(r), known, sample_bytes=90_000)
        tagger, other = fit(some, lab), fit(without, lab.where(F.col("doc_id") != long))
        assert tagger.fitted and pickle.dumps(tagger) == pickle.dumps(other)
    only = spark.createDataFrame([(1, 0, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.train(docs([(1, "zorg " * 900), (2, prose(900))]), only, sample_bytes=1000).fitted


def test_toxicity_without_labels(spark, docs):
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in toxicity.toxicity(docs([(1, "a b")]), lab).collect()] == [0.5]
    assert toxicity.toxicity(docs([]), lab).count() == 0


def smith_waterman(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            h[i + 1][j + 1] = max(0, h[i][j] + (2 if x == y else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
            best = max(best, h[i + 1][j + 1])
    return best


def test_alignment_matches_the_recurrence():
    rng = np.random.default_rng(2)
    for _ in range(40):
        a, b = rng.integers(0, 5, rng.integers(1, 14)), rng.integers(0, 5, rng.integers(1, 20))
        assert dc.align(a.astype(np.uint64), b.astype(np.uint64)) == smith_waterman(a.tolist(), b.tolist())


@pytest.mark.parametrize("bound", [8 << 20, 0])  # all tables broadcast, and none
def test_planted_passages_are_found(spark, docs, prose, monkeypatch, bound):
    rng = random.Random(3)
    items = [(i, prose(25 + i)) for i in range(12)] + [(50, None), (51, ""), (52, "rareword other"), (53, "the"), (None, prose(30)), (3, None)]
    rows, want = [], {}
    for i in range(160):
        w = prose(120).split()
        if i % 4 == 0:
            item, passage = items[i % 12][0], items[i % 12][1].split()
            if i % 8 == 0:  # an edited copy: each ninth word replaced, one dropped
                passage = [f"new{k}" if k % 9 == 4 else x for k, x in enumerate(passage)]
                del passage[2]
            k = rng.randrange(100)
            w[k:k] = passage
            want[i] = item
        rows.append((i, " ".join(w)))
    rows += [(500, None), (501, ""), (502, "x RAREWORD, other"), (0, rows[0][1]), (503, "the the"), (504, items[-2][1])]
    want[502] = 52
    monkeypatch.setattr(dc.common, "BROADCAST_BYTES", bound)
    bench = spark.createDataFrame(items, "item_id long, text string")
    d = docs(rows).withColumn("items", F.lit(1)).withColumn("key", F.lit("clash"))
    got = dc.scan(d, bench).collect()
    assert len(got) == len(rows) and {r.doc_id: r.item_id for r in got if r.contaminated} == want
    kept = dc.drop_contaminated(d, bench)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in rows if r[0] not in want)
    assert dc.scan(docs([]), bench).count() == 0
    assert not any(r.contaminated for r in dc.scan(docs(rows), bench.limit(0)).collect())


def test_every_row_is_judged(spark, docs, prose):
    items = [(i, prose(25)) for i in range(6)] + [(7, "x"), (8, "x")]
    rows = [(1, prose(20)), (1, prose(10) + " " + items[2][1]), (1, items[4][1] + " " + items[0][1]), (None, prose(20)), (None, items[5][1]), (7, None), (7, None), (9, items[5][1])]
    got = sorted(((r.doc_id, r.contaminated, r.item_id, r.score, tuple(r["items"])) for r in dc.scan(docs(rows), spark.createDataFrame(items, "item_id long, text string")).collect()), key=repr)
    assert len(got) == len(rows)
    assert sorted((r[0], r[2], r[3], r[4]) for r in got if r[1] and r[0]) == [(1, 0, 1.0, (0, 4)), (1, 2, 1.0, (2,)), (9, 5, 1.0, (5,))]
    assert [r[2:] for r in got if r[0] is None] == [(5, 1.0, (5,)), (None, 0.0, ())] or [r[2:] for r in got if r[0] is None] == [(None, 0.0, ()), (5, 1.0, (5,))]


def test_edited_copies_against_all_pairs(spark, docs, prose):
    """Recall and precision over edits of any kind, held against alignment of all pairs."""
    import re

    rng = random.Random(11)
    items = [(i, prose(rng.randint(18, 40))) for i in range(8)]
    rows = []
    for i in range(96):
        w, passage = prose(60).split(), items[i % 8][1].split()
        for _ in range(i // 8):
            kind, k = rng.choice("sdi"), rng.randrange(len(passage))
            passage[k : k + (kind != "i")] = [] if kind == "d" else [f"e{rng.randrange(10**6)}"]
        w[20:20] = passage
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r for r in dc.scan(docs(rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want, right = 0, 0
    for i, text in rows:
        for n, item in items:
            a, b = re.findall(r"[a-z0-9]+", item), re.findall(r"[a-z0-9]+", text)
            if smith_waterman(a, b) >= dc.THRESHOLD * 2 * len(a):
                want += 1
                right += n in got[i]["items"]
            else:
                assert n not in got[i]["items"]
    assert want > 50 and right / want > 0.9  # copies edited at every other word keep no seed


def test_scores_match_alignment_of_the_whole_text(spark, docs, prose):
    import re

    item = prose(30)
    w = item.split()
    rows = [(1, prose(40) + " " + item + " " + prose(40)), (2, prose(30) + " " + " ".join(w[:20]) + " " + prose(30)), (3, prose(10) + " " + " ".join(w[:12] + ["q"] + w[13:]))]
    got = {r.doc_id: r.score for r in dc.scan(docs(rows), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    for i, text in rows:
        a, b = re.findall(r"\w+", item), re.findall(r"\w+", text)
        assert got[i] == smith_waterman(a, b) / (2 * len(a))


def dice(a, b):
    x, y = licenses._bigrams(a), licenses._bigrams(b)
    return 2 * len(x & y) / (len(x) + len(y)) if x and y else 0.0


def test_licenses_match_all_pairs(spark, docs, prose):
    lines = [t for _, t in licenses.TEMPLATES]
    rows = [(i, prose(30) + "\n" + t.upper() + "\n" + prose(20)) for i, t in enumerate(lines)] + [(100 + i, t) for i, t in enumerate(lines)]
    rows += [(200, None), (201, ""), (202, "license"), (203, "released under MIT license"), (204, "Released, under the -- MIT   license!"), (205, prose(3000)), (0, rows[0][1]), (206, "Licensed under the\nApache License, Version 2.0.")]
    got = {(r.doc_id, r.license): r.dice for r in licenses.scan(docs(rows).withColumn("unit", F.lit("x"))).collect()}
    want = {}
    for i, text in rows:
        for unit in {*(text or "").split("\n"), (text or "").replace("\n", " ")}:
            scores = [(round(dice(unit, t), 6), name) for name, t in licenses.TEMPLATES]
            best = max(s for s, _ in scores)
            if best >= licenses.THRESHOLD:
                for s, name in scores:
                    if s == best:
                        want[i, name] = max(s, want.get((i, name), 0))
    assert got == want
    assert licenses.scan(docs([])).count() == 0


def test_licenses_tell_rows_apart(spark, docs, prose):
    words = dict(licenses.TEXTS)["GPL-3.0"].split()
    cut = len(words) * 55 // 100
    rows = [(1, " ".join(words[:cut])), (1, " ".join(words[-cut:])), (None, "Released under the MIT License."), (None, prose(5)), (2, "Released under the MIT License.\nx\nreleased under the MIT license"), (2, "Licensed under CC BY-NC 4.0.")]
    got = sorted((str(r.doc_id), r.license, r.lines) for r in licenses.scan(docs(rows)).collect())
    assert got == [("2", "CC-BY-NC-4.0", 1), ("2", "MIT", 2), ("None", "MIT", 1)]
    table = spark.createDataFrame([("Own", "all of this text may be used by anyone"), ("Short", "x"), (None, "y z")], "license string, text string")
    own = licenses.scan(docs([(3, "ALL of this text may be used by anyone!"), (4, prose(9))]), templates=table, texts=[]).collect()
    assert [(r.doc_id, r.license, r.dice) for r in own] == [(3, "Own", 1.0)]


def test_license_passages(spark, docs, prose):
    import textwrap

    whole = dict(licenses.TEXTS)
    wrap = lambda t, n=70, mark="": "\n".join(mark + x for x in textwrap.wrap(t, n))
    bsd = next(t for n, t in licenses.TEMPLATES if n == "BSD-3-Clause")
    rows = [
        (1, "MIT License\n\nCopyright (c) 2020 A. Person\n\n" + wrap(whole["MIT"])),
        (2, prose(40) + "\n" + wrap(bsd) + "\n" + prose(40)),
        (3, "#!/bin/sh\n" + wrap(whole["GPL-3.0"], 60, "# ") + "\n" + prose(200)),
        (4, "Author bio follows. Released under the MIT License. All other rights " + prose(9)),
        (5, prose(30) + " Licensed under\nCC BY-NC 4.0. " + prose(30)),
        (6, wrap(whole["BSD-2-Clause"]) + "\n" + prose(10)),
        (7, prose(300)),
        (None, "x y Released under the MIT License. z"),
    ]
    got = {(r.doc_id, r.license): (r.dice, r.lines) for r in licenses.scan(docs(rows)).collect()}
    want = {(1, "MIT"), (2, "BSD-3-Clause"), (3, "GPL-3.0"), (4, "MIT"), (5, "CC-BY-NC-4.0"), (6, "BSD-2-Clause"), (None, "MIT")}
    assert got == {k: (1.0, 1) for k in want}


def test_pipeline_stages(spark, tmp_path, docs, prose):
    import corpus_pipeline

    rows, labels = toxic_docs(prose, 200)
    item = prose(30)
    rows += [(300 + i, rows[1][1] + (" tail" if i else "")) for i in range(5)] + [(400, prose(20) + " " + item)] + [(500, None), (501, "")]
    docs([(i, t, f"s{i % 3}") for i, t in rows]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, left = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == now.columns
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        left.append({r.doc_id for r in now.collect()})
    ids = {i for i, _ in rows}
    toxic = {i for i, _, t in labels if t}
    assert left[0] == ids - toxic
    assert left[1] == left[0] - {300, 301, 302, 303, 304}  # copies of document 1, which stays
    assert left[2] == left[1] - {400}
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in final} <= left[2] and {r.shard for r in final} <= set(range(24))


def test_pipeline_on_edge_tables(spark, tmp_path, docs, prose):
    import corpus_pipeline

    none = tmp_path / "none"
    docs([]).write.parquet(str(none / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(none / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(none / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(none)).count() == 0
    some = tmp_path / "some"
    text = prose(40)
    rows = [(None, text, None), (None, text, None), (1, None, "a"), (1, None, "a"), (2, "", None), (3, "w " * 20000, "a"), (3, "w " * 20000, "a"), (4, prose(30), "b")]
    d = docs(rows).withColumn("_crc", F.lit(1)).withColumn("shard", F.lit(2)).withColumn("key", F.lit(3))
    d.write.parquet(str(some / "documents.parquet"))
    spark.createDataFrame([(None, 1, 1), (1, 1, None), (4, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(some / "labels.parquet"))
    spark.createDataFrame([(None, text), (1, None)], "item_id long, text string").write.parquet(str(some / "benchmark.parquet"))
    now = spark.read.parquet(str(some / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(some))
        assert now.columns == d.columns, name
        now.write.parquet(str(some / name))
        now = spark.read.parquet(str(some / name))
    left = [(r.doc_id, (r.text or "")[:5]) for r in spark.read.parquet(str(some / "decontamination")).collect()]
    assert sorted(left, key=str) == sorted([(None, text[:5]), (1, ""), (1, ""), (2, ""), (3, "w w w"), (4, rows[-1][1][:5])], key=str)
    assert corpus_pipeline.run(spark, str(some)).columns == ["doc_id", "size", "text_crc32", "shard", "slot"]


def test_items_with_text_ids(spark, docs, prose):
    item = prose(40)
    bench = spark.createDataFrame([("q-1", item), ("q-2", prose(40)), (None, prose(30))], "item_id string, text string")
    got = {r.doc_id: r for r in dc.scan(docs([(1, f"{prose(20)} {item} {prose(20)}"), (2, prose(60)), (3, None)]), bench).collect()}
    assert (got[1].item_id, got[1].items, got[2].contaminated, got[3].items) == ("q-1", ["q-1"], False, [])
