"""Anchored edits, findings with places, references and streaming counts against plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from codexmill.functions import spans as N
from codexmill.operators import edits, mentions
from codexmill.streaming import bounds


def applied(body, ops):
    """(body, error) of one body by hand."""
    body = body or ""
    placed, sections = [], []
    for i, (op, anchor, text) in enumerate(ops or []):
        if op not in ("replace", "insert_after", "append_section"):
            return body, f"{i}: unknown operation"
        if op != "append_section" and not anchor:
            return body, f"{i}: no anchor"
        if text is None:
            return body, f"{i}: no text"
        if op == "append_section":
            sections.append(text)
            continue
        places = [k for k in range(len(body)) if body.startswith(anchor, k)]
        if len(places) != 1:
            return body, f"{i}: anchor not " + ("unique" if places else "found")
        end = places[0] + len(anchor)
        placed.append((end if op == "insert_after" else places[0], end, i, text))
    placed.sort()
    out, at = [], 0
    for start, end, _, text in placed:
        if start < at:
            return body, "overlapping operations"
        out += [body[at:start], text]
        at = end
    out = "".join(out) + body[at:]
    for text in sections:
        out = out.rstrip("\n") + "\n\n" + text if out else text
    return out, None


def op(kind, anchor=None, text=None):
    return (kind, anchor, text)


CASES = [
    ("# Acme\n\nHQ: SF.\n\nStage: B.", [op("replace", "Stage: B.", "Stage: C."), op("insert_after", "HQ: SF.", " (moved)"), op("append_section", None, "See also.")], "# Acme\n\nHQ: SF. (moved)\n\nStage: C.\n\nSee also.", None),
    ("aa aa", [op("replace", "aa", "x")], None, "0: anchor not unique"),
    ("aaa", [op("replace", "aa", "x")], None, "0: anchor not unique"),
    ("abcdef", [op("replace", "abcd", "X"), op("replace", "cdef", "Y")], None, "overlapping operations"),
    ("abcdef", [op("replace", "abcd", "X"), op("insert_after", "ab", "Y")], None, "overlapping operations"),
    ("abcd", [op("replace", "cd", "Y"), op("insert_after", "ab", "-")], "ab-Y", None),
    ("abcd", [op("insert_after", "ab", "1"), op("insert_after", "ab", "2")], "ab12cd", None),
    ("a cat and a dog", [op("replace", "cat", "dog"), op("replace", "dog", "cow")], "a dog and a cow", None),
    ("body", [op("delete", "body", "")], None, "0: unknown operation"),
    ("body", [op(None, "body", "")], None, "0: unknown operation"),
    ("body", [op("replace", None, "x")], None, "0: no anchor"),
    ("body", [op("append_section", None, "x"), op("replace", "body", None)], None, "1: no text"),
    ("", [op("append_section", None, "only")], "only", None),
    (None, [op("append_section", None, "only")], "only", None),
    ("end\n\n\n", [op("append_section", None, "next")], "end\n\nnext", None),
    ("same", [], "same", None),
    ("same", None, "same", None),
    ("naïve 語 x", [op("replace", "語", "語語"), op("insert_after", "naïve", "!")], "naïve! 語語 x", None),
]


def test_edits_case_by_case(spark):
    rows = spark.createDataFrame([(i, b, o, "kept") for i, (b, o, _, _) in enumerate(CASES)], f"id int, body string, ops {edits.OPS}, other string")
    got = {r.id: r for r in edits.edited(rows, "body", "ops").collect()}
    for i, (body, _, want, error) in enumerate(CASES):
        assert (got[i].edited, got[i].error, got[i].other) == (body if want is None else want, error, "kept"), i


def test_edits_at_random(spark):
    rng, rows = random.Random(3), []
    for i in range(400):
        body = "".join(rng.choice("abcé \n") for _ in range(rng.randint(0, 14)))
        ops = [(rng.choice(["replace", "insert_after", "append_section"]), "".join(rng.choice("abcé") for _ in range(rng.randint(0, 3))), rng.choice(["", "Z", "\n"])) for _ in range(rng.randint(0, 4))]
        rows.append((i, body, ops))
    got = {r.id: (r.edited, r.error) for r in edits.edited(spark.createDataFrame(rows, f"id int, body string, ops {edits.OPS}"), "body", "ops").collect()}
    want = {i: applied(b, o) for i, b, o in rows}
    assert got == want
    assert len({e[3:] if e else e for _, e in want.values()}) >= 4


def places(text, pattern):
    out = []
    for m in re.finditer(pattern, text or ""):
        head = text[: m.start()]
        out.append((m[0], m.start(), m.end(), head.count("\n") + 1, m.start() - (head.rfind("\n") + 1) + 1))
    return out


def test_places_of_matches(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab1 \né語") for _ in range(rng.randint(0, 40))) for _ in range(200)] + [None, "", "\n\na1", "a1\n"]
    rows = spark.createDataFrame([(i % 190, t) for i, t in enumerate(texts)], "id int, t string")
    got = sorted((r.id, r.value, r.start, r.end, r.line, r.column) for r in N.matches(rows, "id", "t", "x", "a[b1\n]*1").collect())
    assert got == sorted((i % 190, *p) for i, t in enumerate(texts) for p in places(t, "a[b1\n]*1"))


def test_sweep_keeps_the_higher_rank(spark):
    find = lambda kind, spans: spark.createDataFrame([(1, kind, a, b) for a, b in spans], "id int, kind string, start long, end long")
    rng = random.Random(8)
    for _ in range(3):
        sets = []
        for _ in range(3):
            cuts = sorted(rng.sample(range(60), 12))
            sets.append([(a, b) for a, b in zip(cuts[::2], cuts[1::2])])
        kept = []
        for s in sets:
            kept += [x for x in s if all(x[1] <= a or b <= x[0] for a, b in kept)]
        got = N.swept([find(k, s) for k, s in zip("xyz", sets)], "id").collect()
        assert sorted((r.start, r.end) for r in got) == sorted(kept)


def test_outbound_findings_and_redaction(spark):
    text = "Write jo.5551234567@x.com or\ncall (555) 010-0100, not 2020-01-15; ISBN: 9781234567897.\nAlso JO@y.org @handle +1 555 010 0199"
    rows = spark.createDataFrame([(1, text), (2, None), (3, "nothing")], "id int, t string")
    found = N.outbound(rows, "id", "t")
    assert [(r.kind, r.value, r.line, r.column) for r in found.orderBy("start").collect()] == [("email", "jo.5551234567@x.com", 1, 7), ("phone", "(555) 010-0100", 2, 6), ("email", "JO@y.org", 3, 6), ("phone", "+1 555 010 0199", 3, 23)]
    assert all(text[r.start : r.end] == r.value for r in found.collect())
    known = N.outbound(rows, "id", "t", ["jo@Y.org", "555-010-0100", " "])
    assert sorted(r.value for r in known.collect()) == ["+1 555 010 0199", "jo.5551234567@x.com"]
    out = {r.id: r.t for r in N.redacted(rows, "id", "t", known).collect()}
    assert out[1].startswith("Write [redacted-email] or\ncall (555) 010-0100") and out[1].endswith("JO@y.org @handle [redacted-phone]")
    assert (out[2], out[3]) == (None, "nothing")


def test_references_in_transcripts(spark):
    turns = spark.createDataFrame([(1, "saw page-7 today"), (1, "and xpage-70"), (2, None), (2, "page-1"), (3, "page-7")], "s long, body string")
    pushes = spark.createDataFrame([(1, "page-7"), (1, "page-7"), (1, "page-70"), (1, "gone"), (1, ""), (1, None), (2, "page-7"), (4, "page-7")], "s long, item string")
    assert sorted(map(tuple, mentions.named(pushes, turns, "s", "item", "body").collect())) == [(1, "page-7"), (1, "page-70")]
    assert sorted(map(tuple, mentions.references(pushes, turns, "s", "item", "body").collect())) == [(1, 3, 2), (2, 1, 0)]


@pytest.mark.parametrize("most_files", [None, 1])
def test_counts_survive_a_restart(spark, tmp_path, most_files):
    rng = random.Random(most_files)
    rows = [(f"k{rng.randint(0, 9)}" if rng.random() > 0.02 else None, i, rng.choice(["a", "a", "a", "b", None]), rng.choice([True, True, True, False, None])) for i in range(400)]
    kind = "key string, seq long, content string, violated boolean"
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    for i in range(0, 400, 100):
        spark.createDataFrame(rows[i : i + 100], kind).coalesce(1).write.mode("append").parquet(source)
        if i in (100, 300):
            bounds.run(spark, source, kind, str(tmp_path / "checkpoint"), sink, 4, most_files)
    state, crossed = {}, set()
    for key, seq, content, bad in rows:
        if key is None:
            continue
        held = state.get(key)
        state[key] = None if not bad else (content, held[1] + 1, held[2]) if held and held[0] == content else (content, 1, seq)
        if state[key] and state[key][1] == 4:
            crossed.add(key)
    want = sorted((k, *v, k in crossed) for k, v in state.items() if v)
    assert sorted(map(tuple, bounds.latest(spark, sink).collect())) == want
    assert sorted(map(tuple, bounds.folded(spark.createDataFrame(rows, kind), 4).collect())) == want
    before = spark.read.parquet(sink).count()
    bounds.run(spark, source, kind, str(tmp_path / "checkpoint"), sink, 4)  # nothing new
    assert spark.read.parquet(sink).count() == before
