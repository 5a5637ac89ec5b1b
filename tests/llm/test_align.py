import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from codexmill.llm import align, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_map():
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    out, extra = {chr(b): b for b in plain}, 0
    for b in range(256):
        if b not in plain:
            out[chr(256 + extra)] = b
            extra += 1
    return out


def brute(rows):
    """Whole texts encoded, all pairs of tokens compared by their byte ranges."""
    a, b, own = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), byte_map()
    a.encode_special_tokens = True

    def ranges(parts):
        out, at = [], 0
        for p in parts:
            out.append((at, at + len(p)))
            at += len(p)
        return out

    done, counts = [], Counter()
    for doc_id, text in rows:
        raw = b" " + (text or "").encode()
        x, y = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        xs = [bytes(own[c] for c in a.id_to_token(i)) for i in x]
        ys = [bytes([int(p[1:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in y for p in [b.id_to_piece(i)]]
        if not text or b"".join(xs) != raw or b"".join(ys) != raw:
            done.append((doc_id, None))
            continue
        ra, rb = ranges(xs), ranges(ys)
        links = [(x[i], y[j]) for i, (s, e) in enumerate(ra) for j, (u, v) in enumerate(rb) if s < v and u < e]
        both = {e for _, e in ra} & {e for _, e in rb}
        groups, ga, gb, j = [], [], [], 0
        for i, (_, e) in enumerate(ra):
            ga.append(x[i])
            if e in both:
                while True:
                    gb.append(y[j])
                    j += 1
                    if rb[j - 1][1] == e:
                        break
                groups.append((ga, gb))
                ga, gb = [], []
        counts.update(links)
        done.append((doc_id, (len(x), len(y), groups, links)))
    best = {}
    for (_, j), n in counts.items():
        best[j] = max(n, best.get(j, 0))
    out = []
    for doc_id, found in done:
        if found is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = found
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((doc_id, n_a, n_b, len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest()))
    return out


ODD = [None, "", " ", "  ", "   lead", "trail ", "trail   ", "a  b   c", "line\n  two \n\n three\t\t x", "it's we'll  'tis", "<|endoftext|> <s> </s> <unk> <0x41>", "▁under", "x ▁ y", " nbsp 　wide x　 y", "emoji 👩‍👩‍👧 🇫🇷 ok", "né Ǆ ß ﬁ １２", "123 4567 89,000.5", "\x00 nul \x01", "日本語の文 です", "\x1c fs\x1c x", "a" * 300, "ab " * 400, "﻿bom", "end\r\n", "…“quoted”—dash"]
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def run(spark, docs, rows, path):
    docs(rows).withColumnRenamed("lang", "code").withColumnRenamed("source", "groups").write.parquet(f"{path}/documents.parquet")
    got = queries.op13_token_alignment(spark, str(path))
    assert got.columns == COLUMNS
    return order(map(tuple, got.collect()))


def test_query_matches_brute_force(spark, docs, prose, tmp_path):
    rng = random.Random(4)
    letters = "aB é\n\t'.,1<|▁  ß語"
    rows = list(enumerate(ODD)) + [(100 + i, prose(rng.randint(1, 60))) for i in range(30)]
    rows += [(200 + i, "".join(rng.choice(letters) for _ in range(rng.randint(1, 80)))) for i in range(120)]
    rows += [(400 + i, "".join(rng.choice("ab  \n") for _ in range(40))) for i in range(80)]
    rows += [(None, "the same"), (None, "the same"), (None, None), (100, rows[30][1])]
    assert run(spark, docs, rows, tmp_path / "x") == order(brute(rows))
    assert run(spark, docs, [], tmp_path / "none") == []


def test_real_texts_in_pieces_with_a_small_memory(spark, docs, tmp_path, monkeypatch):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(25).collect()]
    assert run(spark, docs, rows, tmp_path) == order(brute(rows))
    batch = lambda some: pa.record_batch([pa.array([i for i, _ in some]), pa.array([t for _, t in some])], ["doc_id", "text"])
    rows += [(50 + i, t) for i, t in enumerate(ODD)] + [(999, " ".join(t for _, t in rows)[:40_000])]
    align._aligner.cache_clear()
    whole = [r for b in align._encode(A, B)(iter([batch(rows)])) for r in b.to_pylist()]
    monkeypatch.setattr(align, "PIECE", 700)
    monkeypatch.setattr(align, "KNOWN_UNITS", 300)
    parts = [r for b in align._encode(A, B)(iter([batch(rows[i : i + 5]) for i in range(0, len(rows), 5)])) for r in b.to_pylist()]
    assert parts == whole
    assert len(align._aligner(A, B).names) < 3000
    align._aligner.cache_clear()


def test_groups_as_text(spark, docs):
    got = align.align(docs([(1, "hello there"), (2, None)]), A, B).orderBy("doc_id").collect()
    assert [g.split("|")[0] for g in got[0].groups.split(";")] == [str(i) for i in Tokenizer.from_file(A).encode(" hello there").ids]
    assert (got[1].groups, got[1].n_links, got[1].count_sum) == ("", 0, 0)


def test_joined_units_have_the_ids_of_single_ones():
    rng, aligner = random.Random(9), align.Aligner(A, B)
    letters = [chr(c) for c in range(1, 0x250)] + list("abcde'  .,01\n\t") * 20
    units = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 12))) for _ in range(20_000)]
    units = list(dict.fromkeys(u for u in units if not u[-1].isspace()))
    assert aligner.joined is not None
    ids, n = aligner._first(units, True)
    want, m = aligner._first(units, False)
    assert n.tolist() == m.tolist() and ids.tolist() == want.tolist()


def test_components_are_those_of_a_search():
    rng = np.random.default_rng(2)
    for n in (1, 5, 60, 400):
        left, right = rng.integers(0, n, n // 2 + 1), rng.integers(0, n, n // 2 + 1)
        root = list(range(n))
        for _ in range(n):
            for x, y in zip(left, right):
                root[x] = root[y] = min(root[x], root[y])
        assert align.components(left, right, n).tolist() == root
