"""Compilation of groups into entries, corrections in order, cascades and closures."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from codexmill.functions import text as T


def bodies(rows: DataFrame, group: str, order: str, body: Column) -> DataFrame:
    """(group, body, paragraphs): paragraphs of all members in order, each normal form once, the
    first kept. Repeats fall by aggregation before any group is put together."""
    parts = rows.select(group, order, F.posexplode(F.split(F.coalesce(body, F.lit("")), r"\n+")).alias("at", "paragraph"))
    parts = parts.withColumn("key", F.sha1(T.normal_claim(F.col("paragraph")).cast("binary"))).where(F.trim("paragraph") != "")
    first = parts.groupBy(group, "key").agg(F.min(F.struct(order, "at", "paragraph")).alias("p"))
    return first.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["paragraph"]), "\n\n").alias("body"), F.count(F.lit(1)).alias("paragraphs"))


def corrections(records: DataFrame, pages: DataFrame, key: str, field: str, value: str, rank: str, order: str) -> DataFrame:
    """(key, field, value, rank, applied): each page's field after its corrections in line order.
    A correction applies if its source ranks no lower than what stands; equal values are no
    change. Order matters inside one field of one page only, which has few records: they are
    folded in place."""
    side = lambda rows, at: rows.select(F.col(key).cast("string").alias("key"), F.col(field).alias("field"), F.struct(at.cast("long").alias("seq"), F.col(value).cast("string").alias("value"), F.col(rank).cast("int").alias("rank")).alias("r"))
    rows = side(pages, F.lit(-1)).unionByName(side(records, F.col(order)))
    start = F.struct(F.lit(None).cast("string").alias("value"), F.lit(99).alias("rank"), F.lit(0).alias("applied"))

    def step(now: Column, r: Column) -> Column:
        takes = ~r["value"].eqNullSafe(now["value"]) & (r["rank"] <= now["rank"])
        one = F.when(now["value"].isNotNull(), 1).otherwise(0)
        return F.when(takes, F.struct(r["value"].alias("value"), r["rank"].alias("rank"), (now["applied"] + one).alias("applied"))).otherwise(now)

    folded = rows.groupBy("key", "field").agg(F.array_sort(F.collect_list("r")).alias("all"))
    return folded.select("key", "field", F.aggregate("all", start, step).alias("s")).select("key", "field", "s.value", "s.rank", "s.applied")


def cascade(retracted: DataFrame, provenance: DataFrame, reviewed: DataFrame, item: str, sources: str, key: str) -> DataFrame:
    """(key, item): merged entries that rest on a retracted item, less those already reviewed."""
    rests = provenance.select(key, F.explode(sources).alias(item)).join(retracted.select(item).distinct(), item)
    return rests.join(reviewed.select(key).distinct(), key, "left_anti").select(key, item)


def owned(pages: DataFrame, key: str, topics: str, owners: DataFrame) -> DataFrame:
    """(key, source, topic): the first of a page's topics that a live source owns (topic, source)."""
    each = pages.select(key, F.posexplode(topics).alias("at", "t")).select(key, "at", F.lower(F.trim("t")).alias("topic"))
    met = each.join(owners, "topic").groupBy(key).agg(F.min(F.struct("at", "source", "topic")).alias("m"))
    return met.select(key, "m.source", "m.topic")


def claim_source(claims: DataFrame, turns: DataFrame, key: str, session: str, claim: str, role: str, body: str, channels: list[tuple[str, str]]) -> DataFrame:
    """(key, source): the first of the channels (role, source) whose turns of the session hold the
    whole claim, white space and case aside; inferred where none does, unavailable without a
    transcript."""
    said = turns.groupBy(session).agg(*[F.collect_list(F.when(F.col(role) == r, T.neat(F.col(body)))).alias(f"_c{i}") for i, (r, _) in enumerate(channels)], F.lit(True).alias("_here"))
    rows = claims.join(said, session, "left").withColumn("_n", T.neat(F.coalesce(claim, F.lit(""))))
    out = F.when(F.col("_here").isNull(), "unavailable").when(F.col("_n") == "", "inferred")
    for i, (_, name) in enumerate(channels):
        out = out.when(F.exists(f"_c{i}", lambda x: F.contains(x, F.col("_n"))), name)
    return rows.select(key, out.otherwise("inferred").alias("source"))


def as_of(members: DataFrame, group: str, key: str, valid_until: Column, day: Column) -> DataFrame:
    """(group, members, last, tag) of each cluster from the members valid at a day."""
    live = members.where(~F.coalesce(day > valid_until, F.lit(False)))
    names = F.array_join(F.array_sort(F.collect_list(F.col(key).cast("string"))), "\n")
    return live.groupBy(group).agg(F.count(F.lit(1)).alias("members"), F.max(key).alias("last"), F.substring(F.sha1(names.cast("binary")), 1, 8).alias("tag"))


def relinked(pages: DataFrame, key: str, links: Column, renamed: DataFrame, old: str, new: str) -> DataFrame:
    """(key, links): links in order with old targets replaced, each once."""
    each = pages.select(key, F.posexplode(links).alias("at", "link")).join(renamed.select(F.col(old).alias("link"), F.col(new).alias("_to")), "link", "left")
    once = each.select(key, "at", F.coalesce("_to", "link").alias("link")).groupBy(key, "link").agg(F.min("at").alias("at"))
    return once.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "link"))), lambda x: x["link"]).alias("links"))


def ancestors(path: Column, separator: str = "/") -> Column:
    """A path's proper prefixes, nearest first."""
    parts = F.split(path, separator)
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.size(parts) - 1, F.lit(1)), lambda i: F.array_join(F.slice(parts, 1, i), separator))).otherwise(F.array().cast("array<string>"))


def pooled(members: DataFrame, key: str, scope: str) -> DataFrame:
    """(key, pooled): members with those of the scopes above them, by an equality join."""
    up = members.select(F.col(key), F.explode(ancestors(F.col(scope))).alias("_scope"))
    return up.join(members.select(F.col(key).alias("pooled"), F.col(scope).alias("_scope")), "_scope").select(key, "pooled").where(F.col(key) != F.col("pooled"))


def decisions(queues: dict[str, DataFrame], key: str, created: str) -> DataFrame:
    """(queue, key, created) of all queues; sort by created for the oldest first."""
    out = None
    for name, rows in queues.items():
        part = rows.select(F.lit(name).alias("queue"), F.col(key).cast("string").alias("key"), F.coalesce(F.col(created).cast("string"), F.lit("")).alias("created"))
        out = part if out is None else out.unionByName(part)
    return out


def coverage(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(field, populated, ratio): 1 on an empty table. One pass over all fields."""
    counts = rows.agg(F.count(F.lit(1)).alias("_n"), *[F.count(f).alias(f) for f in fields])
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("populated")) for f in fields]))
    return counts.select("_n", pairs.alias("p")).select("p.field", "p.populated", F.round(F.coalesce(F.try_divide("p.populated", "_n"), F.lit(1.0)), 6).alias("ratio"))


#: So many words at most are remembered with their hashes.
KNOWN_WORDS = 20_000


def hash_embedding(size: int = 384):
    """A pandas UDF: words of two letters or more, signed by a hash, counted into `size` places
    and normalised; a text without words is the first unit vector."""
    import hashlib

    import numpy as np

    @F.pandas_udf(Ty.ArrayType(Ty.FloatType()))
    def embed(texts: pd.Series) -> pd.Series:
        known: dict[str, tuple[int, float]] = {}
        out = []
        for text in texts:
            v = np.zeros(size)
            for w in (text or "").lower().replace("_", " ").split():
                if len(w) < 2:
                    continue
                if w not in known:
                    if len(known) >= KNOWN_WORDS:
                        known.clear()
                    d = hashlib.sha256(w.encode()).digest()
                    known[w] = int.from_bytes(d[:4], "big") % size, 1.0 if d[4] % 2 == 0 else -1.0
                at, sign = known[w]
                v[at] += sign
            norm = float(np.sqrt((v * v).sum()))
            if norm == 0:
                v[0] = norm = 1.0
            out.append((v / norm).astype(np.float32))
        return pd.Series(out)

    return embed


def json_object():
    """A pandas UDF: the first whole JSON object in prose or a code fence, as compact JSON with
    sorted keys; raw control characters inside strings are taken as they are; null without one."""
    import json

    @F.pandas_udf(Ty.StringType())
    def extract(texts: pd.Series) -> pd.Series:
        decode = json.JSONDecoder(strict=False).raw_decode

        def first(text: str | None) -> str | None:
            at = (text or "").find("{")
            while at >= 0:
                try:
                    found, _ = decode(text, at)
                    return json.dumps(found, sort_keys=True, separators=(",", ":"))
                except ValueError:
                    at = text.find("{", at + 1)
            return None

        return texts.map(first)

    return extract


class FencedBlocks:
    """A UDTF body: a text's blocks by their headings, where a heading inside a code fence begins
    none. Yields (at, title, body)."""

    def eval(self, text: str) -> Iterator[tuple[int, str, str]]:
        title, lines, fenced, at = "", [], False, 0
        for line in (text or "").splitlines():
            if line.lstrip().startswith("```"):
                fenced = not fenced
            if line.startswith("## ") and not fenced:
                if title or any(x.strip() for x in lines):
                    yield at, title, "\n".join(lines).strip()
                    at += 1
                title, lines = line[3:].strip(), []
            else:
                lines.append(line)
        if title or any(x.strip() for x in lines):
            yield at, title, "\n".join(lines).strip()


# Words before a full stop that don't end a sentence.
ABBREVIATIONS = ("e.g", "i.e", "etc", "vs", "dr", "mr", "mrs", "ms", "prof", "inc", "ltd", "co", "corp", "u.s", "u.k", "a.m", "p.m", "ph.d", "st", "no", "fig", "approx", "jr", "sr", "al")
_CUT = "\ue000"  # of the private area: no text means anything by it


def sentences(text: Column) -> Column:
    """The sentences of a text in order. One ends at a run of . ! ? before white space and an
    upper-case letter or digit, unless the word before the run is an abbreviation; the text's
    last sentence loses its end marks. A cut is marked by one replacement, so no row is parsed
    outside the engine."""
    words = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
    end = rf"(?U)(?<![.!?])(?<!(?:^|\s)(?i:{words})\s{{0,4}})[.!?]+\s+(?=[\p{{Lu}}\p{{Nd}}])"
    whole = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    parts = F.split(F.regexp_replace(whole, end, _CUT), _CUT)
    last = F.regexp_replace(F.element_at(parts, -1), r"(?U)[.!?]+\s*$", "")
    every = F.concat(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(last))
    return F.filter(F.transform(every, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")


def register(spark) -> None:
    """Make the table function `fenced_blocks` known to SQL."""
    spark.udtf.register("fenced_blocks", F.udtf(FencedBlocks, returnType="at int, title string, body string"))
