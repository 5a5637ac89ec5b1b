"""Accounting over append-only ledgers: spend, usage, precision, calibration, rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .resolve import longest_prefix


def billing_bucket(mode: Column, provider: Column, api: str, subscription: str) -> Column:
    """api, subscription or unknown; what can't be told stays apart from zero."""
    known = F.when(mode == "api", "api").when(mode == "subscription", "subscription")
    return F.coalesce(known, F.when(provider == subscription, "subscription").when(provider == api, "api"), F.lit("unknown"))


def _sums(tokens: str, cost: str, bucket: str) -> list[Column]:
    dollars = F.when(F.col(bucket) == "subscription", 0.0).otherwise(F.coalesce(F.col(cost), F.lit(0.0)))
    return [F.count(F.lit(1)).alias("records"), F.sum(F.coalesce(F.col(tokens), F.lit(0))).alias("tokens"), F.round(F.sum(dollars), 4).alias("cost")]


def summarize(ledger: DataFrame, bucket: str, tokens: str, cost: str) -> DataFrame:
    """Records, tokens and dollars per bucket; all three buckets are always there, and
    subscriptions carry no dollars."""
    names = ledger.sparkSession.createDataFrame([("api",), ("subscription",), ("unknown",)], f"{bucket} string")
    got = ledger.groupBy(bucket).agg(*_sums(tokens, cost, bucket))
    return F.broadcast(names).join(got, bucket, "left").fillna(0, ["records", "tokens"]).fillna(0.0, ["cost"])


def breakdown(ledger: DataFrame, bucket: str, parts: list[str], tokens: str, cost: str) -> DataFrame:
    """Bucket totals by each of several parts in one pass of grouping sets: (part, value)."""
    sets = [[bucket, p] for p in parts]
    got = ledger.groupingSets([[F.col(c) for c in s] for s in sets], bucket, *parts).agg(F.grouping_id().alias("_g"), *_sums(tokens, cost, bucket))
    # grouping_id: one bit per column after the bucket, set where the column is summed over
    full = (1 << len(parts)) - 1
    which = F.when(F.lit(False), "")
    value = F.when(F.lit(False), "")
    for i, p in enumerate(parts):
        mine = F.col("_g") == full ^ (1 << (len(parts) - 1 - i))
        which, value = which.when(mine, p), value.when(mine, F.coalesce(F.col(p), F.lit("(unknown)")))
    return got.select(which.alias("part"), value.alias("value"), bucket, "records", "tokens", "cost")


def reprice(ledger: DataFrame, model: str, tokens: str, cost: str, bucket: str, rates: DataFrame, lengths: list[int]) -> DataFrame:
    """Stored and recomputed dollars per bucket; the rate is that of the longest model prefix,
    and rows without one are counted as unpriceable."""
    priced = longest_prefix(ledger.select(bucket, model, tokens, cost), model, rates, "prefix", lengths)
    return priced.groupBy(bucket).agg(F.round(F.sum(cost), 4).alias("stored"), F.round(F.sum(F.col(tokens) * F.col("rate") / 1e6), 4).alias("repriced"), F.count_if(F.col("rate").isNull()).alias("unpriceable"))


def usage(pushes: DataFrame, references: DataFrame, key: str, ts: str) -> DataFrame:
    """(key, pushed, referenced, last_pushed, last_referenced) of every key in either ledger."""
    p = pushes.groupBy(key).agg(F.count(F.lit(1)).alias("pushed"), F.max(ts).alias("last_pushed"))
    r = references.groupBy(key).agg(F.count(F.lit(1)).alias("referenced"), F.max(ts).alias("last_referenced"))
    return p.join(r, key, "full_outer").fillna(0, ["pushed", "referenced"])


def precision(records: DataFrame, pushed: str, referenced: str, session: str) -> DataFrame:
    """Sum of referenced over sum of pushed, null without records; distinct sessions."""
    return records.agg(F.count_distinct(session).alias("sessions"), F.count(F.lit(1)).alias("records"), F.round(F.try_divide(F.sum(referenced), F.sum(pushed)), 6).alias("precision"))


def concentration(items: DataFrame, tier: str, scope: str) -> DataFrame:
    """Share of the most frequent (tier, scope); degenerate where there is only one."""
    counts = items.groupBy(F.coalesce(tier, F.lit("")).alias("tier"), F.coalesce(scope, F.lit("")).alias("scope")).agg(F.count(F.lit(1)).alias("n"))
    top = counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("pairings"), F.min(F.struct((-F.col("n")).alias("n"), "tier", "scope")).alias("t"))
    return top.select("total", "pairings", F.col("t.tier").alias("top_tier"), F.col("t.scope").alias("top_scope"), F.round(F.try_divide(-F.col("t.n"), F.col("total")), 6).alias("share"), (F.col("pairings") <= 1).alias("degenerate"))


def calibration(ledger: DataFrame, tier: str, tiers: list[str], outcomes: dict[str, Column]) -> DataFrame:
    """Counts of outcomes per tier, with zero rows for tiers without any."""
    names = ledger.sparkSession.createDataFrame([(t,) for t in tiers], f"{tier} string")
    got = ledger.groupBy(tier).agg(*[F.count_if(c).alias(n) for n, c in outcomes.items()])
    return F.broadcast(names).join(got, tier, "left").fillna(0, list(outcomes))


def trailing_rate(runs: DataFrame, order: list[Column], top: str, bottom: str, most: int = 14) -> DataFrame:
    """Ratio of sums over the last runs; a top-k, not a sort of the ledger."""
    last = runs.orderBy(*order).limit(most)
    return last.agg(F.count(F.lit(1)).alias("runs"), F.round(F.avg(bottom), 6).alias("mean"), F.round(F.try_divide(F.sum(top), F.sum(bottom)), 6).alias("ratio"))


def headroom(ledger: DataFrame, bucket: str, cost: str, caps: dict[str, float]) -> DataFrame:
    """(bucket, consumed, cap, left, tripped) per bucket with a cap."""
    names = ledger.sparkSession.createDataFrame(list(caps.items()), f"{bucket} string, cap double")
    got = ledger.groupBy(bucket).agg(F.sum(cost).alias("consumed"))
    out = F.broadcast(names).join(got, bucket, "left").fillna(0.0, ["consumed"])
    return out.select(bucket, F.round("consumed", 4).alias("consumed"), "cap", F.round(F.col("cap") - F.col("consumed"), 4).alias("left"), (F.col("consumed") >= F.col("cap")).alias("tripped"))


def size_classes(rows: DataFrame, body: str, warn: int, flag: int) -> DataFrame:
    """(class, n, bytes): ok, warn or flag by UTF-8 size."""
    size = F.coalesce(F.octet_length(body), F.lit(0))
    kind = F.when(size >= flag, "flag").when(size >= warn, "warn").otherwise("ok")
    return rows.select(kind.alias("class"), size.alias("size")).groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
