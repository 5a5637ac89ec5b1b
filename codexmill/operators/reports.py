"""Small aggregates over ledgers and groups: rates, distributions, digests, outcomes, routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def per_day(rows: DataFrame, ts: Column, now: Column, days: int) -> DataFrame:
    """(matched, per_day) of the `days` up to now, both ends included."""
    inside = rows.where((ts >= now - F.make_dt_interval(F.lit(days))) & (ts <= now))
    return inside.agg(F.count(F.lit(1)).alias("matched")).withColumn("per_day", F.round(F.col("matched") / days, 6) if days > 0 else F.lit(0.0))


def sizes(groups: DataFrame, size: str) -> DataFrame:
    """(size, groups, pairs): how many groups of each size, and the comparisons inside them."""
    got = groups.groupBy(F.col(size).alias("size")).agg(F.count(F.lit(1)).alias("groups"))
    return got.withColumn("pairs", F.floor(F.col("groups") * F.col("size") * (F.col("size") - 1) / 2).cast("long"))


def digest(rows: DataFrame, name: Column, body: Column) -> DataFrame:
    """One hash of all rows in any order: of their names and the hashes of their bodies. Names and
    hashes meet in one row, so this is for the listing of a corpus, not for its texts."""
    part = F.concat(name, F.lit(":"), F.substring(F.sha2(F.coalesce(body, F.lit("")).cast("binary"), 256), 1, 12))
    return rows.agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list(part)), "\n").cast("binary"), 256), 1, 16).alias("digest"))


def duty(branches: DataFrame, key: str, inside: str, nights: str) -> DataFrame:
    """(key, duty): nights in a wave of all nights; 0 without any."""
    return branches.select(key, F.round(F.coalesce(F.try_divide(inside, nights), F.lit(0.0)), 6).alias("duty"))


def observations(rows: DataFrame, contract: str, mismatch: Column, known: list[str]) -> DataFrame:
    """(contract, observations, mismatches, rate, no_data) of known contracts, seen or not."""
    names = rows.sparkSession.createDataFrame([(k,) for k in known], "contract string")
    got = rows.groupBy(F.col(contract).alias("contract")).agg(F.count(F.lit(1)).alias("n"), F.count_if(mismatch).alias("m"))
    out = F.broadcast(names).join(got, "contract", "left")
    return out.select("contract", F.coalesce("n", F.lit(0)).alias("observations"), F.coalesce("m", F.lit(0)).alias("mismatches"), F.round(F.try_divide("m", "n"), 6).alias("rate"), F.col("n").isNull().alias("no_data"))


def outcomes(records: DataFrame, batch: str, disposition: str) -> DataFrame:
    """(batch, disposition, n) with a total of each batch, in one pass of grouping sets."""
    got = records.groupingSets([[F.col(batch), F.col(disposition)], [F.col(batch)]], batch, disposition).agg(F.count(F.lit(1)).alias("n"), F.grouping(disposition).alias("_g"))
    return got.select(batch, F.when(F.col("_g") == 1, "total").otherwise(F.col(disposition)).alias(disposition), "n")


def fresh(stale: Column) -> Column:
    """Whether a verdict may authorise an operation by itself: nothing has marked it stale."""
    return F.trim(F.coalesce(stale, F.lit(""))) == ""


def opened(registry: DataFrame, asked: DataFrame, key: str, days: int = 30) -> DataFrame:
    """(key, state, version, wave_open, nights_in_wave, nights_total, batch_interval_days) of the
    branches that epochs are asked for. An open wave refuses and stays as it is; else the wave opens
    with the version asked for and its interval (`days` where none is given), its nights begin anew
    and those in all go on. A branch that the registry lacks begins with none."""
    held = ("version", "wave_open", "nights_in_wave", "nights_total", "batch_interval_days")
    rows = asked.select(key, F.col("version").alias("_version"), F.coalesce("batch_interval_days", F.lit(days)).alias("_days")).join(registry.select(key, *held), key, "left")
    refused = F.coalesce("wave_open", F.lit(False))
    pick = lambda c, new: F.when(refused, F.col(c)).otherwise(new).alias(c)
    state = F.when(refused, "refused").otherwise("opened").alias("state")
    return rows.select(key, state, pick("version", F.col("_version")), F.lit(True).alias("wave_open"), pick("nights_in_wave", F.lit(0).cast("long")), F.coalesce("nights_total", F.lit(0)).cast("long").alias("nights_total"), pick("batch_interval_days", F.col("_days")))


def migrated(value: Column, rules: list[tuple[str, str]]) -> Column:
    """Old values in new form, by replacements in order."""
    for pattern, to in rules:
        value = F.regexp_replace(value, pattern, to)
    return value


def worksheet(events: DataFrame, session: str, item: str, wanted: Column, pushed: Column) -> DataFrame:
    """(session, missed): distinct items that a session wanted and was not pushed, sorted."""
    each = events.groupBy(session, item).agg(F.max(wanted).alias("_w"), F.max(pushed).alias("_p"))
    missed = F.array_sort(F.collect_list(F.when(F.col("_w") & ~F.col("_p"), F.col(item))))
    return each.groupBy(F.col(session).alias("session")).agg(missed.alias("missed"))


def retirement(members: DataFrame, keys: list[str], order: str, held: Column, keep: int) -> DataFrame:
    """Members with their disposition: held ones stay, the newest `keep` of a key move, older ones retire."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return members.withColumn("disposition", F.when(held, "hold").when(place > keep, "retire").otherwise("move"))


def routed(rows: DataFrame, kind: str, routes: DataFrame, default: str) -> DataFrame:
    """Rows with the surface of their class (kind, surface, embedded); an unrouted class goes to
    the default surface and is embedded."""
    names = routes.select(F.col("kind").alias("_k"), F.col("surface"), F.col("embedded"))
    out = rows.join(F.broadcast(names), F.trim(kind) == F.col("_k"), "left").drop("_k")  # a row per class
    return out.withColumns({"surface": F.coalesce("surface", F.lit(default)), "embedded": F.coalesce("embedded", F.lit(True))})
