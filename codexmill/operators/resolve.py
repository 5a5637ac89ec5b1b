"""Entity resolution: duplicates by exact signals, canonical rows, field-wise merges, look-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duplicates(persons: DataFrame, signals: list[str], name: str, canonical: list[str], key: str = "uid") -> DataFrame:
    """(absorbed, canonical, signal): each row that shares a signal with a better one, with the
    best row of the first signal (in order) that finds one.

    A group of n rows gives n - 1 links to its best row, not all its pairs; the links have the
    same components. Name groups count only with two or three rows: larger ones are common
    names. `canonical`: columns that rank rows, highest first; ties go to the least key."""
    best = F.struct(*[F.col(c).alias(f"r{i}") for i, c in enumerate(canonical)])
    arms = []
    for i, signal in enumerate([*signals, name]):
        known = persons.where(F.col(signal).isNotNull() & (F.col(signal).cast("string") != "")).select(key, F.col(signal).cast("string").alias("value"), best.alias("rank"))
        # the best by partial aggregation: no group is gathered
        top = known.groupBy("value").agg(F.max("rank").alias("rank"), F.count(F.lit(1)).alias("n"))
        heads = known.join(top, ["value", "rank"]).groupBy("value", "n").agg(F.min(key).alias("canonical"))
        heads = heads.where("n between 2 and 3" if signal == name else "n >= 2")
        arms.append(known.join(heads, "value").where(F.col(key) != F.col("canonical")).select(F.col(key).alias("absorbed"), "canonical", F.lit(i).alias("priority"), F.lit(signal).alias("signal")))
    links = reduce(lambda a, b: a.unionByName(b), arms)
    first = links.groupBy("absorbed").agg(F.min(F.struct("priority", "signal", "canonical")).alias("f"))
    return first.select("absorbed", F.col("f.canonical").alias("canonical"), F.col("f.signal").alias("signal"))


def merged(rows: DataFrame, group: str, policy: dict[str, str], order: list[Column]) -> DataFrame:
    """One row per group by field policy: `union` of arrays, `max` of numbers and dates, `first`
    non-null in the order of rank."""
    spec = {"max": lambda c: F.max(c), "union": lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))), "first": lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(*order)))}
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *[spec[p](c).alias(c) for c, p in policy.items()])


def lookup(names: DataFrame, index: DataFrame, name: str, alias: str, target: str, order: Column) -> DataFrame:
    """Case-folded name or alias to its target; of several the last by `order`."""
    last = index.groupBy(F.lower(alias).alias("_a")).agg(F.max_by(target, order).alias(target), F.count_distinct(target).alias("candidates"))
    return names.join(last, F.lower(names[name]) == F.col("_a"), "left").drop("_a")


def names_in_texts(texts: DataFrame, key: str, body: Column, names: DataFrame, name: str, words: int) -> DataFrame:
    """(key, name): names of `words` words that occur in a text at word boundaries. Word n-grams
    meet names by an equality join, not by a search for each name in each text; an n-gram is a
    pairwise concatenation of the text's words with the words after them."""
    w = F.regexp_extract_all(F.lower(F.coalesce(body, F.lit(""))), F.lit("[a-z0-9]+"), 0)
    grams, parts = F.col("w"), texts.select(key, w.alias("w")).where(F.size("w") >= words)
    for k in range(1, words):
        grams = F.zip_with(F.slice(grams, 1, F.size("w") - k), F.slice("w", k + 1, F.size("w") - k), lambda a, b: F.concat(a, F.lit(" "), b))
    wanted = names.select(F.lower(name).alias("gram"), F.col(name).alias("name")).distinct()
    return parts.select(key, F.explode(grams).alias("gram")).join(wanted, "gram").select(key, "name").distinct()


def divergence(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only one of two surfaces has."""
    l, r = left.select(key).distinct(), right.select(key).distinct()
    return l.join(r, key, "left_anti").withColumn("side", F.lit("left")).unionByName(r.join(l, key, "left_anti").withColumn("side", F.lit("right")))


def longest_prefix(rows: DataFrame, value: str, rates: DataFrame, prefix: str, lengths: list[int]) -> DataFrame:
    """Rows with the entry whose prefix is the longest that fits (nulls where none fits). Only
    distinct values are looked up; prefix lengths are few, so candidates are exploded and joined
    by equality."""
    names = rows.select(F.col(value).alias("_value")).distinct()
    cut = names.select("_value", F.explode(F.array_distinct(F.array(*[F.substring(F.col("_value"), 1, n) for n in sorted(lengths)]))).alias(prefix))
    fits = cut.join(rates, prefix).groupBy("_value").agg(F.max_by(F.struct(*rates.columns), F.length(prefix)).alias("_rate"))
    return rows.join(fits, rows[value] == fits["_value"], "left").select(*rows.columns, *[F.col(f"_rate.{c}").alias(c) for c in rates.columns])


def first_per(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key. A rank limit applies in map tasks before the shuffle."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
