"""Queues of decisions as folds over append-only tables: what is open, what a gate retires, what a
decision changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexmill.functions import text as T


def blocks(text: Column) -> Column:
    """The `## ` blocks of a text in order, from heading to heading or rule; inside a code fence
    neither counts. One fold over the lines."""
    start = F.struct(F.lit(False).alias("fenced"), F.lit(False).alias("open"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, line: Column) -> Column:
        fence = F.startswith(F.ltrim(line), F.lit("```"))
        head = ~s["fenced"] & ~fence & F.startswith(line, F.lit("## "))
        rule = ~s["fenced"] & ~fence & (F.trim(line) == "---")
        last = F.concat(F.try_element_at(s["out"], F.lit(-1)), F.lit("\n"), line)
        grown = F.concat(F.slice(s["out"], 1, F.greatest(F.size(s["out"]) - 1, F.lit(0))), F.array(last))
        out = F.when(head, F.concat(s["out"], F.array(line))).when(rule | ~s["open"], s["out"]).otherwise(grown)
        return F.struct((s["fenced"] != fence).alias("fenced"), (head | (s["open"] & ~rule)).alias("open"), out.alias("out"))

    found = F.aggregate(F.split(F.coalesce(text, F.lit("")), "\n"), start, step)["out"]
    return F.transform(found, lambda b: F.regexp_replace(b, r"\s+$", ""))


def merge_id(sources: Column, target: Column) -> Column:
    """12 hex digits of the sorted sources and the target's name."""
    return F.substring(F.sha1(F.concat(F.array_join(F.array_sort(sources), "\n"), F.lit("\n"), F.trim(target)).cast("binary")), 1, 12)


def question_id(header: Column, question: Column) -> Column:
    return F.substring(F.sha1(F.concat(F.trim(header), F.lit("\n"), F.trim(question)).cast("binary")), 1, 12)


def source_slugs(sources: Column) -> Column:
    """Distinct slugs of the sources' file names, in order."""
    stem = lambda s: F.regexp_replace(F.element_at(F.split(s, "/"), -1), r"(?<=.)\.[^.]*$", "")
    return F.array_distinct(F.filter(F.transform(sources, lambda s: T.slugify(stem(s))), lambda s: s != ""))


def append_once(queue: DataFrame, fresh: DataFrame, key: str, order: str) -> DataFrame:
    """The queue with fresh rows whose key it does not have; of fresh rows with one key the first."""
    first = fresh.groupBy(key).agg(F.min_by(F.struct(*[c for c in fresh.columns if c != key]), order).alias("_f")).select(key, "_f.*")
    return queue.unionByName(first.join(queue.select(key), key, "left_anti"))


def open_rows(ledger: DataFrame, key: str, kind: str, raised: str, settled: list[str]) -> DataFrame:
    """Rows of one kind whose key no settling row of the same ledger names."""
    done = ledger.where(F.col(kind).isin(*settled)).select(key).distinct()
    return ledger.where(F.col(kind) == raised).join(done, key, "left_anti")


def retired(queue: DataFrame, reason: Column) -> DataFrame:
    """Open proposals with the reason that the present gates give against them; null: kept."""
    return queue.where("not resolved").withColumn("reason", reason)


def decided(queue: DataFrame, decisions: DataFrame, key: str, order: str) -> DataFrame:
    """(key, decision) of each proposal: its first decision; null while it is open. A later one
    changes nothing."""
    first = decisions.groupBy(F.col(key).alias("_k")).agg(F.min_by("decision", order).alias("decision"))
    return queue.join(first, F.col(key) == F.col("_k"), "left").drop("_k")


def folded(merges: DataFrame, key: str, target: str, sources: str) -> DataFrame:
    """(source, target) of approved merges: each source page gives way to its target; a source of
    several approved merges goes to the first by key."""
    each = merges.where("decision = 'approve'").select(key, F.col(target).alias("target"), F.explode(sources).alias("source")).where("source <> target")
    return each.groupBy("source").agg(F.min_by("target", key).alias("target"))


def raised(files: DataFrame, reason: Column, group: str, name: str, seen: DataFrame, most: int = 5) -> DataFrame:
    """(reason, key, files, samples) of unclaimed files: one decision for each reason and group
    that has not been raised before, with the first `most` names as samples."""
    rows = files.select(reason.alias("reason"), F.col(group).alias("key"), F.col(name).alias("name")).where("reason is not null")
    ranked = rows.groupBy("reason", "key").agg(F.count(F.lit(1)).alias("files"), F.min_by("name", "name").alias("first"))
    from pyspark.sql import Window

    order = Window.partitionBy("reason", "key").orderBy("name")
    top = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).groupBy("reason", "key").agg(F.array_sort(F.collect_list("name")).alias("samples"))
    return ranked.join(top, ["reason", "key"]).join(seen, ["reason", "key"], "left_anti").select("reason", "key", "files", "samples")


def latest_exemplars(rows: DataFrame, keys: list[str], seq: str, k: int) -> DataFrame:
    """The k last rows of each key, newest first (`place` from 1); a rank limit holds before the shuffle."""
    from pyspark.sql import Window

    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(seq)))).where(F.col("place") <= k)


def sources_first(rows: DataFrame, mine: Column, order: list[str]) -> list[Column]:
    """An order that puts the caller's rows first and keeps the rest as it is."""
    return [F.when(mine, 0).otherwise(1), *[F.col(c) for c in order]]
