"""Sources and sinks of pages, intake files, ledgers and manifests."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codexmill.functions.records import envelope
from codexmill.operators.rules import glob

# Fixed value: intake names carry a time stamp and eight hex digits.
INTAKE = r"^(\d{8}T\d{6}Z?)-([0-9a-f]{8})\.(md|jsonl)$"


def relative(root: str) -> Column:
    """The part of a file's path below a root folder."""
    last = root.rstrip("/").rsplit("/", 1)[-1] + "/"
    return F.substring(F.col("path"), F.instr(F.col("path"), F.lit(last)) + len(last), F.length("path"))


def pages(spark: SparkSession, root: str, recursive: bool = False) -> DataFrame:
    """(name, path, length, modified, content) of markdown pages; names and folders that begin
    with `_` are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", str(recursive).lower()).load(root)
    rows = files.select(relative(root).alias("name"), "path", "length", F.col("modificationTime").alias("modified"), F.col("content").cast("string").alias("content"))
    return rows.where(~F.exists(F.split("name", "/"), lambda part: part.startswith("_")))


def frontmatter(content: Column) -> tuple[Column, Column]:
    """(metadata text, body): the block between two lines of `---` at the beginning."""
    block = r"(?s)^---\r?\n(.*?)\r?\n---\r?\n?(.*)$"
    has = content.rlike(block)
    return F.when(has, F.regexp_extract(content, block, 1)).otherwise(""), F.when(has, F.regexp_extract(content, block, 2)).otherwise(content)


def scalar(meta: Column, field: str) -> Column:
    """A scalar field of the metadata; null where it is missing or empty."""
    got = F.regexp_extract(meta, rf"(?m)^{field}:[ \t]*(.*?)[ \t]*$", 1)
    return F.nullif(F.regexp_replace(got, "^[\"']|[\"']$", ""), F.lit(""))


def listed(meta: Column, field: str) -> Column:
    """A list field, in brackets or as `- item` lines; an empty array where it is missing."""
    inline = F.regexp_extract(meta, rf"(?m)^{field}:[ \t]*\[(.*?)\][ \t]*$", 1)
    lines = F.regexp_extract(meta, rf"(?m)^{field}:[ \t]*\r?\n((?:[ \t]*-[ \t]+.*(?:\r?\n|$))+)", 1)
    clean = lambda parts: F.filter(F.transform(parts, lambda x: F.regexp_replace(F.trim(x), "^[\"']|[\"']$", "")), lambda x: x != "")
    return F.when(inline != "", clean(F.split(inline, ","))).otherwise(clean(F.regexp_extract_all(lines, F.lit(r"(?m)^[ \t]*-[ \t]+(.*)$"), 1)))


def entities(pages_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) pages: uid, type and name are required, other metadata stays as text."""
    meta, body = frontmatter(F.col("content"))
    rows = pages_.withColumn("meta", meta).withColumn("body", body)
    for field in ("uid", "type", "name", "access", "valid_until"):
        rows = rows.withColumn(field if field != "name" else "title", scalar(F.col("meta"), field))
    rows = rows.withColumn("aliases", listed(F.col("meta"), "aliases")).withColumn("tags", listed(F.col("meta"), "tags"))
    good = F.col("uid").isNotNull() & F.col("type").isNotNull() & F.col("title").isNotNull()
    return rows.where(good), rows.where(~good)


def intake(spark: SparkSession, root: str) -> DataFrame:
    """(source, stamp, id8, path, length, content) of raw intake files, oldest first."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.where(name.rlike(INTAKE)).select(F.element_at(F.split("path", "/"), -2).alias("source"), F.regexp_extract(name, INTAKE, 1).alias("stamp"), F.regexp_extract(name, INTAKE, 2).alias("id8"), "path", "length", F.col("content").cast("string").alias("content"))
    return rows.orderBy("stamp", "path")


def all_entries(spark: SparkSession, wiki: str, extras: dict[str, str], include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Pages of the wiki and, by recursion, of extra roots, whose names begin with the root's; a
    name must fit an `include` pattern, if there are any, and no `exclude` pattern."""
    rows = pages(spark, wiki)
    for name, root in extras.items():
        rows = rows.unionByName(pages(spark, root, recursive=True).withColumn("name", F.concat(F.lit(name + "/"), "name")))
    return rows.where(passes(F.col("name"), include or [], exclude or []))


def passes(name: Column, include: list[str], exclude: list[str]) -> Column:
    hit = lambda globs: reduce(lambda a, b: a | b, [name.rlike(glob(g)) for g in globs], F.lit(False))
    return (hit(include) if include else F.lit(True)) & ~hit(exclude)


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(name, length, version) of all files below a root, without their contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    stamp = F.unix_micros("modificationTime").cast("string")
    return files.select(relative(root).alias("name"), "length", F.concat_ws("-", stamp, F.col("length").cast("string")).alias("version"))


def changed(listed: DataFrame, manifest: DataFrame) -> DataFrame:
    """(name, change) between a listing and a manifest (name, version): only these are read."""
    both = listed.select("name", F.col("version").alias("_a")).join(manifest.select("name", F.col("version").alias("_b")), "name", "full_outer")
    return both.select("name", F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed").alias("change")).where("change is not null")


def memories(spark: SparkSession, root: str, kinds: list[str]) -> DataFrame:
    """(scope, kind, slug, path, content) of `<scope>/<kind>_<slug>.md` files; indexes and names
    of other kinds are left out."""
    shape = r"([^/]+)/(" + "|".join(kinds) + r")_([^/]+)\.md$"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(root)
    part = lambda i: F.regexp_extract("path", shape, i)
    return files.where(F.col("path").rlike(shape)).select(part(1).alias("scope"), part(2).alias("kind"), part(3).alias("slug"), "path", F.col("content").cast("string").alias("content"))


def batches(spark: SparkSession, root: str) -> DataFrame:
    """(name, first) of the JSON-lines files whose first line opens a batch."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", "true").load(root)
    first = F.split(F.col("content").cast("string"), "\n")[0]
    return files.select(relative(root).alias("name"), first.alias("first")).where(envelope(F.col("first")))


def unclaimed(listed: DataFrame, claimed: DataFrame, exempt: DataFrame) -> DataFrame:
    """(name, reason) of intake files that no reader takes: a wrong extension at the first level,
    or a depth that none looks at. Claimed and exempt names are left out."""
    parts = F.split("name", "/")
    ext = F.lower(F.regexp_extract("name", r"\.([^./]+)$", 1))
    reason = F.when((F.size(parts) == 2) & ~ext.isin("md", "jsonl"), "unmatched-extension").when(F.size(parts) > 2, "too-deep")
    rows = listed.where(F.element_at(parts, -1) != ".gitkeep").join(claimed.select("name"), "name", "left_anti").join(exempt.select("name"), "name", "left_anti")
    return rows.select("name", reason.alias("reason")).where("reason is not null")


def dangling(index: DataFrame, listed: DataFrame) -> DataFrame:
    """(scope, target) of index lines `- [..](target)` whose file is gone; `index`: scope, content."""
    targets = index.select("scope", F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^\s*[-*]\s+\[[^\]]*\]\(([^)\s]+)\)"), 1)).alias("target"))
    return targets.withColumn("name", F.concat_ws("/", "scope", "target")).join(listed.select("name"), "name", "left_anti").select("scope", "target")


def torn(spark: SparkSession, path: str, schema: str) -> int:
    """How many lines of a ledger can't be read by its schema."""
    parsed = F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    return spark.read.text(path).select(parsed.alias("r")).where("r._bad is not null").count()


def ledger(spark: SparkSession, path: str, schema: str, ts: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """A JSON-lines ledger with a schema; torn lines are left out; [since, until) by `ts`."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    if since:
        rows = rows.where(F.try_to_timestamp(ts) >= F.lit(since).cast("timestamp"))
    return rows.where(F.try_to_timestamp(ts) < F.lit(until).cast("timestamp")) if until else rows


def append(rows: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Append to a ledger, partitioned by columns such as the month."""
    rows.write.mode("append").partitionBy(*(by or [])).json(path)


def run_summary(spark: SparkSession, path: str) -> DataFrame:
    """key=value log lines as maps."""
    lines = spark.read.text(path)
    pairs = F.transform(F.regexp_extract_all("value", F.lit(r"(\w+=[^\s]+)"), 1), lambda p: F.split(p, "=", 2))
    return lines.select(F.map_from_entries(F.transform(pairs, lambda p: F.struct(p[0], p[1]))).alias("fields"))
