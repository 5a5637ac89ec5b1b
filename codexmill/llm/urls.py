"""URL filters: a blocked Bloom filter of listed canonical URLs in front of an exact join.

A listed entry is a host and a path prefix. It fits its host and all subdomains where the url's
path starts with the entry's. A distinct (host, path) therefore has few candidate entries: the
host's dot suffixes times the path's prefixes of the lengths that occur in the list. The filter
is a table of 512-bit blocks; a candidate hashes to one block and must find all its bits there.
Only possible hits reach the exact join on (host, path), which drops the false positives.

Verdict: the longest fitting entry's; the default (allow) where none fits.

Defined results: a null url, or one without `://`, has empty host and path and gets the
default; repeated pages are judged alike; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WORDS, PROBES = 8, 6  # 64-bit words in a block; bits set per entry
#: Up to so many filter blocks (64 bytes each) or entries are broadcast; more are joined by a shuffle.
BROADCAST_BLOCKS, BROADCAST_ENTRIES = 200_000, 100_000

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = common.lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "rule_host string, rule_path string, rule_verdict string")


def _hash(host: Column, path: Column) -> Column:
    return F.xxhash64(host, path)


def _bits(h: Column) -> Column:
    """An entry's bit places in its block, one for each probe."""
    return F.transform(F.sequence(F.lit(0), F.lit(PROBES - 1)), lambda i: F.pmod(F.xxhash64(h, i), F.lit(64 * WORDS)))


def bloom(entries: DataFrame, blocks: int) -> DataFrame:
    """(block, w0 .. w7): the 512-bit blocks that have entries."""
    keyed = entries.select(_hash(F.col("rule_host"), F.col("rule_path")).alias("h")).distinct()
    set_bits = keyed.select(F.pmod(F.col("h"), F.lit(blocks)).alias("block"), F.explode(_bits(F.col("h"))).alias("bit"))
    words = set_bits.select("block", F.floor(F.col("bit") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, cast(bit % 64 as int))").alias("value"))
    return words.groupBy("block").pivot("word", list(range(WORDS))).agg(F.bit_or("value")).select("block", *[F.coalesce(F.col(str(w)), F.lit(0).cast("long")).alias(f"w{w}") for w in range(WORDS)])


def judge(pages: DataFrame, entries: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """page_id, host, path, rule and verdict of every page. `entries`: rule_host, rule_path,
    rule_verdict; of entries listed more than once with different verdicts the least verdict
    by name holds."""
    host, path = host_and_path(F.col(url))
    pages = pages.select("page_id", host.alias("host"), path.alias("path"))
    entries = entries.groupBy("rule_host", "rule_path").agg(F.min("rule_verdict").alias("rule_verdict"))
    n, lengths = entries.agg(F.count(F.lit(1)), F.collect_set(F.length("rule_path"))).first()  # at most as many lengths as the longest path
    blocks = max(1, -(-n * 12 // (64 * WORDS)))  # about 12 bits an entry
    urls = common.written(pages.where("host <> ''").groupBy("host", "path").agg(F.count(F.lit(1)).alias("rows")), "urls")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefix_of = F.filter(F.array(*[F.lit(int(x)) for x in sorted(lengths)]) if lengths else F.array().cast("array<int>"), lambda k: k <= F.length("path"))
    candidates = urls.select("host", "path").withColumn("rule_host", F.explode(suffixes)).withColumn("_k", F.explode(prefix_of)).withColumn("rule_path", F.expr("substring(path, 1, _k)"))
    candidates = candidates.withColumn("_h", _hash(F.col("rule_host"), F.col("rule_path"))).withColumn("block", F.pmod(F.col("_h"), F.lit(blocks)))
    filters = bloom(entries, blocks)
    hits = candidates.join(F.broadcast(filters) if blocks <= BROADCAST_BLOCKS else filters, "block")
    for i in range(PROBES):
        bit = F.pmod(F.xxhash64(F.col("_h"), F.lit(i)), F.lit(64 * WORDS))
        word = F.element_at(F.array(*[F.col(f"w{w}") for w in range(WORDS)]), (F.floor(bit / 64) + 1).cast("int"))
        hits = hits.where(F.getbit(word, (bit % 64).cast("int")) == 1)
    hits = hits.select("host", "path", "rule_host", "rule_path")
    exact = hits.join(F.broadcast(entries) if n <= BROADCAST_ENTRIES else entries, ["rule_host", "rule_path"])
    rule = F.concat("rule_host", "rule_path")
    best = exact.groupBy("host", "path").agg(F.max(F.struct(F.length(rule).alias("n"), F.length("rule_host").alias("m"), rule.alias("rule"), F.col("rule_verdict").alias("verdict"))).alias("best"))
    best = common.written(best.select("host", "path", "best.rule", "best.verdict"), "judged")
    # urls without a host need no look-up, and one url on very many pages is not dealt to one task
    named = common.attach(pages.where("host <> ''"), best, ["host", "path"], urls.where(F.col("rows") > common.HOT_ROWS))
    none = pages.where("host = ''").withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(None).cast("string")})
    return named.unionByName(none).select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
