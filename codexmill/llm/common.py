"""Shared plumbing of the training-data operators: inputs, shared folders, cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: Splits a text into words; `[^\x20\x09-\x0D]+` is a word.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A table is broadcast if its rows come to no more than so many bytes.
BROADCAST_BYTES = 8 << 20
#: A key with more rows than this is joined apart from the others.
HOT_ROWS = 50_000
#: While a table is written: its query's shuffle files go when it has ended, as what follows reads
#: the table.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Arrow batches of whole texts are bounded by bytes, not only by rows, in a session that uses
#: these operators.
_BATCH_BYTES, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset one
    of our own serves a single machine; on a cluster it would not be shared, which is an error."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"set spark.checkpoint.dir to a folder that driver and executors of {master} share")
    if "CODEXMILL_SHARED" not in os.environ:
        os.environ["CODEXMILL_SHARED"] = tempfile.mkdtemp(prefix="codexmill-")
    return os.environ["CODEXMILL_SHARED"].rstrip("/")


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of this session hold no more than BATCH_BYTES."""
    spark.conf.set(_BATCH_BYTES, str(BATCH_BYTES))


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, as a URI for Spark. What is written there goes when
    the application ends, or before that by `remove`."""
    bound_batches(spark)
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    fs, at = _file_system(spark, path)
    fs.mkdirs(at)  # only what exists can be marked
    fs.deleteOnExit(at)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path below the shared folder that nothing reads any more."""
    fs, at = _file_system(spark, path)
    fs.delete(at, True)


def mounted(uri: str) -> str:
    """The local path of a shared folder that all nodes mount. Operators that map files into
    memory need one; an object store has to be mounted for them."""
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return unquote(parts.path)
    raise ValueError(f"memory-mapped files need a mounted shared folder, not {uri}: pass one as the folder parameter")


def written_at(df: DataFrame, label: str = "cut") -> tuple[DataFrame, str]:
    """Write a table to the shared folder and read it again: (the table, its path). Cuts the
    lineage, so a lost executor costs no recomputation of what stands before it; the shuffle
    files of the writing query, which nothing reads any more, go at once."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, label: str = "cut") -> DataFrame:
    return written_at(df, label)[0]


def measure(rows: DataFrame, *more: Column) -> Row:
    """n and bytes of a (written) table: 8 for a number, text and lists by their length, 16 for
    each row; and more aggregates of it in the same job."""
    width = lambda c, t: F.octet_length(c) if t in ("string", "binary") else F.octet_length(F.to_json(F.struct(c))) if t.startswith(("array", "struct", "map")) else F.lit(8)
    row = sum((F.coalesce(width(F.col(f"`{c}`"), t), F.lit(0)) for c, t in rows.dtypes), F.lit(16))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(row.cast("long")), F.lit(0)).alias("bytes"), *more).first()


def fits(rows: DataFrame, bound: int | None = None) -> bool:
    """Whether a (written) table's rows come to at most BROADCAST_BYTES. `bound`: bytes that they
    are known not to exceed; a table that fits by it is not measured."""
    return bound is not None and bound <= BROADCAST_BYTES or measure(rows)["bytes"] <= BROADCAST_BYTES


def small(rows: DataFrame, bound: int | None = None) -> DataFrame:
    """A broadcast of a (written) table that `fits`; beyond that the join shuffles."""
    return F.broadcast(rows) if fits(rows, bound) else rows


def fresh(columns: list[str], *names: str) -> list[str]:
    """Names like `names` that no column bears (Spark compares without regard to case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns that can be hashed (maps can't)."""
    return F.xxhash64(*[F.col(f"`{c}`") for c, t in df.dtypes if "map<" not in t and "variant" not in t])


def attach(rows: DataFrame, facts: DataFrame, keys: list[str], hot: DataFrame) -> DataFrame:
    """Rows with the facts of their key, nulls where it has none. `facts` is a written table of a
    row per key. Where it is too large for a broadcast, the keys of `hot` (those that more than
    HOT_ROWS rows bear, so few) are still broadcast: none of them goes to one task."""
    if fits(facts) or hot.isEmpty():
        return rows.join(small(facts), keys, "left")
    many = small(written(hot.select(*keys).join(facts, keys, "left"), "hot"))
    return rows.join(many, keys).unionByName(rows.join(many.select(*keys), keys, "left_anti").join(facts, keys, "left"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of words, 0 for a null text."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE)
    # an array of at least one entry; only its ends can be empty
    return (F.size(parts) - F.when(parts[0] == "", 1).otherwise(0) - F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)).cast("long")


def crc_mod(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo `modulus` (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus
