"""From raw documents to balanced shards of a training mix.

Each stage works on all rows that the one before it kept, written as Parquet in between; the
first four return the columns of documents, the last the placement of every drawn row.

Defined results: an empty table passes all stages and gives no rows. Null and empty texts are
not toxic, no duplicates and not contaminated; the mix draws them like other rows of their
source, and they take a place of 8 bytes in a shard. Rows of a null doc_id are rows like others.
Repeated rows with words are copies, of which one stays. Extra columns pass the first four stages
unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codexmill.llm import common, decontaminate, mixing, neardup, sharding, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: documents of score 0.7 or more go."""
    return toxicity.drop_toxic(docs, common.table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: one document of each group stays (shingles of five words, 0.8)."""
    return neardup.drop_duplicates(docs, percent=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a test item go."""
    return decontaminate.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights: each document as often as it is drawn."""
    return mixing.mix_rows(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sharding: doc_id, size, text_crc32, shard and slot of every drawn row."""
    return sharding.assign(docs, 24)


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("decontamination", drop_benchmark), ("mixing", mix), ("sharding", shard)]

#: Trained models and hashed signatures are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
