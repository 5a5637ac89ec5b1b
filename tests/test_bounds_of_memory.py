"""Steps whose memory or result must not hang on the size of a batch, a key or a second reading."""

import pyarrow as pa
from pyspark.sql import functions as F

from codexmill.catalog import pages
from codexmill.operators import cluster as K
from codexmill.operators import handles as H
from codexmill.operators import lexical as X


def test_a_stopped_stream_loses_no_row(spark, tmp_path, monkeypatch):
    events = [(i, "2024-01-01 00:00:00", i % 7, "error" if i > 50 else "purchase") for i in range(600)]
    frame = spark.createDataFrame(events, "event_id long, ts string, user_id long, event_type string").withColumn("ts", F.col("ts").cast("timestamp"))
    frame.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(pages.F, "percentile_approx", lambda column, part: F.max(column) * part + F.pmod(F.unix_micros(F.now()), F.lit(200)))  # another one each time that it is worked out
    got = sorted(map(tuple, pages.bound_violations(spark, str(tmp_path)).collect()))
    rows = frame.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), F.to_date("ts").cast("string").alias("content"), (F.col("event_type") != "purchase").alias("violated"))
    assert got == sorted(map(tuple, pages.bounds.folded(rows, 3).collect()))


def test_words_are_counted_in_slices(monkeypatch):
    monkeypatch.setattr(X, "SLICE_BYTES", 100)
    texts = [None, "one two " * 5, "", *["running runs"] * 40, "long " * 100]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts), pa.array(["x"] * len(texts))], ["id", "_f0", "_f1"])
    out = list(X._counted(2, 0)(iter([batch])))
    assert len(out) > 5 and max(x.num_rows for x in out) < 40
    every = pa.Table.from_batches(out).to_pylist()
    assert sum(r["term"] is None for r in every) == len(texts)
    assert sum(r["tf"][0] for r in every if r["term"] == "run") == 80


def test_targets_without_a_key_are_dealt(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(before, ("-1", "false", "8")):
            spark.conf.set(k, v)
        targets = spark.range(4000).selectExpr("id", "cast(null as string) uid", "cast(null as string) type", "cast(null as string) name", "'fax' key", "'12' value")
        wanted = spark.createDataFrame([(9001, "c1", None, None, None, None), (9002, None, "person", " Ann", None, None), (9003, None, None, None, "linkedin", "in/1"), (9004, None, None, None, "email", " A@x.io")], "id long, uid string, type string, name string, key string, value string")
        known = spark.createDataFrame([("c1", "person", "ann", 1)], "uid string, type string, name string, seq int")
        index = spark.createDataFrame([("linkedin", "in/1", "c1")], "key string, value string, uid string")
        mails = spark.createDataFrame([("a@x.io", 1, "c1")], "address string, uids long, uid string")
        out = H.resolve(targets.unionByName(wanted), known, index, mails, ["linkedin"])
        assert {r.id for r in out.where("kind = 'existing' and page = 'c1'").collect()} == {9001, 9002, 9003, 9004}
        sizes = out.groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert sum(r["count"] for r in sizes) == 4004 and max(r["count"] for r in sizes) < 1500
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_topics_of_whole_and_split_members(spark):
    rows = [("s", 1, "b b b a"), ("s", 2, "a c"), ("s", 3, "c b"), (None, 4, "z"), ("t", None, "")]
    one = spark.createDataFrame(rows, "g string, k int, t string")
    words = F.regexp_extract_all(F.lower("t"), F.lit("[a-z]+"), 0)
    want = {"s": "b-a-c", None: "z"}
    assert {r.g: r.topic for r in K.topic_words(one, "g", "k", words).collect()} == want
    split = spark.createDataFrame([("s", 1, "b b"), ("s", 1, "b a"), *rows[1:]], "g string, k int, t string")
    assert {r.g: r.topic for r in K.topic_words(split, "g", "k", words).collect()} == want
    plan = K.topic_words(one, "g", "k", words)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") < 3  # words are not shuffled per member
