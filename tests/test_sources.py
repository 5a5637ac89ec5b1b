from pyspark.sql import functions as F

from codexmill.sources import files
from codexmill.streaming import ingest

PAGE = '---\nuid: u1\ntype: person\nname: "Jane"\naliases: [J, "Jay"]\ntags:\n  - a\n  - b\n---\nBody of [[Other|x]].\n'


def test_pages_and_entities(spark, tmp_path):
    (tmp_path / "wiki").mkdir()
    (tmp_path / "wiki" / "jane.md").write_text(PAGE)
    (tmp_path / "wiki" / "_index.md").write_text(PAGE)
    (tmp_path / "wiki" / "bare.md").write_text("no metadata")
    pages = files.pages(spark, str(tmp_path / "wiki"))
    assert sorted(r.name for r in pages.select("name").collect()) == ["bare.md", "jane.md"]
    good, bad = files.entities(pages)
    r = good.first()
    assert (r.uid, r.title, r.aliases, r.tags, r.body) == ("u1", "Jane", ["J", "Jay"], ["a", "b"], "Body of [[Other|x]].\n")
    assert [x.name for x in bad.collect()] == ["bare.md"]


def test_ledger_skips_torn_lines_and_windows(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"ts": "2024-01-01T00:00:00Z", "n": 1}\n{"ts": "2024-02-01T00:00:00Z", "n": 2}\n{"ts": "2024-0')
    got = files.ledger(spark, str(tmp_path / "l.jsonl"), "ts string, n int", "ts", "2024-01-15", "2024-03-01")
    assert [r.n for r in got.collect()] == [2]


def test_intake_names(spark, tmp_path):
    (tmp_path / "raw" / "src").mkdir(parents=True)
    (tmp_path / "raw" / "src" / "20240101T000000Z-0a1b2c3d.md").write_text("x")
    (tmp_path / "raw" / "src" / "notes.md").write_text("y")
    assert [(r.source, r.id8) for r in files.intake(spark, str(tmp_path / "raw")).collect()] == [("src", "0a1b2c3d")]


def test_ingest_takes_each_file_once(spark, tmp_path):
    seen = []
    spark.range(3).write.parquet(str(tmp_path / "in"))
    handle = lambda df, n: seen.append(df.count())
    run = lambda: ingest.ingest(spark, str(tmp_path / "in"), "id long", str(tmp_path / "cp"), handle).awaitTermination()
    run()
    run()
    assert sum(seen) == 3
    spark.range(3, 5).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert sum(seen) == 5


def test_temporal_class_flags(spark):
    d = spark.sql("select date'2024-01-01' r, date'2024-01-02' f, date'2020-01-01' b")
    got = d.select(ingest.temporal_class(F.col("f"), F.col("r")), ingest.temporal_class(F.col("b"), F.col("r")), ingest.temporal_class(F.col("r"), F.col("r"))).first()
    assert tuple(got) == ("future", "backdated", "ok")
