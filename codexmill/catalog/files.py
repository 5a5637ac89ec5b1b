"""Queries of sources and sinks, over a tree of pages, intake and ledgers written from the nations."""

from __future__ import annotations

import os

from pyspark.sql import functions as F
from urllib.parse import unquote, urlparse

from codexmill.functions import records as S
from codexmill.operators import cluster as K
from codexmill.registered import query
from codexmill.session import table
from codexmill.sources import files as X
from codexmill.sources import store as O
from codexmill.streaming import ingest as I

_TREES: dict[tuple[str, str], str] = {}


def _put(path: str, text: str) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def tree(spark, sf) -> str:
    """The folder of the fixture: 25 nations as pages, intake files, memories and ledgers."""
    at = (spark.sparkContext.applicationId, sf)
    if at in _TREES:
        return _TREES[at]
    root = unquote(urlparse(K.shared(spark, "tree")).path)
    for r in table(spark, sf, "nation").orderBy("n_nationkey").collect():  # 25 rows
        k, name, region = r["n_nationkey"], r["n_name"], r["n_regionkey"]
        slug = name.lower().replace(" ", "-")
        uid = "" if k % 9 == 0 else f"uid: n{k}\n"
        page = f"---\n{uid}type: {'place' if k % 2 else 'land'}\nname: {name}\ntags: [r{region}, t{k % 3}]\naliases:\n  - {slug}-x\n  - \"{k}\"\nvalid_until: 2024-01-{k + 1:02d}\n---\nBody of {name}. See [[r{region}]].\n"
        _put(f"{root}/wiki/{slug}.md", page)
        _put(f"{root}/wiki/_private/{slug}.md", "hidden")
        if k % 4 == 1:
            _put(f"{root}/extra/r{region}/{slug}.md", page)
            _put(f"{root}/extra/_r{region}/{slug}.md", page)
        _put(f"{root}/raw/s{region}/202401{k + 1:02d}T000000Z-{k:08x}.{'md' if k % 2 else 'txt'}", "x" * (k + 1))
        if k % 5 == 0:
            first = '{"record": "batch", "schema_version": %s, "batch_id": "b%d", "created_at": "2024"}' % (1 if k else 2, k)
            _put(f"{root}/raw/s{region}/batch-{k}.jsonl", first + '\n{"op": "set"}\n')
            _put(f"{root}/raw/s{region}/deep/file-{k}.md", "deep")
        kind = ("user", "feedback", "odd")[k % 3]
        _put(f"{root}/memory/scope-{region}/{kind}_{slug}.md", f"memory {k}")
        _put(f"{root}/memory/scope-{region}/MEMORY-{k}.md", "index")
    _put(f"{root}/wiki/_index.md", "index")
    rows = "".join(f'{{"id": {i}, "ts": "2024-01-{i % 28 + 1:02d}T00:00:00Z", "cost": {i / 4}}}\n' for i in range(100))
    _put(f"{root}/ledgers/spend.jsonl", rows + '{"id": 100, "ts": "2024-')
    _put(f"{root}/ledgers/run.log", "".join(f"2024-01-01 run files={i} seconds={i * 2}.5 mode=full\n" for i in range(10)))
    _TREES[at] = root
    return root


_SLUG = "replace(lower(n_name), ' ', '-')"


@query(f"SELECT {_SLUG} || '.md' AS name FROM nation WHERE NOT starts_with({_SLUG}, 'i') UNION ALL SELECT 'more/r' || n_regionkey::VARCHAR || '/' || {_SLUG} || '.md' FROM nation WHERE n_nationkey % 4 = 1")
def page_scan(spark, sf):
    root = tree(spark, sf)
    return X.all_entries(spark, f"{root}/wiki", {"more": f"{root}/extra"}, ["*.md"], ["i*"]).select("name")


@query(f"SELECT n_nationkey % 9 > 0 valid, CASE WHEN n_nationkey % 9 > 0 THEN 'n' || n_nationkey::VARCHAR END uid, CASE WHEN n_nationkey % 2 = 1 THEN 'place' ELSE 'land' END AS type, n_name title, ['r' || n_regionkey::VARCHAR, 't' || (n_nationkey % 3)::VARCHAR] tags, [{_SLUG} || '-x', n_nationkey::VARCHAR] aliases, '2024-01-' || lpad((n_nationkey + 1)::VARCHAR, 2, '0') valid_until, sha256('Body of ' || n_name || '. See [[r' || n_regionkey::VARCHAR || ']].' || chr(10)) body FROM nation")
def page_entities(spark, sf):
    """Pages as records: metadata by field, the required core, and what lacks it."""
    good, bad = X.entities(X.pages(spark, f"{tree(spark, sf)}/wiki"))
    rows = good.withColumn("valid", F.lit(True)).unionByName(bad.withColumn("valid", F.lit(False)))
    return rows.select("valid", "uid", "type", "title", "tags", "aliases", "valid_until", F.sha2(F.col("body").cast("binary"), 256).alias("body"))


@query("SELECT 's' || n_regionkey::VARCHAR source, '202401' || lpad((n_nationkey + 1)::VARCHAR, 2, '0') || 'T000000Z' stamp, n_nationkey + 1 AS length FROM nation WHERE n_nationkey % 2 = 1")
def intake_scan(spark, sf):
    return X.intake(spark, f"{tree(spark, sf)}/raw").select("source", "stamp", "length")


@query("SELECT count(*) files, sum(n_nationkey + 1)::BIGINT bytes FROM nation WHERE n_nationkey % 2 = 1")
def intake_backlog(spark, sf):
    return X.intake(spark, f"{tree(spark, sf)}/raw").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


@query("SELECT 's' || n_regionkey::VARCHAR || '/batch-' || n_nationkey::VARCHAR || '.jsonl' AS name, 'b' || n_nationkey::VARCHAR batch_id FROM nation WHERE n_nationkey % 5 = 0 AND n_nationkey > 0")
def correction_batches(spark, sf):
    return X.batches(spark, f"{tree(spark, sf)}/raw").select("name", F.get_json_object("first", "$.batch_id").alias("batch_id"))


@query("SELECT 's' || n_regionkey::VARCHAR || '/202401' || lpad((n_nationkey + 1)::VARCHAR, 2, '0') || 'T000000Z-' || lpad(hex(n_nationkey), 8, '0') || '.txt' AS name, 'unmatched-extension' reason FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 's' || n_regionkey::VARCHAR || '/deep/file-' || n_nationkey::VARCHAR || '.md', 'too-deep' FROM nation WHERE n_nationkey % 5 = 0 AND n_nationkey <> 10".replace("hex(n_nationkey)", "lower(ltrim(hex(n_nationkey), '0'))").replace("lower(ltrim(hex(n_nationkey), '0'))", "printf('%x', n_nationkey)"))
def unclaimed_files(spark, sf):
    root = tree(spark, sf)
    exempt = table(spark, sf, "nation").where("n_nationkey = 10").select(F.concat(F.lit("s"), F.col("n_regionkey").cast("string"), F.lit("/deep/file-10.md")).alias("name"))
    return X.unclaimed(X.listing(spark, f"{root}/raw"), X.batches(spark, f"{root}/raw"), exempt)


@query(f"SELECT 'scope-' || n_regionkey::VARCHAR AS scope, CASE n_nationkey % 3 WHEN 0 THEN 'user' ELSE 'feedback' END kind, {_SLUG} slug, 'memory ' || n_nationkey::VARCHAR AS content FROM nation WHERE n_nationkey % 3 < 2")
def memory_files(spark, sf):
    return X.memories(spark, f"{tree(spark, sf)}/memory", ["user", "feedback"]).select("scope", "kind", "slug", "content")


@query(f"SELECT 'scope-' || n_regionkey::VARCHAR AS scope, 'user_' || {_SLUG} || '.md' target FROM nation WHERE n_nationkey % 3 > 0")
def dangling_index_lines(spark, sf):
    """Index lines that name a `user` file for every nation; a third of them exist."""
    n = table(spark, sf, "nation").select(F.concat(F.lit("scope-"), F.col("n_regionkey").cast("string")).alias("scope"), F.concat(F.lit("- [x](user_"), F.regexp_replace(F.lower("n_name"), " ", "-"), F.lit(".md)")).alias("line"))
    index = n.groupBy("scope").agg(F.array_join(F.collect_list("line"), "\n").alias("content"))
    return X.dangling(index, X.listing(spark, f"{tree(spark, sf)}/memory"))


@query(f"SELECT {_SLUG} || '.md' AS name, CASE WHEN n_nationkey % 7 = 0 THEN 'added' WHEN n_nationkey % 7 = 1 THEN 'changed' END change FROM nation WHERE n_nationkey % 7 < 2 UNION ALL SELECT 'gone.md', 'removed'")
def manifest_changes(spark, sf):
    """A listing against a stored manifest that lacks, has other versions of, and has more files."""
    root = tree(spark, sf)
    listed = X.listing(spark, f"{root}/wiki").where(~F.startswith("name", F.lit("_")))
    n = table(spark, sf, "nation").select("n_nationkey", F.concat(F.regexp_replace(F.lower("n_name"), " ", "-"), F.lit(".md")).alias("name"))
    known = listed.join(n, "name").where("n_nationkey % 7 > 0").select("name", F.when(F.col("n_nationkey") % 7 == 1, "old").otherwise(F.col("version")).alias("version"))
    path = K.shared(spark, "manifest")
    O.write_manifest(known.unionByName(spark.range(1).select(F.lit("gone.md").alias("name"), F.lit("1").alias("version"))), path)
    return X.changed(listed, O.read_manifest(spark, path))


@query("SELECT count(*) rows, round(sum(i / 4.0), 4)::DOUBLE cost, 1 torn FROM range(100) t(i) WHERE i % 28 + 1 >= 5 AND i % 28 + 1 < 20")
def ledger_window(spark, sf):
    """A ledger's rows in [since, until), and how many lines are torn."""
    path, schema = f"{tree(spark, sf)}/ledgers/spend.jsonl", "id long, ts string, cost double"
    rows = X.ledger(spark, path, schema, "ts", "2024-01-05", "2024-01-20")
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("cost"), 4).alias("cost")).withColumn("torn", F.lit(X.torn(spark, path, schema)))


@query("SELECT i::VARCHAR files, (i * 2)::VARCHAR || '.5' AS seconds FROM range(10) t(i)")
def run_summaries(spark, sf):
    rows = X.run_summary(spark, f"{tree(spark, sf)}/ledgers/run.log")
    return rows.select(F.col("fields")["files"].alias("files"), F.col("fields")["seconds"].alias("seconds"))


@query("SELECT strftime(ts, '%Y-%m') AS month, count(*) n FROM events WHERE event_id % 3 < 2 GROUP BY 1")
def ledger_by_month(spark, sf):
    """Two appends to a ledger partitioned by month, read back."""
    e = table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy-MM").alias("month"))
    path = K.shared(spark, "verdicts")
    for part in (0, 1):
        X.append(e.where(F.col("event_id") % 3 == part), path, ["month"])
    return spark.read.json(path).groupBy("month").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) n, sum(doc_id)::BIGINT ids FROM documents WHERE doc_id % 2 = 0")
def ingested_files(spark, sf):
    """Files that arrive between two runs of the ingest are each handled once."""
    root = K.shared(spark, "ingest")
    docs, out = table(spark, sf, "documents").select("doc_id"), f"{root}/out"
    for part in (0, 1):
        docs.where(F.col("doc_id") % 4 == 2 * part).coalesce(1).write.mode("append").parquet(f"{root}/in")
        I.ingest(spark, f"{root}/in", "doc_id long", f"{root}/check", lambda batch, number: batch.write.mode("append").parquet(out)).awaitTermination()
    return spark.read.parquet(out).agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


@query("SELECT n_name AS name, '---' || chr(10) || 'name: \"' || n_name || '\"' || chr(10) || 'n: ' || n_nationkey::VARCHAR || CASE WHEN n_nationkey % 2 = 1 THEN chr(10) || 'tags: [\"r' || n_regionkey::VARCHAR || '\"]' ELSE '' END || chr(10) || '---' || chr(10) AS text FROM nation")
def rendered_metadata(spark, sf):
    n = table(spark, sf, "nation")
    tags = F.when(F.col("n_nationkey") % 2 == 1, F.array(F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))))
    return n.select(F.col("n_name").alias("name"), S.rendered({"name": F.col("n_name"), "n": F.col("n_nationkey"), "tags": tags}).alias("text"))


@query("SELECT CASE WHEN n_nationkey % 2 = 1 THEN 'place' ELSE 'land' END AS type, list({'name': n_name, 'uid': 'n' || n_nationkey::VARCHAR} ORDER BY n_name) pages FROM nation WHERE n_nationkey % 9 > 0 GROUP BY 1".replace("list({'name': n_name, 'uid': 'n' || n_nationkey::VARCHAR} ORDER BY n_name)", "string_agg(n_name || '=n' || n_nationkey::VARCHAR, ';' ORDER BY n_name)"))
def type_index(spark, sf):
    """The index page: each type's pages by name."""
    good, _ = X.entities(X.pages(spark, f"{tree(spark, sf)}/wiki"))
    pages = F.array_sort(F.collect_list(F.struct("title", "uid")))
    return good.groupBy("type").agg(F.array_join(F.transform(pages, lambda p: F.concat(p["title"], F.lit("="), p["uid"])), ";").alias("pages"))


_STORED = "SELECT page_id, CASE WHEN page_id % 5 = 2 THEN NULL WHEN page_id % 3 = 0 THEN upper(url) ELSE url END body, CASE WHEN page_id % 3 = 0 OR page_id % 5 = 2 THEN 1 ELSE 0 END AS version FROM pages"


def _stored(spark, sf) -> str:
    """A store of all pages' addresses: written, then a part of them changed or removed."""
    root, rows = K.shared(spark, "store"), table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("key"), F.col("url").alias("body"))
    O.register(spark)
    put = lambda df: df.write.format("codexmill").mode("append").save(root)
    put(rows)
    n = F.col("key").cast("long")
    put(rows.where((n % 3 == 0) | (n % 5 == 2)).select("key", F.when(n % 5 != 2, F.upper("body")).alias("body")))
    return root


@query(f"SELECT page_id::VARCHAR AS key, body, version::BIGINT AS version FROM ({_STORED}) WHERE body IS NOT NULL")
def stored_pages(spark, sf):
    """The last text of each key of a store."""
    root = _stored(spark, sf)
    return O.latest(spark.read.format("codexmill").load(root))


@query(f"SELECT page_id::VARCHAR AS key, url AS body, 0::BIGINT AS version FROM pages WHERE url IS NOT NULL UNION ALL SELECT 'put', 'text', 3::BIGINT UNION ALL SELECT 'count', (SELECT count(*) FROM ({_STORED}) WHERE body IS NOT NULL)::VARCHAR, 2::BIGINT")
def store_versions(spark, sf):
    """A store as it was after its first commit, beside what stands after it was compacted and
    written to by a checked put."""
    root = _stored(spark, sf)
    first = O.latest(spark.read.format("codexmill").option("version", "0").load(root))
    first = first.select("key", "body", "version")
    number = O.compact(spark, root)
    O.put(root, "put", "text")
    now = O.latest(spark.read.format("codexmill").load(root))
    held = now.where("key <> 'put'").agg(F.count(F.lit(1)).cast("string").alias("body")).select(F.lit("count").alias("key"), "body", F.lit(number).cast("long").alias("version"))
    return first.unionByName(now.where("key = 'put'")).unionByName(held)


@query("SELECT n_nationkey, '1' AS first, 's-' || n_nationkey::VARCHAR AS second, n_nationkey % 2 = 1 refused FROM nation")
def checked_puts(spark, sf):
    """A put that expects a version goes through only where that version stands."""
    root, rows = K.shared(spark, "puts"), []
    O.register(spark)
    for k in (r[0] for r in table(spark, sf, "nation").select("n_nationkey").collect()):  # 25 rows
        seen, refused = O.put(root, str(k), "1"), False
        try:
            O.put(root, str(k), f"s-{k}", expect=seen + 1000 if k % 2 else seen)
        except O.Conflict:
            refused = True
            O.put(root, str(k), f"s-{k}", expect=seen)
        rows.append((k, refused))
    done = spark.createDataFrame(rows, "n_nationkey int, refused boolean")
    text = O.latest(spark.read.format("codexmill").load(root)).select(F.col("key").cast("int").alias("n_nationkey"), F.col("body").alias("second"))
    return done.join(text, "n_nationkey").select("n_nationkey", F.lit("1").alias("first"), "second", "refused")
