"""Queries of targets, handles and contact facts, over customers as pages and contact records."""

from __future__ import annotations

from pyspark.sql import functions as F

from codexmill.functions import privacy as P
from codexmill.functions import text as T
from codexmill.operators import contacts as N
from codexmill.operators import handles as H
from codexmill.registered import query

from .common import frame, sub

PAGE = {"uid": "'c' || cast(c_custkey AS string)", "type": "CASE WHEN c_custkey % 7 = 0 THEN 'company' ELSE 'person' END", "name": "lower(c_mktsegment) || ' ' || cast(c_custkey % 500 AS string)", "seq": "c_custkey", "linkedin": "CASE WHEN c_custkey % 3 = 0 THEN 'in/' || cast(c_custkey % 300 AS string) END", "apollo": "CASE WHEN c_custkey % 4 = 0 THEN 'in/' || cast(c_custkey AS string) END"}
RECORD = {"record": "'r' || cast(c_custkey AS string)", "uid": "CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN 'gone' || cast(c_custkey AS string) ELSE 'c' || cast(c_custkey - c_custkey % 2 AS string) END", "email": "'P' || cast(c_custkey % 700 AS string) || '@x.io'", "k": "c_custkey", "mark": "CASE WHEN c_custkey % 6 = 0 THEN 'Yes' WHEN c_custkey % 6 = 1 THEN 'no' END"}
RECORDS = "c_custkey % 5 <> 0"
TARGET = {
    "id": "o_orderkey",
    "uid": "CASE WHEN o_orderkey % 6 = 0 THEN 'c' || cast(o_custkey * (1 + o_orderkey % 2) AS string) END",
    "type": "CASE o_orderkey % 4 WHEN 0 THEN 'company' WHEN 1 THEN NULL ELSE 'person' END",
    "name": "CASE WHEN o_orderkey % 6 = 1 THEN ' Building ' || cast(o_custkey % 600 AS string) END",
    "key": "CASE o_orderkey % 6 WHEN 2 THEN 'linkedin' WHEN 3 THEN 'email' WHEN 4 THEN 'fax' END",
    "value": "CASE o_orderkey % 6 WHEN 2 THEN 'in/' || cast(o_custkey % 400 AS string) WHEN 3 THEN 'p' || cast(o_custkey % 900 AS string) || '@X.io' WHEN 4 THEN '12' END",
}
PAGES_SQL, RECORDS_SQL, TARGETS_SQL = sub("customer", PAGE), sub("customer", RECORD, RECORDS), sub("orders", TARGET)
CLOSED = {"identifier": "'p' || cast(c_custkey % 700 AS string) || '@x.io'", "valid_until": "cast('2024-01-01' AS date) + cast(c_custkey % 60 AS int)"}
CLOSED_SQL = sub("customer", CLOSED, "c_custkey % 9 = 0")
DAY = "2024-02-01"


def _pages(spark, sf):
    return frame(spark, sf, "customer", PAGE)


def _index(spark, sf):
    handles = F.map_filter(F.create_map(F.lit("linkedin"), F.array("linkedin"), F.lit("apollo"), F.array("apollo")), lambda k, v: v[0].isNotNull())
    return H.handle_index(_pages(spark, sf).withColumn("handles", handles), "uid", "handles")


def _contacts(spark, sf):
    return H.addresses(frame(spark, sf, "customer", RECORD, RECORDS).withColumn("emails", F.array("email")), "record", "uid", "emails")


def _closed(spark, sf):
    return frame(spark, sf, "customer", CLOSED, "c_custkey % 9 = 0")


_MATCHES = f"SELECT key, value, count(DISTINCT uid) matches, min(uid) uid FROM (SELECT uid, 'linkedin' AS key, linkedin AS value FROM {PAGES_SQL} WHERE linkedin IS NOT NULL UNION ALL SELECT uid, 'apollo', apollo FROM {PAGES_SQL} WHERE apollo IS NOT NULL) GROUP BY key, value"
_CONTACTS = f"SELECT lower(email) address, count(DISTINCT record) records, count(DISTINCT uid) uids, min(uid) uid, min(record) record FROM {RECORDS_SQL} GROUP BY 1"


@query(_MATCHES)
def handle_matches(spark, sf):
    return H.handle_matches(_index(spark, sf))


@query(f"SELECT value, count(DISTINCT uid) matches, min(uid) uid FROM (SELECT uid, linkedin AS value FROM {PAGES_SQL} UNION ALL SELECT uid, apollo FROM {PAGES_SQL}) WHERE value IS NOT NULL GROUP BY value")
def registry_handles(spark, sf):
    return H.any_handle(_index(spark, sf))


@query(_CONTACTS)
def address_records(spark, sf):
    return _contacts(spark, sf)


_RESOLVED = (
    f"WITH p AS {PAGES_SQL}, n AS (SELECT name, arg_max(uid, seq) uid, arg_max(type, seq) AS type FROM p GROUP BY name), h AS ({_MATCHES}), m AS ({_CONTACTS}), t AS {TARGETS_SQL}, "
    "j AS (SELECT t.*, pu.uid pu, n.uid nu, n.type nt, h.matches hm, hp.uid hu, hp.type ht, m.address ma, m.uids mu, mp.uid mpu, mp.type mt FROM t LEFT JOIN p pu ON pu.uid = t.uid LEFT JOIN n ON n.name = lower(trim(t.name)) LEFT JOIN h ON h.key = t.key AND h.value = t.value "
    "LEFT JOIN p hp ON hp.uid = h.uid LEFT JOIN m ON t.key = 'email' AND m.address = lower(t.value) LEFT JOIN p mp ON mp.uid = m.uid), "
    "r AS (SELECT *, CASE WHEN key = 'email' AND uid IS NULL AND name IS NULL THEN CASE WHEN ma IS NULL THEN 'email-handle-no-match' WHEN mu = 0 THEN 'email-handle-record-without-uid' WHEN mu > 1 THEN 'email-handle-ambiguous' WHEN mpu IS NULL THEN 'email-handle-orphan-uid' WHEN type <> mt THEN 'email-handle-cross-type' END END why FROM j), "
    "q AS (SELECT *, CASE WHEN uid IS NOT NULL THEN pu WHEN name IS NOT NULL THEN CASE WHEN type = nt THEN nu END WHEN key = 'email' THEN CASE WHEN why IS NULL THEN mpu END WHEN key IN ('linkedin', 'apollo') AND hm = 1 AND coalesce(type = ht, true) THEN hu END page FROM r) "
)


@query(_RESOLVED + "SELECT id, CASE WHEN page IS NOT NULL THEN 'existing' WHEN uid IS NULL AND name IS NULL AND key IN ('linkedin', 'apollo') AND type IS NOT NULL AND hm IS NULL THEN 'creatable' ELSE 'unresolvable' END kind, page, CASE WHEN page IS NULL THEN why END reason FROM q")
def resolved_targets(spark, sf):
    return H.resolve(frame(spark, sf, "orders", TARGET), _pages(spark, sf), _index(spark, sf), _contacts(spark, sf), ["linkedin", "apollo"])


@query(_RESOLVED + "SELECT coalesce(why, 'resolved') reason, count(*) n FROM q WHERE key = 'email' AND uid IS NULL AND name IS NULL GROUP BY 1")
def email_handles(spark, sf):
    done = H.resolve(frame(spark, sf, "orders", TARGET), _pages(spark, sf), _index(spark, sf), _contacts(spark, sf), ["linkedin", "apollo"])
    mails = frame(spark, sf, "orders", TARGET).where("key = 'email' and uid is null and name is null").select("id")
    return done.join(mails, "id").groupBy(F.coalesce("reason", F.lit("resolved")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"WITH m AS ({_CONTACTS}), c AS (SELECT identifier, max(valid_until) e FROM {CLOSED_SQL} GROUP BY 1), i AS (SELECT DISTINCT 'p' || (o_custkey % 900)::VARCHAR || '@X.io' identifier FROM orders) "
    f"SELECT i.identifier, CASE WHEN p.uid IS NOT NULL THEN 'wiki-page' WHEN m.uid IS NOT NULL THEN 'uid' WHEN m.address IS NOT NULL THEN 'person-record' ELSE 'identifier' END reached, m.record, m.uid, p.uid page, m.address IS NOT NULL AND coalesce(DATE '{DAY}' > e, false) marked FROM i LEFT JOIN m ON m.address = lower(i.identifier) LEFT JOIN {PAGES_SQL} p ON p.uid = m.uid LEFT JOIN c ON c.identifier = lower(i.identifier)"
)
def identifier_chain(spark, sf):
    wanted = frame(spark, sf, "orders", {"identifier": "'p' || cast(o_custkey % 900 AS string) || '@X.io'"}).distinct()
    return H.chain(wanted, _contacts(spark, sf), _pages(spark, sf), _closed(spark, sf), F.lit(DAY).cast("date"))


@query(f"WITH m AS ({_CONTACTS}), c AS (SELECT identifier, max(valid_until) e FROM {CLOSED_SQL} GROUP BY 1), i AS (SELECT DISTINCT 'p' || (o_custkey % 900)::VARCHAR || '@x.io' identifier FROM orders) SELECT i.identifier, coalesce(records, 0) records, coalesce(uids, 0) uids, coalesce(DATE '{DAY}' > e AND address IS NOT NULL, false) bounced FROM i LEFT JOIN m ON address = i.identifier LEFT JOIN c ON c.identifier = i.identifier")
def identifier_facts(spark, sf):
    wanted = frame(spark, sf, "orders", {"identifier": "'p' || cast(o_custkey % 900 AS string) || '@x.io'"}).distinct()
    return N.facts_for(wanted, _contacts(spark, sf), _closed(spark, sf), F.lit(DAY).cast("date"))


@query(f"SELECT p.uid, lower(r.email) address, coalesce(DATE '{DAY}' > e, false) hard_bounced, r.mark verdict FROM {PAGES_SQL} p JOIN {RECORDS_SQL} r ON r.uid = p.uid LEFT JOIN (SELECT identifier, max(valid_until) e FROM {CLOSED_SQL} GROUP BY 1) c ON c.identifier = lower(r.email)")
def page_deliverability(spark, sf):
    """Each address of a page's record: its own mark beside the verdict, never merged into one."""
    records = frame(spark, sf, "customer", RECORD, RECORDS)
    ends = _closed(spark, sf).groupBy(F.col("identifier").alias("address")).agg(F.max("valid_until").alias("e"))
    rows = _pages(spark, sf).select("uid").join(records, "uid").withColumn("address", H.normal(F.col("email"))).join(ends, "address", "left")
    return rows.select("uid", "address", N.bounced(F.col("e"), F.lit(DAY).cast("date")).alias("hard_bounced"), F.col("mark").alias("verdict"))


_CLASSES = "SELECT 'r' || c_custkey::VARCHAR record, 'p' || (c_custkey % 700)::VARCHAR || '@x.io' identifier, CASE c_custkey % 4 WHEN 0 THEN 'observed' WHEN 1 THEN 'provider' WHEN 2 THEN ' ' END usage_class FROM customer WHERE c_custkey % 3 <> 0"


@query(f"SELECT record, r.email identifier, coalesce(nullif(trim(usage_class), ''), 'unclassified') usage_class, coalesce(usage_class = 'observed', false) outreach FROM {RECORDS_SQL} r LEFT JOIN ({_CLASSES}) c USING (record)")
def contact_classes(spark, sf):
    values = frame(spark, sf, "customer", RECORD, RECORDS).select("record", F.col("email").alias("identifier"))
    entry = {"record": "'r' || cast(c_custkey AS string)", "identifier": "'p' || cast(c_custkey % 700 AS string) || '@x.io'", "usage_class": "CASE c_custkey % 4 WHEN 0 THEN 'observed' WHEN 1 THEN 'provider' WHEN 2 THEN ' ' END", "seq": "c_custkey"}
    return N.classified(values, frame(spark, sf, "customer", entry, "c_custkey % 3 <> 0"), "record")


@query(f"SELECT p.uid, CASE WHEN p.seq % 10 = 0 THEN 'wiki' WHEN bool_or(r.mark = 'Yes') THEN 'excluded' END surface FROM {PAGES_SQL} p LEFT JOIN {RECORDS_SQL} r ON r.uid = p.uid GROUP BY p.uid, p.seq")
def do_not_email(spark, sf):
    marks = frame(spark, sf, "customer", RECORD, RECORDS).groupBy("uid").agg(F.max(F.when(N.flagged(F.col("mark")), "yes")).alias("mark"))
    rows = _pages(spark, sf).join(marks, "uid", "left")
    return rows.select("uid", N.do_not_email(F.when(F.col("seq") % 10 == 0, "TRUE"), F.col("mark")).alias("surface"))


@query(f"SELECT uid, field, [v] AS values, 0 AS held FROM (SELECT uid, unnest(['emails', 'phones']) field, unnest([email, CASE WHEN k % 2 = 0 THEN '555' || k::VARCHAR END]) v FROM {RECORDS_SQL} WHERE uid IS NOT NULL AND record = 'r' || substr(uid, 2)) WHERE v IS NOT NULL")
def excluded_values(spark, sf):
    return N.excluded_read(_own_records(spark, sf), "uid", ["emails", "phones"], include=True)


def _own_records(spark, sf):
    records = frame(spark, sf, "customer", RECORD, RECORDS).where("uid is not null and record = 'r' || substr(uid, 2)")
    return records.select("uid", F.array("email", F.lit(" ")).alias("emails"), F.when(F.col("k") % 2 == 0, F.array(F.concat(F.lit("555"), F.col("k").cast("string")))).alias("phones"))


@query(f"SELECT uid, field, NULL::VARCHAR[] AS values, count(v)::INT held FROM (SELECT uid, unnest(['emails', 'phones']) field, unnest([email, CASE WHEN k % 2 = 0 THEN '555' END]) v FROM {RECORDS_SQL} WHERE uid IS NOT NULL AND record = 'r' || substr(uid, 2)) WHERE v IS NOT NULL GROUP BY uid, field")
def excluded_redactions(spark, sf):
    return N.excluded_read(_own_records(spark, sf), "uid", ["emails", "phones"], include=False)


@query(f"WITH w AS (SELECT DISTINCT 'c' || (o_custkey + o_orderkey % 2 * 100000)::VARCHAR uid FROM orders) SELECT w.uid, p.type, count(r.record) records FROM w LEFT JOIN {PAGES_SQL} p ON p.uid = w.uid LEFT JOIN {RECORDS_SQL} r ON r.uid = w.uid GROUP BY ALL")
def entities_read(spark, sf):
    wanted = frame(spark, sf, "orders", {"uid": "'c' || cast(o_custkey + o_orderkey % 2 * 100000 AS string)"})
    records = frame(spark, sf, "customer", RECORD, RECORDS).where("uid is not null").groupBy("uid").agg(F.count(F.lit(1)).alias("records"))
    return N.read_batch(wanted, _pages(spark, sf).select("uid", "type"), records, "uid").select("uid", "type", F.coalesce("records", F.lit(0)).alias("records"))


_MARKS = "SELECT 'P' || (o_custkey % 900)::VARCHAR || '@x.io' identifier, o_orderdate::DATE d FROM orders"
_LISTED = f"SELECT lower(email) e, min(record) r FROM {RECORDS_SQL} GROUP BY 1"


@query(f"SELECT coalesce(r, 'bounce-' || identifier) record, identifier, d valid_until, r IS NULL is_new FROM (SELECT lower(identifier) identifier, min(d) d FROM ({_MARKS}) GROUP BY 1) LEFT JOIN ({_LISTED}) ON e = identifier")
def bounce_marks(spark, sf):
    marks = frame(spark, sf, "orders", {"identifier": "'P' || cast(o_custkey % 900 AS string) || '@x.io'", "observed_at": "cast(o_orderdate AS date)"})
    return N.mark(marks, frame(spark, sf, "customer", RECORD, RECORDS).withColumn("emails", F.array("email")), "record", "emails")


@query(f"SELECT 'p' || s_suppkey::VARCHAR || '@x.io' identifier, 'b' || s_suppkey::VARCHAR bounce_record, r person_record FROM supplier JOIN ({_LISTED}) ON e = 'p' || s_suppkey::VARCHAR || '@x.io' WHERE s_suppkey % 4 <> 0 AND s_suppkey % 5 <> 0")
def orphaned_marks(spark, sf):
    own = frame(spark, sf, "supplier", {"identifier": "'p' || cast(s_suppkey AS string) || '@x.io'", "bounce_record": "'b' || cast(s_suppkey AS string)", "valid_until": "CASE WHEN s_suppkey % 4 <> 0 THEN cast('2024-01-01' AS date) END", "folded_into": "CASE WHEN s_suppkey % 5 = 0 THEN 'x' END"})
    return N.orphaned(own, frame(spark, sf, "customer", RECORD, RECORDS).withColumn("emails", F.array("email")), "record", "emails")


@query(f"SELECT s slug, coalesce(page, s) page FROM (SELECT 'name ' || s_suppkey::VARCHAR s FROM supplier) LEFT JOIN (SELECT 'name-' || (c_custkey % 150)::VARCHAR a, min('c' || c_custkey::VARCHAR) page FROM customer GROUP BY 1) ON a = replace(s, ' ', '-')")
def alias_pages(spark, sf):
    slugs = frame(spark, sf, "supplier", {"slug": "'name ' || cast(s_suppkey AS string)"})
    pages = frame(spark, sf, "customer", {"page_name": "'c' || cast(c_custkey AS string)", "alias": "'Name ' || cast(c_custkey % 150 AS string)"}).withColumn("aliases", F.array("alias"))
    return H.aliases_to_page(slugs, pages, "slug", "page_name", "aliases", T.slugify)


@query("SELECT doc_id, list_sort(list_filter(list_distinct(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')), lambda e: lower(e) NOT IN ('git@github.com', 'git@gitlab.com', 'git@bitbucket.org') AND split_part(lower(e), '@', 2) <> 'group.calendar.google.com')) emails FROM documents WHERE regexp_matches(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')")
def personal_addresses(spark, sf):
    rows = frame(spark, sf, "documents", {"doc_id": "doc_id", "text": "text"}).withColumn("e", P.emails(F.col("text"))).where(F.size("e") > 0)
    return rows.select("doc_id", F.array_sort(F.filter("e", lambda e: ~P.service_address(e))).alias("emails"))
