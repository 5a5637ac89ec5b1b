"""Targets and handles: which page a correction or a question means, and why where it means none.

Targets name a page by uid, by type and name, or by one handle (key and value). Every look-up is
an equality join against an aggregated side, so a common name or a shared address costs one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMAIL = "email"
#: Rows that can match nothing are dealt to so many keys, not all to one task.
DEALT = 256


def normal(identifier: Column) -> Column:
    return F.lower(F.trim(identifier))


def handle_index(registry: DataFrame, uid: str, handles: str) -> DataFrame:
    """(key, value, uid) of a registry whose `handles` map a key to its values."""
    keys = registry.select(F.col(uid).alias("uid"), F.explode(handles).alias("key", "values"))
    return keys.select("key", F.explode("values").alias("value"), "uid").where("value is not null").distinct()


def handle_matches(index: DataFrame) -> DataFrame:
    """(key, value, matches, uid): how many entities carry a handle, and the one where it is one."""
    return index.groupBy("key", "value").agg(F.count_distinct("uid").alias("matches"), F.min("uid").alias("uid"))


def any_handle(index: DataFrame) -> DataFrame:
    """(value, matches, uid) over all keys: an entity that carries a value under two keys is one."""
    return index.groupBy("value").agg(F.count_distinct("uid").alias("matches"), F.min("uid").alias("uid"))


def addresses(records: DataFrame, record: str, uid: str, emails: str) -> DataFrame:
    """(address, records, uids, uid): contact records and distinct uids of each address."""
    each = records.select(F.col(record).alias("record"), F.col(uid).alias("uid"), F.explode(emails).alias("email"))
    each = each.select("record", "uid", normal(F.col("email")).alias("address")).where("address <> ''")
    return each.groupBy("address").agg(F.count_distinct("record").alias("records"), F.count_distinct("uid").alias("uids"), F.min("uid").alias("uid"), F.min("record").alias("record"))


def email_outcome(known: Column, uids: Column, page_type: Column, has_page: Column, wanted: Column) -> Column:
    """Why an address does not name a page; null where it does. Several records of one uid are
    one person; an address whose page is missing is told apart from an unknown one."""
    return (
        F.when(known.isNull(), "email-handle-no-match")
        .when(uids == 0, "email-handle-record-without-uid")
        .when(uids > 1, "email-handle-ambiguous")
        .when(~has_page, "email-handle-orphan-uid")
        .when(other_type(page_type, wanted), "email-handle-cross-type")
    )


def other_type(page_type: Column, wanted: Column) -> Column:
    """Whether a page is of another type than a target declares; an undeclared type fits."""
    known = F.trim(F.coalesce(page_type, F.lit("")))
    return (F.trim(F.coalesce(wanted, F.lit(""))) != "") & (known != "") & (known != F.trim(wanted))


def _matched(left: Column, right: str, wanted: Column) -> Column:
    """Whether keys are equal and the left one is wanted; a key that is not is dealt by its id."""
    spare = F.when(wanted, 0).otherwise(1 + F.pmod(F.xxhash64("id"), F.lit(DEALT)).cast("int"))
    # always 0, but not a literal, which would leave the join to the first condition alone
    return (left == F.col(right)) & (spare == F.pmod(F.hash(right), F.lit(1)))


def resolve(targets: DataFrame, pages: DataFrame, index: DataFrame, contacts: DataFrame, allowed: list[str], seq: str = "seq") -> DataFrame:
    """(id, kind, page, reason) of targets (id, uid, type, name, key, value).

    kind: existing where exactly one page is meant; creatable for an allowed handle that nobody
    carries and a declared type; unresolvable for anything else. An address never creates.
    `pages`: uid, type, name and `seq` (of equal names the last holds)."""
    by_uid = pages.select(F.col("uid").alias("_uid"), F.col("type").alias("_type"))
    named = pages.groupBy(normal(F.col("name")).alias("_name")).agg(F.max_by(F.struct(F.col("uid").alias("u"), F.col("type").alias("t")), seq).alias("_n"))
    held = handle_matches(index).join(by_uid, F.col("uid") == F.col("_uid"), "left").select(F.col("key").alias("_key"), F.col("value").alias("_value"), F.col("matches").alias("_m"), F.col("_uid").alias("_h"), F.col("_type").alias("_ht"))
    mails = contacts.join(by_uid, F.col("uid") == F.col("_uid"), "left").select(F.col("address").alias("_address"), "uids", F.col("_uid").alias("_e"), F.col("_type").alias("_et"))
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    present = lambda c: F.col(c).isNotNull()
    may = F.coalesce(F.col("key").isin(*allowed), F.lit(False)) & present("value")  # only such handles count
    mail = F.coalesce(F.col("key") == EMAIL, F.lit(False)) & present("value")
    out = targets.join(by_uid, _matched(F.trim("uid"), "_uid", present("uid")), "left")
    out = out.join(named, _matched(normal(F.col("name")), "_name", present("name")), "left")
    out = out.join(held, (F.col("key") == F.col("_key")) & _matched(F.trim("value"), "_value", may), "left")
    out = out.join(mails, _matched(normal(F.col("value")), "_address", mail), "left")
    mail_reason = email_outcome(F.col("_address"), F.col("uids"), F.col("_et"), F.col("_e").isNotNull(), F.col("type"))
    is_mail = F.coalesce(F.col("key") == EMAIL, F.lit(False))
    page = (
        F.when(F.col("uid").isNotNull(), F.col("_uid"))
        .when(F.col("name").isNotNull(), F.when(~blank("type") & ~blank("name") & ~other_type(F.col("_n.t"), F.col("type")), F.col("_n.u")))
        .when(is_mail & ~blank("value"), F.when(mail_reason.isNull(), F.col("_e")))
        .when(F.col("key").isin(*allowed) & (F.col("_m") == 1) & ~other_type(F.col("_ht"), F.col("type")), F.col("_h"))
    )
    creatable = F.col("uid").isNull() & F.col("name").isNull() & F.coalesce(F.col("key").isin(*allowed), F.lit(False)) & ~is_mail & ~blank("value") & ~blank("type") & F.col("_m").isNull()
    reason = F.when(F.col("uid").isNull() & F.col("name").isNull() & is_mail, F.when(blank("value"), "email-handle-no-match").otherwise(mail_reason))
    return out.select("id", F.when(page.isNotNull(), "existing").when(creatable, "creatable").otherwise("unresolvable").alias("kind"), page.alias("page"), F.when(page.isNull(), reason).alias("reason"))


def chain(identifiers: DataFrame, contacts: DataFrame, pages: DataFrame, closed: DataFrame, as_of: Column) -> DataFrame:
    """(identifier, reached, record, uid, page, marked): how far an address leads, to its contact
    record, the record's uid and that uid's page, and whether the address is marked dead."""
    ends = closed.select(normal(F.col("identifier")).alias("_c"), F.col("valid_until").alias("_until")).groupBy("_c").agg(F.max("_until").alias("_until"))
    at = pages.select(F.col("uid").alias("_page")).distinct()
    out = identifiers.join(contacts, normal(F.col("identifier")) == F.col("address"), "left").join(at, F.col("uid") == F.col("_page"), "left").join(ends, normal(F.col("identifier")) == F.col("_c"), "left")
    reached = F.when(F.col("_page").isNotNull(), "wiki-page").when(F.col("uid").isNotNull(), "uid").when(F.col("address").isNotNull(), "person-record").otherwise("identifier")
    return out.select("identifier", reached.alias("reached"), "record", "uid", F.col("_page").alias("page"), (F.col("address").isNotNull() & F.coalesce(as_of > F.col("_until"), F.lit(False))).alias("marked"))


def aliases_to_page(slugs: DataFrame, pages: DataFrame, slug: str, name: str, aliases: str, slugify) -> DataFrame:
    """(slug, page): the first page by name that bears the slug as an alias, else the slug itself."""
    held = pages.select(F.col(name).alias("_page"), F.explode(aliases).alias("_a")).select("_page", slugify(F.col("_a")).alias("_s")).where("_s <> ''").groupBy("_s").agg(F.min("_page").alias("_page"))
    return slugs.join(held, slugify(F.col(slug)) == F.col("_s"), "left").select(slug, F.coalesce("_page", slug).alias("page"))
