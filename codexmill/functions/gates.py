"""Ordered gates and schedules: the first reason that holds, as CASE expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from codexmill.operators.rules import glob

# Extensions of files of code and configuration, and local parts of role addresses.
CODE_EXTENSIONS = tuple(
    "md markdown rst txt py pyi ipynb ts tsx js jsx mjs cjs json yaml yml toml ini cfg conf env sh bash zsh fish ps1 "
    "go rs rb java kt swift php pl c cc cpp cxx h hpp cs m mm css scss sass less html htm xml svg sql graphql proto lock mk dockerfile gradle".split()
)
ROLES = tuple(
    "info information sales support admin administrator noreply no-reply donotreply contact hello help office team billing accounts hr jobs careers press media marketing "
    "webmaster postmaster abuse security privacy legal enquiries inquiries general mail email newsletter subscribe unsubscribe notifications alerts feedback service services orders shop store".split()
)


def _has(text: Column, marker: str) -> Column:
    return F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(marker.lower()))


def ephemeral(flag: Column, scope: Column, body: Column, scopes: list[str], markers: list[str], least: int = 2) -> Column:
    """flag, scope or markers (at least two of them); null where a page is durable."""
    hits = reduce(lambda a, b: a + b, [_has(body, m).cast("int") for m in markers], F.lit(0))
    in_scope = reduce(lambda a, b: a | b, [scope.rlike(glob(s)) for s in scopes], F.lit(False))
    return F.when(F.coalesce(flag, F.lit(False)), "flag").when(F.coalesce(in_scope, F.lit(False)), "scope").when(hits >= least, "markers")


def code_artifact(name: Column, allowed: tuple[str, ...] = ()) -> Column:
    """One token that ends in a known extension; a slash alone says nothing."""
    key = F.trim(name)
    last = F.lower(F.regexp_extract(key, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(~F.lower(key).isin(*allowed, "") & ~key.rlike(r"\s") & last.isin(*CODE_EXTENSIONS), "extension")


def owner_route(name: Column, owner: str, markers: tuple[str, ...]) -> Column:
    """Memories about the owner: reference where a marker says so, else person; null for others."""
    mine = F.lower(name).startswith(owner.lower())
    marked = reduce(lambda a, b: a | b, [_has(name, m) for m in markers], F.lit(False))
    return F.when(mine & marked, "reference").when(mine, "person")


def cross_class(members: Column, kinds: Column) -> Column:
    """Whether a group of two or more spans several known classes (kinds: distinct, nulls left out)."""
    return (members >= 2) & (kinds > 1)


def safe_class(pages: Column, pii: Column, axiom: Column, kinds: Column, duplicate: Column, most: int = 3) -> Column:
    """The first reason against an automatic merge."""
    return F.when(pages > most, "too-many-pages").when(pii, "pii").when(axiom, "axiom").when(kinds > 1, "cross-class").when(duplicate, "live-source")


def decayed(by: Column, action: Column, at: Column, now: Column, days: int) -> Column:
    """A suppression by a machine older than its time to live; people's never decay, and one
    without a date stays."""
    if days <= 0:
        return F.lit(False)
    return F.coalesce((by == "auto") & (action == "not_a_conflict") & (at < now - F.make_dt_interval(F.lit(days))), F.lit(False))


def trigger(on_demand: Column, files: Column, size: Column, hours: Column, most_files: int | None, most_bytes: int | None, interval: int | None, backstop: int = 24) -> Column:
    """The first trigger that fires; a run that never was is overdue (null hours)."""
    reaches = lambda x, limit: F.lit(False) if limit is None else x >= limit
    late = lambda limit: F.lit(False) if limit is None else hours.isNull() | (hours >= limit)
    return F.when(on_demand, "on-demand").when(reaches(files, most_files), "backlog-files").when(reaches(size, most_bytes), "backlog-bytes").when(late(interval), "interval").when(late(backstop), "nightly-backstop").otherwise("none")


def eta(backlog: Column, per_night: Column) -> Column:
    """Nights to drain; infinite at no rate."""
    return F.when(backlog <= 0, 0.0).when(per_night <= 0, float("inf")).otherwise(F.ceil(backlog / per_night).cast("double"))


def closure(calls: Column, call_budget: int, seconds: Column, window: int) -> Column:
    fits = (calls <= call_budget) & (F.lit(window <= 0) | (seconds <= window))
    return F.when(calls.isNull() | seconds.isNull(), "indeterminate").when(fits, "closes").otherwise("does-not-close")


def budget_step(value: Column) -> Column:
    """The next 1, 2 or 5 times a power of ten."""
    base = F.pow(F.lit(10.0), F.floor(F.log10(value)))
    return F.when(value <= 0, 0.0).when(value <= base, base).when(value <= 2 * base, 2 * base).when(value <= 5 * base, 5 * base).otherwise(10 * base)


def source_kind(value: Column, known: tuple[str, ...]) -> Column:
    kind = F.lower(F.trim(value))
    return F.when(kind.isin(*known), kind).otherwise("unsourced")


def asserters(a_uid: Column, a_name: Column, b_uid: Column, b_name: Column) -> Column:
    """same or different by durable id, same by name without ids, else unknown."""
    return F.when(a_uid.isNotNull() & b_uid.isNotNull(), F.when(a_uid == b_uid, "same").otherwise("different")).when(F.lower(a_name) == F.lower(b_name), "same").otherwise("unknown")


def display_name(email: Column) -> Column:
    """A name from the local part of an address: two or more words of at least three letters,
    joined by . _ or -. Null for roles, tags, digits and anything else that leaves a doubt."""
    local = F.trim(F.substring_index(email, "@", 1))
    words = F.filter(F.split(local, "[._-]"), lambda w: w != "")
    good = F.contains(email, F.lit("@")) & ~F.lower(local).isin(*ROLES) & (F.size(words) >= 2) & F.forall(words, lambda w: w.rlike(r"^\p{L}{3,}$"))
    return F.when(good, F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1_000_000)))), " "))


def hard_bounce(text: Column, emails: Column) -> Column:
    """The address of a note with exactly one address and a 5.x.x status."""
    return F.when((F.size(emails) == 1) & text.rlike(r"\b5\.\d{1,3}\.\d{1,3}\b"), emails[0])


def unmet(conditions: dict[str, Column]) -> Column:
    """All conditions that don't hold, not only the first."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), name) for name, c in conditions.items()]))


def ingestion(enabled: Column, instrumented: Column, records: Column) -> Column:
    """Why ingestion may go on (disabled, healthy) or not (no instrumentation, no records)."""
    return F.when(~enabled, "disabled").when(~instrumented, "no instrumentation").when(records == 0, "no records").otherwise("healthy")
