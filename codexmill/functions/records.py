"""Scalars of records, prompts, ledgers and page metadata as Column expressions."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Classes by type, system keys that a content hash leaves out, phrases and patterns.
CLASS_OF_TYPE = {"person": "entity", "company": "entity", "concept": "entity", "tool": "entity", "project": "entity", "source": "entity", "user": "entity", "reference": "reference", "principle": "guideline"}
SYSTEM_KEYS = ("coords", "coordinates", "coord_origins", "breadcrumb", "breadcrumbs", "predicate", "predicates", "predicate_instrument", "tier", "tier_flags")
HOISTED = ("source", "observed_at", "op", "field")
SCHEMA_VERSIONS = (1,)
PENDING_PHRASES = ("has it been added", "has this been added", "has it landed", "has this landed", "needs to be added", "needs updating", "still needs", "not yet added", "not yet landed", "not yet updated", "todo:")
SELF_CLAIMS = (r"(?i)\b\w+-(?:confirmed|ratified|verified|approved)\s*\([^)]*\)", r"(?i)\*\*Proposed resolution\*\*\s*:.*", r"(?i)\*\*Decision\*\*\s*:\s*(?:approve|reject)\b.*")
BATCH_DISCOUNT = 0.5


def memory_class(kind: Column) -> Column:
    """The class of a page type, null for unknown ones."""
    pairs = F.create_map(*[F.lit(x) for kv in CLASS_OF_TYPE.items() for x in kv])
    return F.try_element_at(pairs, F.trim(kind))


def source(value: Column) -> tuple[Column, Column]:
    """(type, reference) of `type:reference`; a bare type has no reference, blank has neither."""
    clean = F.nullif(F.trim(value), F.lit(""))
    at = F.instr(clean, ":")
    return F.when(at > 0, F.trim(F.substring(clean, F.lit(1), at - 1))).otherwise(clean), F.when(at > 0, F.nullif(F.trim(F.substring(clean, at + 1, F.length(clean))), F.lit("")))


def envelope(line: Column) -> Column:
    """Whether a line opens a batch: a JSON object that says so, of a known version, with an id
    and a date."""
    field = lambda name: F.get_json_object(line, f"$.{name}")
    whole = field("schema_version").rlike(r"^\d+$")
    return F.coalesce((field("record") == "batch") & whole & field("schema_version").try_cast("int").isin(*SCHEMA_VERSIONS) & (F.coalesce(field("batch_id"), F.lit("")) != "") & (F.coalesce(field("created_at"), F.lit("")) != ""), F.lit(False))


def hoisted(record: Column, defaults: Column) -> Column:
    """A record (a map) with the envelope's defaults for the keys that may be hoisted; what the
    record says itself holds."""
    missing = F.map_filter(defaults, lambda k, v: k.isin(*HOISTED) & ~F.map_contains_key(record, k))
    return F.map_concat(record, missing)


def canonical(values: Column) -> Column:
    """A JSON array of texts without spaces, as ids are hashed from."""
    return F.to_json(values)


def short_hash(text: Column, digits: int = 16) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, digits)


def content_hash(meta: Column, body: Column) -> Column:
    """sha256 of the claims of a page: its metadata (a map) without system keys, in the order of
    keys, and its body."""
    kept = F.map_filter(meta, lambda k, v: ~k.isin(*SYSTEM_KEYS))
    pairs = F.transform(F.array_sort(F.map_entries(kept)), lambda e: F.concat(F.to_json(F.struct(e["key"].alias("k"), e["value"].alias("v")))))
    return F.sha2(F.concat(F.array_join(pairs, ""), F.lit("\n"), body).cast("binary"), 256)


def values_of(raw: Column) -> Column:
    """A list field as trimmed texts without blanks; null is an empty list."""
    return F.filter(F.transform(F.coalesce(raw, F.array().cast("array<string>")), lambda v: F.trim(v)), lambda v: v != "")


def type_filter(wanted: str | Iterable[str] | None) -> tuple[str, ...] | None:
    """Distinct trimmed types in order; none at all is no filter."""
    names = [wanted] if isinstance(wanted, str) else list(wanted or ())
    return tuple(dict.fromkeys(n.strip() for n in names if n and n.strip())) or None


def gated(field: str, exact: Iterable[str], prefixes: Iterable[str]) -> bool:
    """Whether a field may be asked for only with leave."""
    return field in set(exact) or any(field.startswith(p) for p in prefixes)


def like_escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\%_])", r"\\$1")


def push_id(uid: Column, name: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(uid), F.lit("")), name)


def defanged(text: Column, tag: str) -> Column:
    """Opening and closing tags of one name as harmless words."""
    return F.regexp_replace(text, rf"(?i)</?\s*{re.escape(tag)}\s*>", f"({tag})")


def self_claims_flagged(text: Column, warning: str = "[unverified self-claim] ") -> Column:
    """A warning before each passage that asserts its own confirmation."""
    for pattern in SELF_CLAIMS:
        text = F.regexp_replace(text, pattern, warning + "$0")
    return text


def age_days(created: Column, today: Column) -> Column:
    """Whole days since a date text; null where it is none."""
    return F.date_diff(today, F.try_to_date(F.substring(F.trim(created), 1, 10), "yyyy-MM-dd"))


def audience(access: Column, roles: Column) -> tuple[Column, Column]:
    """(roles, whether all may see it) of a page."""
    return F.array_sort(F.array_distinct(values_of(roles))), F.coalesce(F.lower(F.trim(access)) == "open", F.lit(False))


def drain_cost(backlog: Column, tokens_in: Column, tokens_out: Column, rate_in: float, rate_out: float, batch: bool = True) -> Column:
    """Dollars to work a backlog off at a rate per million tokens; batches cost half."""
    cost = F.greatest(backlog, F.lit(0)) * (tokens_in * rate_in + tokens_out * rate_out) / 1e6
    return cost * BATCH_DISCOUNT if batch else cost


def miss_bounds(pushed: Column, pool: Column) -> tuple[Column, Column]:
    """Least and greatest share of missed items that the candidates allow; null upper end without any."""
    return F.lit(0.0), F.try_divide(pool.cast("double"), (pushed + pool).cast("double"))


def pending_state(flag: Column, *texts: Column) -> Column:
    """Why a text only tells of work to do: the flag, or the first phrase that it holds."""
    hay = F.lower(F.concat_ws(" ", *texts))
    out = F.when(F.coalesce(F.lower(F.trim(flag)).isin("true", "1", "yes", "on"), F.lit(False)), "flag")
    for phrase in PENDING_PHRASES:
        out = out.when(F.contains(hay, F.lit(phrase)), f"phrase: {phrase}")
    return out


def rendered(meta: Mapping[str, Column]) -> Column:
    """Metadata as a block of `key: value` lines between rules, null fields left out; values are
    JSON, which YAML reads."""
    text = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    lines = [F.when(c.isNotNull(), F.concat(F.lit(f"{k}: "), text(c))) for k, c in meta.items()]
    return F.concat(F.lit("---\n"), F.array_join(F.array_compact(F.array(*lines)), "\n"), F.lit("\n---\n"))


def field_path(record: Column, name: str) -> Column:
    """A field of a JSON record: an exact key first, then the dotted path."""
    exact = F.get_json_object(record, "$[" + json.dumps(name).replace('"', "'") + "]")
    return F.coalesce(exact, F.get_json_object(record, "$." + name)) if "." in name else exact
