"""Scalar text functions as Column expressions; all stay inside whole-stage code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Titles and suffixes that a person's normal name leaves out.
HONORIFICS = ("dr", "mr", "mrs", "ms", "prof", "professor", "sir", "hon")
SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "phd", "md", "esq")


def slugify(name: Column, most: int = 60) -> Column:
    """Lower case, runs of other characters as one hyphen, none at the ends, at most `most` long."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, most)


def normal_claim(text: Column) -> Column:
    """Trimmed, white space collapsed, lower case (ß and the like stay as lower() leaves them)."""
    return F.lower(F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x0B]+", " ")))


def neat(text: Column) -> Column:
    """White space collapsed and trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def pair_fingerprint(a: Column, b: Column, kind: Column) -> Column:
    """16 hex digits that don't depend on the order of the two claims."""
    x, y = normal_claim(a), normal_claim(b)
    return F.substring(F.sha1(F.concat_ws("\n", F.least(x, y), F.greatest(x, y), kind).cast("binary")), 1, 16)


def pair_key(a: Column, b: Column) -> Column:
    return F.concat(F.least(a, b), F.lit("+"), F.greatest(a, b))


def normal_name(name: Column) -> Column:
    """Lower case without bracketed parts, punctuation, titles and suffixes."""
    cleared = F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"\([^)]*\)", " "), r"[^a-z0-9\s.\-']", " ")
    words = F.transform(F.split(F.trim(cleared), r"\s+"), lambda t: F.regexp_replace(t, r"^\.+|\.+$", ""))
    return F.array_join(F.filter(words, lambda t: (t != "") & ~t.isin(*HONORIFICS, *SUFFIXES)), " ")


def canonical_profile(url: Column) -> Column:
    """Lower case, no scheme or www, no trailing slashes, then nothing from `?` on."""
    bare = F.regexp_replace(F.lower(F.trim(url)), r"^https?://(www\.)?", "")
    return F.coalesce(F.split(F.regexp_replace(bare, "/+$", ""), r"\?")[0], F.lit(""))


def query_tokens(query: str, least: int = 2, most: int | None = None, stopwords: frozenset[str] = frozenset()) -> list[str]:
    """Query words in order: split at non-word characters, lower case, `least` long."""
    import re

    found = [t for t in re.split(r"\W+", query.lower()) if len(t) >= least and t not in stopwords]
    return found[:most] if most else found


def occurrences(text: Column, token: str) -> Column:
    """Non-overlapping occurrences of a substring."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(token), F.lit("")))) / len(token)).cast("long")


def delimited(values: Column) -> Column:
    """|a|b| with sorted distinct values, the form that membership tests by `contains` need."""
    return F.concat(F.lit("|"), F.array_join(F.array_sort(F.array_distinct(values)), "|"), F.lit("|"))


def iso_date(value: Column) -> Column:
    """A date from an ISO date or timestamp; null where there is none (fail open)."""
    return F.coalesce(F.try_to_date(value, "yyyy-MM-dd"), F.to_date(F.try_to_timestamp(value)))


def wikilinks(body: Column) -> Column:
    """Distinct [[link]] targets in order."""
    return F.array_distinct(F.regexp_extract_all(body, F.lit(r"\[\[([^\]|#]+)"), 1))


def snippet(body: Column, tokens: list[str], most: int = 200) -> Column:
    """A window around the first token found, or the beginning."""
    places = [F.nullif(F.locate(t, F.lower(body)), F.lit(0)) for t in tokens]
    first = F.coalesce(F.least(*places) if len(places) > 1 else places[0] if places else F.lit(1), F.lit(1))
    return F.substring(body, F.greatest(F.lit(1), first - most // 4), F.lit(most))


def sampled(tier: Column, item: Column, rate: float) -> Column:
    """Deterministic sampling: the first 8 bytes of a sha256, unsigned, below `rate`."""
    head = F.substring(F.sha2(F.concat_ws(":", tier, item).cast("binary"), 256), 1, 16)
    return F.conv(head, 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(2**64)) < rate


def key_fingerprint(record: Column) -> Column:
    """16 hex digits of the sorted top-level keys of a JSON object."""
    return F.substring(F.sha2(F.to_json(F.array_sort(F.json_object_keys(record))).cast("binary"), 256), 1, 16)


def prompt_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("int")
