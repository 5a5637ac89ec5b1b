"""Declared dimensions of comparison: which fields two claims are compared by, and what a relation
in one of them means. A registry is data; comparing compiles to columns on the driver."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import compare as C

KINDS, NULLS, STATES = ("interval", "hierarchy", "enum", "identity"), ("unknown", "universal"), ("backfill", "enforced")


@dataclass(frozen=True)
class Dimension:
    """`fields`: the column compared, or the two bounds of an interval. `applies_to`: values of
    other columns for which the dimension holds. A dimension in backfill compares only where both
    sides are filled."""

    name: str
    kind: str
    fields: tuple[str, ...]
    null_means: str = "unknown"
    separates: bool = True
    values: tuple[str, ...] = ()
    applies_to: Mapping[str, tuple] = field(default_factory=dict)
    state: str = "enforced"
    threshold: float = 1.0

    def __post_init__(self):
        if not re.fullmatch(r"[a-z0-9]+(-[a-z0-9]+)*", self.name):
            raise ValueError(f"dimension {self.name!r}: names are lower case with hyphens")
        if self.kind not in KINDS or self.null_means not in NULLS or self.state not in STATES:
            raise ValueError(f"dimension {self.name!r}: unknown kind, null policy or state")
        if self.kind == "enum" and not self.values:
            raise ValueError(f"dimension {self.name!r}: an enum needs its values")
        if len(self.fields) != (2 if self.kind == "interval" else 1):
            raise ValueError(f"dimension {self.name!r}: one field, two for an interval")


# The dimensions that every registry has.
KERNEL = (
    Dimension("recorded-time", "interval", ("recorded_from", "recorded_until"), separates=False),
    Dimension("observed-time", "interval", ("observed_from", "observed_until"), separates=False),
    Dimension("valid-time", "interval", ("valid_from", "valid_until"), null_means="universal"),
    Dimension("scope", "hierarchy", ("scope",), null_means="universal"),
    Dimension("subject", "identity", ("subject",)),
    Dimension("memory-class", "enum", ("memory_class",), values=("entity", "reference", "guideline"), state="backfill"),
)


def registry(declared: tuple[Dimension, ...] = (), kernel: tuple[Dimension, ...] = KERNEL) -> dict[str, Dimension]:
    """The kernel with an operator's own dimensions; a kernel name can't be taken."""
    out = {d.name: d for d in kernel}
    for d in declared:
        if d.name in out:
            raise ValueError(f"dimension {d.name!r} is declared twice")
        out[d.name] = d
    return out


def compare(d: Dimension, a: Mapping[str, Column], b: Mapping[str, Column], ratified: Column | None = None) -> Column:
    """The relation of two claims in one dimension, from their fields."""
    universal, x, y = d.null_means == "universal", [a[f] for f in d.fields], [b[f] for f in d.fields]
    if d.kind == "interval":
        none = lambda w: w[0].isNull() & w[1].isNull()
        one = F.lit("CONTAINS" if universal else "UNKNOWN")
        told = F.when(none(x) & none(y), "UNKNOWN").when(none(x) | none(y), one).otherwise(C.interval(*x, *y))
        empty = none(x) | none(y)
    else:
        known = [F.when(v.isin(*d.values, "*"), v) if d.kind == "enum" else v for v in (x[0], y[0])]
        told = {"hierarchy": lambda: C.hierarchy(*known, universal), "enum": lambda: C.enum(*known, universal), "identity": lambda: C.identity(*known, F.lit(False) if ratified is None else ratified, universal)}[d.kind]()
        empty = known[0].isNull() | known[1].isNull()
    if d.state == "backfill":
        told = F.when(empty, "UNKNOWN").otherwise(told)
    holds = [F.coalesce(side[f].isin(*v), F.lit(False)) for side in (a, b) for f, v in d.applies_to.items()]
    return F.when(reduce(lambda p, q: p & q, holds, F.lit(True)), told).otherwise("UNKNOWN")


def separates(d: Dimension, relation: Column) -> Column:
    """Whether a relation alone keeps two claims apart."""
    return F.lit(d.separates) & (relation == "DISJOINT")


def across(local: Dimension | None, remote: Dimension | None, a: Mapping[str, Column], b: Mapping[str, Column], mapping: Mapping[str, str] | None = None) -> Column:
    """Compare claims of two corpora: UNKNOWN unless both declare the dimension, by one name or
    through the mapping, and by one kind."""
    if local is None or remote is None or local.kind != remote.kind or (local.name != remote.name and (mapping or {}).get(local.name) != remote.name):
        return F.lit("UNKNOWN")
    return compare(local, a, dict(zip(local.fields, (b[f] for f in remote.fields))))


def enforced(d: Dimension, coverage: float) -> Dimension:
    """A backfill dimension is enforced when its coverage reaches the threshold."""
    return replace(d, state="enforced") if d.state == "backfill" and coverage >= d.threshold else d
