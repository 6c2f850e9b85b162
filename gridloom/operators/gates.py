"""Which rows and fields a reader may see, and bounds of list queries: semi-joins and expressions, no id lists."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def number_bound(name: str, text: str | None) -> float | None:
    """A finite number of a query string, None if it is not given; anything else is an error that names the parameter."""
    if text is None or not text.strip():
        return None
    try:
        value = float(text)
    except ValueError:
        value = math.nan
    if not math.isfinite(value):
        raise ValueError(f"{name} must be a finite number")
    return value


def instant_bound(name: str, text: str | None) -> datetime | None:
    """An instant with zone as UTC; a text without zone is an error."""
    if text is None or not text.strip():
        return None
    try:
        at = datetime.fromisoformat(text.strip())
    except ValueError:
        at = None
    if at is None or at.tzinfo is None:
        raise ValueError(f"{name} must be an instant with an offset")
    return at.astimezone(UTC)


def value_bounds(least: str | None, most: str | None) -> tuple[float | None, float | None]:
    """Both bounds of a range; an error if they are crossed."""
    lo, hi = number_bound("min", least), number_bound("max", most)
    if lo is not None and hi is not None and lo > hi:
        raise ValueError("min is above max")
    return lo, hi


def between_bounds(value: Column, lo: object | None, hi: object | None) -> Column:
    """Inclusive bounds, each optional; a missing value is outside as soon as one is given."""
    out = F.lit(True)
    if lo is not None:
        out = out & (value >= F.lit(lo))
    if hi is not None:
        out = out & (value <= F.lit(hi))
    return F.coalesce(out, F.lit(False))


def sort_spec(token: str | None, allowed: Sequence[str], default: str) -> tuple[str, bool]:
    """(field, ascending) of a sort token, a leading hyphen meaning descending; fields not allowed are an error."""
    name = token or default
    field = name.removeprefix("-")
    if field not in allowed:
        raise ValueError(f"cannot sort by {field}")
    return field, not name.startswith("-")


def in_set(column: Column, values: Sequence[str], separator: str = "|") -> Column:
    """Whether a stored set, its members joined by ``separator``, holds one of ``values`` as a whole member."""
    members = F.transform(F.split(column, f"[{separator}]"), F.trim)
    return F.coalesce(F.arrays_overlap(members, F.array(*[F.lit(v) for v in values])), F.lit(False)) if values else F.lit(False)


def json_number(column: Column, path: str) -> Column:
    """The number at a path of a JSON text; null where it is absent or no number."""
    return F.get_json_object(column, path).try_cast("double")


def to_state(change: Column, path: str, by_type: Mapping[str, str], kind: Column) -> Column:
    """The state an event leads to: as its JSON states it, else as its type implies."""
    implied = reduce(lambda c, kv: c.when(kind == kv[0], kv[1]), by_type.items(), F)
    return F.coalesce(F.nullif(F.get_json_object(change, path), F.lit("")), implied if isinstance(implied, Column) else F.lit(None))


def at_least_or_unknown(value: Column, floor: float | None, unknown: bool) -> Column:
    """``value`` at or above ``floor``; rows without a value pass if ``unknown`` allows them."""
    if floor is None:
        return F.lit(True)
    return F.coalesce(value >= floor, F.lit(unknown))


def all_of(*conditions: tuple[Column, bool]) -> Column:
    """A conjunction in which each condition says whether an unknown outcome passes."""
    return reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(passes)) for c, passes in conditions], F.lit(True))


def graded(precision: Column, licence_ok: Column, grades: Sequence[str]) -> Column:
    """The grade of a position: its precision if the licence lets it be served, else the coarsest grade; null for others."""
    known = F.when(precision.isin(*grades), precision)
    return F.when(known.isNull() | licence_ok, known).otherwise(grades[-1])


def permitted_links(links: DataFrame, sources: DataFrame, source: str, active: Column, allowed: Column) -> DataFrame:
    """Links that are active and whose source is among those ``allowed``."""
    return links.where(active).join(sources.where(allowed).select(source).distinct(), source, "left_semi")


def visible_records(records: DataFrame, links: DataFrame, key: str, served: Column) -> DataFrame:
    """Records that may be ``served`` (state, timing, licence) and have one of the permitted ``links``."""
    return records.where(F.coalesce(served, F.lit(False))).join(links.select(key).distinct(), key, "left_semi")


def visible_events(events: DataFrame, kind: str, subject: str, visible: Mapping[str, DataFrame], source: str, sources: DataFrame) -> DataFrame:
    """Events whose subject is visible, whatever its kind, and whose source is permitted or not stated.

    ``visible`` maps a kind to its visible ids (one column). The OR of one EXISTS a kind becomes a single semi-join.
    """
    ids = reduce(DataFrame.unionByName, [df.select(F.lit(k).alias(kind), F.col(df.columns[0]).cast("string").alias("_subject")) for k, df in visible.items()]).distinct()
    keyed = events.withColumn("_subject", F.col(subject).cast("string")).join(ids, [kind, "_subject"], "left_semi").drop("_subject")
    permitted = sources.select(F.col(source).alias("_source")).distinct().withColumn("_ok", F.lit(True))
    joined = keyed.join(permitted, F.col(source) == F.col("_source"), "left")
    return joined.where(F.col(source).isNull() | F.col("_ok")).drop("_source", "_ok")


def evidenced(organisations: DataFrame, key: str, public: Column, *evidence: DataFrame) -> DataFrame:
    """Public organisations that at least one of the evidence tables names."""
    named = reduce(DataFrame.unionByName, [e.select(key) for e in evidence]).where(F.col(key).isNotNull()).distinct()
    return organisations.where(F.coalesce(public, F.lit(False))).join(named, key, "left_semi")


def hidden_provenance(provenance: Column, hidden: Sequence[str]) -> Column:
    """Whether any field of a map field -> source stems from a hidden source."""
    return F.coalesce(F.exists(F.map_values(provenance), lambda s: s.isin(*hidden)), F.lit(False)) if hidden else F.lit(False)


def served_view(records: DataFrame, links: DataFrame, key: str, fields: Sequence[str], readable: Column, rank: Column) -> DataFrame:
    """``key`` and ``fields`` as a reader may see them, with ``<field>_from``: ``own``, ``link`` or null.

    ``records`` has for each field ``<field>_sources`` (array). A value stands where all its sources are ``readable``
    (a Boolean over a source name ``s``). Where not, it is recomputed over the readable ``links`` (key, source, the
    fields): the value of the link that ``rank`` puts highest and that states one. One aggregation of the links, all
    fields at once, combined before the shuffle; records without hidden sources keep their values.
    """
    ok = links.where(readable)
    best = ok.groupBy(F.col(key).alias("_k")).agg(*[F.max_by(F.col(f), F.when(F.col(f).isNotNull(), rank)).alias(f"_l_{f}") for f in fields])
    joined = records.join(best, F.col(key) == F.col("_k"), "left")
    out = [F.col(key)]
    for f in fields:
        open_ = F.col(f"{f}_readable")
        out.append(F.when(open_, F.col(f)).otherwise(F.col(f"_l_{f}")).alias(f))
        out.append(F.when(open_ & F.col(f).isNotNull(), "own").when(~open_ & F.col(f"_l_{f}").isNotNull(), "link").alias(f"{f}_from"))
    return joined.select(*out)


def superseded(rows: DataFrame, key: str, places: str, covered: DataFrame, place: str) -> DataFrame:
    """``rows`` with ``superseded``: whether every one of its ``places`` (array) is covered by a preferred source.

    Places are counted after an equi-join, so the covered set is never collected. A row without places is not
    superseded.
    """
    each = rows.select(key, F.explode(F.array_distinct(places)).alias(place)).join(covered.select(place).distinct().withColumn("_c", F.lit(1)), place, "left")
    whole = each.groupBy(F.col(key).alias("_k")).agg((F.count("_c") == F.count(F.lit(1))).alias("_all"))
    return rows.join(whole, F.col(key) == F.col("_k"), "left").withColumn("superseded", F.coalesce("_all", F.lit(False))).drop("_k", "_all")


def leaks(shown: DataFrame, permitted: DataFrame, key: str) -> DataFrame:
    """Rows shown that an independent count does not permit; empty if the gates hold."""
    return shown.join(permitted.select(key), key, "left_anti")
