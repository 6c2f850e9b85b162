"""Filters, semi-joins, facets, search and keyset pages of list queries."""

from __future__ import annotations

import base64
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def list_filters(equals: Mapping[str, Sequence] | None = None, at_least: Mapping[str, object] | None = None, at_most: Mapping[str, object] | None = None) -> Column:
    """One conjunction of IN lists and inclusive bounds; the same expression serves pages, counts and exports.

    An empty IN list matches nothing. Nulls match no bound.
    """
    out = F.lit(True)
    for name, values in (equals or {}).items():
        out = out & (F.col(name).isin(list(values)) if values else F.lit(False))
    for name, bound in (at_least or {}).items():
        out = out & (F.col(name) >= F.lit(bound))
    for name, bound in (at_most or {}).items():
        out = out & (F.col(name) <= F.lit(bound))
    return out


def negated(condition: Column) -> Column:
    """The complement of a condition, with unknown counted as false before it is negated."""
    return ~F.coalesce(condition, F.lit(False))


def any_of(values: Column, wanted: Sequence[str], wildcard: str | None = None) -> Column:
    """Whether an array shares an element with ``wanted``; an empty or null array matches nothing, a wildcard element all."""
    names = [*wanted, wildcard] if wildcard is not None else list(wanted)
    return F.coalesce(F.arrays_overlap(values, F.array(*[F.lit(w) for w in names])), F.lit(False))


def squash(text: Column, ignored: str = " .,-'&/()") -> Column:
    """Lower case without the ignored characters, for substring search."""
    return F.translate(F.lower(text), ignored, "")


def search_rank(text: Column, query: str, ignored: str = " .,-'&/()") -> Column:
    """0 for an equal squashed text, 1 for a prefix, 2 for a substring, null for none."""
    wanted = query.lower().translate({ord(c): None for c in ignored})
    s = squash(text, ignored)
    return F.when(s == wanted, 0).when(s.startswith(wanted), 1).when(s.contains(wanted), 2)


def country_of(code: Column) -> Column:
    """Country before the first hyphen of a jurisdiction code, upper case."""
    return F.upper(F.element_at(F.split(code, "-"), 1))


def encode_cursor(value: object, key: object) -> str:
    return base64.urlsafe_b64encode(json.dumps([value, key]).encode()).decode()


def decode_cursor(cursor: str) -> tuple[object, object]:
    value, key = json.loads(base64.urlsafe_b64decode(cursor))
    return value, key


def keyset_page(df: DataFrame, sort: str, key: str, limit: int, ascending: bool = True, cursor: str | None = None) -> DataFrame:
    """The page after ``cursor`` in (sort, key) order plus one row that tells whether more follow.

    Nulls sort last either way; the key follows the sort's direction. The plan is a bounded top-k per partition.
    """
    if cursor is not None:
        value, last = decode_cursor(cursor)
        after = (lambda c, v: c > v) if ascending else (lambda c, v: c < v)
        beyond = after(F.col(key), F.lit(last))
        if value is None:
            df = df.where(F.col(sort).isNull() & beyond)
        else:
            df = df.where(after(F.col(sort), F.lit(value)) | ((F.col(sort) == F.lit(value)) & beyond) | F.col(sort).isNull())
    order = [F.col(sort).asc_nulls_last(), F.col(key).asc()] if ascending else [F.col(sort).desc_nulls_last(), F.col(key).desc()]
    return df.orderBy(*order).limit(limit + 1)


def facets(df: DataFrame, *dimensions: str) -> DataFrame:
    """(dimension, value, rows): value counts of several dimensions from one pass; null is a value of its own."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions])
    return df.select(F.inline(pairs)).groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("rows"))


def permitted(df: DataFrame, links: DataFrame, on: str, link_filter: Column) -> DataFrame:
    """Rows with at least one link that passes: EXISTS as a left-semi join, so no row is multiplied."""
    return df.join(links.where(link_filter).select(on), on, "left_semi")


def slip_bucket(target: Column, on: Column, active: Column, grace: int = 0) -> Column:
    """``year``, ``three_years`` or ``more`` for active rows late by more than ``grace`` days, else null."""
    days = F.date_diff(on, target)
    late = F.when(active & (days > grace), days)
    return F.when(late <= 365, "year").when(late <= 1095, "three_years").when(late > 1095, "more")


def genuine_runs(events: DataFrame, source: str, at: str, ok: Column) -> DataFrame:
    """Events after their source's first good run: a minimum per source and one equi-join instead of a correlated EXISTS."""
    first = events.where(ok).groupBy(source).agg(F.min(at).alias("_first"))
    return events.join(first, source).where(F.col(at) > F.col("_first")).drop("_first")
