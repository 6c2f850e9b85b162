"""Rules as data: conditions, weights and credits read from a document and turned into column expressions."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Comparisons that a rule document may name.
TESTS = {
    "equals": lambda c, v: c == F.lit(v), "in": lambda c, v: c.isin(*v), "at_least": lambda c, v: c >= F.lit(v), "at_most": lambda c, v: c <= F.lit(v), "matches": lambda c, v: F.lower(c).rlike(v),
    "overlaps": lambda c, v: F.arrays_overlap(c, F.array(*[F.lit(x) for x in v])), "missing": lambda c, v: c.isNull() == F.lit(v),
}


def parse_rules(text: str) -> dict:
    """A rule document: {"version": …, "threshold": …, "rules": [{"name", "weight", "all": [[column, test, value], …], "credit"}]}.

    Unknown tests, repeated names and weights that are not positive are errors, so a slip in a file shows at once.
    """
    doc = json.loads(text)
    names = [r["name"] for r in doc["rules"]]
    if len(names) != len(set(names)):
        raise ValueError("a rule name is repeated")
    for r in doc["rules"]:
        if not r.get("weight", 1) > 0:
            raise ValueError(f"rule {r['name']} has no positive weight")
        for _, test, _ in r["all"]:
            if test not in TESTS:
                raise ValueError(f"rule {r['name']} names an unknown test {test}")
    return doc


def holds(conditions: Sequence[Sequence]) -> Column:
    """All of the conditions; an unknown outcome does not hold."""
    return reduce(lambda a, b: a & b, [F.coalesce(TESTS[t](F.col(c), v), F.lit(False)) for c, t, v in conditions], F.lit(True))


def scored(doc: Mapping) -> tuple[Column, Column]:
    """(score, failed): the weighted mean of the credits of the rules that hold, and the names of those that do not."""
    total = sum(r.get("weight", 1) for r in doc["rules"])
    parts = [F.when(holds(r["all"]), F.lit(float(r.get("weight", 1) * r.get("credit", 1.0)))).otherwise(0.0) for r in doc["rules"]]
    failed = F.array_compact(F.array(*[F.when(~holds(r["all"]), r["name"]) for r in doc["rules"]]))
    return F.round(sum(parts, F.lit(0.0)) / total, 3), F.array_join(failed, "|")


def families(vocabulary: Mapping[str, Sequence[str]], text: Column) -> Column:
    """Sorted families of a vocabulary (family -> words) of which the text has a word."""
    words = F.split(F.lower(text), r"[^a-z0-9]+")
    return F.array_sort(F.array_compact(F.array(*[F.when(F.arrays_overlap(words, F.array(*[F.lit(w) for w in ws])), f) for f, ws in vocabulary.items()])))


def size_window(amount: Column, sought: Column, least: float, most: float) -> Column:
    """Whether an amount is within a ratio band of what is sought; nothing sought accepts all."""
    return F.coalesce(sought.isNull() | amount.between(sought * least, sought * most), F.lit(False))


def timing_credit(due: Column, now: Column, enough: int, soon: float = 0.5) -> Column:
    """1 with ``enough`` days or no deadline, ``soon`` before that, 0 past the deadline."""
    days = F.date_diff(due, now)
    return F.when(due.isNull() | (days >= enough), 1.0).when(days >= 0, soon).otherwise(0.0)


def place_credit(place: Column, wanted: Column, near: Mapping[str, Sequence[str]]) -> Column:
    """1 for the same region or a whole country, 0.5 for a neighbour of the wanted region, 0 elsewhere."""
    country = lambda c: F.element_at(F.split(c, "-"), 1)
    neighbours = F.create_map(*[x for k, v in near.items() for x in (F.lit(k), F.array(*[F.lit(n) for n in v]))])
    whole = ~F.contains(wanted, F.lit("-")) & (country(place) == wanted)
    return F.when((place == wanted) | whole, 1.0).when(F.coalesce(F.array_contains(F.try_element_at(neighbours, wanted), place), F.lit(False)), 0.5).otherwise(0.0)


def too_far_apart(a: Column, b: Column, factor: float) -> Column:
    """Whether two positive amounts differ by more than ``factor``; a missing one never does."""
    return F.coalesce((a > 0) & (b > 0) & (F.greatest(a, b) > factor * F.least(a, b)), F.lit(False))


def register_functions(spark: SparkSession) -> list[str]:
    """Functions for SQL texts: ``squash`` (search form of a name) and ``great_circle_m``, as SQL expressions, so they are
    inlined and stay in generated code."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION squash(t STRING) RETURNS STRING RETURN translate(lower(t), ' .,-''&/()', '')")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION great_circle_m(la1 DOUBLE, lo1 DOUBLE, la2 DOUBLE, lo2 DOUBLE) RETURNS DOUBLE RETURN 2 * 6371008.8 * asin(sqrt(least(1.0D,"
        " power(sin(radians(la2 - la1) / 2), 2) + cos(radians(la1)) * cos(radians(la2)) * power(sin(radians(lo2 - lo1) / 2), 2))))"
    )
    return ["squash", "great_circle_m"]


def point_text(lon: Column, lat: Column) -> Column:
    """A position as stored text, null without one."""
    return F.when(lon.isNotNull() & lat.isNotNull(), F.concat(F.lit("POINT("), lon.cast("string"), F.lit(" "), lat.cast("string"), F.lit(")")))


def point_of(text: Column) -> Column:
    """The position of a stored text, null where it is none."""
    part = lambda i: F.regexp_extract(text, r"^POINT\((\S+) (\S+)\)$", i).try_cast("double")
    return F.when(part(1).isNotNull() & part(2).isNotNull(), F.struct(part(1).alias("lon"), part(2).alias("lat")))


def clean_json(text: Column) -> Column:
    """JSON with NaN and infinite numbers as null; a text that is no JSON is null."""
    safe = F.regexp_replace(text, r'(?<=[:\[,])\s*(?:NaN|-?Infinity)\s*(?=[,\]}])', "null")
    return F.when(F.try_parse_json(safe).isNotNull(), safe)


def is_due(cadence: Column, last: Column, now: Column) -> Column:
    """Whether a saved search is to be run: immediate ones always, daily and weekly ones once their period is over."""
    never = last.isNull()
    return F.when(cadence == "immediate", True).when(cadence == "daily", never | (now >= last + F.expr("INTERVAL 1 DAY"))).when(cadence == "weekly", never | (now >= last + F.expr("INTERVAL 7 DAY"))).otherwise(False)


def next_attempt(failed_at: Column, attempts: Column, first_s: int = 60, most: int = 8) -> Column:
    """When a failed delivery is tried again: waits double from ``first_s``; null once ``most`` were made."""
    return F.when(attempts < most, F.timestamp_micros(F.unix_micros(failed_at.cast("timestamp")) + (F.pow(F.lit(2.0), attempts - 1) * first_s * 1_000_000).cast("long")))


def retirement(before: Column, after: Column, now: Column) -> Column:
    """What the move of a retirement date means: set, cancelled, delayed, brought forward, or retired once it is past."""
    gone = F.coalesce(after < now, F.lit(False)) & F.coalesce(before >= now, before.isNull())
    return (
        F.when(gone, "retired").when(before.isNull() & after.isNotNull(), "set").when(before.isNotNull() & after.isNull(), "cancelled").when(after > before, "delayed").when(after < before, "brought_forward")
    )
