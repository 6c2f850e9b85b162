"""Lookups that refuse ambiguity, nearest assignment, scored facility matches and incremental scopes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.graph import greedy_one_to_one
from gridloom.operators.spatial import haversine_m, near_pairs


def unique_match(left: DataFrame, right: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """``left`` with ``value`` where the key has exactly one distinct value on the right, else null."""
    only = right.where(F.col(value).isNotNull()).groupBy(*on).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    return left.join(only, list(on), "left").withColumn(value, F.when(F.col("_lo") == F.col("_hi"), F.col("_lo"))).drop("_lo", "_hi")


def with_margin(scored: DataFrame, left: str, right: str, score: str, least: float, margin: float) -> DataFrame:
    """(left, right, score): each left's best right, if it reaches ``least`` and leads the next best by ``margin``."""
    w = Window.partitionBy(left).orderBy(F.col(score).desc(), F.col(right))
    ranked = scored.withColumns({"_r": F.row_number().over(w), "_next": F.lead(score).over(w)})
    clear = F.col("_next").isNull() | (F.col(score) - F.col("_next") >= margin)
    return ranked.where((F.col("_r") == 1) & (F.col(score) >= least) & clear).select(left, right, score)


def unambiguous(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Pairs whose ends have no other partner."""
    many = lambda c: pairs.groupBy(c).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(c)
    return pairs.join(many(left), left, "left_anti").join(many(right), right, "left_anti").select(*pairs.columns)


def matched_places(a: DataFrame, b: DataFrame, key_a: str, key_b: str, lat: str, lon: str, name_score: Column, radius_m: float, accept: float) -> DataFrame:
    """(key_a, key_b, score): places of two tables matched one to one by distance and name.

    Candidates come from ``near_pairs`` over both tables' points; distance counts in steps and the name by
    ``name_score`` over columns ``a`` and ``b`` (structs of the two rows). Taken from the best score down.
    """
    at = lambda df, key, right: df.select(F.struct(F.lit(right).alias("right"), F.col(key).alias("id")).alias("k"), lat, lon)
    points = at(a, key_a, False).unionByName(at(b, key_b, True))
    near = near_pairs(points, "k", lat, lon, radius_m, F.col("k.right"))
    ids = near.select(F.col("left_id.id").alias("_a"), F.col("right_id.id").alias("_b"))
    both = ids.join(a.select(F.col(key_a).alias("_a"), F.struct(*a.columns).alias("a")), "_a").join(b.select(F.col(key_b).alias("_b"), F.struct(*b.columns).alias("b")), "_b")
    m = haversine_m(F.col(f"a.{lat}"), F.col(f"a.{lon}"), F.col(f"b.{lat}"), F.col(f"b.{lon}"))
    closeness = F.when(m <= radius_m / 10, 1.0).when(m <= radius_m / 3, 0.7).otherwise(0.4)
    scored = both.select(F.col("_a").alias(key_a), F.col("_b").alias(key_b), (0.55 * closeness + 0.45 * name_score).alias("score"))
    return greedy_one_to_one(scored.where(F.col("score") >= accept), key_a, key_b, "score")


def nearest_site(cases: DataFrame, sites: DataFrame, case: str, site: str, lat: str, lon: str, radius_m: float) -> DataFrame:
    """(case, site, metres): each case's nearest site within the radius, ties to the lesser site; cases without one are left out."""
    points = cases.select(F.struct(F.lit(False).alias("right"), F.col(case).alias("id")).alias("k"), lat, lon).unionByName(sites.select(F.struct(F.lit(True).alias("right"), F.col(site).alias("id")).alias("k"), lat, lon))
    near = near_pairs(points, "k", lat, lon, radius_m, F.col("k.right"))
    ids = near.select(F.col("left_id.id").alias(case), F.col("right_id.id").alias(site))
    at = lambda df, key, n: df.select(key, F.col(lat).alias(f"_la{n}"), F.col(lon).alias(f"_lo{n}"))
    m = haversine_m(F.col("_la1"), F.col("_lo1"), F.col("_la2"), F.col("_lo2"))
    far = ids.join(at(cases, case, 1), case).join(at(sites, site, 2), site).select(case, site, m.alias("metres"))
    best = far.groupBy(case).agg(F.min(F.struct("metres", site)).alias("_b"))
    return best.select(case, F.col(f"_b.{site}").alias(site), F.col("_b.metres").alias("metres"))


def changed_since(records: DataFrame, key: str, updated: str, watermark: Column) -> DataFrame:
    """Keys of the records an incremental run must look at again."""
    return records.where(F.col(updated) > watermark).select(key).distinct()


def complete_days(rows: DataFrame, place: str, day: str, expected: int) -> DataFrame:
    """(day, complete): whether every place served in the table has at least ``expected`` rows that day."""
    served = rows.agg(F.countDistinct(place).alias("_served"))  # one row
    per = rows.groupBy(day, place).agg(F.count(F.lit(1)).alias("n")).groupBy(day).agg(F.count(F.lit(1)).alias("_places"), F.min("n").alias("_least"))
    return per.join(F.broadcast(served)).select(day, ((F.col("_places") == F.col("_served")) & (F.col("_least") >= expected)).alias("complete"))
