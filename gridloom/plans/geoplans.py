"""Spatial queries beside problem 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions.geo import grid_cell
from gridloom.operators.spatial import haversine_m, near_pairs, usable_position, wrap_longitude
from gridloom.registry import Registry
from gridloom.session import table

REG = Registry()

_OK = "latitude IS NOT NULL AND longitude IS NOT NULL AND NOT isnan(latitude) AND NOT isnan(longitude) AND NOT (latitude = 0 AND longitude = 0) AND latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 360"
_WRAP = "CASE WHEN longitude >= 180 THEN longitude - 360 ELSE longitude END"


@REG.add("grid_cluster", f"""
SELECT CAST(floor({_WRAP} / 0.5) AS BIGINT) AS x, CAST(floor(latitude / 0.5) AS BIGINT) AS y, count(*) AS cases, round(avg({_WRAP}), 9) AS lon, round(avg(latitude), 9) AS lat FROM faa_cases WHERE {_OK} GROUP BY 1, 2""")
def grid_cluster(spark: SparkSession, d: str) -> DataFrame:
    """Cases and their centre in each half-degree cell."""
    lat, lon = F.col("latitude"), wrap_longitude(F.col("longitude"))
    cases = table(spark, d, "faa_cases").where(usable_position(lat, F.col("longitude"))).select(lon.alias("lon"), lat.alias("lat"))
    return cases.groupBy(grid_cell(F.col("lon"), F.col("lat"), 0.5).alias("c")).agg(F.count(F.lit(1)).alias("cases"), F.round(F.avg("lon"), 9).alias("lon"), F.round(F.avg("lat"), 9).alias("lat")).select("c.x", "c.y", "cases", "lon", "lat")


@REG.add("nearest_neighbours", f"""
WITH p AS (SELECT case_id, latitude AS la, {_WRAP} AS lo, floor(latitude / 0.1) AS y FROM faa_cases WHERE {_OK}),
d AS (SELECT a.case_id AS case_id, b.case_id AS other_id, 2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(b.la - a.la) / 2), 2) + cos(radians(a.la)) * cos(radians(b.la)) * pow(sin(radians(b.lo - a.lo) / 2), 2)))) AS m
      FROM p a JOIN p b ON b.y BETWEEN a.y - 1 AND a.y + 1 AND a.case_id <> b.case_id AND abs(b.la - a.la) < 0.02)
SELECT case_id, other_id, round(m, 3) AS metres, rank FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY round(m, 6), other_id) AS rank FROM d WHERE m <= 1000) WHERE rank <= 3""")
def nearest_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The three nearest other cases of each case within a kilometre."""
    cases = table(spark, d, "faa_cases")
    pairs = near_pairs(cases, "case_id", "latitude", "longitude", 1000.0)
    both = pairs.select(F.inline(F.array(F.struct(F.col("left_id").alias("case_id"), F.col("right_id").alias("other_id")), F.struct(F.col("right_id").alias("case_id"), F.col("left_id").alias("other_id")))))
    at = lambda k, n: cases.select(F.col("case_id").alias(k), F.col("latitude").alias(f"la{n}"), wrap_longitude(F.col("longitude")).alias(f"lo{n}"))
    far = both.join(at("case_id", 1), "case_id").join(at("other_id", 2), "other_id").withColumn("m", haversine_m(F.col("la1"), F.col("lo1"), F.col("la2"), F.col("lo2")))
    ranked = far.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy(F.round("m", 6), "other_id")).cast("long"))
    return ranked.where("rank <= 3").select("case_id", "other_id", F.round("m", 3).alias("metres"), "rank")
