"""Problem 4: cases near other cases, and the regions that contain them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.spatial import near_pairs, points_in_regions
from gridloom.registry import Registry
from gridloom.session import table

REG = Registry()

NEAR_M = 300.0


_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
_ORACLE = rf"""
WITH c AS (SELECT case_id, latitude AS la, CASE WHEN longitude >= 180 THEN longitude - 360 ELSE longitude END AS lo FROM faa_cases WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 360 AND NOT (latitude = 0 AND longitude = 0)),
n AS (SELECT 'near' AS kind, a.case_id AS l, b.case_id AS r FROM c a JOIN c b ON b.la BETWEEN a.la - 0.003 AND a.la + 0.003 AND a.case_id < b.case_id
      WHERE 2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(b.la - a.la) / 2), 2) + cos(radians(a.la)) * cos(radians(b.la)) * pow(sin(radians(b.lo - a.lo) / 2), 2)))) <= 300),
g AS (SELECT region_id, unnest(regexp_extract_all(wkt, '\(([^()]+)\)', 1)) AS ring FROM siting_regions WHERE regexp_matches(upper(wkt), 'POLYGON') AND NOT regexp_matches(upper(wkt), 'EMPTY')),
p AS (SELECT region_id, list_transform(string_split(ring, ','), lambda s: list_transform(regexp_extract_all(s, '{_NUMBER}'), lambda v: CAST(v AS DOUBLE))) AS q FROM g),
z AS (SELECT region_id, CASE WHEN q[1] <> q[-1] THEN list_append(q, q[1]) ELSE q END AS q FROM p),
e AS (SELECT region_id, q[i][1] + s AS x1, q[i][2] AS y1, q[i + 1][1] + s AS x2, q[i + 1][2] AS y2 FROM (SELECT region_id, q, unnest(range(1, len(q))) AS i FROM z), (SELECT unnest([-360.0, 0.0, 360.0]) AS s)),
x AS (SELECT case_id, region_id FROM c JOIN e ON la >= least(y1, y2) AND la < greatest(y1, y2) WHERE lo < (x2 - x1) * (la - y1) / (y2 - y1) + x1 GROUP BY 1, 2 HAVING count(*) % 2 = 1)
SELECT kind, l AS left_id, r AS right_id FROM n UNION ALL SELECT 'region', case_id, region_id FROM x
"""


@REG.add("p4_found", _ORACLE)
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kind, left_id, right_id: cases at most 300 m apart, and cases with the regions containing them."""
    cases, regions = table(spark, sf_dir, "faa_cases"), table(spark, sf_dir, "siting_regions")
    near = near_pairs(cases, "case_id", "latitude", "longitude", NEAR_M)
    region = points_in_regions(cases, "case_id", "latitude", "longitude", regions, "region_id", "wkt")
    return near.select(F.lit("near").alias("kind"), "left_id", "right_id").unionByName(region.select(F.lit("region").alias("kind"), "left_id", "right_id"))
