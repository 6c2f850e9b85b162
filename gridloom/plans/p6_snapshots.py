"""Problem 6: projects added, removed or changed between register snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.snapshots import snapshot_changes
from gridloom.registry import Registry
from gridloom.session import table

REG = Registry()

BLANKS = r"[\s  -​ 　﻿]+"


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{BLANKS}|{BLANKS}$", "")


def number(c: Column) -> Column:
    """A number text as a double, thousands commas and blanks aside; null if missing or unreadable."""
    return F.regexp_replace(c, rf",|{BLANKS}", "").try_cast("double")


_ORACLE = r"""
WITH t AS (
  SELECT snapshot_date, delivered_at, row_id, trim(project_id) AS project_id,
         coalesce(try_cast(try_cast(nullif(trim(stage), '') AS DOUBLE) AS BIGINT), 0) AS stage_no,
         coalesce(lower(regexp_replace(project_status, '\s+', '', 'g')), '') AS st,
         try_cast(replace(nullif(trim(mw_connected), ''), ',', '') AS DOUBLE) AS mw
  FROM neso_tec_register),
d AS (SELECT snapshot_date, max(delivered_at) AS delivered_at FROM t GROUP BY 1),
s AS (SELECT *, row_number() OVER (ORDER BY snapshot_date) AS n FROM d),
r AS (
  SELECT s.n, t.project_id, t.stage_no, t.st, t.mw FROM t JOIN s USING (snapshot_date, delivered_at)
  WHERE t.project_id <> ''
  QUALIFY row_number() OVER (PARTITION BY s.n, t.project_id, t.stage_no ORDER BY t.row_id DESC) = 1),
e AS (
  SELECT coalesce(b.n, a.n + 1) AS n, coalesce(b.project_id, a.project_id) AS project_id,
         coalesce(b.stage_no, a.stage_no) AS stage_no,
         CASE WHEN a.n IS NULL THEN 'added' WHEN b.n IS NULL THEN 'removed'
              WHEN a.st <> b.st OR a.mw IS DISTINCT FROM b.mw THEN 'changed' END AS change_type
  FROM r a FULL JOIN r b ON b.n = a.n + 1 AND a.project_id = b.project_id AND a.stage_no = b.stage_no)
SELECT strftime(s.snapshot_date, '%Y-%m-%d') AS snapshot_day, e.project_id, e.stage_no, e.change_type
FROM e JOIN s USING (n) WHERE e.change_type IS NOT NULL AND n > 1
"""


@REG.add("p6_found", _ORACLE)
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """snapshot_day, project_id, stage_no, change_type of every project and stage that came, went or changed."""
    rows = table(spark, sf_dir, "neso_tec_register")
    rows = rows.withColumns({"project_id": F.nullif(_trim(F.col("project_id")), F.lit("")), "stage_no": F.coalesce(number(F.col("stage")).try_cast("long"), F.lit(0).cast("long"))})
    status = F.coalesce(F.lower(F.regexp_replace("project_status", BLANKS, "")), F.lit(""))
    changes = snapshot_changes(rows, ["project_id", "stage_no"], "snapshot_date", "delivered_at", [status, number(F.col("mw_connected"))], ["row_id"])
    return changes.select(F.date_format("day", "yyyy-MM-dd").alias("snapshot_day"), "project_id", "stage_no", "change_type")
