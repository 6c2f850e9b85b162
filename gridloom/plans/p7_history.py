"""Problem 7: versions of each proposal's state, capacity and date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.history import versions
from gridloom.registry import Registry
from gridloom.session import table

REG = Registry()

_ORACLE = r"""
WITH t AS (
  SELECT proposal_id, observed_at, retrieved_at, update_id,
         nullif(nullif(regexp_replace(trim(lower(lifecycle_state)), '[\s_-]+', '_', 'g'), ''), 'unknown') AS st,
         round(capacity_mw, 3) AS mw, proposed_online_date AS d
  FROM proposal_updates WHERE proposal_id IS NOT NULL AND observed_at IS NOT NULL),
o AS (
  SELECT * FROM t
  QUALIFY row_number() OVER (PARTITION BY proposal_id, observed_at ORDER BY retrieved_at DESC, update_id DESC) = 1),
c AS (
  SELECT *, row_number() OVER w AS rn, lag(st) OVER w AS pst, lag(mw) OVER w AS pmw, lag(d) OVER w AS pd
  FROM o WINDOW w AS (PARTITION BY proposal_id ORDER BY observed_at)),
s AS (
  SELECT proposal_id, epoch_us(observed_at) AS us FROM c
  WHERE rn = 1 OR st IS DISTINCT FROM pst OR mw IS DISTINCT FROM pmw OR d IS DISTINCT FROM pd)
SELECT proposal_id, us AS valid_from_us, coalesce(lead(us) OVER (PARTITION BY proposal_id ORDER BY us), -1) AS valid_to_us FROM s
"""


@REG.add("p7_found", _ORACLE)
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """proposal_id, valid_from_us, valid_to_us of every version."""
    updates = table(spark, sf_dir, "proposal_updates")
    state = F.regexp_replace(F.trim(F.lower("lifecycle_state")), r"[\s _-]+", "_")
    state = F.when(~state.isin("", "_", "unknown"), state)
    mw = F.when(~F.isnan("capacity_mw"), F.round("capacity_mw", 3) + 0.0)
    found = versions(updates, "proposal_id", "observed_at", "retrieved_at", [state, mw, F.col("proposed_online_date")], ["update_id"])
    return found.withColumnRenamed("key", "proposal_id")
