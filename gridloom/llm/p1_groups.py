"""Problem 1: one group id for all proposals linked directly or indirectly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.components import groups
from gridloom.registry import Registry
from gridloom.session import table

REG = Registry()

MIN_SCORE = 75.0

_ORACLE = r"""
WITH RECURSIVE l AS (
  SELECT DISTINCT a, b FROM (
    SELECT lower(trim(left_proposal_id)) AS a, lower(trim(right_proposal_id)) AS b FROM proposal_merge
    WHERE score >= 75 AND NOT isnan(score))
  WHERE a <> '' AND b <> '' AND a <> b),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS id, a AS g FROM e UNION SELECT e.b, r.g FROM r JOIN e ON e.a = r.id WHERE r.g < e.b)
SELECT id AS proposal_id, min(g) AS group_id FROM r GROUP BY 1
"""


def proposal_id(c: str) -> Column:
    """Trimmed lower-case id; null if missing or blank."""
    text = F.lower(F.regexp_replace(c, r"^[\s  ​﻿]+|[\s  ​﻿]+$", ""))
    return F.when(text != "", text)


def proposal_groups(merges: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """(proposal_id, group_id) of each proposal with a link: two different ids and a numeric score of ``min_score`` or more."""
    links = merges.where((F.col("score") >= min_score) & ~F.isnan("score"))
    links = links.select(proposal_id("left_proposal_id").alias("a"), proposal_id("right_proposal_id").alias("b"))
    return groups(links, "a", "b").withColumnRenamed("id", "proposal_id")


@REG.add("p1_found", _ORACLE)
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each proposal in at least one link and the smallest id of its group."""
    return proposal_groups(table(spark, sf_dir, "proposal_merge"))
