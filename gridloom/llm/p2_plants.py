"""Problem 2: the same plants in two registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.components import component_roots
from gridloom.llm.linkage import ACCEPT, assign, scored_pairs
from gridloom.registry import Registry
from gridloom.session import materialise, table

REG = Registry()

ATLAS, CAPACITY = 0, 1


def _side(df: DataFrame, side: int, key: str, name: str, city: str, capacity: str) -> DataFrame:
    state: Column = F.upper(F.right(F.trim("state"), F.lit(2)))
    return df.where(F.col(key).isNotNull()).select(F.lit(side).alias("side"), F.col(key).cast("long").alias("id"), state.alias("state"), F.col(name).alias("name"), F.col(city).alias("city"), F.col(capacity).cast("double").alias("capacity"))


def plant_pairs(atlas: DataFrame, capacity: DataFrame) -> DataFrame:
    """(atlas_id, capacity_id, confidence) of the rows that are one plant.

    Atlas rows that list one plant twice (like name, town and capacity) form one group first; groups and capacity rows
    are assigned one to one, and each listing of a group gets the pair. Rows without a state are matched among
    themselves; rows without an id are left out.
    """
    rows = _side(atlas, ATLAS, "atlas_id", "name_a", "city_a", "capacity_a").unionByName(_side(capacity, CAPACITY, "capacity_id", "name_b", "city_b", "capacity_b"))
    rows = rows.withColumn("state", F.coalesce("state", F.lit("")))
    scored = materialise(scored_pairs(rows), "scored")
    listed = (F.col("right_side") == ATLAS) & (F.col("name_sim") >= 0.75) & (F.isnan("town_sim") | (F.col("town_sim") >= 0.6)) & (F.isnan("capacity_sim") | (F.col("capacity_sim") >= 0.9)) & (F.col("confidence") > 0)
    twice = component_roots(scored.where(listed).select(F.col("left_id").alias("u"), F.col("right_id").alias("v")), slots=1)
    twice = materialise(twice, "listings")
    links = scored.where((F.col("right_side") == CAPACITY) & (F.col("confidence") >= ACCEPT))
    grouped = links.join(twice, F.col("left_id") == F.col("vertex"), "left").withColumn("plant", F.coalesce("root", "left_id"))
    best = grouped.groupBy(F.col("plant").alias("left_id"), "right_id").agg(F.max("confidence").alias("confidence"))
    chosen = assign(best)
    members = twice.select(F.col("vertex").alias("atlas_id"), F.col("root").alias("plant"))
    others = chosen.join(members, F.col("left_id") == F.col("plant")).select("atlas_id", F.col("right_id").alias("capacity_id"), "confidence")
    return chosen.select(F.col("left_id").alias("atlas_id"), F.col("right_id").alias("capacity_id"), "confidence").unionByName(others)


@REG.add("p2_found")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """atlas_id, capacity_id of each pair of rows that are the same plant."""
    return plant_pairs(table(spark, sf_dir, "ethanol_atlas"), table(spark, sf_dir, "ethanol_capacity")).select("atlas_id", "capacity_id")


@REG.add("p2_confidence")
def p2_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pairs with their confidence."""
    return plant_pairs(table(spark, sf_dir, "ethanol_atlas"), table(spark, sf_dir, "ethanol_capacity"))
