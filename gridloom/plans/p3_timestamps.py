"""Problem 3: one UTC instant for price intervals, structure cases and register rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import timestamps as ts
from gridloom.registry import Registry
from gridloom.session import table

REG = Registry()

#: Sources without a catalogue of places: default zone, and whether the day comes first in numeric dates.
SOURCE_DEFAULTS = {"case": ("America/New_York", False), "register": ("UTC", True)}


def _one(column: str) -> F.Column:
    """The value that all rows of a group agree on, else null."""
    return F.when(F.min(column) == F.max(column), F.min(column)).alias(column)


def price_instants(prices: DataFrame, locations: DataFrame) -> DataFrame:
    """(row_id, utc_us, status) of each price row: the interval's end from the UTC text, else from the local text.

    A location listed with two zones has none; a source listed with two countries has none. Zone and country come
    from two small lookups; Spark broadcasts them as long as they stay under its threshold and else sorts.
    """
    zones = locations.where(F.col("location_id").isNotNull()).groupBy("location_id").agg(_one("tz_name")).select("location_id", ts.known_zone(F.col("tz_name")).alias("_tz"))
    countries = locations.where(F.col("source_id").isNotNull()).groupBy("source_id").agg(_one("country")).select("source_id", F.upper("country").alias("_country"))
    rows = (
        prices.select("row_id", "location_id", "source_id", "local_interval", "gmtintervalend")
        .join(zones, "location_id", "left")
        .join(countries, "source_id", "left")
        .withColumn("_day_first", F.when(F.col("_country") == "US", False).when(F.col("_country").isNotNull(), True))
    )
    rows = ts.with_read(rows, F.col("gmtintervalend"), F.col("_day_first"), "gmt_read")
    rows = ts.with_read(rows, F.when(F.col("gmt_read").isNull(), F.col("local_interval")), F.col("_day_first"), "local_read")
    read = F.coalesce("gmt_read", "local_read")
    zone = F.when(F.col("gmt_read").isNotNull(), "UTC").otherwise(F.col("_tz"))
    return ts.with_instant(rows, read, zone, "at").select("row_id", "at.utc_us", "at.status")


def text_instants(df: DataFrame, row_id: str, text: str, zone: str, day_first: bool) -> DataFrame:
    """(row_id, utc_us, status) of a text column with one default zone and one order of day and month."""
    read = ts.with_read(df.select(F.col(row_id).alias("row_id"), text), F.col(text), F.lit(day_first), "read")
    return ts.with_instant(read, F.col("read"), F.lit(zone), "at").select("row_id", "at.utc_us", "at.status")


@REG.add("p3_found")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, row_id, utc_us: every price, case and register row that states exactly one instant."""
    price = price_instants(table(spark, sf_dir, "price_intervals"), table(spark, sf_dir, "price_locations"))
    case = text_instants(table(spark, sf_dir, "faa_cases"), "case_id", "entered_date", *SOURCE_DEFAULTS["case"])
    register = text_instants(table(spark, sf_dir, "neso_tec_register"), "row_id", "mw_effective_from", *SOURCE_DEFAULTS["register"])
    parts = [(price, "price"), (case, "case"), (register, "register")]
    found = [df.where("utc_us is not null").select(F.lit(src).alias("src"), "row_id", "utc_us") for df, src in parts]
    return found[0].unionByName(found[1]).unionByName(found[2])
