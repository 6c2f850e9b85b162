"""Blocks of measures: windows of time, rankings, two-sided comparisons, checks and shares."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def complete_day(df: DataFrame, at: str, now: Column) -> DataFrame:
    """Rows of the last whole UTC day before ``now``."""
    end = F.date_trunc("day", now)
    return df.where((F.col(at) < end) & (F.col(at) >= F.date_trunc("day", end - F.expr("INTERVAL 1 DAY"))))


def recent(df: DataFrame, at: str, now: Column, days: int) -> DataFrame:
    """Rows in the ``days`` up to ``now``, which itself is inside."""
    return df.where((F.col(at) > now - F.expr(f"INTERVAL {days} DAY")) & (F.col(at) <= now))


def blocks(df: DataFrame, dimensions: Mapping[str, str], pairs: Sequence[tuple[str, str]], amount: str) -> DataFrame:
    """(block, the dimensions, records, total): the total, each dimension and the ``pairs`` of them, in one pass.

    ``block`` names the dimensions that count; the exact sum is null where nothing is stated.
    """
    view = df.select(*[F.col(c).alias(n) for n, c in dimensions.items()], F.col(amount).cast("decimal(18,3)").alias("_x"))
    sets = [[], *[[n] for n in dimensions], *[list(p) for p in pairs]]
    flags = [F.when(F.grouping(n) == 0, n) for n in dimensions]
    g = view.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(n) for n in dimensions])
    out = g.agg(F.nullif(F.concat_ws(" ", *flags), F.lit("")).alias("_b"), F.count(F.lit(1)).alias("records"), F.sum("_x").alias("total"))
    return out.select(F.coalesce("_b", F.lit("total")).alias("block"), *dimensions, "records", "total")


def ranked(df: DataFrame, key: str, amount: Column) -> DataFrame:
    """(key, records, total, place): by sum, count and key, unstated sums last. The ranking runs over one row a key."""
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("records"), F.sum(amount).alias("total"))
    return g.withColumn("place", F.rank().over(Window.orderBy(F.desc_nulls_last("total"), F.desc("records"), key)))


def two_sides(a: DataFrame, b: DataFrame, key: str, name_a: str, name_b: str) -> DataFrame:
    """(key, name_a, name_b, ratio): counts of two sides; a key on one side only is a zero on the other."""
    count = lambda df, n: df.groupBy(key).agg(F.count(F.lit(1)).alias(n))
    both = count(a, name_a).join(count(b, name_b), key, "full_outer").na.fill(0, [name_a, name_b])
    return both.withColumn("ratio", F.when(F.col(name_b) > 0, F.col(name_a) / F.col(name_b)))


def capacity_factor(net: Column, capacity: Column, year: Column) -> Column:
    """Output over capacity times the hours of the year; null without capacity."""
    hours = F.dayofyear(F.make_date(year, F.lit(12), F.lit(31))) * 24
    return F.when(capacity > 0, net / (capacity * hours))


def shares(df: DataFrame, key: str, value: str, names: Mapping[str, str], total: str) -> DataFrame:
    """(key, a column for each of ``names`` with its value's share, total): a pivot in one aggregation."""
    n = F.count(F.lit(1))
    return df.groupBy(key).agg(*[(F.count_if(F.col(value) == v) / n).alias(c) for v, c in names.items()], n.alias(total))


def part_share(value: Column, condition: Column) -> Column:
    """The sum where the condition holds over the whole sum, in per cent."""
    return F.coalesce(F.sum(F.when(condition, value)), F.lit(0.0)) / F.sum(value) * 100


def checked(df: DataFrame, group: str, key: str, value: str, lo: float, hi: float, missing: float = 0.1, bad: int = 5) -> DataFrame:
    """(group, rows, repeated, missing, out_of_range, verdict): hold for too many missing or impossible values, warn for repeats."""
    n = F.count(F.lit(1))
    g = df.groupBy(group).agg(
        n.alias("rows"), (n - F.count_distinct(key)).alias("repeated"), (F.count_if(F.col(value).isNull()) / n).alias("missing"), F.count_if((F.col(value) < lo) | (F.col(value) > hi)).alias("out_of_range")
    )
    held = (F.col("missing") > missing) | (F.col("out_of_range") > bad)
    return g.withColumn("verdict", F.when(held, "hold").when(F.col("repeated") > 0, "warn").otherwise("pass"))


def precision_recall(df: DataFrame, keys: Sequence[str], accepted: Column, same: Column) -> DataFrame:
    """(keys, tp, fp, fn, precision, recall); null where there is nothing to divide by."""
    g = df.groupBy(*keys).agg(F.count_if(accepted & same).alias("tp"), F.count_if(accepted & ~same).alias("fp"), F.count_if(~accepted & same).alias("fn"))
    ratio = lambda other: F.when(F.col("tp") + F.col(other) > 0, F.col("tp") / (F.col("tp") + F.col(other)))
    return g.withColumns({"precision": ratio("fp"), "recall": ratio("fn")})


def score_interval(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of a share by inverting the normal test of a proportion, kept within 0 and 1; null for no trials."""
    share, weight = hits / n, z * z / n
    spread = z * F.sqrt(share * (1 - share) / n + weight / n / 4)
    at = lambda side: (share + weight / 2 + side * spread) / (1 + weight)
    return F.when(n > 0, F.greatest(F.lit(0.0), at(-1))), F.when(n > 0, F.least(F.lit(1.0), at(1)))


def latest_and_before(df: DataFrame, key: str, period: str, value: str, months: int) -> DataFrame:
    """(key, period, value, before): each key's latest month and its value exactly ``months`` earlier, null if that month is missing."""
    last = df.groupBy(key).agg(F.max_by(F.struct(period, value), period).alias("_l")).select(key, f"_l.{period}", f"_l.{value}")
    prior = df.select(key, F.add_months(period, months).alias(period), F.col(value).alias("before"))
    return last.join(prior, [key, period], "left")


def bucketed(df: DataFrame, keys: Sequence[str], buckets: Mapping[str, Column], amount: Column) -> DataFrame:
    """(keys, <bucket>_records, <bucket>_total …): conditional counts and sums in one aggregation."""
    out = []
    for name, condition in buckets.items():
        out += [F.count_if(condition).alias(f"{name}_records"), F.sum(F.when(condition, amount)).alias(f"{name}_total")]
    return df.groupBy(*keys).agg(*out)


def month_verdicts(months: DataFrame, period: str, basis: str) -> DataFrame:
    """(month, basis, n, previous, verdict) of (period, basis, n, missing): against the month before on the same basis only."""
    prior = months.select(F.add_months(period, 1).alias(period), basis, F.col("n").alias("previous"), F.col("missing").alias("_m"))
    j = months.join(prior, [period, basis], "left")
    move, rise = F.abs(F.col("n") - F.col("previous")) / F.col("previous"), F.col("missing") - F.col("_m")
    verdict = F.when(F.col("previous").isNull(), "no previous").when((move > 0.3) | (rise > 0.1), "hold").when((move >= 0.1) | (rise > 0.05), "warn").otherwise("pass")
    return j.select(F.date_format(period, "yyyy-MM").alias("month"), basis, "n", "previous", verdict.alias("verdict"))
