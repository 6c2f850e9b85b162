"""Interval series: daily summaries, trailing figures with coverage, as-of joins, like-for-like changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def local_day(at: Column, zone: str) -> Column:
    """Calendar day of a UTC instant in a zone."""
    return F.to_date(F.from_utc_timestamp(at, zone))


def day_hours(day: Column, zone: str) -> Column:
    """23, 24 or 25: the hours of a local day."""
    start = F.to_utc_timestamp(day.cast("timestamp"), zone)
    end = F.to_utc_timestamp(F.date_add(day, 1).cast("timestamp"), zone)
    return ((F.unix_micros(end) - F.unix_micros(start)) / 3_600_000_000).cast("int")


def daily_summary(df: DataFrame, keys: Sequence[str], at: str, value: str, zone: str = "UTC", extremes: int = 4) -> DataFrame:
    """(keys, day, n, mean, lowest, highest, negatives, hours, expected_hours, top_mean, bottom_mean) per local day.

    Hours are floored in UTC, so a repeated local hour stays two hours. The means of the highest and lowest hours
    come only where every hour of the day is there and there are at least twice as many as asked for.
    """
    day = local_day(F.col(at), zone)
    rows = df.where(F.col(value).isNotNull() & F.col(at).isNotNull()).withColumns({"day": day, "_hour": F.date_trunc("hour", at)})
    per_hour = rows.groupBy(*keys, "day", "_hour").agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("s"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.count_if(F.col(value) < 0).alias("neg")
    )
    per_day = per_hour.groupBy(*keys, "day").agg(
        F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("mean"), F.min("lo").alias("lowest"), F.max("hi").alias("highest"), F.sum("neg").alias("negatives"),
        F.count(F.lit(1)).cast("int").alias("hours"), F.sort_array(F.collect_list(F.col("s") / F.col("n"))).alias("_means"),  # 25 hours at most
    )
    whole = (F.col("hours") == F.col("expected_hours")) & (F.col("hours") >= 2 * extremes)
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y) / extremes
    return per_day.withColumn("expected_hours", day_hours(F.col("day"), zone)).select(
        *keys, "day", "n", "mean", "lowest", "highest", "negatives", "hours", "expected_hours",
        F.when(whole, mean(F.slice("_means", -extremes, extremes))).alias("top_mean"), F.when(whole, mean(F.slice("_means", 1, extremes))).alias("bottom_mean"),
    )


def trailing_mean(daily: DataFrame, keys: Sequence[str], as_of: Column, days: int = 365, coverage: float = 0.9) -> DataFrame:
    """(keys, n, expected, coverage, mean): the count-weighted mean of the ``days`` before ``as_of``, withheld below ``coverage``.

    ``daily`` has day, n, mean and expected.
    """
    window = daily.where((F.col("day") < as_of) & (F.col("day") >= F.date_sub(as_of, days)))
    got = window.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("expected").alias("expected"), (F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("mean"))
    share = F.col("n") / F.col("expected")
    return got.select(*keys, "n", "expected", share.alias("coverage"), F.when(share >= coverage, F.col("mean")).alias("mean"))


def as_of(left: DataFrame, right: DataFrame, at: str, right_at: str, values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``left`` with the latest ``right`` values at or before each row's date within ``by``; before the first one, the first.

    ``right`` is a reference series with one row a date and key at most. Its validity spans are expanded to the dates
    they cover and joined by date, so the large side needs no sort and no inequality, and a busy date can be split as
    any skewed equi-join. Rows without a date, or whose key has no series, get nulls.
    """
    w = Window.partitionBy(*by).orderBy(right_at) if by else Window.orderBy(right_at)
    spans = right.where(F.col(right_at).isNotNull()).select(*by, F.col(right_at).alias("_d"), *values)
    spans = spans.withColumns({"_n": F.row_number().over(w.orderBy("_d")), "_next": F.lead("_d").over(w.orderBy("_d"))})
    bounds = left.agg(F.min(at).alias("_lo"), F.max(at).alias("_hi"))  # one row
    spans = spans.join(F.broadcast(bounds))
    start = F.when(F.col("_n") == 1, F.least("_d", "_lo")).otherwise(F.greatest("_d", "_lo"))
    end = F.least(F.coalesce(F.date_sub("_next", 1), F.col("_hi")), F.col("_hi"))
    spans = spans.withColumns({"_from": start, "_to": end}).where("_from <= _to")
    days = spans.select(*by, F.explode(F.sequence("_from", "_to")).alias(at), *values)
    return left.join(days, [*by, at], "left")


def converted(df: DataFrame, quotes: DataFrame, currency: str, day: str, amount: str, quote: str, quote_day: str, per: str, target: str) -> DataFrame:
    """``df`` with ``converted``: amounts in ``target`` at the latest day on or before theirs on which both currencies
    quote, or the first such day; rounded to cents, unchanged for the target's own, null without any common day.

    ``quotes`` has one row a currency and day with the units of it that the base buys.
    """
    own = quotes.where(F.col(quote) == target).select(F.col(quote_day).alias("_day"), F.col(per).alias("_target"))
    both = quotes.where(F.col(quote) != target).join(own, F.col(quote_day) == F.col("_day")).select(F.col(quote).alias(currency), "_day", (F.col("_target")).alias("_t"), F.col(per).alias("_p"))
    out = as_of(df, both, day, "_day", ["_t", "_p"], by=[currency])
    return out.withColumn("converted", F.when(F.col(currency) == target, F.col(amount)).otherwise(F.round(F.col(amount) * F.col("_t") / F.col("_p"), 2))).drop("_t", "_p")


def with_changes(df: DataFrame, keys: Sequence[str], period: str, value: str, basis: str, months: Sequence[int] = (1, 12)) -> DataFrame:
    """``df`` with ``change_<m>m``: the move against exactly ``m`` months before on the same basis; gaps are never bridged."""
    for m in months:
        prior = df.select(*keys, F.add_months(period, m).alias(period), F.col(value).alias("_v"), F.col(basis).alias("_b"))
        df = df.join(prior, [*keys, period], "left").withColumn(f"change_{m}m", F.when(F.col("_b") == F.col(basis), F.col(value) - F.col("_v"))).drop("_v", "_b")
    return df


def basis_breaks(df: DataFrame, keys: Sequence[str], period: str, basis: str) -> DataFrame:
    """Rows whose basis differs from the point before them."""
    before = F.lag(basis).over(Window.partitionBy(*keys).orderBy(period))
    return df.withColumn("previous_basis", before).where(F.col("previous_basis").isNotNull() & (F.col("previous_basis") != F.col(basis)))


def zero_filled(df: DataFrame, key: str, period: str, value: str, step: str = "1 month") -> DataFrame:
    """(key, period, value) for every key and every period between the first and the last, absent ones as 0."""
    span = df.agg(F.min(period).alias("a"), F.max(period).alias("b")).where("a is not null")
    months = span.select(F.explode(F.expr(f"sequence(a, b, interval {step})")).alias(period))
    grid = df.select(key).distinct().join(F.broadcast(months))
    return grid.join(df.select(key, period, value), [key, period], "left").withColumn(value, F.coalesce(value, F.lit(0)))


def weighted_trailing(df: DataFrame, keys: Sequence[str], period: str, numerator: str, denominator: str, months: int = 12) -> DataFrame:
    """``df`` with ``ratio``: sum over sum of the last ``months`` consecutive months, null where one is missing.

    ``period`` is the first day of a month, one row each.
    """
    w = Window.partitionBy(*keys).orderBy(period).rowsBetween(-(months - 1), 0)
    whole = (F.count(F.lit(1)).over(w) == months) & (F.min(period).over(w) == F.add_months(period, -(months - 1)))
    return df.withColumn("ratio", F.when(whole, F.sum(numerator).over(w) / F.sum(denominator).over(w)))


def complete_period(counts: DataFrame, period: str, n: str, share: float = 0.9) -> DataFrame:
    """One row: the newest period whose count is at least ``share`` of the one before."""
    before = F.lag(n).over(Window.orderBy(period))
    return counts.withColumn("_p", before).where(F.col(n) >= share * F.col("_p")).agg(F.max(period).alias(period))
