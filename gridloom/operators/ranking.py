"""Islands, top rows per group, per-field winners and modes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(df: DataFrame, keys: Sequence[str], position: Column, gap: float, bucket: float, out: str, tiebreak: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``out``: 1, 2, 3 … within the keys, a new number where ``position`` is more than ``gap`` past the row before.

    Rows are ordered within (keys, bucket of ``bucket`` positions), so a key that holds a large part of all rows is cut
    into its buckets; what goes from bucket to bucket, the last position and the number of starts, is one row a
    bucket. Rows with a null position get null.
    """
    placed = df.withColumn("_p", position.cast("double")).withColumn("_b", F.floor(F.col("_p") / bucket))
    within = Window.partitionBy(*keys, "_b").orderBy("_p", *tiebreak)
    over_buckets = Window.partitionBy(*keys).orderBy("_b")
    back = lambda d, *names: d.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_kb"), *names)
    same = F.col("_b") == F.col("_kb")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    known = placed.where("_p is not null")
    lasts = known.groupBy(*keys, "_b").agg(F.max("_p").alias("_last"))
    lasts = back(lasts.withColumn("_before", F.lag("_last").over(over_buckets)), "_before")
    spare = [f"_k{i}" for i in range(len(keys))] + ["_kb"]
    flagged = known.withColumn("_lag", F.lag("_p").over(within)).join(lasts, same).drop(*spare)
    flagged = flagged.withColumn("_start", F.when(F.coalesce(F.col("_p") - F.coalesce("_lag", "_before") > gap, F.lit(True)), 1).otherwise(0))
    starts = flagged.groupBy(*keys, "_b").agg(F.sum("_start").alias("_n"))
    starts = back(starts.withColumn("_so_far", F.coalesce(F.sum("_n").over(over_buckets.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))), "_so_far")
    numbered = flagged.join(starts, same).withColumn(out, F.col("_so_far") + F.sum("_start").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    lost = placed.where("_p is null").withColumn(out, F.lit(None).cast("long"))
    columns = [*df.columns, out]
    return numbered.select(*columns).unionByName(lost.select(*columns))


def islands(df: DataFrame, keys: Sequence[str], index: str) -> DataFrame:
    """``df`` with ``island``: runs of consecutive whole ``index`` values within the keys share one number."""
    return runs(df, keys, F.col(index), 1, 4_096, "island")


def sessions(df: DataFrame, keys: Sequence[str], at: str, gap_s: float, tiebreak: str, bucket_s: float = 86_400) -> DataFrame:
    """``df`` with ``session``: a new number whenever more than ``gap_s`` seconds passed since the row before."""
    seconds = F.unix_micros(F.col(at).cast("timestamp")) / 1_000_000
    return runs(df, keys, seconds, gap_s, bucket_s, "session", [tiebreak])


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group with ``rank``; Spark limits each partition's groups before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def winners(df: DataFrame, keys: Sequence[str], rules: Mapping[str, Column], eligible: Mapping[str, Column] | None = None) -> DataFrame:
    """For each group and field the value of the member that its rule ranks highest; missing values never win.

    One aggregation with a maximum per field, so a group of any size is combined before the shuffle.
    """
    picks = []
    for field, rank in rules.items():
        ok = F.col(field).isNotNull()
        if eligible and field in eligible:
            ok = ok & eligible[field]
        picks.append(F.max_by(F.when(ok, F.col(field)), F.when(ok, rank)).alias(field))
    return df.groupBy(*keys).agg(*picks)


def most_advanced(df: DataFrame, keys: Sequence[str], state: str, ladder: Sequence[str], withdrawn: str, live: Column) -> DataFrame:
    """(keys, state): the furthest state on the ladder; a withdrawal wins unless a live member got further than the ladder's first step."""
    place = F.coalesce(*[F.when(F.col(state) == s, i) for i, s in enumerate(ladder)], F.lit(-1))
    g = df.groupBy(*keys).agg(F.max(place).alias("_far"), F.max(F.when(live, place)).alias("_live"), F.bool_or(F.col(state) == withdrawn).alias("_gone"))
    names = F.array(*[F.lit(s) for s in ladder])
    furthest = F.when(F.col("_far") >= 0, F.get(names, F.col("_far")))
    return g.select(*keys, F.when(F.col("_gone") & (F.coalesce("_live", F.lit(-1)) < 1), withdrawn).otherwise(furthest).alias("state"))


def mode_with_tie(df: DataFrame, keys: Sequence[str], value: str, preferred: str | None = None) -> DataFrame:
    """(keys, value, n): the most frequent value of each group; ties go to ``preferred``'s value, then to the least."""
    g = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), (F.max(F.col(preferred) == F.col(value)) if preferred else F.lit(False)).alias("_p"))
    w = Window.partitionBy(*keys).orderBy(F.col("n").desc(), F.col("_p").desc(), F.col(value))
    return g.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*keys, value, "n")


def capacity_of(df: DataFrame, keys: Sequence[str], amount: str, live: Column, inventory: Column, covered: Column) -> DataFrame:
    """(keys, amount): live requests plus uncovered inventory, else inventory, else the sum of the rest, else the largest."""
    total = lambda c: F.sum(F.when(c, F.col(amount)))
    g = df.groupBy(*keys).agg(
        total(live & ~inventory).alias("_live"), total(inventory & ~covered).alias("_open"), total(inventory).alias("_all"), total(~live & ~inventory).alias("_rest"), F.max(amount).alias("_max")
    )
    return g.select(*keys, F.coalesce(F.col("_live") + F.coalesce("_open", F.lit(0)), "_all", "_rest", "_max").alias(amount))


def keyed_sample(df: DataFrame, strata: Sequence[str], key: str, n: int, seed: str = "") -> DataFrame:
    """``n`` rows of each stratum by a hash of the key, the same whenever it is drawn."""
    w = Window.partitionBy(*strata).orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")
