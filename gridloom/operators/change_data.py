"""Change events between two versions, quality gates, disambiguation of keys and upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TERMINAL = ("withdrawn", "cancelled")


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key in ``order``; one aggregation, combined before the shuffle."""
    columns = [c for c in df.columns if c != key]
    picked = df.groupBy(key).agg(F.min_by(F.struct(*columns), order).alias("_row"))
    return picked.select(key, *[F.col(f"_row.{c}").alias(c) for c in columns])


def diff_events(before: DataFrame, after: DataFrame, key: str, state: str, raw_state: str, amount: str, date: str, least: float = 0.5, share: float = 0.01) -> DataFrame:
    """(event_type, key, field, before, after): what changed between two versions, unique by ``key``.

    new and removed; withdrawn where only the new state is terminal, else status_change; status_raw_change where the
    state held but its wording moved beyond case and blanks; capacity_change where the amounts differ by more than
    ``least`` and by more than ``share`` of the larger, or one is missing; date_change where the dates differ, missing
    included. One full outer join and one explode.
    """
    fields = [state, raw_state, amount, date]
    a = before.select(F.col(key).alias("_ka"), *[F.col(c).alias(f"a_{c}") for c in fields])
    b = after.select(F.col(key).alias("_kb"), *[F.col(c).alias(f"b_{c}") for c in fields])
    both = a.join(b, F.col("_ka") == F.col("_kb"), "full_outer")
    A, B = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    fold = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    in_both = F.col("_ka").isNotNull() & F.col("_kb").isNotNull()
    moved = ~A(state).eqNullSafe(B(state))
    ended = F.coalesce(B(state).isin(*TERMINAL), F.lit(False)) & ~F.coalesce(A(state).isin(*TERMINAL), F.lit(False))
    reworded = ~moved & (fold(A(raw_state)) != "") & (fold(B(raw_state)) != "") & (fold(A(raw_state)) != fold(B(raw_state)))
    gap = F.abs(A(amount) - B(amount))
    resized = (A(amount).isNull() != B(amount).isNull()) | F.coalesce((gap > least) & (gap > share * F.greatest(F.abs(A(amount)), F.abs(B(amount)))), F.lit(False))
    text = lambda c: c.cast("string")
    event = lambda when, kind, field, x, y: F.when(when, F.struct(kind.alias("event_type"), F.lit(field).alias("field"), text(x).alias("before"), text(y).alias("after")))
    nothing = F.lit(None).cast("string")
    events = F.array(
        event(F.col("_ka").isNull(), F.lit("new"), None, nothing, nothing),
        event(F.col("_kb").isNull(), F.lit("removed"), None, nothing, nothing),
        event(in_both & moved, F.when(ended, "withdrawn").otherwise("status_change"), state, A(state), B(state)),
        event(in_both & F.coalesce(reworded, F.lit(False)), F.lit("status_raw_change"), raw_state, A(raw_state), B(raw_state)),
        event(in_both & resized, F.lit("capacity_change"), amount, A(amount), B(amount)),
        event(in_both & ~A(date).eqNullSafe(B(date)), F.lit("date_change"), date, A(date), B(date)),
    )
    return both.select(F.coalesce("_ka", "_kb").alias(key), F.inline(F.array_compact(events))).select("event_type", key, "field", "before", "after")


def drift(previous: Column, current: Column, warn: float = 0.10, hold: float = 0.30) -> Column:
    """pass, warn or hold by the relative move of a row count; no previous count passes."""
    move = F.abs(current - previous) / F.when(previous > 0, previous)
    return F.when(move > hold, "hold").when(move >= warn, "warn").otherwise("pass")


def null_rates(df: DataFrame, columns: Sequence[str], by: str) -> DataFrame:
    """(by, column, null_rate): share of missing values of each column in each group, one pass."""
    flags = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).isNull().cast("double").alias("missing")) for c in columns])
    return df.select(by, F.inline(flags)).groupBy(by, "column").agg(F.avg("missing").alias("null_rate"))


def against_trailing_median(df: DataFrame, keys: Sequence[str], order: str, value: str, runs: int = 5) -> DataFrame:
    """``df`` with ``baseline``: the median of the ``runs`` values before each row within its keys, null for the first."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-runs, -1)
    seen = F.sort_array(F.collect_list(value).over(w))  # ``runs`` values at most
    n = F.size("_seen")
    middle = (F.try_element_at(F.col("_seen"), F.floor((n + 1) / 2).cast("int")) + F.try_element_at(F.col("_seen"), F.ceil((n + 1) / 2).cast("int"))) / 2
    return df.withColumn("_seen", seen).withColumn("baseline", F.when(n > 0, middle)).drop("_seen")


def zero_filled_days(df: DataFrame, day: str) -> DataFrame:
    """(day, rows) for every day between the first and the last, days without rows as 0."""
    counts = df.groupBy(F.col(day).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    span = counts.agg(F.min("day").alias("a"), F.max("day").alias("b")).where("a is not null")
    days = span.select(F.explode(F.sequence("a", "b")).alias("day"))
    return days.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("rows"))


def churn(before: DataFrame, after: DataFrame, key: str, state: str) -> DataFrame:
    """One row: previous, kept, removed and moved counts and the verdict.

    hold where under 90 % of the keys stay or removals and state moves exceed 15 %; under 50 previous rows nothing is
    judged.
    """
    a = before.select(F.col(key).alias("_k"), F.col(state).alias("_a"), F.lit(True).alias("_in"))
    b = after.select(F.col(key).alias("_k"), F.col(state).alias("_b"), F.lit(True).alias("_still"))
    j = a.join(b, "_k", "left")
    sums = j.agg(
        F.count(F.lit(1)).alias("previous"), F.count("_still").alias("kept"),
        F.count_if(F.col("_still").isNull()).alias("removed"), F.count_if(F.col("_still").isNotNull() & ~F.col("_a").eqNullSafe(F.col("_b"))).alias("moved"),
    )
    bad = (F.col("kept") / F.col("previous") < 0.9) | ((F.col("removed") + F.col("moved")) / F.col("previous") > 0.15)
    return sums.withColumn("verdict", F.when(F.col("previous") < 50, "not judged").when(bad, "hold").otherwise("pass"))


def disambiguated(df: DataFrame, key: str, content: Sequence[str], out: str = "unique_key") -> DataFrame:
    """``df`` with ``out``: the key where it is unique; else the key, a hash of the content and, for equal contents, a number.

    Every member of a repeated key is suffixed by its content, never by its position, so a row keeps its key when
    others come or go.
    """
    digest = F.substring(F.sha1(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in content])), 1, 10)
    same = Window.partitionBy(key, "_digest").orderBy(*content)
    repeated = df.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    counted = df.join(repeated, F.col(key).eqNullSafe(F.col("_key")), "left").withColumn("_digest", digest).withColumn("_i", F.row_number().over(same))
    suffix = F.concat(F.lit("#"), F.col("_digest"), F.when(F.col("_i") > 1, F.concat(F.lit("."), F.col("_i").cast("string"))).otherwise(""))
    return counted.withColumn(out, F.concat(F.col(key).cast("string"), F.when(F.col("_n") > 1, suffix).otherwise(""))).drop("_digest", "_key", "_n", "_i")


def upsert(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], value: str, tolerance: float = 1e-9) -> tuple[DataFrame, DataFrame]:
    """The merged table, and the corrections (keys, before, after) of stored values that moved by more than ``tolerance``."""
    kept = stored.join(incoming.select(*keys), list(keys), "left_anti")
    old = stored.select(*keys, F.col(value).alias("before"))
    moved = incoming.select(*keys, F.col(value).alias("after")).join(old, list(keys))
    changed = (F.col("before").isNull() != F.col("after").isNull()) | F.coalesce(F.abs(F.col("before") - F.col("after")) > tolerance, F.lit(False))
    return kept.unionByName(incoming), moved.where(changed).select(*keys, "before", "after")


def merged_assets(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(keys, fields, change): stored rows with what the incoming ones state; ``added``, ``updated``, ``same`` or ``kept``.

    A field that the incoming row leaves null keeps its stored value. Keys are unique on both sides.
    """
    a = stored.select(*keys, *[F.col(f).alias(f"_a_{f}") for f in fields], F.lit(True).alias("_a"))
    b = incoming.select(*keys, *[F.col(f).alias(f"_b_{f}") for f in fields], F.lit(True).alias("_b"))
    moved = F.lit(False)
    for f in fields:
        moved = moved | (F.col(f"_b_{f}").isNotNull() & ~F.col(f"_b_{f}").eqNullSafe(F.col(f"_a_{f}")))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "kept").when(moved, "updated").otherwise("same")
    return a.join(b, list(keys), "full_outer").select(*keys, *[F.coalesce(f"_b_{f}", f"_a_{f}").alias(f) for f in fields], change.alias("change"))


def snapshot_stats(df: DataFrame, by: str, columns: Sequence[str], vocabulary: str) -> DataFrame:
    """(by, rows, <column>_missing …, words): rows, shares of missing values and the sorted values of a small vocabulary."""
    missing = [F.avg(F.col(c).isNull().cast("double")).alias(f"{c}_missing") for c in columns]
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("rows"), *missing, F.array_join(F.array_sort(F.collect_set(vocabulary)), "|").alias("words"))


def vocabulary_drift(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """(value, drift): values that came or went between two frames."""
    a, b = before.select(column).distinct().withColumn("_a", F.lit(1)), after.select(column).distinct().withColumn("_b", F.lit(1))
    j = a.join(b, column, "full_outer").where("_a is null or _b is null")
    return j.select(F.col(column).alias("value"), F.when(F.col("_a").isNull(), "new").otherwise("gone").alias("drift"))


def transitions(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, transition): added, removed or kept members between two sets."""
    a = before.select(*keys).distinct().withColumn("_a", F.lit(True))
    b = after.select(*keys).distinct().withColumn("_b", F.lit(True))
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("kept")
    return a.join(b, list(keys), "full_outer").select(*keys, kind.alias("transition"))


def retained(files: DataFrame, key: str, group: str, at: str, promoted: str, cutoff: Column, in_use: DataFrame | None = None) -> DataFrame:
    """(key, reason): why each stored file is kept, or ``delete``.

    In this order: undated; young (from ``cutoff`` on); latest of its group; in use (its key is in ``in_use``); the
    sample of its group and month, which is the last promoted file before the cutoff or else the last one. Equal times
    go by ``key``, which is unique. Maxima per group and month, combined before the shuffle, and two equi-joins.
    """
    order = F.struct(at, key)
    old = F.col(at) < cutoff
    month = F.date_trunc("month", at)
    latest = files.where(F.col(at).isNotNull()).groupBy(F.col(group).alias("_g")).agg(F.max_by(key, order).alias("_latest"))
    samples = files.where(old).groupBy(F.col(group).alias("_sg"), month.alias("_sm"))
    samples = samples.agg(F.coalesce(F.max_by(key, F.when(F.col(promoted), order)), F.max_by(key, order)).alias("_sample"))
    out = files.join(latest, F.col(group).eqNullSafe(F.col("_g")), "left").join(samples, F.col(group).eqNullSafe(F.col("_sg")) & (month == F.col("_sm")), "left")
    used = F.lit(False)
    if in_use is not None:
        out = out.join(in_use.select(F.col(key).alias("_used")).distinct(), F.col(key) == F.col("_used"), "left")
        used = F.col("_used").isNotNull()
    reason = F.when(F.col(at).isNull(), "undated").when(~old, "young").when(F.col("_latest") == F.col(key), "latest").when(used, "in_use").when(F.col("_sample") == F.col(key), "sample").otherwise("delete")
    return out.select(key, reason.alias("reason"))


def aligned_keys(previous: DataFrame, current: DataFrame, base: str, digest: str, key: str) -> DataFrame:
    """``previous`` with the keys that ``current`` gives rows of the same base and content; others keep their own.

    Rows of equal base and content are paired in key order, so no row is multiplied.
    """
    numbered = lambda df: df.withColumn("_i", F.row_number().over(Window.partitionBy(base, digest).orderBy(key)))
    new = numbered(current).select(base, digest, "_i", F.col(key).alias("_new"))
    return numbered(previous).join(new, [base, digest, "_i"], "left").withColumn(key, F.coalesce("_new", key)).drop("_i", "_new")


def weekday_baseline(daily: DataFrame, day: str, rows: str, last: int = 4) -> DataFrame:
    """``daily`` with ``baseline``: the median of the ``last`` same weekdays before."""
    return against_trailing_median(daily.withColumn("_wd", F.dayofweek(day)), ["_wd"], day, rows, last).drop("_wd")


def nulled_fields(previous: DataFrame, current: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(field, had, lost): values set before, and how many of them the same keys now lack."""
    old = previous.select(F.col(key).alias("_k"), *[F.col(f).isNotNull().alias(f"_p{i}") for i, f in enumerate(fields)])
    now = current.select(F.col(key).alias("_k"), *[F.col(f).isNull().alias(f"_n{i}") for i, f in enumerate(fields)])
    facts = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_p{i}").alias("had"), (F.col(f"_p{i}") & F.col(f"_n{i}")).alias("lost")) for i, f in enumerate(fields)])
    return old.join(now, "_k").select(F.inline(facts)).groupBy("field").agg(F.count_if("had").alias("had"), F.count_if("lost").alias("lost"))
