"""What changed between full snapshots: gaps and islands over key and row hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def snapshot_changes(snapshots: DataFrame, keys: Sequence[str], day: str, delivered: str, compared: Sequence[Column], tiebreak: Sequence[str] = ()) -> DataFrame:
    """(day, *keys, change_type): rows added, removed or changed against the snapshot before.

    Of the deliveries of a day only the last counts (a null ``delivered`` is the earliest). ``compared`` holds the
    expressions whose values make a row's content, null being a value of its own. Rows with a null key or day count
    for nothing; a key repeated within a delivery counts once, with the content of the greatest ``tiebreak``. The
    first snapshot makes no events.

    A key's rows of equal content on consecutive snapshots form an island, with the snapshots' positions as the
    sequence. An island that starts where the one before ended is a change; other starts are additions, and ends that
    nothing follows are removals. Windows run per key and hold one row a snapshot at most, whatever was repeated;
    repeats are combined before the shuffle. The table of days has one row a day (36,525 a century), which bounds the
    broadcast and the one unpartitioned window.
    """
    deliveries = snapshots.where(F.col(day).isNotNull()).groupBy(F.col(day).alias("_day")).agg(F.max(delivered).alias("_last"))
    order = Window.orderBy("_day")
    days = deliveries.withColumns({"_seq": F.row_number().over(order), "_next_day": F.lead("_day").over(order)})
    content = F.xxhash64(*[x for c in compared for x in (c, c.isNull())])
    rows = snapshots.select(*keys, F.col(day).alias("_on"), F.col(delivered).alias("_at"), *[F.col(t).alias(f"_t{i}") for i, t in enumerate(tiebreak)], content.alias("_hash"))
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    rows = rows.join(F.broadcast(days), (F.col("_on") == F.col("_day")) & F.col("_at").eqNullSafe(F.col("_last")))
    pick = F.max_by("_hash", F.struct(*[f"_t{i}" for i in range(len(tiebreak))], "_hash")).alias("_hash")
    one = rows.groupBy(*keys, "_seq").agg(pick)

    same = Window.partitionBy(*keys, "_hash").orderBy("_seq")
    islands = (
        one.withColumn("_island", F.col("_seq") - F.row_number().over(same))
        .groupBy(*keys, "_hash", "_island")
        .agg(F.min("_seq").alias("_from"), F.max("_seq").alias("_to"))
    )
    by_key = Window.partitionBy(*keys).orderBy("_from")
    islands = islands.withColumns({"_before": F.lag("_to").over(by_key), "_after": F.lead("_from").over(by_key)})
    start = F.when(F.col("_before") == F.col("_from") - 1, "changed").when(F.col("_from") > 1, "added")
    end = F.when(F.coalesce(F.col("_after") != F.col("_to") + 1, F.lit(True)), "removed")
    events = islands.select(
        *keys,
        F.inline(F.array(
            F.struct(F.col("_from").alias("_seq"), start.alias("change_type")),
            F.struct((F.col("_to") + 1).alias("_seq"), end.alias("change_type")),
        )),
    ).where("change_type is not null")
    # A removal after the last day finds no day here and so falls away.
    return events.join(F.broadcast(days.select("_seq", "_day")), "_seq").select(F.col("_day").alias("day"), *keys, "change_type")
