"""Event streams: windows, exact-once intake, keyed state and alerts."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from gridloom.session import checkpoint_root


def read_table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int = 4) -> DataFrame:
    """A stored table as a file stream, with the schema of the files."""
    folder = sf_dir.rstrip("/")
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    # As a pattern the path may be one file or a folder of parts; a plain path may only be a folder.
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder}/[{name[0]}]{name[1:]}.parquet")


def tumbling(stream: DataFrame, at: str, width: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """(keys, window, events, total) per window of ``width``; rows later than ``late`` no longer count."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), *keys).agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total"))


def sliding(stream: DataFrame, at: str, width: str, step: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """(keys, window, events) per window of ``width`` every ``step``."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width, step), *keys).agg(F.count(F.lit(1)).alias("events"))


def session_windows(stream: DataFrame, at: str, gap: str, keys: list[str], late: str | None = "1 hour") -> DataFrame:
    """(keys, session_window, events): a session ends after ``gap`` without a row; with ``late`` None no row is late."""
    rows = stream if late is None else stream.withWatermark(at, late)
    return rows.groupBy(F.session_window(at, gap), *keys).agg(F.count(F.lit(1)).alias("events"))


def once(stream: DataFrame, key: str, at: str, late: str = "1 day") -> DataFrame:
    """Each idempotency key once, with state kept for ``late`` only."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


@dataclass(frozen=True)
class Changes:
    """A stream of (key, at_us, value) whose moves ``drain`` finds in time order, and how late a row may come.

    Each batch keeps its rows in the folder ``rows``. Once the watermark (newest time less ``late``) has passed them they
    are ordered by key and time, and ``last`` takes each key's last value; what is open at the end follows then. The
    order is made by Spark's sort, which spills, so no key has to fit in memory. What a batch writes depends on earlier
    batches only, so it may be run again.
    """

    rows: DataFrame
    late: str | None

    @property
    def sparkSession(self) -> SparkSession:  # noqa: N802
        return self.rows.sparkSession

    @property
    def schema(self) -> StructType:
        return StructType([StructField("key", self.rows.schema["key"].dataType), StructField("at_us", LongType()), StructField("before", StringType()), StructField("after", StringType())])

    def _with_batch(self, *names: str) -> StructType:
        return StructType([*[self.rows.schema[n] for n in names], StructField("batch", IntegerType())])

    def _held(self, spark: SparkSession, root: str, end: int) -> DataFrame:
        return spark.read.schema(self._with_batch("key", "at_us", "value")).parquet(f"{root}/rows").where(F.col("batch") < end)

    def _watermark(self, spark: SparkSession, root: str, end: int) -> int | None:
        """Of the batches before ``end``; no row at or before it comes any more."""
        if self.late is None or not end:
            return None
        return self._held(spark, root, end).agg(F.expr(f"unix_micros(timestamp_micros(max(at_us)) - INTERVAL '{self.late}')")).first()[0]

    def _moves(self, due: DataFrame, root: str, end: int) -> DataFrame:
        """The moves of ``due`` from the last values of the batches before ``end``."""
        ordered = due.select("key", "at_us", "value", F.lit(1).alias("due"))
        if self.late is not None and end:
            last = due.sparkSession.read.schema(self._with_batch("key", "value")).parquet(f"{root}/last").where(F.col("batch") < end)
            last = last.groupBy("key").agg(F.max(F.struct("batch", "value")).alias("l"))
            ordered = ordered.unionByName(last.select("key", F.lit(None).cast("long").alias("at_us"), F.col("l.value").alias("value"), F.lit(0).alias("due")))
        w = Window.partitionBy("key").orderBy("due", F.asc_nulls_last("at_us"), F.asc_nulls_last("value"))
        moves = ordered.withColumn("before", F.lag("value").over(w)).where((F.col("due") == 1) & ~F.col("before").eqNullSafe(F.col("value")))
        return moves.select("key", "at_us", "before", F.col("value").alias("after"))

    def closed(self, df: DataFrame, root: str, batch: int) -> DataFrame:
        """Keep a batch but for its late rows; the moves that the watermark has passed with it."""
        spark = df.sparkSession
        before = self._watermark(spark, root, batch)
        fresh = df if before is None else df.where(F.col("at_us").isNull() | (F.col("at_us") > before))
        fresh.write.mode("overwrite").parquet(f"{root}/rows/batch={batch}")
        now = self._watermark(spark, root, batch + 1)
        due = self._held(spark, root, batch + 1).where(F.lit(False) if now is None else F.col("at_us") <= now)
        due = due if before is None else due.where(F.col("at_us") > before)
        if self.late is not None:
            last = F.max(F.struct("at_us", F.col("value").isNull().alias("none"), "value"))
            due.groupBy("key").agg(last.alias("l")).select("key", "l.value").write.mode("overwrite").parquet(f"{root}/last/batch={batch}")
        return self._moves(due, root, batch)

    def open(self, root: str) -> DataFrame:
        """The moves after the last watermark; rows without a time come last."""
        spark, end = self.sparkSession, 1 << 30
        mark = self._watermark(spark, root, end)
        held = self._held(spark, root, end)
        return self._moves(held if mark is None else held.where(F.col("at_us").isNull() | (F.col("at_us") > mark)), root, end)


def state_changes(stream: DataFrame, key: str, at: str, value: str, late: str | None = "0 seconds") -> Changes:
    """(key, at_us, before, after), once drained: a row whenever a key's value moves.

    Rows are taken in time order, equal times by value and nulls last, however batches and partitions bring them. A row
    at or before the watermark, which is ``late`` behind the newest row of earlier batches, changes nothing; with None no
    row is late, and all of them are held until the end.
    """
    return Changes(stream.select(F.col(key).alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("at_us"), F.col(value).cast("string").alias("value")), late)


def drain(stream: DataFrame | Changes, mode: str, label: str, each: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Run a stream over all that is there and give its result table; ``complete`` keeps the last result, others append.

    Output and offsets lie in the shared checkpoint folder, so a restart goes on where it stopped.
    """
    spark = stream.sparkSession
    root = f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"
    schema = stream.schema
    changes = isinstance(stream, Changes)

    def keep(df: DataFrame, batch: int) -> None:
        # Each batch has its own folder, so a batch that is run again replaces what it wrote.
        target = f"{root}/out" if mode == "complete" else f"{root}/out/batch={batch}"
        df.write.mode("overwrite").parquet(target)
        if each:
            each(df, batch)

    def ordered(df: DataFrame, batch: int) -> None:
        keep(stream.closed(df, root, batch), batch)

    writer = (stream.rows if changes else stream).writeStream.outputMode(mode).foreachBatch(ordered if changes else keep).option("checkpointLocation", f"{root}/offsets").trigger(availableNow=True)
    writer.start().awaitTermination()
    if changes:
        keep(stream.open(root), -1)
    return spark.read.schema(schema).parquet(f"{root}/out").select(*[f.name for f in schema])


def alerts(events: DataFrame, searches: DataFrame, condition: Column, seq: str, watermark: str, horizon: int) -> tuple[DataFrame, DataFrame]:
    """Matches of new events with saved searches, and the searches with their watermark moved on.

    Events in (watermark, horizon] are considered; the watermark goes to the highest one considered, matching or not,
    and never past the horizon. ``condition`` joins the two on equal keys.
    """
    considered = events.where(F.col(seq) <= horizon)
    fresh = considered.join(searches, condition & (F.col(seq) > F.col(watermark)))
    top = considered.agg(F.max(seq).alias("_top"))  # one row
    moved = searches.join(F.broadcast(top)).withColumn(watermark, F.greatest(F.col(watermark), F.coalesce("_top", F.col(watermark)))).drop("_top")
    return fresh, moved
