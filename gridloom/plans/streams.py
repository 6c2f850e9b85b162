"""Streams over the events table, drained, and intake queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.registry import Registry
from gridloom.sources import store
from gridloom.streaming import events as st
from gridloom.session import table

REG = Registry()


@REG.add("events_tumbling", "SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H') AS start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Six-hour windows of the event stream."""
    stream = st.read_table_stream(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    out = st.drain(st.tumbling(stream, "at", "6 hours", ["event_type"], late="365 days"), "complete", "tumbling")
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH").alias("start"), "event_type", "events", F.round("total", 4).alias("total"))


@REG.add("events_sliding", """
WITH s AS (SELECT event_type, CAST(ts AS DATE) AS day FROM events), w AS (SELECT event_type, CAST(unnest([day, day - 1]) AS DATE) AS start FROM s)
SELECT strftime(start, '%Y-%m-%d') AS start, event_type, count(*) AS events FROM w GROUP BY ALL""")
def events_sliding(spark: SparkSession, d: str) -> DataFrame:
    """Two-day windows every day, as a stream."""
    stream = st.read_table_stream(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    out = st.drain(st.sliding(stream, "at", "2 days", "1 day", ["event_type"], late="365 days"), "complete", "sliding")
    return out.select(F.date_format("window.start", "yyyy-MM-dd").alias("start"), "event_type", "events")


@REG.add("events_session", """
WITH s AS (SELECT user_id, ts, CASE WHEN coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER w >= 43200000000, true) THEN 1 ELSE 0 END AS st FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
t AS (SELECT user_id, ts, sum(st) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM s)
SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS events FROM t GROUP BY user_id, k""")
def events_session(spark: SparkSession, d: str) -> DataFrame:
    """Sessions with a gap of twelve hours, as a stream; as in the SQL no row is late."""
    stream = st.read_table_stream(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    # Spark joins rows that are exactly the gap apart, the SQL parts them.
    out = st.drain(st.session_windows(stream, "at", "43199999999 microseconds", ["user_id"], late=None), "complete", "sessions")
    return out.select("user_id", F.unix_micros("session_window.start").alias("start_us"), "events")


@REG.add("events_once", "SELECT DISTINCT event_id, event_type FROM events")
def events_once(spark: SparkSession, d: str) -> DataFrame:
    """Each event id once."""
    stream = st.read_table_stream(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return st.drain(st.once(stream, "event_id", "at", late="365 days").select("event_id", "event_type"), "append", "once")


@REG.add("stream_state_changes", """
WITH o AS (SELECT user_id, epoch_us(ts) AS at_us, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_type) AS before FROM events)
SELECT user_id, at_us, before, event_type AS after FROM o WHERE before IS DISTINCT FROM event_type""")
def stream_state_changes(spark: SparkSession, d: str) -> DataFrame:
    """Changes of each user's last event type, in time order; as in the SQL no row is late."""
    stream = st.read_table_stream(spark, d, "events")
    return st.drain(st.state_changes(stream, "user_id", "ts", "event_type", late=None), "update", "changes").withColumnRenamed("key", "user_id")


@REG.add("provenance_stamp", "SELECT 'case:' || trim(CAST(case_id AS VARCHAR)) AS record_id, 'faa' AS source_id, sha1(coalesce(study_asn, chr(0)) || chr(31) || coalesce(structure_city, chr(0))) AS content FROM faa_cases")
def provenance_stamp(spark: SparkSession, d: str) -> DataFrame:
    """Record ids and content hashes of the cases."""
    cases = table(spark, d, "faa_cases")
    rows = store.stamped(cases, "case", "case_id", "file", "open", F.col("retrieved_at"))
    return rows.select("record_id", F.lit("faa").alias("source_id"), store.content_hash(["study_asn", "structure_city"]).alias("content"))


@REG.add("latest_promoted", "SELECT user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ts FROM events WHERE event_type IN ('purchase', 'signup') AND ts < TIMESTAMP '2024-01-25' GROUP BY 1")
def latest_promoted(spark: SparkSession, d: str) -> DataFrame:
    """Newest good run of each source before a time."""
    status = F.when(F.col("event_type").isin("purchase", "signup"), "promoted").otherwise("held")
    runs = table(spark, d, "events").select(F.col("user_id").alias("source_id"), "ts", status.alias("status"))
    return store.latest_promoted(runs, datetime(2024, 1, 25)).select(F.col("source_id").alias("user_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))
