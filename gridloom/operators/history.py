"""History of changing attributes: one row per version with the period it was valid."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from heapq import merge
from itertools import repeat

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.session import forget, materialise

OPEN = -1
#: Snapshots that the updates are cut into, and so sorted runs that a task merges.
SNAPSHOTS = 8
#: Rows of a run in memory, and of a batch of versions.
BATCH_ROWS = 10_000


def utc_micros(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970 of a timestamp column, with or without zone, whatever the session's zone."""
    if dict(df.dtypes)[column] == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{column}`)")
    return F.unix_micros(column)


def sorted_run(path: str, run: int) -> Iterator[tuple[str, int, int, str]]:
    """Rows (key, at_us, run, payload) of one sorted file, a batch in memory at a time."""
    fs, inner = FileSystem.from_uri(path)
    with fs.open_input_file(inner) as source:
        for batch in pq.ParquetFile(source).iter_batches(BATCH_ROWS, columns=["key", "at_us", "payload"]):
            yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), repeat(run), batch.column(2).to_pylist())


def merged_versions(runs: Iterable[Iterator[tuple[str, int, int, str]]]) -> Iterator[tuple[str, str, int, int]]:
    """Versions (key, payload, from_us, to_us) from sorted runs, merged by key, time and run.

    Of equal keys and times the last of the last run holds. One reading and one open version are held, no history.
    """
    open_key = open_payload = open_from = None
    key = at = payload = None

    def closed() -> tuple[str, str, int, int] | None:
        """Take the reading in hand into the open version; the version that this closes."""
        nonlocal open_key, open_payload, open_from
        if key == open_key and payload == open_payload:
            return None
        done = None if open_key is None else (open_key, open_payload, open_from, at if key == open_key else OPEN)
        open_key, open_payload, open_from = key, payload, at
        return done

    for k, t, _, content in merge(*runs):
        if (k != key or t != at) and key is not None and (done := closed()):
            yield done
        key, at, payload = k, t, content
    if key is not None:
        if done := closed():
            yield done
        yield open_key, open_payload, open_from, OPEN


def _merge_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Versions of each part (part, paths: its run of every snapshot, oldest first).

    edge is 0 within the part; its first version has edge bit 1 and its last bit 2, since those may go on in a
    neighbour part.
    """
    for batch in batches:
        for part, paths in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows, first = [], True
            for row in merged_versions(sorted_run(path, i) for i, path in enumerate(paths)):
                rows.append(row)
                if len(rows) > BATCH_ROWS:
                    yield _rows(part, rows[:-1], 1 if first else 0, 0)
                    rows, first = rows[-1:], False
            yield _rows(part, rows, 1 if first else 0, 2)


def _rows(part: int, rows: list[tuple[str, str, int, int]], head: int, tail: int) -> pa.RecordBatch:
    edges = [0] * len(rows)
    edges[0] |= head
    edges[-1] |= tail
    columns = [*zip(*rows, strict=True)]
    types = (pa.string(), pa.string(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array([part] * len(rows), pa.int32()), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)], pa.array(edges, pa.int32())],
        names=["part", "key", "payload", "from_us", "to_us", "edge"],
    )


def stitch(edges: Sequence[tuple]) -> list[tuple]:
    """Final (key, from_us, to_us) of the edge versions, given in partition order as (key, payload, from_us, to_us, edge)."""
    done: list[list] = []
    pending: list | None = None  # the last version of the partitions so far
    for key, payload, from_us, to_us, edge in edges:
        if edge & 1 and pending is not None:
            if pending[0] == key and pending[1] == payload:
                from_us = pending[2]
            else:
                done.append([pending[0], pending[2], from_us if pending[0] == key else OPEN])
            pending = None
        if edge & 2:
            pending = [key, payload, from_us]
        else:
            done.append([key, from_us, to_us])
    if pending is not None:
        done.append([pending[0], pending[2], OPEN])
    return [tuple(x) for x in done]


def _runs_of(df: DataFrame) -> list[tuple[int, list[str]]]:
    """(part, paths of its runs by snapshot) of a table written by ``versions``: a file for each task and snapshot."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._gridloom_path)
    fs = path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
    found: dict[int, list[tuple[int, str]]] = {}
    for folder in fs.listStatus(path):
        if match := re.search(r"snapshot=(\d+)$", folder.getPath().toString()):
            for file in fs.listStatus(folder.getPath()):
                name = file.getPath().toString()
                if part := re.search(r"/part-(\d+)-[^/]*$", name):
                    found.setdefault(int(part[1]), []).append((int(match[1]), re.sub(r"^file:/(?!/)", "file:///", name)))
    return [(part, [p for _, p in sorted(runs)]) for part, runs in sorted(found.items())]


def versions(updates: DataFrame, key: str, observed: str, retrieved: str, attributes: Sequence[Column], tiebreak: Sequence[str] = (), snapshots: int = SNAPSHOTS) -> DataFrame:
    """(key, valid_from_us, valid_to_us): longest runs of readings, in ``observed`` order, with equal ``attributes``.

    Of the readings of one entity at one time the last ``retrieved`` holds, then the greatest ``tiebreak``, then the
    greatest content; a null ``retrieved`` is the earliest. Null is a value of its own. Rows without key or time count
    for nothing.

    The updates are cut by ``retrieved`` into at most ``snapshots`` snapshots of about equal size. One range partition
    over (key, time) holds for all snapshots, so an entity with any share of all rows spreads over as many parts as it
    needs; each part of each snapshot is written as a sorted run. A task then merges the runs of its part, of which it
    holds a batch each, keeps one open version and emits it as the content changes. Versions at the edges of parts,
    two a part, are put together on the driver.
    """
    spark = updates.sparkSession
    contents = [f"a{i}" for i in range(len(attributes))]
    ties = [f"t{i}" for i in range(len(tiebreak))]
    received = utc_micros(updates, retrieved)
    readings = updates.where(F.col(key).isNotNull() & F.col(observed).isNotNull()).select(
        F.col(key).cast("string").alias("key"), utc_micros(updates, observed).alias("at_us"), received.alias("got_us"),
        *[F.col(t).alias(n) for t, n in zip(tiebreak, ties, strict=True)], *[c.alias(n) for c, n in zip(attributes, contents, strict=True)],
    )
    # Equal times of receipt are in one snapshot, and later ones never in an earlier snapshot.
    bounds = readings.agg(F.percentile_approx("got_us", [i / snapshots for i in range(1, snapshots)], 1_000)).first()[0] if snapshots > 1 else None
    later = [F.coalesce(F.col("got_us") > b, F.lit(False)).cast("int") for b in sorted(set(bounds or []))]
    readings = readings.withColumn("snapshot", sum(later, F.lit(0)))
    runs = readings.repartitionByRange("key", "at_us").sortWithinPartitions("snapshot", "key", "at_us", "got_us", *ties, *contents)
    runs = materialise(runs.select("snapshot", "key", "at_us", F.to_json(F.struct(*contents)).alias("payload")), "runs", ["snapshot"])
    parts = _runs_of(runs)
    schema = "part int, key string, payload string, from_us long, to_us long, edge int"
    if not parts:
        return spark.createDataFrame([], "key string, valid_from_us long, valid_to_us long")
    tasks = spark.createDataFrame(parts, "part int, paths array<string>").withColumn("task", F.row_number().over(Window.orderBy("part")) - 1)  # one row a part
    merged = materialise(tasks.repartitionById(len(parts), "task").select("part", "paths").mapInArrow(_merge_parts, schema), "versions")
    forget(runs)
    edges = merged.where("edge > 0").select("part", "edge", "key", "payload", "from_us", "to_us").collect()
    edges.sort(key=lambda r: (r["part"], r["edge"]))
    final = stitch([(r["key"], r["payload"], r["from_us"], r["to_us"], r["edge"]) for r in edges])
    ends = spark.createDataFrame(final, "key string, valid_from_us long, valid_to_us long")
    inner = merged.where("edge = 0").select("key", F.col("from_us").alias("valid_from_us"), F.col("to_us").alias("valid_to_us"))
    return inner.unionByName(ends)
