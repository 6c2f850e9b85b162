"""State changes against a walk in Python: large groups, batches out of time order, late rows, nulls."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from gridloom.plans.streams import events_session, stream_state_changes
from gridloom.streaming import events as st

START = datetime(2024, 1, 1)


def written(spark, folder, name, batches, schema):
    """A table of one file a batch, in that order."""
    (folder / f"{name}.parquet").mkdir(parents=True)
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(str(folder / f"b{i}"))
        next((folder / f"b{i}").glob("*.parquet")).rename(folder / f"{name}.parquet" / f"{i}.parquet")


def walked(batch):
    out, last = [], {}
    for k, at, v in sorted(batch, key=lambda r: (repr(r[0]), r[1] is None, r[1] or START, r[2] is None, r[2] or "")):
        if v != last.get(k):
            out.append((k, None if at is None else at, last.get(k), v))
        last[k] = v
    return sorted(out, key=repr)


def got(df, key):
    rows = ((r[key], None if r["at_us"] is None else START + timedelta(microseconds=r["at_us"] - 1704067200000000), r["before"], r["after"]) for r in df.collect())
    return sorted(rows, key=repr)


def test_state_changes_of_a_large_group(spark, tmp_path):
    rng = random.Random(3)
    events = [(7, START + timedelta(seconds=s), rng.choice("abc")) for s in rng.sample(range(10**6), 25_000)]
    written(spark, tmp_path, "events", [events], "user_id long, ts timestamp_ntz, event_type string")
    assert got(stream_state_changes(spark, str(tmp_path)), "user_id") == walked(events)


def test_state_changes_of_parts_out_of_order_and_nulls(spark, tmp_path):
    rng = random.Random(4)
    events = [(rng.choice([1, 2, None]), START + timedelta(seconds=s), rng.choice(["a", "b", None])) for s in range(180, 0, -1)] + [(1, None, "c")]
    written(spark, tmp_path, "events", [events[i::9] if i % 2 else events[i * 20 : i * 20 + 20] for i in range(9)], "user_id long, ts timestamp_ntz, event_type string")
    whole = [r for i in range(9) for r in (events[i::9] if i % 2 else events[i * 20 : i * 20 + 20])]
    assert got(stream_state_changes(spark, str(tmp_path)), "user_id") == walked(whole)


def test_late_rows_are_those_behind_the_watermark(spark, tmp_path):
    at = lambda s: START + timedelta(seconds=s)
    batches = [[(1, at(100), "a"), (2, at(90), "x")], [(1, at(95), "b"), (1, at(89), "gone"), (1, at(130), "c")], [(1, at(121), "d"), (1, at(120), "gone"), (2, at(150), "x")], [(2, at(160), None)]]
    written(spark, tmp_path, "t", batches, "k long, at timestamp_ntz, v string")
    seen = []
    stream = st.read_table_stream(spark, str(tmp_path), "t", files_per_batch=1)
    out = st.drain(st.state_changes(stream, "k", "at", "v", late="10 seconds"), "update", "t", lambda df, batch: seen.append((batch, df.count())))
    assert got(out, "key") == walked([r for b in batches for r in b if r[2] != "gone"])
    assert seen == [(0, 1), (1, 2), (2, 2), (3, 0), (-1, 1)]


def test_sessions_are_drained_from_a_stream(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    hours = [(k, h) for k in (1, 2) for h in rng.sample(range(20_000), 400)]
    hours.sort(key=lambda r: -r[1])
    written(spark, tmp_path, "events", [[(k, START + timedelta(hours=h)) for k, h in hours[i::9] if i % 2 or h > 9_000] + [(k, START + timedelta(hours=h)) for k, h in hours[i - 1 :: 9] if i and not i % 2 and h < 500] for i in range(9)], "user_id long, ts timestamp_ntz")
    drained, drain = [], st.drain
    monkeypatch.setattr(st, "drain", lambda stream, mode, *a: drained.append((stream.isStreaming, mode)) or drain(stream, mode, *a))
    got = sorted(map(tuple, events_session(spark, str(tmp_path)).collect()))
    expected, last = [], {}
    for k, at in sorted((r["user_id"], r["ts"]) for r in spark.read.parquet(str(tmp_path / "events.parquet")).collect()):
        if k not in last or at - last[k] >= timedelta(hours=12):
            expected.append([k, (at - START) // timedelta(microseconds=1) + 1704067200000000, 0])
        expected[-1][2] += 1
        last[k] = at
    assert got == [tuple(r) for r in expected]
    assert drained == [(True, "complete")]


def test_windows_drop_rows_behind_the_watermark(spark, rows, tmp_path):
    minute = lambda m: START + timedelta(minutes=m)
    # The fourth file's first row is five hours old when it comes, its second one only half an hour. The watermark that
    # tells late rows is that of the batch before.
    batches = [[("a", minute(0), 1.0), ("a", minute(5), 2.0)], [("a", minute(300), 1.0)], [("a", minute(301), 1.0)], [("a", minute(7), 4.0), ("a", minute(270), 8.0)], [("a", minute(900), 1.0)]]
    written(spark, tmp_path, "events", batches, "kind string, ts timestamp, value double")
    stream = st.read_table_stream(spark, str(tmp_path), "events", 1)
    out = st.drain(st.tumbling(stream, "ts", "1 hour", ["kind"], late="1 hour"), "append", "late")
    got = {(r["window"]["start"] - START).seconds // 60: (r["events"], r["total"]) for r in out.collect()}
    assert got == {0: (2, 3.0), 240: (1, 8.0), 300: (2, 2.0)}
    once = st.drain(st.once(st.read_table_stream(spark, str(tmp_path), "events", 1), "kind", "ts", late="1 hour").select("kind", "ts"), "append", "once-late")
    assert rows(once.select("kind"))[0] == ("a",) and once.where(once.ts == minute(5)).count() + once.where(once.ts == minute(0)).count() == 1
