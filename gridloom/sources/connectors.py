"""Sources as data: what a connector is, the registry of them, and one run from raw rows to promoted events."""

from __future__ import annotations

import hashlib
import inspect
import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import change_data as cd
from gridloom.sources.store import Store, stamped

#: What a vanished row means, and the event it makes; an unknown meaning announces nothing.
REMOVALS = {"withdrawn": "withdrawn", "delisted": "delisted", "removed": "removed_from_source"}


@dataclass(frozen=True)
class Connector:
    """One source: ``read`` gives its raw rows, ``normalise`` the typed frame with ``key`` and the compared columns.

    ``restate`` applies today's rules to an older frame, so that a new rule is never news. ``required`` columns are
    gated on missing values. ``incremental`` sources deliver a window, in which an absent row means nothing.
    """

    source_id: str
    licence_id: str
    read: Callable[[SparkSession, str], DataFrame]
    normalise: Callable[[DataFrame], DataFrame]
    key: str
    state: str
    raw_state: str
    amount: str
    date: str
    restate: Callable[[DataFrame], DataFrame] = lambda df: df
    removal: str = "removed"
    incremental: bool = False
    restricted: bool = False
    required: Sequence[str] = ()

    @property
    def digest(self) -> str:
        """A version of the rules: it changes with the code of the two functions."""
        return hashlib.sha1("".join(inspect.getsource(f) for f in (self.normalise, self.restate)).encode()).hexdigest()[:12]


@dataclass
class Sources:
    """The registry: connectors by id, with the facts that the manifest states about each."""

    connectors: dict[str, Connector] = field(default_factory=dict)
    facts: dict[str, Mapping] = field(default_factory=dict)

    def add(self, connector: Connector, **facts: object) -> Connector:
        if connector.source_id in self.connectors:
            raise ValueError(f"source {connector.source_id} is registered twice")
        self.connectors[connector.source_id] = connector
        self.facts[connector.source_id] = facts
        return connector

    def with_manifest(self, text: str) -> Sources:
        """Facts of a JSON manifest (source id -> facts); a source that is not registered is an error."""
        for source_id, facts in json.loads(text).items():
            if source_id not in self.connectors:
                raise ValueError(f"the manifest names an unknown source {source_id}")
            self.facts[source_id] = {**self.facts[source_id], **facts}
        return self

    def frame(self, spark: SparkSession) -> DataFrame:
        """(source_id, licence_id, incremental, restricted, facts): one row a source, as a dimension."""
        rows = [(c.source_id, c.licence_id, c.incremental, c.restricted, {k: str(v) for k, v in self.facts[s].items()}) for s, c in sorted(self.connectors.items())]
        return spark.createDataFrame(rows, "source_id string, licence_id string, incremental boolean, restricted boolean, facts map<string,string>")


def fetch_window(watermark: datetime | None, now: datetime, overlap: timedelta, most: timedelta) -> tuple[datetime, datetime]:
    """The window an incremental run reads: from the watermark less the overlap, and at most ``most`` long."""
    start = max((watermark or now - most) - overlap, now - most) if watermark is None else watermark - overlap
    return start, min(now, start + most)


def upserted(previous: DataFrame | None, window: DataFrame, key: str) -> DataFrame:
    """A window's rows over the previous frame; what the window lacks stays."""
    return window if previous is None else previous.join(window.select(key), key, "left_anti").unionByName(window, allowMissingColumns=True)


def removal_event(meaning: str | None, announce: bool = True) -> str | None:
    """The event type of a vanished row, None where nothing is to be said."""
    return REMOVALS.get(meaning or "") if announce else None


def digest_of(df: DataFrame) -> str:
    """A digest of all rows that does not depend on their order: sums of two hashes and the count."""
    row = F.struct(*df.columns)
    hashed = df.select(F.xxhash64(row).alias("a"), F.xxhash64(F.lit(1), row).alias("b"))
    r = hashed.agg(F.count(F.lit(1)), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
    return f"{r[0]}:{r[1]}:{r[2]}"


def gate(previous: DataFrame | None, frame: DataFrame, connector: Connector) -> dict[str, str]:
    """Verdicts of a run's gates: repeated keys, row drift, missing values and, against the previous frame, churn."""
    missing = [F.avg(F.col(c).isNull().cast("double")).alias(f"m{i}") for i, c in enumerate(connector.required)]
    row = frame.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(connector.key).alias("k"), *missing).first()
    out = {"duplicates": "pass" if row["n"] == row["k"] else "hold", "empty": "hold" if not row["n"] and not connector.incremental else "pass"}
    out |= {f"missing {c}": "hold" if (row[f"m{i}"] or 0) > 0.5 else "pass" for i, c in enumerate(connector.required)}
    if previous is not None:
        before = previous.count()
        move = abs(row["n"] - before) / before if before else 0.0
        small = max(row["n"], before) < 10  # too few to judge
        out["rows"] = "pass" if small else "hold" if move > 0.3 else "warn" if move >= 0.1 else "pass"
        out["churn"] = "hold" if cd.churn(previous, frame, connector.key, connector.state).first()["verdict"] == "hold" else "pass"
        out["schema"] = "pass" if set(previous.columns) == set(frame.columns) else "warn"
    return out


def run(store: Store, connector: Connector, ts: str, path: str, allow_restricted: bool = False) -> dict[str, object]:
    """One run: read, compare with the last digest, normalise, restate what was there, gate, diff and write.

    An unchanged delivery under unchanged rules ends early with status ``unchanged``. A gate on hold writes the frame
    under status ``held`` and no events; ``Store.release`` promotes it later. Restricted sources go to a tree of their
    own (``quarantine``) and only if allowed. The status is written last, so a run that stops half way never counts.
    """
    if connector.restricted and not allow_restricted:
        raise PermissionError(f"{connector.source_id} is restricted")
    spark = store.spark
    target = Store(spark, f"{store.root}/quarantine") if connector.restricted else store
    raw = connector.read(spark, path)
    digest = f"{connector.digest}|{digest_of(raw)}"
    last = target.last_promoted(connector.source_id, ts)
    if last and target.digest(connector.source_id, last) == digest:
        target.write_status(connector.source_id, ts, "unchanged", digest)
        return {"status": "unchanged", "events": 0}
    frame = stamped(connector.normalise(raw), connector.source_id, connector.key, path, connector.licence_id, F.lit(ts))
    previous = connector.restate(target.read(connector.source_id, last)) if last else None
    if connector.incremental:
        frame = upserted(previous, frame, connector.key)
    verdicts = gate(previous, frame, connector)
    if "hold" in verdicts.values():
        target.write(connector.source_id, ts, frame, None, "held", digest)
        return {"status": "held", "events": 0, "verdicts": verdicts}
    events = None
    if previous is not None:
        events = cd.diff_events(previous, frame, connector.key, connector.state, connector.raw_state, connector.amount, connector.date)
        gone = removal_event(connector.removal, not connector.incremental)
        renamed = F.when(F.col("event_type") == "removed", gone).otherwise(F.col("event_type"))
        events = events.withColumn("event_type", renamed).where("event_type is not null")
    target.write(connector.source_id, ts, frame, events, "promoted", digest)
    written = target.events(connector.source_id, ts).count() if events is not None else 0
    return {"status": "promoted", "events": written, "verdicts": verdicts}


@dataclass(frozen=True)
class Objects:
    """Objects under a root on any file system that Spark reaches; what is once written stays as it is."""

    spark: SparkSession
    root: str

    def _at(self, name: str):  # noqa: ANN202
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def put(self, name: str, content: bytes) -> None:
        """Write a new object; an existing one is an error."""
        fs, path = self._at(name)
        out = fs.create(path, False)
        try:
            out.write(bytearray(content))
        finally:
            out.close()

    def get(self, name: str) -> bytes:
        return bytes(self.spark.read.format("binaryFile").load(f"{self.root}/{name}").select("content").first()[0])

    def names(self, prefix: str = "") -> list[str]:
        """Names below a folder, ascending."""
        fs, path = self._at(prefix)
        if not fs.exists(path):
            return []
        base, found, files = self._at("")[1].toUri().getPath().rstrip("/"), [], fs.listFiles(path, True)
        while files.hasNext():
            found.append(files.next().getPath().toUri().getPath()[len(base) + 1 :])
        return sorted(n for n in found if not n.rsplit("/", 1)[-1].startswith("."))


def projected(df: DataFrame, columns: Mapping[str, Column | Sequence[str]], source: str) -> DataFrame:
    """A source's rows in canonical columns: an expression, or the first of some columns that states a value."""
    first = lambda names: F.coalesce(*[F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names])
    return df.select(F.lit(source).alias("source"), *[(c if isinstance(c, Column) else first(c)).alias(n) for n, c in columns.items()])


def united(*frames: DataFrame) -> DataFrame:
    """All sources in one frame; a column that a source lacks is null there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
