"""Snapshot store, provenance, and the readers and writers of its formats."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PROVENANCE = ("source_id", "source_url", "retrieved_at", "licence_id")


def stamped(rows: DataFrame, source_id: str, key: str, source_url: str, licence_id: str, retrieved_at: Column) -> DataFrame:
    """``rows`` with the four provenance columns, record_id (source:key) and the row as JSON in ``raw``.

    Keys are trimmed; a null or blank key fails the run, since such a row could never be followed.
    """
    trimmed = F.trim(F.col(key).cast("string"))
    checked = F.when(F.coalesce(trimmed, F.lit("")) == "", F.raise_error(F.lit(f"{source_id}: a row has no {key}")).cast("string")).otherwise(trimmed)
    raw = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    return rows.withColumn("raw", raw).withColumns({
        "source_record_id": checked, "record_id": F.concat(F.lit(f"{source_id}:"), checked), "source_id": F.lit(source_id), "source_url": F.lit(source_url),
        "licence_id": F.lit(licence_id), "retrieved_at": retrieved_at,
    })


def six_figures(value: Column) -> Column:
    """A number as text with six significant figures, so that 100, 100.0 and '100.00' agree; other texts as they are."""
    number = value.cast("string").try_cast("double")
    scale = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(number))) - 5)
    rounded = F.when(number == 0, F.lit(0.0)).otherwise(F.round(number / scale) * scale)
    plain = F.regexp_replace(F.format_string("%.6e", rounded), r"0+e", "e")
    return F.when(number.isNotNull() & ~F.isnan(number), plain).otherwise(value.cast("string"))


def content_hash(columns: Sequence[str], numbers: Sequence[str] = ()) -> Column:
    """A stable id from identifying columns; null and empty differ, ``numbers`` count at six significant figures."""
    text = lambda c: six_figures(F.col(c)) if c in numbers else F.col(c).cast("string")
    return F.sha1(F.concat_ws("\u001f", *[F.coalesce(text(c), F.lit("\u0000")) for c in columns]))


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for sinks that hold scalars only."""
    return df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes])


@dataclass(frozen=True)
class Store:
    """Runs of each source under ``root``/kind/source_id=…/ts=…; a run counts once its status row is written."""

    spark: SparkSession
    root: str

    def write(self, source_id: str, ts: str, frame: DataFrame, events: DataFrame | None = None, status: str = "promoted", digest: str = "") -> None:
        """Data first and the status row last, so a run that stops half way is never read."""
        for kind, df in (("normalized", frame), ("events", events)):
            if df is not None:
                df.write.mode("overwrite").parquet(f"{self.root}/{kind}/source_id={source_id}/ts={ts}")
        self.write_status(source_id, ts, status, digest)

    def runs(self) -> DataFrame:
        schema = "status string, digest string, source_id string, ts string"
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/runs")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.option("basePath", f"{self.root}/runs").schema(schema).parquet(f"{self.root}/runs")

    def last_promoted(self, source_id: str, before: str | None = None) -> str | None:
        """Newest promoted run, of those before ``before`` if that is given; one row comes back."""
        return latest_promoted(self.runs().where(F.col("source_id") == source_id), before).agg(F.max("ts")).first()[0]

    def digest(self, source_id: str, ts: str) -> str | None:
        row = self.runs().where((F.col("source_id") == source_id) & (F.col("ts") == ts)).select("digest").first()
        return row[0] if row else None

    def events(self, source_id: str, ts: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/events/source_id={source_id}/ts={ts}")

    def to_load(self, source_id: str, after: str | None) -> list[str]:
        """Promoted runs since the last loaded one, oldest first."""
        runs = self.runs().where((F.col("source_id") == source_id) & (F.col("status") == "promoted"))
        return [r[0] for r in (runs.where(F.col("ts") > after) if after else runs).select("ts").orderBy("ts").collect()]

    def read(self, source_id: str, ts: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/normalized/source_id={source_id}/ts={ts}")

    def previous(self, source_id: str, ts: str) -> DataFrame | None:
        """The frame as it stood before ``ts``."""
        last = self.last_promoted(source_id, ts)
        return self.read(source_id, last) if last else None

    def release(self, source_id: str, ts: str) -> None:
        """Promote a held run."""
        self.write_status(source_id, ts, "promoted")

    def write_status(self, source_id: str, ts: str, status: str, digest: str = "") -> None:
        self.spark.createDataFrame([(status, digest)], "status string, digest string").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/runs/source_id={source_id}/ts={ts}")


def latest_promoted(runs: DataFrame, before: object | None = None) -> DataFrame:
    """(source_id, ts): the newest promoted run of each source, of those before ``before`` if that is given."""
    good = runs.where(F.col("status") == "promoted")
    return (good.where(F.col("ts") < F.lit(before)) if before is not None else good).groupBy("source_id").agg(F.max("ts").alias("ts"))


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",", null: str = "", encoding: str = "UTF-8") -> DataFrame:
    """Delimited text with a header and a stated schema; nothing is inferred, malformed rows become nulls."""
    return spark.read.csv(path, schema=schema, header=True, sep=sep, nullValue=null, encoding=encoding, mode="PERMISSIVE", multiLine=True, escape='"')


def read_rates(spark: SparkSession, path: str) -> DataFrame:
    """(rate_date, currency, per_euro) from a wide rate file: one column a currency, ``N/A`` and non-positive left out."""
    wide = spark.read.csv(path, header=True, nullValue="N/A")
    currencies = [c for c in wide.columns if c.strip() not in ("Date", "") and not c.startswith("_c")]
    texts = wide.select(F.col("Date"), *[F.col(f"`{c}`").cast("string").alias(c.strip()) for c in currencies])
    long = texts.unpivot(["Date"], [c.strip() for c in currencies], "currency", "rate")
    out = long.select(F.col("Date").try_cast("date").alias("rate_date"), "currency", F.col("rate").try_cast("double").alias("per_euro"))
    return out.where("per_euro > 0 and rate_date is not null")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(file, payload) of JSON responses, one a file; see ``operators.shred`` for what is in them."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("payload"))


def write_by_month(df: DataFrame, path: str, at: str) -> None:
    """Partition by source and UTC month; only the months written are replaced. Rows of a month go to few files."""
    monthly = df.withColumn("month", F.date_format(at, "yyyy-MM"))
    monthly.repartition("source_id", "month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_id", "month").parquet(path)


def write_csv(df: DataFrame, path: str, columns: Sequence[str], order: Sequence[str], most: int) -> None:
    """An ordered export of chosen columns, at most ``most`` rows."""
    flat(df.select(*columns)).orderBy(*order).limit(most).coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_ndjson(df: DataFrame, path: str) -> None:
    """One JSON object a line, nulls kept."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def features(df: DataFrame, lon: str, lat: str, properties: Sequence[str]) -> DataFrame:
    """One GeoJSON feature a row; rows without a position have a null geometry."""
    point = F.when(F.col(lon).isNotNull() & F.col(lat).isNotNull(), F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")))
    feature = F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*properties).alias("properties"))
    return df.select(F.to_json(feature, {"ignoreNullFields": "false"}).alias("value"))


def write_clustered(df: DataFrame, path: str, lon: str, lat: str) -> None:
    """Rows in curve order, so row groups cover small areas and their min/max statistics prune box filters."""
    from gridloom.operators.spatial import cell_xy, morton, wrap_longitude

    x, y = cell_xy(wrap_longitude(F.col(lon)), F.col(lat))
    keyed = df.withColumns({"_x": x, "_y": y}).withColumn("_z", morton(F.col("_x"), F.col("_y"))).drop("_x", "_y")
    keyed.repartitionByRange("_z").sortWithinPartitions("_z").drop("_z").write.mode("overwrite").parquet(path)
