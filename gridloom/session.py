"""Session settings and lineage cuts shared by every operator."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "gridloom", master: str = "local[*]", **conf: object) -> SparkSession:
    """A session with UTC time, AQE and Arrow; ``conf`` overrides any setting (``_`` stands for ``.``)."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("_", "."): str(v) for k, v in conf.items()}
    builder = SparkSession.builder.master(master).appName(app)
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where it is unset a temporary one, on a single machine only."""
    root = spark.conf.get(CHECKPOINT_KEY, None)
    if not root:
        current = spark.sparkContext.getCheckpointDir()
        if current:
            return current
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set(CHECKPOINT_KEY, root)
    return root


def materialise(df: DataFrame, label: str = "step", partitions: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` to the shared folder, in folders by ``partitions`` if that is given, and read it back.

    This cuts the lineage, so a lost executor costs one re-read and no recomputation, and gives the optimiser the
    true size of the intermediate result. Files are replicated and kept as the shared file system keeps them.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").partitionBy(*partitions).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._gridloom_path = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete the files of ``materialise`` results that nothing reads any more; other frames are left alone."""
    for df in frames:
        path = getattr(df, "_gridloom_path", None)
        if path:
            hadoop = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(hadoop, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the test data: a file or a folder of Parquet parts."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
