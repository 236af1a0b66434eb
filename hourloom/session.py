"""Session building and stage materialisation."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "hourloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library is tuned for; extra conf wins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_LOCAL_ROOTS: dict[str, str] = {}
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage_root(spark: SparkSession) -> str:
    """Shared folder for written stages: the one the cluster names, else (local only) a temp one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="hourloom-stages-")
    return _LOCAL_ROOTS[app]


@contextmanager
def _shuffles_dropped(spark: SparkSession):
    """What a write inside shuffles is deleted when the write ends, and not when the driver happens to collect its garbage."""
    was = spark.conf.get(_DROP_SHUFFLES, "false")
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(_DROP_SHUFFLES, was)


def materialize(df: DataFrame, name: str, partition_by=()) -> DataFrame:
    """Write a stage as parquet in the shared folder and read it back.

    Cuts lineage, survives lost executors, and gives later stages column pruning,
    filter pushdown and real sizes for the broadcast decision.
    """
    path = f"{stage_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    with _shuffles_dropped(df.sparkSession):
        writer.parquet(path)
    # A partition column is read back last; keep the given order.
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
