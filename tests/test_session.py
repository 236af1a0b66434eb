from __future__ import annotations

import time
from types import SimpleNamespace

import pytest

from hourloom import session


def fake(master, configured=None):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default=None: configured or default),
        sparkContext=SimpleNamespace(master=master, applicationId=f"app-{master}"),
    )


def test_the_folder_the_cluster_names_is_used():
    assert session.stage_root(fake("spark://host:7077", "hdfs://shared/ck/")) == "hdfs://shared/ck"


def test_only_a_local_session_falls_back_to_a_temporary_folder():
    assert session.stage_root(fake("local[2]")) == session.stage_root(fake("local[2]"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.stage_root(fake("yarn"))


def test_a_stage_survives_and_keeps_its_columns(spark):
    df = spark.range(10).selectExpr("id", "id % 3 AS k", "TIMESTAMP_NTZ '2016-01-01 00:00:00' AS ts")
    stored = session.materialize(df, "t-stage", ["k"])
    # Names, order and types hold; a file source makes every column nullable.
    assert stored.dtypes == df.dtypes and stored.count() == 10
    assert "PartitionFilters: [isnotnull(k" in stored.where("k = 1")._jdf.queryExecution().toString()


def test_a_written_stage_leaves_no_shuffle_files(spark):
    """they stayed until the driver collected its garbage, and added up over the stages of a query."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: set(disk.getAllFiles().mkString("\n").split())
    before = files()
    session.materialize(spark.range(1000).repartition(3, "id"), "t-shuffled")
    until = time.time() + 20
    while (left := [f for f in files() - before if "/shuffle_" in f]) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert spark.conf.get(session._DROP_SHUFFLES) == "false"
