"""Session settings and the shared folder for lineage cuts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: If false, tables dealt out by some of the keys of a join are joined as they are.
DEAL_BY_ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"
_TEST_DIR: str | None = None


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "basepaths") -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    A session on one machine may do without the setting and gets a temporary folder that goes
    when the process ends; on a cluster the setting is required, as executors could not read each other's files.
    """
    global _TEST_DIR
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _TEST_DIR is None:
        _TEST_DIR = tempfile.mkdtemp(prefix="basepaths-")
        atexit.register(shutil.rmtree, _TEST_DIR, ignore_errors=True)
    return _TEST_DIR


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, never used before."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """``values`` hold inside, the former ones after it."""
    before = {k: spark.conf.get(k) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def cut_lineage(df: DataFrame, drop_shuffles: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and continue from the written table.

    With ``drop_shuffles`` the shuffle files behind it go when it is written, not when the driver next collects garbage.
    """
    path = fresh_path(df.sparkSession, "cut")
    with settings(df.sparkSession, {DROP_SHUFFLES: "true"} if drop_shuffles else {}):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_by(df: DataFrame, key: str, tasks: int) -> DataFrame:
    """As ``cut_lineage`` for rows dealt out by ``key`` to ``tasks``: bucketed, so that Spark knows where a key's rows are."""
    table = f"cut_{uuid.uuid4().hex}"
    with settings(df.sparkSession, {DROP_SHUFFLES: "true"}):
        df.write.format("parquet").bucketBy(tasks, key).option("path", fresh_path(df.sparkSession, "cut")).saveAsTable(table)
    return df.sparkSession.table(table).select(*df.columns)
