"""Spark session helpers.

``get_spark`` is for tests and local runs only.  On a cluster the caller
owns the session; library code never sets cluster knobs itself except the
checkpoint folder when the session has none (``ensure_checkpoint_dir``).
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_spark(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "specsift") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SPECSIFT_DRIVER_MEMORY", "16g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.pythonUDF.arrow.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for written intermediate tables (``spark.checkpoint.dir``).

    A session on a local master without one gets a fresh scratch folder (the
    only machine is this one).  On any other master a folder of one machine
    would lose rows, so a missing setting is an error.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(current)
        return current
    sc_dir = spark.sparkContext.getCheckpointDir()
    if sc_dir:
        return sc_dir
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="specsift-ckpt-")
    spark.sparkContext.setCheckpointDir(path)
    try:
        spark.conf.set("spark.checkpoint.dir", path)
    except Exception:  # noqa: BLE001 - some sessions reject core keys at runtime
        pass
    return spark.sparkContext.getCheckpointDir() or path


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside delete their shuffle files when they end, not
    when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def write_stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and read it back.

    Cuts the lineage in a way that survives lost executors, and computes
    ``df`` once (a reliable ``checkpoint()`` computes it twice).  The shuffle
    files of the write go with it: nothing reads them again.
    """
    return write_stages([df], name)


def write_stages(parts: Iterable[DataFrame], name: str) -> DataFrame:
    """``write_stage`` of the rows of all ``parts`` (at least one, of one schema),
    one after the other: each has its shuffle files alone."""
    path, schema = None, None
    for df in parts:
        spark = df.sparkSession
        if path is None:
            root = ensure_checkpoint_dir(spark).rstrip("/")
            path, schema = f"{root}/specsift-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}", df.schema
        with shuffles_deleted(spark):
            df.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def clear_stages(spark: SparkSession) -> None:
    """Delete what ``write_stage`` wrote in this application (results that
    still read those tables are lost with them)."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/specsift-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make the package importable in executor Python workers, whatever their
    working directory: zip it once per application and ``addPyFile`` it."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="specsift-pkg-"), "specsift.zip")
    with zipfile.ZipFile(path, "w") as z:
        for root, _, files in os.walk(here):
            for fn in files:
                if fn.endswith(".py"):
                    full = os.path.join(root, fn)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
