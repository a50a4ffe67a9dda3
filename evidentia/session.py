"""One place that builds a SparkSession with the settings the transforms rely on."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F


def session(app: str = "evidentia", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``master`` stays the cluster's own unless given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str):
    """A driver table; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, rows: int, key: str) -> DataFrame:
    """``df``, a table as read, dealt out by ``key`` if one of its tasks has more than ``rows`` rows and over twice an even share of the cores.

    A file of one row group is one task, however large. Only the numbers of rows are read for this.
    """
    n, most = df.groupBy(F.spark_partition_id()).count().agg(F.sum("count"), F.max("count")).first()
    cores = df.sparkSession.sparkContext.defaultParallelism
    if not n or most <= rows or most * cores <= 2 * n:
        return df
    return df.repartition(max(cores, n // rows), key)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below ``spark.checkpoint.dir``.

    Where that setting is unset, a local master takes a temporary folder; a cluster must name one that the driver and all executors share.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/evidentia-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a shared folder and read again: it is computed once, lineage ends there, and a lost executor costs nothing of it."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def python_workers(spark: SparkSession, rows: int = 256) -> None:
    """Set this session up for Python in tasks: Arrow batches of at most ``rows`` rows, so that a task's memory follows a few texts and not
    thousands, and this library on the workers' path, where it is not installed."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    root = str(Path(__file__).resolve().parents[1])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (known, root) if x)
