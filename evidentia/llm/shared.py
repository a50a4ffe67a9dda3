"""Shared storage and small helpers of the corpus operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evidentia.session import python_workers, table

__all__ = ["ascii_lower", "by_id", "cleanup", "dealt", "materialize", "new_folder", "partitions", "shared_root", "python_workers", "table", "tasks_for", "vocabulary", "WORD"]

#: Up to so many ids (8 bytes each) are broadcast to pick rows out; beyond it rows are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Small steps are dealt to so many tasks at least.
FEWEST = 8
#: A word: a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """This application's folder under ``spark.checkpoint.dir``. Where that is unset, a local master takes a temporary folder; a cluster must name one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/evidentia-{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own under the shared folder; nothing is created yet."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def cleanup(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application. Results that were not written yet are lost with them, so a job calls it last."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends there, and a lost executor costs nothing that was written."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file; the environment's TOKENIZERS_DIR may name another folder."""
    if folder := os.environ.get("TOKENIZERS_DIR"):
        return f"{folder}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


def partitions(spark: SparkSession) -> int:
    """How many partitions an explicit exchange uses: the session's own shuffle setting, which follows the input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def tasks_for(spark: SparkSession, rows: int, a_task: int = 50_000) -> int:
    """How many tasks ``rows`` rows are worth: the session's partitions at most, and FEWEST at least, where those partitions would be nearly empty."""
    return min(partitions(spark), max(FEWEST, rows // a_task))


def dealt(df: DataFrame, *keys) -> DataFrame:
    """``df`` hash-partitioned by ``keys`` into the session's number of shuffle partitions."""
    return df.repartition(partitions(df.sparkSession), *keys)


def by_id(rows: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    """The rows whose ``column`` is in ``ids``, a written table of that one column."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, column, "left_semi")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is. Pure ASCII texts take the fast built-in."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, lower))
