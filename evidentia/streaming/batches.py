"""Micro-batches that count once: each is one folder of a table, named by its batch id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery


def store_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """Write one micro-batch as ``path``/batch=<id>. A batch that is run again replaces its own folder, so a rerun changes nothing."""
    batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")


def start_batches(stream: DataFrame, path: str, checkpoint: str, change: Callable[[DataFrame], DataFrame] = lambda df: df, trigger: dict | None = None) -> StreamingQuery:
    """Run ``stream`` to its end (or by ``trigger``), each micro-batch passed through ``change`` and stored exactly once in the table at ``path``.

    Spark may hand out a batch more than once, with the same id and the same rows; ``change`` must give the same rows for the same input.
    """
    # A name of the library's alone: the function runs on the driver, and on a remote session is pickled with what it names.
    writer = stream.writeStream.foreachBatch(lambda df, batch_id: store_batch(change(df), batch_id, path))
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def partial_totals(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, n_rows, total): additive parts of one batch, the sum exact to four decimals."""
    return rows.groupBy(*by).agg(F.count("*").alias("n_rows"), F.sum(F.col(value).cast("decimal(18,4)")).alias("total"))


def merged_totals(parts: DataFrame, by: list[str]) -> DataFrame:
    """The totals of all stored batches, and how many batches had a part in them."""
    return parts.groupBy(*by).agg(F.sum("n_rows").alias("n_rows"), F.sum("total").cast("double").alias("total"))
