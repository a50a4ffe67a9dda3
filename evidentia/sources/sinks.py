"""Where results go: JSON reports, the response cache, and the quarantine of texts that could not be read."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def write_reports(reports: DataFrame, path: str) -> None:
    """One JSON document a row."""
    reports.write.mode("overwrite").json(path)


def append_cache(entries: DataFrame, path: str) -> None:
    """New cache entries (key, value, ts, ttl), appended under their key's first two characters; the newest entry of a key counts."""
    entries.withColumn("shard", F.substring("key", 1, 2)).write.mode("append").partitionBy("shard").parquet(path)


def write_cost_report(report: DataFrame, path: str, kind: str = "json") -> None:
    """The cost report as JSON or text."""
    if kind not in ("json", "text"):
        raise ValueError(f"unsupported format: {kind}")
    report.select("report" if kind == "json" else "text").write.mode("overwrite").text(path)


def quarantine(checked: DataFrame, path: str) -> None:
    checked.filter("quarantined IS NOT NULL").write.mode("append").parquet(path)
