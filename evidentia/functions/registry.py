"""The callable tools by name: each turns section or instruction tables into findings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evidentia.operators import detect, inventory, scan


def _constants(spark: SparkSession, facts: dict[str, DataFrame]) -> DataFrame:
    return scan.signature_scan(facts["section"], scan.signature_table(spark))


TOOLS: dict[str, tuple[str, Callable[[SparkSession, dict[str, DataFrame]], DataFrame]]] = {
    "metadata": ("hashes and size of each file", lambda spark, f: inventory.file_metadata(f["binary"])),
    "strings": ("keyword strings", lambda spark, f: scan.interesting_strings(f["section"])),
    "constants": ("known constants", _constants),
    "functions": ("functions worth a look", lambda spark, f: inventory.extract_functions(f["func"])),
    "patterns": ("arithmetic patterns of functions", lambda spark, f: detect.arx_operations(detect.function_counts(f["insn"]))),
    "dataflow": ("operation mixing of functions", lambda spark, f: detect.data_mixing(detect.function_counts(f["insn"]))),
    "groups": ("clusters of functions", lambda spark, f: inventory.function_clusters(f["func"], f["call_edge"])),
}


def tool(name: str) -> Callable[[SparkSession, dict[str, DataFrame]], DataFrame]:
    if name not in TOOLS:
        raise KeyError(f"no tool named {name!r}; there are {', '.join(TOOLS)}")
    return TOOLS[name][1]
