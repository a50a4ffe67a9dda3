"""Blobs, their sections, and the tables of facts that the detectors read."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evidentia.session import python_workers

SCHEMAS = {
    "binary": "file_id long, filename string, content binary, os string, arch string, entry long, bits int, endian string, error string",
    "section": "file_id long, name string, vaddr long, memsize long, file_offset long, size long, data binary",
    "func": "file_id long, addr long, name string, size int, num_blocks int, edges int, nodes int, is_plt boolean, is_simproc boolean, is_blob boolean",
    "loop": "file_id long, func long, loop_id int, block long",
    "insn": "file_id long, func long, block long, ord int, mnemonic string, op_str string, offset long, block_offset long",
    "call_edge": "file_id long, src long, dst long",
}
#: Architectures tried in this order for a blob without a header.
BLOB_ARCHITECTURES = ("x86_64", "i386", "arm", "aarch64", "mips")
_MACHINES = {3: "i386", 8: "mips", 40: "arm", 62: "x86_64", 183: "aarch64", 243: "riscv"}


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(file_id, filename, content) of the files under ``path``; empty ones are left out. file_id is a hash of the path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.filter("length > 0").select(F.xxhash64("path").alias("file_id"), F.element_at(F.split("path", "/"), -1).alias("filename"), "content")


def read_facts(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One fact table, with its fixed schema."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{path}/{name}.parquet")


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """(key, setting struct) of a JSON file that maps names to settings under ``models``."""
    setting = "provider: string, model: string, cost_per_1k_input_tokens: double, cost_per_1k_output_tokens: double, temperature: double, max_tokens: int, timeout_seconds: int, max_retries: int"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"models map<string, struct<{setting}>>").alias("s"))
    return raw.select(F.explode("s.models").alias("key", "setting"))


def read_prompt(spark: SparkSession, path: str, default: str) -> DataFrame:
    """One row, text: a file's whole text, or ``default`` where it has none."""
    rows = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"))
    return rows.select(F.when(F.trim("text") == "", F.lit(default)).otherwise(F.col("text")).alias("text"))


def header(content: Column) -> Column:
    """struct(os, arch, bits, endian, entry) from an ELF header; a blob has os 'unknown' and the first of BLOB_ARCHITECTURES."""
    h = F.hex(F.substring(content, 1, 32))
    at = lambda i, n: F.substring(h, 2 * i + 1, 2 * n)
    elf, wide, little = at(0, 4) == "7F454C46", at(4, 1) == "02", at(5, 1) == "01"

    def number(i: int, n: int) -> Column:
        swapped = F.concat(*(at(i + k, 1) for k in reversed(range(n))))
        return F.conv(F.when(little, swapped).otherwise(at(i, n)), 16, 10).cast("long")

    machine = F.try_element_at(F.create_map(*(F.lit(x) for kv in _MACHINES.items() for x in kv)), number(18, 2).cast("int"))
    return F.struct(
        F.when(elf, "unix").otherwise("unknown").alias("os"),
        F.coalesce(F.when(elf, machine), F.lit(BLOB_ARCHITECTURES[0])).alias("arch"),
        F.when(elf & ~wide, 32).otherwise(64).alias("bits"),
        F.when(elf & ~little, "BE").otherwise("LE").alias("endian"),
        F.when(elf, F.when(wide, number(24, 8)).otherwise(number(24, 4))).otherwise(F.lit(0)).alias("entry"),
    )


def elf_sections(data: bytes) -> list[tuple[str, int, int, int, int]]:
    """(name, vaddr, memsize, file offset, size) of an ELF file's sections; [] where there is no readable table."""
    if data[:4] != b"\x7fELF" or len(data) < 64:
        return []
    wide, order = data[4] == 2, "<" if data[5] == 1 else ">"
    try:
        table, step, count, names = (struct.unpack_from(order + "Q", data, 40)[0], *struct.unpack_from(order + "HHH", data, 58)) if wide else (struct.unpack_from(order + "I", data, 32)[0], *struct.unpack_from(order + "HHH", data, 46))
        heads = []
        for i in range(count):
            at = table + i * step
            name, kind = struct.unpack_from(order + "II", data, at)
            addr, offset, size = struct.unpack_from(order + "QQQ", data, at + 16) if wide else struct.unpack_from(order + "III", data, at + 12)
            heads.append((name, kind, addr, offset, size))
        base = heads[names][3]
        return [(data[base + n : data.index(b"\0", base + n)].decode("latin-1"), a, s, o, 0 if k == 8 else s) for n, k, a, o, s in heads if k]
    except (struct.error, IndexError, ValueError):
        return []


def sections(files: DataFrame) -> DataFrame:
    """The section table of ``files`` (file_id, content): an ELF file's own sections, else the whole blob as one section at 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, content in zip(pdf["file_id"], pdf["content"], strict=True):
                found = elf_sections(content) or [(".blob.data", 0, len(content), 0, len(content))]
                rows += [(i, n, a, m, o, s, bytes(content[o : o + s])) for n, a, m, o, s in found]
            yield pd.DataFrame(rows, columns=["file_id", "name", "vaddr", "memsize", "file_offset", "size", "data"])

    python_workers(files.sparkSession, 16)
    return files.select("file_id", "content").mapInPandas(run, SCHEMAS["section"])
