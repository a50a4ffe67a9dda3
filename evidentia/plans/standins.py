"""Fact tables made from the driver tables, as DataFrames and as the same SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evidentia.session import table

MNEMONICS = ("xor", "add", "ror", "lsl", "mul", "ldr", "mov", "and", "orr", "sub", "eor", "udiv")
WORDS = ("0x6a09e667", "0xbb67ae85", "0x67452301", "0xefcdab89", "0x61707865", "0x3320646e")


def instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as instructions: supplier = function, part = opcode, line number = block."""
    rows = table(spark, sf_dir, "lineitem")
    word = F.get(F.array(*(F.lit(w) for w in WORDS)), (F.col("l_partkey") % 97).cast("int"))
    kind = F.col("l_partkey") % 12
    ops = F.when(word.isNotNull(), F.concat(F.lit("r0, "), word)).when(kind.isin(5, 6), F.lit("r1, [r2, #4]")).otherwise(F.concat(F.lit("r1, "), F.col("l_linenumber").cast("string")))
    return rows.select(
        (F.col("l_suppkey") % 10).alias("file_id"),
        F.col("l_suppkey").alias("func"),
        F.col("l_linenumber").cast("long").alias("block"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
        F.get(F.array(*(F.lit(m) for m in MNEMONICS)), kind.cast("int")).alias("mnemonic"),
        ops.alias("op_str"),
        (F.col("l_partkey") % 1000).alias("offset"),
    )


def loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select((F.col("l_suppkey") % 10).alias("file_id"), F.col("l_suppkey").alias("func"), (F.col("l_orderkey") % 3).alias("loop_id"), (F.col("l_orderkey") % (F.col("l_suppkey") % 19 + 2)).alias("block"))


def loop_insn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return instructions(spark, sf_dir).withColumn("block", F.expr("floor(ord / 10) % (func % 19 + 2)"))


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as functions: key = address, size = size, price = graph."""
    rows = table(spark, sf_dir, "part")
    return rows.select(
        (F.col("p_partkey") % 7).alias("file_id"),
        (F.col("p_partkey") * 100).alias("addr"),
        F.col("p_name").alias("name"),
        F.col("p_size").alias("size"),
        (F.col("p_size") % 9).alias("num_blocks"),
        F.when(F.col("p_size") % 13 == 0, None).otherwise(F.col("p_size") % 17).alias("edges"),
        (F.col("p_size") % 11).alias("nodes"),
        (F.col("p_partkey") % 23 == 0).alias("is_plt"),
        (F.col("p_partkey") % 29 == 0).alias("is_simproc"),
        (F.col("p_partkey") % 7 == 3).alias("is_blob"),
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as model calls: type = model, user = tokens."""
    rows = table(spark, sf_dir, "events")
    return rows.select(
        "event_id",
        "ts",
        F.col("event_type").alias("model"),
        F.when(F.col("event_type").isin("view", "click"), "p1").otherwise("p2").alias("provider"),
        (F.col("user_id") * 10).alias("input_tokens"),
        (F.col("user_id") * 3).alias("output_tokens"),
        F.col("user_id").cast("double").alias("duration_seconds"),
        (F.col("event_type") != "error").alias("success"),
        (F.col("user_id") % 50).cast("double").alias("cost"),
    )


_LIST = "[" + ", ".join(f"'{m}'" for m in MNEMONICS) + "]"
_WORDS = "[" + ", ".join(f"'{w}'" for w in WORDS) + "]"
SQL = f"""
insn AS (SELECT l_suppkey % 10 AS file_id, l_suppkey AS func, l_linenumber::BIGINT AS block, l_orderkey * 10 + l_linenumber AS ord, {_LIST}[l_partkey % 12 + 1] AS mnemonic,
  CASE WHEN l_partkey % 97 < 6 THEN 'r0, ' || {_WORDS}[l_partkey % 97 + 1] WHEN l_partkey % 12 IN (5, 6) THEN 'r1, [r2, #4]' ELSE 'r1, ' || l_linenumber::VARCHAR END AS op_str, l_partkey % 1000 AS o FROM lineitem),
loops AS (SELECT l_suppkey % 10 AS file_id, l_suppkey AS func, l_orderkey % 3 AS loop_id, l_orderkey % (l_suppkey % 19 + 2) AS block FROM lineitem),
lsize AS (SELECT file_id, func, loop_id, count(DISTINCT block) AS n_blocks FROM loops GROUP BY file_id, func, loop_id),
hot AS (SELECT file_id, func, loop_id, n_blocks FROM (SELECT *, row_number() OVER (PARTITION BY file_id, func ORDER BY n_blocks DESC, loop_id) AS rn FROM lsize) WHERE rn = 1),
linsn AS (SELECT i.* FROM (SELECT file_id, func, (ord // 10) % (func % 19 + 2) AS block, mnemonic, op_str FROM insn) i
  JOIN (SELECT DISTINCT l.file_id, l.func, l.block FROM loops l JOIN hot h USING (file_id, func, loop_id) WHERE h.n_blocks >= 2) b USING (file_id, func, block)),
counts AS (SELECT file_id, func, count(*) FILTER (mnemonic IN ('xor', 'eor')) AS x, sum(CASE WHEN mnemonic = 'ror' THEN 2 WHEN mnemonic = 'lsl' THEN 1 ELSE 0 END)::BIGINT AS r2,
  count(*) FILTER (mnemonic = 'add') AS a, count(*) FILTER (mnemonic IN ('ror', 'lsl')) AS rot, count(*) FILTER (mnemonic IN ('mov', 'ldr') AND contains(op_str, '[')) AS t,
  count(*) FILTER (o < 800 AND mnemonic = 'mul') AS mul, count(*) FILTER (o < 800 AND mnemonic = 'udiv') AS div, count(*) FILTER (o < 800 AND contains(op_str, 'x')) AS wide,
  count(*) FILTER (o < 500 AND mnemonic IN ('xor', 'eor')) AS n_xor, count(*) FILTER (o < 500 AND mnemonic = 'add') AS n_add, count(*) FILTER (o < 500 AND mnemonic = 'sub') AS n_sub,
  count(*) FILTER (o < 500 AND mnemonic = 'mul') AS n_mul, count(*) FILTER (o < 500 AND mnemonic = 'ror') AS n_rotate, count(*) FILTER (o < 500 AND mnemonic = 'lsl') AS n_shift,
  count(*) FILTER (o < 500 AND mnemonic = 'and') AS n_and, count(*) FILTER (o < 500 AND mnemonic = 'orr') AS n_or FROM insn GROUP BY ALL),
fn AS (SELECT p_partkey % 7 AS file_id, p_partkey * 100 AS addr, p_name AS name, p_size AS size, p_size % 9 AS num_blocks, CASE WHEN p_size % 13 = 0 THEN NULL ELSE p_size % 17 END AS edges, p_size % 11 AS nodes,
  p_partkey % 23 = 0 AS is_plt, p_partkey % 29 = 0 AS is_simproc, p_partkey % 7 = 3 AS is_blob FROM part),
calls AS (SELECT event_id, ts, event_type AS model, CASE WHEN event_type IN ('view', 'click') THEN 'p1' ELSE 'p2' END AS provider, user_id * 10 AS input_tokens, user_id * 3 AS output_tokens, user_id::DOUBLE AS duration_seconds, event_type <> 'error' AS success, (user_id % 50)::DOUBLE AS cost FROM events)
"""
