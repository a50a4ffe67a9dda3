"""From detections to named algorithms: evidence flags, scores, conflict resolution and suppression."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from evidentia.functions.classify import round_algorithm
from evidentia.session import written

CANDIDATE = ("file_id", "func", "algorithm", "confidence", "evidence", "category", "structure")


def evidence_flags(ratios: DataFrame) -> DataFrame:
    """(file_id, sbox, arx, hybrid): whether any loop's memory ratio speaks for tables, for arithmetic, or for neither."""
    r = F.col("memory_ratio")
    return ratios.groupBy("file_id").agg(F.bool_or(r > 0.25).alias("sbox"), F.bool_or(r < 0.15).alias("arx"), F.bool_or((r >= 0.15) & (r <= 0.25)).alias("hybrid"))


def candidates(found: dict[str, DataFrame]) -> DataFrame:
    """All candidate rows (CANDIDATE) from the detectors' tables, keyed feistel, arx, tables, loops, modular, hashes, ratios, magic.

    A file's flags are joined once to each detector's few rows; the union goes on without a shuffle.
    """
    flags = evidence_flags(found["ratios"])
    flags = flags.join(found["feistel"].select("file_id").distinct().withColumn("feistel", F.lit(True)), "file_id", "full_outer")
    flags = flags.join(found["magic"].select("file_id").distinct().withColumn("magic", F.lit(True)), "file_id", "full_outer")
    flags = written(flags.select("file_id", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("sbox", "arx", "hybrid", "feistel", "magic"))), "evidence-flags")

    def told(name: str, algorithm: Column, confidence: Column, evidence: Column, category: str, structure: Column | None = None) -> DataFrame:
        own = found[name].drop("sbox", "arx", "hybrid", "feistel", "magic").withColumnRenamed("confidence", "_confidence").withColumnRenamed("structure", "_structure")
        own = own.join(flags, "file_id", "left").fillna(False, ["sbox", "arx", "hybrid", "feistel", "magic"])
        shape = structure if structure is not None else F.lit(None).cast("string")
        flagged = [F.col(c) for c in ("sbox", "arx", "hybrid", "feistel", "magic")]
        return own.select("file_id", "func", algorithm.alias("algorithm"), confidence.cast("double").alias("confidence"), evidence.alias("evidence"), F.lit(category).alias("category"), shape.alias("structure"), *flagged)

    c = F.col
    raised = lambda x: F.when(c("sbox"), F.least(F.lit(0.98), x + 0.10)).otherwise(x)
    many = (c("xor_operations") >= 50) & ~c("feistel")
    arx = F.when(c("magic"), F.when(c("arx"), 0.90).otherwise(0.85)).when(many & c("arx"), 0.75).when(many & ~c("sbox"), 0.65)
    table = F.when(c("_confidence") == "high", 0.80).otherwise(0.65)
    table = F.when(c("feistel"), F.least(F.lit(0.95), table + 0.15)).otherwise(table)
    counts = F.format_string("ADD:%d, XOR:%d, ROT:%d", "add_operations", "xor_operations", "rotate_operations")
    parts = [
        told("feistel", F.lit("DES or Feistel-based cipher"), raised(c("_confidence")), F.concat(F.lit("Feistel structure: "), c("_structure")), "symmetric", F.lit("feistel")),
        told("arx", F.when(c("magic"), F.lit("ChaCha20/Salsa20")).otherwise(c("likely_algorithm")), arx, F.concat(F.when(c("magic"), "Magic constant + ARX (").otherwise("ARX ("), counts, F.lit(")")), "symmetric", F.lit("arx")).filter("confidence IS NOT NULL"),
        told("tables", F.when(c("feistel"), "DES").otherwise("AES or DES (S-box based cipher)"), raised(table), F.format_string("S-box pattern with %d table accesses", "table_accesses"), "symmetric", F.when(c("feistel"), "feistel").otherwise("spn")),
        told("loops", round_algorithm(c("potential_rounds"), c("feistel")), F.lit(0.70), F.format_string("Loop of ~%d rounds", "potential_rounds"), "symmetric"),
        told("modular", c("likely_algorithm"), c("_confidence"), F.format_string("Modular arithmetic (MUL:%d, DIV:%d, SHIFT:%d)", "multiplications", "divisions", "shifts"), "asymmetric"),
        told("hashes", c("algorithm"), F.lit(0.85), F.format_string("%d hash constants", "constant_count"), "hash"),
    ]
    return reduce(DataFrame.unionByName, parts)


def resolve(rows: DataFrame) -> DataFrame:
    """Settle tables against arithmetic by the memory ratio: drop or lower what it speaks against, raise what it confirms."""
    arx, sbox = F.col("arx") & ~F.col("hybrid"), F.col("sbox") & ~F.col("hybrid")
    shaped = F.coalesce(F.col("structure") == "arx", F.lit(False))
    c = F.col("confidence")
    kept = rows.filter(~(arx & F.col("algorithm").contains("S-box")))
    changed = F.when(arx & shaped, F.least(F.lit(0.95), c + 0.10)).when(~arx & sbox & shaped & ~F.col("magic"), F.greatest(F.lit(0.50), c - 0.20)).otherwise(c)
    return kept.withColumn("confidence", F.round(changed, 4))


def dominate(rows: DataFrame, by: str = "category", score: str = "confidence", file: str | None = "file_id", order=("algorithm", "func"), high: float = 0.90, also: float = 0.80) -> DataFrame:
    """Where a category's best score reaches ``high``, keep the best and those of at least ``also``; the category 'unknown' keeps all."""
    keys = [k for k in (file, by) if k]
    best = Window.partitionBy(*keys)
    ranked = rows.withColumn("_top", F.max(score).over(best)).withColumn("_rn", F.row_number().over(best.orderBy(F.desc(score), *order)))
    keep = (F.coalesce(F.col(by), F.lit("unknown")) == "unknown") | (F.col("_top") < high) | (F.col("_rn") == 1) | (F.col(score) >= also)
    return ranked.filter(keep).drop("_top", "_rn")


def inferred(found: dict[str, DataFrame]) -> DataFrame:
    """CANDIDATE rows after resolution and suppression; a file with nothing left but several table functions gets one binary-wide row."""
    rows = candidates(found)
    kept = written(dominate(resolve(rows)).select(*CANDIDATE), "candidates")
    tables = found["tables"].groupBy("file_id").agg(F.count("*").alias("n")).filter("n >= 2").join(kept.select("file_id").distinct(), "file_id", "left_anti")
    tables = tables.join(found["feistel"].select("file_id").distinct().withColumn("feistel", F.lit(True)), "file_id", "left")
    wide = tables.select(
        "file_id",
        F.lit(None).cast(kept.schema["func"].dataType).alias("func"),
        F.when(F.col("feistel"), "DES (inlined S-box implementation)").otherwise("AES (inlined/optimized S-box implementation)").alias("algorithm"),
        F.lit(0.80).alias("confidence"),
        F.format_string("S-box patterns in %d functions", "n").alias("evidence"),
        F.lit("symmetric").alias("category"),
        F.lit(None).cast("string").alias("structure"),
    )
    return kept.unionByName(wide)


def likelihood(xor: Column, rotation: Column, mixing: Column) -> Column:
    """The score of a file from its numbers of xor, rotation and mixing functions."""
    total = xor + rotation + mixing
    bonus = F.when(total >= 10, 0.3).when(total >= 5, 0.15).otherwise(0.0)
    return F.least(F.least(xor * 0.15, F.lit(0.4)) + F.least(rotation * 0.12, F.lit(0.3)) + F.least(mixing * 0.18, F.lit(0.4)) + bonus, F.lit(1.0))


def aggregate_score(base: Column, patterns: Column, groups: Column, largest: Column) -> Column:
    """``base`` raised by large groups, many patterns, and patterns over several groups."""
    large = F.when(largest >= 10, 0.25).when(largest >= 5, 0.15).otherwise(0.0)
    many = F.when(patterns >= 15, 0.20).when(patterns >= 10, 0.10).otherwise(0.0)
    spread = F.when((groups >= 5) & (patterns >= 5), 0.15).otherwise(0.0)
    return F.least(base + large + many + spread, F.lit(1.0))


def merged(rows: DataFrame, family: Column, name: str = "algorithm", score: str = "confidence", evidence: str = "evidence", by: str = "file_id") -> DataFrame:
    """One row a family: the longest name (then the best score), the best score, and all evidence."""
    named = rows.withColumn("_family", family)
    out = named.groupBy(by, "_family").agg(F.max_by(name, F.struct(F.length(name), score, name)).alias(name), F.max(score).alias(score), F.array_join(F.array_sort(F.collect_set(evidence)), "; ").alias(evidence), F.count("*").alias("n_merged"))
    return out.withColumnRenamed("_family", "family")
