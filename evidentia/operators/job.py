"""The whole analysis as one job: triage, detection, functions, weaknesses, protocols, score and one row for every file."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from evidentia.operators import detect, infer, inventory, report
from evidentia.session import written

#: Numbers that the detectors of constants look for in operands.
WORDS = (*dict.fromkeys(w for ws in detect.HASH_WORDS.values() for w in ws), *detect.MAGIC_WORDS)
ROUTES = ("deep", "quick", "skip")
STAGES = 7


def most_blocks(insn: DataFrame, top: int) -> DataFrame:
    """(file_id, func) of the ``top`` functions with most blocks of each file; ties go to the smaller address."""
    blocks = insn.groupBy("file_id", "func").agg(F.count_distinct("block").alias("n_blocks"))
    return inventory.capped(blocks, top, [F.desc("n_blocks"), F.col("func")]).select("file_id", "func")


def found_patterns(insn: DataFrame, loops: DataFrame, loop_insn: DataFrame, top: int | None = None) -> dict[str, DataFrame]:
    """The tables of all detectors, as the inference takes them; ``top`` keeps the functions of ``most_blocks``.

    Only one row a function is ranked; the instructions follow by a semi-join.
    """
    if top is not None:
        most = most_blocks(insn, top)
        insn, loops, loop_insn = (rows.join(most, ["file_id", "func"], "left_semi") for rows in (insn, loops, loop_insn))
    counts, blocks, hot = facts(insn, loops, loop_insn)
    return {
        "feistel": detect.feistel_networks(hot),
        "arx": detect.arx_operations(counts),
        "tables": detect.table_lookups(counts),
        "loops": detect.round_loops(blocks),
        "modular": detect.modular_arithmetic(counts),
        "hashes": detect.hash_constants(counts),
        "ratios": detect.memory_ratios(hot).filter("total_instructions >= 20"),
        "magic": detect.magic_constants(counts),
    }


def facts(insn: DataFrame, loops: DataFrame, loop_insn: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What all detectors need, written once: counts and dictionary words of each function, the blocks of each loop, counts over each hottest loop.

    Each source is read once, whatever the number of detectors.
    """
    counts = written(detect.function_counts(insn, words=WORDS, lists=False), "function-counts")
    blocks = written(detect.loop_blocks(loops), "loop-blocks")
    return counts, blocks, written(detect.loop_counts(detect.loop_instructions(loop_insn, blocks)), "loop-counts")


def routes(files: DataFrame, strings: DataFrame, force_deep: bool = False) -> DataFrame:
    """(file_id, route) of every file: the deepest route that any of its strings asks for; a file without strings is skipped."""
    if force_deep:
        return files.select("file_id").distinct().withColumn("route", F.lit("deep"))
    rank = F.array_position(F.array(*(F.lit(r) for r in ROUTES)), report.triage(F.col("string")))
    best = strings.groupBy("file_id").agg(F.min(rank).cast("int").alias("rank"))
    chosen = F.get(F.array(*(F.lit(r) for r in ROUTES)), F.coalesce("rank", F.lit(len(ROUTES))) - 1)
    return files.select("file_id").distinct().join(best, "file_id", "left").select("file_id", chosen.alias("route"))


def analysed(files: DataFrame, strings: DataFrame, insn: DataFrame, loops: DataFrame, loop_insn: DataFrame, functions: DataFrame, tags: DataFrame | None = None, top: int | None = None, force_deep: bool = False) -> DataFrame:
    """One row for every file: its route, what was found, the score, and which of its facts are missing (errors, empty if none).

    A skipped file takes no further stage and has no findings and no score. A file that lacks one kind of facts still goes through the stages that do
    not need them. Facts are restricted to the files that go on before anything is counted.
    """
    routed = routes(files, strings, force_deep)
    taken = routed.filter("route <> 'skip'").select("file_id")
    strings, insn, loops, loop_insn, functions = (rows.join(taken, "file_id", "left_semi") for rows in (strings, insn, loops, loop_insn, functions))
    algorithms = infer.inferred(found_patterns(insn, loops, loop_insn, top)).filter(F.col("confidence") >= report.MIN_REPORTED["algorithms"])
    algorithms = algorithms.withColumn("severity", report.severity_of(F.col("algorithm")))
    parts = [
        algorithms.groupBy("file_id").agg(F.array_join(F.array_sort(F.collect_set("algorithm")), ",").alias("algorithms"), F.round(F.max("confidence"), 4).alias("best_confidence"), F.count("severity").alias("n_vulnerabilities")),
        report.security_score(algorithms.filter("severity IS NOT NULL"), algorithms),
        report.protocols(report.protocol_evidence(strings, report.protocol_table(files.sparkSession))).select("file_id", "protocols"),
        inventory.extract_functions(functions, tags).groupBy("file_id").agg(F.count("*").alias("n_functions")),
        insn.groupBy("file_id").agg(F.lit(True).alias("_insn")),
        functions.groupBy("file_id").agg(F.lit(True).alias("_functions")),
    ]
    out = reduce(lambda x, y: x.join(y, "file_id", "left"), parts, routed)
    skipped = F.col("route") == "skip"
    missing = F.concat_ws(",", F.when(F.col("_insn").isNull(), "no instructions"), F.when(F.col("_functions").isNull(), "no functions"))
    return out.select(
        "file_id",
        "route",
        skipped.alias("skipped"),
        F.when(skipped, "").otherwise(missing).alias("errors"),
        F.coalesce("n_functions", F.lit(0)).alias("n_functions"),
        "algorithms",
        "best_confidence",
        F.coalesce("n_vulnerabilities", F.lit(0)).alias("n_vulnerabilities"),
        "protocols",
        F.when(~skipped, F.coalesce("security_score", F.lit(100))).cast("long").alias("security_score"),
        F.when(skipped, 1).otherwise(STAGES).alias("stages_completed"),
    )
