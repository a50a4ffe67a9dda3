"""Structural detectors over an instruction table: one fused conditional aggregate per function feeds them all.

insn: (file_id, func, ord, mnemonic, op_str[, offset]); ord orders a function's instructions, offset is the distance from its start in bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from evidentia.functions.classify import first_of, mixing_pattern, rotation_family, rounds, xor_pattern
from evidentia.session import python_workers

KEY = ("file_id", "func")
# 32-bit words that name a hash function, and those of the stream cipher's magic string.
HASH_WORDS = {
    "SHA-256": (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x428A2F98, 0x71374491, 0xB5C0FBCF, 0xE9B5DBA5),
    "SHA-1": (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476, 0xC3D2E1F0),
    "MD5": (0xD76AA478, 0xE8C7B756, 0x242070DB),
}
MAGIC_WORDS = (0x61707865, 0x3320646E, 0x79622D32, 0x6B206574)
MAGIC = b"expand 32-byte k"
LOADS = ("ldr", "ldrb", "ldrh", "ldp", "str", "strb", "strh", "stp", "load", "store", "mov")
ALU = ("add", "adds", "sub", "subs", "eor", "eors", "xor", "and", "ands", "orr", "orn", "ror", "rorv", "lsl", "lsr", "asr", "mul", "madd", "msub")


def _has(m: Column, *parts: str) -> Column:
    return m.rlike("|".join(parts))


def _count(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def operation_class(m: Column) -> Column:
    """One of eight classes, first match wins; null for others."""
    return first_of(
        [
            (_has(m, "xor") | m.startswith("eor"), "xor"),
            (_has(m, "add"), "add"),
            (_has(m, "sub"), "sub"),
            (_has(m, "mul"), "mul"),
            (_has(m, "rol", "ror"), "rotate"),
            (_has(m, "shl", "shr", "shift", "lsl", "lsr", "asr"), "shift"),
            (_has(m, "and"), "and"),
            (_has(m, "or"), "or"),
        ],
        F.lit(None).cast("string"),
    )


def rotation_amount(m: Column, operands: Column) -> Column:
    """The second operand of a rotation as a number, if it is one (decimal or 0x)."""
    second = F.trim(F.get(F.split(operands, ","), F.lit(1)))
    number = F.when(second.rlike("^0[xX][0-9a-fA-F]+$"), F.conv(F.substring(second, 3, 16), 16, 10)).when(second.rlike("^[0-9]+$"), second)
    return F.when(_has(m, "rol", "ror"), number.try_cast("int"))


def first_of_function(rows: DataFrame, value: Column, name: str, first: int = 10) -> DataFrame:
    """(file_id, func, name): the values of the ``first`` rows of each function by ord, ties by value, as a list; null values are left out.

    Rows are ranked and cut on both sides of the exchange before they are collected, so a function with any number of rows costs ``first`` rows a task.
    """
    some = rows.select(*KEY, "ord", value.alias("_v")).filter("_v IS NOT NULL")
    kept = some.withColumn("_rn", F.row_number().over(Window.partitionBy(*KEY).orderBy("ord", "_v"))).filter(F.col("_rn") <= first)
    return kept.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "_v"))), lambda x: x["_v"]).alias(name))


def first_rotations(insn: DataFrame, first: int = 10) -> DataFrame:
    """(file_id, func, rotation_amounts): the ``first`` rotation amounts of each function that has any."""
    return first_of_function(insn, rotation_amount(F.lower("mnemonic"), F.coalesce(F.col("op_str"), F.lit(""))), "rotation_amounts", first)


def first_operations(insn: DataFrame, first: int = 10) -> DataFrame:
    """(file_id, func, operations): the text of the ``first`` xors of each function that has any."""
    m = F.lower("mnemonic")
    return first_of_function(insn, F.when(_has(m, "xor") | m.startswith("eor"), F.concat_ws(" ", "mnemonic", "op_str")), "operations", first)


def operand_values(op_str: Column) -> Column:
    """The hexadecimal numbers of an operand string as an array of longs; those of more than 15 digits are left out."""
    digits = F.regexp_extract_all(op_str, F.lit("0x([0-9a-fA-F]+)"), F.lit(1))
    return F.transform(F.filter(digits, lambda h: F.length(h) <= 15), lambda h: F.conv(h, 16, 10).cast("long"))


def function_counts(insn: DataFrame, mix_bytes: int = 500, wide_bytes: int = 800, words: tuple[int, ...] = (), lists: bool = True) -> DataFrame:
    """One row a function with every count that the detectors need: one shuffle, partial sums on the map side.

    ``words`` adds a column of that name: a struct (value, ord) for each of these numbers that stands in an operand, with its last place, so that one pass
    over the instructions feeds the detectors of constants too. ``lists`` adds ``first_rotations`` and ``first_operations``, each one more exchange of
    the rows concerned.

    Mixing counts take the function's first ``mix_bytes`` bytes, the modular ones its first ``wide_bytes`` (all of it without an offset column).
    """
    m, ops = F.lower("mnemonic"), F.coalesce(F.col("op_str"), F.lit(""))
    offset = F.col("offset") if "offset" in insn.columns else F.lit(0)
    near, wide = offset < mix_bytes, offset < wide_bytes
    kind = operation_class(m)
    xor, rotate = _has(m, "xor") | m.startswith("eor"), _has(m, "rol", "ror")
    shift = ~rotate & _has(m, "shl", "shr", "shift", "lsl", "lsr", "asr")
    add = _has(m, "add")
    mul = _has(m, "mul")
    div = ~mul & _has(m, "div")
    named = {
        "xor_count": _count(xor),
        "rotation_count_x2": F.sum(F.when(rotate, 2).when(shift, 1).otherwise(0)),
        "arx_add": _count(add),
        "arx_xor": _count(~add & xor),
        "arx_rotate": _count(~add & ~xor & _has(m, "rol", "ror", "shift", "lsl", "lsr")),
        "table_accesses": _count(_has(m, "mov", "ld") & (ops.contains("[") | ops.contains("byte ptr"))),
        "mul_count": _count(wide & mul),
        "div_count": _count(wide & div),
        "shift_count": _count(wide & ~mul & ~div & _has(m, "shr", "lsr", "asr")),
        "wide_ops": _count(wide & (ops.contains("qword") | ops.contains("r64") | ops.contains("x"))),
    }
    named |= {f"n_{k}": _count(near & (kind == k)) for k in ("xor", "add", "sub", "mul", "rotate", "shift", "and", "or")}
    sums = [*(v.cast("long").alias(k) for k, v in named.items()), F.count("*").alias("n_insn")]
    if lists:
        return _with(_with(function_counts(insn, mix_bytes, wide_bytes, words, False), first_rotations(insn), "rotation_amounts"), first_operations(insn), "operations")
    if not words:
        return insn.groupBy(*KEY).agg(*sums)
    held = insn.withColumn("_values", F.when(ops.contains("0x"), operand_values(ops)))
    last = [F.max(F.when(F.array_contains("_values", F.lit(w).cast("long")), F.col("ord"))).alias(f"_at{k}") for k, w in enumerate(words)]
    found = F.filter(F.array(*(F.struct(F.lit(w).cast("long").alias("value"), F.col(f"_at{k}").alias("ord")) for k, w in enumerate(words))), lambda x: x["ord"].isNotNull())
    return held.groupBy(*KEY).agg(*sums, *last).withColumn("words", found).drop(*(f"_at{k}" for k in range(len(words))))


def _with(rows: DataFrame, lists: DataFrame | None, name: str) -> DataFrame:
    """``rows`` with the list ``name`` of each function: that of ``lists``, else its own, else an empty one."""
    if lists is None:
        return rows if name in rows.columns else rows.withColumn(name, F.array().cast("array<int>"))
    return rows.drop(name).join(lists, list(KEY), "left").withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))


def xor_chains(counts: DataFrame, operations: DataFrame | None = None) -> DataFrame:
    """Functions with at least 2 xors, with their ``first_operations`` where these are given or among the counts."""
    n = F.col("xor_count")
    found = counts.filter(n >= 2) if operations is None else _with(counts.filter(n >= 2), operations, "operations")
    return found.select(*KEY, "xor_count", *(["operations"] if "operations" in found.columns else []), xor_pattern(n).alias("pattern_type"), F.when(n >= 5, "strong").otherwise("moderate").alias("crypto_indicator"))


def bit_rotations(counts: DataFrame, amounts: DataFrame | None = None) -> DataFrame:
    """Functions with a weight of at least 1, a rotation weighing 1 and a shift a half; ``first_rotations`` name the likely algorithm."""
    n = F.col("rotation_count_x2")
    found = _with(counts.filter(n >= 2), amounts, "rotation_amounts")
    return found.select(*KEY, F.floor(n / 2).cast("long").alias("rotation_count"), "rotation_amounts", rotation_family(F.col("rotation_amounts")).alias("likely_algorithm"), F.when(n >= 8, "strong").otherwise("moderate").alias("crypto_indicator"))


def data_mixing(counts: DataFrame) -> DataFrame:
    """Functions that mix at least 3 classes of operations, 10 operations in all."""
    cols = [F.col(f"n_{k}") for k in ("xor", "add", "sub", "mul", "rotate", "shift", "and", "or")]
    kinds, total = sum((c > 0).cast("long") for c in cols), sum(cols)
    scored = counts.withColumn("operation_diversity", kinds).withColumn("total_operations", total).filter("operation_diversity >= 3 AND total_operations >= 10")
    score = F.col("operation_diversity") * F.col("total_operations") / 100
    return scored.select(*KEY, "operation_diversity", "total_operations", *(f"n_{k}" for k in ("xor", "add", "sub", "mul", "rotate", "shift", "and", "or")), F.round(score, 2).alias("mixing_score"), F.when(score > 5, "very_strong").otherwise("strong").alias("crypto_indicator"), mixing_pattern().alias("pattern_type"))


def arx_operations(counts: DataFrame) -> DataFrame:
    a, x, r = F.col("arx_add"), F.col("arx_xor"), F.col("arx_rotate")
    return counts.filter((a >= 2) & (x >= 2) & (r >= 1)).select(*KEY, a.alias("add_operations"), x.alias("xor_operations"), r.alias("rotate_operations"), ((a + x + r) / 3).alias("arx_score"), F.lit("ChaCha20/Salsa20/BLAKE2").alias("likely_algorithm"))


def table_lookups(counts: DataFrame) -> DataFrame:
    n = F.col("table_accesses")
    return counts.filter(n >= 2).select(*KEY, n, F.lit("S-box substitution or permutation").alias("likely_operation"), F.when(n >= 8, "high").otherwise("medium").alias("confidence"))


def modular_arithmetic(counts: DataFrame) -> DataFrame:
    mul, div, shift = F.col("mul_count"), F.col("div_count"), F.col("shift_count")
    return counts.filter((mul >= 3) & ((div >= 1) | (shift >= 2))).select(*KEY, mul.alias("multiplications"), div.alias("divisions"), shift.alias("shifts"), F.col("wide_ops").alias("wide_operations"), F.lit("RSA or ECC").alias("likely_algorithm"), F.when(mul >= 10, 0.75).otherwise(0.65).alias("confidence"))


def loop_blocks(loops: DataFrame) -> DataFrame:
    """(file_id, func, loop_id, block), each once. loops: (file_id, func, loop_id, block)."""
    return loops.select(*KEY, "loop_id", "block").distinct()


def hottest_loops(loops: DataFrame) -> DataFrame:
    """(file_id, func, loop_id, n_blocks): each function's loop with most blocks, the first of equals. loops: (file_id, func, loop_id, block)."""
    sizes = loops.groupBy(*KEY, "loop_id").agg(F.count_distinct("block").alias("n_blocks"))
    best = F.max(F.struct("n_blocks", (-F.col("loop_id")).alias("_neg"), "loop_id")).alias("best")
    return sizes.groupBy(*KEY).agg(best).select(*KEY, "best.loop_id", "best.n_blocks")


def loop_instructions(insn: DataFrame, loops: DataFrame, block_bytes: int = 200) -> DataFrame:
    """Instructions (with a block column) of each function's hottest loop, the first ``block_bytes`` bytes of each block."""
    hot = hottest_loops(loops)
    blocks = loops.join(hot.filter("n_blocks >= 2").select(*KEY, "loop_id"), [*KEY, "loop_id"]).select(*KEY, "block").distinct()
    own = insn.join(blocks, [*KEY, "block"])
    return own.filter(F.col("block_offset") < block_bytes) if "block_offset" in insn.columns else own


def loop_counts(loop_insn: DataFrame) -> DataFrame:
    """One row a function with the counts over its hottest loop that ``feistel_networks`` and ``memory_ratios`` need."""
    m, ops = F.lower("mnemonic"), F.coalesce(F.col("op_str"), F.lit(""))
    memory = m.isin(*LOADS) & ops.contains("[")
    return loop_insn.groupBy(*KEY).agg(
        _count(m.isin("mov", "movz", "orr") & ~ops.rlike("wzr|xzr")).alias("register_copies"),
        _count(m.isin("ldr", "str", "ldp", "stp")).alias("memory_swaps"),
        _count(m.isin("eor", "xor", "eors")).alias("xor_operations"),
        _count(memory).alias("memory_ops"),
        _count(~memory & m.isin(*ALU)).alias("alu_ops"),
        F.count("*").alias("total_instructions"),
    )


def _counted(rows: DataFrame) -> DataFrame:
    return rows if "register_copies" in rows.columns else loop_counts(rows)


def feistel_networks(loop_insn: DataFrame) -> DataFrame:
    """Loops that keep half of their state: register copies, memory moves and xors. Takes instructions or their ``loop_counts``."""
    counts = _counted(loop_insn).select(*KEY, "register_copies", "memory_swaps", "xor_operations")
    kept, x = F.col("register_copies") + F.floor(F.col("memory_swaps") / 4), F.col("xor_operations")
    strong, weak = (kept >= 2) & (x >= 2), (kept >= 1) & (x >= 3)
    confidence = F.when(strong, F.least(F.lit(0.90), 0.70 + kept * 0.05)).otherwise(0.65)
    structure = F.when(strong, "Feistel Network (L/R swap pattern)").otherwise("Possible Feistel Network (weak signal)")
    return counts.filter(strong | weak).select("*", structure.alias("structure"), F.round(confidence, 2).alias("confidence"))


def memory_ratios(loop_insn: DataFrame) -> DataFrame:
    """The share of memory operations in each hottest loop, and what it speaks for. Takes instructions or their ``loop_counts``."""
    counts = _counted(loop_insn).select(*KEY, "memory_ops", "alu_ops", "total_instructions")
    ratio = F.col("memory_ops") / F.col("total_instructions")
    kind = F.when(ratio > 0.25, "S-box cipher (High memory usage)").when(ratio < 0.15, "ARX cipher (Low memory usage)").otherwise("Hybrid/Uncertain (Do not suppress)")
    return counts.select("*", F.round(ratio, 3).alias("memory_ratio"), kind.alias("classification"))


def round_loops(loops: DataFrame) -> DataFrame:
    """Each function's first loop of 3 to 20 blocks, with its estimated rounds."""
    sizes = loops.groupBy(*KEY, "loop_id").agg(F.count_distinct("block").alias("loop_blocks")).filter(F.col("loop_blocks").between(3, 20))
    first = sizes.groupBy(*KEY).agg(F.min_by("loop_blocks", "loop_id").alias("loop_blocks"))
    return first.select(*KEY, "loop_blocks", rounds(F.col("loop_blocks")).cast("long").alias("potential_rounds"), F.when(F.col("loop_blocks") > 5, "high").otherwise("medium").alias("complexity"))


def immediates(insn: DataFrame) -> DataFrame:
    """(file_id, func, ord, value) of every hexadecimal number in the operands; the ``words`` of ``function_counts`` where these are given."""
    if "words" in insn.columns:
        return insn.select(*KEY, F.explode("words").alias("w")).select(*KEY, "w.ord", "w.value")
    return insn.select(*KEY, "ord", F.explode(operand_values(F.coalesce("op_str", F.lit("")))).alias("value"))


def places(sections: DataFrame, wanted: list[bytes]) -> DataFrame:
    """(file_id, address, which): every place of every byte string of ``wanted`` in the sections (file_id, vaddr, data), overlapping ones too.

    A task goes once over each section's bytes, whatever their number, and gives out hits only; ``which`` is the place in the list. Null sections have none.
    """
    python_workers(sections.sparkSession)
    rows = sections.filter("data IS NOT NULL").select("file_id", F.col("vaddr").cast("long").alias("vaddr"), F.col("data").cast("binary").alias("data"))
    schema = rows.select("file_id").schema.add("address", "long").add("which", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A look-ahead takes no bytes, so a hit hides none that overlaps it; equally long strings cannot hide each other either.
        finders = [re.compile(b"(?=(" + b"|".join(re.escape(w) for w in own) + b"))", re.S) for own in by_length]
        for batch in batches:
            row, at, which = [], [], []
            for k, (base, data) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2), strict=True)):
                view = memoryview(data.as_buffer())
                for m in (m for f in finders for m in f.finditer(view)):
                    for n in number[bytes(m[1])]:
                        row.append(k)
                        at.append(base + m.start())
                        which.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(at, pa.int64()), pa.array(which, pa.int32())], ["file_id", "address", "which"])

    number: dict[bytes, list[int]] = {}
    for n, w in enumerate(wanted):
        number.setdefault(bytes(w), []).append(n)
    by_length = [sorted(w for w in number if len(w) == k) for k in sorted({len(w) for w in number if w})]
    return rows.mapInArrow(run, schema)


def _near(hits: DataFrame, functions: DataFrame, reach: int) -> DataFrame:
    """Hits (file_id, address, ...) beside each function (func, lo, hi) that has them at lo <= address < hi, ``reach`` bytes around it: both sides are
    dealt to buckets of ``reach`` bytes, so the interval join is an equality join."""
    spans = functions.select("file_id", "func", (F.col("addr") - reach).alias("lo"), (F.col("addr") + F.col("size") + reach).alias("hi")).filter("hi > lo")
    spans = spans.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") / reach), F.floor((F.col("hi") - 1) / reach))))
    return hits.withColumn("bucket", F.floor(F.col("address") / reach)).join(spans, ["file_id", "bucket"]).filter("address >= lo AND address < hi").drop("bucket")


def nearby_words(sections: DataFrame, functions: DataFrame, words: list[int], reach: int = 500) -> DataFrame:
    """(file_id, func, value, address): dictionary words of 32 bits, little-endian on the function's grid of 4 bytes, that start at most ``reach`` bytes
    before a function or less than ``reach`` bytes after it. sections: (file_id, vaddr, data); functions: (file_id, func, addr, size)."""
    hits = places(sections, [w.to_bytes(4, "little") for w in words]).withColumn("value", F.get(F.array(*(F.lit(w).cast("long") for w in words)), F.col("which")))
    return _near(hits, functions, reach).filter("(address - lo) % 4 = 0").select("file_id", "func", "value", "address").distinct()


def nearby_strings(sections: DataFrame, functions: DataFrame, reach: int = 1000, wanted: bytes = MAGIC) -> DataFrame:
    """(file_id, func): functions that have the string ``wanted`` in a section, starting at most ``reach`` bytes before them or less than ``reach`` bytes
    after them. Its end may lie further off."""
    return _near(places(sections, [wanted]), functions, reach).select("file_id", "func").distinct()


def hash_constants(insn: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """Functions with at least 2 distinct words of the dictionary, in operands or near by; the last word found names the algorithm."""
    case = first_of([(F.col("value").isin(list(words)), name) for name, words in HASH_WORDS.items()], F.lit(None).cast("string"))
    found = immediates(insn).select(*KEY, "value", F.struct(F.lit(0).alias("pass"), F.col("ord").cast("long").alias("at"), "value").alias("place"))
    if near is not None:
        found = found.unionByName(near.select(*KEY, "value", F.struct(F.lit(1).alias("pass"), F.col("address").cast("long").alias("at"), "value").alias("place")))
    named = found.withColumn("algorithm", case).filter("algorithm IS NOT NULL")
    out = named.groupBy(*KEY).agg(F.count_distinct("value").alias("constant_count"), F.max_by("algorithm", "place").alias("algorithm"), F.array_sort(F.collect_set("value")).alias("constants_found"))
    return out.filter("constant_count >= 2").withColumn("confidence", F.when(F.col("constant_count") >= 4, "high").otherwise("medium"))


def magic_constants(insn: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """Functions with 2 of the 4 magic words as operands, or (``near``: file_id, func) with the whole string close by."""
    own = immediates(insn).filter(F.col("value").isin(list(MAGIC_WORDS))).groupBy(*KEY).agg(F.count_distinct("value").alias("n")).filter("n >= 2").select(*KEY)
    return own if near is None else own.unionByName(near.select(*KEY)).distinct()


def isa_patterns(insn: DataFrame, patterns: DataFrame) -> DataFrame:
    """(file_id, func, pattern, n, confidence) of the instruction patterns (pattern, mnemonic, min_occurrences, confidence) that occur often enough.

    Patterns with a column isa count for instructions of that column's value only. Instructions are counted by mnemonic before they meet the patterns.
    """
    isa = ["isa"] if "isa" in patterns.columns and "isa" in insn.columns else []
    counted = insn.groupBy(*KEY, *isa, F.upper("mnemonic").alias("_m")).agg(F.count("*").alias("_n"))
    rules = patterns.select(*isa, "pattern", F.upper("mnemonic").alias("_m"), "min_occurrences", "confidence")
    own = counted.join(rules, [*isa, "_m"])
    return own.groupBy(*KEY, "pattern", "min_occurrences", "confidence").agg(F.sum("_n").alias("n")).filter("n >= min_occurrences").select(*KEY, "pattern", "n", "confidence")


def legacy_block_flags(counts: DataFrame) -> DataFrame:
    """Blocks (file_id, func, block, n_xor, n_shift, n_tmp) with many xors, shifts or temporaries."""
    return counts.filter("n_xor > 3 OR n_shift > 2 OR n_tmp > 5").withColumn("patterns", F.concat_ws(",", F.when(F.col("n_xor") > 3, "xor"), F.when(F.col("n_shift") > 2, "shift"), F.when(F.col("n_tmp") > 5, "mixing")))


def group_counts(insn: DataFrame, groups: DataFrame, functions: int = 10, per_block: int = 50) -> DataFrame:
    """Six-class counts and the score of each function group (file_id, root, func), over its first functions and each block's first instructions."""
    ranked = groups.withColumn("rf", F.row_number().over(Window.partitionBy("file_id", "root").orderBy("func"))).filter(F.col("rf") <= functions)
    blocks = ["block"] if "block" in insn.columns else []
    cut = insn.withColumn("ri", F.row_number().over(Window.partitionBy(*KEY, *blocks).orderBy("ord"))).filter(F.col("ri") <= per_block)
    m, ops = F.lower("mnemonic"), F.coalesce(F.col("op_str"), F.lit(""))
    kind = first_of(
        [
            (_has(m, "xor"), "xor"),
            (_has(m, "rol", "ror", "rotate"), "rotation"),
            (m.isin("movzx", "movsx", "ldr", "ldrb") & ops.contains("["), "lookup"),
            (_has(m, "shl", "shr", "lsl", "lsr"), "shift"),
            (_has(m, "and", "or"), "and_or"),
            (_has(m, "mod", "div"), "mod"),
        ],
        F.lit(None).cast("string"),
    )
    counted = ranked.join(cut.withColumn("kind", kind), list(KEY)).groupBy("file_id", "root").agg(*(_count(F.col("kind") == k).alias(f"{k}_count") for k in ("xor", "rotation", "lookup", "shift", "and_or", "mod")))
    limits = (("xor_count", 10, 0.3), ("rotation_count", 5, 0.25), ("lookup_count", 3, 0.2), ("shift_count", 15, 0.15), ("and_or_count", 20, 0.1))
    score = sum(F.when(F.col(c) > n, F.lit(s)).otherwise(0.0) for c, n, s in limits)
    parts = F.concat_ws(", ", *(F.when(F.col(c) > n, F.format_string(f"%d {w}", c)) for (c, n, _), w in zip(limits, ("XOR operations", "rotations", "table lookups", "shifts"), strict=False)))
    summary = F.when(parts == "", "No significant crypto patterns").otherwise(F.concat(F.lit("Detected: "), parts))
    return counted.select("*", F.round(F.least(score, F.lit(1.0)), 2).alias("crypto_score"), (F.col("xor_count") > 5).alias("has_xor_chains"), (F.col("rotation_count") > 3).alias("has_rotations"), (F.col("lookup_count") > 2).alias("has_lookups"), summary.alias("pattern_summary"))
