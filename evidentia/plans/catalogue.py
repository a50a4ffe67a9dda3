"""Registered queries over the driver tables and the SQL that checks them.

No driver table holds binaries, so texts stand in for sections and other tables for facts (see ``standins``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from evidentia.functions import classify, jsonfix, text as tx
from evidentia.operators import detect, infer, inventory, job, ledger, report, scan
from evidentia.plans import standins as st
from evidentia.session import table
from evidentia.sources import dictionaries

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function name, with its DuckDB SQL; {FACTS} in it stands for the stand-in tables."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql.replace("{FACTS}", st.SQL)
        return fn

    return add


KEYS = "|".join(tx.KEYWORDS)


@query(f"""
SELECT lang, count(*)::BIGINT AS n_strings, sum(length(s))::BIGINT AS n_chars
FROM (SELECT lang, unnest(regexp_extract_all(text, '[\\x20-\\x7e]{{4,}}')) AS s FROM documents) WHERE regexp_matches(lower(s), '{KEYS}') GROUP BY lang
""")
def keyword_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printable runs that hold a keyword, counted by language."""
    runs = table(spark, sf_dir, "documents").select("lang", F.explode(tx.printable_runs(F.col("text"))).alias("s"))
    return runs.filter(tx.has_keyword(F.col("s"))).groupBy("lang").agg(F.count("*").alias("n_strings"), F.sum(F.length("s")).alias("n_chars"))


@query("SELECT doc_id, octet_length(encode(text))::BIGINT AS size_bytes, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents WHERE text <> ''")
def file_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes and size of every document."""
    return inventory.file_metadata(table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("content")))


@query("SELECT doc_id, (pos - 1)::INT AS ord, s AS string FROM (SELECT doc_id, unnest(r) AS s, unnest(generate_series(1, len(r))) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '[\\x20-\\x7e]{4,}') AS r FROM documents))")
def printable_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every printable run of every document, in order."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tx.printable_runs(F.col("text"))).alias("ord", "string"))


@query(f"""
WITH r AS (SELECT doc_id, unnest(r) AS s, unnest(generate_series(1, len(r))) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '[\\x20-\\x7e]{{4,}}') AS r FROM documents)),
k AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS ord, count(*) OVER (PARTITION BY doc_id) AS total FROM r WHERE regexp_matches(lower(s), '{KEYS}'))
SELECT doc_id, ord::INT AS ord, s AS string, total::BIGINT AS total_found FROM k WHERE ord <= 100
""")
def keyword_top100(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 100 keyword strings of each document: the cap is the feature."""
    runs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tx.printable_runs(F.col("text"))).alias("pos", "string")).filter(tx.has_keyword(F.col("string")))
    w = Window.partitionBy("doc_id")
    numbered = runs.select("doc_id", "string", F.row_number().over(w.orderBy("pos")).alias("ord"), F.count("*").over(w).alias("total_found"))
    return numbered.filter("ord <= 100")


_SCAN = "SELECT d.doc_id AS id, b.item_id AS item, instr(d.text, b.text)::BIGINT AS position FROM documents d JOIN benchmark b ON contains(d.text, b.text)"


def _phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return scan.phrase_scan(docs, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("item"), F.col("text").alias("phrase")))


@query(_SCAN)
def constant_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each dictionary phrase's first place in each document."""
    return _phrases(spark, sf_dir)


@query("WITH s AS (" + _SCAN + "), g AS (SELECT item % 7 AS family, id, count(*) AS n FROM s GROUP BY ALL), t AS (SELECT family, max(n) AS top, sum(n) AS total FROM g GROUP BY family) SELECT family, total::BIGINT AS n, CASE WHEN top >= 4 THEN 'very_high' WHEN top >= 2 THEN 'high' WHEN top >= 1 THEN 'medium' ELSE 'low' END AS confidence_level FROM t")
def constant_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Found phrases by family, with the word for the largest group."""
    groups = _phrases(spark, sf_dir).groupBy((F.col("item") % 7).alias("family"), "id").agg(F.count("*").alias("n"))
    return groups.groupBy("family").agg(F.sum("n").alias("n"), F.max("n").alias("top")).select("family", "n", classify.constant_confidence(F.col("top")).alias("confidence_level"))


TEXT_RULES = (
    ("tags", "A", "high", "all", 2, {"script": "text:<script", "style": "text:<style"}),
    ("markup", "B", "medium", "n_of", 2, {"bold": "text:<b>", "table": "nocase:<TABLE", "amp": "text:&amp;"}),
    ("links", "C", "low", "count_over", 5, {"href": "text:href"}),
    ("letters", "D", "high", "any", 1, {"the": "74 68 ?? 20", "jump": "3c [3] 3e", "nibble": "3c 6? 3e"}),
)
_RULES_SQL = r"""
WITH c AS (SELECT page_id, len(regexp_extract_all(html, '<script')) AS s, len(regexp_extract_all(html, '<style')) AS y, len(regexp_extract_all(html, '<b>')) AS b, len(regexp_extract_all(html, '(?i)<TABLE')) AS t,
  len(regexp_extract_all(html, '&amp;')) AS a, len(regexp_extract_all(html, 'href')) AS h, len(regexp_extract_all(x, '(?s)th. ')) AS d1, len(regexp_extract_all(x, '(?s)<.{3}>')) AS d2, len(regexp_extract_all(x, '(?s)<[\x60-\x6f]>')) AS d3
  FROM (SELECT *, regexp_replace(html, '[^\x00-\x7f]', '~~', 'g') AS x FROM pages)),
m AS (SELECT page_id, 'tags' AS rule, 'A' AS algorithm, 'high' AS severity, s + y AS match_count FROM c WHERE s > 0 AND y > 0
  UNION ALL SELECT page_id, 'markup', 'B', 'medium', b + t + a FROM c WHERE (b > 0)::INT + (t > 0)::INT + (a > 0)::INT >= 2
  UNION ALL SELECT page_id, 'links', 'C', 'low', h FROM c WHERE h > 5
  UNION ALL SELECT page_id, 'letters', 'D', 'high', d1 + d2 + d3 FROM c WHERE d1 + d2 + d3 > 0)
"""


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.rule_matches(table(spark, sf_dir, "pages").select(F.col("page_id").alias("file_id"), F.col("html").cast("binary").alias("data")), TEXT_RULES)


@query(_RULES_SQL + "SELECT page_id AS file_id, rule, algorithm, severity, match_count::BIGINT AS match_count FROM m")
def rule_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules with the conditions any, all, n of, and more than n, over pages as bytes."""
    return _rules(spark, sf_dir)


@query(_RULES_SQL + """
SELECT page_id AS file_id, count(*)::BIGINT AS n_rules, count(DISTINCT algorithm)::BIGINT AS n_algorithms, string_agg(DISTINCT algorithm, ',' ORDER BY algorithm) AS algorithms,
  count(*) FILTER (severity = 'high')::BIGINT AS n_high, count(*) FILTER (severity = 'medium')::BIGINT AS n_medium, count(*) FILTER (severity = 'low')::BIGINT AS n_low,
  round(CASE WHEN count(DISTINCT algorithm) > 2 THEN least(least(sum(w) / (count(*) + 5), 1.0) * 1.2, 1.0) ELSE least(sum(w) / (count(*) + 5), 1.0) END, 2)::DOUBLE AS confidence
FROM (SELECT *, (CASE severity WHEN 'high' THEN 1.0::DOUBLE WHEN 'medium' THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END) * (1 + least(match_count / 10.0::DOUBLE, 1.0::DOUBLE)) AS w FROM m) GROUP BY page_id
""")
def rule_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of each page summed up, with the score."""
    return scan.rule_summary(_rules(spark, sf_dir))


@query("""
WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents WHERE text <> ''), n AS (SELECT doc_id, ch, count(*) AS k FROM c GROUP BY ALL), t AS (SELECT doc_id, k, sum(k) OVER (PARTITION BY doc_id) AS n FROM n)
SELECT doc_id, round(sum(-(k / n::DOUBLE) * log2(k / n::DOUBLE)), 4) AS entropy FROM t GROUP BY doc_id
""")
def entropy_by_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shannon entropy of every document's characters: characters are counted on the map side, so long texts and hot characters only cost counts."""
    chars = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "")).alias("ch")).filter("ch <> ''")
    counts = chars.groupBy("doc_id", "ch").agg(F.count("*").alias("k"))
    total = counts.groupBy("doc_id").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.log2(F.col("k").cast("double"))).alias("klogk"))
    return total.select("doc_id", F.round(F.log2(F.col("n").cast("double")) - F.col("klogk") / F.col("n"), 4).alias("entropy"))


#: So many events are searched for keys in a task.
KEY_EVENTS = 50_000


def key_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of events, cut at lengths of up to 32 bytes, as data sections."""
    h = F.sha2(F.concat(F.col("event_id").cast("string"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.when(F.date_format("ts", "SSSSSS") != "000000", F.concat(F.lit("."), F.regexp_replace(F.date_format("ts", "SSSSSS"), "0+$", ""))).otherwise("")), 256)
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    # A file of one row group would be one task.
    events = events.repartition(max(spark.sparkContext.defaultParallelism, events.count() // KEY_EVENTS), "event_id")
    return events.select(F.col("event_id").alias("file_id"), F.lit(".data").alias("name"), F.lit(0).cast("long").alias("vaddr"), F.unhex(F.substr(h, F.lit(1), (2 + (F.col("event_id") % 60) * 2).cast("int"))).alias("data"))


@query("""
WITH t AS (SELECT event_id, sha256(event_id::VARCHAR || ts::VARCHAR)[1:2 + (event_id % 60) * 2] AS h FROM events),
w AS (SELECT event_id, k AS size, o, h[o * 2 + 1 : o * 2 + 2 * k] AS x FROM t, (VALUES (8), (16), (24), (32)) AS s(k), generate_series(0, 31) AS g(o) WHERE o + k < length(h) // 2),
b AS (SELECT event_id, size, o, x, list_transform(generate_series(0, size - 1), lambda i: ('0x' || x[i * 2 + 1 : i * 2 + 2])::INT) AS v FROM w),
f AS (SELECT * FROM b WHERE len(list_distinct(v)) >= 4 AND len(list_filter(v, lambda q: q < 32 OR q > 126)) >= size * 0.3 AND NOT starts_with(x, '6a09e667') AND NOT starts_with(x, '67452301')
  AND list_sum(list_transform(list_distinct(v), lambda c: -(len(list_filter(v, lambda q: q = c)) / size::DOUBLE) * log2(len(list_filter(v, lambda q: q = c)) / size::DOUBLE))) >= 3.0 - 1e-9)
SELECT event_id AS file_id, o::BIGINT AS "offset", min(size)::INT AS size, arg_min(x, size) AS hexed FROM f GROUP BY event_id, o
""")
def key_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key-like windows of every byte string; here digests of events, cut at lengths of up to 32 bytes."""
    return scan.key_windows(key_sections(spark, sf_dir)).select("file_id", "offset", "size", "hexed")


@query("WITH {FACTS} SELECT file_id, func, x AS xor_count, CASE WHEN x >= 8 THEN 'key_schedule or stream_cipher' WHEN x >= 5 THEN 'key_mixing or round_function' WHEN x >= 3 THEN 'basic_crypto_operation' ELSE 'unknown' END AS pattern_type, CASE WHEN x >= 5 THEN 'strong' ELSE 'moderate' END AS crypto_indicator FROM counts WHERE x >= 2")
def xor_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.xor_chains(detect.function_counts(st.instructions(spark, sf_dir), lists=False))


@query("WITH {FACTS} SELECT file_id, func, r2 // 2 AS rotation_count, CASE WHEN r2 >= 8 THEN 'strong' ELSE 'moderate' END AS crypto_indicator FROM counts WHERE r2 >= 2")
def weighted_rotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.bit_rotations(detect.function_counts(st.instructions(spark, sf_dir), lists=False)).drop("rotation_amounts", "likely_algorithm")


@query("""WITH {FACTS}, a AS (SELECT file_id, func, ord, TRY_CAST(string_split(op_str, ', ')[2] AS BIGINT) AS amount FROM insn WHERE mnemonic = 'ror'),
b AS (SELECT *, row_number() OVER (PARTITION BY file_id, func ORDER BY ord, amount) AS rn FROM a WHERE amount < 2147483648)
SELECT file_id, func, string_agg(amount::VARCHAR, ',' ORDER BY rn) AS amounts FROM b WHERE rn <= 10 GROUP BY file_id, func""")
def rotation_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 10 rotation amounts of each function, decimal or hexadecimal; the cap is the feature."""
    insn = st.instructions(spark, sf_dir)
    found = detect.bit_rotations(detect.function_counts(insn, lists=False), detect.first_rotations(insn)).filter(F.size("rotation_amounts") > 0)
    return found.select("file_id", "func", F.array_join("rotation_amounts", ",").alias("amounts"))


@query("""WITH {FACTS}, a AS (SELECT file_id, func, concat_ws(' ', mnemonic, op_str) AS t, row_number() OVER (PARTITION BY file_id, func ORDER BY ord, concat_ws(' ', mnemonic, op_str)) AS rn, count(*) OVER (PARTITION BY file_id, func) AS n FROM insn WHERE mnemonic IN ('xor', 'eor'))
SELECT file_id, func, any_value(n)::BIGINT AS xor_count, string_agg(t, ';' ORDER BY rn) AS operations FROM a WHERE rn <= 10 GROUP BY file_id, func HAVING any_value(n) >= 2""")
def xor_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 10 xors of each function that has two, as text; the cap is the feature."""
    insn = st.instructions(spark, sf_dir)
    found = detect.xor_chains(detect.function_counts(insn, lists=False), detect.first_operations(insn))
    return found.select("file_id", "func", "xor_count", F.array_join("operations", ";").alias("operations"))


@query("""WITH {FACTS}, m AS (SELECT *, (n_xor > 0)::INT + (n_add > 0)::INT + (n_sub > 0)::INT + (n_mul > 0)::INT + (n_rotate > 0)::INT + (n_shift > 0)::INT + (n_and > 0)::INT + (n_or > 0)::INT AS d, n_xor + n_add + n_sub + n_mul + n_rotate + n_shift + n_and + n_or AS tt FROM counts)
SELECT file_id, func, d::BIGINT AS operation_diversity, tt AS total_operations, n_xor, n_add, n_sub, n_mul, n_rotate, n_shift, n_and, n_or, round(d * tt / 100.0::DOUBLE, 2) AS mixing_score, CASE WHEN d * tt > 500 THEN 'very_strong' ELSE 'strong' END AS crypto_indicator,
CASE WHEN n_add >= 3 AND n_xor >= 3 AND n_rotate >= 2 THEN 'ARX_cipher (ChaCha20/Salsa20 style)' WHEN n_xor >= 4 AND n_shift + n_rotate >= 3 THEN 'SPN_cipher (AES style)' WHEN n_xor >= 3 AND n_and >= 2 AND n_or >= 2 THEN 'hash_function (SHA/MD5 style)' ELSE 'general_crypto_mixing' END AS pattern_type FROM m WHERE d >= 3 AND tt >= 10""")
def mixing_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.data_mixing(detect.function_counts(st.instructions(spark, sf_dir), lists=False))


@query("WITH {FACTS} SELECT file_id, func, a AS add_operations, x AS xor_operations, rot AS rotate_operations, (a + x + rot) / 3.0::DOUBLE AS arx_score, 'ChaCha20/Salsa20/BLAKE2' AS likely_algorithm FROM counts WHERE a >= 2 AND x >= 2 AND rot >= 1")
def arx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.arx_operations(detect.function_counts(st.instructions(spark, sf_dir), lists=False))


@query("WITH {FACTS} SELECT file_id, func, t AS table_accesses, 'S-box substitution or permutation' AS likely_operation, CASE WHEN t >= 8 THEN 'high' ELSE 'medium' END AS confidence FROM counts WHERE t >= 2")
def table_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.table_lookups(detect.function_counts(st.instructions(spark, sf_dir), lists=False))


@query("WITH {FACTS} SELECT file_id, func, mul AS multiplications, div AS divisions, 0::BIGINT AS shifts, wide AS wide_operations, 'RSA or ECC' AS likely_algorithm, CASE WHEN mul >= 10 THEN 0.75::DOUBLE ELSE 0.65::DOUBLE END AS confidence FROM counts WHERE mul >= 3 AND div >= 1")
def modular(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.modular_arithmetic(detect.function_counts(st.instructions(spark, sf_dir), lists=False))


@query("WITH {FACTS} SELECT file_id, func, loop_id, n_blocks::BIGINT AS n_blocks FROM hot")
def hottest_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.hottest_loops(st.loops(spark, sf_dir))


@query("WITH {FACTS}, s AS (SELECT file_id, func, loop_id, count(DISTINCT block) AS n FROM loops GROUP BY ALL HAVING count(DISTINCT block) BETWEEN 3 AND 20), f AS (SELECT file_id, func, arg_min(n, loop_id) AS n FROM s GROUP BY ALL) SELECT file_id, func, n::BIGINT AS loop_blocks, (CASE WHEN n BETWEEN 10 AND 12 THEN 10 WHEN n BETWEEN 13 AND 14 THEN 12 WHEN n BETWEEN 16 AND 17 THEN 16 WHEN n BETWEEN 18 AND 20 THEN 20 ELSE n END)::BIGINT AS potential_rounds, CASE WHEN n > 5 THEN 'high' ELSE 'medium' END AS complexity FROM f")
def round_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.round_loops(st.loops(spark, sf_dir))


@query("WITH {FACTS}, c AS (SELECT file_id, func, count(*) FILTER (mnemonic IN ('mov', 'orr')) AS r, count(*) FILTER (mnemonic = 'ldr') AS m, count(*) FILTER (mnemonic IN ('xor', 'eor')) AS x FROM linsn GROUP BY ALL), p AS (SELECT *, r + m // 4 AS k FROM c) SELECT file_id, func, r AS register_copies, m AS memory_swaps, x AS xor_operations, CASE WHEN k >= 2 AND x >= 2 THEN 'Feistel Network (L/R swap pattern)' ELSE 'Possible Feistel Network (weak signal)' END AS structure, round(CASE WHEN k >= 2 AND x >= 2 THEN least(0.90::DOUBLE, 0.70::DOUBLE + k * 0.05::DOUBLE) ELSE 0.65::DOUBLE END, 2) AS confidence FROM p WHERE (k >= 2 AND x >= 2) OR (k >= 1 AND x >= 3)")
def feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.feistel_networks(detect.loop_instructions(st.loop_insn(spark, sf_dir), st.loops(spark, sf_dir)))


@query("WITH {FACTS}, c AS (SELECT file_id, func, count(*) FILTER (mnemonic IN ('ldr', 'mov') AND contains(op_str, '[')) AS m, count(*) FILTER (mnemonic IN ('xor', 'add', 'ror', 'lsl', 'mul', 'and', 'orr', 'sub', 'eor')) AS a, count(*) AS n FROM linsn GROUP BY ALL) SELECT file_id, func, m AS memory_ops, a AS alu_ops, n AS total_instructions, round(m / n::DOUBLE, 3) AS memory_ratio, CASE WHEN m / n::DOUBLE > 0.25 THEN 'S-box cipher (High memory usage)' WHEN m / n::DOUBLE < 0.15 THEN 'ARX cipher (Low memory usage)' ELSE 'Hybrid/Uncertain (Do not suppress)' END AS classification FROM c")
def mem_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.memory_ratios(detect.loop_instructions(st.loop_insn(spark, sf_dir), st.loops(spark, sf_dir)))


@query("WITH {FACTS}, v AS (SELECT file_id, func, ord, TRY_CAST('0x' || regexp_extract(op_str, '0x([0-9a-f]+)', 1) AS BIGINT) AS v FROM insn WHERE contains(op_str, '0x')), w AS (SELECT *, CASE WHEN v IN (1779033703, 3144134277) THEN 'SHA-256' WHEN v IN (1732584193, 4023233417) THEN 'SHA-1' END AS a FROM v) SELECT file_id, func, count(DISTINCT v)::BIGINT AS constant_count, arg_max(a, (ord, v)) AS algorithm, string_agg(DISTINCT v::VARCHAR, ',' ORDER BY v::VARCHAR) AS found, CASE WHEN count(DISTINCT v) >= 4 THEN 'high' ELSE 'medium' END AS confidence FROM w WHERE a IS NOT NULL GROUP BY file_id, func HAVING count(DISTINCT v) >= 2")
def distinct_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.hash_constants(st.instructions(spark, sf_dir))
    return found.select("file_id", "func", "constant_count", "algorithm", F.array_join(F.array_sort(F.transform("constants_found", lambda v: v.cast("string"))), ",").alias("found"), "confidence")


@query("WITH {FACTS} SELECT file_id, func FROM insn WHERE contains(op_str, '0x61707865') OR contains(op_str, '0x3320646e') GROUP BY ALL HAVING count(DISTINCT regexp_extract(op_str, '0x([0-9a-f]+)', 1)) >= 2")
def magic_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.magic_constants(st.instructions(spark, sf_dir))


@query("""WITH {FACTS}, p(isa, pattern, m, least, confidence) AS (VALUES ('ARM', 'xor_cipher', 'eor', 5, 0.6::DOUBLE), ('ARM', 'rotation', 'ror', 3, 0.5), ('ARM', 'rotation', 'lsl', 3, 0.5), ('ARM', 'table_lookup', 'ldr', 4, 0.6),
('x86', 'xor_cipher', 'xor', 5, 0.6), ('x86', 'rotation', 'ror', 3, 0.5), ('x86', 'table_lookup', 'mov', 4, 0.6), ('MIPS', 'xor_cipher', 'xor', 5, 0.6), ('RISC-V', 'xor_cipher', 'xor', 5, 0.6), ('RISC-V', 'rotation', 'ror', 3, 0.5),
('AVR', 'xor_cipher', 'eor', 5, 0.6), ('AVR', 'rotation', 'lsl', 3, 0.5), ('AVR', 'rotation', 'ror', 3, 0.5))
SELECT file_id, func, pattern, count(*)::BIGINT AS n, confidence FROM insn JOIN p ON mnemonic = m AND isa = ['ARM', 'x86', 'MIPS', 'RISC-V', 'AVR'][file_id % 5 + 1] GROUP BY ALL HAVING count(*) >= any_value(least)""")
def isa_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruction patterns of each function's architecture, from the dictionary file's table."""
    isa = F.get(F.array(*(F.lit(a) for a in dictionaries.ISA["architectures"])), (F.col("file_id") % 5).cast("int"))
    return detect.isa_patterns(st.instructions(spark, sf_dir).withColumn("isa", isa), dictionaries.isa_table(dictionaries.inline(spark, dictionaries.ISA)))


@query("WITH {FACTS}, c AS (SELECT l_orderkey % 50 AS file_id, l_suppkey AS func, l_linenumber AS block, count(*) FILTER (l_partkey % 12 IN (0, 10)) AS n_xor, count(*) FILTER (l_partkey % 12 = 3) AS n_shift, count(*) FILTER (l_partkey % 12 = 6) AS n_tmp FROM lineitem GROUP BY ALL) SELECT *, concat_ws(',', CASE WHEN n_xor > 3 THEN 'xor' END, CASE WHEN n_shift > 2 THEN 'shift' END, CASE WHEN n_tmp > 5 THEN 'mixing' END) AS patterns FROM c WHERE n_xor > 3 OR n_shift > 2 OR n_tmp > 5")
def legacy_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_partkey") % 12
    counts = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 50).alias("file_id"), F.col("l_suppkey").alias("func"), F.col("l_linenumber").alias("block")).agg(F.count_if(k.isin(0, 10)).alias("n_xor"), F.count_if(k == 3).alias("n_shift"), F.count_if(k == 6).alias("n_tmp"))
    return detect.legacy_block_flags(counts)


_FUNCTIONS = """WITH {FACTS}, tags AS (SELECT DISTINCT l_partkey % 7 AS file_id, l_partkey * 100 AS addr, l_shipmode_like AS tag FROM (SELECT l_partkey, l_returnflag AS l_shipmode_like FROM lineitem WHERE l_linenumber = 7 AND l_quantity > 48)),
t AS (SELECT file_id, addr, count(*) AS n FROM tags GROUP BY ALL),
s AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY addr) AS seen FROM fn WHERE NOT is_plt AND NOT is_simproc),
c AS (SELECT s.*, CASE WHEN nodes = 0 THEN 0 WHEN edges IS NULL THEN num_blocks ELSE greatest(edges - nodes + 2, 0) END AS cc, n IS NOT NULL AS hit FROM s LEFT JOIN t USING (file_id, addr) WHERE seen <= CASE WHEN is_blob THEN 500 ELSE 100000 END),
k AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY {ORDER}) AS rn FROM c WHERE cc >= CASE WHEN is_blob THEN 8 ELSE 3 END OR hit)
SELECT file_id, addr, size, num_blocks, cc AS complexity, round(cc / greatest(num_blocks, 1)::DOUBLE, 2) AS complexity_score, hit AS has_hit, row_number() OVER (PARTITION BY file_id ORDER BY cc DESC, addr)::INT AS ord FROM k WHERE rn <= 50"""


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of high quantity as rule hits inside functions."""
    return table(spark, sf_dir, "lineitem").filter("l_linenumber = 7 AND l_quantity > 48").select((F.col("l_partkey") % 7).alias("file_id"), (F.col("l_partkey") * 100).alias("addr"), F.col("l_returnflag").alias("tag"))


def _extract(spark: SparkSession, sf_dir: str, topk: bool) -> DataFrame:
    return inventory.extract_functions(st.functions(spark, sf_dir), tags(spark, sf_dir), topk=topk).drop("name", "tags")


@query(_FUNCTIONS.replace("{ORDER}", "addr"))
def function_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50 functions worth a look of each file, by complexity."""
    return _extract(spark, sf_dir, False)


@query(_FUNCTIONS.replace("{ORDER}", "cc DESC, addr"))
def function_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 most complex functions of each file."""
    return _extract(spark, sf_dir, True)


_SCORES = """WITH {FACTS}, m AS (SELECT *, (n_xor > 0)::INT + (n_add > 0)::INT + (n_sub > 0)::INT + (n_mul > 0)::INT + (n_rotate > 0)::INT + (n_shift > 0)::INT + (n_and > 0)::INT + (n_or > 0)::INT AS d, n_xor + n_add + n_sub + n_mul + n_rotate + n_shift + n_and + n_or AS tt FROM counts),
p AS (SELECT file_id, count(*) FILTER (x >= 2) AS nx, count(*) FILTER (r2 >= 2) AS nr, count(*) FILTER (d >= 3 AND tt >= 10) AS nm, count(*) FILTER (x >= 2 AND a >= 2 AND rot >= 1) AS na FROM m GROUP BY file_id),
l AS (SELECT *, least(least(nx * 0.15::DOUBLE, 0.4::DOUBLE) + least(nr * 0.12::DOUBLE, 0.3::DOUBLE) + least(nm * 0.18::DOUBLE, 0.4::DOUBLE) + CASE WHEN nx + nr + nm >= 10 THEN 0.3::DOUBLE WHEN nx + nr + nm >= 5 THEN 0.15::DOUBLE ELSE 0 END, 1.0::DOUBLE) AS score FROM p)"""


def _pattern_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = detect.function_counts(st.instructions(spark, sf_dir), lists=False)
    kinds = sum((F.col(f"n_{k}") > 0).cast("int") for k in ("xor", "add", "sub", "mul", "rotate", "shift", "and", "or"))
    total = sum(F.col(f"n_{k}") for k in ("xor", "add", "sub", "mul", "rotate", "shift", "and", "or"))
    mixed = (kinds >= 3) & (total >= 10)
    return counts.groupBy("file_id").agg(F.count_if(F.col("xor_count") >= 2).alias("nx"), F.count_if(F.col("rotation_count_x2") >= 2).alias("nr"), F.count_if(mixed).alias("nm"), F.count_if((F.col("arx_xor") >= 2) & (F.col("arx_add") >= 2) & (F.col("arx_rotate") >= 1)).alias("na"))


@query(_SCORES + " SELECT file_id, nx AS n_xor, nr AS n_rotation, nm AS n_mixing, round(score, 4) AS score, CASE WHEN score >= 0.9 THEN 'Very strong' WHEN score >= 0.7 THEN 'Strong' WHEN score >= 0.5 THEN 'Moderate' WHEN score >= 0.3 THEN 'Weak' ELSE 'Minimal' END AS assessment FROM l")
def likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pattern_counts(spark, sf_dir).withColumn("s", infer.likelihood(F.col("nx"), F.col("nr"), F.col("nm")))
    word = F.regexp_extract(classify.characteristics(F.col("s")), "^(Very strong|[A-Z][a-z]+)", 1)
    return rows.select("file_id", F.col("nx").alias("n_xor"), F.col("nr").alias("n_rotation"), F.col("nm").alias("n_mixing"), F.round("s", 4).alias("score"), word.alias("assessment"))


@query(_SCORES + ", z AS (SELECT file_id, nx + nr + na AS t, file_id + 1 AS g, file_id * 2 AS m FROM l) SELECT file_id, round(least(0.2::DOUBLE + CASE WHEN m >= 10 THEN 0.25::DOUBLE WHEN m >= 5 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN t >= 15 THEN 0.20::DOUBLE WHEN t >= 10 THEN 0.10::DOUBLE ELSE 0 END + CASE WHEN g >= 5 AND t >= 5 THEN 0.15::DOUBLE ELSE 0 END, 1.0::DOUBLE), 4) AS score FROM z")
def aggregate_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pattern_counts(spark, sf_dir)
    return rows.select("file_id", F.round(infer.aggregate_score(F.lit(0.2), F.col("nx") + F.col("nr") + F.col("na"), F.col("file_id") + 1, F.col("file_id") * 2), 4).alias("score"))


@query("WITH c AS (SELECT p_partkey, p_brand, (p_retailprice - 900) / 100 AS conf FROM part), w AS (SELECT *, max(conf) OVER (PARTITION BY p_brand) AS top, row_number() OVER (PARTITION BY p_brand ORDER BY conf DESC, p_partkey) AS rn FROM c) SELECT p_partkey, p_brand, round(conf, 4) AS conf FROM w WHERE top < 0.9 OR rn = 1 OR conf >= 0.8")
def suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dominance inside each category, over parts by brand and price."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", ((F.col("p_retailprice") - 900) / 100).alias("conf"))
    return infer.dominate(rows, "p_brand", "conf", None, ("p_partkey",)).select("p_partkey", "p_brand", F.round("conf", 4).alias("conf"))


def _found(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return job.found_patterns(st.instructions(spark, sf_dir), st.loops(spark, sf_dir), st.loop_insn(spark, sf_dir))


@query("""WITH {FACTS}, c AS (SELECT file_id, func, count(*) FILTER (mnemonic IN ('mov', 'orr')) AS r, count(*) FILTER (mnemonic = 'ldr') AS ms, count(*) FILTER (mnemonic IN ('xor', 'eor')) AS x, count(*) FILTER (mnemonic IN ('ldr', 'mov') AND contains(op_str, '[')) AS m, count(*) AS n FROM linsn GROUP BY ALL),
fe AS (SELECT file_id, func, CASE WHEN r + ms // 4 >= 2 AND x >= 2 THEN least(0.90::DOUBLE, 0.70::DOUBLE + (r + ms // 4) * 0.05::DOUBLE) ELSE 0.65::DOUBLE END AS conf FROM c WHERE (r + ms // 4 >= 2 AND x >= 2) OR (r + ms // 4 >= 1 AND x >= 3)),
fl AS (SELECT file_id, bool_or(round(m / n::DOUBLE, 3) > 0.25) AS sbox, bool_or(round(m / n::DOUBLE, 3) < 0.15) AS arx, bool_or(round(m / n::DOUBLE, 3) BETWEEN 0.15 AND 0.25) AS hybrid FROM c WHERE n >= 20 GROUP BY file_id),
mg AS (SELECT DISTINCT file_id FROM (SELECT file_id, func FROM insn WHERE contains(op_str, '0x61707865') OR contains(op_str, '0x3320646e') GROUP BY ALL HAVING count(DISTINCT op_str) >= 2)),
f AS (SELECT i.file_id, coalesce(sbox, false) AS sbox, coalesce(arx, false) AS arx, coalesce(hybrid, false) AS hybrid, i.file_id IN (SELECT file_id FROM fe) AS fei, i.file_id IN (SELECT file_id FROM mg) AS magic FROM (SELECT DISTINCT file_id FROM insn) i LEFT JOIN fl USING (file_id)),
hc AS (SELECT file_id, func, arg_max(a, (ord, v)) AS a FROM (SELECT file_id, func, ord, v, CASE WHEN v IN (1779033703, 3144134277) THEN 'SHA-256' WHEN v IN (1732584193, 4023233417) THEN 'SHA-1' END AS a FROM (SELECT *, TRY_CAST('0x' || regexp_extract(op_str, '0x([0-9a-f]+)', 1) AS BIGINT) AS v FROM insn WHERE contains(op_str, '0x'))) WHERE a IS NOT NULL GROUP BY file_id, func HAVING count(DISTINCT v) >= 2),
lp AS (SELECT file_id, func, arg_min(n, loop_id) AS n FROM (SELECT file_id, func, loop_id, count(DISTINCT block) AS n FROM loops GROUP BY ALL HAVING count(DISTINCT block) BETWEEN 3 AND 20) GROUP BY ALL),
lr AS (SELECT file_id, func, CASE WHEN n BETWEEN 10 AND 12 THEN 10 WHEN n BETWEEN 13 AND 14 THEN 12 WHEN n BETWEEN 16 AND 17 THEN 16 WHEN n BETWEEN 18 AND 20 THEN 20 ELSE n END AS n FROM lp),
u AS (SELECT file_id, func, 'DES or Feistel-based cipher' AS algorithm, CASE WHEN sbox THEN least(0.98::DOUBLE, round(conf, 2) + 0.10::DOUBLE) ELSE round(conf, 2) END AS confidence, 'symmetric' AS category, 'feistel' AS structure FROM fe JOIN f USING (file_id)
 UNION ALL SELECT file_id, func, CASE WHEN magic THEN 'ChaCha20/Salsa20' ELSE 'ChaCha20/Salsa20/BLAKE2' END, CASE WHEN magic THEN CASE WHEN arx THEN 0.90 ELSE 0.85 END WHEN x >= 50 AND NOT fei AND arx THEN 0.75 WHEN x >= 50 AND NOT fei AND NOT sbox THEN 0.65 END::DOUBLE, 'symmetric', 'arx' FROM counts JOIN f USING (file_id) WHERE a >= 2 AND x >= 2 AND rot >= 1
 UNION ALL SELECT file_id, func, CASE WHEN fei THEN 'DES' ELSE 'AES or DES (S-box based cipher)' END, CASE WHEN sbox THEN least(0.98::DOUBLE, b + 0.10::DOUBLE) ELSE b END, 'symmetric', CASE WHEN fei THEN 'feistel' ELSE 'spn' END FROM (SELECT *, CASE WHEN fei THEN least(0.95::DOUBLE, (CASE WHEN t >= 8 THEN 0.80 ELSE 0.65 END)::DOUBLE + 0.15::DOUBLE) ELSE (CASE WHEN t >= 8 THEN 0.80 ELSE 0.65 END)::DOUBLE END AS b FROM counts JOIN f USING (file_id) WHERE t >= 2)
 UNION ALL SELECT file_id, func, CASE n WHEN 10 THEN 'AES-128' WHEN 12 THEN 'AES-192' WHEN 16 THEN CASE WHEN fei THEN 'DES' ELSE 'DES or AES' END WHEN 20 THEN 'ChaCha20/Salsa20' ELSE 'Unknown cipher (' || n || ' rounds)' END, 0.70::DOUBLE, 'symmetric', NULL FROM lr JOIN f USING (file_id)
 UNION ALL SELECT file_id, func, 'RSA or ECC', (CASE WHEN mul >= 10 THEN 0.75 ELSE 0.65 END)::DOUBLE, 'asymmetric', NULL FROM counts WHERE mul >= 3 AND div >= 1
 UNION ALL SELECT file_id, func, a, 0.85::DOUBLE, 'hash', NULL FROM hc),
v AS (SELECT u.file_id, func, algorithm, category, structure, round(CASE WHEN arx AND NOT hybrid AND structure = 'arx' THEN least(0.95::DOUBLE, confidence + 0.10::DOUBLE) WHEN NOT (arx AND NOT hybrid) AND sbox AND NOT hybrid AND structure = 'arx' AND NOT magic THEN greatest(0.50::DOUBLE, confidence - 0.20::DOUBLE) ELSE confidence END, 4) AS confidence FROM u JOIN f USING (file_id) WHERE confidence IS NOT NULL AND NOT (arx AND NOT hybrid AND contains(algorithm, 'S-box'))),
w AS (SELECT *, max(confidence) OVER (PARTITION BY file_id, category) AS top, row_number() OVER (PARTITION BY file_id, category ORDER BY confidence DESC, algorithm, func) AS rn FROM v)
SELECT file_id, func, algorithm, confidence, category, structure FROM w WHERE top < 0.90 OR rn = 1 OR confidence >= 0.80""")
def infer_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All detectors, their candidates, conflict resolution and suppression."""
    return infer.inferred(_found(spark, sf_dir)).drop("evidence")


_PROTOCOLS = " UNION ALL ".join(f"SELECT '{p}' AS protocol, '{k}' AS keyword, {i} AS ord" for p, keys in report.PROTOCOLS.items() for i, k in enumerate(keys))


@query(f"WITH p AS ({_PROTOCOLS}), e AS (SELECT DISTINCT conv_id, protocol, keyword, ord FROM conversations JOIN p ON contains(lower(text), lower(keyword))), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY protocol, ord) AS rn FROM e) SELECT conv_id, string_agg(DISTINCT protocol, ',' ORDER BY protocol) AS protocols, count(DISTINCT protocol)::BIGINT AS n_protocols, string_agg('Found ''' || keyword || ''' in binary strings', '; ' ORDER BY rn) FILTER (rn <= 10) AS evidence FROM r GROUP BY conv_id")
def protocol_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Protocols of each conversation, from the keywords in its turns."""
    return report.protocols(report.protocol_evidence(table(spark, sf_dir, "conversations"), report.protocol_table(spark), "conv_id", "text"), "conv_id")


@query("SELECT DISTINCT p_partkey AS span, event_type AS tag FROM part JOIN events ON user_id * 7 >= p_partkey AND user_id * 7 < p_partkey + p_size")
def range_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points inside intervals: tags of functions whose range holds a match."""
    spans = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("span"), F.col("p_partkey").alias("lo"), (F.col("p_partkey") + F.col("p_size")).alias("hi"))
    return inventory.range_tags(table(spark, sf_dir, "events").select((F.col("user_id") * 7).alias("at"), F.col("event_type").alias("tag")), spans, 50)


_NEIGHBOURS = "WITH r AS (SELECT p_partkey AS addr, p_size AS size, row_number() OVER (ORDER BY p_partkey) AS k FROM part) SELECT x.addr AS a, y.addr AS b, y.size AS size_b FROM r x JOIN r y ON abs(x.k - y.k) BETWEEN 1 AND 5 AND abs(x.addr - y.addr) < 2000 AND y.size < 30"


@query("WITH r AS (SELECT p_partkey % 7 AS f, p_partkey AS addr, p_size AS size, row_number() OVER (PARTITION BY p_partkey % 7 ORDER BY p_partkey) AS k FROM part) SELECT x.f AS file_id, x.addr AS a, y.addr AS b, y.size AS size_b FROM r x JOIN r y ON x.f = y.f AND abs(x.k - y.k) BETWEEN 1 AND 5 AND abs(x.addr - y.addr) < 2000 AND y.size < 30")
def proximity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions close by in rank and address."""
    return inventory.proximity_pairs(table(spark, sf_dir, "part").select((F.col("p_partkey") % 7).alias("file_id"), F.col("p_partkey").alias("addr"), F.col("p_size").alias("size")), size=30)


@query("WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS src, l_partkey % 100 AS dst FROM lineitem), r(root, node, depth) AS (SELECT s_suppkey, s_suppkey, 0 FROM supplier UNION SELECT r.root, e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 3) SELECT root, node, min(depth)::INT AS depth FROM r GROUP BY ALL")
def call_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each function reaches over call edges in three steps."""
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 100).alias("dst"))
    return inventory.reachable(edges, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("root")), 3, None)


_COUNTED = "count(*)::BIGINT AS n_calls, sum(cost) AS total_cost"


@query(f"WITH {{FACTS}} SELECT model, provider, {_COUNTED}, CASE WHEN grouping(model) = 0 THEN 'model' WHEN grouping(provider) = 0 THEN 'provider' ELSE 'total' END AS level FROM calls GROUP BY GROUPING SETS ((), (model), (provider))")
def cost_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs in all, by model and by provider in one pass."""
    return ledger.cost_levels(st.calls(spark, sf_dir))


@query("WITH {FACTS} SELECT model, count(*)::BIGINT AS total_calls, count(*) FILTER (success)::BIGINT AS successful_calls, count(*) FILTER (NOT success)::BIGINT AS failed_calls, count(*) FILTER (success) / count(*)::DOUBLE AS success_rate, round(avg(duration_seconds), 6) AS average_duration, sum(duration_seconds) AS total_duration, round(sum(cost) / count(*), 6) AS avg_cost_per_call FROM calls GROUP BY model")
def call_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ledger.call_statistics(st.calls(spark, sf_dir), ["model"])
    return s.withColumn("average_duration", F.round("average_duration", 6)).withColumn("avg_cost_per_call", F.round("avg_cost_per_call", 6))


@query("WITH {FACTS} SELECT model, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(input_tokens + output_tokens)::BIGINT AS total_tokens FROM calls GROUP BY model")
def token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.token_usage(st.calls(spark, sf_dir), ["model"])


@query("WITH {FACTS}, p(model, prov, a, b) AS (VALUES ('view', 'x', 0.0008::DOUBLE, 0.004::DOUBLE), ('click', 'y', 0.015::DOUBLE, 0.075::DOUBLE)) SELECT model, coalesce(prov, 'unknown') AS provider, round(sum(coalesce(input_tokens / 1000 * a + output_tokens / 1000 * b, 0)), 4) AS total_cost FROM calls LEFT JOIN p USING (model) GROUP BY ALL")
def cost_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls priced by a price table; unknown models cost nothing."""
    prices = spark.createDataFrame([("view", "x", 0.0008, 0.004), ("click", "y", 0.015, 0.075)], "model string, provider string, price_in double, price_out double")
    return ledger.priced(st.calls(spark, sf_dir), prices).groupBy("model", "provider").agg(F.round(F.sum("cost"), 4).alias("total_cost"))


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'main_analyzer' WHEN 1 THEN 'long_context_analyzer' WHEN 2 THEN 'reasoning_model' ELSE 'quick_classifier' END AS chosen, CASE event_type WHEN 'view' THEN 'quick_classifier' WHEN 'click' THEN 'reasoning_model' ELSE 'main_analyzer' END AS cheapest FROM events")
def model_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model by attempt, and by kind of analysis."""
    kind = F.when(F.col("event_type") == "view", "quick_classify").when(F.col("event_type") == "click", "reasoning").otherwise("other")
    return table(spark, sf_dir, "events").select("event_id", ledger.select_model(kind, F.col("event_id") % 6).alias("chosen"), ledger.cheapest_model(kind).alias("cheapest"))


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("props").alias("value"), F.col("event_id").alias("ts"), (F.col("user_id") * 40).alias("ttl"))


_CACHE = "WITH e AS (SELECT user_id AS key, arg_max(props, event_id) AS value, max(event_id) AS ts, any_value(user_id) * 40 AS ttl FROM events GROUP BY user_id), n AS (SELECT max(event_id) AS now FROM events), l AS (SELECT e.* FROM e, n WHERE now - ts <= ttl)"


def _now(spark: SparkSession, sf_dir: str):
    return F.lit(table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0])


@query(_CACHE + " SELECT c_custkey, key, value, 0.0::DOUBLE AS billed_cost FROM customer JOIN l ON key = c_custkey")
def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.cache_hits(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").alias("key")), _cache(spark, sf_dir), _now(spark, sf_dir))


@query(_CACHE + " SELECT c_custkey, c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT key FROM l)")
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.cache_misses(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").alias("key")), _cache(spark, sf_dir), _now(spark, sf_dir))


@query(_CACHE + " SELECT key, value, ts, ttl FROM (SELECT *, row_number() OVER (PARTITION BY key % 20 ORDER BY ts, key) AS rn, greatest(count(*) OVER (PARTITION BY key % 20) // 3, 1) AS gone FROM e) WHERE rn > gone")
def cache_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest third of each cache shard goes."""
    return ledger.evicted(ledger.latest(_cache(spark, sf_dir)).withColumn("shard", F.col("key") % 20), "shard").drop("shard")


@query(_CACHE + " SELECT count(*)::BIGINT AS entries, sum(length(value))::BIGINT AS bytes FROM l")
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.cache_stats(ledger.cleaned(_cache(spark, sf_dir), _now(spark, sf_dir)))


@query("""WITH RECURSIVE i AS (SELECT conv_id, turn, floor(length(text) / 3.5::DOUBLE)::BIGINT AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
g(conv_id, turn, t, rn, n, held) AS (SELECT conv_id, turn, t, rn, 1, CASE WHEN t > 200 THEN 201 ELSE t END FROM i WHERE rn = 1
 UNION ALL SELECT i.conv_id, i.turn, i.t, i.rn, CASE WHEN i.t > 200 OR g.held + i.t > 200 THEN g.n + 1 ELSE g.n END, CASE WHEN i.t > 200 THEN 201 WHEN g.held + i.t > 200 THEN i.t ELSE g.held + i.t END FROM g JOIN i ON i.conv_id = g.conv_id AND i.rn = g.rn + 1)
SELECT conv_id, turn, t AS tokens, n AS batch_number, max(n) OVER (PARTITION BY conv_id) AS total_batches, count(*) OVER (PARTITION BY conv_id, n)::BIGINT AS items_in_batch, sum(t) OVER (PARTITION BY conv_id, n)::BIGINT AS estimated_tokens FROM g""")
def token_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of each conversation packed greedily under 200 tokens."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.estimated_tokens(F.col("text")).alias("tokens"))
    return ledger.token_batches(turns, 200, "conv_id", "turn")


@query("SELECT conv_id, turn, ((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3)::BIGINT AS chunk FROM conversations")
def chunk_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.chunks(table(spark, sf_dir, "conversations").select("conv_id", "turn"), 3, "conv_id", ["turn"])


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'parsed' WHEN event_id % 3 = 1 THEN 'repaired' ELSE 'fallback' END AS how, CASE WHEN event_id % 3 = 2 THEN NULL ELSE CAST(json_extract(props, '$.k') AS INT) END AS k FROM events")
def json_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole, cut-off and hopeless JSON texts."""
    raw = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Here it is:\n```json\n{\"a\": [1, "), F.col("props"), F.lit(", \"cut"))).otherwise("no json")
    fixed = jsonfix.checked(table(spark, sf_dir, "events").select("event_id", raw.alias("raw")), "raw", "null")
    whole = F.get_json_object("json", "$.k")
    return fixed.select("event_id", "how", F.coalesce(whole, F.get_json_object("json", "$.a[1].k")).cast("int").alias("k"))


_DEEP, _QUICK = "|".join(report.TRIAGE_DEEP), "|".join(report.TRIAGE_QUICK)


@query(f"SELECT doc_id, CASE WHEN regexp_matches(lower(text), '{_DEEP}') THEN 'deep' WHEN regexp_matches(lower(text), '{_QUICK}') THEN 'quick' ELSE 'skip' END AS route, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def triage_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", report.triage(F.col("text")).alias("route"))
    return docs.join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")


_VULN = "v AS (SELECT p_partkey // 2 AS file_id, p_partkey, CASE p_size % 8 WHEN 0 THEN 'DES' WHEN 1 THEN 'RC4' WHEN 2 THEN 'MD5' WHEN 3 THEN 'AES-CBC' WHEN 4 THEN 'AES-256-GCM' WHEN 5 THEN 'SHA-256' ELSE 'other' END AS algorithm FROM part), s AS (SELECT *, CASE WHEN algorithm IN ('DES', 'RC4') THEN 'critical' WHEN algorithm = 'MD5' THEN 'high' WHEN algorithm = 'AES-CBC' THEN 'medium' END AS severity FROM v)"


def _algorithms(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*(F.lit(a) for a in ("DES", "RC4", "MD5", "AES-CBC", "AES-256-GCM", "SHA-256", "other", "other")))
    rows = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 2).alias("file_id"), "p_partkey", F.get(names, (F.col("p_size") % 8).cast("int")).alias("algorithm"))
    return rows.withColumn("severity", report.severity_of(F.col("algorithm")))


@query(f"WITH {_VULN}, l AS (SELECT file_id, sum(CASE severity WHEN 'critical' THEN 50 WHEN 'high' THEN 25 WHEN 'medium' THEN 10 ELSE 0 END) AS lost, max((algorithm IN ('AES-256-GCM', 'SHA-256'))::INT) * 10 + max((algorithm = 'AES-256-GCM')::INT) * 10 AS won FROM s GROUP BY file_id) SELECT file_id, greatest(0, least(100, 100 - lost + won))::BIGINT AS security_score FROM l")
def security_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _algorithms(spark, sf_dir)
    return report.security_score(rows.filter("severity IS NOT NULL"), rows)


@query(f"WITH {_VULN} SELECT file_id, p_partkey, algorithm, severity, row_number() OVER (PARTITION BY file_id ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 ELSE 2 END, p_partkey)::BIGINT AS ord FROM s WHERE severity IS NOT NULL")
def severity_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.by_severity(_algorithms(spark, sf_dir).filter("severity IS NOT NULL"), "file_id", ("p_partkey",))


@query("WITH r AS (SELECT p_partkey % 50 AS file_id, CASE WHEN p_size % 3 = 0 THEN 'AES' WHEN p_size % 3 = 1 THEN 'AES-256' ELSE 'RSA' END AS algorithm, (p_size / 100.0::DOUBLE) AS confidence, p_type AS evidence FROM part), g AS (SELECT file_id, regexp_extract(algorithm, '^[A-Z]+') AS family, arg_max(algorithm, length(algorithm)) AS algorithm, max(confidence) AS confidence, string_agg(DISTINCT evidence, '; ' ORDER BY evidence) AS evidence, count(*)::BIGINT AS n_merged FROM r GROUP BY ALL) SELECT * FROM g")
def merge_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several names of one family become the most specific one, with all their evidence."""
    name = F.when(F.col("p_size") % 3 == 0, "AES").when(F.col("p_size") % 3 == 1, "AES-256").otherwise("RSA")
    rows = table(spark, sf_dir, "part").select((F.col("p_partkey") % 50).alias("file_id"), name.alias("algorithm"), (F.col("p_size") / 100).alias("confidence"), F.col("p_type").alias("evidence"))
    return infer.merged(rows, F.regexp_extract("algorithm", "^[A-Z]+", 0))


@query("WITH {FACTS}, f AS (SELECT *, CASE WHEN nodes = 0 THEN 0 WHEN edges IS NULL THEN num_blocks ELSE greatest(edges - nodes + 2, 0) END AS cc FROM fn) SELECT file_id, addr, cc AS complexity FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY cc DESC, addr) AS rn FROM f) WHERE rn <= 50")
def prune_for_llm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes to the model: few columns, and at most 50 rows of a file."""
    rows = st.functions(spark, sf_dir).withColumn("complexity", tx.complexity(F.col("edges"), F.col("nodes"), F.col("num_blocks")))
    return inventory.capped(rows.select("file_id", "addr", "complexity"), 50, [F.desc("complexity"), "addr"])


@query("WITH {FACTS}, g AS (SELECT DISTINCT file_id, func % 5 AS root, func FROM insn), rf AS (SELECT *, row_number() OVER (PARTITION BY file_id, root ORDER BY func) AS k FROM g), c AS (SELECT r.file_id, root, count(*) FILTER (mnemonic = 'xor') AS xor_count, count(*) FILTER (mnemonic = 'ror') AS rotation_count, count(*) FILTER (mnemonic = 'ldr' AND contains(op_str, '[')) AS lookup_count, count(*) FILTER (mnemonic = 'lsl') AS shift_count, count(*) FILTER (mnemonic IN ('and', 'orr', 'eor')) - count(*) FILTER (mnemonic = 'eor') + count(*) FILTER (mnemonic = 'eor') AS and_or_count, count(*) FILTER (mnemonic = 'udiv') AS mod_count FROM rf r JOIN insn i ON i.file_id = r.file_id AND i.func = r.func WHERE k <= 10 GROUP BY ALL) SELECT file_id, root, xor_count, rotation_count, lookup_count, shift_count, and_or_count, mod_count, round(least((xor_count > 10)::INT * 0.3::DOUBLE + (rotation_count > 5)::INT * 0.25::DOUBLE + (lookup_count > 3)::INT * 0.2::DOUBLE + (shift_count > 15)::INT * 0.15::DOUBLE + (and_or_count > 20)::INT * 0.1::DOUBLE, 1.0::DOUBLE), 2) AS crypto_score FROM c")
def group_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six-class counts and the score of function groups."""
    insn = st.instructions(spark, sf_dir)
    groups = insn.select("file_id", (F.col("func") % 5).alias("root"), "func").distinct()
    return detect.group_counts(insn.drop("block"), groups, per_block=1 << 30).select("file_id", "root", "xor_count", "rotation_count", "lookup_count", "shift_count", "and_or_count", "mod_count", "crypto_score")


@query("""WITH RECURSIVE {FACTS}, real AS (SELECT file_id, addr, size, row_number() OVER (PARTITION BY file_id ORDER BY addr) AS k FROM fn WHERE NOT is_simproc),
e AS (SELECT DISTINCT l_partkey % 7 AS file_id, l_partkey * 100 AS src, (l_partkey + 7 * (l_orderkey % 4)) * 100 AS dst FROM lineitem),
c AS (SELECT e.*, d.size AS dst_size FROM e JOIN real d ON d.file_id = e.file_id AND d.addr = e.dst JOIN real s ON s.file_id = e.file_id AND s.addr = e.src),
steps AS MATERIALIZED (SELECT file_id, src, dst FROM c WHERE dst_size < 1000 UNION SELECT file_id, dst, src FROM c WHERE dst_size < 500
  UNION SELECT x.file_id, x.addr, y.addr FROM real x JOIN real y ON x.file_id = y.file_id AND abs(x.k - y.k) BETWEEN 1 AND 5 AND abs(x.addr - y.addr) < 2000 AND y.size < 300 WHERE x.size < 200),
turns AS MATERIALIZED (SELECT * FROM (SELECT file_id, addr, NOT is_plt AND NOT is_simproc AS able, row_number() OVER (PARTITION BY file_id ORDER BY addr) AS k, is_blob FROM fn) WHERE k <= CASE WHEN is_blob THEN 100 ELSE 300 END),
one AS MATERIALIZED (SELECT file_id, src, list(dst) AS ds FROM steps GROUP BY ALL),
g(file_id, k, root, own, taken) AS (SELECT DISTINCT file_id, 0::BIGINT, NULL::BIGINT, []::BIGINT[], []::BIGINT[] FROM turns
  UNION ALL SELECT file_id, k, root, own, list_concat(taken, own) FROM (
    SELECT z.file_id, z.k, z.root, z.taken, list_distinct(list_concat(list_concat([z.root], z.n1), list_concat(z.n2, coalesce((SELECT list_distinct(flatten(list(list_filter(ds, lambda d: NOT list_contains(z.taken, d))))) FROM one WHERE one.file_id = z.file_id AND list_contains(z.n2, src)), [])))) AS own FROM (
      SELECT y.*, coalesce((SELECT list_distinct(flatten(list(list_filter(ds, lambda d: NOT list_contains(y.taken, d))))) FROM one WHERE one.file_id = y.file_id AND list_contains(y.n1, src)), []) AS n2 FROM (
        SELECT x.*, coalesce((SELECT list_distinct(flatten(list(list_filter(ds, lambda d: NOT list_contains(x.taken, d))))) FROM one WHERE one.file_id = x.file_id AND src = x.root), []) AS n1 FROM (
          SELECT g.file_id, g.k + t.skip AS k, t.addr AS root, g.taken FROM g JOIN LATERAL (SELECT min(k) - g.k AS skip, arg_min(addr, k) AS addr FROM turns WHERE turns.file_id = g.file_id AND turns.k > g.k AND able AND NOT list_contains(g.taken, addr)) t ON true WHERE t.addr IS NOT NULL) x) y) z))
SELECT file_id, root, unnest(own) AS func FROM g WHERE len(own) >= 2""")
def function_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters over calls and neighbourhood, grown in order of address through functions that are in none yet."""
    fn = st.functions(spark, sf_dir)
    edges = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 7).alias("file_id"), (F.col("l_partkey") * 100).alias("src"), ((F.col("l_partkey") + 7 * (F.col("l_orderkey") % 4)) * 100).alias("dst"))
    return inventory.function_clusters(fn, edges)
