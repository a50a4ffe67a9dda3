"""More registered queries: scans of sections, links between findings, summaries and cost roll-ups, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evidentia.functions import classify, text as tx
from evidentia.operators import detect, inventory, job, ledger, report, scan
from evidentia.plans import catalogue, standins as st
from evidentia.plans.catalogue import ORACLE, query
from evidentia.session import table

#: Patterns that pages hold, under names that the classification knows.
_SIGNATURES = {"AES_SBOX_FIRST_BYTES": b"href", "CHACHA20_SIGMA": b"<nav>", "SHA256_K_FIRST": b"<script", "MD5_INIT_A": "é".encode(), "RC4_INIT_PATTERN": b"no page has this"}
_NAMED = "(VALUES ('AES_SBOX_FIRST_BYTES', 'href', 'AES'), ('CHACHA20_SIGMA', '<nav>', 'ChaCha20/Salsa20'), ('SHA256_K_FIRST', '<script', 'SHA-256'), ('MD5_INIT_A', 'é', 'MD5'), ('RC4_INIT_PATTERN', 'no page has this', 'RC4')) AS t(name, p, algorithm)"


@query(f"""WITH a AS (SELECT page_id AS file_id, '.data' AS section, name, algorithm, page_id * 1000 + octet_length(encode(substr(html, 1, (instr(html, p) - 1)::INT))) AS address
FROM pages JOIN {_NAMED} ON contains(html, p)) SELECT file_id, section, name, algorithm, address::BIGINT AS address, '0x' || lower(to_hex(address)) AS "offset" FROM a""")
def signature_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each signature's first byte in each section, at any place; pages are the sections."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("file_id"), F.lit(".data").alias("name"), (F.col("page_id") * 1000).alias("vaddr"), F.col("html").cast("binary").alias("data"))
    return scan.signature_scan(pages, scan.signature_table(spark, {k: v.hex() for k, v in _SIGNATURES.items()}))


def _text_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    return rows.select(F.floor(F.col("doc_id") / 2).alias("file_id"), F.lit(".rodata").alias("name"), F.col("doc_id").alias("vaddr"), F.col("text").cast("binary").alias("data"))


@query(f"""WITH r AS (SELECT doc_id, unnest(r) AS s, unnest(generate_series(1, len(r))) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '[\\x20-\\x7e]{{4,}}') AS r FROM documents)),
k AS (SELECT doc_id // 2 AS file_id, s, row_number() OVER (PARTITION BY doc_id // 2 ORDER BY doc_id, pos) AS ord, count(*) OVER (PARTITION BY doc_id // 2) AS total FROM r WHERE regexp_matches(lower(s), '{catalogue.KEYS}'))
SELECT file_id, '.rodata' AS section, ord::INT AS ord, s AS string, total::BIGINT AS total_found FROM k WHERE ord <= 100""")
def interesting_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 100 keyword strings of each file, over its sections in order of address."""
    return scan.interesting_strings(_text_sections(spark, sf_dir))


@query(f"""SELECT file_id, '.data' AS section, "offset", size, hexed, CASE size WHEN 8 THEN 'DES key or IV' WHEN 16 THEN 'AES-128 key or IV' WHEN 24 THEN '3DES or AES-192 key' ELSE 'AES-256 key or ChaCha20 key' END AS key_type, ord::INT AS ord, total_found, true AS has_hardcoded_keys
FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY "offset") AS ord, count(*) OVER (PARTITION BY file_id)::BIGINT AS total_found FROM ({ORACLE["key_candidates"]})) WHERE ord <= 10""")
def first_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten key candidates of each file: the cap is the feature; total_found counts all."""
    return scan.first_key_windows(catalogue.key_sections(spark, sf_dir))


@query("""WITH a AS (SELECT p_partkey AS file_id, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_type END AS arch, p_size AS bits FROM part), b AS (SELECT s_suppkey * 2 AS file_id, s_name AS arch, NULL::INT AS bits FROM supplier)
SELECT coalesce(a.file_id, b.file_id) AS file_id, coalesce(a.arch, b.arch, 'Unknown') AS arch, coalesce(a.bits::VARCHAR, b.bits::VARCHAR, 'Unknown') AS bits FROM a FULL JOIN b ON a.file_id = b.file_id""")
def forced_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was extracted counts, else what was reported, else 'Unknown'."""
    extracted = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file_id"), F.when(F.col("p_size") % 3 != 0, F.col("p_type")).alias("arch"), F.col("p_size").alias("bits"))
    reported = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 2).alias("file_id"), F.col("s_name").alias("arch"), F.lit(None).cast("int").alias("bits"))
    return inventory.forced(extracted, reported, ["arch", "bits"])


@query("""WITH {FACTS}, g AS (SELECT DISTINCT file_id, func % 9 AS root, func FROM insn WHERE file_id NOT IN (SELECT file_id FROM fn)),
l AS (SELECT file_id, root FROM (SELECT file_id, root, row_number() OVER (PARTITION BY file_id ORDER BY count(*) DESC, root) AS rn FROM g GROUP BY file_id, root) WHERE rn <= 5),
m AS (SELECT DISTINCT g.file_id, func AS addr FROM g JOIN l ON g.file_id = l.file_id AND g.root = l.root)
SELECT file_id, addr FROM fn UNION ALL SELECT file_id, addr FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY addr) AS rn FROM m) WHERE rn <= 20""")
def functions_from_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files without an extracted function get those of their largest groups."""
    groups = st.instructions(spark, sf_dir).select("file_id", (F.col("func") % 9).alias("root"), "func").distinct()
    return inventory.functions_from_groups(st.functions(spark, sf_dir).select("file_id", "addr"), groups)


@query("""WITH a AS (SELECT DISTINCT p_partkey % 50 AS file_id, p_brand AS algorithm FROM part), f AS (SELECT p_partkey % 50 AS file_id, lower(p_brand) AS k, string_agg(DISTINCT p_name, ',' ORDER BY p_name) AS functions FROM part WHERE p_size % 2 = 0 GROUP BY ALL),
v AS (SELECT p_partkey % 50 AS file_id, lower(p_brand) AS k, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS vulnerabilities FROM part WHERE p_size % 3 = 0 GROUP BY ALL)
SELECT a.file_id, algorithm, functions, vulnerabilities FROM a LEFT JOIN f ON f.file_id = a.file_id AND f.k = lower(algorithm) LEFT JOIN v ON v.file_id = a.file_id AND v.k = lower(algorithm)""")
def linked_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Algorithms with the functions and vulnerabilities of the same name, whatever its case and outer blanks."""
    part = table(spark, sf_dir, "part").withColumn("file_id", F.col("p_partkey") % 50)
    functions = part.filter("p_size % 2 = 0").select("file_id", F.concat(F.lit(" "), F.upper("p_brand")).alias("related_algorithm"), F.col("p_name").alias("name"))
    weak = part.filter("p_size % 3 = 0").select("file_id", F.lower("p_brand").alias("algorithm"), F.col("p_type").alias("type"))
    out = report.linked(part.select("file_id", F.col("p_brand").alias("algorithm")).distinct(), functions, weak)
    return out.select("file_id", "algorithm", F.array_join("functions", ",").alias("functions"), F.array_join("vulnerabilities", ",").alias("vulnerabilities"))


def _word_sections(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as sections of 100,000 addresses each that hold hash words and the magic string before, between and behind their text's bytes; and suppliers
    as functions of all sizes, anywhere in the documents' addresses."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    words = F.unhex(F.lit("67e6096a85ae67bb" + detect.MAGIC.hex()))
    data = F.concat(F.substring(text, 1, 700), words, F.expr("substring(cast(coalesce(text, '') AS binary), 701)"), words)
    sections = docs.select((F.col("doc_id") % 10).alias("file_id"), (F.col("doc_id") * 100_000).alias("vaddr"), data.alias("data"))
    key = F.col("s_suppkey")
    at = (key % 100) * 100_000 + (key * 7919) % 4_000
    return sections, table(spark, sf_dir, "supplier").select(((key % 100) % 10).alias("file_id"), key.alias("func"), at.alias("addr"), (key % 300).cast("int").alias("size"))


# The words stand behind the first 700 bytes of a text, or all of it, and at its end; a section starts at its document's number times 100,000.
_PLACED = """d AS (SELECT doc_id, doc_id * 100000 AS base, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id % 10 AS file_id, base + least(n, 700) AS place FROM d UNION ALL SELECT doc_id % 10, base + n + 24 FROM d),
s AS (SELECT (s_suppkey % 100) % 10 AS file_id, s_suppkey AS func, (s_suppkey % 100) * 100000 + (s_suppkey * 7919) % 4000 AS addr, s_suppkey % 300 AS size FROM supplier)"""


@query(f"""WITH {_PLACED}, v AS (SELECT file_id, 1779033703 AS value, place AS address FROM w UNION ALL SELECT file_id, 3144134277, place + 4 FROM w)
SELECT DISTINCT s.file_id, func, value::BIGINT AS value, address FROM s JOIN v ON v.file_id = s.file_id AND address >= addr - 500 AND address < addr + size + 500 AND (address - (addr - 500)) % 4 = 0""")
def nearby_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash words close to functions, on the function's grid of four bytes."""
    return detect.nearby_words(*_word_sections(spark, sf_dir), [0x6A09E667, 0xBB67AE85, 0x67452301])


@query(f"""WITH {{FACTS}}, {_PLACED}, m AS (SELECT file_id, func FROM insn WHERE contains(op_str, '0x61707865') OR contains(op_str, '0x3320646e') GROUP BY ALL HAVING count(DISTINCT regexp_extract(op_str, '0x([0-9a-f]+)', 1)) >= 2)
SELECT file_id, func FROM m UNION SELECT s.file_id, func FROM s JOIN w ON w.file_id = s.file_id AND place + 8 >= addr - 1000 AND place + 8 < addr + size + 1000""")
def magic_near_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions with two magic words as operands, or with the whole magic string starting at most 1000 bytes off."""
    return detect.magic_constants(st.instructions(spark, sf_dir), detect.nearby_strings(*_word_sections(spark, sf_dir)))


@query(f"WITH {_PLACED} SELECT DISTINCT s.file_id, func FROM s JOIN w ON w.file_id = s.file_id AND place + 8 >= addr - 1000 AND place + 8 < addr + size + 1000")
def nearby_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions with the whole magic string starting at most 1000 bytes off."""
    return detect.nearby_strings(*_word_sections(spark, sf_dir))


# Every pattern of every rule as bytes that it fits: unknown bytes are aa, unknown halves a, jumps are zeros; texts in mixed case where it does not count.
def _planted(pattern: str) -> str:
    kind, _, rest = pattern.partition(":")
    if kind == "regex":
        return "ab" * 300
    if kind in ("text", "nocase"):
        return (rest.swapcase() if kind == "nocase" else rest).encode().hex()
    return "".join("00" * int(t[1:-1]) if t[0] == "[" else t.replace("?", "a") for t in pattern.split())


def _hex_regex(pattern: str) -> str:
    """A pattern over bytes written as two digits and a blank each."""
    kind, _, rest = pattern.partition(":")
    if kind == "regex":
        return "(?:.. ){256,}"
    if kind == "text":
        return "".join(f"{b:02X} " for b in rest.encode())
    if kind == "nocase":
        return "".join(f"(?:{ord(c.upper()):02X}|{ord(c.lower()):02X}) " for c in rest)
    return "".join(f"(?:.. ){{{t[1:-1]}}}" if t[0] == "[" else t.upper().replace("?", ".") + " " for t in pattern.split())


#: Document i gets the patterns of rule i modulo this behind its text, each after a byte fe; one in so many gets none.
_PLANTS = len(scan.RULES) + 1
_RULE_BYTES = {i: "".join("fe" + _planted(p) for p in r[5].values()) for i, r in enumerate(scan.RULES)}


def _crypto_rules_sql() -> str:
    plants = " ".join(f"WHEN {i} THEN '{h.upper()}'" for i, h in _RULE_BYTES.items())
    counts = ", ".join(f"len(regexp_extract_all(h, '{_hex_regex(p)}')) AS c{i}_{k}" for i, r in enumerate(scan.RULES) for k, p in enumerate(r[5].values()))
    found = []
    for i, (name, algorithm, severity, kind, n, patterns) in enumerate(scan.RULES):
        held = " + ".join(f"(c{i}_{k} > 0)::INT" for k in range(len(patterns)))
        total = " + ".join(f"c{i}_{k}" for k in range(len(patterns)))
        fires = {"any": f"{held} >= 1", "all": f"{held} = {len(patterns)}", "n_of": f"{held} >= {n}", "count_over": f"{total} > {n}"}[kind]
        found.append(f"SELECT doc_id AS file_id, '{name}' AS rule, '{algorithm}' AS algorithm, '{severity}' AS severity, ({total})::BIGINT AS match_count FROM c WHERE {fires}")
    return f"""WITH b AS (SELECT doc_id, regexp_replace(hex(encode(coalesce(text, ''))) || CASE doc_id % {_PLANTS} {plants} ELSE '' END, '(..)', '\\1 ', 'g') AS h FROM documents),
c AS MATERIALIZED (SELECT doc_id, {counts} FROM b) {" UNION ALL ".join(found)}"""


@query(_crypto_rules_sql())
def crypto_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole rule list over every document's bytes, with each rule's patterns planted behind some of them."""
    planted = F.create_map(*(F.lit(x) for i, h in _RULE_BYTES.items() for x in (i, h)))[(F.col("doc_id") % _PLANTS).cast("int")]
    data = F.concat(F.coalesce(F.col("text"), F.lit("")).cast("binary"), F.unhex(F.coalesce(planted, F.lit(""))))
    return scan.rule_scan(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), data.alias("data")), *scan.rule_tables(spark))


@query("""WITH {FACTS}, c AS (SELECT event_id % 100 AS file_id, model AS stage, cost, duration_seconds AS d FROM calls), g AS (SELECT file_id, stage, count(*)::BIGINT AS n_calls, sum(cost) AS cost, sum(d) AS duration_seconds FROM c GROUP BY GROUPING SETS ((file_id), (file_id, stage)))
SELECT file_id, stage, n_calls, cost, duration_seconds, round(coalesce(cost / nullif(max(cost) FILTER (stage IS NULL) OVER (PARTITION BY file_id), 0), 0), 6) AS share FROM g""")
def stage_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each stage of a file's analysis cost, and the file in all."""
    calls = st.calls(spark, sf_dir).select((F.col("event_id") % 100).alias("file_id"), F.col("model").alias("stage"), "cost", "duration_seconds")
    return ledger.stage_costs(calls).withColumn("share", F.round("share", 6))


@query("SELECT conv_id, sum(floor(length(text) / 3.5::DOUBLE))::BIGINT AS tokens, count(*)::BIGINT AS functions, (sum(floor(length(text) / 3.5::DOUBLE)) > 800 OR count(*) > 50) AS batched FROM conversations GROUP BY conv_id")
def batch_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a job is cut into batches: over four fifths of the budget, or over 50 functions."""
    jobs = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(tx.estimated_tokens(F.col("text"))).alias("tokens"), F.count("*").alias("functions"))
    return jobs.withColumn("batched", ledger.should_batch(F.col("tokens"), F.col("functions"), 1000))


@query(f"""WITH g AS ({ORACLE["group_scores"]}) SELECT file_id, count(*)::BIGINT AS n_groups, count(*) FILTER (crypto_score >= 0.5)::BIGINT AS n_likely, max(crypto_score) AS best_score,
array_to_string(list_slice(list(root ORDER BY crypto_score DESC, root), 1, 5), ',') AS top FROM g GROUP BY file_id""")
def group_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of functions summed up by file."""
    return inventory.group_summary(catalogue.QUERIES["group_scores"](spark, sf_dir))


@query(f"""WITH t AS (SELECT p_partkey % 7 AS file_id, count(*) AS total FROM part GROUP BY ALL), k AS (SELECT file_id, count(*) AS n FROM ({ORACLE["function_extract"]}) GROUP BY file_id)
SELECT t.file_id, total::BIGINT AS total_functions, coalesce(n, 0)::BIGINT AS analyzed_count, (total - coalesce(n, 0))::BIGINT AS filtered_count, 3 AS min_complexity_threshold FROM t LEFT JOIN k ON t.file_id = k.file_id""")
def filtered_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many functions of each file were kept and how many filtered."""
    return inventory.filtered_counts(st.functions(spark, sf_dir), catalogue.QUERIES["function_extract"](spark, sf_dir))


@query("""WITH p AS (SELECT p_partkey % 60 AS file_id, ['AES-GCM', 'ECDHE', 'SHA-256', 'AES-CTR', 'DH', 'HMAC-SHA256', 'AES-CBC', 'IKE', 'RC4'][p_size % 9 + 1] AS a FROM part), h AS (SELECT file_id, list(DISTINCT a) AS have FROM p GROUP BY file_id),
c AS (SELECT file_id, protocol, len(list_filter(needs, lambda x: list_contains(have, x))) AS n, len(needs) AS k FROM h, (VALUES ('TLS 1.2/1.3', ['AES-GCM', 'ECDHE', 'SHA-256']), ('SSH', ['AES-CTR', 'DH', 'HMAC-SHA256']), ('IPSec', ['AES-CBC', 'HMAC-SHA256', 'IKE'])) AS t(protocol, needs))
SELECT file_id, protocol, round(least(n / k::DOUBLE, 0.89::DOUBLE), 2) AS confidence, CASE WHEN n = k THEN 'complete' WHEN n * 2 > k THEN 'partial' ELSE 'minimal' END AS implementation_status FROM c WHERE n / k::DOUBLE >= 0.40""")
def protocol_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Protocols by the share of their algorithms that a file has."""
    names = F.array(*(F.lit(a) for a in ("AES-GCM", "ECDHE", "SHA-256", "AES-CTR", "DH", "HMAC-SHA256", "AES-CBC", "IKE", "RC4")))
    rows = table(spark, sf_dir, "part").select((F.col("p_partkey") % 60).alias("file_id"), F.get(names, (F.col("p_size") % 9).cast("int")).alias("algorithm"))
    return report.protocols_by_algorithms(rows)


@query("""SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'OpenSSL' WHEN 1 THEN 'OpenSSL' WHEN 2 THEN 'mbedTLS' WHEN 3 THEN 'libsodium' WHEN 4 THEN 'wolfSSL' END AS library,
CASE WHEN p_size % 31 IN (16, 12, 8, 7) THEN 'ChaCha20 (signature rotations: 16, 12, 8, 7)' WHEN p_size % 31 IN (2, 13, 22, 6, 11, 25) THEN 'SHA-256 (signature rotations)' WHEN p_size % 31 IN (17) THEN 'MD5 (signature rotations)' ELSE 'unknown_arx_cipher' END AS family FROM part""")
def named_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The library by a function's prefix, and the family of algorithms by its rotations."""
    prefix = F.get(F.array(*(F.lit(p) for p in ("EVP_", "SSL_", "mbedtls_", "crypto_", "wc_", "main"))), (F.col("p_size") % 6).cast("int"))
    rows = table(spark, sf_dir, "part")
    return rows.select("p_partkey", report.library_of(F.concat(prefix, F.col("p_name"))).alias("library"), classify.rotation_family(F.array((F.col("p_size") % 31).cast("int"))).alias("family"))


def _analysis_sql(union: str) -> str:
    """SQL of the whole job, ``union`` being that of the inferred algorithms."""
    return f"""WITH f AS (SELECT DISTINCT s_suppkey % 12 AS file_id FROM supplier), s AS (SELECT (conv_id % 4) * 3 AS file_id, text FROM conversations),
r AS (SELECT f.file_id, min(CASE WHEN regexp_matches(lower(text), '{catalogue._DEEP}') THEN 1 WHEN regexp_matches(lower(text), '{catalogue._QUICK}') THEN 2 ELSE 3 END) AS k FROM f LEFT JOIN s USING (file_id) GROUP BY f.file_id),
a AS (SELECT file_id, algorithm, confidence, CASE WHEN algorithm = 'DES' OR algorithm LIKE 'DES %' THEN 50 WHEN algorithm LIKE '%SHA-1%' THEN 25 END AS lost FROM ({union}) WHERE confidence >= 0.5),
g AS (SELECT file_id, string_agg(DISTINCT algorithm, ',' ORDER BY algorithm) AS algorithms, max(confidence) AS best_confidence, count(lost) AS n_vulnerabilities, greatest(0, least(100, 100 - coalesce(sum(lost), 0) + max(contains(algorithm, 'SHA-256')::INT) * 10))::BIGINT AS score FROM a GROUP BY file_id),
p AS (SELECT file_id, string_agg(DISTINCT protocol, ',' ORDER BY protocol) AS protocols FROM s JOIN ({catalogue._PROTOCOLS}) ON contains(lower(text), lower(keyword)) GROUP BY file_id),
n AS (SELECT file_id, count(*) AS n FROM ({ORACLE["function_extract"]}) GROUP BY file_id)
SELECT r.file_id, ['deep', 'quick', 'skip'][k] AS route, k = 3 AS skipped, CASE WHEN k = 3 THEN '' ELSE concat_ws(',', CASE WHEN r.file_id NOT IN (SELECT l_suppkey % 10 FROM lineitem) THEN 'no instructions' END, CASE WHEN r.file_id NOT IN (SELECT p_partkey % 7 FROM part) THEN 'no functions' END) END AS errors,
CASE WHEN k = 3 THEN 0 ELSE coalesce(n, 0) END::BIGINT AS n_functions, CASE WHEN k < 3 THEN algorithms END AS algorithms, CASE WHEN k < 3 THEN best_confidence END AS best_confidence, CASE WHEN k = 3 THEN 0 ELSE coalesce(n_vulnerabilities, 0) END::BIGINT AS n_vulnerabilities,
CASE WHEN k < 3 THEN protocols END AS protocols, CASE WHEN k < 3 THEN coalesce(score, 100) END AS security_score, (CASE WHEN k = 3 THEN 1 ELSE 7 END)::INT AS stages_completed FROM r LEFT JOIN g USING (file_id) LEFT JOIN p USING (file_id) LEFT JOIN n USING (file_id)"""


@query(_analysis_sql(ORACLE["infer_union"]))
def whole_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From facts to one row a file: routes, algorithms, weaknesses, protocols, score, and the facts that are missing."""
    files = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 12).alias("file_id"))
    strings = table(spark, sf_dir, "conversations").select(((F.col("conv_id") % 4) * 3).alias("file_id"), F.col("text").alias("string"))
    return job.analysed(files, strings, st.instructions(spark, sf_dir), st.loops(spark, sf_dir), st.loop_insn(spark, sf_dir), st.functions(spark, sf_dir), catalogue.tags(spark, sf_dir))


@query("WITH {FACTS}, b AS (SELECT file_id, func, count(DISTINCT (ord // 10) % (func % 19 + 2)) AS n FROM insn GROUP BY ALL) SELECT file_id, func FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY n DESC, func) AS rn FROM b) WHERE rn <= 5")
def most_block_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five functions with most blocks of each file."""
    return job.most_blocks(st.loop_insn(spark, sf_dir), 5)
