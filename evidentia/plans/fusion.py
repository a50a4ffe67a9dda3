"""Registered queries on fused evidence, traits of ciphers, keys in texts and stored micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evidentia.operators import evidence, scan
from evidentia.plans.catalogue import query
from evidentia.session import shared_folder, spread, table
from evidentia.sources import dictionaries
from evidentia.streaming import answers, batches

#: Stand-ins: names of functions and of algorithms, given to parts by number.
NAMES = ("aes_sub_bytes", "shift_rows", "mod_exp", "expand_key", "SSL_write", "sha_compress", "pkcs_pad", "base64_decode", "xor_block", "rotl32", "ecdh", "add_words", "sign_message", "session handshake", "send", "main")
ALGORITHMS = ("AES-256-GCM", "AES-128-CBC", "3DES", "RC4", "SHA-256", "SHA-3", "ChaCha20", "RSA-2048", "Blowfish", "Twofish-256")
_N, _A = (f"[{', '.join(repr(x) for x in v)}]" for v in (NAMES, ALGORITHMS))


def _pick(values: tuple[str, ...], n) -> F.Column:
    return F.get(F.array(*(F.lit(v) for v in values)), n.cast("int"))


@query(f"""WITH e AS (SELECT p_partkey % 40 AS file_id, {_A}[p_partkey % 10 + 1] AS algorithm, CASE p_size % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 ELSE 5 END AS k, (p_partkey % 101) / 100.0::DOUBLE AS c FROM part),
i(term, indicator, boost) AS (VALUES ('connect', 'n', 0.3::DOUBLE), ('send', 'n', 0.3), ('ssl_write', 'n', 0.3), ('ecdh', 'k', 0.4), ('session', 's', 0.2), ('handshake', 's', 0.2)),
w AS (SELECT DISTINCT p_partkey % 40 AS file_id, unnest(string_split(lower({_N}[p_size % 16 + 1]), ' ')) AS term FROM part),
b AS (SELECT file_id, round(sum(boost), 4) AS boost FROM (SELECT DISTINCT file_id, indicator, boost FROM w JOIN i USING (term)) GROUP BY file_id),
m AS (SELECT file_id, algorithm, min(k) AS k, count(DISTINCT k)::INT AS n_sources FROM e GROUP BY ALL),
x AS (SELECT m.file_id, m.algorithm, m.k, n_sources, max(c) AS c FROM m JOIN e ON e.file_id = m.file_id AND e.algorithm = m.algorithm AND e.k = m.k GROUP BY ALL)
SELECT file_id, algorithm, ['inferred', 'constant', 'name', 'string', 'other'][k] AS source, n_sources, round(least(c * [0.95, 0.90, 0.70, 0.50, 0][k]::DOUBLE + coalesce(boost, 0), 0.99), 4) AS confidence FROM x LEFT JOIN b USING (file_id)""")
def trusted_algorithms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Algorithms by their most trusted evidence, raised by the indicators in a file's names; parts are the evidence."""
    part = table(spark, sf_dir, "part")
    file = (F.col("p_partkey") % 40).alias("file_id")
    rows = part.select(file, _pick(ALGORITHMS, F.col("p_partkey") % 10).alias("algorithm"), _pick(("inferred", "constant", "name", "string", "rumour"), F.col("p_size") % 5).alias("source"), ((F.col("p_partkey") % 101) / 100).alias("confidence"))
    names = part.select(file, _pick(NAMES, F.col("p_size") % 16).alias("text"))
    return evidence.fused(rows, evidence.boosts(names, dictionaries.boost_table(dictionaries.inline(spark, dictionaries.INDICATORS))))


@query(f"""WITH a AS (SELECT p_partkey, {_A}[p_partkey % 10 + 1] AS a, p_size % 4 = 1 AS hint FROM part),
t AS (SELECT *, CASE WHEN a = 'SHA-3' THEN 'sponge' WHEN a IN ('RC4', 'ChaCha20') THEN 'stream' WHEN a NOT IN ('SHA-256', 'RSA-2048') THEN 'block' END AS kind FROM a),
m AS (SELECT *, CASE WHEN kind <> 'block' THEN NULL WHEN a = 'AES-256-GCM' THEN 'GCM' WHEN a = 'AES-128-CBC' THEN 'CBC' WHEN hint AND kind = 'block' THEN 'ECB' END AS mode FROM t)
SELECT p_partkey, kind AS cipher_type, mode AS mode_of_operation, CASE WHEN a IN ('AES-256-GCM', 'Twofish-256') THEN 256 WHEN a = 'AES-128-CBC' THEN 128 WHEN a = 'RSA-2048' THEN 2048 END::INT AS key_size_bits,
CASE WHEN a LIKE 'AES%' OR a LIKE 'Two%' THEN 128 WHEN kind = 'block' THEN 64 END::INT AS block_size_bits, CASE WHEN mode IN ('GCM', 'CBC') THEN true WHEN mode = 'ECB' THEN false END AS iv_nonce_required FROM m""")
def cipher_traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind, mode, sizes and initial value of the cipher that each part stands for."""
    hint = F.when(F.col("p_size") % 4 == 1, "set_ecb mode ecb").otherwise("speech")
    return table(spark, sf_dir, "part").select("p_partkey", evidence.cipher_traits(_pick(ALGORITHMS, F.col("p_partkey") % 10), hint).alias("t")).select("p_partkey", "t.*")


@query("""SELECT p_partkey, ['substitute', 'permutation', 'modular_arithmetic', 'key_expansion', 'unknown', 'compression', 'padding', 'encoding', 'xor', 'rotation', 'unknown', 'addition', 'unknown', 'unknown', 'unknown', 'unknown'][p_size % 16 + 1] AS operation,
CASE p_size % 16 WHEN 3 THEN 'key_derivation' WHEN 5 THEN 'hash' WHEN 12 THEN 'signature' ELSE 'unknown' END AS role FROM part""")
def operation_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operation and the role that each function's name stands for."""
    name = _pick(NAMES, F.col("p_size") % 16)
    return table(spark, sf_dir, "part").select("p_partkey", evidence.operation_of(name).alias("operation"), evidence.role_of(name).alias("role"))


#: So many documents can be searched for keys in a task, whatever the others have.
KEY_DOCUMENTS = 5_000


@query()
def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key-like windows of all sizes at every byte of every document."""
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), KEY_DOCUMENTS, "doc_id")
    rows = documents.select(F.col("doc_id").alias("file_id"), F.lit(".data").alias("name"), F.lit(0).cast("long").alias("vaddr"), F.col("text").cast("binary").alias("data"))
    return scan.key_windows(rows).select("file_id", "offset", "size", "hexed", "key_type")


@query("SELECT event_type, CAST(ts AS DATE) AS day, count(*)::BIGINT AS n_rows, sum(value::DECIMAL(18, 4))::DOUBLE AS total FROM events GROUP BY ALL")
def stored_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of files: every micro-batch leaves its parts of the totals in a table, which are then summed up."""
    events, by = table(spark, sf_dir, "events"), ["event_type", "day"]
    # A pattern, as a stream's plain path must be a folder and the table can be one file.
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/events.parque[t]")
    out = shared_folder(spark, "batches")
    change = lambda df: batches.partial_totals(df.withColumn("day", F.to_date("ts")), by, "value")
    batches.start_batches(stream, f"{out}/table", f"{out}/state", change).awaitTermination()
    return batches.merged_totals(spark.read.parquet(f"{out}/table"), by)


@query("""WITH RECURSIVE e AS (SELECT event_id AS id, user_id AS key, ts FROM events),
m AS (SELECT key, min(ts) AS began FROM e GROUP BY key UNION ALL SELECT m.key, min(e.ts) FROM m JOIN e ON e.key = m.key AND e.ts > m.began + INTERVAL 12 HOUR GROUP BY m.key),
n AS (SELECT m.key, began, min(id) AS entry_id FROM m JOIN e ON e.key = m.key AND ts = began GROUP BY ALL)
SELECT id, e.key, id <> entry_id AS hit, entry_id FROM e ASOF JOIN n ON e.key = n.key AND e.ts >= n.began""")
def cached_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of requests by user, through a cache whose entries live twelve hours."""
    events = table(spark, sf_dir, "events")
    # All files are one micro-batch: a cache depends on the order of arrival, and files have none among themselves.
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parque[t]")
    out = shared_folder(spark, "cached")
    asked = answers.cached_requests(stream.select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), "ts"), ttl=12 * 3600)
    batches.start_batches(asked, f"{out}/table", f"{out}/state").awaitTermination()
    return spark.read.parquet(f"{out}/table").select("id", "key", "hit", "entry_id")
