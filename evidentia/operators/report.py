"""Rule tables turned into columns: triage, protocols, severities, scores and the final report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from evidentia.functions.classify import first_of, severity_rank

# Protocols and the keywords that point to them.
PROTOCOLS = {
    "TLS": ("TLS", "SSL", "ClientHello", "ServerHello", "HandshakeType"),
    "SSH": ("SSH", "ssh-rsa", "ssh-ed25519", "OpenSSH"),
    "HTTPS": ("HTTPS", "HTTP/1.1", "Content-Type"),
    "IPSec": ("IPSec", "ESP", "AH", "IKE"),
    "OpenVPN": ("OpenVPN", "tun", "tap"),
    "WireGuard": ("WireGuard", "Curve25519"),
    "Signal": ("Signal", "X3DH", "Double Ratchet"),
    "PGP/GPG": ("PGP", "GPG", "OpenPGP"),
}
# Algorithm combinations that point to a protocol, and the least score that is reported.
COMBINATIONS = (("TLS 1.2/1.3", ("AES-GCM", "ECDHE", "SHA-256")), ("SSH", ("AES-CTR", "DH", "HMAC-SHA256")), ("IPSec", ("AES-CBC", "HMAC-SHA256", "IKE")))
TRIAGE_DEEP = ("aes", "rsa", "encrypt", "decrypt", "cipher", "hash", "sha", "md5", "crypto", "key", "openssl", "mbedtls", "libsodium", "base64")
TRIAGE_QUICK = ("xor", "random", "socket", "connect", "compress")
# Severity by algorithm, and library prefixes of function names.
SEVERITY = (("DES", "critical"), ("RC4", "critical"), ("MD5", "high"), ("SHA-1", "high"), ("ECB", "high"), ("AES-CBC", "medium"))
LIBRARIES = (("EVP_", "OpenSSL"), ("SSL_", "OpenSSL"), ("mbedtls_", "mbedTLS"), ("crypto_", "libsodium"), ("wc_", "wolfSSL"))
MIN_REPORTED = {"functions": 0.60, "protocols": 0.60, "algorithms": 0.50}


def triage(text: Column) -> Column:
    """deep, quick or skip, by the words in a file's strings."""
    low = F.lower(text)
    return first_of([(low.rlike("|".join(TRIAGE_DEEP)), "deep"), (low.rlike("|".join(TRIAGE_QUICK)), "quick")], "skip")


def protocol_table(spark: SparkSession) -> DataFrame:
    rows = [(p, k, i) for p, keys in PROTOCOLS.items() for i, k in enumerate(keys)]
    return spark.createDataFrame(rows, "protocol string, keyword string, ord int")


def protocol_evidence(strings: DataFrame, protocols: DataFrame, by: str = "file_id", text: str = "string") -> DataFrame:
    """Distinct (file, protocol, keyword) found in the file's strings.

    The keyword table is fixed and broadcast; matches are made distinct on the map side, so a keyword in very many strings costs one row a task.
    """
    return strings.join(F.broadcast(protocols), F.expr(f"contains(lower({text}), lower(keyword))")).select(by, "protocol", "keyword", "ord").distinct()


def protocols(evidence: DataFrame, by: str = "file_id", first: int = 10) -> DataFrame:
    """Per file: its protocols, their number, and the first pieces of evidence."""
    place = F.struct("protocol", "ord", F.concat(F.lit("Found '"), F.col("keyword"), F.lit("' in binary strings")).alias("e"))
    return evidence.groupBy(by).agg(F.array_join(F.array_sort(F.collect_set("protocol")), ",").alias("protocols"), F.count_distinct("protocol").alias("n_protocols"), F.array_join(F.slice(F.array_sort(F.collect_list(place))["e"], 1, first), "; ").alias("evidence"))


def protocols_by_algorithms(algorithms: DataFrame, by: str = "file_id") -> DataFrame:
    """(file, protocol, confidence, status): combinations by the share of their algorithms that were detected; a share below 0.40 is dropped."""
    have = algorithms.groupBy(by).agg(F.collect_set("algorithm").alias("have"))
    rows = F.array(*(F.struct(F.lit(p).alias("protocol"), F.size(F.array_intersect("have", F.array(*(F.lit(a) for a in needs)))).alias("n"), F.lit(len(needs)).alias("of")) for p, needs in COMBINATIONS))
    flat = have.select(by, F.explode(rows).alias("r")).select(by, "r.protocol", (F.col("r.n") / F.col("r.of")).alias("share"), "r.n", "r.of")
    status = F.when(F.col("n") == F.col("of"), "complete").when(F.col("n") * 2 > F.col("of"), "partial").otherwise("minimal")
    return flat.filter("share >= 0.40").select(by, "protocol", F.round(F.least("share", F.lit(0.89)), 2).alias("confidence"), status.alias("implementation_status"))


def severity_of(algorithm: Column, key_bits: Column | None = None) -> Column:
    """The severity that a weak algorithm or key size has; null for a sound one."""
    cases = []
    if key_bits is not None:
        cases = [(algorithm.contains("RSA") & (key_bits <= 1024), "critical"), (algorithm.contains("RSA") & (key_bits <= 1536), "high"), (algorithm.contains("AES") & (key_bits < 256), "medium")]
    plain = [((algorithm == a) | algorithm.startswith(a + " ") if a == "DES" else algorithm.contains(a), s) for a, s in SEVERITY]
    return first_of(cases + plain, F.lit(None).cast("string"))


def key_vulnerabilities(keys: DataFrame) -> DataFrame:
    """Hard-coded keys as vulnerability rows: critical if their entropy (column entropy) is over 4 bits or their size is a key's."""
    severity = F.when((F.col("entropy") > 4.0) & F.col("size").isin(8, 16, 24, 32), "critical").otherwise("high")
    return keys.select("file_id", F.lit("hardcoded_key").alias("type"), severity.alias("severity"), F.col("key_type").alias("algorithm"), F.format_string("%d bytes at 0x%x", "size", "offset").alias("evidence"))


def security_score(vulnerabilities: DataFrame, algorithms: DataFrame, by: str = "file_id") -> DataFrame:
    """100 less 50, 25, 10 or 5 for each vulnerability, plus 10 each, once, for a modern algorithm and for authenticated encryption; 0 to 100."""
    weight = first_of([(F.col("severity") == s, w) for s, w in (("critical", 50), ("high", 25), ("medium", 10), ("low", 5))], 0)
    lost = vulnerabilities.groupBy(by).agg(F.sum(weight).alias("lost"))
    modern, sealed = F.col("algorithm").rlike("AES-256|SHA-256|RSA-2048|RSA-3072|RSA-4096"), F.col("algorithm").rlike("GCM|ChaCha20-Poly1305")
    won = algorithms.groupBy(by).agg((F.max(modern.cast("int")) * 10 + F.max(sealed.cast("int")) * 10).alias("won"))
    both = lost.join(won, by, "full_outer")
    return both.select(by, F.greatest(F.lit(0), F.least(F.lit(100), 100 - F.coalesce("lost", F.lit(0)) + F.coalesce("won", F.lit(0)))).cast("long").alias("security_score"))


def by_severity(rows: DataFrame, by: str = "file_id", order: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with their rank in the report: critical first."""
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy(by).orderBy(severity_rank(F.col("severity")), *order)).cast("long"))


def library_of(name: Column) -> Column:
    return first_of([(name.startswith(p), lib) for p, lib in LIBRARIES], F.lit(None).cast("string"))


def linked(algorithms: DataFrame, functions: DataFrame, vulnerabilities: DataFrame, by: str = "file_id") -> DataFrame:
    """Algorithms with the functions and vulnerabilities of the same (case-folded) name."""
    key = lambda df, c: df.withColumn("_k", F.lower(F.trim(c)))
    f = key(functions, "related_algorithm").groupBy(by, "_k").agg(F.array_sort(F.collect_set("name")).alias("functions"))
    v = key(vulnerabilities, "algorithm").groupBy(by, "_k").agg(F.array_sort(F.collect_set("type")).alias("vulnerabilities"))
    return key(algorithms, "algorithm").join(f, [by, "_k"], "left").join(v, [by, "_k"], "left").drop("_k")


def report(metadata: DataFrame, algorithms: DataFrame, functions: DataFrame, found: DataFrame, vulnerabilities: DataFrame, scores: DataFrame) -> DataFrame:
    """(file_id, report): one nested struct a file, its lists sorted and thresholded; a file without any finding has empty lists."""
    rows = lambda df, *c, name, order: df.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct(*order, *c))).alias(name))
    neg = lambda c: (-F.col(c)).alias(f"neg_{c}")
    a = rows(algorithms.filter(F.col("confidence") >= MIN_REPORTED["algorithms"]), "algorithm", "confidence", "evidence", name="detected_algorithms", order=(neg("confidence"),))
    f = rows(functions.filter(F.col("confidence") >= MIN_REPORTED["functions"]), "name", "confidence", name="detected_functions", order=(neg("confidence"),))
    p = rows(found.filter(F.col("confidence") >= MIN_REPORTED["protocols"]), "protocol", "confidence", "implementation_status", name="detected_protocols", order=(neg("confidence"),))
    v = rows(vulnerabilities, "type", "severity", "algorithm", "evidence", name="vulnerabilities", order=(severity_rank(F.col("severity")).alias("rank"),))
    out = reduce(lambda x, y: x.join(y, "file_id", "left"), [a, f, p, v, scores], metadata)
    lists = ("detected_algorithms", "detected_functions", "detected_protocols", "vulnerabilities")
    empty = [F.coalesce(c, F.from_json(F.lit("[]"), out.schema[c].dataType)).alias(c) for c in lists]
    meta = F.struct(*(c for c in metadata.columns if c != "file_id")).alias("file_metadata")
    return out.select("file_id", F.struct(meta, *empty, F.struct(F.coalesce("security_score", F.lit(100)).alias("security_score")).alias("explainability")).alias("report"))
