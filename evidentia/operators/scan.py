"""Dictionary scans over blobs: signatures, rules, strings and key candidates."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from evidentia.functions.classify import algorithm_of_constant, constant_confidence, key_type
from evidentia.functions.text import has_keyword, hex_address, latin1, printable_runs
from evidentia.session import python_workers, written

# Byte signatures by name, in hexadecimal.
SIGNATURES = {
    "AES_SBOX_FIRST_BYTES": "637c777bf26b",
    "AES_INV_SBOX_FIRST": "52096ad53036",
    "AES_RCON_FIRST": "010204081020",
    "CHACHA20_CONSTANT": b"expand 32-byte k".hex(),
    "SALSA20_CONSTANT": b"expand 32-byte k".hex(),
    "CHACHA20_SIGMA": b"expand".hex(),
    "SHA256_K_FIRST": "428a2f98",
    "SHA256_K_SECOND": "71374491",
    "SHA256_INIT_H0": "6a09e667",
    "SHA1_INIT_H0": "67452301",
    "SHA1_INIT_H1": "efcdab89",
    "SHA512_K_FIRST": "428a2f98d728ae22",
    "SHA512_INIT_H0": "6a09e667f3bcc908",
    "MD5_INIT_A": "67452301",
    "MD5_INIT_B": "efcdab89",
    "MD5_INIT_C": "98badcfe",
    "DES_IP_TABLE_START": "3a322a221a12",
    "DES_SBOX1_FIRST": "0e040d01020f",
    "DES_PC1_TABLE": "393129211911",
    "SECP256K1_P_SUFFIX": "fffffffefffffc2f",
    "SECP256K1_N_SUFFIX": "d0364141",
    "P256_PRIME_SUFFIX": "ffffffff00000001",
    "BLAKE2B_IV0": "6a09e667f3bcc908",
    "BLAKE2S_IV0": "6a09e667",
    "RC4_INIT_PATTERN": bytes(range(16)).hex(),
    "BASE64_TABLE": b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdef".hex(),
}

# Whole public constants, and prefixes, that are no secret keys.
PUBLIC_CONSTANTS = (
    "637c777bf26b6fc53001672bfed7ab76",
    "52096ad53036a538bf40a39e81f3d7fb",
    "6a09e667bb67ae853c6ef372a54ff53a510e527f9b05688c1f83d9ab5be0cd19",
    "67452301efcdab8998badcfe10325476c3d2e1f0",
    "0123456789abcdeffedcba9876543210",
    b"expand 32-byte k".hex(),
    b"expand 16-byte k".hex(),
)
PUBLIC_PREFIXES = ("637c777bf26b6fc5", "52096ad53036a538", "6a09e667", "67452301")
KEY_SIZES = (8, 16, 24, 32)
#: So many bytes of sections are searched for keys at a time.
KEY_STEP = 1 << 16
#: Up to so many names of sections that a file has more than once are broadcast; more are joined by a shuffle.
SEVERAL = 100_000
#: Sections that may hold keys.
DATA_SECTIONS = r"\.data|\.rodata|\.rdata|__data|__const|__rodata"

# Fixed values: (rule, algorithm, severity, condition, number, {pattern: hex with wildcards and jumps, or text}).
_SEQUENCE = "00 01 02 03 04 05 06 07 08 09 0a 0b 0c 0d 0e 0f"
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
RULES = (
    ("AES_Constants", "AES", "high", "any", 1, {"sbox": "63 7c 77 7b f2 6b 6f c5 30 01 67 2b fe d7 ab 76", "inv_sbox": "52 09 6a d5 30 36 a5 38 bf 40 a3 9e 81 f3 d7 fb", "rcon": "01 02 04 08 10 20 40 80 1b 36", "mixcol": "02 03 01 01 01 02 03 01 01 01 02 03 03 01 01 02"}),
    ("ChaCha20_Salsa20_Constants", "ChaCha20/Salsa20", "high", "any", 1, {"chacha_sigma": "61 70 78 65 33 32 2d 62 79 74 65 20 6b", "chacha_expand": "text:expand 32-byte k", "chacha_tau": "text:expand 16-byte k", "quarter_round": "10 00 00 00 00 00 00 00 00 00 00 00 00 00 00 00"}),
    ("SHA256_Constants", "SHA-256", "high", "n_of", 2, {"h0_le": "67 e6 09 6a", "h1_le": "85 ae 67 bb", "h2_le": "72 f3 6e 3c", "h3_le": "3a f5 4f a5", "h0_be": "6a 09 e6 67", "h1_be": "bb 67 ae 85", "k0": "98 2f 8a 42", "k1": "91 44 37 71", "k2": "cf fb c0 b5"}),
    ("SHA1_Constants", "SHA-1", "medium", "n_of", 3, {"h0": "01 23 45 67", "h1": "89 ab cd ef", "h2": "fe dc ba 98", "h3": "76 54 32 10", "h4": "f0 e1 d2 c3"}),
    ("MD5_Constants", "MD5", "medium", "n_of", 3, {"md5_a": "01 23 45 67", "md5_b": "89 ab cd ef", "md5_c": "fe dc ba 98", "md5_d": "76 54 32 10", "md5_t1": "d7 6a a4 78", "md5_t2": "e8 c7 b7 56"}),
    ("DES_3DES_Constants", "DES/3DES", "medium", "any", 1, {"ip_table": "3a 32 2a 22 1a 12 0a 02", "sbox1": "0e 04 0d 01 02 0f 0b 08", "pc1_table": "39 31 29 21 19 11 09 01", "expansion": "20 01 02 03 04 05 04 05"}),
    ("RSA_ECC_Primes", "RSA/ECC", "high", "any", 1, {"secp256k1_p": "ff ff ff fe ff ff fc 2f", "secp256k1_n": "d0 36 41 41", "p256_prime": "ff ff ff ff 00 00 00 01", "rsa_modulus": "00 [127] 00"}),
    ("BLAKE2_Constants", "BLAKE2", "high", "any", 1, {"blake2b_iv0": "08 c9 bc f3 67 e6 09 6a", "blake2s_iv0": "67 e6 09 6a", "blake2_sigma": _SEQUENCE}),
    ("RC4_Initialization", "RC4", "low", "any", 1, {"rc4_init": _SEQUENCE, "ksa_pattern": "00 [255] ff"}),
    ("Base64_Encoding", "Base64", "low", "any", 1, {"base64_std": f"text:{_LETTERS}+/", "base64_url": f"text:{_LETTERS}-_"}),
    ("Cryptographic_XOR_Loops", "XOR Cipher", "medium", "any", 1, {"xor_x86": "31 ?? ?? 40 7? ??", "xor_x64": "48 31 ?? ?? 48 ff ?? 75 ??", "xor_arm": "?? ?? ?? e0", "xor_mips": "26 ?? ?? 00"}),
    ("Bit_Rotation_Operations", "Generic Crypto Operations", "low", "any", 1, {"rol_x86": "c1 c0", "ror_x86": "c1 c8", "rotate_pattern": "d3 ?? ?? c3 ?? 09"}),
    ("HMAC_Implementation", "HMAC", "high", "all", 2, {"ipad": "36 36 36 36 36 36 36 36", "opad": "5c 5c 5c 5c 5c 5c 5c 5c"}),
    ("PBKDF2_KDF", "PBKDF2", "high", "any", 1, {"counter": "00 00 00 01", "pbkdf2_str": "nocase:PBKDF2", "prf_str": "nocase:HMAC-SHA"}),
    ("Bcrypt_Scrypt_Argon2", "Bcrypt/Scrypt/Argon2", "high", "any", 1, {"bcrypt": "text:$2a$", "bcrypt_alt": "text:$2b$", "scrypt": "nocase:scrypt", "argon2i": "text:$argon2i$", "argon2d": "text:$argon2d$", "argon2id": "text:$argon2id$"}),
    ("TLS_SSL_Handshake", "TLS/SSL", "high", "any", 1, {"tls12": "03 03", "tls13": "03 04", "client_hello": "01 00 00", "server_hello": "02 00 00", "tls_aes_gcm": "13 01", "tls_chacha": "13 03"}),
    ("Poly1305_MAC", "Poly1305", "high", "any", 1, {"poly_prime": "fb ff ff ff ff ff ff ff ff ff ff ff ff ff ff ff", "poly_clamp": "0f ff ff fc 0f ff ff fc 0f ff ff fc 0f ff ff fc"}),
    ("Curve25519_Ed25519", "Curve25519/Ed25519", "high", "any", 1, {"curve25519_p": "ed ff ff ff ff ff ff ff ff ff ff ff ff ff ff ff", "ed25519_base": "58 66 66 66 66 66 66 66 66 66 66 66 66 66 66 66"}),
    ("High_Entropy_Data_Block", "Generic", "low", "count_over", 5, {"high_entropy": r"regex:[\x00-\xFF]{256,}"}),
)


def rule_regex(pattern: str) -> str:
    """A Java regular expression for one rule pattern, over bytes decoded as Latin-1."""
    kind, _, rest = pattern.partition(":")
    if kind == "regex":
        return f"(?s){rest}"
    if kind in ("text", "nocase"):
        return ("(?i)" if kind == "nocase" else "") + re.sub(r"([^A-Za-z0-9 ])", r"\\\1", rest)
    out = "(?s)"
    for token in pattern.split():
        if token == "??":
            out += "."
        elif jump := re.fullmatch(r"\[(\d+)(?:-(\d+))?\]", token):
            out += f".{{{jump[1]}}}" if not jump[2] else f".{{{jump[1]},{jump[2]}}}"
        elif token[1] == "?":
            out += rf"[\x{token[0]}0-\x{token[0]}f]"
        elif token[0] == "?":
            out += "[" + "".join(rf"\x{i:x}{token[1]}" for i in range(16)) + "]"
        else:
            out += rf"\x{token}"
    return out


def signature_table(spark: SparkSession, signatures=None) -> DataFrame:
    """(name, pattern, algorithm): the dictionary as a small table."""
    rows = spark.createDataFrame(list((signatures or SIGNATURES).items()), "name string, hexed string")
    return rows.select("name", F.unhex("hexed").alias("pattern"), algorithm_of_constant(F.col("name")).alias("algorithm"))


def signature_scan(sections: DataFrame, signatures: DataFrame) -> DataFrame:
    """(file_id, section, name, algorithm, address) of each signature's first place in each section (file_id, name, vaddr, data).

    A contains-join has no equality, so the dictionary, whose size is fixed, is broadcast and each section is read once. Unreadable sections are null and are skipped.
    """
    blob = sections.filter("data IS NOT NULL").select("file_id", F.col("name").alias("section"), "vaddr", latin1(F.col("data")).alias("blob"))
    found = blob.join(F.broadcast(signatures.select("name", "algorithm", latin1(F.col("pattern")).alias("p"))), F.expr("contains(blob, p)"))
    return found.select("file_id", "section", "name", "algorithm", (F.col("vaddr") + F.expr("locate(p, blob)") - 1).alias("address")).withColumn("offset", hex_address(F.col("address")))


ANCHOR_WORDS = 3
#: Phrases without a whole inner word are looked for by a contains-join, up to so many of them.
SHORT_PHRASES = 10_000


def phrase_scan(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """(id, item, position) of each phrase's first place in each text, wherever it stands; for dictionaries of any size.

    texts: (id, text); phrases: (item, phrase). A phrase's first and last word may be parts of words in a text, those between are whole ones; up to three of
    them are its anchor. Anchors of texts and phrases meet by equality and without the texts, then the few candidates are checked whole.
    Only phrases of one or two words are looked for in every text; more than SHORT_PHRASES of those are an error.
    """
    words = lambda c: F.split(c, "[ \n]", -1)
    run = lambda w, i, k: F.concat_ws(" ", *(F.get(w, i + j) for j in range(k)))
    own = phrases.filter("phrase <> ''").withColumn("w", words(F.col("phrase")))
    short = own.filter(F.size("w") < 3).select("item", "phrase")
    n_short = short.count()
    if n_short > SHORT_PHRASES:
        raise ValueError(f"{n_short} phrases of fewer than three words; at most {SHORT_PHRASES} can be looked for")
    near = None
    cut = texts.select("id", words(F.col("text")).alias("w"))
    anchor_of = lambda k: lambda i: run(F.col("w"), i, k)
    for k, some in ((1, own.filter(F.size("w").between(3, ANCHOR_WORDS + 1))), (ANCHOR_WORDS, own.filter(F.size("w") > ANCHOR_WORDS + 1))):
        starts = F.when(F.size("w") >= k, F.sequence(F.lit(0), F.size("w") - k)).otherwise(F.array().cast("array<int>"))
        anchors = cut.select("id", F.explode(F.transform(starts, anchor_of(k))).alias("anchor"))
        found = anchors.join(some.select("item", run(F.col("w"), F.lit(1), k).alias("anchor")), "anchor").select("id", "item").distinct()
        near = found if near is None else near.unionByName(found)
    whole = texts.join(near, "id").join(phrases, "item").filter("contains(text, phrase)").select("id", "item", "text", "phrase")
    if n_short:
        whole = whole.unionByName(texts.join(F.broadcast(short), F.expr("contains(text, phrase)")).select("id", "item", "text", "phrase"))
    return whole.select("id", "item", F.expr("locate(phrase, text)").cast("long").alias("position"))


def constant_groups(found: DataFrame, by: str = "file_id") -> DataFrame:
    """(file, algorithm, n, names, confidence_level): constants by algorithm, the level from the file's largest group."""
    groups = found.groupBy(by, "algorithm").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("name")).alias("names"))
    top = groups.groupBy(by).agg(F.max("n").alias("largest"))
    return groups.join(top, by).withColumn("confidence_level", constant_confidence(F.col("largest"))).drop("largest")


def rule_matches(blobs: DataFrame, rules=RULES) -> DataFrame:
    """(file_id, rule, algorithm, severity, match_count) of the rules that hold in ``blobs`` (file_id, data).

    Each pattern is counted once a blob, in one projection: nothing is joined or shuffled. match_count is the number of matches of all the rule's patterns.
    """
    text = latin1(F.col("data"))
    judged = []
    for name, algorithm, severity, kind, n, patterns in rules:
        counts = F.array(*(F.regexp_count(F.col("blob"), F.lit(rule_regex(p))) for p in patterns.values()))
        held = F.size(F.filter(counts, lambda c: c > 0))
        total = F.aggregate(counts, F.lit(0), lambda a, c: a + c)
        fires = {"any": held >= 1, "all": held == len(patterns), "n_of": held >= n, "count_over": total > n}[kind]
        judged.append(F.struct(F.lit(name).alias("rule"), F.lit(algorithm).alias("algorithm"), F.lit(severity).alias("severity"), fires.alias("fires"), total.cast("long").alias("match_count")))
    rows = blobs.filter("data IS NOT NULL").select("file_id", text.alias("blob")).select("file_id", F.explode(F.array(*judged)).alias("r"))
    return rows.filter("r.fires").select("file_id", "r.rule", "r.algorithm", "r.severity", "r.match_count")


#: Longest anchor of a pattern, in bytes, and up to how many anchors (8 bytes each) a task is given to look for; beyond it every text's own runs of bytes are
#: joined with the anchors.
ANCHOR_BYTES, HELD_ANCHORS = 4, 1_000_000
_PATTERNS = "array<struct<rule:string,ident:string,regex:string>>"
#: How much a byte tells, roughly: zeros, ff, letters and blanks are in most blobs.
_COMMON = frozenset(b"\x00\xff \n" + bytes(range(0x61, 0x7B)))


def anchor_of(pattern: str) -> tuple[int, int]:
    """(length, value) of a pattern's anchor: its most telling run of up to ANCHOR_BYTES sure bytes, A-Z as a-z, little-endian; (0, 0) if no byte is sure."""
    kind, _, rest = pattern.partition(":")
    if kind == "regex":
        return 0, 0
    if kind in ("text", "nocase"):
        runs = [rest.encode("latin-1")]
    else:
        sure = [int(t, 16) if "?" not in t and t[0] != "[" else -1 for t in pattern.split()]
        runs = [bytes(int(x) for x in r.split(",") if x) for r in ",".join(map(str, sure)).split("-1")]
    found = [r.lower()[i : i + n] for r in runs for n in (min(ANCHOR_BYTES, len(r)),) if n for i in range(len(r) - n + 1)]
    best = max(found, key=lambda a: (len(a), len(set(a) - _COMMON)), default=b"")
    return len(best), int.from_bytes(best, "little")


def rule_tables(spark: SparkSession, rules=RULES) -> tuple[DataFrame, DataFrame]:
    """(rules, patterns) as tables: (rule, algorithm, severity, kind, n, n_patterns) and (rule, ident, regex, length, anchor)."""
    patterns = [(r[0], ident, rule_regex(p), *anchor_of(p)) for r in rules for ident, p in r[5].items()]
    names = [(*r[:5], len(r[5])) for r in rules]
    return spark.createDataFrame(names, "rule string, algorithm string, severity string, kind string, n int, n_patterns int"), spark.createDataFrame(patterns, "rule string, ident string, regex string, length int, anchor long")


def _anchors_in(blobs: DataFrame, held: dict[int, list[int]] | None) -> DataFrame:
    """(file_id, length, anchor): the distinct runs of 1 to ANCHOR_BYTES bytes of each blob, A-Z as a-z; only those in ``held`` (by length) if it is given.

    One pass over the bytes a length; what goes on is distinct, so a blob gives at most its number of anchors, or of bytes.
    """
    python_workers(blobs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = {k: np.array(sorted(v), np.uint32) for k, v in held.items()} if held is not None else None
        fold = np.arange(256, dtype=np.uint8)
        fold[0x41:0x5B] += 32
        for batch in batches:
            for k, data in enumerate(batch.column(1)):
                raw = fold[np.frombuffer(data.as_buffer(), np.uint8)]
                value = np.zeros(len(raw), np.uint32)
                for length in range(1, ANCHOR_BYTES + 1):
                    n = len(raw) - length + 1
                    if n <= 0:
                        break
                    value = value[:n] | (raw[length - 1 :].astype(np.uint32) << np.uint32(8 * (length - 1)))
                    if wanted is None:
                        found = np.unique(value)
                    elif length in wanted:
                        place = np.searchsorted(wanted[length], value)
                        found = np.unique(value[wanted[length][np.minimum(place, len(wanted[length]) - 1)] == value])
                    else:
                        continue
                    ids = batch.column(0).take(pa.array(np.full(len(found), k)))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(found), length, np.int32)), pa.array(found.astype(np.int64))], ["file_id", "length", "anchor"])

    schema = blobs.select("file_id").schema.add("length", "integer").add("anchor", "long")
    return blobs.select("file_id", F.col("data").cast("binary").alias("data")).mapInArrow(run, schema)


def rule_scan(blobs: DataFrame, rules: DataFrame, patterns: DataFrame) -> DataFrame:
    """(file_id, rule, algorithm, severity, match_count) as ``rule_matches`` gives, for rule lists of any size (``rule_tables``).

    Each blob's bytes are gone over once for the anchors of all patterns; anchors and patterns meet by equality, and a blob is searched by the patterns
    whose anchor it has and by no others. A pattern without a sure byte is searched in every blob. file_id must be unique; null blobs have no match.
    """
    blobs = blobs.filter("data IS NOT NULL").select("file_id", "data")
    known = patterns.filter("length > 0").select("length", "anchor").distinct()
    n = known.count()
    held: dict[int, list[int]] | None = None
    if n <= HELD_ANCHORS:
        held = {}
        for r in known.collect():
            held.setdefault(r["length"], []).append(r["anchor"])
    found = _anchors_in(blobs, held)
    small = (lambda df: F.broadcast(df)) if n <= SHORT_PHRASES else (lambda df: df)
    named = patterns.select("length", "anchor", F.struct("rule", "ident", "regex").alias("p"))
    asked = found.join(small(named), ["length", "anchor"]).groupBy("file_id").agg(F.collect_list("p").alias("ps"))
    always = patterns.filter("length = 0").agg(F.collect_list(F.struct("rule", "ident", "regex")).alias("always"))
    # One row of patterns without any sure byte, for every blob; the list is a setting of the job and short.
    rest = [tuple(x) for x in always.first()["always"]]
    every = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(("rule", "ident", "regex"), x, strict=True))) for x in rest)).cast(_PATTERNS)
    text = blobs.join(asked, "file_id", "left").select("file_id", latin1(F.col("data")).alias("t"), F.concat(F.coalesce("ps", F.array().cast(_PATTERNS)), every).alias("ps"))
    counted = text.select("file_id", F.explode(F.transform("ps", lambda p: F.struct(p["rule"].alias("rule"), F.regexp_count(F.col("t"), p["regex"]).cast("long").alias("c")))).alias("x"))
    sums = counted.select("file_id", "x.*").filter("c > 0").groupBy("file_id", "rule").agg(F.count("*").alias("held"), F.sum("c").alias("match_count"))
    fires = F.when(F.col("kind") == "any", F.col("held") >= 1).when(F.col("kind") == "all", F.col("held") == F.col("n_patterns")).when(F.col("kind") == "n_of", F.col("held") >= F.col("n")).otherwise(F.col("match_count") > F.col("n"))
    return sums.join(small(rules), "rule").filter(fires).select("file_id", "rule", "algorithm", "severity", "match_count")


def rule_summary(found: DataFrame, by: str = "file_id") -> DataFrame:
    """Per file: rules, distinct algorithms, severity histogram and the confidence score."""
    weight = F.when(F.col("severity") == "high", 1.0).when(F.col("severity") == "medium", 0.6).otherwise(0.3)
    grown = weight * (1 + F.least(F.col("match_count") / 10.0, F.lit(1.0)))
    out = found.groupBy(by).agg(
        F.count("*").alias("n_rules"),
        F.count_distinct("algorithm").alias("n_algorithms"),
        F.array_join(F.array_sort(F.collect_set("algorithm")), ",").alias("algorithms"),
        *(F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in ("high", "medium", "low")),
        F.sum(grown).alias("w"),
    )
    score = F.least(F.col("w") / (F.col("n_rules") + 5), F.lit(1.0))
    return out.withColumn("confidence", F.round(F.when(F.col("n_algorithms") > 2, F.least(score * 1.2, F.lit(1.0))).otherwise(score), 2)).drop("w")


def interesting_strings(sections: DataFrame, first: int = 100, closed: bool = False) -> DataFrame:
    """(file_id, section, ord, string, total_found): the ``first`` keyword strings of each file in order of place."""
    runs = sections.filter("data IS NOT NULL").select("file_id", F.col("name").alias("section"), "vaddr", F.posexplode(printable_runs(latin1(F.col("data")), closed=closed)).alias("pos", "string"))
    found = runs.filter(has_keyword(F.col("string")))
    order = Window.partitionBy("file_id").orderBy("vaddr", "pos")
    total = found.groupBy("file_id").agg(F.count("*").alias("total_found"))
    return found.withColumn("ord", F.row_number().over(order)).filter(F.col("ord") <= first).join(total, "file_id").select("file_id", "section", "ord", "string", "total_found")


def key_windows(sections: DataFrame, sizes=KEY_SIZES) -> DataFrame:
    """(file_id, section, offset, size, hexed): every byte window of every size that is a key candidate; the smallest size at each offset is kept.

    A window has three tenths of its bytes outside printable ASCII, an entropy of 3 bits or more, and is no public constant. The bytes of a batch of
    sections are searched together, KEY_STEP of them at a time and only where no smaller window was found, so time is linear in the bytes and memory
    follows a batch. Sections of one name in one file can overlap: only their windows are grouped by offset, those of all other sections are not
    exchanged. Null data and sections that are not longer than a window give none.
    """
    rows = _data_sections(sections)
    if sections.isStreaming:
        return _with_type(_least(_windows(rows, sizes)))
    several = written(rows.groupBy("file_id", "section").count().filter("count > 1").select(F.col("file_id").alias("_f"), F.col("section").alias("_s")), "sections")
    held = several.count()
    if not held:
        return _with_type(_windows(rows, sizes))
    several = F.broadcast(several) if held <= SEVERAL else several
    same = F.col("file_id").eqNullSafe(F.col("_f")) & F.col("section").eqNullSafe(F.col("_s"))
    alone, some = (_windows(rows.join(several, same, how), sizes) for how in ("left_anti", "left_semi"))
    return _with_type(alone.unionByName(_least(some)))


def _data_sections(sections: DataFrame) -> DataFrame:
    python_workers(sections.sparkSession)
    return sections.filter(F.lower(F.col("name")).rlike(DATA_SECTIONS)).select("file_id", F.col("name").alias("section"), F.col("vaddr").cast("long").alias("vaddr"), F.col("data").cast("binary").alias("data"))


def _with_type(found: DataFrame) -> DataFrame:
    return found.select("file_id", "section", "offset", "size", "hexed", key_type(F.col("size")).alias("key_type"))


def _least(found: DataFrame) -> DataFrame:
    """The smallest window at each offset of a file's sections of one name."""
    least = found.groupBy("file_id", "section", "offset").agg(F.min_by(F.struct("size", "hexed"), "size").alias("k"))
    return least.select("file_id", "section", "offset", "k.size", "k.hexed")


def _windows(rows: DataFrame, sizes, first: int | None = None) -> DataFrame:
    """(file_id, section, offset, size, hexed): the smallest key-like window at each offset of each row of (file_id, section, vaddr, data).

    With ``first``, only so many windows of each row, numbered from 1 by ``ord``, and the count of all of them as ``total_found``.
    """
    sizes = sorted(sizes)
    names = ["file_id", "section", "vaddr", "o", "size", "window"]

    def found_in(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]:
        for place, starts, lengths, windows in _key_like(batch.column(3), sizes):
            cuts = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(cuts), pa.py_buffer(windows)])
            taken = (batch.column(c).take(pa.array(place)) for c in range(3))
            yield place, starts, pa.RecordBatch.from_arrays([*taken, pa.array(starts), pa.array(lengths), packed], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from (found for _, _, found in found_in(batch))

    def run_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Windows come some places at a time, so a row's count is known at the batch's end only; until then at most ``first`` of it are held.
            total, held = np.zeros(batch.num_rows, np.int64), []
            for place, starts, found in found_in(batch):
                order = np.lexsort((starts, place))
                row = place[order]
                nth = total[row] + np.arange(1, len(row) + 1) - np.searchsorted(row, row)
                total += np.bincount(row, minlength=len(total))
                early = nth <= first
                held.append((row[early], nth[early], found.take(pa.array(order[early]))))
            for row, nth, found in held:
                if len(row):
                    yield pa.RecordBatch.from_arrays([*found.columns, pa.array(nth.astype(np.int32)), pa.array(total[row])], [*names, "ord", "total_found"])

    schema = rows.select("file_id", "section", "vaddr").schema.add("o", "long").add("size", "integer").add("window", "binary")
    if first is not None:
        schema = schema.add("ord", "integer").add("total_found", "long")
    found = rows.select("file_id", "section", "vaddr", "data").mapInArrow(run if first is None else run_first, schema)
    return found.select("file_id", "section", (F.col("vaddr") + F.col("o")).alias("offset"), "size", F.lower(F.hex("window")).alias("hexed"), *(() if first is None else ("ord", "total_found")))


def _key_like(data: pa.Array, sizes: list[int], step: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bytes]]:
    """(rows, starts, sizes, bytes) of the smallest window that passes all tests at each place of ``data``, ``step`` places at a time.

    The last window of a row is left out. Entropy is taken from sorted windows: the r-th equal byte of a run adds r log r - (r - 1) log (r - 1).
    """
    data = data.fill_null(b"")
    if not len(data) or data.buffers()[2] is None:
        return
    step = step or KEY_STEP
    cuts = np.frombuffer(data.buffers()[1], np.int64 if pa.types.is_large_binary(data.type) else np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64)
    whole = np.frombuffer(data.buffers()[2], np.uint8)[: cuts[-1]]
    ranks = np.arange(1, max(sizes) + 1, dtype=float)
    adds = np.diff(np.concatenate(([0.0], ranks * np.log2(ranks))), prepend=0.0)
    for a in range(int(cuts[0]), int(cuts[-1]), step):
        b = min(a + step, int(cuts[-1]))
        raw = whole[a : b + max(sizes) - 1]
        first, last = np.searchsorted(cuts, a, "right") - 1, np.searchsorted(cuts, b, "left")
        place = np.repeat(np.arange(first, last), np.diff(np.clip(cuts[first : last + 1], a, b)))
        room = cuts[place + 1] - np.arange(a, b)
        odd = np.concatenate(([0], np.cumsum((raw < 32) | (raw > 126))))
        known = _public_in(raw.tobytes())
        free, parts = np.ones(b - a, bool), []
        for size in sizes:
            n = min(b - a, len(raw) - size + 1)
            if n <= 0:
                break
            able = free[:n] & (room[:n] > size) & (odd[size : size + n] - odd[:n] >= size * 0.3)
            for p, length, anywhere in known:
                if length <= size:
                    able[max(p - size + length, 0) if anywhere else p : p + 1] = False
            at = np.flatnonzero(able)
            if not len(at):
                continue
            windows = np.lib.stride_tricks.sliding_window_view(raw, size)[at]
            columns = np.ascontiguousarray(np.sort(windows, axis=1).T)
            rank, total = np.ones(len(at), np.intp), np.zeros(len(at))
            for i in range(1, size):
                rank = np.where(columns[i] == columns[i - 1], rank + 1, 1)
                total += adds[rank]
            good = np.log2(size) - total / size >= 3.0 - 1e-9
            free[at[good]] = False
            parts.append((at[good], size, windows[good].tobytes()))
        at = np.concatenate([np.empty(0, np.int64), *(p[0] for p in parts)])
        if len(at):
            yield place[at], a + at - cuts[place[at]], np.concatenate([np.full(len(p[0]), p[1], np.int32) for p in parts]), b"".join(p[2] for p in parts)


def _public_in(data: bytes) -> list[tuple[int, int, bool]]:
    """(place, length, anywhere) of public values in ``data``: whole constants spoil every window that holds them, prefixes the one that they start."""
    found = []
    for values, anywhere in ((PUBLIC_CONSTANTS, True), (PUBLIC_PREFIXES, False)):
        for value in map(bytes.fromhex, values):
            p = data.find(value)
            while p >= 0:
                found.append((p, len(value), anywhere))
                p = data.find(value, p + 1)
    return found


def first_keys(candidates: DataFrame, first: int = 10) -> DataFrame:
    """The ``first`` key candidates of each file by offset, with the file's total and flag."""
    total = candidates.groupBy(F.col("file_id").alias("_f")).agg(F.count("*").alias("total_found"))
    ranked = candidates.withColumn("ord", F.row_number().over(Window.partitionBy("file_id").orderBy("offset", "section")))
    return ranked.filter(F.col("ord") <= first).join(total, F.col("file_id").eqNullSafe(F.col("_f"))).drop("_f").withColumn("has_hardcoded_keys", F.lit(True))


def first_key_windows(sections: DataFrame, sizes=KEY_SIZES, first: int = 10) -> DataFrame:
    """The rows of ``first_keys(key_windows(sections))``; a file with one data section is searched once, and is cut and counted where it is searched.

    Only the windows of files with several data sections are counted by file, ranked and exchanged; a count of such files is written first.
    """
    rows = _data_sections(sections)
    sums = rows.groupBy(F.col("file_id").alias("_f")).agg(F.count("*").alias("n"), F.count_distinct("section").alias("n_names"))
    several = written(sums.filter("n > 1"), "files")
    held, named_twice = several.agg(F.count("*"), F.count_if(F.col("n") > F.col("n_names"))).first()
    several = F.broadcast(several) if held <= SEVERAL else several
    alone, some = (rows.join(several, F.col("file_id").eqNullSafe(F.col("_f")), how) for how in ("left_anti", "left_semi"))
    shared = _least(_windows(some, sizes)) if named_twice else _windows(some, sizes)
    own = _windows(alone, sizes, first).select("file_id", "section", "offset", "size", "hexed", key_type(F.col("size")).alias("key_type"), "ord", "total_found", F.lit(True).alias("has_hardcoded_keys"))
    return own.unionByName(first_keys(_with_type(shared), first))
