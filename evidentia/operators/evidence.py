"""Evidence of different worth: fusion by trusted source, boosts, and what names tell of ciphers and operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evidentia.functions.classify import first_of

# Sources of evidence, most trusted first, and the trust in each.
TRUST = (("inferred", 0.95), ("constant", 0.90), ("name", 0.70), ("string", 0.50))
#: No fused confidence is above this.
CAP = 0.99
# Block sizes in bits, and the modes that do or do not take an initial value.
BLOCK_BITS = (("AES", 128), ("DES", 64), ("BLOWFISH", 64), ("TWOFISH", 128), ("IDEA", 64), ("CAMELLIA", 128))
MODES = ("GCM", "CCM", "CBC", "CTR", "ECB", "CFB", "OFB", "XTS")
WITH_IV = ("CBC", "CTR", "GCM", "CCM")
# Words of function names and the operation they stand for, special ones first.
OPERATIONS = (
    ("sub_bytes|sbox|substitut", "substitute"),
    ("shift_rows|permut|pbox", "permutation"),
    ("mod_exp|modular_mult|modexp", "modular_arithmetic"),
    ("expand|schedule", "key_expansion"),
    ("mix_columns|round", "round_function"),
    ("compress|digest|hash", "compression"),
    ("padding|pkcs|oaep", "padding"),
    ("base64|hex|encode|decode", "encoding"),
    ("xor", "xor"),
    ("rotl|rotr|rotate", "rotation"),
    ("shift", "shift"),
    ("add", "addition"),
)
ROLES = (("encrypt|decrypt", "encryption"), ("hash|digest|compress", "hash"), ("sign|verify", "signature"), ("expand|schedule", "key_derivation"))


def boosts(names: DataFrame, terms: DataFrame, by: str = "file_id", text: str = "text") -> DataFrame:
    """(by, boost, indicators): the boosts of all indicators (indicator, term, boost) with a term among the words of ``names``, each indicator once.

    Words are runs of letters, digits and underscores, case folded; they meet terms by equality, so the dictionary can be of any size, and a task passes on
    each (by, word) once. Rows with a null ``by`` or text give nothing.
    """
    words = names.filter(F.col(by).isNotNull()).select(by, F.explode(F.array_distinct(F.split(F.lower(text), "[^a-z0-9_]+"))).alias("term")).filter("term <> ''")
    hits = words.join(terms.select("term", "indicator", "boost").distinct(), "term").groupBy(by, "indicator").agg(F.max("boost").alias("boost"))
    return hits.groupBy(by).agg(F.round(F.sum("boost"), 4).alias("boost"), F.array_join(F.array_sort(F.collect_set("indicator")), ",").alias("indicators"))


def fused(evidence: DataFrame, raised: DataFrame | None = None, by: str = "file_id", cap: float = CAP) -> DataFrame:
    """(by, algorithm, source, n_sources, confidence) from rows (by, algorithm, source, confidence): the most trusted source decides.

    Its best confidence (null: 0; kept in 0 to 1) times the trust in it is raised by the file's boost, up to ``cap``. Sources that are not in TRUST count
    only where there is no other, with no trust; weaker sources never change a stronger one's word. Null algorithms are dropped.
    """
    rank = first_of([(F.col("source") == s, i) for i, (s, _) in enumerate(TRUST)], len(TRUST))
    own = F.least(F.greatest(F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    rows = evidence.filter("algorithm IS NOT NULL").select(by, "algorithm", rank.alias("_rank"), own.alias("_own"))
    best = rows.groupBy(by, "algorithm").agg(F.min("_rank").alias("_rank"), F.min(F.struct("_rank", (-F.col("_own")).alias("_neg"))).alias("_best"), F.size(F.collect_set("_rank")).alias("n_sources"))
    trust, name = F.get(F.array(*(F.lit(t) for _, t in TRUST)), "_rank"), F.get(F.array(*(F.lit(s) for s, _ in TRUST)), "_rank")
    out = best.select(by, "algorithm", F.coalesce(name, F.lit("other")).alias("source"), "n_sources", (F.coalesce(trust, F.lit(0.0)) * -F.col("_best._neg")).alias("_c"))
    boost = F.lit(0.0)
    if raised is not None:
        out = out.join(raised.select(by, F.col("boost").alias("_boost")), by, "left")
        boost = F.coalesce("_boost", F.lit(0.0))
    return out.select(by, "algorithm", "source", "n_sources", F.round(F.least(F.col("_c") + boost, F.lit(cap)), 4).alias("confidence"))


def cipher_traits(algorithm: Column, hints: Column | None = None) -> Column:
    """struct(cipher_type, mode_of_operation, key_size_bits, block_size_bits, iv_nonce_required); a null where the rules say nothing.

    ``hints`` are other texts that may name the mode. Hashes have no cipher type and no key size; only block ciphers have a mode and a block size.
    """
    name = F.upper(F.coalesce(algorithm, F.lit("")))
    none = F.lit(None).cast("string")
    kind = first_of([(name.rlike("SHA-?3|KECCAK"), "sponge"), (name.rlike("RC4|CHACHA20|SALSA20"), "stream"), (name.rlike("|".join(n for n, _ in BLOCK_BITS)), "block")], none)
    said = F.concat_ws(" ", name, F.upper(hints)) if hints is not None else name
    mode = F.nullif(F.regexp_extract(said, f"(?:^|[^A-Z0-9])({'|'.join(MODES)})(?:[^A-Z0-9]|$)", 1), F.lit(""))
    mode = F.when(kind == "block", mode)
    bits = F.nullif(F.regexp_extract(name, "(?:^|[^0-9])(128|192|256|512|1024|2048|3072|4096)(?:[^0-9]|$)", 1), F.lit(""))
    bits = F.when(~name.rlike("SHA|MD5|BLAKE|KECCAK"), bits.cast("int"))
    size = F.when(kind == "block", first_of([(name.contains(n), b) for n, b in BLOCK_BITS], F.lit(None).cast("int")))
    iv = F.when(mode.isin(*WITH_IV), True).when(mode == "ECB", False)
    return F.struct(kind.alias("cipher_type"), mode.alias("mode_of_operation"), bits.alias("key_size_bits"), size.alias("block_size_bits"), iv.alias("iv_nonce_required"))


def operation_of(name: Column) -> Column:
    """The operation that a function's name stands for; 'unknown' for others."""
    low = F.lower(F.coalesce(name, F.lit("")))
    return first_of([(low.rlike(words), op) for words, op in OPERATIONS], "unknown")


def role_of(name: Column) -> Column:
    low = F.lower(F.coalesce(name, F.lit("")))
    return first_of([(low.rlike(words), role) for words, role in ROLES], "unknown")
