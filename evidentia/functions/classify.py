"""Ordered classifications: the first condition that holds decides."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def first_of(cases: list[tuple[Column, object]], otherwise) -> Column:
    out = None
    for condition, value in cases:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def algorithm_of_constant(name: Column) -> Column:
    families = [
        (("AES",), "AES"),
        (("CHACHA", "SALSA"), "ChaCha20/Salsa20"),
        (("SHA256",), "SHA-256"),
        (("SHA512",), "SHA-512"),
        (("SHA1",), "SHA-1"),
        (("MD5",), "MD5"),
        (("DES",), "DES/3DES"),
        (("SECP", "P256"), "ECC"),
        (("BLAKE",), "BLAKE2"),
        (("RC4",), "RC4"),
        (("BASE64",), "Base64"),
    ]
    return first_of([(name.rlike("|".join(words)), family) for words, family in families], "Unknown")


def key_type(size: Column) -> Column:
    kinds = {8: "DES key or IV", 16: "AES-128 key or IV", 24: "3DES or AES-192 key", 32: "AES-256 key or ChaCha20 key"}
    return first_of([(size == k, v) for k, v in kinds.items()], "Unknown")


def constant_confidence(largest_group: Column) -> Column:
    return first_of([(largest_group >= 4, "very_high"), (largest_group >= 2, "high"), (largest_group >= 1, "medium")], "low")


def xor_pattern(n: Column) -> Column:
    return first_of([(n >= 8, "key_schedule or stream_cipher"), (n >= 5, "key_mixing or round_function"), (n >= 3, "basic_crypto_operation")], "unknown")


def rotation_family(amounts: Column) -> Column:
    """By any of the amounts, in this order, so 7 and 12 always name the first family."""
    any_of = lambda *x: F.arrays_overlap(amounts, F.array(*(F.lit(v) for v in x)))
    return first_of(
        [
            (F.coalesce(F.size(amounts), F.lit(0)) <= 0, "unknown_arx_cipher"),
            (any_of(16, 12, 8, 7), "ChaCha20 (signature rotations: 16, 12, 8, 7)"),
            (any_of(2, 13, 22, 6, 11, 25), "SHA-256 (signature rotations)"),
            (any_of(7, 12, 17, 22), "MD5 (signature rotations)"),
        ],
        "unknown_arx_cipher",
    )


def mixing_pattern() -> Column:
    """From the count columns n_xor, n_add, n_rotate, n_shift, n_and, n_or."""
    c = F.col
    return first_of(
        [
            ((c("n_add") >= 3) & (c("n_xor") >= 3) & (c("n_rotate") >= 2), "ARX_cipher (ChaCha20/Salsa20 style)"),
            ((c("n_xor") >= 4) & (c("n_shift") + c("n_rotate") >= 3), "SPN_cipher (AES style)"),
            ((c("n_xor") >= 3) & (c("n_and") >= 2) & (c("n_or") >= 2), "hash_function (SHA/MD5 style)"),
        ],
        "general_crypto_mixing",
    )


def characteristics(score: Column) -> Column:
    return first_of(
        [
            (score >= 0.9, "Very strong crypto characteristics - highly likely contains cryptographic code"),
            (score >= 0.7, "Strong crypto characteristics - likely contains cryptographic code"),
            (score >= 0.5, "Moderate crypto characteristics - possibly contains cryptographic code"),
            (score >= 0.3, "Weak crypto characteristics - may contain some crypto operations"),
        ],
        "Minimal crypto characteristics - unlikely to contain significant cryptographic code",
    )


def rounds(blocks: Column) -> Column:
    """Rounds by a loop's block count; 14 blocks count as 12 rounds."""
    return first_of([(blocks.between(10, 12), 10), (blocks.between(13, 14), 12), (blocks.between(16, 17), 16), (blocks.between(18, 20), 20)], blocks)


def round_algorithm(n: Column, feistel: Column) -> Column:
    unknown = F.format_string("Unknown cipher (%d rounds)", n)
    return first_of([(n == 10, "AES-128"), (n == 12, "AES-192"), (n == 14, "AES-256"), (n == 16, F.when(feistel, "DES").otherwise("DES or AES")), (n == 20, "ChaCha20/Salsa20")], unknown)


def confidence_band(score: Column) -> Column:
    """Bands of a detection's score; below 0.30 it is not reported (null)."""
    return first_of([(score >= 0.85, "very_high"), (score >= 0.70, "high"), (score >= 0.50, "moderate"), (score >= 0.30, "low")], F.lit(None).cast("string"))


def severity_rank(severity: Column) -> Column:
    return first_of([(F.lower(severity) == s, i) for i, s in enumerate(("critical", "high", "medium", "low"))], 4)
