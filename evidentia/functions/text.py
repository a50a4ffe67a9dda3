"""Column functions over strings and byte blobs; all native expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The keywords that mark a string as interesting.
KEYWORDS = (
    "aes", "rsa", "des", "sha", "md5", "encrypt", "decrypt", "cipher",
    "key", "hash", "crypto", "ssl", "tls", "openssl", "blowfish",
    "rc4", "chacha", "curve25519", "ecdsa", "pbkdf", "bcrypt",
)


def latin1(data: Column) -> Column:
    """Bytes as a string of one character a byte, so that places in it are byte offsets."""
    return F.decode(data, "ISO-8859-1")


def printable_runs(text: Column, least: int = 4, closed: bool = False) -> Column:
    """Maximal runs of printable ASCII of at least ``least`` characters; ``closed`` drops one that reaches the end."""
    tail = r"(?=[^\x20-\x7e])" if closed else ""
    pattern = rf"[\x20-\x7e]{{{least},}}{tail}"
    if not closed:
        return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.regexp_extract_all(text, F.lit(rf"([\x20-\x7e]{{{least},}}+)(?=[^\x20-\x7e])"), F.lit(1))


def has_keyword(text: Column, keywords=KEYWORDS) -> Column:
    """Whether any keyword is a part of ``text``, in any case."""
    return F.lower(text).rlike("|".join(keywords))


def hex_address(address: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(address)))


def little_endian(four_bytes: Column) -> Column:
    """A 4-byte binary as an unsigned little-endian number."""
    h = F.hex(four_bytes)
    return F.conv(F.concat(*(F.substring(h, i, 2) for i in (7, 5, 3, 1))), 16, 10).cast("long")


def byte_values(hexed: Column) -> Column:
    """The bytes of a hexadecimal string as an array of numbers."""
    return F.transform(F.sequence(F.lit(1), F.length(hexed) - 1, F.lit(2)), lambda i: F.conv(F.substr(hexed, i, F.lit(2)), 16, 10).cast("int"))


def entropy_of(values: Column) -> Column:
    """Shannon entropy in bits of an array's values; 0 for an empty array."""
    n = F.size(values)
    counts = F.transform(F.array_distinct(values), lambda v: F.size(F.filter(values, lambda x: x == v)))
    bits = F.aggregate(counts, F.lit(0.0), lambda a, c: a - (c / n) * F.log2(c / n))
    return F.when(n > 0, bits).otherwise(F.lit(0.0))


def estimated_tokens(text: Column, per_token: float = 3.5) -> Column:
    return F.floor(F.length(text) / F.lit(per_token)).cast("long")


def complexity(edges: Column, nodes: Column, blocks: Column) -> Column:
    """Cyclomatic complexity edges - nodes + 2, not below 0; 0 without nodes; the block count where the graph is unknown."""
    return F.when(nodes == 0, F.lit(0)).when(edges.isNull() | nodes.isNull(), blocks).otherwise(F.greatest(edges - nodes + 2, F.lit(0)))
