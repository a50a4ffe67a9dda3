"""Dictionary files: nested JSON maps of varying shape, unfolded into typed dimension tables.

Each reader takes ``raw``, a DataFrame with one JSON text a row in column value: ``dictionary(spark, path)``, or ``inline(spark, ...)`` for the fixed values below.
A text that is no JSON gives no rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

# Instruction patterns by architecture.
ISA = {
    "architectures": {
        "ARM": {"common_crypto_patterns": {"xor_cipher": {"instructions": ["EOR", "VEOR"], "min_occurrences": 5, "confidence": 0.6}, "rotation": {"instructions": ["ROR", "ROL", "LSL", "LSR"], "min_occurrences": 3, "confidence": 0.5}, "table_lookup": {"instructions": ["LDR", "LDRB"], "min_occurrences": 4, "confidence": 0.6}}},
        "x86": {"common_crypto_patterns": {"xor_cipher": {"instructions": ["XOR", "PXOR"], "min_occurrences": 5, "confidence": 0.6}, "rotation": {"instructions": ["ROL", "ROR", "SHLD", "SHRD"], "min_occurrences": 3, "confidence": 0.5}, "table_lookup": {"instructions": ["MOV", "MOVZX"], "min_occurrences": 4, "confidence": 0.6}, "byte_swap": {"instructions": ["BSWAP", "XCHG"], "confidence": 0.5}}},
        "MIPS": {"common_crypto_patterns": {"xor_cipher": {"instructions": ["XOR", "XORI"], "min_occurrences": 5, "confidence": 0.6}, "rotation": {"instructions": ["SLL", "SRL", "ROTR"], "min_occurrences": 3, "confidence": 0.5}, "table_lookup": {"instructions": ["LB", "LBU", "LW"], "min_occurrences": 4, "confidence": 0.6}}},
        "RISC-V": {"common_crypto_patterns": {"xor_cipher": {"instructions": ["XOR", "XORI"], "min_occurrences": 5, "confidence": 0.6}, "rotation": {"instructions": ["SLLI", "SRLI", "ROL", "ROR"], "min_occurrences": 3, "confidence": 0.5}}},
        "AVR": {"common_crypto_patterns": {"xor_cipher": {"instructions": ["EOR"], "min_occurrences": 5, "confidence": 0.6}, "rotation": {"instructions": ["LSL", "LSR", "ROL", "ROR"], "min_occurrences": 3, "confidence": 0.5}, "table_lookup": {"instructions": ["LPM", "LD"], "min_occurrences": 4, "confidence": 0.6}}},
    }
}
# What raises the confidence in a protocol.
INDICATORS = {
    "protocol_indicators": {
        "network_communication": {"function_names": ["connect", "send", "recv", "socket", "bind", "listen", "SSL_connect", "SSL_write", "SSL_read"], "confidence_boost": 0.3},
        "key_exchange": {"patterns": ["diffie_hellman", "ecdh", "rsa_key_exchange"], "confidence_boost": 0.4},
        "session_management": {"keywords": ["session", "handshake", "negotiate", "establish", "cipher_suite", "key_schedule"], "confidence_boost": 0.2},
    }
}


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def inline(spark: SparkSession, *values: dict) -> DataFrame:
    return spark.createDataFrame([(json.dumps(v),) for v in values], "value string")


def entries(raw: DataFrame) -> DataFrame:
    """(family, field, pos, text, number): every leaf of a map of maps, whatever its shape.

    A single value has pos 0, a list one row an element; number reads decimal and 0x texts (null for others). Objects and lists inside a list keep their JSON as text.
    """
    return raw.sparkSession.sql(
        """
        WITH leaves AS (
          SELECT f.key AS family, g.key AS field, CASE WHEN schema_of_variant(g.value) LIKE 'ARRAY%' THEN g.value ELSE parse_json('[' || to_json(g.value) || ']') END AS list
          FROM (SELECT try_parse_json(value) AS v FROM {raw}) AS r, LATERAL variant_explode(r.v) AS f, LATERAL variant_explode(f.value) AS g),
        flat AS (SELECT family, field, e.pos, coalesce(try_variant_get(e.value, '$', 'string'), to_json(e.value)) AS text FROM leaves, LATERAL variant_explode(leaves.list) AS e)
        SELECT family, field, pos, text,
          CASE WHEN text RLIKE '^0[xX][0-9a-fA-F]{{1,16}}$' THEN CAST(conv(substr(text, 3), 16, 10) AS DECIMAL(20, 0)) ELSE try_cast(text AS DECIMAL(20, 0)) END AS number
        FROM flat""",
        raw=raw,
    )


def isa_table(raw: DataFrame) -> DataFrame:
    """(isa, pattern, mnemonic, min_occurrences, confidence): common patterns and those of extensions; 1 occurrence and confidence 0 where none is given."""
    return raw.sparkSession.sql(
        """
        WITH a AS (SELECT f.key AS isa, f.value AS v FROM (SELECT try_parse_json(value) AS v FROM {raw}) AS r, LATERAL variant_explode(try_variant_get(r.v, '$.architectures', 'variant')) AS f),
        p AS (
          SELECT isa, e.key AS pattern, e.value AS v FROM a, LATERAL variant_explode(try_variant_get(a.v, '$.common_crypto_patterns', 'variant')) AS e
          UNION ALL
          SELECT isa, try_variant_get(q.value, '$.name', 'string'), q.value
          FROM a, LATERAL variant_explode(try_variant_get(a.v, '$.crypto_extensions', 'variant')) AS x, LATERAL variant_explode(try_variant_get(x.value, '$.patterns', 'variant')) AS q)
        SELECT DISTINCT isa, pattern, upper(try_variant_get(m.value, '$', 'string')) AS mnemonic,
          coalesce(try_variant_get(p.v, '$.min_occurrences', 'int'), 1) AS min_occurrences, coalesce(try_variant_get(p.v, '$.confidence', 'double'), 0D) AS confidence
        FROM p, LATERAL variant_explode(try_variant_get(p.v, '$.instructions', 'variant')) AS m""",
        raw=raw,
    )


def boost_table(raw: DataFrame) -> DataFrame:
    """(indicator, term, boost): the terms of every list of an indicator, in lower case."""
    return raw.sparkSession.sql(
        """
        WITH i AS (SELECT f.key AS indicator, f.value AS v FROM (SELECT try_parse_json(value) AS v FROM {raw}) AS r, LATERAL variant_explode(try_variant_get(r.v, '$.protocol_indicators', 'variant')) AS f),
        l AS (SELECT indicator, try_variant_get(i.v, '$.confidence_boost', 'double') AS boost, e.value AS list FROM i, LATERAL variant_explode(i.v) AS e WHERE schema_of_variant(e.value) LIKE 'ARRAY%')
        SELECT DISTINCT indicator, lower(try_variant_get(t.value, '$', 'string')) AS term, boost FROM l, LATERAL variant_explode(l.list) AS t""",
        raw=raw,
    )
