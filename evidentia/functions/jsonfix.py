"""Repair of JSON texts that a model cut off or wrapped in prose."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from evidentia.session import python_workers


def closed(text: str) -> str:
    """``text`` with an open string, then open arrays and objects closed from the inside out; what follows the top value is cut off."""
    stack, inside, escaped = [], False, False
    for i, c in enumerate(text):
        if inside:
            inside, escaped = (c != '"' or escaped), (c == "\\" and not escaped)
        elif c == '"':
            inside = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]" and stack:
            stack.pop()
            if not stack:
                return text[: i + 1]
    out = text[:-1] if escaped else text
    return (out + '"' if inside else re.sub(r"[,:\s]+$", "", out)) + "".join(reversed(stack))


def repaired(text: str | None) -> str | None:
    """The JSON value in ``text`` as compact JSON, else null: tried as it is, out of a fence, from its first bracket, closed, without trailing commas."""
    if text is None:
        return None
    fence = re.search(r"```(?:json)?\s*(.*?)(?:```|\Z)", text, re.S)
    start = re.search(r"[\[{]", fence[1] if fence else text)
    core = (fence[1] if fence else text)[start.start() :] if start else text
    tries = [text, core, closed(core)]
    tries += [re.sub(r",(\s*[}\]])", r"\1", x) for x in tries[1:]]
    cut = core
    for _ in range(3):  # a dangling key or value: go back to the last comma
        cut = cut.rpartition(",")[0]
        tries.append(re.sub(r",(\s*[}\]])", r"\1", closed(cut)))
    for t in tries:
        try:
            return json.dumps(json.loads(t.strip(), strict=False), separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            continue
    return None


@F.pandas_udf(StringType())
def _repair(texts: pd.Series) -> pd.Series:
    return texts.map(repaired)


def parsed_json(text: Column) -> Column:
    """Valid JSON goes through in the JVM; only the rest is repaired in Python."""
    return F.when(F.try_parse_json(text).isNotNull(), text).otherwise(_repair(text))


def checked(df: DataFrame, text: str, fallback: str = "{}") -> DataFrame:
    """``df`` with json (parsed, repaired or ``fallback``), how, and the raw text of what failed, for a quarantine table."""
    python_workers(df.sparkSession)
    fixed = df.withColumn("_fixed", _repair(F.when(F.try_parse_json(F.col(text)).isNull(), F.col(text))))
    how = F.when(F.try_parse_json(F.col(text)).isNotNull(), "parsed").when(F.col("_fixed").isNotNull(), "repaired").otherwise("fallback")
    out = fixed.withColumn("how", how).withColumn("json", F.when(F.col("how") == "parsed", F.col(text)).otherwise(F.coalesce("_fixed", F.lit(fallback))))
    return out.withColumn("quarantined", F.when(F.col("how") == "fallback", F.col(text))).drop("_fixed")
