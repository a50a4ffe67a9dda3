"""The language-model boundary: requests in, answers out, in batches inside tasks. Off unless a client is given."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from evidentia.operators import ledger
from evidentia.session import python_workers, written

SCHEMA = "key string, content string, input_tokens long, output_tokens long, duration_seconds double, attempts int, success boolean, error_message string"


class RateLimited(Exception):
    """A client raises this to ask for a longer pause."""


def complete(requests: DataFrame, client: Callable[[str, str], tuple[str, int, int]], retries: int = 2, pause: float = 1.0) -> DataFrame:
    """Answers to ``requests`` (key, model, prompt) by client(model, prompt) -> (content, input tokens, output tokens).

    A failed call is tried again up to ``retries`` times, after pauses that double (twice as long when rate-limited); what fails for good is a row with its error.
    """

    def one(model: str, prompt: str) -> tuple:
        error = ""
        for attempt in range(retries + 1):
            began = time.monotonic()
            try:
                content, i, o = client(model, prompt)
                return content, i, o, time.monotonic() - began, attempt + 1, True, None
            except Exception as x:  # any client error becomes a row
                error = f"{type(x).__name__}: {x}"
                if attempt < retries:
                    time.sleep(pause * 2**attempt * (2 if isinstance(x, RateLimited) else 1))
        return None, 0, 0, 0.0, retries + 1, False, error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, *one(m, p)) for k, m, p in zip(pdf["key"], pdf["model"], pdf["prompt"], strict=True)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    python_workers(requests.sparkSession)
    return requests.select("key", "model", "prompt").mapInPandas(run, SCHEMA)


def answered(requests: DataFrame, cache: DataFrame, client: Callable[[str, str], tuple[str, int, int]], now: Column, ttl: int = ledger.TTL_SECONDS, **kw) -> tuple[DataFrame, DataFrame]:
    """(answers, new entries): ``requests`` (id, key, model, prompt) through a cache (key, value, ts, ttl) in front of the client.

    A live entry answers without a call. Of other requests each key is asked once, whatever number of them share it; the answers are written before they
    are joined back, so that a lost executor or a second action does not ask again. New entries hold the successful answers only, to be appended to the
    cache. Requests with a null key are never cached: each is asked on its own and has no entry. An id must be unique.
    answers: id, key, content, success, cached, attempts, error_message.
    """
    requests = requests.withColumn("_key", F.coalesce(F.col("key"), F.concat(F.lit("\0"), F.col("id").cast("string"))))
    known = ledger.live(ledger.latest(cache), now).select(F.col("key").alias("_key"), "value")
    held = requests.join(known, "_key").select("id", "key", F.col("value").alias("content"), F.lit(True).alias("success"), F.lit(True).alias("cached"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("error_message"))
    missing = requests.join(known, "_key", "left_anti")
    asked = missing.groupBy("_key").agg(F.min(F.struct("model", "prompt")).alias("r")).select(F.col("_key").alias("key"), "r.model", "r.prompt")
    done = written(complete(asked, client, **kw), "answers")
    fresh = missing.join(done.withColumnRenamed("key", "_key"), "_key").select("id", "key", "content", "success", F.lit(False).alias("cached"), "attempts", "error_message")
    entries = done.filter("success AND NOT startswith(key, '\0')").select("key", F.col("content").alias("value"), now.alias("ts"), F.lit(ttl).alias("ttl"))
    return held.unionByName(fresh), entries
