"""A cache of answers as state of a stream: which requests it answers, and which fill it."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from evidentia.operators import ledger
from evidentia.session import python_workers


#: Keys are dealt to so many buckets; a bucket's entries are one row of state. A running stream must keep its number.
BUCKETS = 1024


def cached_requests(requests: DataFrame, ttl: int = ledger.TTL_SECONDS, late: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """(id, key, hit, entry_id) of a stream of ``requests`` (id, key, ts): whether the cache answers, and the request whose answer it gives.

    A request without a live entry is a miss and makes the entry, its own id being entry_id; an entry lives ``ttl`` seconds, its last moment included, and
    hits do not renew it. Requests of one micro-batch come in order of (ts, id); one that comes after an entry of a later time is a hit. State is
    one entry a key, dropped when the watermark has passed its end; rows later than ``late`` behind the newest may be dropped by Spark. Keys are
    judged a bucket at a time, as a call of Python costs more than a key's rows do; a task holds a bucket's entries and its rows of a micro-batch, so
    memory follows the source's limit on a micro-batch, and ``buckets`` should grow with the keys that live at once. Requests with a null key or
    time, or a time not after 1970 began (where watermarks start), are never cached: each is a miss without an entry. Extra columns are left out.
    """
    python_workers(requests.sparkSession, 10_000)
    kinds = {f.name: f.dataType.simpleString() for f in requests.select("id", "key").schema}
    life = ttl * 1_000_000

    def ask(_: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        live = {n: (t, i) for n, t, i in zip(*state.get, strict=True)} if state.exists else {}
        answers = [] if state.hasTimedOut else [_judged(pd.concat(list(chunks)), live, life)]
        # What ends before the watermark is no more of use; a timeout must lie behind it.
        now = state.getCurrentWatermarkMs()
        live = {n: e for n, e in live.items() if (e[0] + life) // 1000 + 1 >= now}
        if live:
            state.update((list(live), [e[0] for e in live.values()], [e[1] for e in live.values()]))
            state.setTimeoutTimestamp(max((min(e[0] for e in live.values()) + life) // 1000 + 1, now + 1))
        elif state.exists:
            state.remove()
        yield from answers

    timed = requests.select("id", "key", F.col("ts").cast("timestamp").alias("ts"))
    able = F.col("key").isNotNull() & F.coalesce(F.unix_micros("ts") > 0, F.lit(False))
    asked = timed.filter(able).withWatermark("ts", late).withColumn("at", F.unix_micros("ts")).withColumn("name", _name(kinds["key"]))
    asked = asked.withColumn("bucket", F.pmod(F.xxhash64("name"), F.lit(buckets)))
    schema = f"id {kinds['id']}, key {kinds['key']}, hit boolean, entry_id {kinds['id']}"
    held = f"names array<string>, began array<long>, entries array<{kinds['id']}>"
    known = asked.groupBy("bucket").applyInPandasWithState(ask, schema, held, "append", GroupStateTimeout.EventTimeTimeout)
    alone = timed.filter(~able).select("id", "key", F.lit(False).alias("hit"), F.lit(None).cast(kinds["id"]).alias("entry_id"))
    return known.unionByName(alone)


def _judged(rows: pd.DataFrame, live: dict[str, tuple[int, Any]], life: int) -> pd.DataFrame:
    """One bucket's ``rows`` (id, key, name, at) as answers; ``live`` (name -> time and id of the entry) is brought up to date."""
    codes, names = pd.factorize(rows["name"])
    order = np.lexsort((rows["id"].to_numpy(), rows["at"].to_numpy(np.int64), codes))
    rows = rows.iloc[order]
    at, ids = rows["at"].tolist(), rows["id"].to_numpy()
    ends = np.cumsum(np.bincount(codes, minlength=len(names))).tolist()
    hit, entry = np.ones(len(at), bool), np.empty(len(at), ids.dtype)
    i = 0
    for name, end in zip(names, ends, strict=True):
        began, first = live.get(name, (None, None))
        while i < end:
            if began is None or at[i] - began > life:
                began, first, hit[i] = at[i], ids[i], False
            # Sorted, so what one entry answers is a stretch.
            j = max(bisect_right(at, began + life, i, end), i + 1)
            entry[i:j], i = first, j
        live[name] = began, _plain(first)
    return pd.DataFrame({"id": ids, "key": rows["key"].to_numpy(), "hit": hit, "entry_id": entry})


def _name(kind: str) -> Column:
    """The key as a string, equal just where keys of this type are."""
    key = F.col("key")
    if kind == "binary":
        return F.hex(key)
    if kind in ("float", "double"):
        return (key + F.lit(0.0)).cast("string")
    if kind == "timestamp":
        return F.unix_micros(key).cast("string")
    return F.to_json(F.struct(key)) if "<" in kind else key.cast("string")


def _plain(value: Any) -> Any:
    """A numpy scalar as Python's own."""
    return value.item() if isinstance(value, np.generic) else value
