"""Model calls: prices, cost roll-ups, response cache, model choice and batches under a token budget."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# Fixed values: (key, model, provider, price per 1000 input tokens, per 1000 output tokens, temperature, max tokens, timeout s, retries).
MODELS = (
    ("quick_classifier", "claude-3-5-haiku-20241022", "anthropic", 0.0008, 0.004, 0.1, 4000, 30, 3),
    ("main_analyzer", "claude-3-5-haiku-20241022", "anthropic", 0.0008, 0.004, 0.2, 8000, 120, 3),
    ("long_context_analyzer", "claude-3-5-haiku-20241022", "anthropic", 0.0008, 0.004, 0.2, 8000, 180, 3),
    ("reasoning_model", "claude-3-opus-20240229", "anthropic", 0.015, 0.075, 0.3, 4096, 300, 2),
)
FALLBACK = ("main_analyzer", "long_context_analyzer", "reasoning_model", "quick_classifier")
BY_ANALYSIS = {"quick_classify": "quick_classifier", "main_analysis": "main_analyzer", "long_context": "long_context_analyzer", "reasoning": "reasoning_model", "protocol_analysis": "reasoning_model"}
TTL_SECONDS = 86_400


def price_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([m[1:5] for m in MODELS], "model string, provider string, price_in double, price_out double").distinct()


def priced(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """``calls`` with provider and cost; an unknown model costs 0 and has the provider 'unknown'."""
    out = calls.drop("provider", "cost").join(F.broadcast(prices), "model", "left")
    cost = F.col("input_tokens") / 1000 * F.col("price_in") + F.col("output_tokens") / 1000 * F.col("price_out")
    return out.withColumn("cost", F.coalesce(cost, F.lit(0.0))).withColumn("provider", F.coalesce("provider", F.lit("unknown"))).drop("price_in", "price_out")


def cost_levels(calls: DataFrame, model: str = "model", provider: str = "provider", cost: str = "cost") -> DataFrame:
    """(level, model, provider, n_calls, total_cost): total, by model and by provider, in one pass of grouping sets."""
    sets = calls.groupingSets([[], [F.col(model)], [F.col(provider)]], F.col(model), F.col(provider))
    level = F.when(F.grouping(model) == 0, "model").when(F.grouping(provider) == 0, "provider").otherwise("total")
    return sets.agg(level.alias("level"), F.count("*").alias("n_calls"), F.sum(cost).alias("total_cost")).select("level", F.col(model).alias("model"), F.col(provider).alias("provider"), "n_calls", "total_cost")


def call_statistics(calls: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts, success rate, durations and mean cost; zeros where there are no calls."""
    rows = calls.groupBy(*(by or []))
    n = F.count("*")
    share = lambda x: F.coalesce(F.try_divide(x, n.cast("double")), F.lit(0.0))
    ok = F.count_if("success")
    zero = F.lit(0.0)
    return rows.agg(n.alias("total_calls"), ok.alias("successful_calls"), (n - ok).alias("failed_calls"), share(ok).alias("success_rate"), F.coalesce(F.avg("duration_seconds"), zero).alias("average_duration"), F.coalesce(F.sum("duration_seconds"), zero).alias("total_duration"), share(F.coalesce(F.sum("cost"), zero)).alias("avg_cost_per_call"))


def token_usage(calls: DataFrame, by: list[str] | None = None) -> DataFrame:
    z = F.lit(0)
    i, o = F.coalesce(F.sum("input_tokens"), z), F.coalesce(F.sum("output_tokens"), z)
    return calls.groupBy(*(by or [])).agg(i.alias("input_tokens"), o.alias("output_tokens"), (i + o).alias("total_tokens"))


def cost_report(calls: DataFrame) -> DataFrame:
    """One row: the whole report as a nested struct in JSON (column report), and as text (column text)."""
    total = call_statistics(calls).crossJoin(token_usage(calls)).crossJoin(calls.agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("total_cost")))
    maps = [calls.groupBy(k).agg(F.sum("cost").alias("c")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(k, "c")))).alias(f"by_{k}")) for k in ("model", "provider")]
    wide = reduce(DataFrame.crossJoin, [total, *maps])  # single rows: totals only
    text = F.format_string("Total cost: $%.6f\nCalls: %d (%d ok, %d failed)\nTokens: %d in, %d out", "total_cost", "total_calls", "successful_calls", "failed_calls", "input_tokens", "output_tokens")
    return wide.select(F.to_json(F.struct("*")).alias("report"), text.alias("text"))


def select_model(analysis: Column, attempt: Column) -> Column:
    """The model's key: the main one at first, then along the fallback order, its last for good."""
    order = F.array(*(F.lit(k) for k in FALLBACK))
    return F.when(attempt <= 0, F.lit("main_analyzer")).otherwise(F.get(order, F.least(attempt, F.lit(len(FALLBACK) - 1)).cast("int")))


def cheapest_model(analysis: Column) -> Column:
    """The model's key by kind of analysis, the main one for kinds that are not listed."""
    pairs = [F.lit(x) for kv in BY_ANALYSIS.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), analysis), F.lit("main_analyzer"))


def cache_key(version: Column, query: Column, context: Column, kind: Column) -> Column:
    """sha256 of version, query, the context map as JSON with sorted keys, and kind."""
    ordered = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(context))))
    return F.sha2(F.concat_ws(":", version, query, ordered, kind), 256)


def latest(cache: DataFrame) -> DataFrame:
    """The newest entry of each key (key, value, ts, ttl)."""
    return cache.groupBy("key").agg(F.max_by(F.struct("value", "ts", "ttl"), "ts").alias("e")).select("key", "e.*")


def live(cache: DataFrame, now: Column) -> DataFrame:
    """Entries that are not older than their time to live."""
    return cache.filter(now - F.col("ts") <= F.col("ttl"))


def cache_hits(requests: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """Requests with a live entry, and its value; what it once cost is reported, and nothing is billed."""
    return requests.join(live(latest(cache), now).select("key", "value"), "key").withColumn("billed_cost", F.lit(0.0))


def cache_misses(requests: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    return requests.join(live(latest(cache), now).select("key"), "key", "left_anti")


def cleaned(cache: DataFrame, now: Column) -> DataFrame:
    return live(latest(cache), now)


def deleted(cache: DataFrame, keys: DataFrame) -> DataFrame:
    return cache.join(keys, "key", "left_anti")


def evicted(cache: DataFrame, by: str | None = None) -> DataFrame:
    """What stays when the oldest third (at least one) of the entries goes; ``by`` does so for each partition of the cache."""
    keys = [by] if by else []
    count = cache.groupBy(*keys).agg(F.greatest(F.floor(F.count("*") / 3), F.lit(1)).alias("_out"))
    ranked = cache.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy("ts", "key")))
    joined = ranked.join(F.broadcast(count), keys) if keys else ranked.crossJoin(F.broadcast(count))
    return joined.filter(F.col("_rn") > F.col("_out")).drop("_rn", "_out")


def cache_stats(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count("*").alias("entries"), F.coalesce(F.sum(F.length("value")), F.lit(0)).alias("bytes"))


def token_batches(items: DataFrame, budget: int, by: str, order: str, tokens: str = "tokens") -> DataFrame:
    """``items`` with batch_number, total_batches, items_in_batch and estimated_tokens: greedy packing in order under ``budget``.

    An item over the budget gets a batch of its own; it closes the batch before it. Each ``by`` is packed on its own, as a stream: rows are sorted
    by (by, order) inside a partition and a task holds the running batch only, so a group of any size takes no memory. Each row goes through once, whole, so
    equal orders and null groups or orders (which come first) keep their rows; equal orders are packed by ascending tokens. A null token count is 0.
    Columns of ``items`` named like the outputs are replaced.
    """
    new = ("batch_number", "total_batches", "items_in_batch", "estimated_tokens")
    rest = [c for c in items.columns if c not in new]
    rows = items.select(F.col(by).alias("_g"), F.col(order).alias("_o"), F.coalesce(F.col(tokens).cast("long"), F.lit(0)).alias("_t"), F.struct(*rest).alias("_row"))
    schema = rows.select("_g", "_t", "_row").schema.add("_n", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, number, held = None, 0, 0
        for batch in batches:
            out = []
            for g, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if number == 0 or g != group:
                    group, number, held = g, 1, t
                elif t > budget or held + t > budget:
                    number, held = number + 1, t
                else:
                    held += t
                out.append(number)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], ["_g", "_t", "_row", "_n"])

    flat = rows.repartition("_g").sortWithinPartitions("_g", "_o", "_t").select("_g", "_t", "_row").mapInArrow(run, schema)
    info = flat.groupBy("_g", "_n").agg(F.count("*").alias("_items"), F.sum("_t").alias("_sum"))
    last = info.groupBy(F.col("_g").alias("_h")).agg(F.max("_n").alias("_last"))
    info = info.join(last, F.col("_g").eqNullSafe(F.col("_h"))).select(F.col("_g").alias("_h"), F.col("_n").alias("_m"), "_items", "_sum", "_last")
    joined = flat.join(info, F.col("_g").eqNullSafe(F.col("_h")) & (F.col("_n") == F.col("_m")))
    return joined.select(*(F.col("_row")[c].alias(c) for c in rest), F.col("_n").alias("batch_number"), F.col("_last").alias("total_batches"), F.col("_items").alias("items_in_batch"), F.col("_sum").alias("estimated_tokens"))


def stage_costs(calls: DataFrame, by: str = "file_id", stage: str = "stage") -> DataFrame:
    """(file, stage, n_calls, cost, duration_seconds, share): what each stage of a file's analysis cost, and its share of the file's cost; the row
    with a null stage sums the file up."""
    cost, time = F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"), F.coalesce(F.sum("duration_seconds"), F.lit(0.0)).alias("duration_seconds")
    sets = calls.groupingSets([[F.col(by)], [F.col(by), F.col(stage)]], F.col(by), F.col(stage)).agg(F.count("*").alias("n_calls"), cost, time)
    whole = F.max(F.when(F.col(stage).isNull(), F.col("cost"))).over(Window.partitionBy(by))
    return sets.withColumn("share", F.coalesce(F.try_divide("cost", whole), F.lit(0.0)))


def chunks(items: DataFrame, size: int, by: str, order: list[str]) -> DataFrame:
    """``items`` with a chunk number: ``size`` in each, in order."""
    rn = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return items.withColumn("chunk", F.floor((rn - 1) / size).cast("long"))


def should_batch(tokens: Column, functions: Column, budget: int = 50_000) -> Column:
    return (tokens > int(0.8 * budget)) | (functions > 50)
