"""Line dedup by site-relative frequency: lines on too many of a host's pages are boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evidentia.llm.shared import materialize

#: A line goes if more than this share of its host's pages hold it ...
MAX_RATIO = 0.08
#: ... and at least this many pages do.
MIN_PAGES = 4
#: Up to so many flagged lines (16 bytes each, so 8 MB) the flags are broadcast; beyond it they are joined by a shuffle.
BROADCAST_LINES = 500_000


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    """Two independent 64-bit hashes of the trimmed line."""
    return F.struct(F.xxhash64(F.trim(line)).alias("h1"), F.xxhash64(F.lit("line"), F.trim(line)).alias("h2"))


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, line key, pages, host_pages) of each line that too many pages of its host hold.

    A page counts once for a line however often it repeats it. Only line hashes are shuffled, combined before the exchange, so neither a
    host with a third of all rows nor a line on every page lands in one task. A null host counts as the host ''.
    """
    pages = docs.select(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("_host"), F.col(text).alias("_text"))
    totals = pages.groupBy("_host").agg(F.count("*").alias("host_pages"))
    keys = F.array_distinct(F.transform(F.filter(_lines(F.col("_text")), lambda x: F.trim(x) != ""), _key))
    counts = pages.select("_host", F.explode(keys).alias("key")).groupBy("_host", "key").agg(F.count("*").alias("pages"))
    many = counts.filter(F.col("pages") >= min_pages)
    return many.join(totals, "_host").filter(F.col("pages") > F.lit(max_ratio) * F.col("host_pages"))


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, out: str = "kept_text") -> DataFrame:
    """``docs`` plus ``out`` (the text without boilerplate lines), ``n_lines`` (lines with text) and ``n_dropped``.

    Lines are the \\n-split pieces, compared without outer blanks; blank lines stay. Every row stays, also one that loses all its lines.
    A null text gives a null ``out`` and zero counts; columns of ``docs`` named like the outputs are replaced.
    The flags of one host are at most (its distinct lines a page) / max_ratio, so one host's list stays small whatever its size.
    """
    new = (out, "n_lines", "n_dropped")
    flagged = materialize(boilerplate(docs, host, text, max_ratio, min_pages), "boilerplate")
    small = flagged.count() <= BROADCAST_LINES
    flags = flagged.groupBy("_host").agg(F.collect_list(F.col("key.h1")).alias("_h1"), F.collect_list("key").alias("_keys"))
    # The row travels as one struct, so none of its columns can clash with those used here.
    keyed = docs.select(F.struct("*").alias("_row")).withColumn("_host", F.coalesce(F.col("_row")[host].cast("string"), F.lit("")))
    joined, t = keyed.join(F.broadcast(flags) if small else flags, "_host", "left"), F.col("_row")[text]
    bad = lambda x: F.array_contains(F.col("_h1"), F.xxhash64(F.trim(x))) & F.array_contains(F.col("_keys"), _key(x))
    full = lambda a: F.size(F.filter(a, lambda x: F.trim(x) != ""))
    kept = F.when(F.col("_h1").isNull(), _lines(t)).otherwise(F.filter(_lines(t), lambda x: (F.trim(x) == "") | ~bad(x)))
    done = joined.withColumn("_kept", kept).withColumn("_n", F.when(t.isNull(), F.lit(0)).otherwise(full(_lines(t))).cast("long"))
    dropped = F.when(t.isNull(), F.lit(0)).otherwise(F.col("_n") - full(F.col("_kept"))).cast("long")
    rest = [F.col("_row")[c].alias(c) for c in docs.columns if c not in new]
    return done.select(*rest, F.array_join("_kept", "\n").alias(out), F.col("_n").alias("n_lines"), dropped.alias("n_dropped"))


ORACLE = f"""
WITH l AS (SELECT doc_id, coalesce(source, '') AS host, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
p AS (SELECT coalesce(source, '') AS host, count(*) AS host_pages FROM documents GROUP BY 1),
f AS (SELECT host, trim(line) AS t FROM l JOIN p USING (host) WHERE trim(line) <> '' GROUP BY host, trim(line), host_pages
      HAVING count(DISTINCT doc_id) >= {MIN_PAGES} AND count(DISTINCT doc_id) > {MAX_RATIO}::DOUBLE * host_pages),
m AS (SELECT l.*, f.t IS NOT NULL AS bad FROM l LEFT JOIN f ON l.host = f.host AND trim(l.line) = f.t),
g AS (SELECT doc_id, count(*) FILTER (trim(line) <> '') AS n_lines, count(*) FILTER (bad) AS n_dropped, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT bad) AS k FROM m GROUP BY doc_id)
SELECT d.doc_id, d.source, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k, '') END AS kept_text
FROM documents d LEFT JOIN g USING (doc_id)
"""
