"""Sharding by histogram sort: exact byte counts below probe keys, refined until the splitters are exact, then one exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from evidentia.llm.shared import dealt, materialize, partitions

N_SHARDS = 24
#: Probes a round in each open bracket.
PROBES = 4096
KEY_BITS = 60
#: A cell with more rows than this is dealt out by row number too.
ROWS_A_TASK = 200_000


def content_key(*columns: str) -> Column:
    """A uniform 60-bit key from the columns' values."""
    text = F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("long")


def _histogram(rows: DataFrame, key: str, brackets: list[tuple[int, int]]) -> dict[int, dict[int, tuple[int, int]]]:
    """For each bracket [lo, hi): cell -> (bytes, rows). At most PROBES cells a bracket come back, whatever the input."""
    chosen = None
    for k, (lo, hi) in enumerate(brackets):
        step = -(-(hi - lo) // PROBES)
        inside = (F.col(key) >= lo) & (F.col(key) < hi)
        value = F.struct(F.lit(k).alias("k"), F.expr(f"CAST(({key} - {lo}L) DIV {step}L AS INT)").alias("cell"))
        chosen = F.when(inside, value) if chosen is None else chosen.when(inside, value)
    cells = rows.select(chosen.alias("c"), "size").filter("c IS NOT NULL").groupBy("c.k", "c.cell").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    out: dict[int, dict[int, tuple[int, int]]] = {k: {} for k in range(len(brackets))}
    for r in cells.collect():
        out[r["k"]][r["cell"]] = (r["b"], r["n"])
    return out


def splitters(rows: DataFrame, key: str, targets: list[tuple[int, int]], top: int, below: int = 0, tolerance: int = 0) -> list[tuple[int, int, bool]]:
    """For each target (numerator, denominator): the least x with bytes(key < x) * denominator >= numerator, as (x, bytes below x, single).

    All open brackets are refined together, one aggregation a round. A bracket closes when it holds at most one row, when its bytes are within
    ``tolerance``, or when it is one key wide; ``single`` then says that many rows share that key. ``below``: bytes before this range.
    """
    state = {t: (0, top, below, None, None) for t in targets}  # lo, hi, bytes below lo, bytes and rows inside
    done: dict[tuple[int, int], tuple[int, int, bool]] = {}
    while len(done) < len(state):
        open_ = sorted({(s[0], s[1]) for t, s in state.items() if t not in done})
        cells = dict(zip(open_, _histogram(rows, key, open_).values(), strict=True))
        for t, (lo, hi, under, _, _) in state.items():
            if t in done:
                continue
            step, run, counts = -(-(hi - lo) // PROBES), under, cells[lo, hi]
            if run * t[1] >= t[0]:  # nothing below is needed
                done[t] = (lo, run, False)
                continue
            for cell in sorted(counts):
                b, n = counts[cell]
                if (run + b) * t[1] >= t[0]:
                    a, z = lo + cell * step, min(hi, lo + (cell + 1) * step)
                    if n <= 1 or b <= tolerance:
                        done[t] = (z, run + b, False)
                    elif z - a == 1:
                        done[t] = (a, run, True)
                    else:
                        state[t] = (a, z, run, b, n)
                    break
                run += b
            else:
                done[t] = (hi, run, False)
    return [done[t] for t in targets]


def _assigned(docs: DataFrame, doc_id: str, text: str, n_shards: int, tolerance: int, rows: bool = False) -> DataFrame:
    """(doc_id, size, text_crc32, _key, _uid, shard[, _row]) of every row: the splitters as one expression over a written key table, nothing exchanged."""
    keyed = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        content_key(doc_id).alias("_key"),
        F.monotonically_increasing_id().alias("_uid"),
        *([F.struct("*").alias("_row")] if rows else []),
    )
    keyed = materialize(keyed, "shard-keys")
    total, n_rows, last_uid = keyed.agg(F.sum("size"), F.count("*"), F.max("_uid")).first()
    shard_of = F.lit(0)
    if n_rows:
        targets = [(k * total, n_shards) for k in range(1, n_shards)]
        for t, (x, below, shared) in zip(targets, splitters(keyed, "_key", targets, 1 << KEY_BITS, tolerance=tolerance), strict=True):
            past = F.col("_key") >= x
            if shared:  # many rows with this very key: split them by row number
                ((y, _, _),) = splitters(keyed.filter(F.col("_key") == x), "_uid", [t], last_uid + 1, below)
                past = (F.col("_key") > x) | ((F.col("_key") == x) & (F.col("_uid") >= y))
            shard_of = shard_of + past.cast("int")
    return keyed.withColumn("shard", shard_of.cast("int"))


def shard(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_shards: int = N_SHARDS, tolerance: int = 0) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): shards 0 to n_shards-1 of near equal bytes, in the order of a content key.

    A row's size is the UTF-8 bytes of its text (null: none) plus 8. Row r goes to shard floor(n_shards * bytes before r / all bytes); with
    ``tolerance`` 0 that is exact, so shards differ by at most the size of one row. Rows with the same doc_id share a key; where a splitter
    falls among them they are split by their row number in the written key table, so one id with a third of all rows is no hot spot.
    The slot numbers a shard's rows from 0 without gaps, in key order. An empty table gives no rows. Only the counts of probe cells reach the driver: at
    most PROBES for each splitter, whatever the input. Rows move once, without their text.
    """
    placed = _assigned(docs, doc_id, text, n_shards, tolerance)
    n_rows = placed.count()
    bits = max(12, min(40, ((n_rows or 1) // 50_000).bit_length()))
    cells = placed.withColumn("_cell", F.shiftright("_key", KEY_BITS - bits))
    # A cell's rows are numbered in one task; a cell that repeated ids make large is dealt out by row number.
    large = cells.groupBy("shard", "_cell").agg(F.count("*").alias("n")).filter(F.col("n") > ROWS_A_TASK).select("shard", "_cell", F.ceil(F.col("n") / ROWS_A_TASK).alias("_ways"))
    cells = cells.join(large, ["shard", "_cell"], "left").withColumn("_part", F.coalesce(F.pmod("_uid", "_ways"), F.lit(0)))
    counts = cells.groupBy("shard", "_cell", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_cell", "_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_cell", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    group = ["shard", "_cell", "_part"]
    placed = dealt(cells, *group).withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy("_key", "_uid")) - 1)
    placed = placed.join(starts, group).withColumn("slot", (F.col("_start") + F.col("_rank")).cast("long"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", n_shards: int = N_SHARDS, tolerance: int = 0) -> None:
    """Write the rows of ``docs``, with all their columns, to ``folder``/shard=<n> in key order, sharded as ``shard`` does.

    Rows are written beside their keys and exchanged once, by range of (shard, key), so that a shard is several files of even size and no task holds a
    whole shard. A column of ``docs`` named shard is replaced; an empty table writes no shards.
    """
    placed = _assigned(docs, doc_id, text, n_shards, tolerance, rows=True)
    order = ["shard", "_key", "_uid"]
    moved = placed.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    rest = [F.col("_row")[c].alias(c) for c in docs.columns if c != "shard"]
    moved.select(*rest, "shard").write.partitionBy("shard").parquet(folder)


def _nibbles() -> list[int]:
    """The table of CRC-32 for four bits at a time, from its polynomial."""
    out = []
    for c in range(16):
        for _ in range(4):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


#: CRC-32 as a fold over the text's half bytes, the low half of each byte first.
CRC = f"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(regexp_replace(hex(encode(coalesce(text, ''))), '(.)(.)', '\\2\\1', 'g'), ''),
      lambda x: strpos('0123456789ABCDEF', x) - 1)), lambda c, x: xor(c >> 4, {_nibbles()}[((xor(c, x) & 15) + 1)::INT])), 4294967295)"""
ORACLE = f"""
WITH d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size, {CRC} AS crc, ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS k FROM documents),
b AS (SELECT *, coalesce(sum(size) OVER (ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before, (sum(size) OVER ())::BIGINT AS total FROM d),
s AS (SELECT *, ({N_SHARDS} * before // total)::INT AS shard FROM b)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, shard, (row_number() OVER (PARTITION BY shard ORDER BY k, doc_id) - 1)::BIGINT AS slot, 'bytes' AS law,
       NULL::INT AS grown_shard FROM s
"""
