"""Conversation prefix trie: nodes are shared beginnings, subtree sums run along heavy paths, and light paths are added to their parents in rounds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from evidentia.llm.shared import dealt, materialize, partitions, python_workers
from evidentia.llm.sharding import CRC

#: A window runs over so many turns of one conversation or path at most (a power of two); longer ones are cut, and the cuts' sums are joined.
CUT_BITS = 12
#: Conversations are rebuilt on the one at the start of their block of so many ids, of which they take fewer than TURNS turns.
BLOCK, TURNS = 100, 6

_MERGE = {
    "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    "max": lambda a, b: F.greatest(a, b),
    "bit_xor": lambda a, b: F.coalesce(a, F.lit(0)).bitwiseXOR(F.coalesce(b, F.lit(0))),
}


def before(rows: DataFrame, key: list[str], place: Column, cut: Column | None, values: dict[str, tuple[str, Column]]) -> DataFrame:
    """``rows`` (a written table) plus, by name, each (sum, max or bit_xor, column) over the rows of ``key`` at smaller places; nulls where there are none.

    ``cut`` divides a key's rows, in the order of places, into pieces that one task can run over; what the pieces sum up to is joined back, so a
    key with a third of all rows is spread over many tasks. Without a cut every key is one piece.
    """
    keyed = rows.withColumn("_cut", F.lit(0) if cut is None else cut)
    group = [*key, "_cut"]
    run = Window.partitionBy(*group).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    here = keyed.withColumns({n: getattr(F, f)(c).over(run) for n, (f, c) in values.items()})
    if cut is None:
        return here.drop("_cut")
    pieces = keyed.groupBy(*group).agg(*(getattr(F, f)(c).alias(n) for n, (f, c) in values.items()), F.lit(1).alias("_piece"))
    earlier = Window.partitionBy(*key).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(*group, *(getattr(F, f)(F.col(n)).over(earlier).alias(f"_{n}") for n, (f, _) in values.items()), F.sum("_piece").over(earlier).alias("_pieces"))
    joined = here.join(pieces.filter("_pieces IS NOT NULL"), group, "left")
    return joined.withColumns({n: _MERGE[f](F.col(n), F.col(f"_{n}")) for n, (f, _) in values.items()}).drop("_cut", "_pieces", *(f"_{n}" for n in values))


def numbered(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, pos, x1, x2, n_chars): turns numbered from 1 in each conversation, as two hashes of role and text, and the text's code points.

    Turns are ordered by ``turn``, null first; equal ones by a hash of role and text, so that the result is the same whatever the partitioning. A null role
    or text counts as empty; rows without a conv_id are left out. Texts are not exchanged: rows are sorted by range of (conversation, turn),
    so a conversation with very many turns lies in several partitions.
    """
    r, t = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = conversations.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.xxhash64(r, t).alias("x1"), F.xxhash64(F.lit("turn"), t, r).alias("x2"), F.length(t).cast("long").alias("n_chars"))
    order = ["conv_id", "turn", "x1", "x2"]
    rows = rows.filter("conv_id IS NOT NULL").repartitionByRange(partitions(conversations.sparkSession), *order).sortWithinPartitions(*order)
    placed = materialize(rows.select("conv_id", "x1", "x2", "n_chars", F.monotonically_increasing_id().alias("place")), "turns")
    done = before(placed, ["conv_id"], F.col("place"), F.shiftright("place", 33), {"pos": ("sum", F.lit(1).cast("long"))})
    return done.select("conv_id", (F.coalesce("pos", F.lit(0)) + 1).alias("pos"), "x1", "x2", "n_chars")


def rebuilt(turns: DataFrame, block: int = BLOCK, shared: int = TURNS) -> tuple[DataFrame, DataFrame]:
    """Sequences and lengths of conversations that begin with turns of another one: ``turns`` as ``numbered`` gives them, in a written table.

    Conversation c begins with the first h turns of conversation c - c mod ``block`` (all if it has fewer, none if there is none), h being the crc32 of c in
    decimal modulo ``shared``, and goes on with its own turns after the first h. So it may have no turn at all.
    """
    sizes = materialize(turns.groupBy("conv_id").agg(F.max("pos").alias("n")), "sizes")
    base = F.col("conv_id") - F.pmod("conv_id", F.lit(block))
    convs = sizes.select("conv_id", "n", base.alias("base"), F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(shared)).alias("h"))
    convs = convs.join(sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("m")), "base", "left").withColumn("m", F.least(F.coalesce("m", F.lit(0)), "h"))
    convs = materialize(convs.withColumn("total", F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "convs")
    first = turns.filter((F.pmod("conv_id", F.lit(block)) == 0) & (F.col("pos") < shared)).withColumnRenamed("conv_id", "base")
    taken = convs.select("conv_id", "base", "m", "total").join(first, "base").filter("pos <= m").withColumn("d", F.col("pos"))
    own = turns.join(convs, "conv_id").filter("pos > h").withColumn("d", F.col("pos") - F.col("h") + F.col("m"))
    columns = ["conv_id", "d", "x1", "x2", "n_chars", (F.col("d") == F.col("total")).alias("last")]
    return taken.select(*columns).unionByName(own.select(*columns)), convs.select("conv_id", "total")


def whole(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sequences and lengths of conversations as they are: ``turns`` as ``numbered`` gives them, in a written table."""
    sizes = materialize(turns.groupBy("conv_id").agg(F.max("pos").alias("total")), "sizes")
    rows = turns.join(sizes, "conv_id").select("conv_id", F.col("pos").alias("d"), "x1", "x2", "n_chars", (F.col("pos") == F.col("total")).alias("last"))
    return rows, sizes


def _prefixes(sequences: DataFrame, long: bool) -> DataFrame:
    """``sequences`` plus the names (h1, h2) of the prefix that each turn ends and (p1, p2) of the one before it; the root is (0, 0).

    A prefix's name is the xor of two 64-bit hashes of each of its turns and their depths, so that it can be summed up piece by piece."""
    rows = materialize(sequences.withColumns({"e1": F.xxhash64("d", "x1"), "e2": F.xxhash64("x2", "d")}).drop("x1", "x2"), "sequences")
    cut = F.shiftright("d", CUT_BITS) if long else None
    named = before(rows, ["conv_id"], F.col("d"), cut, {"p1": ("bit_xor", F.col("e1")), "p2": ("bit_xor", F.col("e2"))}).fillna(0, ["p1", "p2"])
    return materialize(named.withColumns({"h1": F.col("p1").bitwiseXOR(F.col("e1")), "h2": F.col("p2").bitwiseXOR(F.col("e2"))}).drop("e1", "e2"), "prefixes")


def _tree(rows: DataFrame, convs: DataFrame, long: bool) -> DataFrame:
    """One row a node, with its heavy path (t1, t2), named by the path's top node, the path (u1, u2) of its parent, and the light links above it (level).

    The heavy child of a node is the one that most conversations pass through, and of these the one with the smallest conv_id; so a light link halves
    the conversations at least, and a level is at most their logarithm. What lies above a node is read off its smallest conversation, whose
    turns are all of its ancestors.
    """
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    nodes = rows.groupBy("h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("d").alias("depth"), F.min("n_chars").alias("n_chars"), F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    root = root.select(zero.alias("h1"), zero.alias("h2"), "conv_id", "n_convs", zero.alias("depth"), zero.alias("n_chars"), none.alias("p1"), none.alias("p2"))
    nodes = materialize(nodes.unionByName(root), "nodes")
    children = nodes.filter("depth > 0").groupBy("p1", "p2").agg(F.count("*").alias("n_children"), F.max(F.struct("n_convs", (-F.col("conv_id")).alias("neg"), "h1", "h2")).alias("heavy"))
    children = materialize(children, "children")
    counts = children.select(F.col("p1").alias("h1"), F.col("p2").alias("h2"), "n_children")
    heavy = children.select("heavy.h1", "heavy.h2", F.lit(0).alias("light"))
    marked = materialize(nodes.join(counts, ["h1", "h2"], "left").join(heavy, ["h1", "h2"], "left").fillna({"n_children": 0, "light": 1}), "marked")
    # Copies of a conversation are the smallest one of no node, and need not be looked at again.
    first = rows.select(F.col("conv_id").alias("c"), "d", "h1", "h2").join(marked.select(F.col("conv_id").alias("c")).distinct(), "c", "left_semi")
    flagged = first.join(marked.filter("depth > 0"), ["h1", "h2"])
    if long:
        flagged = materialize(flagged, "flagged")
    above = {"prev": ("max", F.struct("d", "conv_id")), "up": ("max", F.when(F.col("light") == 1, F.struct("d", "h1", "h2"))), "lights": ("sum", F.col("light"))}
    found = before(flagged, ["c"], F.col("d"), F.shiftright("d", CUT_BITS) if long else None, above).filter("c = conv_id")
    least = (convs.agg(F.min("conv_id")).first() or [None])[0]
    u1, u2 = F.coalesce("up.h1", F.lit(0)), F.coalesce("up.h2", F.lit(0))
    light, columns = F.col("light") == 1, ["h1", "h2", "conv_id", "depth", "n_convs", "n_chars", "n_children", "p1", "p2"]
    found = found.select(*columns, F.coalesce("prev.conv_id", F.lit(least).cast("long")).alias("parent_conv_id"), F.when(light, F.col("h1")).otherwise(u1).alias("t1"), F.when(light, F.col("h2")).otherwise(u2).alias("t2"), u1.alias("u1"), u2.alias("u2"), (F.coalesce("lights", F.lit(0)) + F.col("light")).cast("long").alias("level"))
    top = marked.filter("depth = 0").select(*columns, none.alias("parent_conv_id"), zero.alias("t1"), zero.alias("t2"), none.alias("u1"), none.alias("u2"), zero.alias("level"))
    tree = found.unionByName(top)
    return materialize(tree.withColumns({"leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("n_chars")}), "tree")


def _attached(tree: DataFrame) -> DataFrame:
    """(h1, h2, leaves, saved): what the light paths below each node sum up to, found from the innermost level of paths outwards."""
    sums = [F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")]
    is_top = (F.col("h1") == F.col("t1")) & (F.col("h2") == F.col("t2"))
    paths = tree.groupBy("t1", "t2").agg(F.max("level").alias("level"), F.max(F.when(is_top, F.struct("p1", "p2", "u1", "u2"))).alias("to"), *sums)
    paths = materialize(paths, "paths")
    deepest = paths.agg(F.max("level")).first()[0] or 0
    done, arrived = [paths.limit(0).select("to", "leaves", "saved")], None
    for level in range(deepest, 0, -1):
        here = paths.filter(F.col("level") == level).select("t1", "t2", "to", "leaves", "saved")
        if arrived is not None:
            here = here.unionByName(arrived, allowMissingColumns=True).groupBy("t1", "t2").agg(F.max("to").alias("to"), *sums)
        here = materialize(here, f"level-{level}")
        done.append(here.select("to", "leaves", "saved"))
        arrived = here.groupBy(F.col("to.u1").alias("t1"), F.col("to.u2").alias("t2")).agg(*sums)
    return reduce(DataFrame.unionByName, done).groupBy(F.col("to.p1").alias("h1"), F.col("to.p2").alias("h2")).agg(*sums)


def ends_digest(ends: DataFrame) -> DataFrame:
    """(h1, h2, ends_sha256) of rows (h1, h2, conv_id): SHA-256 in lower-case hex of the ids in ascending order, comma-joined.

    Ids are packed by blocks of 4096 first, and a task streams the blocks of one node through its digest, so a node at which very many conversations end
    needs no more memory than another.
    """
    python_workers(ends.sparkSession)
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    blocks = ends.groupBy("h1", "h2", F.shiftright("conv_id", 12).alias("block")).agg(ids.alias("ids"))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest = None, None
        for batch in rows:
            out = []
            for a, b, _, part in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if (a, b) == last:
                    digest.update(b"," + part.encode())
                else:
                    if last:
                        out.append((*last, digest.hexdigest()))
                    last, digest = (a, b), hashlib.sha256(part.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema)
        if last:
            yield pa.RecordBatch.from_pylist([dict(zip(names, (*last, digest.hexdigest()), strict=True))], schema)

    names = ("h1", "h2", "ends_sha256")
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("ends_sha256", pa.string())])
    return dealt(blocks, "h1", "h2").sortWithinPartitions("h1", "h2", "block").mapInArrow(run, "h1 long, h2 long, ends_sha256 string")


def trie(sequences: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes of the prefix trie of ``sequences`` (conv_id, d, x1, x2, n_chars, last), d running from 1 without gaps, and the rows (h1, h2, conv_id) of the
    nodes where conversations end. ``convs`` (conv_id, total) has every conversation, also those without a turn.

    Nodes: (h1, h2) names, conv_id (smallest conversation), depth, n_convs, parent_conv_id, n_children, n_leaves and saved_tokens of the subtree. No
    conversations give no nodes.
    """
    convs = materialize(convs, "lengths")
    long = (convs.agg(F.max("total")).first()[0] or 0) >> CUT_BITS > 0
    rows = _prefixes(sequences, long)
    tree = _tree(rows, convs, long)
    more = _attached(tree).withColumnsRenamed({"leaves": "more_leaves", "saved": "more_saved"})
    own = tree.join(more, ["h1", "h2"], "left").fillna(0, ["more_leaves", "more_saved"])
    own = own.withColumns({"leaves": F.col("leaves") + F.col("more_leaves"), "saved": F.col("saved") + F.col("more_saved")})
    if long:
        own = materialize(own, "own-sums")
    place = -F.col("depth")
    summed = before(own, ["t1", "t2"], place, F.shiftright(place, CUT_BITS) if long else None, {"n_leaves": ("sum", F.col("leaves")), "saved_tokens": ("sum", F.col("saved"))})
    summed = summed.withColumns({"n_leaves": F.coalesce("n_leaves", F.lit(0)) + F.col("leaves"), "saved_tokens": F.coalesce("saved_tokens", F.lit(0)) + F.col("saved")})
    zero = F.lit(0).cast("long")
    ends = rows.filter("last").select("h1", "h2", "conv_id").unionByName(convs.filter("total = 0").select(zero.alias("h1"), zero.alias("h2"), "conv_id"))
    return summed.select("h1", "h2", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"), ends


def digested(sequences: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of ``trie`` with ends_sha256 in place of their names."""
    nodes, ends = trie(sequences, convs)
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    out = nodes.join(ends_digest(ends), ["h1", "h2"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """``digested`` over the conversations as ``rebuilt`` makes them."""
    return digested(*rebuilt(materialize(numbered(conversations), "numbered")))


ORACLE = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos FROM conversations),
c AS (SELECT conv_id, {CRC} % {TURNS} AS h FROM (SELECT DISTINCT conv_id, conv_id::VARCHAR AS text FROM conversations)),
b AS (SELECT c.conv_id, t.pos AS d, r, x FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % {BLOCK} WHERE pos <= h),
m AS (SELECT c.conv_id, any_value(h) AS h, count(b.d) AS m FROM c LEFT JOIN b USING (conv_id) GROUP BY c.conv_id),
s AS (SELECT conv_id, d, r, x FROM b UNION ALL SELECT conv_id, pos - h + m, r, x FROM t JOIN m USING (conv_id) WHERE pos > h),
p AS (SELECT conv_id, d, x, string_agg(md5(r) || md5(x), '') OVER (PARTITION BY conv_id ORDER BY d) AS k FROM s),
n AS (SELECT k, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(length(x)) AS len FROM p GROUP BY k, d
      UNION ALL SELECT '', 0, min(conv_id), count(*), 0 FROM c),
l AS (SELECT conv_id, max_by(k, d) AS k FROM p GROUP BY conv_id UNION ALL SELECT conv_id, '' FROM c WHERE conv_id NOT IN (SELECT conv_id FROM p)),
e AS (SELECT k, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM l GROUP BY k),
f AS (SELECT substr(k, 1, 64 * (depth::INT - 1)) AS k, count(*) AS n FROM n WHERE depth > 0 GROUP BY 1),
u AS (SELECT a.k, count(*) FILTER (f.k IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.len)::BIGINT AS saved
      FROM n AS a JOIN n ON starts_with(n.k, a.k) LEFT JOIN f ON f.k = n.k GROUP BY a.k)
SELECT n.conv_id, n.depth::BIGINT AS depth, q.conv_id AS parent_conv_id, n.n_convs, coalesce(f.n, 0)::BIGINT AS n_children, u.n_leaves, u.saved AS saved_tokens,
       sha256(coalesce(e.ids, '')) AS ends_sha256
FROM n JOIN u USING (k) LEFT JOIN f ON f.k = n.k LEFT JOIN e ON e.k = n.k LEFT JOIN n AS q ON n.depth > 0 AND q.k = substr(n.k, 1, 64 * (n.depth::INT - 1))
"""
