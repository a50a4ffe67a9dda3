"""Files, functions, and how they hang together."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from evidentia.functions.text import complexity
from evidentia.session import python_workers, written

#: A file with up to so many steps between functions (16 bytes each) is walked through in one task.
HELD_STEPS = 1_000_000
MIN_COMPLEXITY, BLOB_COMPLEXITY, BLOB_FUNCTIONS, ALL_FUNCTIONS = 3, 8, 500, 100_000


def file_metadata(files: DataFrame, content: str = "content") -> DataFrame:
    """``files`` with size and hashes instead of their content; empty files are left out."""
    data = F.col(content)
    size = F.octet_length(data)
    return files.filter(size > 0).select(*(c for c in files.columns if c != content), size.cast("long").alias("size_bytes"), F.md5(data).alias("md5"), F.sha1(data).alias("sha1"), F.sha2(data, 256).alias("sha256"))


def forced(extracted: DataFrame, reported: DataFrame, columns: list[str], default: str = "Unknown", by: str = "file_id") -> DataFrame:
    """Per column what was extracted, else what was reported, else ``default``."""
    b = reported.select(by, *(F.col(c).alias(f"_{c}") for c in columns))
    return extracted.join(b, by, "full_outer").select(by, *(F.coalesce(F.col(c).cast("string"), F.col(f"_{c}").cast("string"), F.lit(default)).alias(c) for c in columns))


def extract_functions(functions: DataFrame, tags: DataFrame | None = None, limit: int = 50, least: int = MIN_COMPLEXITY, topk: bool = False) -> DataFrame:
    """Functions worth a look: (file_id, addr, name, size, num_blocks, complexity, complexity_score, has_hit, tags, ord).

    functions: (file_id, addr, name, size, num_blocks, edges, nodes, is_plt, is_simproc, is_blob). Stubs are skipped; a blob has a higher least
    complexity; a function with a signature hit stays whatever its complexity. As a rule the first ``limit`` by address are
    taken and then sorted by complexity; ``topk`` takes the most complex ones instead. tags: (file_id, addr, tag).
    """
    blob = F.coalesce(F.col("is_blob"), F.lit(False))
    rows = functions.filter(~F.col("is_plt") & ~F.col("is_simproc"))
    by_place = Window.partitionBy("file_id").orderBy("addr")
    rows = rows.withColumn("_seen", F.row_number().over(by_place)).filter(F.col("_seen") <= F.when(blob, BLOB_FUNCTIONS).otherwise(ALL_FUNCTIONS))
    rows = rows.withColumn("complexity", complexity(F.col("edges"), F.col("nodes"), F.col("num_blocks")))
    if tags is not None:
        own = tags.groupBy("file_id", "addr").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
        rows = rows.join(own, ["file_id", "addr"], "left")
    else:
        rows = rows.withColumn("tags", F.lit(None).cast("array<string>"))
    rows = rows.withColumn("has_hit", F.coalesce(F.size("tags") > 0, F.lit(False)))
    kept = rows.filter((F.col("complexity") >= F.when(blob, F.greatest(F.lit(least), F.lit(BLOB_COMPLEXITY))).otherwise(least)) | F.col("has_hit"))
    hard = Window.partitionBy("file_id").orderBy(F.desc("complexity"), "addr")
    kept = kept.withColumn("_rn", F.row_number().over(hard if topk else by_place)).filter(F.col("_rn") <= limit)
    score = F.round(F.col("complexity") / F.greatest(F.col("num_blocks"), F.lit(1)), 2)
    return kept.select("file_id", "addr", "name", "size", "num_blocks", "complexity", score.alias("complexity_score"), "has_hit", "tags", F.row_number().over(hard).alias("ord"))


def range_tags(matches: DataFrame, spans: DataFrame, width: int, keys: list[str] | None = None) -> DataFrame:
    """Distinct (keys, span, tag) of points inside spans [lo, hi): matches (keys, at, tag), spans (keys, span, lo, hi).

    Spans are dealt to buckets ``width`` wide, so points meet them by equality; a wide span only costs its buckets.
    """
    keys = keys or []
    dealt = spans.filter("hi > lo").withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    points = matches.withColumn("_bucket", F.floor(F.col("at") / width))
    return points.join(dealt, [*keys, "_bucket"]).filter("at >= lo AND at < hi").select(*keys, "span", "tag").distinct()


def address_of_offset(matches: DataFrame, sections: DataFrame) -> DataFrame:
    """File offsets as virtual addresses, by the section (file_id, file_offset, size, vaddr) that holds them."""
    j = matches.join(sections.select("file_id", "file_offset", "size", "vaddr"), "file_id").filter("at >= file_offset AND at < file_offset + size")
    return j.withColumn("at", F.expr("at - file_offset + vaddr")).drop("file_offset", "size", "vaddr")


def proximity_pairs(functions: DataFrame, reach: int = 5, distance: int = 2000, size: int = 300, by: str | None = "file_id") -> DataFrame:
    """(a, b): functions at most ``reach`` ranks and less than ``distance`` apart, b being smaller than ``size``.

    Ranks are numbered once per file; the band is then an equality join on rank, spread over its 2 * reach offsets.
    """
    keys = [by] if by else []
    ranked = functions.select(*keys, "addr", "size", F.row_number().over(Window.partitionBy(*keys).orderBy("addr")).alias("rank"))
    steps = F.array(*(F.lit(d) for d in range(-reach, reach + 1) if d))
    left = ranked.select(*keys, F.col("addr").alias("a"), F.explode(F.transform(steps, lambda d: F.col("rank") + d)).alias("rank"))
    right = ranked.select(*keys, F.col("addr").alias("b"), F.col("size").alias("size_b"), "rank")
    return left.join(right, [*keys, "rank"]).filter((F.abs(F.col("a") - F.col("b")) < distance) & (F.col("size_b") < size)).select(*keys, "a", "b", "size_b")


def reachable(edges: DataFrame, roots: DataFrame, depth: int = 3, by: str | None = "file_id") -> DataFrame:
    """(root, node, depth): what each root reaches over ``edges`` (src, dst) in at most ``depth`` steps, at its least depth."""
    keys = [by] if by else []
    seen = roots.select(*keys, F.col("root"), F.col("root").alias("node"), F.lit(0).alias("depth")).distinct()
    last, step = seen, edges.select(*keys, F.col("src").alias("node"), F.col("dst")).distinct()
    for d in range(1, depth + 1):
        new = last.join(step, [*keys, "node"]).select(*keys, "root", F.col("dst").alias("node")).distinct()
        last = new.join(seen.select(*keys, "root", "node"), [*keys, "root", "node"], "left_anti").withColumn("depth", F.lit(d))  # each node is gone through once
        seen = seen.unionByName(last)
    return seen.select(*keys, "root", "node", "depth")


def cluster_steps(functions: DataFrame, edges: DataFrame, callee: int = 1000, caller: int = 500, near: int = 200, neighbour: int = 300, distance: int = 2000) -> DataFrame:
    """(file_id, src, dst): one step of a cluster: to callees smaller than ``callee``, from functions smaller than ``caller`` to their callers, and from
    functions smaller than ``near`` to close neighbours smaller than ``neighbour``. Simulated procedures take no part."""
    real = functions.filter(~F.coalesce("is_simproc", F.lit(False))).select("file_id", "addr", "size")
    sized = lambda c, n: real.select("file_id", F.col("addr").alias(c), F.col("size").alias(n))
    calls = edges.select("file_id", "src", "dst").distinct().join(sized("dst", "dst_size"), ["file_id", "dst"]).join(sized("src", "src_size"), ["file_id", "src"])
    down = calls.filter(F.col("dst_size") < callee).select("file_id", "src", "dst")
    up = calls.filter(F.col("dst_size") < caller).select("file_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    beside = proximity_pairs(real, distance=distance, size=neighbour).join(sized("a", "a_size"), ["file_id", "a"]).filter(F.col("a_size") < near).select("file_id", F.col("a").alias("src"), F.col("b").alias("dst"))
    return down.unionByName(up).unionByName(beside).filter("src <> dst").distinct()


def _walk(roots: pd.DataFrame, steps: pd.DataFrame, depth: int) -> pd.DataFrame:
    """The clusters of one file, as ``function_clusters`` describes them."""
    own, taken, out = {k: g.tolist() for k, g in steps.groupby("src")["dst"]}, set(), []
    for root in sorted(roots["root"]):
        if root in taken:
            continue
        last = found = {root}
        for _ in range(depth):
            last = {d for n in last for d in own.get(n, ())} - found - taken
            found = found | last
        taken |= found
        out += [(root, n) for n in sorted(found)]
    return pd.DataFrame(out, columns=["root", "func"])


def function_clusters(functions: DataFrame, edges: DataFrame, roots: int = 300, blob_roots: int = 100, depth: int = 3, held_steps: int = HELD_STEPS, **limits: int) -> DataFrame:
    """(file_id, root, func) of clusters with at least 2 functions, as a walk in order of address grows them.

    Each of a file's first ``roots`` functions (``blob_roots`` of a blob) that is no stub and in no cluster yet starts one: whatever it reaches over
    ``cluster_steps`` (with ``limits``) in ``depth`` steps through functions that are in no cluster yet. So a cluster hangs on all smaller roots. It is found in
    rounds, for all files and roots at once: what every open root reaches through free functions is computed, and a root that shares none of it with a
    smaller open root has its cluster for good, as those can take nothing away from it. The smallest open root of a file is always one of them, so there are
    at most ``roots`` rounds, and far fewer where clusters lie apart. Files with up to HELD_STEPS steps need no rounds: a task walks through each of them as
    it is, with the same result.
    """
    python_workers(functions.sparkSession)
    blob = F.coalesce(F.col("is_blob"), F.lit(False)) if "is_blob" in functions.columns else F.lit(False)
    ranked = functions.withColumn("_rn", F.row_number().over(Window.partitionBy("file_id").orderBy("addr"))).filter(F.col("_rn") <= roots).filter(F.col("_rn") <= F.when(blob, blob_roots).otherwise(roots))
    able = ranked.filter(~F.coalesce("is_plt", F.lit(False)) & ~F.coalesce("is_simproc", F.lit(False)))
    open_ = written(able.select("file_id", F.col("addr").alias("root")).distinct(), "roots")
    steps, done = written(cluster_steps(functions, edges, **limits), "steps"), []
    sizes = steps.groupBy("file_id").agg(F.count("*").alias("n"))
    small = written(open_.select("file_id").distinct().join(sizes, "file_id", "left").filter(F.coalesce("n", F.lit(0)) <= held_steps).select("file_id"), "small-files")
    if not small.isEmpty():
        mine, own = (rows.join(small, "file_id", "left_semi").groupBy("file_id") for rows in (open_, steps))
        schema = open_.schema.add("func", open_.schema["root"].dataType)
        done.append(written(mine.cogroup(own).applyInPandas(lambda key, a, b: _walk(a, b, depth).assign(file_id=key[0])[["file_id", "root", "func"]], schema), "clusters"))
        open_, steps = written(open_.join(small, "file_id", "left_anti"), "roots"), steps.join(small, "file_id", "left_anti")
    while not open_.isEmpty():
        seen = written(reachable(steps, open_, depth), "reach")
        least = seen.groupBy("file_id", "node").agg(F.min("root").alias("least"))
        shared = seen.join(least, ["file_id", "node"]).withColumn("late", F.col("least") < F.col("root"))
        sure = shared.groupBy("file_id", "root").agg(F.max("late").alias("late")).filter("NOT late").select("file_id", "root")
        new = written(seen.join(sure, ["file_id", "root"], "left_semi").select("file_id", "root", F.col("node").alias("func")), "clusters")
        done.append(new)
        taken = new.select("file_id", "func")
        open_ = written(open_.join(taken.withColumnRenamed("func", "root"), ["file_id", "root"], "left_anti"), "roots")
        steps = written(steps.join(taken.withColumnRenamed("func", "src"), ["file_id", "src"], "left_anti").join(taken.withColumnRenamed("func", "dst"), ["file_id", "dst"], "left_anti"), "steps")
    if not done:
        return open_.select("file_id", "root", F.col("root").alias("func"))
    owned = reduce(DataFrame.unionByName, done)
    sizes = owned.groupBy("file_id", "root").agg(F.count("*").alias("n")).filter("n >= 2").select("file_id", "root")
    return owned.join(sizes, ["file_id", "root"]).select("file_id", "root", "func")


def filtered_counts(functions: DataFrame, kept: DataFrame, least: int = MIN_COMPLEXITY, by: str = "file_id") -> DataFrame:
    """(file, total_functions, analyzed_count, filtered_count, min_complexity_threshold) of ``functions`` of which ``kept`` were extracted."""
    all_, own = functions.groupBy(by).agg(F.count("*").alias("total_functions")), kept.groupBy(by).agg(F.count("*").alias("analyzed_count"))
    out = all_.join(own, by, "left").withColumn("analyzed_count", F.coalesce("analyzed_count", F.lit(0)))
    return out.withColumn("filtered_count", F.col("total_functions") - F.col("analyzed_count")).withColumn("min_complexity_threshold", F.lit(least))


def group_summary(scores: DataFrame, by: str = "file_id", first: int = 5) -> DataFrame:
    """(file, n_groups, n_likely, best_score, top): groups of functions summed up; a group of 0.5 or more is likely, top names the ``first`` by score."""
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("crypto_score")).alias("neg"), "root"))), 1, first)
    out = scores.groupBy(by).agg(F.count("*").alias("n_groups"), F.count_if(F.col("crypto_score") >= 0.5).alias("n_likely"), F.max("crypto_score").alias("best_score"), top.alias("t"))
    return out.select(by, "n_groups", "n_likely", "best_score", F.array_join(F.transform("t", lambda x: x["root"].cast("string")), ",").alias("top"))


def functions_from_groups(functions: DataFrame, groups: DataFrame, top: int = 5, first: int = 20) -> DataFrame:
    """For files without any extracted function: the ``first`` addresses of the members of their ``top`` largest groups."""
    bare = groups.join(functions.select("file_id").distinct(), "file_id", "left_anti")
    sizes = bare.groupBy("file_id", "root").agg(F.count("*").alias("n"))
    large = sizes.withColumn("_rn", F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc("n"), "root"))).filter(F.col("_rn") <= top).select("file_id", "root")
    members = bare.join(large, ["file_id", "root"]).select("file_id", F.col("func").alias("addr")).distinct()
    made = members.withColumn("_rn", F.row_number().over(Window.partitionBy("file_id").orderBy("addr"))).filter(F.col("_rn") <= first).select("file_id", "addr")
    return functions.select("file_id", "addr").unionByName(made)


def capped(rows: DataFrame, k: int, order: list[Column | str], by: str = "file_id") -> DataFrame:
    """The first ``k`` rows of each ``by`` in the given order."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("_rn") <= k).drop("_rn")
