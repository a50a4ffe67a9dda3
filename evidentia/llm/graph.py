"""Connected components as joins and aggregates; no node, link or component list ever reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from evidentia.llm.shared import materialize, tasks_for


def _shape(links: DataFrame, tasks: int) -> tuple[bool, int]:
    """Whether every a has one b that is no a itself, so that each component is one star round its smallest node; and how many tasks ``links`` are worth."""
    ends = links.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(links.select(F.col("b").alias("a"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.coalesce(tasks).groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down")).coalesce(tasks)
    loose, n = nodes.agg(F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))), F.coalesce(F.sum("up"), F.lit(0))).first()
    return loose == 0, tasks_for(links.sparkSession, n)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node in ``edges``; component is the smallest node that can be reached.

    Large stars and small stars alternate until every component is one star, which one aggregate by node tells: a large star moves a node's larger
    neighbours to the smallest node around it, a small star its smaller ones, and itself. Nodes stay connected throughout, links only ever point at
    smaller nodes, and nothing but single stars stays as it is; the number of rounds grows with the logarithm of the nodes (squared at the worst),
    and there is no limit on it. Minima are combined on the map side, and the join that brings them back can be split by adaptive skew handling, so
    a node with very many links is no hot spot; what the aggregates leave is dealt to as many tasks as its size is worth. Rows with a null end are ignored; repeated rows and rows that link a node with itself are allowed;
    no edges give no rows.
    """
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "edges")
    tasks = tasks_for(edges.sparkSession, edges.count())
    nodes = materialize(edges.coalesce(tasks).distinct().coalesce(tasks), "nodes")
    lone, links = nodes.filter("a = b").select("a"), nodes.filter("a > b")
    settled, tasks = _shape(links, tasks)
    while not settled:
        # Every stage has as many tasks as the graph is worth, whatever the session's partitions.
        around = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).coalesce(tasks).groupBy("a").agg(F.min("b").alias("m")).coalesce(tasks)
        large = links.join(around.select(F.col("a").alias("b"), F.least("a", "m").alias("m")), "b").select("a", F.col("m").alias("b")).coalesce(tasks).distinct()
        large = materialize(large.coalesce(tasks), "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m")).coalesce(tasks)
        moved = large.join(least, "a").select("b", "m").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).coalesce(tasks)
        links = materialize(moved.unionByName(least.select("a", F.col("m").alias("b"))).coalesce(tasks).distinct().coalesce(tasks), "small-star")
        settled, tasks = _shape(links, tasks)
    known = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = links.select("b").unionByName(lone.select(F.col("a").alias("b"))).coalesce(tasks).distinct().coalesce(tasks).join(links.select(F.col("a").alias("b")), "b", "left_anti")
    roots = roots.select(F.col("b").alias("node"), F.col("b").alias("component")).coalesce(tasks)
    return materialize(known.unionByName(roots).coalesce(tasks), "components")


def joined_components(parts: DataFrame, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The components ``parts`` (node, component) once ``edges`` are added: known stars take the place of the links that made them."""
    new = materialize(edges.select(F.col(a).alias("a"), F.col(b).alias("b")), "new-edges")
    return parts if new.isEmpty() else connected_components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(new))
