"""Centroid clustering by weighted deduplication: Lloyd's rounds over distinct quantised vectors in exact integers, joined back to all vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evidentia.llm.shared import materialize, python_workers

#: Components of a vector, steps a unit, clusters, rounds, and what is put before an id to choose the first centroids.
WIDTH, SCALE, K, ROUNDS, SEED = 64, 1024, 8, 10, "3"
#: Quantised components of at most this size either way are kept: squared distances then fit a long.
LARGEST = 1 << 27


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """(vec_id, q): vectors with exactly ``width`` components, none null or not finite, each as the integer floor(scale * x); q has four bytes a component.

    Vectors with a component of more than LARGEST are left out too, as their squared distances leave a long.
    """
    python_workers(vectors.sparkSession)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("e"))
    rows = rows.filter((F.size("e") == width) & ~F.exists("e", lambda x: x.isNull()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(1).flatten()).reshape(-1, width)
            with np.errstate(over="ignore", invalid="ignore"):
                q = np.floor(scale * x)
            good = (np.isfinite(x) & (np.abs(q) <= LARGEST)).all(axis=1)
            packed = [r.tobytes() for r in q[good].astype("<i4")]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), pa.array(packed, pa.binary())], ["vec_id", "q"])

    return rows.mapInArrow(run, "vec_id long, q binary")


def _nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of each row; of equally near ones the smaller number."""
    far = np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    number = far.argmin(axis=1)
    return number, far[np.arange(len(x)), number]


def _unpack(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, width).astype(np.int64)


def _sums(distinct: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """cluster -> (vectors, componentwise sums). A task adds up its rows by cluster, so K rows a task and component are exchanged, whatever the input."""
    width = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centroids), width + 1), dtype=object)  # Python integers: they cannot overflow
        for batch in batches:
            if batch.num_rows:
                x, w = _unpack(batch.column(0), width), np.asarray(batch.column(1))
                number, _ = _nearest(x, centroids)
                wide = w.max() > 1 << 20
                x, w = (x.astype(object), w.astype(object)) if wide else (x, w)
                for k in np.unique(number):
                    own = number == k
                    total[k, 0] += int(w[own].sum())
                    total[k, 1:] += (x[own] * w[own][:, None]).sum(axis=0).astype(object)
        k, d = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(d, pa.int32()), pa.array([str(v) for v in total[k, d]], pa.string())], ["k", "d", "v"])

    rows = distinct.select("q", "n").mapInArrow(run, "k int, d int, v string")
    out: dict[int, tuple[int, list[int]]] = {}
    sums = {(r["k"], r["d"]): int(r["v"]) for r in rows.groupBy("k", "d").agg(F.sum(F.col("v").cast("decimal(28,0)")).alias("v")).collect()}
    for k in range(len(centroids)):
        if n := sums.get((k, 0)):
            out[k] = (n, [sums.get((k, d + 1), 0) for d in range(width)])
    return out


def first_centroids(rows: DataFrame, k: int = K, seed: str = SEED) -> np.ndarray:
    """The vectors of the ``k`` rows with the smallest sha256 of ``seed``:id; of one id's vectors the smaller bytes come first. Null ids are no seeds."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    found = rows.filter("vec_id IS NOT NULL").select(order.alias("o"), "q").orderBy("o", "q").limit(k).collect()
    return np.array([np.frombuffer(r["q"], "<i4") for r in found], dtype=np.int64)


def lloyd(distinct: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """``centroids`` after ``rounds`` rounds over ``distinct`` (q, n), n being how many vectors are q.

    A round assigns every vector to its nearest centroid and moves each centroid to the componentwise floor of its vectors' mean; one without vectors
    stays. Once nothing moves, nothing will, and the rounds left are not run.
    """
    for _ in range(rounds):
        moved = centroids.copy()
        for k, (n, sums) in _sums(distinct, centroids).items():
            moved[k] = [s // n for s in sums]
        if (moved == centroids).all():
            break
        centroids = moved
    return centroids


def assigned(distinct: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(q, n, cluster, distance) of the rows of ``distinct``."""
    width = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                number, far = _nearest(_unpack(batch.column(0), width), centroids)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(number.astype(np.int32)), pa.array(far)], ["q", "n", "cluster", "distance"])

    return distinct.select("q", "n").mapInArrow(run, "q binary, n long, cluster int, distance long")


def cluster(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K, rounds: int = ROUNDS, width: int = WIDTH) -> tuple[DataFrame, list[tuple[int, list[int], int, int]]]:
    """(vec_id, cluster, distance) of every kept vector, and (cluster, centroid, vectors, summed distance) of each cluster that has vectors.

    Equal quantised vectors are counted before anything else, so a vector that a third of all rows repeat is one row of every round; assignments are joined back
    by the vector itself, in a join that adaptive skew handling can split. Repeated ids are vectors of their own. Fewer kept vectors with an
    id than ``k`` give fewer clusters; none give no rows. Only K centroids and their sums reach the driver.
    """
    rows = materialize(quantised(vectors, vec_id, embedding, width), "quantised")
    distinct = materialize(rows.groupBy("q").agg(F.count("*").alias("n")), "distinct")
    centroids = first_centroids(rows, k)
    if not len(centroids):
        nothing = rows.limit(0).select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return nothing, []
    centroids = lloyd(distinct, centroids, rounds)
    found = materialize(assigned(distinct, centroids), "assigned")
    weight = F.col("n").cast("decimal(20,0)") * F.col("distance").cast("decimal(18,0)")
    inertias = {r["cluster"]: (r["n"], int(r["inertia"])) for r in found.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum(weight).alias("inertia")).collect()}
    clusters = [(c, [int(x) for x in centroids[c]], n, inertia) for c, (n, inertia) in sorted(inertias.items())]
    return rows.join(found.select("q", "cluster", "distance"), "q").select("vec_id", "cluster", "distance"), clusters


def labelled(vectors: DataFrame) -> DataFrame:
    """The vectors of ``cluster`` with the sums and a digest of the centroid beside each of them."""
    rows, clusters = cluster(vectors)
    if not clusters:
        return rows.select("*", F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"), F.lit("").alias("centroid_sha256"))
    known = {c: F.struct(F.lit(inertia).cast("long").alias("i"), F.lit(hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()).alias("s")) for c, x, _, inertia in clusters}
    own = F.create_map(*(y for c, v in known.items() for y in (F.lit(c), v)))[F.col("cluster")]
    total = sum(inertia for *_, inertia in clusters)
    return rows.select("*", own["i"].alias("cluster_inertia"), F.lit(total).cast("long").alias("inertia"), own["s"].alias("centroid_sha256"))


def _oracle() -> str:
    """The rounds as one common table expression each: assignments (a) and centroids (c), over the vectors' components (v)."""
    steps = [f"""v AS MATERIALIZED (SELECT vec_id, d, floor({SCALE} * e[d]::DOUBLE)::BIGINT AS x FROM (SELECT vec_id, embedding AS e, unnest(range(1, {WIDTH + 1})) AS d FROM embeddings
      WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda y: isfinite(y))) = {WIDTH})),
c0 AS MATERIALIZED (SELECT k, d, x FROM v JOIN (SELECT vec_id, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS k FROM (SELECT DISTINCT vec_id FROM v) QUALIFY k < {K}) USING (vec_id))"""]
    for i in range(ROUNDS + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT vec_id, min(struct_pack(f := f, k := k)) AS b FROM (SELECT vec_id, k, sum((v.x - c{i}.x) * (v.x - c{i}.x))::BIGINT AS f FROM v JOIN c{i} USING (d) GROUP BY vec_id, k) GROUP BY vec_id)")
        if i < ROUNDS:
            steps.append(f"m{i} AS (SELECT b.k AS k, d, sum(x) AS s, count(*) AS n FROM v JOIN a{i} USING (vec_id) GROUP BY ALL)")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c{i}.k, d, CASE WHEN n IS NULL THEN x ELSE ((s - ((s % n) + n) % n) // n)::BIGINT END AS x FROM c{i} LEFT JOIN m{i} USING (k, d))")
    return "WITH " + ",\n".join(steps) + f""",
h AS (SELECT k, sha256(string_agg(x::VARCHAR, ',' ORDER BY d)) AS s FROM c{ROUNDS} GROUP BY k)
SELECT vec_id, b.k::INT AS cluster, b.f AS distance, (sum(b.f) OVER (PARTITION BY b.k))::BIGINT AS cluster_inertia, (sum(b.f) OVER ())::BIGINT AS inertia, s AS centroid_sha256
FROM a{ROUNDS} JOIN h ON h.k = b.k
"""


ORACLE = _oracle()
