"""Exact centroid clustering over a pivot table (operator 11).

The squared distances of all vectors to a few fixed pivots are worked out once and stored
next to the vectors. In each round the triangle inequality gives every (vector, centroid)
pair a lower bound, the largest difference of their distances to the same pivot; only
centroids whose bound doesn't exceed the best exact distance found get an exact distance, in
64-bit integers. Rounding of the bounds is covered by a margin, so ties are never lost.

A round reads the stored table once; each task returns one row of sums per centroid, and
`CLUSTERS` rows reach the driver.

Defined results: rows whose vector is null, has another length or a component that is null
or not finite are left out. Repeated rows and ids are vectors of their own; of equal hashes
the smaller vector comes first. A null id starts no centroid and is assigned like the others.
With fewer vectors than centroids every vector with an id starts one; without any, an
empty result. Further columns are ignored. `whole` tells which components are too large.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import stage
from .vectors import floored_means, packed, partial_sums, unpacked, usable, whole

CLUSTERS = 16
ROUNDS = 3
SCALE = 64
DIMS = 64
PIVOTS = 8
#: Vectors that a task looks at together.
BLOCK = 8192
#: Relative error that covers all roundings of a bound.
MARGIN = 1e-12


def squared(rows: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole-number rows to one vector, or row by row to `to`."""
    d = rows - to
    return np.einsum("ij,ij->i", d, d)


def spread_out(points: np.ndarray, n: int) -> np.ndarray:
    """Up to n rows, each the one farthest from those before it (the first row first)."""
    chosen, gap = [0], squared(points, points[0])
    while len(chosen) < min(n, len(points)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, squared(points, points[chosen[-1]]))
    return points[chosen]


def to_pivots(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances (not squared) to every pivot."""
    return np.sqrt(np.stack([squared(rows, p) for p in pivots], axis=1).astype(np.float64))


def nearest(rows: np.ndarray, stored: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid (the first of equal ones) and squared distance of each row, and how
    many exact distances that took. `stored` are the rows' distances to the pivots."""
    own = to_pivots(centroids, pivots)
    bound = np.zeros((len(rows), len(centroids)))
    for j in range(len(pivots)):
        a, b = stored[:, j:j + 1], own[:, j]
        np.maximum(bound, np.abs(a - b) - MARGIN * (a + b), out=bound)
    bound *= bound * (1 - MARGIN)
    best = bound.argmin(axis=1)
    distance, exact = squared(rows, centroids[best]), len(rows)
    first = best.copy()
    for c, centre in enumerate(centroids):
        i = np.flatnonzero((bound[:, c] <= distance) & (first != c))
        exact += len(i)
        d = squared(rows[i], centre)
        better = (d < distance[i]) | ((d == distance[i]) & (c < best[i]))
        distance[i[better]], best[i[better]] = d[better], c
    return best, distance, exact


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            yield batch.slice(at, BLOCK)


@dataclass
class Table:
    """Vectors as whole numbers with their distances to the pivots; the first centroids."""

    rows: DataFrame  # vec_id, q, stored
    pivots: np.ndarray
    centroids: np.ndarray
    dims: int


def build(vectors: DataFrame, clusters: int = CLUSTERS, scale: int = SCALE, dims: int = DIMS, pivots: int = PIVOTS) -> Table:
    """Store the pivot table. The first centroids are the vectors with the smallest hash of
    `1:<vec_id>`, and the pivots are the ones among them that lie farthest apart."""
    kept = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).filter((F.size("v") == dims) & usable("v"))
    key = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    start = kept.filter(F.col("vec_id").isNotNull()).orderBy(key, "v").limit(clusters).select("v").collect()
    first = whole(pa.array([r["v"] for r in start], pa.list_(pa.float64())), scale, dims)
    chosen = spread_out(first, pivots) if len(first) else first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _blocks(batches):
            q = whole(part.column(1), scale, dims)
            stored = to_pivots(q, chosen) if len(chosen) else np.zeros((len(q), 0))
            yield pa.RecordBatch.from_arrays([part.column(0), packed(q.astype(np.int32)), packed(stored)], names=["vec_id", "q", "stored"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return Table(stage(kept.mapInArrow(run, f"vec_id {kind}, q binary, stored binary")), chosen, first, dims)


def refine(table: Table, rounds: int = ROUNDS) -> np.ndarray:
    """The centroids after so many rounds of assignment and floored means."""
    centroids, pivots, dims = table.centroids, table.pivots, table.dims
    for _ in range(rounds if len(centroids) else 0):
        def run(batches: Iterator[pa.RecordBatch], now: np.ndarray = centroids) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros(now.shape, np.int64), np.zeros(len(now), np.int64)
            for part in _blocks(batches):
                q, stored = _read(part, dims, len(pivots))
                best, _distance, _exact = nearest(q, stored, now, pivots)
                partial_sums(best, q, total, count)
            used = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(count[used]), pa.array(list(total[used]), pa.list_(pa.int64()))],
                                             names=["cluster", "n", "sums"])

        sums = table.rows.mapInArrow(run, "cluster int, n long, sums array<long>")
        centroids = centroids.copy()
        for (c,), mean in floored_means(sums, ["cluster"], dims).items():
            centroids[c] = mean
    return centroids


def _read(part: pa.RecordBatch, dims: int, n_pivots: int) -> tuple[np.ndarray, np.ndarray]:
    q, stored = (part.column(part.schema.get_field_index(c)) for c in ("q", "stored"))
    return unpacked(q, "<i4", dims).astype(np.int64), unpacked(stored, "<f8", n_pivots)


def assign(table: Table, centroids: np.ndarray) -> DataFrame:
    """`vec_id, cluster, distance` of every vector."""
    pivots, dims = table.pivots, table.dims

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _blocks(batches):
            if len(centroids):
                best, distance, _exact = nearest(*_read(part, dims, len(pivots)), centroids, pivots)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(best, pa.int32()), pa.array(distance)],
                                                 names=["vec_id", "cluster", "distance"])

    kind = table.rows.schema["vec_id"].dataType.simpleString()
    return table.rows.mapInArrow(run, f"vec_id {kind}, cluster int, distance long")


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> DataFrame:
    """Cluster, squared distance, the sums of distances and the centroid's digest per vector."""
    spark, table = vectors.sparkSession, build(vectors, clusters)
    centroids = refine(table, rounds)
    rows = stage(assign(table, centroids))
    sums = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    digests = [(c, hashlib.sha256(",".join(map(str, q)).encode()).hexdigest()) for c, q in enumerate(centroids.tolist())]
    named = spark.createDataFrame(digests, "cluster int, centroid_sha256 string").join(sums, "cluster")  # a row a centroid
    total = sums.agg(F.sum("cluster_inertia")).scalar()
    return rows.join(F.broadcast(named), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", total.alias("inertia"), "centroid_sha256")


def oracle(clusters: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    """The same in DuckDB SQL, with all distances."""
    parts = [f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q
        FROM embeddings WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS})""",
             f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, q FROM (
        SELECT q, sha256('1:' || vec_id) AS h FROM v ORDER BY h LIMIT {clusters}))"""]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, q, c, d FROM (
            SELECT v.vec_id, v.q, k.c, list_sum(list_transform(list_zip(v.q, k.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v, c{r} k)
            QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)""")
        if r < rounds:
            parts.append(f"""m{r} AS MATERIALIZED (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS q FROM (
                SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n
                FROM (SELECT c, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM a{r}) GROUP BY c, i) GROUP BY c)""")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT k.c, coalesce(m.q, k.q) AS q FROM c{r} k LEFT JOIN m{r} m USING (c))")
    return f"""WITH {', '.join(parts)}
        SELECT a.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance,
            CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
            sha256(array_to_string(k.q, ',')) AS centroid_sha256
        FROM a{rounds} a JOIN c{rounds} k USING (c)"""
