"""Exact centroid clustering that scans few vectors again, by geometric drift tightening.

Vectors are integers, so squared distances and centroids are exact. After a vector has
been compared with every centroid it keeps one lower bound on its distance to any
centroid but its own. When centroids have moved, the bound must be loosened by what a
centroid j can at most have come nearer to a vector of cluster i. Full drift, the way j
has moved, is always enough, but most of it is usually not towards the cluster. All
vectors of the cluster lie in a sphere about i's old centroid whose radius is its
farthest vector's distance. The points to which j came nearer by at least t lie within
one branch of a hyperbola whose foci are j's old and new place, and that within the cone
about the way j went with its tip half way and the half angle arccos(t / drift). In the
plane through both places and the sphere's centre the nearest the sphere comes to the
axis is an angle: that of the centre less that under which the sphere is seen. So the
loosening is the drift times the cosine of this angle: all of it if the sphere lies in
the way, none if it lies aside or behind.

A vector whose distance to its own centroid, which is computed anew for every vector, is
below the loosened bound, or below half the way to the next centroid, keeps its cluster.
All others are ambiguous and compared with every centroid, in whole numbers.

Each round is a pass over the table that the last one wrote. The driver holds the
centroids and their sums: ``k`` rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixwright.sources.staging import written

K, ROUNDS, DIMS, SCALE, SEED = 40, 5, 64, 256, 2
LARGEST = 2**27  # of a component: a squared distance of 64 of them fits a long
SPARE = 1e-9  # share of a distance by which rounding may mislead


def whole(vector: Column, dims: int, scale: int) -> Column:
    """The vector's components times ``scale``, rounded down; null unless it has ``dims`` finite ones."""
    x = vector.cast("array<double>")
    fit = (F.size(x) == dims) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))

    def floor(v: Column) -> Column:
        least = F.floor(v * scale)
        return F.when(F.abs(v * scale) < LARGEST, least.cast("int")).otherwise(
            F.raise_error(F.lit(f"a component times {scale} must stay below {LARGEST}")).cast("int")
        )

    return F.when(fit, F.transform(x, floor))


def seeds(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors of the ``k`` rows (id, v) whose ids hash lowest, in order of the hash; equal ids by vector."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = rows.orderBy(name, "v").limit(k).select("v").collect()
    return np.array([r.v for r in first], dtype=np.int64)


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all centroids."""
    x, c = x.astype(np.int64), centroids.astype(np.int64)
    most = int(np.abs(x).max(initial=0)) * int(np.abs(c).max(initial=0)) * x.shape[1]
    dot = (x.astype(float) @ c.T.astype(float)).astype(np.int64) if most < 2**53 else x @ c.T  # sums of products are whole below 2**53
    return (x * x).sum(axis=1)[:, None] - 2 * dot + (c * c).sum(axis=1)[None, :]


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For clusters i and centroids j: how much nearer j can have come to a point of i's sphere about its old centroid."""
    old, new = old.astype(float), new.astype(float)
    way = new - old
    drift = np.sqrt((way * way).sum(axis=1))
    axis = way / np.where(drift > 0, drift, 1)[:, None]
    off = old[:, None, :] - ((old + new) / 2)[None, :, :]
    far = np.sqrt((off * off).sum(axis=2))
    outside = far > radius[:, None]
    along = np.einsum("ijd,jd->ij", off, axis) / np.where(far > 0, far, 1)
    seen = np.arcsin(np.clip(radius[:, None] / np.where(outside, far, 1), 0, 1))
    angle = np.maximum(np.arccos(np.clip(along, -1, 1)) - seen, 0)
    share = np.where(outside, np.maximum(np.cos(angle), 0), 1)
    return np.minimum(share * (1 + SPARE) + SPARE, 1) * drift[None, :]


def _others(matrix: np.ndarray, best, empty: float) -> np.ndarray:
    """``best`` of each row but for its diagonal."""
    off = matrix.astype(float).copy()
    np.fill_diagonal(off, empty)
    return best(off, axis=1) if len(off) else np.zeros(0)


def assigned(rows: DataFrame, centroids: np.ndarray, loosened: np.ndarray | None) -> DataFrame:
    """Rows (id, v, cluster, distance, lower, scans), each at its nearest centroid; ``loosened``: of each cluster's bounds."""
    kind = "id {}, v array<int>, cluster int, distance bigint, lower double, scans int".format(rows.schema["id"].dataType.simpleString())
    dims = centroids.shape[1]
    half = np.sqrt(_others(squared(centroids, centroids), np.min, np.inf)) / 2

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("v").flatten().to_numpy().reshape(-1, dims)
            if loosened is None:
                cluster, distance = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
                lower, scans, open_ = np.zeros(len(x)), np.zeros(len(x), np.int32), np.ones(len(x), bool)
            else:
                cluster = b.column("cluster").to_numpy().astype(np.int64)
                step = x.astype(np.int64) - centroids[cluster]
                distance = (step * step).sum(axis=1)
                lower = b.column("lower").to_numpy() - loosened[cluster]
                scans = b.column("scans").to_numpy().copy()
                near = np.sqrt(distance.astype(float)) * (1 + SPARE) + SPARE
                open_ = near >= np.maximum(lower, half[cluster])
            at = np.flatnonzero(open_)
            if len(at):
                all_ = squared(x[at], centroids)
                own = all_.argmin(axis=1)  # the first of equal ones
                cluster, distance, lower = cluster.copy(), distance.copy(), lower.copy()
                cluster[at], distance[at] = own, all_[np.arange(len(at)), own]
                rest = all_.astype(float)
                rest[np.arange(len(at)), own] = np.inf
                lower[at] = np.sqrt(rest.min(axis=1)) * (1 - SPARE)
                scans[at] += 1
            out = [b.column("id"), b.column("v"), pa.array(cluster.astype(np.int32)), pa.array(distance), pa.array(lower), pa.array(scans)]
            yield pa.RecordBatch.from_arrays(out, ["id", "v", "cluster", "distance", "lower", "scans"])

    return rows.mapInArrow(read, kind)


def moved(rows: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The centroids at the means of their clusters, rounded down, and the radius of each cluster about its old centroid."""
    sums = [F.sum(F.col("v")[d].cast("bigint")).alias(f"s{d}") for d in range(centroids.shape[1])]
    found = rows.groupBy("cluster").agg(F.count("*").alias("n"), F.max("distance").alias("most"), *sums).collect()
    new, radius = centroids.copy(), np.zeros(len(centroids))
    for r in found:
        new[r.cluster] = [s // r.n for s in r[3:]]
        radius[r.cluster] = np.sqrt(float(r.most)) * (1 + SPARE)
    return new, radius


def cluster(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS, dims: int = DIMS,
    scale: int = SCALE, seed: int = SEED,
) -> tuple[DataFrame, np.ndarray]:
    """Rows (id, v, cluster, distance, lower, scans) and the final centroids.

    ``v`` is the vector in whole numbers, ``distance`` its squared distance to its centroid,
    ``scans`` how often it was compared with every centroid. Rows whose vector is null, of
    another length, or has a null or non-finite component take no part. Repeated rows count
    each. With fewer rows than ``k`` every one is a centroid at first; equal ones among them
    stay equal until the second is empty, for ties go to the smaller number. A null key is
    hashed as the empty text. An empty table gives no rows and no centroids. A finite
    component that times ``scale`` reaches 2**27 ends in an error, since distances would not
    fit a long. Only the two named columns are read.
    """
    v = whole(F.col(f"`{vector}`"), dims, scale)
    rows = vectors.select(F.col(f"`{key}`").alias("id"), v.alias("v")).where("v is not null")
    rows = written(rows, "vectors")
    centroids = seeds(rows, k, seed).reshape(-1, dims)
    if not len(centroids):
        kind = ", cast(0 as int) as cluster, 0L as distance, cast(0 as double) as lower, cast(0 as int) as scans"
        return rows.selectExpr("id", "v", *kind.strip(", ").split(", ")), centroids
    rows = written(assigned(rows, centroids, None), "assigned")
    for _ in range(rounds):
        new, radius = moved(rows, centroids)
        loosened = np.maximum(_others(loosening(centroids, new, radius), np.max, 0.0), 0)
        centroids = new
        rows = written(assigned(rows, centroids, loosened), "assigned")
    return rows, centroids


def report(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Rows (id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of a clustering."""
    spark = rows.sparkSession
    sums = {r.cluster: r.s for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    told = [(i, sums.get(i, 0), sum(sums.values()), n) for i, n in enumerate(names)]
    of = spark.createDataFrame(told, "c int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return rows.join(F.broadcast(of), F.expr("cluster = c")).select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql() -> str:
    """The query's result in SQL: every round compares every vector with every centroid."""
    floor = f"CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)"
    parts = [f"""
    WITH v AS (
        SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: {floor}) AS v FROM embeddings
        WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS}
    ),
    c0 AS (
        SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS c, v AS m
        FROM v ORDER BY c LIMIT {K}
    )"""]
    for r in range(ROUNDS + 1):
        off = "list_transform(list_zip(v.v, c.m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))"
        parts.append(f"""
    a{r} AS (
        SELECT id, any_value(vec_id) AS vec_id, any_value(v) AS v, min(CAST(c AS HUGEINT) + d * {K}) AS best
        FROM (SELECT v.id, v.vec_id, v.v, c.c, CAST(list_sum({off}) AS HUGEINT) AS d FROM v, c{r} c) GROUP BY id
    ),
    b{r} AS (SELECT id, vec_id, v, CAST(best % {K} AS INT) AS c, CAST(best // {K} AS BIGINT) AS d FROM a{r})""")
        if r < ROUNDS:
            parts.append(f"""
    s{r} AS (
        SELECT c, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS m
        FROM (SELECT c, i, sum(v[i]) AS s, count(*) AS n FROM b{r}, range(1, {DIMS + 1}) t(i) GROUP BY c, i) GROUP BY c
    ),
    c{r + 1} AS (SELECT c.c, coalesce(s.m, c.m) AS m FROM c{r} c LEFT JOIN s{r} s ON s.c = c.c)""")
    return ",".join(parts) + f"""
    SELECT b.vec_id, b.c AS cluster, b.d AS distance,
        CAST(sum(b.d) OVER (PARTITION BY b.c) AS BIGINT) AS cluster_inertia, CAST(sum(b.d) OVER () AS BIGINT) AS inertia,
        sha256(array_to_string(c.m, ',')) AS centroid_sha256
    FROM b{ROUNDS} b JOIN c{ROUNDS} c ON c.c = b.c
    """
