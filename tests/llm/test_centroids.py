"""Clustering against rounds that compare every vector with every centroid, and the bound against points."""

import hashlib

import numpy as np
import pytest

from fixwright.llm import centroids

ROWS = "vec_id bigint, embedding array<float>, v string"


def plain(rows, k, rounds, scale=256, dims=64):
    vectors = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows]
    order = sorted(vectors, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    means = [list(v) for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m)), c) for c, m in enumerate(means))

    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in vectors]
        for c in range(len(means)):
            own = [v for (_, v), a in zip(vectors, at) if a == c]
            if own:
                means[c] = [sum(x) // len(own) for x in zip(*own)]
    out = [(i, *reversed(nearest(v))) for i, v in vectors]
    return sorted(out, key=str), means


def read(rows):
    return sorted([(r.id, r.cluster, r.distance) for r in rows.collect()], key=str)


def blobs(n, groups, spread, dims=64, seed=0):
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, 1, (groups, dims))
    return [(i, [float(x) for x in np.float32(middles[i % groups] + rng.normal(0, spread, dims))]) for i in range(n)]


@pytest.mark.parametrize("spread", [0.05, 0.6])
def test_equals_plain_rounds_with_fewer_scans(spark, spread):
    rows = blobs(300, 6, spread)
    frame = spark.createDataFrame([(*r, "x") for r in rows], ROWS).repartition(4)
    found, means = centroids.cluster(frame, k=8)
    want, plain_means = plain(rows, 8, 5)
    assert read(found) == want and means.tolist() == plain_means
    scans = [r.scans for r in found.collect()]
    assert min(scans) >= 1 and sum(scans) < (0.5 if spread < 0.1 else 0.9) * 6 * len(rows)
    told = centroids.report(found, means).collect()
    total = sum(d for _, _, d in want)
    for r in told:
        assert r.inertia == total and r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, means[r.cluster].tolist())).encode()).hexdigest()


def test_ties_copies_and_small_tables(spark):
    rows = [(i % 7, [float(i % 3)] * 64) for i in range(30)] + [(None, [0.5] * 64), (None, [0.25] * 64)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], ROWS)
    for k in (2, 5, 40):
        found, means = centroids.cluster(frame, k=k)
        want, plain_means = plain(rows, k, 5)
        assert read(found) == want and means.tolist() == plain_means


def test_unfit_vectors_take_no_part(spark):
    good = [0.1] * 64
    odd = [None, [], good[:63], [*good, 0.1], [None, *good[1:]], [float("nan"), *good[1:]], [float("-inf"), *good[1:]]]
    frame = spark.createDataFrame([(1, good, None), *[(i + 2, v, "id") for i, v in enumerate(odd)]], ROWS).withColumnRenamed("v", "cluster")
    found, _ = centroids.cluster(frame)
    assert read(found) == [(1, 0, 0)]
    none, means = centroids.cluster(frame.where("vec_id > 1"))
    assert centroids.report(none, means).count() == 0 and not len(means)
    with pytest.raises(Exception, match="must stay below"):
        centroids.cluster(spark.createDataFrame([(1, [1e9] * 64, None)], ROWS))


def test_loosening_holds_for_every_point_and_is_below_full_drift():
    rng = np.random.default_rng(5)
    for dims in (2, 3, 64):
        old = rng.normal(0, 10, (6, dims))
        new = old + rng.normal(0, 2, (6, dims))
        radius = rng.uniform(0, 12, 6)
        most = centroids.loosening(old, new, radius)
        drift = np.linalg.norm(new - old, axis=1)
        assert (most <= drift * (1 + 1e-8) + 1e-8).all() and (most < 0.9 * drift).any()
        for i in range(6):
            way = rng.normal(0, 1, (4000, dims))
            way /= np.linalg.norm(way, axis=1, keepdims=True)
            x = old[i] + way * (radius[i] * rng.uniform(0, 1, (4000, 1)) ** (1 / dims))
            nearer = np.linalg.norm(x[:, None] - old, axis=2) - np.linalg.norm(x[:, None] - new, axis=2)
            assert (nearer <= most[i] + 1e-9).all()


def test_distances_of_large_components_are_exact():
    x, c = np.array([[2**27 - 1] * 64, [-(2**27) + 1] * 64]), np.array([[-(2**27) + 1] * 64, [5] * 64])
    assert centroids.squared(x, c).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(u, w)) for w in c] for u in x]
