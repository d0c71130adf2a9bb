"""Clustering: bounds against full scans, and the defined cases."""

import hashlib
import random

import numpy as np
import pytest

from weftline.llm import clustering

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, k=8, rounds=10):
    """Lloyd's rounds in Python's integers, every distance taken each time."""
    seeds = sorted((hashlib.sha256(f"3:{'null' if i is None else i}".encode()).hexdigest(), v) for i, v in rows)
    centroids = [v for _, v in seeds[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in rows]
        for j in range(len(centroids)):
            if own := [v for (_, v), o in zip(rows, of, strict=True) if o == j]:
                centroids[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    return sorted((i is None, i, *near(v)[::-1]) for i, v in rows), centroids


def of(table):
    return sorted((r.vec_id is None, r.vec_id, r.cluster, r.distance) for r in table.collect())


@pytest.fixture(scope="module")
def vectors(spark):
    rng = random.Random(5)
    centres = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(5)]
    rows = [(i, [float(np.float32(c + rng.gauss(0, 0.2))) for c in centres[i % 5]], i % 5) for i in range(300)]
    rows += [(7, rows[8][1], 0), (7, rows[8][1], 0), (None, rows[9][1], None), (301, [0.0] * 64, 0), (302, [0.0] * 64, 0)]
    return rows


def test_equals_full_scans(spark, vectors):
    table, centroids, scans = clustering.cluster(spark.createDataFrame(vectors, SCHEMA).repartition(5))
    ints = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v, _ in vectors]
    want, want_centroids = plain(ints)
    assert of(table) == want and centroids == want_centroids
    assert scans[0] == len(vectors) and sum(scans[1:]) < 10 * len(vectors)  # bounds spare scans


def test_bounds_hold_in_every_round(spark, vectors):
    x = np.array([[int(np.floor(1024 * c)) for c in v] for _, v, _ in vectors])
    rng = np.random.default_rng(3)
    centroids = x[:6].copy()
    now = clustering.Round.of(centroids, centroids)
    cluster, best, second = now.scan(x)
    upper, lower = np.sqrt(best), np.sqrt(second)
    for step in (0, 1, 40, 300, 2):
        before, centroids = centroids, centroids + rng.integers(-step - 1, step + 2, centroids.shape)
        if step == 2:
            centroids[1] = centroids[0]  # equal centroids tie
        now = clustering.Round.of(centroids, before)
        cluster, upper, lower, _ = now.assign(x, cluster, upper, lower)
        full = np.stack([clustering.exact(x, c) for c in centroids], axis=1)
        assert (cluster == full.argmin(axis=1)).all()
        own = full[np.arange(len(x)), cluster].astype(float)
        full[np.arange(len(x)), cluster] = np.iinfo(np.int64).max
        assert (upper**2 >= own * (1 - 1e-9)).all() and (np.maximum(lower, 0) ** 2 <= full.min(axis=1) * (1 + 1e-9)).all()


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 0), (2, [], 0), (3, [1.0] * 63, 0), (4, [1.0] * 63 + [None], 0), (5, [1.0] * 63 + [nan], 0), (6, [1.0] * 63 + [-inf], 0), (7, [2e5] + [1.0] * 63, 0), (8, [-131072.0] + [1.0] * 63, 0), (9, [131072.0] + [-0.0001] * 63, 0)]
    table, centroids, _ = clustering.cluster(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as cluster", "1 as upper", "2 as v"))
    found = {r.vec_id: r for r in table.collect()}
    assert set(found) == {8, 9} and len(centroids) == 2  # fewer vectors than clusters
    assert {r.distance for r in found.values()} == {0} and found[9].v[1] == -1  # floor, not truncation
    table, centroids, _ = clustering.cluster(spark.createDataFrame(rows[:7], SCHEMA))
    assert table.count() == 0 and centroids == [] and "cluster" in table.columns


def test_query_of_an_empty_table(spark, store):
    out = clustering.op11_hamerly(spark, store(embeddings=spark.createDataFrame([], SCHEMA)))
    assert out.count() == 0 and out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_sums_beyond_64_bits_are_null(spark, store):
    rows = [(i, [131072.0 * (1 if (i * 37 >> (k % 7)) % 2 else -1) for k in range(64)], 0) for i in range(40)]
    out = clustering.op11_hamerly(spark, store(embeddings=spark.createDataFrame(rows, SCHEMA))).collect()
    want, _ = plain([(i, [int(1024 * x) for x in v]) for i, v, _ in rows])
    assert sorted((r.vec_id, r.cluster, r.distance) for r in out) == [w[1:] for w in want]
    total = sum(w[3] for w in want)
    assert total >= 1 << 63 and {r.inertia for r in out} == {None}
    for r in out:
        own = sum(w[3] for w in want if w[2] == r.cluster)
        assert r.cluster_inertia == (own if own < 1 << 63 else None)
