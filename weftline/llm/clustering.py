"""Centroid clustering: exact integer k-means under Hamerly's bounds.

Every vector keeps its cluster, one upper bound on the distance to its centroid
and one lower bound on the distance to the second-nearest. When centroids move,
the upper bound grows by the drift of the own centroid and the lower one shrinks
by the largest drift of the others. Where the upper bound stays below the lower
one, or below half the distance from the own centroid to its nearest neighbour,
the vector cannot change its cluster and no distance is taken. Ambiguous vectors
first get the exact distance to their own centroid; those that stay ambiguous
are scanned against all centroids in integers.

Bounds are floating point and rounded outwards, and a vector is passed over only
where they differ strictly, so clusters are those of a full scan, ties included.

A round is a map over the vectors' table: no shuffle. Vectors that moved give
differences of sums and counts, added up in each task first: what is shuffled and
reaches the driver is a row per task and cluster. The table of vectors with
their bounds is written each round, and the one before it is removed, so lost
executors cost no more than their own tasks.

Defined cases: vectors that are null, have another number of components, or hold
a null or non-finite one are left out; so are components beyond 131,072 in size,
whose squared distances do not fit 64 bits. Fewer kept vectors than clusters give
fewer clusters, none give no rows. Null ids are kept and hash as ``null``.
Repeated rows each have a row of their own; of equal hashes the smaller vector,
by its components, comes first. Equal centroids are ties: the smaller number wins,
and the other stays empty. Sums of distances beyond 64 bits are null. Other
columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm._common import materialize, release, slices, table

#: Largest size of a component whose squared distances, over 64 of them, fit 64 bits.
LARGEST = 131_072
#: Outward rounding of a bound: far above the error of a root and a sum, far below any gap of interest.
_UP, _DOWN = 1 + 1e-12, 1 - 1e-12
_STATE = ("vec_id", "v", "cluster", "upper", "lower", "distance", "before", "scanned")
_KINDS = {"cluster": pa.int32(), "upper": pa.float64(), "lower": pa.float64(), "distance": pa.int64(), "before": pa.int32(), "scanned": pa.bool_()}


def integer_vectors(vectors: DataFrame, size: int, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and v, the integers floor(scale * x); rows that are no vectors of ``size`` finite components go."""
    # ANSI division and casts cannot fail below: what is outside of the range has gone
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > LARGEST * 1024 // scale)
    doubles = F.col(vector_col).cast("array<double>")
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), doubles.alias("v")).where(F.col("v").isNotNull() & (F.size("v") == size) & ~F.exists("v", bad))
    return kept.select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("int")).alias("v"))


def first_centroids(kept: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of ``salt:vec_id``, in that order: a top-k, of which k rows reach the driver."""
    name = F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null")))
    rows = kept.select(F.sha2(name.cast("binary"), 256).alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r.v for r in rows], dtype=np.int64)


def exact(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Squared distances of rows to one centroid, or row by row to as many."""
    d = x - centroid
    return np.einsum("ij,ij->i", d, d)


@dataclass(frozen=True)
class Round:
    """Centroids, how far each moved since the bounds were taken, and half its distance to the nearest other one."""

    centroids: np.ndarray  # (k, dimensions) int64
    drift: np.ndarray
    drift_others: np.ndarray
    half_gap: np.ndarray

    @classmethod
    def of(cls, centroids: np.ndarray, before: np.ndarray) -> Round:
        k = len(centroids)
        drift = np.sqrt(exact(centroids, before)) * _UP
        others = np.array([max([drift[j] for j in range(k) if j != i], default=0.0) for i in range(k)])
        gaps = np.array([min([int(exact(centroids[i : i + 1], centroids[j])[0]) for j in range(k) if j != i], default=np.inf) for i in range(k)], dtype=float)
        return cls(centroids, drift, others, np.sqrt(gaps) / 2 * _DOWN)

    def scan(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest centroid (of ties the smaller number), its squared distance, and that of the second-nearest (infinite if there is none)."""
        all_ = np.stack([exact(x, c) for c in self.centroids], axis=1)
        near = all_.argmin(axis=1)
        at = np.arange(len(x))
        best = all_[at, near]
        all_[at, near] = np.iinfo(np.int64).max
        second = all_.min(axis=1).astype(float) if len(self.centroids) > 1 else np.full(len(x), np.inf)
        return near.astype(np.int32), best, second

    def assign(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """cluster, upper, lower after this round, and which rows were scanned."""
        cluster = cluster.copy()
        upper = (upper + self.drift[cluster]) * _UP
        lower = (lower - self.drift_others[cluster]) * np.where(lower > self.drift_others[cluster], _DOWN, _UP)
        bound = np.maximum(lower, self.half_gap[cluster])
        open_ = np.flatnonzero(~(upper < bound))
        upper[open_] = np.sqrt(exact(x[open_], self.centroids[cluster[open_]])) * _UP
        open_ = open_[~(upper[open_] < bound[open_])]
        near, best, second = self.scan(x[open_])
        cluster[open_], upper[open_], lower[open_] = near, np.sqrt(best) * _UP, np.sqrt(second) * _DOWN
        scanned = np.zeros(len(x), dtype=bool)
        scanned[open_] = True
        return cluster, upper, lower, scanned


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, -1)


def _assigned(state: DataFrame, now: Round, last: bool) -> DataFrame:
    """The state one round on; ``before`` is the cluster that the vector had (-1: none), ``distance`` is exact in the last round, else -1."""
    new = "cluster" not in state.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 10_000, 8):
                x = _matrix(part.column("v"), part.num_rows)
                if new:
                    before = np.full(len(x), -1, dtype=np.int32)
                    cluster, best, second = now.scan(x)
                    upper, lower, scanned = np.sqrt(best) * _UP, np.sqrt(second) * _DOWN, np.ones(len(x), dtype=bool)
                else:
                    before = part.column("cluster").to_numpy()
                    cluster, upper, lower, scanned = now.assign(x, before, part.column("upper").to_numpy(), part.column("lower").to_numpy())
                distance = exact(x, now.centroids[cluster]) if last else np.full(len(x), -1)
                values = {"cluster": cluster, "upper": upper, "lower": lower, "distance": distance, "before": before, "scanned": scanned}
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("v"), *[pa.array(values[c], _KINDS[c]) for c in _STATE[2:]]], list(_STATE))

    return state.mapInArrow(run, "vec_id long, v array<int>, cluster int, upper double, lower double, distance long, before int, scanned boolean")


def _moved_sums(state: DataFrame) -> list:
    """By cluster: change of count and of component sums, from the vectors that moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[int, int] = {}
        total: dict[int, np.ndarray] = {}
        for part in batches:
            x = _matrix(part.column("v"), part.num_rows)
            for side, sign in (("cluster", 1), ("before", -1)):
                of = part.column(side).to_numpy()
                for j in np.unique(of[of >= 0]).tolist():
                    own = x[of == j]
                    count[j] = count.get(j, 0) + sign * len(own)
                    total[j] = total.get(j, 0) + sign * own.sum(axis=0)
        if count:
            yield pa.RecordBatch.from_arrays([pa.array(count, pa.int32()), pa.array(count.values(), pa.int64()), pa.array([t.tolist() for t in total.values()], pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = state.where("cluster <> before").select("v", "cluster", "before").mapInArrow(run, "cluster int, n long, sums array<long>")
    each = parts.select("cluster", "n", F.posexplode("sums").alias("at", "s")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    return each.groupBy("cluster").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", "s"))).alias("s")).collect()  # a row per cluster


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, size: int = 64, salt: str = "3", scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, list[list[int]], list[int]]:
    """Clusters of all kept vectors, the final centroids, and how many vectors were scanned in each round.

    The table has vec_id, v (integers), cluster, upper, lower, distance (squared, exact) and ``before``, the cluster of the
    round before.
    """
    kept = integer_vectors(vectors, size, scale, id_col, vector_col)
    centroids = first_centroids(kept, k, salt)
    if not len(centroids):
        empty = kept.select("vec_id", "v", *[F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("upper", "double"), ("lower", "double"), ("distance", "long"), ("before", "int"))])
        return empty, [], []
    count = [0] * len(centroids)
    total = [[0] * size for _ in centroids]
    state, before, scans = kept, centroids, []
    for n in range(rounds + 1):
        last = n == rounds
        old, state = state, materialize(_assigned(state, Round.of(centroids, before), last), "vectors")
        if n:
            release(old)
        scans.append(state.where("scanned").count())
        if last:
            break
        for r in _moved_sums(state):
            count[r.cluster] += r.n
            total[r.cluster] = [a + int(b.s) for a, b in zip(total[r.cluster], r.s, strict=True)]
        before = centroids
        centroids = np.array([[t // c for t in ts] if c else old_.tolist() for c, ts, old_ in zip(count, total, before, strict=True)], dtype=np.int64)
    return state.drop("scanned"), centroids.tolist(), scans


def op11_hamerly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings in eight clusters, with inertia and the digest of each vector's centroid."""
    found, centroids, _ = cluster(table(spark, sf_dir, "embeddings"))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    whole = lambda c: F.expr(f"try_cast(sum(cast({c} as decimal(38,0))) as bigint)")
    of = found.groupBy("cluster").agg(whole("distance").alias("cluster_inertia"))
    named = spark.createDataFrame([(i, d) for i, d in enumerate(digests)], "cluster int, centroid_sha256 string")
    # both sides have a row per cluster
    rows = found.join(F.broadcast(of), "cluster").join(F.broadcast(found.agg(whole("distance").alias("inertia")))).join(F.broadcast(named), "cluster")
    return rows.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = 8, rounds: int = 10) -> str:
    """The rounds in a row, each with a full scan."""
    steps = [
        """k AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x) AND abs(x) <= 131072)) = 64)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS j, v AS c FROM (SELECT v, sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), 'null')) AS h FROM k ORDER BY h, v LIMIT {k}))",
        "n AS MATERIALIZED (SELECT row_number() OVER () AS row_id, * FROM k)",
    ]
    near = "SELECT row_id, min([list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), j]) AS b FROM n CROSS JOIN c{i} GROUP BY row_id"
    for i in range(rounds):
        steps += [
            f"a{i} AS MATERIALIZED ({near.format(i=i)})",
            f"s{i} AS MATERIALIZED (SELECT j, list(CAST((t - ((t % m) + m) % m) // m AS BIGINT) ORDER BY p) AS c FROM (SELECT b[2] AS j, p, sum(x) AS t, count(*) AS m FROM (SELECT b, unnest(v) AS x, unnest(range(64)) AS p FROM a{i} JOIN n USING (row_id)) GROUP BY j, p) GROUP BY j)",
            f"c{i + 1} AS MATERIALIZED (SELECT j, coalesce(s.c, o.c) AS c FROM c{i} o LEFT JOIN s{i} s USING (j))",
        ]
    return f"""
WITH {", ".join(steps)},
a AS MATERIALIZED (SELECT vec_id, CAST(b[1] AS BIGINT) AS distance, b[2] AS cluster FROM ({near.format(i=rounds)}) JOIN n USING (row_id))
SELECT a.vec_id, CAST(a.cluster AS INTEGER) AS cluster, a.distance, CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a JOIN c{rounds} c ON c.j = a.cluster
"""


OP11_SQL = _sql()
