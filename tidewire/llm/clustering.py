"""Centroid clustering of integer vectors with Hamerly's bounds.

Every vector carries one upper bound of its distance to its own centroid and one lower bound of its distance to
the second-nearest. When centroids move, the upper bound grows by the drift of its own and the lower one shrinks
by the largest drift of the others. A vector whose upper bound is below its lower bound, or below half the way to
the centroid nearest to its own, keeps its cluster unread. The rest get an exact distance to their own centroid,
and those still ambiguous an exact integer scan of all centroids. Bounds are rounded away from each other, and only
a strict comparison saves a scan, so that results are those of full scans, ties included.

Each round is a table in the shared folder; vectors that changed their cluster are read back and summed by task,
so what reaches the driver is a sum and a count a centroid, whatever the table's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: Larger components have squared distances that no long holds: at 64 of them, each up to 2^28 apart, 2^62.
LIMIT = 1 << 27
#: What bounds are loosened by for rounding, relative to themselves.
SLACK = 1e-12
STATE = "vec_id long, v array<long>, cluster int, was int, upper double, lower double, scans int"
NONE = -1


def vectors(table: DataFrame, key: str = "vec_id", column: str = "embedding", width: int = 64, scale: int = 64) -> DataFrame:
    """vec_id and v: the components as floor(scale * x). Vectors of another width, null or with null or non-finite components are left out.

    So are those with a component beyond ``LIMIT`` after scaling (2,097,152 at a scale of 64): their squared distances have no long.
    A null key stays; repeated rows are vectors of their own.
    """
    scaled = F.transform(F.col(column), lambda x: x.cast("double") * scale)
    fits = F.forall("x_", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= float(LIMIT)))
    rows = table.select(F.col(key).cast("long").alias("vec_id"), scaled.alias("x_")).filter((F.size("x_") == width) & fits)
    return rows.select("vec_id", F.transform("x_", lambda x: F.floor(x)).alias("v"))


def seeds(rows: DataFrame, k: int, seed: int = 1) -> np.ndarray:
    """The k vectors with the smallest sha256 of ``seed:vec_id``, in that order; of equal hashes (null ids are empty) the smaller vector. Fewer if there are fewer."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = rows.select(digest.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r.v for r in first], np.int64)


def _up(x: np.ndarray) -> np.ndarray:
    return x + np.abs(x) * SLACK


def _down(x: np.ndarray) -> np.ndarray:
    return x - np.abs(x) * SLACK


def _own(v: np.ndarray, centroids: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    return ((v - centroids[cluster]) ** 2).sum(1)


def scan(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (ties: the smaller number), its squared distance, and the second-nearest one's, or -1."""
    d = np.stack([((v - c) ** 2).sum(1) for c in centroids], 1)
    near = d.argmin(1)
    best = d[np.arange(len(d)), near]
    if len(centroids) == 1:
        return near, best, np.full(len(d), -1)
    return near, best, np.partition(d, 1, axis=1)[:, 1]


class Step:
    """One assignment: centroids, and how far each has drifted since the last one (None before the first)."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None = None):
        self.centroids = centroids
        self.first = before is None
        k = len(centroids)
        self.half = np.full(k, np.inf)
        for c in range(k):
            others = np.delete(centroids, c, 0)
            if len(others):
                self.half[c] = _down(np.sqrt(((others - centroids[c]) ** 2).sum(1).min().astype(float))) / 2
        self.drift = np.zeros(k) if self.first else _up(np.sqrt(((centroids - before) ** 2).sum(1).astype(float)))
        order = np.argsort(self.drift)
        self.most = np.full(k, self.drift[order[-1]])
        self.most[order[-1]] = self.drift[order[-2]] if k > 1 else 0.0

    def assign(self, v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, scans: np.ndarray) -> tuple[np.ndarray, ...]:
        """New cluster, upper, lower and scans of vectors."""
        if self.first:
            look = np.arange(len(v))
            cluster, upper, lower, scans = np.zeros(len(v), np.int64), np.zeros(len(v)), np.zeros(len(v)), scans.copy()
        else:
            cluster, scans = cluster.copy(), scans.copy()
            upper, lower = _up(upper + self.drift[cluster]), _down(lower - self.most[cluster])
            safe = np.maximum(self.half[cluster], lower)
            look = np.flatnonzero(~(upper < safe))
            upper[look] = _up(np.sqrt(_own(v[look], self.centroids, cluster[look]).astype(float)))
            look = look[~(upper[look] < safe[look])]
        near, best, second = scan(v[look], self.centroids)
        cluster[look], upper[look] = near, _up(np.sqrt(best.astype(float)))
        lower[look] = np.where(second < 0, np.inf, _down(np.sqrt(np.maximum(second, 0).astype(float))))
        scans[look] += 1
        return cluster, upper, lower, scans


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, -1)


def assigned(state: DataFrame, step: Step) -> DataFrame:
    """The state after a step; ``was`` is the cluster before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            was, upper, lower, scans = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 4, 5, 6))
            cluster, upper, lower, scans = step.assign(_matrix(batch.column(1), n), was.astype(np.int64), upper, lower, scans)
            columns = [batch.column(0), batch.column(1), pa.array(cluster, pa.int32()), pa.array(was, pa.int32()), pa.array(upper), pa.array(lower), pa.array(scans, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return state.mapInArrow(run, STATE)


def sums(state: DataFrame, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """What rounds add to sums and counts of clusters: the vectors that changed theirs, with a minus for the one they left. Exact, as objects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, width + 1), np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            cluster, was = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            v = np.concatenate([_matrix(batch.column(0), n), np.ones((n, 1), np.int64)], 1)
            np.add.at(total, cluster, v)
            left = was >= 0
            np.subtract.at(total, was[left], v[left])
        at = np.argwhere(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at[:, 0]), pa.array(at[:, 1]), pa.array(total[at[:, 0], at[:, 1]])], ["cluster", "place", "total"])

    parts = state.filter("cluster <> was").select("v", "cluster", "was").mapInArrow(run, "cluster long, place long, total long")
    rows = parts.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(19,0)")).alias("total")).collect()
    out = np.zeros((k, width + 1), object)
    for r in rows:
        out[r.cluster, r.place] = int(r.total)
    return out[:, :width], out[:, width]


def cluster(rows: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance, scans) of every vector (vec_id, v), and the final centroids.

    ``rounds`` times each vector goes to its nearest centroid (squared distance, ties: the smaller number) and each centroid that
    has vectors becomes their componentwise floor(sum / count); then vectors are assigned once more. ``scans`` counts full scans.
    An empty table gives no rows and no centroids.
    """
    spark = rows.sparkSession
    none = "vec_id long, cluster int, distance long, scans int"
    centroids = seeds(rows, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], none), centroids
    n, width = centroids.shape
    start = {"cluster": F.lit(NONE), "was": F.lit(NONE), "upper": F.lit(0.0), "lower": F.lit(0.0), "scans": F.lit(0)}
    state, old, before = rows.withColumns(start), None, None
    total, count = np.zeros((n, width), object), np.zeros(n, object)
    for _ in range(rounds):
        state = materialize(assigned(state, Step(centroids, before)), "clusters")
        if old is not None:
            discard(old)
        old = state
        more = sums(state, n, width)
        total, count = total + more[0], count + more[1]
        before = centroids
        centroids = np.array([[int(x) // int(count[c]) for x in total[c]] if count[c] else before[c] for c in range(n)], np.int64)
    last = Step(centroids, before)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column(1), batch.num_rows)
                was, upper, lower, scans = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 4, 5, 6))
                got, _, _, scans = last.assign(v, was.astype(np.int64), upper, lower, scans)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.int32()), pa.array(_own(v, centroids, got)), pa.array(scans, pa.int32())], ["vec_id", "cluster", "distance", "scans"])

    out = materialize(state.mapInArrow(run, none), "clustered")
    if old is not None:
        discard(old)
    return out, centroids


def described(clustered: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Clustered vectors with cluster_inertia, inertia (distances summed over the cluster and over all) and centroid_sha256. A row a cluster reaches the driver."""
    if not len(centroids):
        more = {"cluster_inertia": F.lit(0).cast("long"), "inertia": F.lit(0).cast("long"), "centroid_sha256": F.lit("")}
        return clustered.withColumns(more)
    own = {r.cluster: int(r.d) for r in clustered.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    at = F.col("cluster") + 1
    text = [F.sha2(F.lit(",".join(map(str, c.tolist()))), 256) for c in centroids]
    each = [F.lit(own.get(c, 0)).cast("long") for c in range(len(centroids))]
    return clustered.withColumns({"cluster_inertia": F.element_at(F.array(*each), at), "inertia": F.lit(sum(own.values())).cast("long"), "centroid_sha256": F.element_at(F.array(*text), at)})
