"""Approximate nearest neighbours by robust-pruned directed graphs, one a shard.

Vectors are dealt to shards by hash, and by magnitude in steps of 2 ** 20. In a shard, points enter the graph in batches of doubling
size: a greedy beam search from the entry point proposes what it visits as neighbours, and
robust pruning keeps, nearest first, those that no kept one is closer to by a factor: few
edges, in all directions. Each kept edge is also proposed in reverse. A query's beam search
runs over every shard's graph, its candidates are ranked by exact distance, and the best of all
shards are the result. Equal vectors are one point of the graph with the least of their ids, as
many as a result can hold: without that, a common vector would fill its neighbours' edges.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Edges a point, width of the beam when building and when searching, relaxation of pruning.
DEGREE, BUILD_BEAM, SEARCH_BEAM, ALPHA = 24, 40, 160, 1.2
#: Points a shard, queries a block.
SHARD_ROWS, QUERY_BLOCK = 8192, 1024
#: Blocks of queries that a copy of a shard answers.
COPY_BLOCKS = 64
BATCH = 256
SALTS = 32


class Graph:
    """Distances are told in units of the farthest component from the centre, so that neither large nor small or offset vectors lose them in 32 bits."""

    def __init__(self, points: np.ndarray, edges: np.ndarray | None = None, entry: int = 0):
        points = np.asarray(points, dtype=np.float64)
        self.scale = float(np.abs(points).max(initial=0)) or 1.0
        self.centre = (points / self.scale).mean(axis=0)
        self.unit = float(np.abs(points / self.scale - self.centre).max(initial=0)) or 1.0
        self.points = self.placed(points)
        self.edges = np.full((len(points), DEGREE), -1, dtype=np.int32) if edges is None else edges
        self.entry = entry

    def placed(self, vectors: np.ndarray) -> np.ndarray:
        """Vectors about the centre, in units; one too far away for its square to be told is moved in along its direction."""
        x = (vectors / self.scale - self.centre) / self.unit
        far = np.abs(x).max(axis=1, keepdims=True, initial=0)
        return np.ascontiguousarray(np.where(far > 1e6, x / np.maximum(far, 1) * 1e6, x), dtype=np.float32)

    def _distances(self, queries: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Squared distances of each query to its row of ids; infinite where an id is missing."""
        d = self.points[ids] - queries[:, None, :]
        out = np.einsum("bkd,bkd->bk", d, d)
        out[ids < 0] = np.inf
        return out

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """The beam of each of placed queries, nearest first (-1: none), and the points that each step expanded."""
        n = len(queries)
        ids = np.full((n, beam), -1, dtype=np.int32)
        near = np.full((n, beam), np.inf, dtype=np.float32)
        ids[:, 0] = self.entry
        near[:, 0] = self._distances(queries, ids[:, :1])[:, 0]
        done = np.zeros((n, beam), dtype=bool)
        steps, live = [], np.arange(n)
        while len(live):
            fresh = ~done[live] & (ids[live] >= 0)
            live = live[fresh.any(axis=1)]
            if not len(live):
                break
            fresh = ~done[live] & (ids[live] >= 0)
            at = fresh.argmax(axis=1)
            done[live, at] = True
            step = np.full(n, -1, dtype=np.int32)
            step[live] = ids[live, at]
            steps.append(step)
            new = self.edges[step[live]]
            new = np.where((new[:, :, None] == ids[live][:, None, :]).any(axis=2), -1, new)
            all_ids = np.concatenate((ids[live], new), axis=1)
            all_near = np.concatenate((near[live], self._distances(queries[live], new)), axis=1)
            all_done = np.concatenate((done[live], np.zeros(new.shape, dtype=bool)), axis=1)
            order = np.argsort(all_near, axis=1, kind="stable")[:, :beam]
            ids[live], near[live], done[live] = (np.take_along_axis(x, order, axis=1) for x in (all_ids, all_near, all_done))
            ids[live] = np.where(np.isinf(near[live]), -1, ids[live])
        return ids, steps

    def prune(self, point: int, proposed: np.ndarray) -> np.ndarray:
        """Robust pruning: of the proposed neighbours, nearest first, those that no kept one is closer to by ALPHA."""
        c = np.unique(proposed)
        c = c[(c >= 0) & (c != point)]
        x = self.points[c]
        d = ((x - self.points[point]) ** 2).sum(axis=1)
        order = np.argsort(d, kind="stable")[: 4 * BUILD_BEAM]
        c, d, x = c[order], d[order], x[order]
        square = (x * x).sum(axis=1)
        between = square[:, None] + square[None, :] - 2 * (x @ x.T)
        alive, kept = np.ones(len(c), dtype=bool), []
        while len(kept) < DEGREE and alive.any():
            k = int(alive.argmax())
            kept.append(c[k])
            alive &= ALPHA * ALPHA * np.maximum(between[k], 0) > d
            alive[k] = False
        return np.array(kept, dtype=np.int32)

    def _link(self, point: int, neighbours: np.ndarray) -> None:
        self.edges[point] = -1
        self.edges[point, : len(neighbours)] = neighbours

    def build(self) -> Graph:
        n = len(self.points)
        centre = self.points.mean(axis=0, dtype=np.float64)
        self.entry = int(((self.points - centre) ** 2).sum(axis=1).argmin())
        order = np.random.default_rng(5).permutation(n)
        order = np.concatenate(([self.entry], order[order != self.entry]))
        at, size = 1, 1
        while at < n:
            batch = order[at : at + size]
            beams, steps = self.search(self.points[batch], BUILD_BEAM)
            seen = np.concatenate((np.stack(steps, axis=1), beams), axis=1)
            back: dict[int, list[int]] = {}
            for p, proposed in zip(batch.tolist(), seen, strict=True):
                kept = self.prune(p, proposed)
                self._link(p, kept)
                for q in kept.tolist():
                    back.setdefault(q, []).append(p)
            for q, more in back.items():
                have = self.edges[q][self.edges[q] >= 0]
                both = np.concatenate((have, np.array([m for m in more if m not in have], dtype=np.int32)))
                self._link(q, both if len(both) <= DEGREE else self.prune(q, both))
            at, size = at + len(batch), min(2 * size, BATCH)
        return self


def usable(vector: Column) -> Column:
    """No null, zero or empty vector, nor one with a null or non-finite component."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def build_index(vectors: DataFrame, k: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row a shard of (vec_id, v array<double>): its points, their ids, and the graph. Written, hence reusable."""
    some = lambda x: F.slice(F.array_sort(x), 1, k + 1)  # noqa: E731  all ids that a result can hold, and the query's own
    salted = vectors.groupBy("v", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).alias("salt")).agg(some(F.collect_set("vec_id")).alias("ids"))
    points = materialize(salted.groupBy("v").agg(some(F.flatten(F.collect_list("ids"))).alias("ids")), "points")
    shards = max(1, math.ceil(points.count() / shard_rows))
    # vectors of very different magnitudes would lose each other's distances in one graph
    level = F.floor((F.log2(F.array_max(F.transform("v", F.abs))) + 10) / 20) + 64
    points = points.withColumn("dim", F.size("v").cast("long")).withColumn("shard", F.col("dim") * (1 << 32) + level * (1 << 20) + F.pmod(F.xxhash64("v"), F.lit(shards)))

    def build(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        dim = table["dim"][0].as_py()
        x = np.concatenate([np.asarray(c.flatten()) for c in table["v"].chunks]).reshape(-1, dim)
        g = Graph(x).build()
        return pa.table({"shard": table["shard"].slice(0, 1), "dim": table["dim"].slice(0, 1), "points": [x.astype("<f8").tobytes()], "edges": [g.edges.astype("<i4").tobytes()], "entry": [g.entry], "ids": [table["ids"].to_pylist()]}, schema=pa.schema({"shard": pa.int64(), "dim": pa.int64(), "points": pa.binary(), "edges": pa.binary(), "entry": pa.int64(), "ids": pa.list_(pa.list_(pa.int64()))}))

    schema = "shard long, dim long, points binary, edges binary, entry long, ids array<array<long>>"
    return materialize(points.groupBy("shard").applyInArrow(build, schema), "index")


def search(index: DataFrame, queries: DataFrame, k: int, beam: int = SEARCH_BEAM) -> DataFrame:
    """The k nearest rows of each of queries (vec_id, v): query_id, rank, vec_id, score.

    Queries go to every shard of their dimension in blocks. A shard moves once for each ``COPY_BLOCKS`` blocks, not for each: it goes first in a sorted
    stream, its blocks after it, and a task holds one graph and one block.
    """
    n = max(1, math.ceil(queries.count() / QUERY_BLOCK))
    copies = math.ceil(n / COPY_BLOCKS)
    of_dim = index.groupBy("dim").agg(F.collect_list("shard").alias("shards"))
    asked = queries.groupBy(F.size("v").cast("long").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(n)).alias("block")).agg(F.collect_list("vec_id").alias("query_ids"), F.collect_list("v").alias("vs"))
    asked = asked.join(of_dim, "dim").select(F.explode("shards").alias("shard"), (F.col("block") % copies).alias("copy"), "block", "query_ids", "vs")
    graphs = index.withColumns({"copy": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))), "block": F.lit(-1).cast("long")})
    both = graphs.unionByName(asked, allowMissingColumns=True).repartition("shard", "copy").sortWithinPartitions("shard", "copy", "block")
    both = both.select("block", "dim", "points", "edges", "entry", "ids", "query_ids", "vs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = g = ids = None
        for batch in batches:
            for row in range(batch.num_rows):
                at = lambda c: batch.column(c)[row].as_py()  # noqa: B023, E731
                if at(0) < 0:
                    x = np.frombuffer(at(2), "<f8").reshape(-1, at(1))
                    g, ids = Graph(x, np.frombuffer(at(3), "<i4").reshape(-1, DEGREE), at(4)), at(5)
                    continue
                q = np.array(at(7), dtype=np.float64)
                beams, _ = g.search(g.placed(q), beam)
                out: list[tuple] = []
                for one, v, found in zip(at(6), q, beams, strict=True):
                    found = found[found >= 0]
                    d = np.sqrt(((x[found] - v) ** 2).sum(axis=1))
                    best = sorted((s, i) for s, p in zip(d.tolist(), found.tolist(), strict=True) for i in ids[p] if i != one)[:k]
                    out += [(one, i, s) for s, i in best]
                if out:
                    a, b, c = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], ["query_id", "vec_id", "score"])

    found = both.mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def neighbours(table: DataFrame, modulus: int, k: int, key: str = "vec_id", vector: str = "embedding", beam: int = SEARCH_BEAM, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Rows whose id the modulus divides, each with its k nearest other rows (fewer if there are no more).

    Rows with a null id or an unusable vector take no part; vectors of other lengths never meet. Components may have any
    finite magnitude, as far as squares of double precision go.
    Rows alike in id and vector count once; of an id's several vectors the least one asks. Ties
    go to the smaller id. No usable row gives no result.
    """
    v = table.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    queries = v.filter(F.col("vec_id") % modulus == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    return search(build_index(v, k, shard_rows), queries, k, beam)
