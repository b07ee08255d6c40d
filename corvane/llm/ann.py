"""Approximate nearest neighbours by robust-pruned directed graphs, one per shard.

Vectors are dealt into shards of about SHARD rows by a hash of their id. Each shard gets a
graph: points search it greedily for neighbours, and of what they find and of the edges that
come back those are kept that no kept nearer edge covers within a factor ALPHA. Queries run a
beam search through every shard's graph, in blocks read from the shared folder; distances of
what the beams hold are taken anew in double precision from the original vectors. A graph
holds its shard's vectors moved to their mean and scaled to one, so single precision serves any
range; a query that lies too far out for it is compared with its whole shard in double precision.
Every shard's graph meets all queries: with queries a fixed share of rows, work is rows squared
over SHARD, and a fixed query set makes it linear.

Equal vectors of a shard are one point, which carries its smallest ids, so ties are exact.
Points and queries advance in lockstep through NumPy arrays.

No part: null or empty vectors, all-zero ones, and ones with null or non-finite components.
Vectors of another length than the query's are no candidates. Rows that repeat an id count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm import shared

SHARD = 8192
DEGREE, BEAM, SEARCH_BEAM = 28, 56, 128
ALPHA = 1.2
WIDTH = 4  # points a beam expands at a time
FAR = 1e3  # times a shard's spread, beyond which single precision no longer tells its points apart
BATCH = 256
RESULT = "query_id long, vec_id long, score double"


class Graph:
    """A directed graph over distinct points."""

    def __init__(self, points: np.ndarray, seed: int = 7):
        self.points = np.ascontiguousarray(points, np.float32)
        n = len(points)
        self.norms = np.einsum("ij,ij->i", self.points, self.points)
        self.start = int(((self.points - self.points.mean(0)) ** 2).sum(1).argmin()) if n else 0
        rng = np.random.default_rng(seed)
        self.edges = np.full((n, DEGREE), -1, np.int64)
        if n > 1:
            some = min(DEGREE // 2, n - 1)
            self.edges[:, :some] = (np.arange(n)[:, None] + 1 + rng.integers(0, n - 1, (n, some))) % n
            for alpha in (1.0, ALPHA):
                order = rng.permutation(n)
                for at in range(0, n, BATCH):
                    self._insert(order[at : at + BATCH], alpha)

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest points that a beam search finds, (queries, beam), with squared distances; -1 and inf where fewer."""
        q, n, width = len(queries), len(self.points), beam
        queries = queries.astype(np.float32)
        near = np.full((q, width), -1, np.int64)
        dist = np.full((q, width), np.inf, np.float32)
        done = np.ones((q, width), bool)
        seen = np.zeros((q, n), bool)
        near[:, 0], done[:, 0], seen[:, self.start] = self.start, False, True
        dist[:, 0] = ((queries - self.points[self.start]) ** 2).sum(1)
        live = np.arange(q)
        while len(live):
            open_dist = np.where(done[live], np.inf, dist[live])
            pick = np.argpartition(open_dist, min(WIDTH, width - 1), axis=1)[:, :WIDTH]
            usable = np.isfinite(np.take_along_axis(open_dist, pick, 1))
            going = usable.any(1)
            live, pick, usable = live[going], pick[going], usable[going]
            if not len(live):
                break
            rows = live[:, None]
            done[rows, pick] = True
            chosen = np.where(usable, near[rows, pick], -1)
            new = np.where(chosen[:, :, None] >= 0, self.edges[chosen], -1).reshape(len(live), -1)
            fresh = (new >= 0) & ~seen[rows, new]
            new.sort(axis=1)
            fresh = (new >= 0) & ~seen[rows, new]
            fresh[:, 1:] &= new[:, 1:] != new[:, :-1]
            r, c = np.nonzero(fresh)
            seen[live[r], new[r, c]] = True
            d = np.full(new.shape, np.inf, np.float32)
            gap = self.points[new[r, c]] - queries[live[r]]
            d[r, c] = np.einsum("ij,ij->i", gap, gap)
            all_near = np.concatenate([near[live], new], 1)
            all_dist = np.concatenate([dist[live], d], 1)
            all_done = np.concatenate([done[live], np.zeros(new.shape, bool)], 1)
            top = np.argpartition(all_dist, width - 1, axis=1)[:, :width]
            near[live], dist[live] = np.take_along_axis(all_near, top, 1), np.take_along_axis(all_dist, top, 1)
            done[live] = np.take_along_axis(all_done, top, 1) | ~np.isfinite(dist[live])
        return np.where(np.isfinite(dist), near, -1), dist

    def _prune(self, owners: np.ndarray, found: np.ndarray, alpha: float) -> np.ndarray:
        """Kept edges (owners, DEGREE) of candidates (owners, any number), -1 for none."""
        found = np.where(found == owners[:, None], -1, found)
        found = np.sort(found, axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        p = self.points[found]
        gap = p - self.points[owners][:, None]
        dist = np.where(found >= 0, np.einsum("ijk,ijk->ij", gap, gap), np.inf)
        order = np.argsort(dist, axis=1, kind="stable")
        found, dist = np.take_along_axis(found, order, 1), np.take_along_axis(dist, order, 1)
        p = self.points[found]
        norm = self.norms[found]
        between = norm[:, :, None] + norm[:, None, :] - 2 * np.matmul(p, p.transpose(0, 2, 1))
        out = np.full((len(owners), DEGREE), -1, np.int64)
        alive = np.isfinite(dist)
        each = np.arange(len(owners))
        for k in range(DEGREE):
            best = alive.argmax(1)
            some = alive[each, best]
            if not some.any():
                break
            out[some, k] = found[each, best][some]
            alive &= ~(some[:, None] & (alpha * alpha * between[each, best] <= dist))
            alive[each, best] = False
        return out

    def _insert(self, points: np.ndarray, alpha: float) -> None:
        near, _ = self.search(self.points[points], BEAM)
        self.edges[points] = self._prune(points, np.concatenate([near, self.edges[points]], 1), alpha)
        to = self.edges[points]
        source, target = np.repeat(points, DEGREE)[to.ravel() >= 0], to.ravel()[to.ravel() >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        owners, first, count = np.unique(target, return_index=True, return_counts=True)
        for turn in range(0, int(count.max(initial=0)), DEGREE):  # a target of many back edges takes all, a degree's worth a turn
            more = count > turn
            self._add(owners[more], first[more] + turn, np.minimum(count[more] - turn, DEGREE), source, alpha)

    def _add(self, owners: np.ndarray, first: np.ndarray, count: np.ndarray, source: np.ndarray, alpha: float) -> None:
        """Gives owners the edges source[first : first + count], DEGREE at most, pruned where there isn't room for all."""
        wide = int(count.max(initial=0))
        for at in range(0, len(owners), BATCH):
            own, f, c = owners[at : at + BATCH], first[at : at + BATCH], count[at : at + BATCH]
            place = f[:, None] + np.arange(wide)
            back = np.where(np.arange(wide) < c[:, None], source[np.minimum(place, len(source) - 1)], -1)
            old = self.edges[own]
            room = (old >= 0).sum(1) + c <= DEGREE
            both = np.concatenate([old, back], 1)
            kept = np.empty_like(old)
            if room.any():
                b = np.sort(both[room], axis=1)
                b[:, 1:][b[:, 1:] == b[:, :-1]] = -1
                full = np.full((len(b), max(DEGREE, b.shape[1])), -1, np.int64)
                full[:, : b.shape[1]] = b
                kept[room] = -np.sort(-full, axis=1)[:, :DEGREE]
            if (~room).any():
                kept[~room] = self._prune(own[~room], both[~room], alpha)
            self.edges[own] = kept


class Frame:
    """Moves vectors to the mean of a shard's points and scales them to its spread."""

    def __init__(self, points: np.ndarray):
        self.size = np.abs(points).max(initial=0.0) or 1.0
        self.mean = (points / self.size).mean(0)
        self.spread = np.abs(points / self.size - self.mean).max(initial=0.0) or 1.0

    def __call__(self, vectors: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (vectors / self.size - self.mean) / self.spread


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", shard: int = SHARD, beam: int = SEARCH_BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each query, itself left out; score is the Euclidean distance."""
    spark = rows.sparkSession
    typed = lambda x: x.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v"))).withColumn("d", F.size("v"))
    points = typed(rows)
    # queries in a settled table, which tasks read in blocks
    folder = shared.new_folder(spark, "queries")
    typed(queries).groupBy("id").agg(F.min(F.struct("d", "v")).alias("x")).select("id", "x.d", "x.v").write.parquet(folder)
    shards = max(1, -(-points.count() // shard))
    dealt = points.withColumn("s", F.pmod(F.xxhash64("id"), F.lit(shards)))
    # a partition a shard: hashing the shard's number again would put several in one task
    dealt = dealt.repartitionById(shards, F.col("s").cast("int")).sortWithinPartitions("d", "s", "id")

    def blocks(length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        files, path = shared.file_system(folder)
        from pyarrow import fs

        for info in sorted(files.get_file_info(fs.FileSelector(path)), key=lambda i: i.path):
            if info.base_name.startswith("part-"):
                with files.open_input_file(info.path) as f:
                    for batch in pq.ParquetFile(f).iter_batches(BATCH):
                        batch = batch.filter(pc.equal(batch.column("d"), length))
                        if batch.num_rows:
                            yield batch.column("id").to_numpy(), _matrix(batch.column("v"))

    def solve(ids: np.ndarray, vectors: np.ndarray) -> Iterator[pa.RecordBatch]:
        keep = np.concatenate(([True], ids[1:] != ids[:-1]))
        ids, vectors = ids[keep], vectors[keep]
        raw = np.ascontiguousarray(vectors + 0.0).view(np.dtype((np.void, vectors.shape[1] * 8))).ravel()
        _, first, which = np.unique(raw, return_index=True, return_inverse=True)
        order = np.argsort(which, kind="stable")  # ids ascend already
        begin = np.searchsorted(which[order], np.arange(len(first) + 1))
        points = vectors[first]
        frame = Frame(points)
        graph = Graph(frame(points))
        for query, q in blocks(vectors.shape[1]):
            moved = frame(q)
            far = ~(np.abs(moved).max(1) <= FAR)
            near, _ = graph.search(np.where(far[:, None], 0.0, moved), max(beam, k + 1))
            out: list[list] = [[], [], []]
            for i in range(len(query)):
                found = np.arange(len(points)) if far[i] else near[i][near[i] >= 0]
                score = np.sqrt(((points[found] - q[i]) ** 2).sum(1))
                # k + 1 ids of each point suffice: one may be the query's own
                own = [order[begin[p] : min(begin[p + 1], begin[p] + k + 1)] for p in found]
                size = [len(o) for o in own]
                vec, dist = ids[np.concatenate(own)], np.repeat(score, size)
                best = np.lexsort((vec, dist))
                best = best[vec[best] != query[i]][:k]
                out[0].extend([query[i]] * len(best))
                out[1].extend(vec[best])
                out[2].extend(dist[best])
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "score"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, at = [], [], None
        for batch in batches:
            marks = batch.column(2).to_numpy().astype(np.int64) * (1 << 32) + batch.column(3).to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(marks[1:] != marks[:-1]) + 1, [len(marks)])) if len(marks) else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if at is not None and at != marks[a]:
                    yield from solve(np.concatenate(ids), np.concatenate(vectors))
                    ids, vectors = [], []
                at = marks[a]
                ids.append(batch.column(0).slice(a, b - a).to_numpy())
                vectors.append(_matrix(batch.column(1).slice(a, b - a)))
        if ids:
            yield from solve(np.concatenate(ids), np.concatenate(vectors))

    found = dealt.select("id", "v", "d", F.col("s").cast("long").alias("s")).mapInArrow(search, RESULT)
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
