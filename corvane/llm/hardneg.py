"""Hard negatives by a distributed kNN join over Voronoi cells.

Vectors become whole numbers and scores are their inner products. A further component, sqrt(longest² - |x|²), gives all
candidates one length, so that the greatest inner product is the least distance. Pivots, fitted on at most SAMPLE vectors,
make cells; candidates and anchors know the nearest pivot and their distances. Bounds on cells then say which anchor groups a
candidate might serve, and it is replicated to these only:

- for positives, per label: an anchor cell's radius, and the k-th least of what cells' nearest members of that label can
  be away at most (of each cell and label, the k + 1 nearest to the pivot are known);
- for negatives: the ring between the nearest and farthest distances that the scores allowed by an anchor's positives mean.

Groups meet candidates in chunks of a bounded number of rows, so a label, cell or vector that holds a third of all rows is
many tasks'. In a chunk the join is exact: block products, whole numbers in double precision where these hold them all, else in
integers of any length (scores beyond a long are held at its ends, and components at a long's). Bounds only spare work, and
in many dimensions they spare little; anchors are a stated share of rows, so work is anchors times candidates then.

No part: null ids, labels, vectors, and vectors with null or non-finite components. Of rows that repeat an id the least label,
then vector, counts. Vectors of another length than the anchor's are no candidates for it. Without anchors the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm import shared

SAMPLE, PIVOTS, GROUPS = 4096, 32, 4
ANCHORS = 2048  # of a group and salt, about
CHUNK, CHUNKS = 16384, 16  # candidates of a chunk at most, about, and the least number of chunks
BLOCK = 256  # anchors multiplied at a time
_LEAST, _MOST = -(2**63) + 1, 2**63 - 1
_NONE = -(2**63)


def usable(vector: Column) -> Column:
    return F.coalesce(vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors as a matrix of integers) for each length of vectors."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, flat[(ends[rows] - size)[:, None] + np.arange(size)]


def fit_pivots(vectors: list[list[int]], longest: float, number: int = PIVOTS, rounds: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(pivots, their further component): centres of a sample, spread by farthest first, then moved to means."""
    width = max((len(v) for v in vectors), default=0)
    if not vectors:
        return np.zeros((1, width)), np.zeros(1)
    points = np.zeros((len(vectors), width + 1))
    for k, v in enumerate(vectors):
        points[k, : len(v)] = v
    points[:, width] = np.sqrt(np.maximum(longest - (points**2).sum(1), 0))
    gap = lambda p: ((points - p) ** 2).sum(1)
    chosen = [0]
    far = gap(points[0])
    while len(chosen) < min(number, len(points)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, gap(points[chosen[-1]]))
    pivots = points[chosen]
    for _ in range(rounds):
        near = np.stack([gap(p) for p in pivots], 1).argmin(1)
        pivots = np.stack([points[near == k].mean(0) if (near == k).any() else pivots[k] for k in range(len(pivots))])
    return pivots[:, :width], pivots[:, width]


def distances(vectors: np.ndarray, tail: np.ndarray | float, pivots: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """Distances of vectors with a further component to pivots; what one has beyond the other's length meets zeros."""
    v = vectors.astype(np.float64)
    n = min(v.shape[1], pivots.shape[1])
    tail = np.broadcast_to(tail, len(v))
    squares = (v**2).sum(1) + tail**2
    return np.sqrt(np.maximum(squares[:, None] + (pivots**2).sum(1) + tails**2 - 2 * (v[:, :n] @ pivots[:, :n].T + np.outer(tail, tails)), 0))


def products(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors, held within a long."""
    biggest = [max(abs(int(m.min(initial=0))), int(m.max(initial=0))) for m in (anchors, candidates)]
    if biggest[0] * biggest[1] * anchors.shape[1] < 2**53:
        return (anchors.astype(np.float64) @ candidates.T.astype(np.float64)).astype(np.int64)
    exact = anchors.astype(object) @ candidates.T.astype(object) if anchors.shape[1] else np.zeros((len(anchors), len(candidates)), object)
    return np.clip(exact, _LEAST, _MOST).astype(np.int64)


def best(scores: np.ndarray, allowed: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, columns) of the greatest allowed scores of each row, k turns; of equal ones the first column."""
    left = np.where(allowed, scores, _NONE)
    rows = np.arange(len(left))
    for _ in range(k if left.shape[1] else 0):
        at = left.argmax(1)
        some = left[rows, at] != _NONE
        if not some.any():
            return
        yield rows[some], at[some]
        left[rows[some], at[some]] = _NONE


def _blocks(anchors: pa.Table, candidates: pa.Table) -> Iterator[tuple[np.ndarray, pa.Table, pa.Table]]:
    """(products, anchors, candidates) of all pairs of equal lengths, a block of anchors at a time; candidates by id."""
    candidates = candidates.sort_by("id")
    theirs = {m.shape[1]: (rows, m) for rows, m in by_length(candidates.column("v"))}
    for rows, matrix in by_length(anchors.column("v")):
        if matrix.shape[1] in theirs:
            other, vectors = theirs[matrix.shape[1]]
            met = candidates.take(other)
            for at in range(0, len(rows), BLOCK):
                yield products(matrix[at : at + BLOCK], vectors), anchors.take(rows[at : at + BLOCK]), met


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


class _Cells:
    """Pivots over the candidates' vectors, and who might serve whom."""

    def __init__(self, points: DataFrame, sample: int, pivots: int, groups: int):
        facts = points.agg(F.max("squares").alias("longest")).first()
        self.longest = float(facts.longest or 0.0)
        some = [list(r.v) for r in points.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(sample).collect()]
        self.pivots, self.tails = fit_pivots(some, self.longest, pivots)
        n = len(self.pivots)
        full = np.concatenate([self.pivots, self.tails[:, None]], 1)
        self.apart = np.sqrt(((full[:, None] - full[None]) ** 2).sum(2))
        # cells join the group of the nearest of the first few pivots
        self.group = [int(g) for g in self.apart[:, : min(groups, n)].argmin(1)]
        self.margin = 1e-5 * float(np.sqrt(self.longest)) + 1e-6

    def place(self, points: DataFrame, anchors: bool) -> DataFrame:
        """points with cell and gaps: distances to all pivots. An anchor's further component is zero."""
        pivots, tails, longest = self.pivots, self.tails, self.longest

        @shared.lean
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                gaps = np.zeros((batch.num_rows, len(pivots)), np.float32)
                for rows, vectors in by_length(batch.column("v")):
                    tail = 0.0 if anchors else np.sqrt(np.maximum(longest - (vectors.astype(np.float64) ** 2).sum(1), 0))
                    gaps[rows] = distances(vectors, tail, pivots, tails)
                cell = pa.array(gaps.argmin(1) if len(gaps) else [], pa.int32())
                yield pa.RecordBatch.from_arrays([*batch.columns, cell, pa.array(list(gaps), pa.list_(pa.float32()))], [*batch.schema.names, "cell", "gaps"])

        return points.mapInArrow(run, "id long, label long, v array<long>, squares double, cell int, gaps array<float>")


def _served(cells: _Cells, reach: Column) -> Column:
    """Groups of those (cell, reach) that hold a candidate."""
    group = F.array(*map(F.lit, cells.group))
    return F.array_distinct(F.transform(F.filter(reach, lambda b: F.get(F.col("gaps"), b.cell) <= b.reach), lambda b: F.get(group, b.cell)))


def mine(
    rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, key: str = "vec_id", label: str = "label", vector: str = "embedding", scale: int = 256, sample: int = SAMPLE, pivots: int = PIVOTS, groups: int = GROUPS, chunk: int = CHUNK, chunks: int = CHUNKS
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor (rows where anchor holds) and each of its positives, the best of other labels whose score is from low to high per cent of the positive's."""
    spark = rows.sparkSession
    whole = F.transform(F.col(vector).cast("array<double>"), lambda x: F.floor(x * scale))
    x = rows.where(usable(F.col(vector).cast("array<double>"))).select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), whole.alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    x = x.where("id is not null and label is not null").groupBy("id").agg(F.min(F.struct("label", "v", "anchor")).alias("x")).select("id", "x.*")
    squares = F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double"))
    points = shared.settle(x.withColumn("squares", squares), "vectors")
    cells = _Cells(points, sample, pivots, groups)
    plain = points.select("id", "label", "v", "squares")
    placed = shared.settle(cells.place(plain, False), "candidates")
    asked = shared.settle(cells.place(points.where("anchor").select(*plain.columns), True), "anchors")
    asked = asked.withColumn("gap", F.get("gaps", F.col("cell"))).drop("gaps")
    shares = max(chunks, -(-placed.count() // chunk))
    salts = max(1, -(-asked.count() // (ANCHORS * len(set(cells.group)))))
    group_of = F.get(F.array(*map(F.lit, cells.group)), F.col("cell"))

    def meet(candidates: DataFrame, anchors: DataFrame, join, shape: str) -> DataFrame:
        # a candidate goes to its groups' every salt, an anchor to its group's every chunk
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = candidates.select("id", "label", "v", "group", F.pmod(F.xxhash64("id"), F.lit(shares)).cast("int").alias("part"), every(salts).alias("salt"))
        right = anchors.withColumn("group", group_of).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")).withColumn("part", every(shares))
        return left.groupBy("group", "salt", "part").cogroup(right.groupBy("group", "salt", "part")).applyInArrow(join, shape)

    # positives: what an anchor cell's members of a label reach at most
    # (lengths are apart, for vectors of another length are nobody's)
    size = F.size("v").alias("size")
    near = placed.select("label", size, "cell", F.get("gaps", F.col("cell")).alias("gap"))
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("label", "size", "cell").orderBy("gap"))).where(F.col("r") <= positives + 1)
    apart = spark.createDataFrame([(i, j, float(cells.apart[i, j])) for i in range(len(cells.group)) for j in range(len(cells.group))], "cell int, other int, apart double")
    radius = asked.groupBy("label", size, "cell").agg(F.max("gap").cast("double").alias("radius"))
    away = radius.join(F.broadcast(apart), "cell").join(near.select("label", "size", F.col("cell").alias("other"), "gap"), ["label", "size", "other"])
    away = away.withColumn("most", F.col("radius") + F.col("apart") + F.col("gap")).withColumn("r", F.row_number().over(Window.partitionBy("label", "size", "cell").orderBy("most"))).where(F.col("r") == positives + 1)
    reach = radius.join(away.select("label", "size", "cell", "most"), ["label", "size", "cell"], "left").withColumn("reach", F.coalesce(F.col("radius") + F.col("most") + cells.margin, F.lit(float("inf"))))
    # a row a label; Spark broadcasts the table if its files are small enough, else it joins by label
    served = shared.settle(reach.groupBy("label", "size").agg(F.collect_list(F.struct("cell", "reach")).alias("reach")), "reach")
    sent = placed.withColumn("size", size).join(served, ["label", "size"]).select("id", "label", "v", F.explode(_served(cells, F.col("reach"))).alias("group"))

    def positive_pairs(_, candidates: pa.Table, anchors: pa.Table) -> pa.Table:
        out = [np.zeros((0, 3), np.int64)]
        for scores, a, c in _blocks(anchors, candidates):
            own, ids = _numbers(a, "id"), _numbers(c, "id")
            allowed = (_numbers(a, "label")[:, None] == _numbers(c, "label")) & (own[:, None] != ids)
            out += [np.stack([own[r], ids[k], scores[r, k]], 1) for r, k in best(scores, allowed, positives)]
        found = np.concatenate(out)
        return pa.table({n: found[:, k] for k, n in enumerate(("id", "positive_id", "positive_score"))})

    found = meet(sent, asked.select("id", "label", "v", "cell"), positive_pairs, "id long, positive_id long, positive_score long")
    first = Window.partitionBy("id").orderBy(F.col("positive_score").desc(), "positive_id")
    found = found.withColumn("r", F.row_number().over(first)).where(F.col("r") <= positives)
    with_positives = found.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("r", "positive_id", "positive_score"))).alias("p"))
    asked = shared.settle(asked.join(with_positives.select("id", F.col("p.positive_id").alias("pids"), F.col("p.positive_score").alias("pscores")), "id"), "positives")

    # negatives: the ring around an anchor that its positives' scores allow
    top, least = F.array_max("pscores").cast("double"), F.array_min(F.filter("pscores", lambda s: s >= 0)).cast("double")
    away_of = lambda score: F.sqrt(F.greatest(F.col("squares") + cells.longest - 2 * score, F.lit(0.0)))
    rings = asked.where(top >= 0).groupBy("cell").agg(F.max("gap").alias("radius"), F.min(away_of(top * high / 100)).alias("inner"), F.max(away_of(least * low / 100)).alias("outer")).collect()  # a row a cell
    can = [
        F.when((F.get("gaps", F.lit(r.cell)) + r.radius + cells.margin >= r.inner) & (F.get("gaps", F.lit(r.cell)) - r.radius - cells.margin <= r.outer), F.lit(cells.group[r.cell]))
        for r in rings
    ]
    groups_of = F.array_distinct(F.filter(F.array(*can), lambda g: g.isNotNull())) if can else F.array().cast("array<int>")
    sent = placed.select("id", "label", "v", F.explode(groups_of).alias("group"))

    def negative_pairs(_, candidates: pa.Table, anchors: pa.Table) -> pa.Table:
        out = [np.zeros((0, 4), np.int64)]
        for scores, a, c in _blocks(anchors, candidates):
            own, ids = _numbers(a, "id"), _numbers(c, "id")
            other = _numbers(a, "label")[:, None] != _numbers(c, "label")
            pids, pscores = a.column("pids").to_pylist(), a.column("pscores").to_pylist()
            for turn in range(positives):
                has = np.array([k for k, p in enumerate(pids) if len(p) > turn and pscores[k][turn] >= 0], np.int64)
                if not len(has):
                    continue
                p = [pscores[k][turn] for k in has]
                # bounds in whole numbers: 50 * positive <= 100 * negative <= 95 * positive
                lo, hi = np.array([-(-low * s // 100) for s in p]), np.array([min(high * s // 100, _MOST) for s in p])
                some = scores[has]
                allowed = other[has] & (some >= lo[:, None]) & (some <= hi[:, None])
                pid = np.array([pids[k][turn] for k in has])
                out += [np.stack([own[has[r]], pid[r], ids[k], some[r, k]], 1) for r, k in best(some, allowed, negatives)]
        found = np.concatenate(out)
        return pa.table({n: found[:, k] for k, n in enumerate(("anchor_id", "positive_id", "negative_id", "negative_score"))})

    met = meet(sent, asked.where(top >= 0).select("id", "label", "v", "cell", "pids", "pscores"), negative_pairs, "anchor_id long, positive_id long, negative_id long, negative_score long")
    first = Window.partitionBy("anchor_id", "positive_id").orderBy(F.col("negative_score").desc(), "negative_id")
    met = met.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= negatives)
    scores = asked.select(F.col("id").alias("anchor_id"), F.explode(F.arrays_zip("pids", "pscores")).alias("p")).select("anchor_id", F.col("p.pids").alias("positive_id"), F.col("p.pscores").alias("positive_score"))
    return met.join(scores, ["anchor_id", "positive_id"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
