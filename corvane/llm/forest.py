"""Near-duplicate groups by an LSH forest over MinHash signatures.

1. Texts of equal shingle sets are one class, known by its smallest id; only classes go on.
2. Each class enters several trees. A tree orders the classes by its own run of signature
   values; classes that share a prefix of DEPTH values are a region. A region of more than
   CAP classes is crowded: there each class meets its two neighbours in the sorted order of
   up to ORDERED values, which are those of the longest common prefix, so the depth at which
   classes meet adapts to how crowded their part of the region is. That is linear in a
   region's size, but doesn't find all of its links.
3. Within a region, neighbours are candidates if their signatures agree enough: for each
   class its best neighbour and the region's most linked class.
4. Candidates are confirmed on full shingle sets and joined to components. Then all other
   candidates across components are confirmed too, so that no link between components is
   left out, and components are taken again. Regions dense with such candidates are confirmed
   as a whole, without making a row for each pair.
5. Classes of crowded regions also meet in that second round by an exact prefix filter: two
   sets that are linked share one of the first n - ceil(0.75 n) + 1 shingles of each, in any
   order common to all sets (here from rare to common). Those that share one and belong to
   different components are compared, in cells of about 2 * CAP classes; where more share it,
   every block of them meets every other in a cell of its own.

Links have 100 * intersection >= 75 * union (by default). With 24 trees of depth 3, a pair at
0.75 meets in no tree with probability 2e-6, and one that met only in crowded regions meets
again in a cell; a met pair is passed over if its estimate over 128 values falls short of
0.58, more than 4 standard deviations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm import shared, textscan
from corvane.llm.components import components
from corvane.llm.shared import clear, mark, settle

VALUES = 128
TREES, DEPTH = 24, 3
#: Values of a sorted order in crowded regions.
ORDERED = 32
CAP = 2048
#: Ids of 8 bytes that may be sent to all tasks: 32 MB.
BROADCAST_IDS = 4_000_000
#: Pairs per class up to which a region's pairs are confirmed one by one.
DENSE = 4
#: Rows of regions solved at once; a region is never cut.
HELD = 4096
#: Rows of one text from which its class is sent to all tasks, unless there are too many such texts.
HOT, HOT_TEXTS = 1000, 1_000_000
#: Bits of the hash of a shingle that name its counter in the order of the prefix filter.
COUNTERS = 20
_rng = np.random.default_rng(20250701)
_XOR = _rng.integers(1, 1 << 32, VALUES, dtype=np.uint64).astype(np.uint32)
_ODD = (_rng.integers(1, 1 << 31, VALUES, dtype=np.uint64) * 2 + 1).astype(np.uint32)


def _signatures(sets: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """MinHash values of the non-empty rows, as 32-bit integers."""
    x = textscan.mix64(sets)
    x = (x >> np.uint64(32)).astype(np.uint32)
    starts = edges[:-1][edges[1:] > edges[:-1]]
    out = np.empty((len(starts), VALUES), np.uint32)
    for j in range(VALUES):
        y = (x ^ _XOR[j]) * _ODD[j]
        y ^= y >> np.uint32(15)
        out[:, j] = np.minimum.reduceat(y, starts)
    return out


def _digests(sets: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Two 64-bit sums of each row's set."""
    out = np.empty((len(edges) - 1, 2), np.uint64)
    for k in range(2):
        total = np.zeros(len(sets) + 1, np.uint64)
        np.cumsum(textscan.mix64(sets + np.uint64((0x9E3779B97F4A7C15, 0x3C6EF372FE94F82A)[k])), out=total[1:])
        out[:, k] = total[edges[1:]] - total[edges[:-1]]
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    """Each row of a matrix of bytes as a binary value."""
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def fingerprints(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(id, n, d0, d1, values): set size, digest and signature; values is null for an empty set."""

    @shared.lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, offsets in textscan.slices(batch.column(1)):
                start, stop, bounds = textscan.words(data, offsets, textscan.SPACES)
                sets, edges = textscan.shingle_sets(textscan.word_hashes(data, start, stop), bounds, width)
                n, digests = np.diff(edges), _digests(sets, edges).view(np.int64)
                full = n > 0
                sig = np.zeros((end - at, VALUES), np.uint32)
                if full.any():
                    sig[full] = _signatures(sets, edges)
                values = _binary((sig & 0xFFFF).astype("<u2").view(np.uint8).reshape(end - at, VALUES * 2))  # 16 bits of each value
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), pa.array(n, pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]), values], ["id", "n", "d0", "d1", "values"])

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(scan, "id long, n long, d0 long, d1 long, values binary")


def _prefixes(classes: DataFrame) -> DataFrame:
    """(tree, id, region): the hash of each tree's prefix."""

    @shared.lean
    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(n, VALUES).astype(np.uint64)
            prefix = np.empty((TREES, n), np.uint64)
            for tree in range(TREES):
                h = np.full(n, np.uint64(tree + 1))
                for k in range(DEPTH):
                    h = textscan.mix64(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, tree * DEPTH + k])
                prefix[tree] = h
            trees = pa.array(np.repeat(np.arange(TREES, dtype=np.int32), n))
            yield pa.RecordBatch.from_arrays([trees, pa.array(np.tile(batch.column(0).to_numpy(), TREES)), pa.array(prefix.reshape(-1).view(np.int64))], ["tree", "id", "region"])

    return classes.select("id", "values").mapInArrow(grow, "tree int, id long, region long")


def regions(classes: DataFrame, cap: int = CAP) -> tuple[DataFrame, DataFrame | None]:
    """(region, id): classes that share a prefix, 2 to cap in each region; and (tree, id) of those in larger regions, if any."""
    rows = _prefixes(classes)
    sizes = rows.groupBy("region").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    rows = settle(rows.join(sizes, "region"), "forest")
    crowded = rows.where(F.col("size") > cap).select("tree", "id")
    return rows.where(F.col("size") <= cap).select("region", "id"), None if crowded.isEmpty() else crowded


def order_neighbours(crowded: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b, agree, lead_a, lead_b): classes of (tree, id) next to each other in a tree's sorted order, with DEPTH values or more in common.

    The orders are range-partitioned; the first and last class of each partition meet those of
    the partitions beside it in a second step of two rows a partition.
    """
    run = F.substring(F.concat("values", "values"), F.col("tree") * (2 * DEPTH) + 1, F.lit(2 * ORDERED))
    rows = crowded.join(classes.select("id", "values"), "id").select("tree", run.alias("run"), "id")
    shape = "a long, b long, agree int, tree int, run binary, id long"

    @shared.lean
    def walk(batches: Iterator[pa.RecordBatch], borders: bool) -> Iterator[pa.RecordBatch]:
        before = first = last = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            tree, ids = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            run = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(n, ORDERED)
            if first is None:
                first = (int(tree[0]), run[0].tobytes(), int(ids[0]))
            if before is not None:
                tree, run, ids = (np.concatenate(x) for x in zip(before, (tree, run, ids), strict=True))
            before = (tree[-1:], run[-1:], ids[-1:])
            last = (int(tree[-1]), run[-1].tobytes(), int(ids[-1]))
            common = np.logical_and.accumulate(run[1:] == run[:-1], axis=1).sum(1)
            x = np.flatnonzero((common >= DEPTH) & (tree[1:] == tree[:-1]) & (ids[1:] != ids[:-1]))
            none = pa.nulls(len(x), pa.int32()), pa.nulls(len(x), pa.binary()), pa.nulls(len(x), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[x], ids[x + 1])), pa.array(np.maximum(ids[x], ids[x + 1])), pa.array(common[x].astype(np.int32)), *none], ["a", "b", "agree", "tree", "run", "id"])
        if borders and first is not None:
            ends = [first, last] if first != last else [first]
            none = [pa.nulls(len(ends), t) for t in (pa.int64(), pa.int64(), pa.int32())]
            yield pa.RecordBatch.from_arrays([*none, *(pa.array(c, t) for c, t in zip(zip(*ends, strict=True), (pa.int32(), pa.binary(), pa.int64()), strict=True))], ["a", "b", "agree", "tree", "run", "id"])

    ordered = rows.repartitionByRange("tree", "run", "id").sortWithinPartitions("tree", "run", "id")
    found = settle(ordered.mapInArrow(lambda batches: walk(batches, True), shape), "orders")
    borders = found.where("id is not null").select("tree", "run", "id").coalesce(1).sortWithinPartitions("tree", "run", "id")
    pairs = found.where("id is null").unionByName(borders.mapInArrow(lambda batches: walk(batches, False), shape))
    return pairs.groupBy("a", "b").agg(F.least(F.lit(VALUES), F.sum("agree")).cast("int").alias("agree")).select("a", "b", "agree", F.lit(0).cast("long").alias("lead_a"), F.lit(0).cast("long").alias("lead_b"))


def _counters(shingles: np.ndarray) -> np.ndarray:
    return (textscan.mix64(shingles) >> np.uint64(64 - COUNTERS)).astype(np.int64)


def _order_of_shingles(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """For each counter: the power of two of its count, and whether sets of more than one component have it.

    Tasks send what they counted in a few rows of packed arrays; 2 bytes a counter reach the driver.
    """
    size, low = 1 << COUNTERS, COUNTERS - 6

    @shared.lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, least, most = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max), np.full(size, np.iinfo(np.int64).min)
        for batch in batches:
            for c, s in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                at = _counters(np.frombuffer(s.as_buffer(), "<u8"))
                np.add.at(n, at, 1)
                least[at], most[at] = np.minimum(least[at], c), np.maximum(most[at], c)
        at = np.flatnonzero(n)
        for part in range(64):
            x = at[(at >> low) == part]
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([v.astype("<i8").tobytes()]) for v in (x, n[x], least[x], most[x]))], ["part", "at", "n", "least", "most"])

    @shared.lean
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, least, most = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max), np.full(size, np.iinfo(np.int64).min)
        parts = set()
        for batch in batches:
            parts |= set(batch.column(0).to_pylist())
            for row in zip(*(batch.column(k) for k in range(1, 5)), strict=True):
                at, k, a, b = (np.frombuffer(v.as_buffer(), "<i8") for v in row)
                n[at] += k
                least[at], most[at] = np.minimum(least[at], a), np.maximum(most[at], b)
        level, mixed = np.ceil(np.log2(np.maximum(n, 1))).astype(np.uint8), (least < most).astype(np.uint8)
        for part in sorted(parts):
            cut = slice(part << low, (part + 1) << low)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([level[cut].tobytes()]), pa.array([mixed[cut].tobytes()])], ["part", "level", "mixed"])

    packed = sets.select("component", "s").mapInArrow(count, "part int, at binary, n binary, least binary, most binary")
    level, mixed = np.zeros(size, np.uint8), np.zeros(size, bool)
    for row in packed.repartition("part").mapInArrow(merge, "part int, level binary, mixed binary").collect():
        cut = slice(row.part << low, (row.part + 1) << low)
        level[cut], mixed[cut] = np.frombuffer(row.level, np.uint8), np.frombuffer(row.mixed, np.uint8) > 0
    return level, mixed


def cells(sets: DataFrame, percent: int, cap: int = CAP) -> DataFrame:
    """(region, id) from rows (id, component, s): every two sets of differing components that can be linked share a region.

    Of those that share a shingle of their prefixes, the largest component is set against the
    others, and the others against each other; each block of cap against each, in its own region.
    """
    level, mixed = _order_of_shingles(sets)

    @shared.lean
    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for s in batch.column(2):
                x = np.frombuffer(s.as_buffer(), "<u8")
                at = _counters(x)
                first = np.lexsort((x, level[at]))[: len(x) - -(-percent * len(x) // 100) + 1]
                found.append(x[first[mixed[at[first]]]].view(np.int64))
            row = np.repeat(np.arange(batch.num_rows), [len(x) for x in found])
            if len(row):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), *(batch.column(k).take(pa.array(row)) for k in (0, 1))], ["shingle", "id", "component"])

    rows = settle(sets.select("id", "component", "s").mapInArrow(prefix, "shingle long, id long, component long"), "prefixes")
    by = rows.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("shingle")
    by = by.agg(F.sum("n").alias("size"), F.max(F.struct("n", "component")).alias("lead"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    by = by.select("shingle", "size", F.col("lead.component").alias("first"), F.ceil(F.col("lead.n") / cap).alias("firsts"), F.ceil((F.col("size") - F.col("lead.n")) / cap).alias("others"))
    x = settle(rows.join(by, "shingle"), "shared")
    small = x.where(F.col("size") <= cap).select(F.xxhash64("shingle").alias("region"), "id")
    x = x.where(F.col("size") > cap).withColumn("leads", F.col("component") == F.col("first"))
    block = F.pmod(F.xxhash64("id", "shingle"), F.when(F.col("leads"), F.col("firsts")).otherwise(F.col("others")))
    x = x.withColumn("block", block)
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    against = x.withColumn("you", F.explode(F.when(F.col("leads"), every("others")).otherwise(every("firsts"))))
    against = against.select(F.xxhash64("shingle", F.lit("lead"), F.when(F.col("leads"), F.col("block")).otherwise(F.col("you")), F.when(F.col("leads"), F.col("you")).otherwise(F.col("block"))).alias("region"), "id")
    among = x.where("not leads").withColumn("you", F.explode(every("others")))
    among = among.select(F.xxhash64("shingle", F.lit("other"), F.least("block", "you"), F.greatest("block", "you")).alias("region"), "id")
    return small.unionByName(against).unionByName(among)


def _pairs_in(first: np.ndarray, last: np.ndarray, n: np.ndarray, sig: np.ndarray, least: float, ratio: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs i < j < last[i] whose signatures agree in at least the given share; and their agreement."""
    left, right, seen = [], [], []
    rows = np.arange(len(n))
    gap = 1
    while len(rows := rows[rows + gap < last[rows]]):
        for at in range(0, len(rows), 4096):
            i = rows[at : at + 4096]
            j = i + gap
            fits = np.minimum(n[i], n[j]) >= ratio * np.maximum(n[i], n[j])
            i, j = i[fits], j[fits]
            agree = (sig[i] == sig[j]).sum(1)
            good = agree >= least * VALUES
            left.append(i[good].astype(np.int32))
            right.append(j[good].astype(np.int32))
            seen.append(agree[good].astype(np.int16))
        gap += 1
    if not left:
        none = np.zeros(0, np.int64)
        return none, none, none
    return np.concatenate(left), np.concatenate(right), np.concatenate(seen)


def candidates(members: DataFrame, least: float, ratio: float, across: bool) -> DataFrame:
    """(a, b, agree, hub) from rows (region, id, n, values[, component]).

    across False: each class with its best neighbour and with the most linked class of its
    region; hub is the smaller (1) or larger (2) id of the pair as the most linked one, or 0.
    across True: of pairs of differing components all where they are few in a region, DENSE for
    each class; in a denser region its classes that have such pairs, as (a = region, b = id, hub = -1).
    A task holds a region at a time.
    """

    @shared.lean
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
            if table.num_rows < 2:
                return
            region, ids, n = (table.column(c).to_numpy() for c in ("region", "id", "n"))
            sig = np.frombuffer(b"".join(table.column("values").to_pylist()), "<u2").reshape(len(ids), VALUES)
            edges = np.flatnonzero(np.concatenate(([True], region[1:] != region[:-1], [True])))
            last = np.repeat(edges[1:], np.diff(edges))
            i, j, agree = _pairs_in(edges, last, n, sig, least, ratio)
            keep = ids[i] != ids[j]
            if across:
                comp = table.column("component").to_numpy()
                keep &= comp[i] != comp[j]
            i, j, agree = i[keep], j[keep], agree[keep]
            if not across and len(i):
                # rows of a region stand in order of ids, so the smaller place is the smaller id
                count = len(ids)
                degree = np.bincount(i, minlength=count) + np.bincount(j, minlength=count)

                def best(worth) -> np.ndarray:
                    """Each row's partner of the greatest worth, of equal ones the smallest; -1 without any."""
                    top = np.full(count, -1, np.int64)
                    for at in range(0, len(i), 1 << 18):
                        a, b, how = (x[at : at + (1 << 18)] for x in (i, j, agree))
                        np.maximum.at(top, a, worth(b, how) << 32 | count - b)
                        np.maximum.at(top, b, worth(a, how) << 32 | count - a)
                    return np.where(top < 0, -1, count - (top & 0xFFFFFFFF))

                near, lead = best(lambda you, how: how.astype(np.int64)), best(lambda you, how: degree[you])
                me = np.flatnonzero(near >= 0)
                i, j = np.concatenate([me, me]), np.concatenate([near[me], lead[me]])
                agree = np.concatenate([(sig[i[at : at + 4096]] == sig[j[at : at + 4096]]).sum(1) for at in range(0, len(i), 4096)])
                hub = np.where(np.arange(len(i)) < len(me), 0, np.where(ids[j] < ids[i], 1, 2)).astype(np.int32)
            else:
                hub = np.zeros(len(i), np.int32)
            names = ["a", "b", "agree", "hub"]
            if across and len(i):
                of = np.searchsorted(edges, i, "right") - 1
                n_pairs = np.bincount(of, minlength=len(edges))
                row, _ = np.unique(np.concatenate([i, j]), return_counts=True)
                n_rows = np.bincount(np.searchsorted(edges, row, "right") - 1, minlength=len(edges))
                dense = n_pairs > DENSE * n_rows
                row = row[dense[np.searchsorted(edges, row, "right") - 1]]
                if len(row):
                    yield pa.RecordBatch.from_arrays([pa.array(region[row]), pa.array(ids[row]), pa.array(np.zeros(len(row), np.int32)), pa.array(np.full(len(row), -1, np.int32))], names)
                few = ~dense[of]
                i, j, agree, hub = i[few], j[few], agree[few], hub[few]
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[i], ids[j])), pa.array(np.maximum(ids[i], ids[j])), pa.array(agree.astype(np.int32)), pa.array(hub)], names)

        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size >= HELD:
                table = pa.Table.from_batches(held)
                region = table.column("region").to_numpy()
                cut = int(np.searchsorted(region, region[-1]))
                if cut:
                    yield from solve(table.slice(0, cut).combine_chunks())
                held = table.slice(cut).combine_chunks().to_batches()
                size = table.num_rows - cut
        if held:
            yield from solve(pa.Table.from_batches(held).combine_chunks())

    dealt = members.repartition("region").sortWithinPartitions("region", "id")
    found = dealt.mapInArrow(find, "a long, b long, agree int, hub int")
    if across:
        return found.groupBy("a", "b", "hub").agg(F.max("agree").alias("agree"))
    return found.groupBy("a", "b").agg(F.max("agree").alias("agree"), F.count_if(F.col("hub") == 1).alias("lead_a"), F.count_if(F.col("hub") == 2).alias("lead_b"))


def links_in_dense_regions(members: DataFrame, percent: int) -> DataFrame:
    """(a, b): confirmed links from rows (region, id, component, s), one for each pair of components in a region.

    Intersections of all sets of a region come from products of 0/1 matrices over the shingles
    that at least two of them have; nothing is emitted for each pair. Regions have about CAP rows at most.
    """

    def solve(region: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch | None:
        ids, comp = np.array([r[0] for r in region]), np.array([r[1] for r in region])
        size = np.array([len(r[2]) for r in region])
        values, column, count = np.unique(np.concatenate([r[2] for r in region]), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(region)), size)
        shared_by = count[column] > 1
        number = np.cumsum(count > 1) - 1
        row, column = row[shared_by], number[column[shared_by]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        common = np.zeros((len(region), len(region)), np.float32)
        for at in range(0, int((count > 1).sum()), 2048):
            a, b = np.searchsorted(column, [at, at + 2048])
            m = np.zeros((len(region), 2048), np.float32)
            m[row[a:b], column[a:b] - at] = 1
            common += m @ m.T
        linked = 100 * common.astype(np.float64) >= percent * (size[:, None] + size[None, :] - common)
        i, j = np.nonzero(np.triu(linked, 1) & (comp[:, None] != comp[None, :]))
        if not len(i):
            return None
        pair = np.stack([np.minimum(comp[i], comp[j]), np.maximum(comp[i], comp[j])])
        _, one = np.unique(pair, axis=1, return_index=True)
        i, j = i[one], j[one]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[i], ids[j])), pa.array(np.maximum(ids[i], ids[j]))], ["a", "b"])

    @shared.lean
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, np.ndarray]] = []
        at = None
        for batch in batches:
            for region, i, c, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if region != at and held:
                    if (out := solve(held)) is not None:
                        yield out
                    held = []
                at = region
                held.append((i, c, np.frombuffer(s.as_buffer(), "<u8")))
        if held and (out := solve(held)) is not None:
            yield out

    rows = members.select("region", "id", "component", "s").repartition("region").sortWithinPartitions("region", "id")
    return rows.mapInArrow(find, "a long, b long")


def full_sets(wanted: DataFrame, docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(id, s): shingle sets of the wanted ids, made anew from their texts.

    Up to BROADCAST_IDS ids go to all scans of the documents; more are joined by a shuffle of the texts.
    """

    @shared.lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, offsets in textscan.slices(batch.column(1)):
                start, stop, bounds = textscan.words(data, offsets, textscan.SPACES)
                sets, edges = textscan.shingle_sets(textscan.word_hashes(data, start, stop), bounds, width)
                values = [sets[edges[k] : edges[k + 1]].astype("<u8").tobytes() for k in range(end - at)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), pa.array(values, pa.binary())], ["id", "s"])

    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).join(wanted, "id", "left_semi")
    return settle(texts.mapInArrow(scan, "id long, s binary"), "sets").dropDuplicates(["id"])


def confirm(pairs: DataFrame, docs: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """Those of (a, b) with 100 * intersection >= percent * union of full shingle sets.

    Sets are made anew for the documents concerned only.
    """

    @shared.lean
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), "<u8") for v in (x, y))
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                linked.append(100 * common >= percent * (len(both) - common))
            batch = batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))
            if batch.num_rows:
                yield batch

    wanted = settle(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "wanted")
    sets = full_sets(wanted, docs, key, text, width)
    x = pairs.select("a", "b").join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    return settle(x.mapInArrow(check, "a long, b long"), "links")


def _classes(full: DataFrame, n_rows: int) -> DataFrame:
    """(id, class): rows of equal sets have the smallest id among them.

    Rows of a text that is alone need no join. Texts of very many rows, at most HOT_TEXTS, are
    broadcast, so that their rows stay where they are; all others are joined by a shuffle.
    """
    own = ["d0", "d1", "n"]
    classes = settle(full.groupBy(*own).agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("rows")).where("rows > 1"), "texts")
    hot = max(HOT, n_rows // HOT_TEXTS)
    rows = full.select("id", *own).join(F.broadcast(classes.where(F.col("rows") > hot).select(*own, F.col("class").alias("hot"))), own, "left")
    rest = rows.where("hot is null").join(classes.where(F.col("rows") <= hot).select(*own, "class"), own, "left")
    return rows.where("hot is not null").select("id", F.col("hot").alias("class")).unionByName(rest.select("id", F.coalesce("class", "id").alias("class"))).distinct()


def _of_rows(docs: DataFrame, key: str, text: str, width: int, percent: int, cap: int) -> DataFrame:
    """The result where ids have several texts: components of rows, which have ids of their own, joined where they hold rows of one id."""
    rows = docs.select(F.col(key).cast("long").alias("own"), F.col(text).cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id())
    rows = settle(rows, "rows")
    found = settle(near_duplicates(rows, "row", "text", width, percent, cap).select(F.col("doc_id").alias("row"), "n_shingles", F.col("component_id").alias("of_row")).join(rows.select("row", "own"), "row"), "of-rows")
    # an id is linked to the smallest id of each component that one of its rows is in
    known = found.where("own is not null")
    least = known.groupBy("of_row").agg(F.min("own").alias("b"))
    linked = components(settle(known.select("own", "of_row").distinct().join(least, "of_row").select(F.col("own").alias("a"), "b").where("a <> b").distinct(), "links"))
    x = found.join(linked, F.col("own") == F.col("node"), "left").withColumn("c", F.coalesce("component", "own"))
    return x.select(F.col("own").alias("doc_id"), "n_shingles", F.col("c").alias("component_id"), F.coalesce(F.col("c") == F.col("own"), F.lit(True)).alias("kept"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 75, cap: int = CAP) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row per row of docs.

    Words are runs of anything but ASCII white space, A-Z lower-cased. A null, empty or blank
    text has no shingles and is its own component. Rows that repeat an id with the same text
    are one class; rows that repeat an id with other texts are linked by every one of them, and have one component.
    A null id is its own component, null, and kept. An empty table gives an empty result.
    """
    spark, since = docs.sparkSession, mark(docs.sparkSession)
    prints = settle(fingerprints(docs, key, text, width), "prints")
    full = prints.where("n > 0 and id is not null")
    sets_of = F.struct("n", "d0", "d1")
    if not full.groupBy("id").agg((F.min(sets_of) != F.max(sets_of)).alias("torn")).where("torn").isEmpty():
        return _of_rows(docs, key, text, width, percent, cap)
    member = settle(_classes(full, prints.count()), "classes")
    heads = member.where("id = class").select("id")
    head_rows = full.join(heads, "id", "left_semi").select("id", "n", "values").dropDuplicates(["id"])
    head_rows = settle(head_rows, "heads")
    least, ratio = percent / 100 - 0.17, percent / 100
    places, crowded = regions(head_rows, cap)
    places = settle(places, "regions")
    rows = settle(places.distinct().join(head_rows, "id"), "places")
    pairs = candidates(rows, least, ratio, False)
    if crowded is not None:
        crowded = settle(crowded, "crowded")
        pairs = pairs.unionByName(order_neighbours(crowded, head_rows)).groupBy("a", "b").agg(F.max("agree").alias("agree"), F.sum("lead_a").alias("lead_a"), F.sum("lead_b").alias("lead_b"))
    pairs = settle(pairs, "pairs")
    # of the pairs of each class: the most alike partner, and the one that most regions have as their most linked class
    ends = pairs.select(F.col("a").alias("me"), F.col("b").alias("you"), "agree", F.col("lead_b").alias("lead")).unionByName(pairs.select(F.col("b").alias("me"), F.col("a").alias("you"), "agree", F.col("lead_a").alias("lead")))
    chosen = ends.groupBy("me").agg(F.max_by("you", F.struct("agree", -F.col("you"))).alias("x"), F.max_by("you", F.struct("lead", "agree", -F.col("you"))).alias("y"))
    chosen = chosen.select("me", F.explode(F.array("x", "y")).alias("you")).select(F.least("me", "you").alias("a"), F.greatest("me", "you").alias("b")).distinct()
    links = confirm(settle(chosen, "chosen"), docs, key, text, width, percent)
    comp = settle(components(links), "components")
    known = comp.select(F.col("node").alias("id"), "component")
    if crowded is not None:
        sets = full_sets(settle(crowded.select("id").distinct(), "crowded"), docs, key, text, width).join(known, "id", "left").withColumn("component", F.coalesce("component", "id"))
        again = settle(cells(settle(sets, "crowded-sets"), percent, cap), "cells")
        rows = rows.unionByName(again.join(head_rows, "id").select(*rows.columns))
    labelled = rows.join(known, "id", "left").withColumn("component", F.coalesce("component", "id"))
    rest = settle(candidates(labelled, least, ratio, True), "rest")
    more = confirm(rest.where("hub >= 0").select("a", "b").distinct(), docs, key, text, width, percent)
    dense = rest.where("hub < 0").select(F.col("a").alias("region"), F.col("b").alias("id"))
    if not dense.isEmpty():
        sets = full_sets(settle(dense.select("id").distinct(), "wanted"), docs, key, text, width)
        crowd = dense.join(sets, "id").join(known, "id", "left").withColumn("component", F.coalesce("component", "id"))
        more = more.unionByName(settle(links_in_dense_regions(crowd, percent), "dense-links"))
    comp = settle(components(links.unionByName(more)), "components")
    label = member.join(comp, F.col("class") == F.col("node"), "left").select("id", F.coalesce("component", "class").alias("c")).groupBy("id").agg(F.min("c").alias("c"))
    found = prints.select("id", "n").join(label, "id", "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("c", "id").alias("component_id"), F.coalesce(F.coalesce("c", "id") == F.col("id"), F.lit(True)).alias("kept")
    )
    return clear(spark, since, found)  # what the result doesn't read is removed
