"""Running sums, places, quantiles and inversions over groups of any size: no group is one task's.

Rows are sorted into ranges of about equal size; sums of ranges are few and are carried forward, and within a range a window
adds what comes before. A group that holds all rows is as many tasks' as there are ranges. The order given must tell
rows apart, or a run of equal rows stays in one range.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.sources.settled import settle

BLOCK, BUCKETS = 4096, 1024  # rows of a block at least, and blocks of a group at most, where inversions are counted


def join_on(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """left beside right's other columns where all of `by` are equal; nulls are equal."""
    r = right.select(*[F.col(c).alias(f"_j{k}") for k, c in enumerate(by)], *[c for c in right.columns if c not in by])
    same = functools.reduce(operator.and_, (F.col(c).eqNullSafe(F.col(f"_j{k}")) for k, c in enumerate(by)), F.lit(True))
    return left.join(r, same).drop(*[f"_j{k}" for k in range(len(by))])


def running(df: DataFrame, by: Sequence[str], order: Sequence[Column], sums: dict[str, Column], ranges: int | None = None) -> DataFrame:
    """df with the sum of each of `sums` over its group's rows up to and with its own, in order. Nulls count as a group and as zero."""
    by, n = list(by), ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    inputs = {f"_in{k}": F.coalesce(c, F.lit(0)) for k, c in enumerate(sums.values())}
    x = df.withColumns(inputs)
    # ranges are fixed by writing them: their bounds come from a sample
    x = settle(x.repartitionByRange(n, *[F.col(c) for c in by], *order).withColumn("_range", F.spark_partition_id()))
    totals = x.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_t{k}") for k, c in enumerate(inputs)])
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "_range", *[F.coalesce(F.sum(f"_t{k}").over(earlier), F.lit(0)).alias(f"_o{k}") for k in range(len(inputs))])
    within = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = x.select("*", *[F.sum(c).over(within).alias(f"_w{k}") for k, c in enumerate(inputs)])
    return join_on(local, offsets, [*by, "_range"]).select(*df.columns, *[(F.col(f"_w{k}") + F.col(f"_o{k}")).alias(name) for k, name in enumerate(sums)])


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "place", ranges: int | None = None) -> DataFrame:
    """df with each row's place in its group, from 0."""
    x = running(df, by, order, {name: F.lit(1)}, ranges)
    return x.withColumn(name, (F.col(name) - 1).cast("long"))


def quantiles(df: DataFrame, by: Sequence[str], value: str, places: dict[str, Column], ranges: int | None = None) -> DataFrame:
    """(by, n, one column a name): the value at each place, from 0, of a group's values in order; places are columns of n, null values don't count.

    Equal values are counted before anything is sorted.
    """
    by = list(by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    x = running(counts, by, [F.col(value)], {"_upto": F.col("_n")}, ranges)
    sizes = counts.groupBy(*by).agg(F.sum("_n").alias("n"))
    y = join_on(x, sizes, by)
    at = lambda place: F.max(F.when((F.col("_upto") - F.col("_n") <= place) & (place < F.col("_upto")), F.col(value)))
    return y.groupBy(*by, "n").agg(*[at(place).alias(name) for name, place in places.items()])


def median(df: DataFrame, by: Sequence[str], value: str, ranges: int | None = None) -> DataFrame:
    """(by, n, median): the middle value, or the mean of the two."""
    half = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    x = quantiles(df, by, value, {"_a": half[0], "_b": half[1]}, ranges)
    return x.select(*by, "n", ((F.col("_a") + F.col("_b")) / 2).alias("median"))


def _inversions(values: np.ndarray, groups: np.ndarray | None = None) -> int:
    """Pairs i < j with values[i] > values[j], by merges; with groups only pairs of unequal groups, which don't decrease."""
    if groups is not None:
        order = np.lexsort((values, groups))  # inside a group values ascend, so it has no pair
        values = values[order]
    n, total, width = len(values), 0, 1
    values = values.copy()
    while width < n:
        for a in range(0, n - width, 2 * width):
            b, c = a + width, min(a + 2 * width, n)
            left, right = values[a:b], values[b:c]
            total += int((len(left) - np.searchsorted(left, right, "right")).sum())
            values[a:c] = np.sort(values[a:c], kind="stable")
        width *= 2
    return total


def inversions(df: DataFrame, by: Sequence[str], first: str, second: str, key: str, ranges: int | None = None) -> DataFrame:
    """(by, n, inversions): pairs of a group that `first` and `second` order in opposite ways; equal values are no pair. Rows with a null value are left out.

    Rows get their places by (first, second) and by (second, place), which resolves ties so that they count for nothing. Places cut into
    blocks: pairs of different blocks both ways are counted from a small table of block counts, pairs of one block by sorting the block.
    """
    by = list(by)
    x = df.where(F.col(first).isNotNull() & F.col(second).isNotNull()).select(*by, first, second, key)
    x = numbered(x, by, [F.col(first), F.col(second), F.col(key)], "_p", ranges)
    x = numbered(x, by, [F.col(second), F.col("_p")], "_q", ranges)
    sizes = x.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    block = F.greatest(F.lit(BLOCK), F.ceil(F.col("n") / BUCKETS))
    y = join_on(x, sizes, by).select(*[F.col(c).alias(f"_g{k}") for k, c in enumerate(by)], "n", "_p", "_q", F.floor(F.col("_p") / block).alias("_bp"), F.floor(F.col("_q") / block).alias("_bq"))
    y, group = settle(y), [f"_g{k}" for k in range(len(by))]
    shape = ", ".join([*(f"{g} {y.schema[g].dataType.simpleString()}" for g in group), "part long"])

    def answer(keys, total: int) -> pa.Table:
        return pa.table({**{g: pa.array([k.as_py()], k.type) for g, k in zip(group, keys, strict=False)}, "part": pa.array([total], pa.int64())})

    def same_first(keys: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        return answer(keys, _inversions(rows.sort_by("_p").column("_q").to_numpy()))

    def same_second(keys: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("_p").to_numpy())
        return answer(keys, _inversions(rows.column("_q").to_numpy()[order], rows.column("_bp").to_numpy()[order]))

    def across(keys: tuple[pa.Scalar, ...], cells: pa.Table) -> pa.Table:
        p, q, c = (cells.column(n).to_numpy() for n in ("_bp", "_bq", "c"))
        table = np.zeros((int(p.max()) + 1, int(q.max()) + 1), np.int64)
        table[p, q] = c
        # rows of later first blocks and earlier second blocks
        later = np.cumsum(table[::-1], 0)[::-1]
        later = np.concatenate([later[1:], np.zeros((1, table.shape[1]), np.int64)])
        earlier = np.cumsum(later, 1) - later
        return answer(keys, int((table * earlier).sum()))

    parts = y.groupBy(*group, "_bp").applyInArrow(same_first, shape)
    parts = parts.unionByName(y.groupBy(*group, "_bq").applyInArrow(same_second, shape))
    cells = y.groupBy(*group, "_bp", "_bq").agg(F.count(F.lit(1)).alias("c"))
    parts = parts.unionByName((cells if group else cells.withColumn("_all", F.lit(0))).groupBy(*(group or ["_all"])).applyInArrow(across, shape))
    found = parts.groupBy(*group).agg(F.sum("part").alias("inversions")).select(*[F.col(g).alias(c) for g, c in zip(group, by, strict=True)], "inversions")
    return join_on(sizes, found, by)
