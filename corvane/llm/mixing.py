"""Mixing sources to target weights by a time-varying curriculum; DataFrame operations only.

Each source has a weight schedule: linear between knots over training time 0..1. Its integral
is the source's weight, its running integral the source's cumulative demand for words.

Targets: sources share the words of all documents by weight, none more than `most` times its
own size; what is above goes to the others by weight. Within a source, documents stand in an
order that depends on a hash of their content only. The mix takes words from the start of
that order, again and again, up to the target: a document is taken whole in each full round,
and in the last round if it lies before the end, the one at the end in part. A word's place
in the source's cumulative demand gives its time, and time is inverted piece by piece.

Cumulative sizes take two steps: within buckets of the order, and over the buckets' sums, so
no task holds a whole source. Buckets are cut by leading bits of the hash.

Defined cases: a null text has size 0; a null source is a source of its own, the last one;
rows of size 0 take nothing; rows that repeat stand next to each other and count each; an
empty table gives no rows; no words at all give targets of 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.shared import settle

BUCKET_DIGITS = 3  # hexadecimal digits of the order that name a bucket

#: Schedules of the sources in turn, as (time, weight) knots: their integrals are 5, 2 and 1.
SCHEDULES = (((0.0, 6.0), (1.0, 4.0)), ((0.0, 1.0), (0.5, 2.0), (1.0, 3.0)), ((0.0, 1.0), (1.0, 1.0)))


def integral(knots: Sequence[tuple[float, float]]) -> float:
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False))


def invert(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """Time at which the given share of a schedule's integral is reached."""
    whole, done, out = integral(knots), 0.0, F.lit(None).cast("double")
    want = share * whole
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        piece = (t1 - t0) * (w0 + w1) / 2
        slope = (w1 - w0) / (t1 - t0)
        rest = F.greatest(want - done, F.lit(0.0))
        # w0 * x + slope * x * x / 2 = rest
        x = 2 * rest / (w0 + F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * rest, F.lit(0.0))))
        out = F.when(out.isNull() & (want <= done + piece * (1 + 1e-12)), t0 + F.least(x, F.lit(t1 - t0))).otherwise(out)
        done += piece
    return F.coalesce(out, F.lit(float(knots[-1][0])))


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space: starts of such runs are counted."""
    flat = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.coalesce(F.regexp_count(flat, F.lit("[^ ]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], most: float = 3.0) -> DataFrame:
    """(source, source_size, turn, target) from (source, source_size): one row per source.

    Sources above their limit at the common level are those of the smallest limit per weight:
    with sources in this order, a source is above where its limit per weight is below the level
    that the words left after all before it would give to it and all after it.
    """
    # the number of sources bounds these windows, not the number of documents
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    turn = ((F.row_number().over(by_name) - 1) % len(weights)).cast("int")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col("turn") + 1)
    x = sizes.withColumn("turn", turn).withColumn("w", w).withColumn("cap", most * F.col("source_size"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(0))
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    x = x.withColumn("level", left / F.sum("w").over(after)).withColumn("above", F.col("cap") / F.col("w") <= F.col("level"))
    # all sources after the first that isn't above are not above
    x = x.withColumn("level", F.min(F.when(~F.col("above"), F.struct(F.col("cap") / F.col("w"), F.col("source_size"), F.col("level")))).over(every)["level"])
    target = F.when(F.col("above"), F.col("cap")).otherwise(F.col("w") * F.col("level"))
    return x.select("source", "source_size", "turn", F.round(target, 6).alias("target"))


def mix(docs: DataFrame, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES, most: float = 3.0, key: str = "doc_id", text: str = "text", source: str = "source", keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, size, source_size, target, taken, position, mixed_source, turn, at) and kept columns, for each row.

    position: time of the document's first word, null where nothing is taken; at: words before it in a round of its source.
    """
    extra = {c: f"kept_{i}" for i, c in enumerate(keep)}
    rows = docs.select(F.col(key).alias("k"), F.col(source).cast("string").alias("source"), word_count(F.col(text).cast("string")).alias("size"), *[F.col(c).alias(a) for c, a in extra.items()])
    rows = rows.withColumn("o", F.md5(F.concat_ws(":", F.coalesce(F.col("k").cast("string"), F.lit("")), F.col("size").cast("string"))))
    rows = rows.withColumn("bucket", F.substring("o", 1, BUCKET_DIGITS))
    if not keep:
        rows = settle(rows, "sizes")  # small without further columns: words are counted once
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    wanted = targets(sums.groupBy("source").agg(F.sum("n").alias("source_size")), [integral(s) for s in schedules], most)
    run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = sums.withColumn("start", F.coalesce(F.sum("n").over(run), F.lit(0))).alias("s").join(wanted.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")))
    buckets = buckets.select(F.col("s.source").alias("bs"), F.col("s.bucket").alias("bb"), "start", "source_size", "turn", "target")
    x = rows.join(buckets, F.col("source").eqNullSafe(F.col("bs")) & (F.col("bucket") == F.col("bb")))
    own = Window.partitionBy("source", "bucket").orderBy("o", "k").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("at", F.col("start") + F.coalesce(F.sum("size").over(own), F.lit(0)))
    goal = F.round("target").cast("long")
    rounds = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = goal - rounds * F.col("source_size")
    taken = rounds * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("at")))
    time = _time(F.lit(1), schedules)
    return x.select(
        F.col("k").alias(key), "size", "source_size", "target", taken.cast("long").alias("taken"),
        F.when(taken > 0, F.round(time, 9)).alias("position"), F.col("source").alias("mixed_source"), "turn", "at", *[F.col(a).alias(c) for c, a in extra.items()],
    )


def _time(round_: Column, schedules: Sequence[Sequence[tuple[float, float]]]) -> Column:
    """Time of the first word of a document's copy in the given round, from turn, at, source_size and target."""
    share = F.when(F.col("target") > 0, (F.col("at") + (round_ - 1) * F.col("source_size")) / F.col("target"))
    time = F.lit(None).cast("double")
    for k, s in enumerate(schedules):
        time = F.when(F.col("turn") == k, invert(share, s)).otherwise(time)
    return time


def in_training_order(mixed: DataFrame, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES, parts: bool = False, untaken: bool = False) -> DataFrame:
    """Documents range-sorted by position, each as often as it is taken; round counts its copies from 1.

    Parts count from one half, or each as a copy; untaken documents stay out, or come first, in round 0.
    A copy's position is the time of its own place in the source's demand, so all lie in 0..1.
    """
    copies = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0)
    times = (F.ceil(copies) if parts else F.round(copies)).cast("int")
    none = F.array(F.lit(0)) if untaken else F.array().cast("array<int>")
    x = mixed.withColumn("round", F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(none)))
    x = x.withColumn("position", F.when(F.col("round") > 0, F.round(_time(F.col("round"), schedules), 9)))
    # rows of one position, and those of none, are many: a hash of the key parts them too
    part = F.xxhash64(x[mixed.columns[0]])
    return x.repartitionByRange(F.col("position"), part).sortWithinPartitions(F.col("position"), part, F.col("round"))
