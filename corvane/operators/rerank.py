"""Joint scoring of (query text, candidate text) pairs by a pluggable scorer, and expansion by siblings."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators import prefix
from corvane.sources.settled import settle

Scorer = Callable[[Sequence[str], Sequence[str]], Sequence[float]]


def score_pairs(pairs: DataFrame, scorer: Scorer, query_text: str = "query_text", text: str = "text") -> DataFrame:
    """Adds ce_score: each distinct pair of texts is scored once, and the score fanned out; null texts count as empty.

    The scorer runs on whole Arrow batches. One that gives another number of scores than of pairs raises ValueError.
    """
    keyed = pairs.withColumn("_q", F.coalesce(query_text, F.lit(""))).withColumn("_t", F.coalesce(text, F.lit("")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, t = batch.column(0), batch.column(1)
            got = list(scorer(q.to_pylist(), t.to_pylist()))
            if len(got) != batch.num_rows:
                raise ValueError(f"scorer gave {len(got)} scores for {batch.num_rows} pairs")
            yield pa.RecordBatch.from_arrays([q, t, pa.array(got, pa.float64())], ["_q", "_t", "ce_score"])

    scores = keyed.select("_q", "_t").distinct().mapInArrow(run, "_q string, _t string, ce_score double")
    return keyed.join(scores, ["_q", "_t"]).drop("_q", "_t")


def rank_finite(scored: DataFrame, query: str = "query_id", key: str = "instance_id") -> DataFrame:
    """Drops null and non-finite scores, then adds ce_rank by (-ce_score, key)."""
    s = F.col("ce_score")
    finite = s.isNotNull() & ~F.isnan(s) & (F.abs(s) != float("inf"))
    return scored.where(finite).withColumn("ce_rank", F.row_number().over(Window.partitionBy(query).orderBy(s.desc(), key)))


#: Siblings that share a key of the join.
RUN = 64


def expand_families(families: DataFrame, instances: DataFrame, scored: DataFrame, allowed: DataFrame, leading: int = 20, most: int = 60) -> DataFrame:
    """(query_id, instance_id, family, place): unscored, authorized siblings of a query's leading families, in family order.

    families: (query_id, family, family_rank), ranks unique within a query; instances: (instance_id, family); scored: (query_id, instance_id); allowed: (instance_id).
    Authorized siblings are numbered once. A query's scored ones tell how many unscored each of its families has, so it meets only the first
    siblings that it needs, in runs of RUN; places follow from the numbers, so that rows aren't exchanged or sorted once they are expanded.
    """
    live = instances.where("family is not null").select("instance_id", "family").join(allowed.select("instance_id").distinct().hint("merge"), "instance_id", "left_semi")
    live = settle(prefix.numbered(live, ["family"], [F.col("instance_id")], "_at"))
    lead = families.where(F.col("family_rank") <= leading).select("query_id", "family", "family_rank")
    seen = scored.select("query_id", "instance_id").distinct().join(live, "instance_id").groupBy("query_id", "family").agg(F.collect_list("_at").alias("_seen"))
    x = lead.join(live.groupBy("family").agg(F.count(F.lit(1)).alias("_n")), "family").join(seen, ["query_id", "family"], "left")
    x = x.withColumn("_seen", F.coalesce("_seen", F.array().cast("array<bigint>")))
    earlier = Window.partitionBy("query_id").orderBy("family_rank").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("_before", F.coalesce(F.sum(F.col("_n") - F.size("_seen")).over(earlier), F.lit(0))).where(F.col("_before") < most)
    x = x.withColumn("_end", F.least(F.col("_n"), most - F.col("_before") + F.size("_seen"))).where("_end > 0")
    run = lambda at: F.floor(at / RUN).cast("long")
    x = x.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), run(F.col("_end") - 1))))
    x = x.join(live.withColumn("_run", run(F.col("_at"))), ["family", "_run"]).where((F.col("_at") < F.col("_end")) & ~F.array_contains("_seen", F.col("_at")))
    place = F.col("_before") + F.col("_at") + 1 - F.size(F.filter("_seen", lambda s: s < F.col("_at")))
    return x.withColumn("place", place.cast("int")).where(F.col("place") <= most).select("query_id", "instance_id", "family", "place")
