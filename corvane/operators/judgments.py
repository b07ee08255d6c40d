"""Scenarios, graded judgments and splits: joins with referential checks, guards against leaks, masks for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Operations that may not see the sealed split, and the one that may.
DEVELOPMENT = ("feature_fitting", "ranker_training", "hyperparameter_selection", "threshold_tuning", "calibration", "model_comparison", "early_stopping", "alias_mining")
FINAL = ("final_evaluation",)
SEALED = "test"
#: The sources of a grade in order of precedence, with their weights.
GRADE_SOURCES = (("adjudicated", 1.0), ("human", 1.0), ("synthetic-seed", 0.6))


class Leak(ValueError):
    """Rows that should be apart are not."""


def resolved_grade() -> list[Column]:
    """grade, label_source and label_weight from adjudicated_grade, human_grade and synthetic_grade: the first that is there."""
    columns = [F.col("adjudicated_grade"), F.col("human_grade"), F.col("synthetic_grade")]
    first = lambda values: F.coalesce(*[F.when(c.isNotNull(), F.lit(v)) for c, v in zip(columns, values, strict=True)])
    return [F.coalesce(*columns).alias("grade"), first([s for s, _ in GRADE_SOURCES]).alias("label_source"), first([w for _, w in GRADE_SOURCES]).alias("label_weight")]


def unknown_scenarios(judgments: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Judgments whose scenario doesn't exist: must be empty."""
    return judgments.join(scenarios, "scenario_id", "left_anti")


def qrels(scenarios: DataFrame, judgments: DataFrame) -> DataFrame:
    """Graded judgments with their scenario's columns; ungraded ones are left out."""
    graded = judgments.select("scenario_id", "report_key", *resolved_grade()).where("grade is not null")
    return graded.join(scenarios, "scenario_id")


def weak_qrels(scenarios: DataFrame, judgments: DataFrame, splits: DataFrame, split: str) -> DataFrame:
    """One row a scenario of a split: its positive synthetic grades as a map, answerable, and the status expected of a search.

    scenarios: (scenario_id, answerability); a scenario without positives keeps an empty map.
    """
    if split not in ("train", "validation", "test"):
        raise ValueError(f"unknown weak-label split: {split}")
    mine = scenarios.join(splits.where(F.col("split") == split).select("scenario_id").distinct(), "scenario_id", "left_semi")
    good = judgments.where("synthetic_grade > 0").groupBy("scenario_id", "report_key").agg(F.max("synthetic_grade").alias("grade"))
    maps = good.groupBy("scenario_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("report_key", "grade")))).alias("relevant"))
    none = F.create_map().cast(maps.schema["relevant"].dataType)
    answerable = F.coalesce(F.col("answerability") != "No answer", F.lit(True))
    status = F.when(~answerable, "NO_SATISFACTORY_REPORT").when(F.contains(F.lower("answerability"), F.lit("clarification")), "NEEDS_CLARIFICATION")
    return mine.join(maps, "scenario_id", "left").select("scenario_id", F.coalesce("relevant", none).alias("relevant"), answerable.alias("answerable"), status.alias("expected_status"))


def labelled_queries(scenarios: DataFrame, judgments: DataFrame, splits: DataFrame | None = None, split: str | None = None) -> DataFrame:
    """(scenario_id, query, grades): all grades of a scenario, missing ones skipped, optionally of one split."""
    x = judgments.where("synthetic_grade is not null")
    if split is not None:
        x = x.join(splits.where(F.col("split") == split).select("scenario_id").distinct(), "scenario_id", "left_semi")
    x = x.groupBy("scenario_id", "report_key").agg(F.max("synthetic_grade").alias("grade")).groupBy("scenario_id").agg(F.sort_array(F.collect_list(F.struct("report_key", "grade"))).alias("grades"))
    return x.join(scenarios.select("scenario_id", "query"), "scenario_id", "left").select("scenario_id", F.coalesce("query", F.lit("")).alias("query"), "grades")


def judgment_faults() -> Column:
    """The first rule of the human-judgment contract that a row breaks, else null."""
    return (
        F.when(F.col("relevance").isNull() | ~F.col("relevance").isin(0, 1, 2), "grade")
        .when(F.trim(F.coalesce("annotator_id", F.lit(""))) == "", "annotator")
        .when(F.coalesce("source", F.lit("")) != "production_query", "source")
    )


def accept_judgments(x: DataFrame) -> DataFrame:
    """The rows as they are; the first fault, or no row at all, fails."""
    if not x.take(1):
        raise ValueError("no human judgments supplied")
    if bad := x.withColumn("fault", judgment_faults()).where("fault is not null").take(1):
        raise ValueError(f"judgment breaks the rule on {bad[0]['fault']}: {bad[0].asDict()}")
    return x


def split_overlap(splits: DataFrame) -> DataFrame:
    """(scenario_id, splits) of ids in more than one split."""
    return splits.groupBy("scenario_id").agg(F.sort_array(F.collect_set("split")).alias("splits")).where("size(splits) > 1")


def sealed_rows(ids: DataFrame, splits: DataFrame, operation: str) -> DataFrame:
    """Ids that an operation may not see. An unknown operation fails, since a misspelt guard would guard nothing."""
    if operation not in DEVELOPMENT + FINAL:
        raise ValueError(f"unknown operation: {operation}")
    sealed = splits.where(F.col("split") == SEALED).select("scenario_id")
    return ids.join(sealed, "scenario_id", "left_semi").where(F.lit(operation in DEVELOPMENT))


def shared_positives(positives: DataFrame) -> DataFrame:
    """(report_key, splits) of positives that more than one split has."""
    return positives.groupBy("report_key").agg(F.sort_array(F.collect_set("split")).alias("splits")).where("size(splits) > 1")


def guard(ids: DataFrame, splits: DataFrame, operation: str) -> DataFrame:
    """ids, after both checks."""
    for bad, what in ((split_overlap(splits), "splits overlap"), (sealed_rows(ids, splits, operation), f"sealed ids passed to {operation}")):
        if rows := bad.take(10):
            raise Leak(f"{what}: {sorted(str(r['scenario_id']) for r in rows)}")
    return ids


def co_positive_mask(candidates: DataFrame, grades: DataFrame) -> DataFrame:
    """candidates (query_id, instance_id, family) with masked: not to be taken as a negative.

    Masked are graded positives, any instance of a positive's family, and what nobody judged. grades: (query_id, instance_id, family, grade).
    """
    judged = grades.select("query_id", "instance_id", "grade")
    families = grades.where("grade > 0").select("query_id", "family").distinct().withColumn("sibling", F.lit(True))
    x = candidates.join(judged, ["query_id", "instance_id"], "left").join(families, ["query_id", "family"], "left")
    return x.select("query_id", "instance_id", (F.col("grade").isNull() | (F.col("grade") > 0) | F.col("sibling").isNotNull()).alias("masked"))


def slices(x: DataFrame, by: str, metric: str, least: int = 10, digits: int = 4) -> DataFrame:
    """Mean candidate and fallback values and their difference, of slices with enough queries."""
    g = x.groupBy(by).agg(F.avg(f"candidate_{metric}").alias("c"), F.avg(f"fallback_{metric}").alias("f"), F.count(F.lit(1)).alias("queries")).where(F.col("queries") >= least)
    return g.select(by, "queries", F.round("c", digits).alias("candidate"), F.round("f", digits).alias("fallback"), F.round(F.col("c") - F.col("f"), digits).alias("delta"))


def threshold_sweep(probes: DataFrame, thresholds: list[float]) -> DataFrame:
    """(tau, coverage, precision): probes (score, hit) at each of a few thresholds; precision is null where none fires."""
    x = probes.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col("score") >= t).alias(f"f{i}") for i, t in enumerate(thresholds)],
        *[F.count_if((F.col("score") >= t) & F.col("hit")).alias(f"h{i}") for i, t in enumerate(thresholds)],
    )
    rows = F.array(*[F.struct(F.lit(t).alias("tau"), F.round(F.col(f"f{i}") / F.col("n"), 6).alias("coverage"), F.when(F.col(f"f{i}") > 0, F.round(F.col(f"h{i}") / F.col(f"f{i}"), 6)).alias("precision")) for i, t in enumerate(thresholds)])
    return x.select(F.inline(rows))
