"""Exact ranking metrics at any size: AUROC, average precision, PR curve, best F1.

Rows are counted per distinct score first, then ranked with range-partitioned running totals; all
metrics come from one ranking. A metric with an empty class is NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normatile.functions.scores import EPS, defined_if_two_classes
from normatile.operators.ordering import join_null_safe, running_totals

ALL = "_all"


def _keyed(df: DataFrame, group: Sequence[str]) -> tuple[DataFrame, list[str]]:
    return (df, list(group)) if group else (df.withColumn(ALL, F.lit(0)), [ALL])


def score_counts(df: DataFrame, score: str, label: str, group: Sequence[str] = ()) -> DataFrame:
    """Positive and negative rows per distinct score."""
    return (
        df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
        .groupBy(*group, F.col(score).cast("double").alias("threshold"))
        .agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg"))
    )


def rank_counts(counts: DataFrame, group: Sequence[str] = (), ranged: bool = False) -> DataFrame:
    """Add true and false positives (``tp``, ``fp``) of "score >= threshold" to counts per score.

    ``ranged``: the counts lie in range partitions of descending thresholds already.
    """
    return running_totals(
        counts, group, [F.desc("threshold")], {"tp": F.col("pos"), "fp": F.col("neg")}, ranged
    )


def ranking(df: DataFrame, score: str, label: str, group: Sequence[str] = ()) -> DataFrame:
    return rank_counts(score_counts(df, score, label, group), group)


def summarize(ranked: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """AUROC, average precision, best F1 and its threshold from a ranking."""
    keyed, keys = _keyed(ranked, group)
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    beaten = F.col("neg") * (F.col("tp") - F.col("pos") / F.lit(2.0))
    base = keyed.groupBy(*keys).agg(
        F.sum("pos").alias("positives"),
        F.sum("neg").alias("negatives"),
        F.sum(beaten).alias("_beaten"),
        F.sum(F.col("pos") * precision).alias("_precision"),
    )
    p, n = F.col("positives"), F.col("negatives")
    return base.select(
        *group,
        "positives",
        "negatives",
        defined_if_two_classes(F.try_divide(F.col("_beaten"), p.cast("double") * n), p, n).alias("auroc"),
        F.try_divide(F.col("_precision"), p.cast("double")).alias("average_precision"),
    )


def auroc(df: DataFrame, score: str, label: str, group: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve with half credit for ties."""
    return summarize(ranking(df, score, label, group), group).select(*group, "positives", "negatives", "auroc")


def average_precision(df: DataFrame, score: str, label: str, group: Sequence[str] = ()) -> DataFrame:
    return summarize(ranking(df, score, label, group), group).select(*group, "average_precision")


def _with_rates(ranked: DataFrame, group: Sequence[str]) -> DataFrame:
    if group:
        rated = join_null_safe(ranked, ranked.groupBy(*group).agg(F.sum("pos").alias("_p")), group)
    else:
        rated = ranked.withColumn("_p", ranked.agg(F.sum("pos")).scalar())
    return rated.where(F.col("_p") > 0).withColumns(
        {"precision": F.col("tp") / (F.col("tp") + F.col("fp")), "recall": F.col("tp") / F.col("_p")}
    )


def pr_curve(df: DataFrame, score: str, label: str, group: Sequence[str] = ()) -> DataFrame:
    """Precision and recall at every distinct threshold, and the end point (1, 0) without one."""
    rated, keys = _keyed(_with_rates(ranking(df, score, label, group), group), group)
    points = rated.select(*keys, "threshold", "precision", "recall")
    ends = rated.groupBy(*keys).agg(
        F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")
    )
    return points.unionByName(ends).select(*group, "threshold", "precision", "recall")


def best_f1(df: DataFrame, score: str, label: str, group: Sequence[str] = ()) -> DataFrame:
    """Highest F1 over all thresholds; among equals the lowest threshold."""
    rated, keys = _keyed(_with_rates(ranking(df, score, label, group), group), group)
    f1 = 2.0 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + EPS)
    best = rated.withColumn("best_f1", f1).groupBy(*keys).agg(
        F.max(F.struct("best_f1", (-F.col("threshold")).alias("_t"))).alias("_best")
    )
    return best.select(*group, F.col("_best.best_f1").alias("best_f1"), (-F.col("_best._t")).alias("threshold"))


def class_counts(df: DataFrame, label: str, group: Sequence[str] = ()) -> DataFrame:
    """How many classes a group has; ranking metrics need two."""
    keyed, keys = _keyed(df, group)
    classes = F.when(F.min(label) == F.max(label), 1).otherwise(2)
    return keyed.groupBy(*keys).agg(classes.alias("n_classes")).select(*group, "n_classes")


def score_inventory(images: DataFrame, score: str, label: str, group: Sequence[str] = ()) -> DataFrame:
    """Image counts by class and the range of scores."""
    keyed, keys = _keyed(images, group)
    return keyed.groupBy(*keys).agg(
        F.count("*").alias("total"),
        F.count_if(F.col(label) == 0).alias("normal"),
        F.count_if(F.col(label) == 1).alias("anomaly"),
        F.min(score).alias("min_score"),
        F.max(score).alias("max_score"),
    ).select(*group, "total", "normal", "anomaly", "min_score", "max_score")


def pair_labels(scores: DataFrame, truth: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Match predictions with ground truth on their keys; a place without truth is normal."""
    return scores.join(truth.select(*keys, label).hint("merge"), list(keys), "left").withColumn(
        label, F.coalesce(F.col(label), F.lit(0))
    )
