"""Column expressions for scores, labels and metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Small constants that keep powers and divisions defined.
EPS = 1e-8


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def soft_clip(score: Column, scale: float = 10.0) -> Column:
    """Saturating clip: grows towards ``scale`` and never reaches it."""
    return score / (1.0 + score / F.lit(float(scale)))


def squash(score: Column) -> Column:
    """Monotone map of [0, inf) to a probability-like value."""
    return sigmoid(F.log1p(score))


def probability(score: Column, scale: float = 10.0) -> Column:
    """The anomaly probability that the supervised losses work on."""
    return sigmoid(soft_clip(score, scale) / 2.0)


def clip(value: Column, low, high) -> Column:
    low = low if isinstance(low, Column) else F.lit(float(low))
    high = high if isinstance(high, Column) else F.lit(float(high))
    return F.least(F.greatest(value, low), high)


def amplify(quadratic: Column, gamma: float | None = 1.3) -> Column:
    """Floor a squared distance at zero and raise it to ``gamma`` (None: leave it as it is); NULL stays NULL."""
    floored = F.when(quadratic.isNotNull(), F.greatest(quadratic, F.lit(0.0)))
    return floored if gamma is None else F.pow(floored + EPS, F.lit(float(gamma)))


def fuse_scores(
    attention: Column,
    deviation: Column,
    n_queries: int | Column,
    alpha: float = 0.4,
    beta: float = 0.4,
    cross: float = 0.2,
) -> Column:
    """Final patch score: per-query attention, deviation and their product."""
    queries = n_queries if isinstance(n_queries, Column) else F.lit(n_queries)
    share = attention / (queries.cast("double") + EPS)
    return alpha * share + beta * deviation + cross * (share * deviation)


def fuse_for_selection(attention: Column, deviation: Column, alpha: float = 0.4, beta: float = 0.4) -> Column:
    """Score that ranks patches while pruning: summed attention and no product term."""
    return alpha * attention + beta * deviation


def label_of(defect_type: Column) -> Column:
    return F.when(defect_type == "good", 0).otherwise(1)


def label_name(label: Column) -> Column:
    return F.when(label == 1, "Anomaly").otherwise("Normal")


def defined_if_two_classes(metric: Column, positives: Column, negatives: Column) -> Column:
    """NULL where a ranking metric has no meaning because one class is empty."""
    return F.when((positives > 0) & (negatives > 0), metric)


def combined_metric(image_metric: Column, patch_metric: Column) -> Column:
    """Mean of both metrics, the image metric alone, or NULL if that one is undefined."""
    return F.coalesce((image_metric + patch_metric) / 2.0, image_metric)
