"""Training losses as aggregate columns: plain Catalyst aggregates, usable under any groupBy."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normatile.functions.scores import probability, soft_clip
from normatile.functions.seeded import gaussian

# Logarithms are floored here, so that a probability of 0 or 1 gives a large, finite loss.
LOG_FLOOR = -100.0


def clustering_loss(score: Column, clamp_max: float = 100.0, lambda_var: float = 0.1) -> Column:
    """Mean of the clipped scores plus a share of their sample variance."""
    clipped = soft_clip(score, clamp_max)
    return F.avg(clipped) + float(lambda_var) * F.var_samp(clipped)


def cross_entropy(p: Column, y: Column) -> Column:
    """Binary cross-entropy of one row."""
    y = y.cast("double")
    log_p = F.greatest(F.when(p > 0, F.log(p)).otherwise(LOG_FLOOR), F.lit(LOG_FLOOR))
    log_q = F.greatest(F.when(p < 1, F.log(1.0 - p)).otherwise(LOG_FLOOR), F.lit(LOG_FLOOR))
    return -(y * log_p + (1.0 - y) * log_q)


def bce_loss(score: Column, y: Column) -> Column:
    return F.avg(cross_entropy(probability(score), y))


def focal_loss(score: Column, y: Column, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    """Cross-entropy weighted down for rows that are already right."""
    p, t = probability(score), y.cast("double")
    p_t = p * t + (1.0 - p) * (1.0 - t)
    alpha_t = alpha * t + (1.0 - alpha) * (1.0 - t)
    return F.avg(alpha_t * F.pow(1.0 - p_t, F.lit(float(gamma))) * cross_entropy(p, y))


def pseudo_loss(score: Column, *keys: Column, epsilon: float = 0.01, seed: int = 42) -> Column:
    """Mean rise of scores under a small seeded disturbance, falls counted as zero."""
    disturbed = score + float(epsilon) * gaussian(seed, *keys)
    return F.avg(F.greatest(disturbed - score, F.lit(0.0)))


# Losses a run can select by name; callers may register their own builder.
LOSSES: dict[str, Callable[..., Column]] = {
    "clustering": lambda score, y, **kw: clustering_loss(score, **kw),
    "bce": lambda score, y, **kw: bce_loss(score, y, **kw),
    "focal": lambda score, y, **kw: focal_loss(score, y, **kw),
}


def register_loss(name: str, builder: Callable[..., Column]) -> None:
    """Add a loss: ``builder(score, label, **options)`` returns an aggregate column."""
    LOSSES[name] = builder


def total_loss(
    df: DataFrame,
    score: str,
    label: str,
    group: list[str] | None = None,
    loss: str = "bce",
    patch_weight: float = 1.0,
    use_pseudo: bool = False,
    pseudo_keys: tuple[str, ...] = (),
    pseudo_epsilon: float = 0.01,
    **options,
) -> DataFrame:
    """Columns ``patch``, ``total`` and, with normal-only training, ``pseudo`` per group."""
    patch = LOSSES[loss](F.col(score), F.col(label), **options)
    aggs = [patch.alias("patch")]
    pseudo = use_pseudo and loss == "clustering"
    if pseudo:
        keys = [F.col(k) for k in pseudo_keys]
        aggs.append(pseudo_loss(F.col(score), *keys, epsilon=pseudo_epsilon).alias("pseudo"))
    out = df.groupBy(*(group or [])).agg(*aggs)
    total = float(patch_weight) * F.col("patch") + (F.col("pseudo") if pseudo else F.lit(0.0))
    return out.withColumn("total", total)


def score_profile(df: DataFrame, group: list[str], score: str = "score") -> DataFrame:
    """Mean, lowest and highest score per group (a training step, an image, ...)."""
    return df.groupBy(*group).agg(
        F.avg(score).alias("mean_score"), F.min(score).alias("min_score"), F.max(score).alias("max_score")
    )
