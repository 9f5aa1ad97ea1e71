"""Whole jobs put together from the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normatile.functions.scores import fuse_scores
from normatile.operators.attention import attention
from normatile.operators.evaluation import auroc, score_inventory
from normatile.operators.ordering import join_null_safe
from normatile.operators.profile import add_normal, fit_profile
from normatile.operators.rollups import pixel_auroc
from normatile.operators.scoring import image_score, mahalanobis
from normatile.session import materialize


def score_patches(
    patches: DataFrame, profile: DataFrame, group: Sequence[str] = (), queries: DataFrame | None = None,
    gamma: float | None = 1.3, alpha: float = 0.4, beta: float = 0.4, cross: float = 0.2, n_queries: int | None = None,
) -> DataFrame:
    """Final patch scores: deviation from the profile fused with attention, if queries are given.

    ``n_queries`` is how many the model has; without it attention is shared by the queries an image really has.
    """
    scored = mahalanobis(patches, profile, group, gamma=gamma)
    if queries is None:
        return scored.withColumn("score", F.col("deviation"))
    attended = attention(patches, queries).drop("weights")
    joined = join_null_safe(scored, attended, ["image_id", "patch_idx"])
    return joined.withColumn(
        "score", fuse_scores(F.col("importance"), F.col("deviation"), F.col("n_queries") if n_queries is None else n_queries, alpha, beta, cross)
    )


def score_images(
    patches: DataFrame, group: Sequence[str] = (), queries: DataFrame | None = None, label: str = "y", **options
) -> DataFrame:
    """Fit on normal patches, score all patches, and give each image its score and label."""
    profile = materialize(fit_profile(add_normal(patches, label), group), "profile")
    scored = score_patches(patches, profile, group, queries, **options)
    labels = patches.groupBy("image_id").agg(F.max(label).alias("label"))
    return join_null_safe(image_score(scored), labels, ["image_id"])


def evaluation_report(
    scores: DataFrame, masks: DataFrame, images: DataFrame, grid: int, size: int, unknown: str = "drop"
) -> DataFrame:
    """One row: image AUROC, pixel AUROC (raw scores), counts and score range."""
    ranked = join_null_safe(images, image_score(scores), ["image_id"])
    by_image = auroc(ranked, "image_score", "label").select("auroc").scalar()
    by_pixel = pixel_auroc(scores, masks, grid, size, unknown=unknown).select("auroc").scalar()
    counts = score_inventory(ranked, "image_score", "label")
    return counts.withColumns({"image_auroc": by_image, "pixel_auroc": by_pixel})
