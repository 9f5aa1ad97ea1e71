"""Step-wise pruning of patches: score the survivors, keep the best n(t), repeat."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normatile.functions.schedules import keep_counts
from normatile.functions.scores import fuse_for_selection
from normatile.operators.attention import attention_logits, importance, softmax_weights
from normatile.operators.ordering import join_null_safe, top_k
from normatile.operators.vectors import centroid, to_matrix
from normatile.session import materialize

# Images with more patches than this are pruned by distributed aggregates instead of a window.
WINDOW_PATCHES = 65536


def active_steps(n_patches: int, t_steps: int, n_max: int, n_min: int, on_noop: str = "skip", **shape) -> list[int]:
    """The keep counts that really remove patches from an image of ``n_patches``.

    ``on_noop="stop"`` ends at the first step that has nothing to remove; ``"skip"`` goes on.
    """
    if on_noop not in ("skip", "stop"):
        raise ValueError(f"on_noop must be 'skip' or 'stop', got {on_noop!r}")
    left, steps = n_patches, []
    for wanted in keep_counts(t_steps, n_max, n_min, **shape):
        if left <= wanted:
            if on_noop == "stop":
                break
            continue
        steps.append(wanted)
        left = wanted
    return steps


def prune_patches(
    scored: DataFrame,
    n_queries: int | None = None,
    n_max: int = 256,
    n_min: int = 32,
    t_steps: int = 8,
    w: float = 0.4,
    p1: float = 0.5,
    p2: float = 2.0,
    alpha: float = 0.4,
    beta: float = 0.4,
    on_noop: str = "skip",
    key: str = "image_id",
    window_patches: int = WINDOW_PATCHES,
) -> DataFrame:
    """Patches of ``(image, patch_idx, logits, deviation)`` that survive all steps; a NULL image key is an image.

    A patch with a NULL, NaN or infinite logit or deviation goes before all others and gives them its attention.

    With fixed queries a step changes only the softmax denominators, so vectors are not needed.
    Images of ordinary size take all steps inside one shuffle by image. Images with more patches
    than ``window_patches`` (none, if patches come from a model grid) take each step by combined
    aggregates and a join, so no task holds such an image. Both use every logit; ``n_queries`` may
    state how many there are, and a wrong number is an error.
    """
    scored = materialize(scored.select(key, "patch_idx", "logits", "deviation"), "scored")
    counts = scored.groupBy(key).agg(F.count("*").alias("_n"), F.min(F.size("logits")).alias("_low"), F.max(F.size("logits")).alias("_high"))
    largest, low, high = counts.agg(F.max("_n"), F.min("_low"), F.max("_high")).first()
    if largest is None:
        return scored.select(key, "patch_idx")
    if n_queries is not None and (low, high) != (n_queries, n_queries):
        raise ValueError(f"{low} to {high} logits per patch, not {n_queries}")
    shape = {"w": w, "p1": p1, "p2": p2}
    steps = keep_counts(t_steps, n_max, n_min, **shape)
    if on_noop not in ("skip", "stop"):
        raise ValueError(f"on_noop must be 'skip' or 'stop', got {on_noop!r}")
    if on_noop == "stop":
        # An image too small for the first step keeps every patch. The others share one course: they
        # go on until the schedule asks for as many patches as the step before.
        stall = next((i for i in range(1, len(steps)) if steps[i] >= steps[i - 1]), len(steps))
        starts = F.col("_n") > steps[0] if steps else F.lit(False)
        scored = join_null_safe(scored, counts.select(key, starts.alias("_live")), [key])
        idle = scored.where(~F.col("_live")).select(key, "patch_idx")
        scored = scored.where("_live").drop("_live")
        steps = steps[:stall]
    if largest <= window_patches:
        kept = _by_image(scored, steps, alpha, beta, key)
    else:
        sized = join_null_safe(scored, counts.select(key, (F.col("_n") > window_patches).alias("_big")), [key])
        kept = _by_image(sized.where(~F.col("_big")).drop("_big"), steps, alpha, beta, key).unionByName(
            prune_with(sized.where("_big").drop("_big"), steps, fused_selection(alpha, beta), key)
        )
    return kept.unionByName(idle) if on_noop == "stop" else kept


def _by_image(scored: DataFrame, steps: list[int], alpha: float, beta: float, key: str) -> DataFrame:
    """All steps of an image in one pass over its logits: a matrix of patches by queries."""

    def prune(rows: pa.Table) -> pa.Table:
        index = rows["patch_idx"].to_numpy()
        logits = to_matrix(rows["logits"].combine_chunks())
        deviation = rows["deviation"].cast(pa.float64()).to_numpy()
        # A patch without a score is the first to go and takes no attention from the others.
        given = rows["logits"].is_valid().to_numpy()
        sound = given & np.isfinite(logits).all(axis=1) & np.isfinite(deviation)
        left = np.arange(len(index))
        for keep in steps:
            if keep >= len(left):
                continue
            score = np.full(len(left), -np.inf)
            good = sound[left]
            if good.any():
                own = logits[left[good]]
                e = np.exp(own - own.max(axis=0))
                score[good] = alpha * (e / e.sum(axis=0)).sum(axis=1) + beta * deviation[left[good]]
            left = left[np.lexsort((index[left], -score))[:keep]]
        return rows.select([key, "patch_idx"]).take(pa.array(left))

    return scored.groupBy(key).applyInArrow(prune, scored.select(key, "patch_idx").schema)


def fused_selection(alpha: float = 0.4, beta: float = 0.4) -> Callable[[DataFrame], DataFrame]:
    """The default scorer: softmax attention over the survivors plus their deviation."""

    def score(survivors: DataFrame) -> DataFrame:
        key = survivors.columns[0]
        known = F.coalesce(F.abs("deviation") < float("inf"), F.lit(False))
        # A patch without a deviation takes no attention from the others; a NULL score goes first.
        scored = survivors.withColumn("logits", F.when(known, F.col("logits")))
        weights = softmax_weights(scored, [key]).withColumn("_attended", importance())
        fused = weights.withColumn("_score", fuse_for_selection(F.col("_attended"), F.col("deviation"), alpha, beta))
        attended = fused.select(key, "patch_idx", "_score")
        return join_null_safe(survivors, attended, [key, "patch_idx"])

    return score


def prune_with(
    patches: DataFrame, steps: list[int], score: Callable[[DataFrame], DataFrame], key: str = "image_id"
) -> DataFrame:
    """Pruning with a user's scorer: ``score`` adds ``_score`` to the surviving rows at each step.

    The scorer sees every column of ``patches``, so it may recompute queries or attention from
    vectors. Survivors are stored after each step, which keeps the plan from growing with t.
    """
    left = materialize(patches, "survivors")
    for keep in steps:
        best = top_k(score(left), [key], "_score", "patch_idx", keep)
        left = materialize(best.select(*patches.columns), "survivors")
    return left.select(key, "patch_idx")


def prune_refreshed(
    patches: DataFrame,
    queries: DataFrame,
    deviation: DataFrame,
    steps: list[int],
    refresh: Callable[[DataFrame, DataFrame, DataFrame], DataFrame],
    alpha: float = 0.4,
    beta: float = 0.4,
    key: str = "image_id",
) -> tuple[DataFrame, DataFrame]:
    """Pruning whose queries are renewed at every step: survivors, and the queries after the last one.

    ``refresh(survivors, centroid, queries)`` gives the next queries from those of the step before; the
    centroid of the survivors takes the place of the class token. ``deviation`` holds a number for each
    (image, patch_idx). After the last step the queries are renewed once more: with them a final
    ``attention`` pass can score all patches. Survivors and queries are stored after each step.
    """
    score = fused_selection(alpha, beta)
    left = materialize(patches.select(key, "patch_idx", "embedding"), "survivors")
    deviation = deviation.select(key, "patch_idx", "deviation")
    for keep in steps:
        queries = materialize(refresh(left, centroid(left, [key]), queries), "queries")
        logits = materialize(attention_logits(left, queries, key), "logits")
        best = top_k(score(join_null_safe(logits, deviation, [key, "patch_idx"])), [key], "_score", "patch_idx", keep)
        left = materialize(join_null_safe(left, best.select(key, "patch_idx"), [key, "patch_idx"]), "survivors")
    queries = materialize(refresh(left, centroid(left, [key]), queries), "queries")
    return left.select(key, "patch_idx"), queries
