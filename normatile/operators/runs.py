"""Analytics over metric logs ``(run_id, epoch, step, key, value)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normatile.operators.ordering import running_totals
from normatile.operators.rules import CheckpointGate, EarlyStop, scan_rule


def epoch_means(log: DataFrame, keys: Sequence[str] = ("run_id", "epoch", "key")) -> DataFrame:
    """Mean of each logged value per epoch."""
    return log.groupBy(*keys).agg(F.avg("value").alias("mean_value"), F.count("value").alias("n_steps"))


def running_loss(log: DataFrame, every: int = 10, keys: Sequence[str] = ("run_id", "epoch", "key")) -> DataFrame:
    """Mean of all values since the epoch began, given out at every ``every``-th step.

    One pass of running totals gives the sum and the step count; an epoch may hold any number of
    steps.
    """
    totals = running_totals(
        log, list(keys), ["step"], {"_sum": F.col("value"), "_n": F.lit(1).cast("long")}
    )
    return totals.where(F.col("_n") % every == 0).select(
        *keys, "step", F.col("_n").alias("n_steps"), (F.col("_sum") / F.col("_n")).alias("running_mean")
    )


def run_summary(log: DataFrame, best_of: dict[str, str] | None = None) -> DataFrame:
    """Last, lowest and highest value of each key, and the step where the best one was logged.

    ``best_of`` names the keys for which lower is better ('min'); others take the maximum.
    """
    lower = [k for k, mode in (best_of or {}).items() if mode == "min"]
    merit = F.when(F.col("key").isin(lower), -F.col("value")).otherwise(F.col("value")) if lower else F.col("value")
    at_best = F.max(F.struct(merit.alias("m"), (-F.col("step")).alias("s"), F.col("value").alias("v")))
    out = log.groupBy("run_id", "key").agg(
        F.max_by("value", "step").alias("last_value"), at_best.alias("_best"), F.count("*").alias("n_logged")
    )
    return out.select(
        "run_id", "key", "last_value", F.col("_best.v").alias("best_value"),
        (-F.col("_best.s")).alias("best_step"), "n_logged",
    )


def early_stopping(
    epochs: DataFrame, metric: str, patience: int = 7, mode: str = "max", min_delta: float = 0.0,
    keys: Sequence[str] = ("run_id",), epoch: str = "epoch",
) -> DataFrame:
    """Counter, best value and stop flag after each epoch: ``keys, epoch, metric, best, bad_epochs, stopped``.

    The first defined value sets the best. A value counts as better only if it beats the best by
    more than ``min_delta``. Undefined epochs change nothing, nor do epochs after the stop. A run of any
    length is spread over slices (``rules.scan_rule``).
    """
    return scan_rule(epochs, keys, epoch, EarlyStop(metric, patience, mode, min_delta))


def checkpoint_gate(
    epochs: DataFrame, image_metric: str = "image_metric", patch_metric: str = "patch_metric",
    tolerance: float = 0.02, keys: Sequence[str] = ("run_id",), epoch: str = "epoch",
) -> DataFrame:
    """Which epochs save a checkpoint, and the pair of best metrics after each.

    An epoch saves if one metric improves and the other improves, stays, or falls by no more than
    ``tolerance``. Saving replaces both bests, so the one that fell is lowered. A column named
    ``stopped`` with true ends the run: the stopping epoch and later ones never save.
    """
    stopped = "stopped" if "stopped" in epochs.columns else None
    return scan_rule(epochs, keys, epoch, CheckpointGate(image_metric, patch_metric, tolerance, stopped))
