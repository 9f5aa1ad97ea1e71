"""Closed-form schedules over a step column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lr_factor(step: Column, warmup_steps: Column | int, total_steps: Column | int) -> Column:
    """Linear warm-up, then half a cosine down to zero."""
    warmup = warmup_steps if isinstance(warmup_steps, Column) else F.lit(warmup_steps)
    total = total_steps if isinstance(total_steps, Column) else F.lit(total_steps)
    rising = step.cast("double") / F.greatest(F.lit(1), warmup)
    progress = (step - warmup).cast("double") / F.greatest(F.lit(1), total - warmup)
    return F.when(step < warmup, rising).otherwise(0.5 * (1.0 + F.cos(F.pi() * progress)))


def keep_count(
    t: Column,
    n_max: int | Column = 256,
    n_min: int | Column = 32,
    t_steps: int = 15,
    w: float = 0.4,
    p1: float = 0.5,
    p2: float = 2.0,
) -> Column:
    """Patches kept at pruning step ``t``: a concave and a convex decay, mixed by ``w``."""
    top = n_max if isinstance(n_max, Column) else F.lit(n_max)
    bottom = n_min if isinstance(n_min, Column) else F.lit(n_min)
    left = 1.0 - F.least(t, F.lit(t_steps)).cast("double") / float(t_steps)
    mix = w * F.pow(left, F.lit(float(p1))) + (1.0 - w) * F.pow(left, F.lit(float(p2)))
    return F.when(t >= t_steps, bottom).otherwise(F.floor(bottom + (top - bottom) * mix)).cast("long")


def keep_counts(t_steps: int, n_max: int, n_min: int, w: float = 0.4, p1: float = 0.5, p2: float = 2.0) -> list[int]:
    """The same schedule as plain numbers, for loops that are planned on the driver."""
    out = []
    for t in range(t_steps):
        left = 1.0 - t / t_steps
        out.append(int(n_min + (n_max - n_min) * (w * left**p1 + (1.0 - w) * left**p2)))
    return out


def global_step(epoch: Column, steps_per_epoch: Column | int, step: Column) -> Column:
    """1-based step number over all epochs, from a 1-based epoch and a 0-based step."""
    per_epoch = steps_per_epoch if isinstance(steps_per_epoch, Column) else F.lit(steps_per_epoch)
    return (epoch - 1) * per_epoch + step + 1
