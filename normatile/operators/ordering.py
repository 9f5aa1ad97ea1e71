"""Ordering without a single-task window: running totals, positions, splits, batches, last-n.

A window ordered over a whole table, or over a group that holds a large share of it, runs in one
task. ``running_totals`` range-partitions by (group, order) instead, so a large group is spread over
as many slices as its rows need, and carries only one subtotal per slice boundary across slices.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from normatile.functions.seeded import shuffle_key
from normatile.session import materialize

OrderKey = str | Column


def _column(key: OrderKey) -> Column:
    return F.col(key) if isinstance(key, str) else key


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", broadcast: bool = False) -> DataFrame:
    """Join on ``keys`` with NULL equal to NULL; the left side's keys stay, then the right side's other columns."""
    keys = list(keys)
    named = right.select(*[F.col(k).alias(f"_right_{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & left[k].eqNullSafe(F.col(f"_right_{i}"))
    joined = left.join(F.broadcast(named) if broadcast else named, same, how)
    return joined.drop(*[f"_right_{i}" for i in range(len(keys))])


def running_totals(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[OrderKey],
    totals: Mapping[str, Column],
    ranged: bool = False,
) -> DataFrame:
    """Add inclusive running sums of ``totals`` within ``group`` along ``order``.

    ``ranged`` says that ``df`` lies in range partitions of (group, order), in that order, and is not dealt again.

    ``order`` must be a total order inside a group; a NULL group key is a group. Slices are stored
    before use, so that the slice number of a row cannot change if a task is run again. All columns
    of ``df`` are stored with them: pass narrow rows.
    """
    group = list(group)
    order_cols = [_column(key) for key in order]
    parts = {name: f"_part_{i}" for i, name in enumerate(totals)}
    sliced = df.withColumns({parts[name]: value for name, value in totals.items()})
    if not ranged:
        sliced = sliced.repartitionByRange(*[F.col(g) for g in group], *order_cols)
    sliced = materialize(sliced.withColumn("_slice", F.spark_partition_id()), "slices")

    # Each slice starts with at most one group that began in an earlier slice, so the table of
    # carried subtotals has fewer rows than there are slices: safe to broadcast at any data size.
    across = W.partitionBy(*(group or [F.lit(0)])).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    subtotals = sliced.groupBy("_slice", *group).agg(*[F.sum(p).alias(p) for p in parts.values()])
    number = F.row_number().over(W.partitionBy(*(group or [F.lit(0)])).orderBy("_slice"))
    carried = subtotals.select(
        "_slice", *group, *[F.sum(p).over(across).alias(f"{p}_before") for p in parts.values()], number.alias("_nth")
    ).where("_nth > 1").drop("_nth")

    inside = (
        W.partitionBy("_slice", *group).orderBy(*order_cols).rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    local = sliced.withColumns({f"{p}_local": F.sum(p).over(inside) for p in parts.values()})
    joined = join_null_safe(local, carried, ["_slice", *group], "left", broadcast=True)
    out = {
        name: F.col(f"{p}_local") + F.coalesce(F.col(f"{p}_before"), F.lit(0))
        for name, p in parts.items()
    }
    return joined.select(*df.columns, *[value.alias(name) for name, value in out.items()])


def with_position(
    df: DataFrame, order: Sequence[OrderKey], group: Sequence[str] = (), name: str = "position"
) -> DataFrame:
    """Add the 0-based position of each row within ``group`` along ``order``."""
    ranked = running_totals(df, group, order, {name: F.lit(1).cast("long")})
    return ranked.withColumn(name, F.col(name) - 1)


def group_sizes(df: DataFrame, group: Sequence[str], name: str = "group_size") -> DataFrame:
    """Attach the number of rows of each group; with no group, of the table."""
    if not group:
        size = df.agg(F.count("*").alias(name)).scalar()
        return df.withColumn(name, size)
    return join_null_safe(df, df.groupBy(*group).agg(F.count("*").alias(name)), group)


def permutation_split(
    df: DataFrame,
    key: str,
    seed: int = 42,
    n_val: int | None = None,
    group: Sequence[str] = (),
    by_hash: bool = True,
) -> DataFrame:
    """Seeded permutation: the first rows become ``val``, the complement ``train``.

    ``n_val`` is clamped to [1, n - 1]; without it half of the rows (n // 2) go to validation.
    ``by_hash=False`` takes rows in key order, which any engine can reproduce.
    """
    order = [shuffle_key(seed, F.col(key)), F.col(key)] if by_hash else [F.col(key)]
    sized = group_sizes(with_position(df, order, group, "_position"), group, "_size")
    if n_val is None:
        quota = F.floor(F.col("_size") / 2)
    else:
        quota = F.greatest(F.lit(1), F.least(F.lit(n_val), F.col("_size") - 1))
    return sized.withColumn("part", F.when(F.col("_position") < quota, "val").otherwise("train")).drop(
        "_position", "_size"
    )


def assign_batches(
    df: DataFrame,
    key: str,
    batch_size: int,
    *,
    shuffle: bool = True,
    drop_last: bool = True,
    seed: int = 42,
    epoch: int = 1,
    group: Sequence[str] = (),
) -> DataFrame:
    """Number rows into batches of a fixed size; training shuffles and drops the partial batch."""
    order = [shuffle_key(seed, F.lit(epoch), F.col(key)), F.col(key)] if shuffle else [F.col(key)]
    out = with_position(df, order, group, "position").withColumn(
        "batch_id", F.floor(F.col("position") / batch_size)
    )
    if drop_last:
        sized = group_sizes(out, group, "_size")
        out = sized.where(F.col("batch_id") < F.floor(F.col("_size") / batch_size)).drop("_size")
    return out


def top_k(df: DataFrame, group: Sequence[str], score: OrderKey, tie: str, k: int) -> DataFrame:
    """The ``k`` highest-scored rows per group, ties broken by ``tie`` ascending.

    The rank filter sits on the window, so Spark keeps only k rows per group in every task before
    the shuffle and a large group never travels whole.
    """
    w = W.partitionBy(*group).orderBy(_column(score).desc(), F.col(tie))
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows without replacement, repeatable for a seed."""
    return df.orderBy(shuffle_key(seed, F.col(key)), F.col(key)).limit(n)


def shuffled(df: DataFrame, key: str, seed: int = 42, epoch: int = 1) -> DataFrame:
    """The table in a random order that is repeatable for (seed, epoch)."""
    return df.orderBy(shuffle_key(seed, F.lit(epoch), F.col(key)), F.col(key))


def head(df: DataFrame, order: Sequence[OrderKey], n: int) -> DataFrame:
    """The first ``n`` rows in order."""
    return df.orderBy(*[_column(key) for key in order]).limit(n)


def percentile_bounds(
    df: DataFrame, group: Sequence[str], value: str, low: float = 5.0, high: float = 95.0
) -> DataFrame:
    """Exact, linearly interpolated percentiles per group, for groups of any size.

    Equal values are counted first, then ranked with ``running_totals``; the two values around each
    wanted rank are picked by a conditional aggregate. No group's values meet in one buffer.
    """
    group = list(group)
    if not group:
        keyed = percentile_bounds(df.withColumn("_all", F.lit(0)), ["_all"], value, low, high)
        return keyed.drop("_all")
    if (low, high) == (0.0, 100.0):
        return df.groupBy(*group).agg(F.min(value).alias("p_low"), F.max(value).alias("p_high"))
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_n"))
    ranked = running_totals(counts, group, [value], {"_through": F.col("_n")})
    # Sizes come from the stored slices: Spark prunes the ranking from this branch.
    sized = join_null_safe(ranked, ranked.groupBy(*group).agg(F.sum("_n").alias("_size")), group)
    aggs = []
    for name, p in (("p_low", low), ("p_high", high)):
        rank = (F.col("_size") - 1) * F.lit(p / 100.0)
        for suffix, wanted in (("lo", F.floor(rank)), ("hi", F.ceil(rank))):
            at = (wanted >= F.col("_through") - F.col("_n")) & (wanted < F.col("_through"))
            aggs.append(F.max(F.when(at, F.col(value))).alias(f"_{name}_{suffix}"))
    picked = sized.groupBy(*group).agg(F.max("_size").alias("_size"), *aggs)
    out = []
    for name, p in (("p_low", low), ("p_high", high)):
        rank = (F.col("_size") - 1) * F.lit(p / 100.0)
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        out.append((lo + (hi - lo) * (rank - F.floor(rank))).alias(name))
    return picked.select(*group, *out)


def last_n(df: DataFrame, n: int, step: str, within: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """The last ``n`` rows by arrival: ``step``, then the columns ``within`` a step.

    Row counts alone say which steps are wholly inside the last ``n`` rows and which one step is cut.
    Only the rows of cut steps are ranked, by running totals over range slices: no window covers a
    group or a step, so a group or step that holds most rows is spread over many tasks.
    """
    group = list(group)
    counts = df.groupBy(*group, step).agg(F.count("*").alias("_rows"))
    newest = running_totals(counts, group, [F.desc(step)], {"_through": F.col("_rows")})
    alive = newest.where(F.col("_through") - F.col("_rows") < n)
    room = F.lit(n) - (F.col("_through") - F.col("_rows"))
    marked = join_null_safe(df, alive.select(*group, step, room.alias("_room"), (F.col("_through") > n).alias("_cut")), [*group, step])
    whole = marked.where(~F.col("_cut")).drop("_room", "_cut")
    ranked = running_totals(marked.where("_cut"), group, [F.desc(c) for c in (step, *within)], {"_rank": F.lit(1).cast("long")})
    return whole.unionByName(ranked.where(F.col("_rank") <= F.col("_room")).drop("_room", "_cut", "_rank"))
