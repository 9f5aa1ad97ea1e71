"""Normal profiles: mean and covariance of normal patches, per group, at any vector width.

A profile row is ``(group..., n, mu, sigma, sigma_inv)``. A group without a row has no profile.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from normatile.operators.ordering import join_null_safe, last_n, running_totals
from normatile.operators.vectors import rows_by_key, sum_vector, to_list_array, to_matrix
from normatile.session import materialize

REGULARIZATION = 1e-6
# A task flushes its partial sums once they exceed this size; sums are additive, so the result is
# the same, and memory stays bounded however many groups a task meets.
PARTIAL_BYTES = 256 * 2**20
PROFILE_FIELDS = "n bigint, mu array<double>, sigma array<array<double>>, sigma_inv array<array<double>>"


def _group_schema(df: DataFrame, group: Sequence[str]) -> str:
    return "".join(f"`{g}` {df.schema[g].dataType.simpleString()}, " for g in group)


def _by_group(df: DataFrame, group: list[str], fn) -> DataFrame:
    """``mapInArrow`` with rows ``(group..., _row, _vec)`` out; ``fn`` yields (keys, row numbers, matrix)."""
    schema = df.select(*group).schema.add("_row", T.IntegerType()).add("_vec", T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: list[pa.DataType] = []

        def seen() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    types[:] = [batch.column(i).type for i in range(len(group))]
                    yield batch

        for key, numbers, table in fn(seen()):
            columns = [pa.array([value] * len(numbers), types[i]) for i, value in enumerate(key)]
            columns += [pa.array(np.asarray(numbers, np.int32)), to_list_array(table)]
            yield pa.RecordBatch.from_arrays(columns, names=[*group, "_row", "_vec"])

    return df.mapInArrow(run, schema)


def _merge(a: tuple, b: tuple) -> tuple:
    """Counts, means and centred products of two sets of rows together."""
    n, d = a[0] + b[0], b[1] - a[1]
    return n, a[1] + d * (b[0] / n), a[2] + b[2] + np.outer(d, d) * (a[0] * b[0] / n)


def moment_sums(df: DataFrame, group: Sequence[str], features: str) -> DataFrame:
    """Centred moments per group as additive rows ``(group..., _row, _vec)``.

    Each task merges (n, mean, centred products) of its Arrow batches pairwise, one matmul per batch,
    so nothing is lost however far the features lie from zero. The tasks' products are then summed;
    their means, one short row per task and group, are taken relative to the group's centre and add
    the part between tasks. Row -2 is the centre, -1 holds n and the sum of the shifted means, row i
    the products of dimension i. Vectors that are NULL or hold NULL, NaN or infinity are left out.
    """
    group = list(group)

    def partials(batches):
        state: dict[tuple, tuple] = {}

        def flush():
            for key, (n, mean, products) in state.items():
                yield key, [-1, *range(len(mean))], np.vstack([np.concatenate([[n], mean])[None, :], np.pad(products, ((0, 0), (0, 1)))])
            state.clear()

        for batch in batches:
            x = to_matrix(batch.column(len(group)))
            for key, rows in rows_by_key([batch.column(i) for i in range(len(group))], len(x)):
                part = x[rows]
                part = part[np.isfinite(part).all(axis=1)]
                if len(part):
                    mean = part.mean(axis=0)
                    centred = part - mean
                    new = (float(len(part)), mean, centred.T @ centred)
                    state[key] = _merge(state[key], new) if key in state else new
            if sum(s[2].nbytes for s in state.values()) > PARTIAL_BYTES:
                yield from flush()
        yield from flush()

    return combined_moments(
        materialize(_by_group(df.where(F.col(features).isNotNull()).select(*group, features), group, partials), "moments"), group
    )


def combined_moments(parts: DataFrame, group: Sequence[str]) -> DataFrame:
    """Moments of several sets of rows together: ``parts`` has rows (group..., _row, _vec) of each set.

    Row -1 of a set holds its n and mean, row i its products of dimension i about its own mean (padded
    by one). The result has the rows of ``moment_sums``. ``parts`` should be a stored table.
    """
    group = list(group)
    means = parts.where("_row = -1")
    n, mean = F.get("_vec", F.lit(0)), F.slice("_vec", 2, F.size("_vec"))
    weighted = means.select(*group, n.alias("_n"), F.transform(mean, lambda v: v * n).alias("_w"))
    center = weighted.groupBy(*group).agg(F.sum("_n").alias("_n"), sum_vector("_w").alias("_w"))
    center = center.select(*group, F.transform("_w", lambda v: v / F.col("_n")).alias("_c"))
    beside = join_null_safe(means, center, group).select(*group, "_vec", "_c")

    def between(batches):
        for batch in batches:
            table, c = to_matrix(batch.column(len(group))), to_matrix(batch.column(len(group) + 1))
            weight, shift = table[:, :1], table[:, 1:] - c
            for key, rows in rows_by_key([batch.column(i) for i in range(len(group))], len(table)):
                w, d = weight[rows], shift[rows]
                products = np.pad((d * w).T @ d, ((0, 0), (0, 1)))
                yield key, [-1, *range(d.shape[1])], np.vstack([np.concatenate([w.sum(axis=0), (d * w).sum(axis=0)])[None, :], products])

    rest = _by_group(beside, group, between)
    # The centre's row is padded to the width of the others.
    centers = center.select(*group, F.lit(-2).alias("_row"), F.concat("_c", F.array(F.lit(0.0))).alias("_vec"))
    rows = parts.select(*group, "_row", "_vec").where("_row >= 0").unionByName(rest).unionByName(centers)
    return rows.groupBy(*group, "_row").agg(sum_vector("_vec").alias("_vec"))


def _finish(sums: pd.DataFrame, reg: float, floor_one: bool) -> tuple[int, np.ndarray, np.ndarray, np.ndarray] | None:
    table = np.stack([np.asarray(v, np.float64) for v in sums.sort_values("_row")["_vec"]])
    n, shift = table[1, 0], table[1, 1:]
    divisor = max(n - 1, 1) if floor_one else n - 1
    if divisor <= 0:
        return None
    mu = table[0, :-1] + shift / n
    sigma = (table[2:, :-1] - np.outer(shift, shift) / n) / divisor
    sigma = (sigma + sigma.T) / 2.0 + reg * np.eye(len(mu))
    return int(n), mu, sigma, np.linalg.pinv(sigma, hermitian=True) if reg == 0 else np.linalg.inv(sigma)


def fit_profile(
    patches: DataFrame,
    group: Sequence[str] = (),
    features: str = "embedding",
    reg: float = REGULARIZATION,
    floor_one: bool = False,
) -> DataFrame:
    """Mean, covariance (n - 1) plus ``reg`` on the diagonal, and its inverse, per group.

    A group of one row has no covariance and gets no profile, unless ``floor_one`` divides by
    max(n - 1, 1) as the running buffer statistics do. The last step handles width + 2 rows per
    group, whatever the number of patches was.
    """
    group, reg = list(group), float(reg)
    keyed = patches if group else patches.withColumn("_all", F.lit(0))
    keys = group or ["_all"]
    out = finished_profile(moment_sums(keyed, keys, features), keys, reg, floor_one)
    return out if group else out.drop("_all")


def finished_profile(sums: DataFrame, keys: Sequence[str], reg: float, floor_one: bool = False) -> DataFrame:
    """Profiles from the rows of ``moment_sums``."""
    keys = list(keys)

    def finish(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        done = _finish(rows, reg, floor_one)
        if done is None:
            return pd.DataFrame(columns=[*keys, "n", "mu", "sigma", "sigma_inv"])
        n, mu, sigma, inverse = done
        row = dict(zip(keys, key)) | {
            "n": n, "mu": mu.tolist(), "sigma": sigma.tolist(), "sigma_inv": inverse.tolist()
        }
        return pd.DataFrame([row])

    return sums.groupBy(*keys).applyInPandas(finish, _group_schema(sums, keys) + PROFILE_FIELDS)


def narrow_moments(df: DataFrame, group: Sequence[str], dims: Sequence[Column]) -> DataFrame:
    """Mean and covariance of a few columns with built-in aggregates: ``n, mu, sigma``."""
    names = [f"_d{i}" for i in range(len(dims))]
    cols = df.select(*group, *[d.cast("double").alias(n) for d, n in zip(dims, names)])
    aggs = [F.count("*").alias("n"), F.array(*[F.avg(n) for n in names]).alias("mu")]
    rows = [
        F.array(*[F.coalesce(F.covar_samp(a, b), F.lit(0.0)) for b in names]) for a in names
    ]
    return cols.groupBy(*group).agg(*aggs, F.array(*rows).alias("sigma"))


def add_normal(patches: DataFrame, label: str = "y") -> DataFrame:
    """Only patches labelled normal may enter the statistics."""
    return patches.where(F.col(label) == 0)


def buffer_statistics(
    arrivals: DataFrame,
    n: int = 10000,
    step: str = "step",
    within: Sequence[str] = ("image_id", "patch_idx"),
    group: Sequence[str] = (),
    features: str = "embedding",
) -> DataFrame:
    """Statistics of the last ``n`` normal patches in arrival order; an empty buffer gives no row."""
    recent = last_n(arrivals, n, step, within, group)
    return fit_profile(recent, group, features, reg=0.0, floor_one=True)


def refit_buffers(
    arrivals: DataFrame,
    every: int,
    n: int,
    step: str = "step",
    within: Sequence[str] = ("image_id", "patch_idx"),
    group: Sequence[str] = (),
) -> DataFrame:
    """For each refit step (0, every, 2 * every, ...) the ``n`` latest rows known at that step.

    Adds ``refit``, the 0-based refit number. Rows are ranked once; a refit's buffer is a range of
    ranks, found by an equi-join on rank blocks of length ``n`` (a range meets at most two blocks).
    """
    group = list(group)
    keys = arrivals.select(*group, step, *within)
    ranked = running_totals(keys, group, [step, *within], {"_rank": F.lit(1).cast("long")})
    refit_of = F.ceil(F.col(step) / float(every)).cast("long")
    reached = ranked.groupBy(*group, refit_of.alias("refit")).agg(F.max("_rank").alias("_reached"))
    last_step = arrivals.groupBy(*group).agg(F.max(step).alias("_last"))
    # A refit whose interval brought no new rows sees the buffer of the refit before it.
    span = last_step.select(
        *group, F.explode(F.sequence(F.lit(0), F.floor(F.col("_last") / every))).alias("refit")
    )
    carried = W.partitionBy(*(group or [F.lit(0)])).orderBy("refit").rowsBetween(W.unboundedPreceding, 0)
    ends = (
        join_null_safe(span, reached, [*group, "refit"], "left")
        .withColumn("_reached", F.max("_reached").over(carried))
        .where(F.col("_reached").isNotNull())
    )
    first = F.greatest(F.lit(1), F.col("_reached") - n + 1)
    blocks = ends.withColumn(
        "_block", F.explode(F.sequence(F.floor(first / n), F.floor(F.col("_reached") / n)))
    )
    placed = ranked.withColumn("_block", F.floor(F.col("_rank") / n))
    hits = join_null_safe(placed, blocks, [*group, "_block"]).where(
        (F.col("_rank") <= F.col("_reached")) & (F.col("_rank") > F.col("_reached") - n)
    )
    members = hits.select(*group, step, *within, "refit")
    return join_null_safe(arrivals, members, [*group, step, *within])


def ema_profile(
    arrivals: DataFrame,
    every: int = 100,
    n: int = 10000,
    momentum: float = 0.1,
    step: str = "step",
    within: Sequence[str] = ("image_id", "patch_idx"),
    group: Sequence[str] = (),
    features: str = "embedding",
    reg: float = REGULARIZATION,
) -> DataFrame:
    """Profile after all refits: the first is taken as it is, later ones are averaged in.

    Exponential averaging is linear, so the state after refit T is a weighted sum of all refits:
    weight (1 - m)^T for refit 0 and m (1 - m)^(T - k) for refit k > 0. That needs one aggregate
    and no sequential pass. The covariance is averaged and inverted once.
    """
    group, reg = list(group), float(reg)
    keyed = arrivals if group else arrivals.withColumn("_all", F.lit(0))
    keys = group or ["_all"]
    buffers = refit_buffers(keyed, every, n, step, within, keys)
    refits = materialize(fit_profile(buffers, [*keys, "refit"], features, reg), "refits")

    out = averaged_profile(refits, keys, momentum)
    return out if group else out.drop("_all")


def averaged_profile(refits: DataFrame, keys: Sequence[str], momentum: float) -> DataFrame:
    """Exponential average of the profiles ``(keys..., refit, n, mu, sigma)`` of each group in order of ``refit``.

    The first one is taken as it is; a profile reached earlier may stand there and be carried on.
    """
    keys = list(keys)
    # Refits that could not be fitted (a single row so far) are skipped, so number the fitted ones.
    by_refit = W.partitionBy(*keys).orderBy("refit")
    numbered = refits.select(
        *keys, "n", "mu", "sigma", (F.row_number().over(by_refit) - 1).alias("_k")
    )
    last = numbered.groupBy(*keys).agg(F.max("_k").alias("_t"), F.max_by("n", "_k").alias("n"))
    m = float(momentum)
    weight = F.pow(F.lit(1.0 - m), F.col("_t") - F.col("_k")) * F.when(F.col("_k") > 0, m).otherwise(1.0)
    rows = (
        join_null_safe(numbered.drop("n"), last, keys)
        .withColumn("_w", weight)
        .select(*keys, "n", "_t", "_w", F.posexplode(F.concat(F.array("mu"), F.col("sigma"))).alias("_row", "_raw"))
        .select(*keys, "n", "_t", "_row", F.transform("_raw", lambda v: v * F.col("_w")).alias("_vec"))
    )
    state = rows.groupBy(*keys, "_row").agg(
        sum_vector("_vec").alias("_vec"), F.max("n").alias("n"), F.max("_t").alias("_t")
    )

    def finish(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        table = np.stack([np.asarray(v, np.float64) for v in part.sort_values("_row")["_vec"]])
        sigma = table[1:]
        row = dict(zip(keys, key)) | {
            "version": int(part["_t"].iloc[0]), "n": int(part["n"].iloc[0]), "mu": table[0].tolist(),
            "sigma": sigma.tolist(), "sigma_inv": np.linalg.inv(sigma).tolist(),
        }
        return pd.DataFrame([row])

    schema = _group_schema(refits, keys) + "version bigint, " + PROFILE_FIELDS
    return state.groupBy(*keys).applyInPandas(finish, schema)


def sliding_refits(
    known: DataFrame,
    every: int,
    n: int,
    step: str = "step",
    within: Sequence[str] = ("image_id", "patch_idx"),
    group: Sequence[str] = ("category",),
    features: str = "embedding",
    reg: float = REGULARIZATION,
    done: DataFrame | None = None,
) -> DataFrame:
    """``(group..., refit, n, mu, sigma, sigma_inv)`` of all refits that the rows of ``known`` allow, at once.

    Refit r of a group sees the last ``n`` of its rows up to step r * every; ``done`` (group..., done)
    names the last refit that was made before, and ``known`` then needs to hold the last ``n`` rows of
    that time and all rows since. The places where some buffer begins or ends cut a group's rows into
    segments. A row enters the moments of its one segment; a buffer is a run of whole segments, and
    its moments are merged from theirs. The number of jobs does not grow with the number of refits.
    A refit over fewer than two rows has no row.
    """
    group, within = list(group), list(within)
    ranked = running_totals(known.select(*group, step, *within), group, [step, *within], {"_rank": F.lit(1).cast("long")})
    ranked = materialize(ranked.withColumn("refit", F.ceil(F.col(step) / float(every)).cast("long")), "ranked")
    last = known.groupBy(*group).agg(F.floor(F.max(step) / every).cast("long").alias("_last"))
    last = last.withColumn("done", F.lit(-1).cast("long")) if done is None else join_null_safe(last, done, group, "left")
    asked = last.withColumn("done", F.coalesce("done", F.lit(-1))).where(F.col("_last") > F.col("done"))
    asked = asked.select(*group, F.explode(F.sequence(F.col("done") + 1, F.col("_last"))).alias("refit"), "done")
    # Rows that came before the first refit asked for count with it.
    seen = join_null_safe(ranked.groupBy(*group, "refit").agg(F.count("*").alias("_new")), last.select(*group, "done"), group)
    seen = seen.groupBy(*group, F.greatest("refit", F.coalesce("done", F.lit(-1)) + 1).alias("refit")).agg(F.sum("_new").alias("_new"))
    ends = join_null_safe(asked.select(*group, "refit"), seen, [*group, "refit"], "left")
    ends = running_totals(ends, group, ["refit"], {"_high": F.coalesce("_new", F.lit(0))})
    ends = ends.select(*group, "refit", F.greatest(F.lit(0), F.col("_high") - n).alias("_low"), "_high").where("_high > 0")
    ends = materialize(ends, "refit-ends")

    # A cut stands behind the row of its rank: its running count numbers the segments.
    cuts = ends.select(*group, F.explode(F.array("_low", "_high")).alias("_rank")).distinct()
    nothing = [F.lit(None).cast(ranked.schema[c].dataType).alias(c) for c in (step, *within)]
    both = ranked.select(*group, "_rank", F.lit(0).alias("_cut"), step, *within)
    both = both.unionByName(cuts.select(*group, "_rank", F.lit(1).alias("_cut"), *nothing))
    numbered = materialize(running_totals(both, group, ["_rank", "_cut"], {"_segment": F.col("_cut").cast("long")}), "segments")
    rows = numbered.where("_cut = 0 and _segment > 0").select(*group, step, *within, "_segment")
    tagged = join_null_safe(known, rows, [*group, step, *within])
    segments = materialize(segment_parts(moment_sums(tagged, [*group, "_segment"], features), [*group, "_segment"]), "segment-parts")

    places = numbered.where("_cut = 1").select(*group, "_rank", "_segment")
    low = join_null_safe(ends, places.withColumnsRenamed({"_rank": "_low", "_segment": "_first"}), [*group, "_low"])
    spans = join_null_safe(low, places.withColumnsRenamed({"_rank": "_high", "_segment": "_stop"}), [*group, "_high"])
    spans = spans.select(*group, "refit", F.explode(F.sequence("_first", F.col("_stop") - 1)).alias("_segment"))
    parts = materialize(join_null_safe(spans, segments, [*group, "_segment"]).drop("_segment"), "refit-parts")
    return finished_profile(combined_moments(parts, [*group, "refit"]), [*group, "refit"], reg)


def segment_parts(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``moment_sums`` as parts for ``combined_moments``: n and mean in row -1, products about that mean."""
    keys = list(keys)

    def centred(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        table = np.stack([np.asarray(v, np.float64) for v in rows.sort_values("_row")["_vec"]])
        n, shift = table[1, 0], table[1, 1:]
        products = table[2:, :-1] - np.outer(shift, shift) / n
        out = np.vstack([np.concatenate([[n], table[0, :-1] + shift / n])[None, :], np.pad(products, ((0, 0), (0, 1)))])
        frame = pd.DataFrame({k: [v] * len(out) for k, v in zip(keys, key)})
        return frame.assign(_row=np.arange(-1, len(out) - 1, dtype=np.int32), _vec=list(out))

    return sums.groupBy(*keys).applyInPandas(centred, _group_schema(sums, keys) + "_row int, _vec array<double>")
