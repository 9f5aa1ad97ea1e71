"""Patch scores from a profile, and image scores from patch scores."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from normatile.functions.scores import amplify
from normatile.operators.ordering import join_null_safe, top_k
from normatile.operators.vectors import rows_by_key, to_matrix
from normatile.session import materialize

# Models up to this size go to every executor; with larger ones the patches meet their group's model.
MODEL_BYTES = 64 * 2**20
# Rows of one group that a task scores at a time when models are not broadcast.
SHARE_ROWS = 50_000


def _distances(column: pa.Array, mu: np.ndarray, precision: np.ndarray) -> np.ndarray:
    centered = to_matrix(column) - mu
    return ((centered @ precision) * centered).sum(axis=1)


def mahalanobis(
    patches: DataFrame,
    profile: DataFrame,
    group: Sequence[str] = (),
    features: str = "embedding",
    gamma: float | None = 1.3,
    out: str = "deviation",
    model_bytes: int = MODEL_BYTES,
) -> DataFrame:
    """Squared Mahalanobis distance to the group's profile, raised to ``gamma``.

    Same rows at any width and model size: 0 where the group has no profile, NULL where the vector is
    NULL or holds NULL or NaN. A NULL group key is a group like any other. Two profiles of one group are an error.
    """
    group = list(group)
    profile = profile.select(*group, "mu", "sigma_inv")
    model, size = {}, 0
    # One pass over the models: they are kept while they fit, and left for the executors when they don't.
    for row in profile.toLocalIterator():
        size += 8 * len(row["mu"]) ** 2
        if size > model_bytes and group:
            break
        key = tuple(row[g] for g in group)
        if key in model:
            raise ValueError(f"two profiles for {key}")
        model[key] = (np.asarray(row["mu"], np.float64), np.asarray(row["sigma_inv"], np.float64))
    if size > model_bytes and group:
        raw = _dealt(patches, materialize(profile, "models"), group, features)
    elif not model:
        raw = patches.withColumn("_q", F.lit(None).cast("double")).withColumn("_known", F.lit(False))
    else:
        raw = _broadcast(patches, model, group, features)
    score = F.when(~F.col("_known"), 0.0).otherwise(amplify(F.nanvl("_q", F.lit(None).cast("double")), gamma))
    return raw.withColumn(out, score).drop("_q", "_known")


def _broadcast(patches: DataFrame, model: dict[tuple, tuple[np.ndarray, np.ndarray]], group: list[str], features: str) -> DataFrame:
    """Models of a checked size: each task looks its groups up."""
    shared = patches.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<q:double,known:boolean>")
    def distance(x: pa.Array, *keys: pa.Array) -> pa.Array:
        result, known = np.full(len(x), np.nan), np.zeros(len(x), bool)
        for label, rows in rows_by_key(keys, len(x)):
            if label in shared.value:
                result[rows] = _distances(x.take(pa.array(rows)), *shared.value[label])
                known[rows] = True
        return pa.StructArray.from_arrays([pa.array(result), pa.array(known)], ["q", "known"])

    scored = patches.withColumn("_d", distance(F.col(features), *[F.col(g) for g in group]))
    return scored.withColumns({"_q": F.col("_d.q"), "_known": F.col("_d.known")}).drop("_d")


def _dealt(patches: DataFrame, profile: DataFrame, group: list[str], features: str) -> DataFrame:
    """One shuffle of the patches, however many groups: a share of a group's rows meets its model."""
    shares = patches.groupBy(*group).agg(F.ceil(F.count("*") / SHARE_ROWS).alias("_shares"))
    dealt = join_null_safe(patches, shares, group).withColumn("_share", F.pmod(F.xxhash64(features, *group), F.col("_shares"))).drop("_shares")
    models = join_null_safe(profile, shares, group)
    models = models.withColumn("_share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_shares") - 1))).drop("_shares")
    schema = T.StructType([*patches.schema.fields, T.StructField("_q", T.DoubleType()), T.StructField("_known", T.BooleanType())])

    def score(rows: pa.Table, model: pa.Table) -> pa.Table:
        if model.num_rows > 1:
            raise ValueError("two profiles for one group")
        q, known = np.full(rows.num_rows, np.nan), bool(model.num_rows)
        if known and rows.num_rows:
            mu = to_matrix(model["mu"].combine_chunks())[0]
            precision = to_matrix(model["sigma_inv"].combine_chunks().flatten())
            q = _distances(rows[features].combine_chunks(), mu, precision)
        return rows.drop_columns(["_share"]).append_column("_q", pa.array(q)).append_column("_known", pa.array([known] * rows.num_rows, pa.bool_()))

    keys = [*group, "_share"]
    return dealt.groupBy(*keys).cogroup(models.groupBy(*keys)).applyInArrow(score, schema)


def image_score(scores: DataFrame, keys: Sequence[str] = ("image_id",), score: str = "score", k: int = 3) -> DataFrame:
    """Mean of the ``k`` highest patch scores (of all, if there are fewer)."""
    best = top_k(scores, list(keys), score, "patch_idx", k)
    return best.groupBy(*keys).agg(F.avg(score).alias("image_score"))
