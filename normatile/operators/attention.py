"""Attention of query vectors over the patches of their image.

A patch whose vector is NULL, or holds NULL, NaN or infinity, takes no part: its weights are NULL and the
other patches share the attention. Such a query takes no part either. A NULL image key is an image.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from normatile.operators.ordering import join_null_safe
from normatile.operators.vectors import VECTOR, linear, max_vector, rows_by_key, to_matrix
from normatile.session import materialize

# Patches that travel together past one copy of their image's query block.
PACK = 64
# Images whose partial softmax sums a task holds at a time.
PARTIAL_IMAGES = 100_000


def _offsets(lengths: Sequence[int]) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector is complete and finite."""
    return vectors.where(F.forall(F.col(column), lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False))))


def query_blocks(queries: DataFrame, key: str = "image_id") -> DataFrame:
    """All query vectors of an image in one row, in query order.

    The number of queries is a constant of the model, so the row has a fixed size.
    """
    ordered = F.array_sort(F.collect_list(F.struct("query_idx", F.col("embedding").alias("v"))))
    return usable(queries).groupBy(key).agg(F.transform(ordered, lambda q: q["v"]).alias("block"))


def attention_logits(
    patches: DataFrame,
    queries: DataFrame,
    key: str = "image_id",
    weight: Sequence | None = None,
    bias: Sequence | None = None,
) -> DataFrame:
    """Scaled dot products ``q . p / sqrt(D)``: one array over queries per patch.

    Queries are first mapped to the patch width when weights are given. Only (patch key, logits)
    come out; vectors are read once and never repeated per query.
    """
    if weight is not None:
        queries = queries.withColumn("embedding", linear(F.col("embedding").cast(VECTOR), weight, bias))
    packed = (
        patches.select(key, "patch_idx", F.col("embedding").alias("_v"))
        .repartition(key)  # one shuffle of the vectors serves the packs and the join
        .groupBy(key, F.floor(F.col("patch_idx") / PACK).alias("_pack"))
        .agg(F.collect_list(F.struct("patch_idx", "_v")).alias("_rows"))
    )

    @F.arrow_udf("array<array<double>>")
    def scores(vectors: pa.Array, blocks: pa.Array) -> pa.Array:
        if not len(vectors):
            return pa.array([], pa.list_(pa.list_(pa.float64())))
        parts = []
        for v, q in zip(vectors, blocks):
            p, b = to_matrix(v.values), to_matrix(q.values)
            parts.append((p @ b.T) / np.sqrt(p.shape[1]))
        widths = np.concatenate([np.full(m.shape[0], m.shape[1]) for m in parts])
        rows = [m.shape[0] for m in parts]
        inner = pa.ListArray.from_arrays(_offsets(widths), pa.array(np.concatenate([m.ravel() for m in parts])))
        return pa.ListArray.from_arrays(_offsets(rows), inner)

    joined = join_null_safe(packed, query_blocks(queries, key), [key])
    logits = joined.select(
        key,
        F.col("_rows.patch_idx").alias("_ids"),
        scores(F.col("_rows._v"), F.col("block")).alias("_logits"),
    )
    pairs = F.explode(F.arrays_zip("_ids", "_logits")).alias("_pair")
    return logits.select(key, pairs).select(
        key, F.col("_pair._ids").alias("patch_idx"), F.col("_pair._logits").alias("logits")
    )


def softmax_weights(logits: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Softmax over the patches of an image, per query: adds ``weights``, drops ``logits``.

    Every task merges, per image and query, the largest logit and the sum of exponentials scaled by it
    (one short row per image); these rows merge the same way, and one join brings them to the patches.
    An image with very many patches is not gathered anywhere. Patches with a NULL, NaN or infinite
    logit get NULL weights and count for nothing. ``logits`` should be a stored table.
    """
    keys = list(keys)
    schema = logits.select(*keys).schema
    for name in ("_peak", "_mass"):
        schema = schema.add(name, T.ArrayType(T.DoubleType()))

    def partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        types: list[pa.DataType] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if state:
                columns = [pa.array([k[i] for k in state], t) for i, t in enumerate(types)]
                lists = [pa.array([list(s[i]) for s in state.values()], pa.list_(pa.float64())) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*columns, *lists], names=[*keys, "_peak", "_mass"])
                state.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            types[:] = [batch.column(i).type for i in range(len(keys))]
            for key, rows in rows_by_key([batch.column(i) for i in range(len(keys))], batch.num_rows):
                table = to_matrix(batch.column(len(keys)).take(pa.array(rows)))
                table = table[np.isfinite(table).all(axis=1)]
                if not len(table):
                    continue
                peak = table.max(axis=0)
                mass = np.exp(table - peak).sum(axis=0)
                if key in state:
                    old_peak, old_mass = state[key]
                    top = np.maximum(peak, old_peak)
                    peak, mass = top, mass * np.exp(peak - top) + old_mass * np.exp(old_peak - top)
                state[key] = (peak, mass)
            if len(state) > PARTIAL_IMAGES:
                yield from flush()
        yield from flush()

    made = logits.select(*keys, "logits").where("logits is not null").mapInArrow(partials, schema)
    peaks = made.groupBy(*keys).agg(max_vector("_peak").alias("_top"), F.collect_list(F.struct("_peak", "_mass")).alias("_parts"))
    zero = F.transform("_top", lambda _: F.lit(0.0))
    total = F.aggregate(
        "_parts", zero, lambda acc, p: F.zip_with(acc, F.zip_with(F.zip_with(p["_peak"], "_top", lambda m, t: F.exp(m - t)), p["_mass"], lambda f, z: f * z), lambda x, y: x + y)
    )
    shared = join_null_safe(logits, peaks.select(*keys, "_top", total.alias("_z")), keys, "left")
    sound = F.forall("logits", lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))
    weights = F.zip_with(F.zip_with("logits", "_top", lambda v, m: F.exp(v - m)), "_z", lambda e, z: e / z)
    return shared.withColumn("weights", F.when(sound, weights)).drop("_top", "_z", "logits")


def importance(weights: str = "weights"):
    """Attention a patch receives, summed over queries."""
    return F.aggregate(F.col(weights), F.lit(0.0), lambda acc, w: acc + w)


def attention(
    patches: DataFrame, queries: DataFrame, key: str = "image_id",
    weight: Sequence | None = None, bias: Sequence | None = None,
) -> DataFrame:
    """``(image, patch_idx, weights, importance, n_queries)`` for every patch.

    Without (usable) queries weights are empty and the importance is 0; a patch without a usable vector
    has NULL weights and importance.
    """
    logits = materialize(attention_logits(patches, queries, key, weight, bias), "logits")
    weighed = softmax_weights(logits.withColumn("n_queries", F.size("logits")), [key])
    attended = weighed.withColumn("importance", importance()).select(key, "patch_idx", "weights", "importance", "n_queries")
    # Images without queries get no attention, but they stay.
    asked = usable(queries).select(F.col(key).alias("_asked")).distinct()
    idle = patches.select(key, "patch_idx").join(asked, F.col(key).eqNullSafe(F.col("_asked")), "left_anti")
    none = {"weights": F.array().cast("array<double>"), "importance": F.lit(0.0), "n_queries": F.lit(0)}
    return attended.unionByName(idle.withColumns(none).select(*attended.columns))
