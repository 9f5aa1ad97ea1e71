"""Operators on vector columns. Weights travel with the function; each Arrow batch is one matmul."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VECTOR = "array<double>"


def to_matrix(column: pa.Array) -> np.ndarray:
    """A list column of one width as a (rows, width) matrix of doubles; a NULL list is a row of NaN.

    Lists of different widths raise an error: cut up by their total length they would be mixed.
    """
    if not len(column):
        return np.zeros((0, 0))
    given = column.is_valid().to_numpy(zero_copy_only=False)
    widths = np.unique(column.value_lengths().drop_null().to_numpy())
    if len(widths) > 1:
        raise ValueError(f"vectors of different widths: {widths.tolist()}")
    width = int(widths[0]) if len(widths) else 0
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if given.all():
        return flat.reshape(len(column), width)
    matrix = np.full((len(column), width), np.nan)
    matrix[given] = flat.reshape(int(given.sum()), width)
    return matrix


def to_list_array(matrix: np.ndarray) -> pa.Array:
    """The inverse of :func:`to_matrix`."""
    rows, width = matrix.shape
    offsets = np.arange(0, (rows + 1) * width, width, dtype=np.int32) if width else np.zeros(rows + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.reshape(-1)))


def rows_by_key(keys: Sequence[pa.Array], n: int) -> list[tuple[tuple, np.ndarray]]:
    """Row numbers of each distinct key of an Arrow batch."""
    codes = np.zeros(n, np.int64)
    for key in keys:
        encoded = key.dictionary_encode(null_encoding="encode")
        codes = codes * len(encoded.dictionary) + encoded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(codes, kind="stable")
    starts = np.flatnonzero(np.diff(codes[order], prepend=-1)) if n else []
    groups = np.split(order, starts[1:]) if n else []
    return [(tuple(key[int(rows[0])].as_py() for key in keys), rows) for rows in groups]


def linear(x: Column, weight: Sequence, bias: Sequence | None = None) -> Column:
    """Affine map ``W x + b`` with ``weight`` of shape (out, in)."""
    w = np.asarray(weight, dtype=np.float64)
    b = np.zeros(w.shape[0]) if bias is None else np.asarray(bias, dtype=np.float64)

    @F.arrow_udf(VECTOR)
    def apply(v: pa.Array) -> pa.Array:
        return to_list_array(to_matrix(v) @ w.T + b if len(v) else np.zeros((0, w.shape[0])))

    return apply(x)


def layernorm_linear(
    x: Column, weight: Sequence, bias: Sequence, gain: Sequence | None = None, shift: Sequence | None = None,
    eps: float = 1e-5,
) -> Column:
    """Normalise a vector to zero mean and unit variance, scale and shift it, then map it."""
    w = np.asarray(weight, dtype=np.float64)
    b = np.asarray(bias, dtype=np.float64)
    g = np.ones(w.shape[1]) if gain is None else np.asarray(gain, dtype=np.float64)
    s = np.zeros(w.shape[1]) if shift is None else np.asarray(shift, dtype=np.float64)

    @F.arrow_udf(VECTOR)
    def apply(v: pa.Array) -> pa.Array:
        if not len(v):
            return to_list_array(np.zeros((0, w.shape[0])))
        m = to_matrix(v)
        spread = np.sqrt(m.var(axis=1, keepdims=True) + eps)
        return to_list_array(((m - m.mean(axis=1, keepdims=True)) / spread * g + s) @ w.T + b)

    return apply(x)


def erf(x: np.ndarray) -> np.ndarray:
    """The error function of every element: a series of positive terms, exact to rounding."""
    z = np.clip(np.abs(x), 0.0, 6.0)  # beyond 6 it is 1 in double precision
    term = total = z.copy()
    for n in range(1, 140):
        term = term * (2.0 * z * z / (2 * n + 1))
        total = total + term
    return np.sign(x) * np.minimum(1.0, 2.0 / math.sqrt(math.pi) * np.exp(-z * z) * total)


def mlp_head(x: Column, w1: Sequence, b1: Sequence, w2: Sequence, b2: float) -> Column:
    """Two-layer head with a GELU in between; one logit per vector."""
    w1, b1 = np.asarray(w1, np.float64), np.asarray(b1, np.float64)
    w2 = np.asarray(w2, np.float64).reshape(-1)

    @F.arrow_udf("double")
    def apply(v: pa.Array) -> pa.Array:
        if not len(v):
            return pa.array([], pa.float64())
        hidden = to_matrix(v) @ w1.T + b1
        hidden = hidden * 0.5 * (1.0 + erf(hidden / math.sqrt(2.0)))
        return pa.array(hidden @ w2 + float(b2))

    return apply(x)


def center(x: Column, mu: Column) -> Column:
    return F.zip_with(x, mu, lambda a, b: a.cast("double") - b.cast("double"))


def dot(x: Column, y: Column) -> Column:
    """Inner product of two array columns, inside the JVM."""
    products = F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def quadratic_form(x: Column, mu: Column, precision: Column) -> Column:
    """``(x - mu)' P (x - mu)`` with native expressions; meant for narrow vectors."""
    centered = center(x, mu)
    return F.aggregate(
        F.zip_with(centered, precision, lambda value, row: value * dot(row, centered)),
        F.lit(0.0),
        lambda acc, v: acc + v,
    )


def mean_vector(column: str) -> Column:
    """Element-wise mean as an aggregate (combined map-side)."""
    return vector_to_array(Summarizer.mean(array_to_vector(F.col(column))))


def sum_vector(column: str) -> Column:
    """Element-wise sum as an aggregate (combined map-side)."""
    return vector_to_array(Summarizer.sum(array_to_vector(F.col(column))))


def max_vector(column: str) -> Column:
    """Element-wise maximum as an aggregate (combined map-side)."""
    return vector_to_array(Summarizer.max(array_to_vector(F.col(column))))


def centroid(patches: DataFrame, keys: Sequence[str] = ("image_id",), embedding: str = "embedding") -> DataFrame:
    """Mean embedding of the patches left in each image; takes the place of the class token."""
    wide = patches.withColumn("_v", F.col(embedding).cast(VECTOR))
    return wide.groupBy(*keys).agg(mean_vector("_v").alias(embedding))


def explode_tokens(df: DataFrame, column: str, width: int, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Cut an encoder's flat output into token rows of ``width`` numbers: ``token_idx, embedding``."""
    count = F.floor(F.size(column) / width).cast("int")
    tokens = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(column, i * width + 1, width))
    return df.select(*keys, F.posexplode(tokens).alias("token_idx", "embedding"))


def drop_cls(tokens: DataFrame) -> DataFrame:
    """Patch tokens only; token 1 becomes patch 0."""
    return tokens.where(F.col("token_idx") > 0).select(
        *[c for c in tokens.columns if c != "token_idx"], (F.col("token_idx") - 1).alias("patch_idx")
    )


def keep_cls(tokens: DataFrame) -> DataFrame:
    return tokens.where(F.col("token_idx") == 0).drop("token_idx")


def concat_tokens(cls: DataFrame, patches: DataFrame) -> DataFrame:
    """Token set made of one class token per image (index 0) and its patches (index + 1)."""
    head = cls.withColumn("token_idx", F.lit(0).cast("long"))
    body = patches.withColumn("token_idx", F.col("patch_idx").cast("long") + 1).drop("patch_idx")
    return head.unionByName(body.select(*head.columns))


def embed_images(
    df: DataFrame, pixels: str, make_predict_fn: Callable, batch_size: int = 32,
    input_shape: Sequence[int] | None = None, out: str = "embedding", element: T.DataType | None = None,
) -> DataFrame:
    """Run a user's frozen encoder over an array column, batch by batch.

    ``make_predict_fn`` is called once per worker and returns a function from a numpy batch to a
    (batch, width) array, so weights are loaded once and not per row.
    """
    udf = predict_batch_udf(
        make_predict_fn,
        return_type=T.ArrayType(element or T.FloatType()),
        batch_size=batch_size,
        input_tensor_shapes=[list(input_shape)] if input_shape else None,
    )
    return df.withColumn(out, udf(F.col(pixels)))

