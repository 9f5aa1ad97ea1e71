"""Centroid clustering (Lloyd's rounds, exact) with ns-bounds.

Each vector keeps, for every centroid, its distance at the round when it was last computed. In a later
round that distance can have changed by no more than the norm of the centroid's whole displacement
since then. All earlier centroids are kept for that: the norm of the total displacement is never more,
and often far less, than the sum of the drifts of each round. Where the bounds leave a vector's
centroid in doubt, and only there, distances are computed again, in whole numbers.

Vectors are scaled to integers, so sums, distances and ties are exact and runs agree bit for bit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from normatile.llm.common import col, schema_after, stored
from normatile.session import new_folder

SLACK = 1e-9  # relative; covers the rounding of bounds, so that ties are always computed
LARGEST = 1 << 27  # a larger component could overflow a squared distance
STATE = "v binary, cluster int, bounds binary, asked binary, distance long"
SUMS = "of int, n long, inertia long, sums array<long>"


def _matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    """A binary column of equally long values as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def _packed(table: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(table)
    width = raw.shape[1] * raw.itemsize
    offsets = pa.array(np.arange(len(raw) + 1, dtype=np.int32) * width)
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, offsets.buffers()[1], pa.py_buffer(raw)])


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, dims: int, scale: float) -> DataFrame:
    """``vec_id, v``: floor(scale * x) of the vectors with exactly ``dims`` finite components, as 32-bit integers."""
    rows = vectors.select(col(id_col).alias("vec_id"), col(vector_col).cast("array<double>").alias("x")).where(F.size("x") == dims)
    schema = schema_after(rows, ["vec_id"], "v binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)  # null components become NaN
            good = np.isfinite(x).all(axis=1)
            whole = np.floor(scale * x[good])
            if len(whole) and np.abs(whole).max() > LARGEST:
                raise ValueError(f"a scaled component lies beyond {LARGEST}: squared distances would not fit 64 bits")
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), _packed(whole.astype(np.int32))], names=schema.names)

    return rows.mapInArrow(run, schema)


def starts(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest SHA-256 of ``seed:vec_id``, in that order; fewer if there are fewer."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    first = vectors.orderBy(F.sha2(name, 256), "v").limit(k).select("v").collect()
    return np.array([np.frombuffer(r["v"], np.int32) for r in first], np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x.astype(np.int64) - c
    return np.einsum("ij,ij->i", d, d)


def evaluate(x: np.ndarray, own: np.ndarray, bounds: np.ndarray, asked: np.ndarray, history: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """New clusters and exact distances to them; ``bounds`` and ``asked`` are brought up to date in place.

    ``bounds[i, j]`` is the distance of vector i to centroid j as it was in round ``asked[i, j]``.
    Also gives the number of distances computed.
    """
    now, turn = history[-1], len(history) - 1
    rows = np.arange(len(x))
    k = len(now)
    moved = np.sqrt(np.array([[float(((now[j] - old[j]) ** 2).sum()) for j in range(k)] for old in history]))
    shift = moved[asked, np.arange(k)[None, :]]
    low = (bounds - shift) - SLACK * (bounds + shift)
    low[rows, own] = np.inf
    # The own centroid's distance is needed for the result; it also is the tightest upper bound.
    exact = squared(x, now[own])
    bounds[rows, own], asked[rows, own] = np.sqrt(exact), turn
    upper = np.sqrt(exact) * (1 + SLACK)
    best, best_at, computed = exact.copy(), own.copy(), len(x)
    open_ = np.flatnonzero(low.min(axis=1) <= upper) if k > 1 else rows[:0]
    for j in range(k):
        doubt = open_[(low[open_, j] <= upper[open_])]
        if not len(doubt):
            continue
        d = squared(x[doubt], now[j])
        computed += len(doubt)
        bounds[doubt, j], asked[doubt, j] = np.sqrt(d), turn
        better = (d < best[doubt]) | ((d == best[doubt]) & (j < best_at[doubt]))
        best[doubt[better]], best_at[doubt[better]] = d[better], j
    return best_at, best, computed


def _pass(state: DataFrame, history: list[np.ndarray]) -> DataFrame:
    """One assignment of all vectors; each task adds a row per centroid with what its vectors' moves change in count and sum."""
    k, dims, turn = len(history[-1]), history[-1].shape[1], len(history) - 1
    schema = schema_after(state, ["vec_id"], f"{STATE}, {SUMS}")
    first = turn == 0
    rows = state.select("vec_id", "v", *([] if first else ["cluster", "bounds", "asked"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, inertia, sums = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        kind = None
        for batch in batches:
            if not batch.num_rows:
                continue
            kind = batch.column(0).type
            x = _matrix(batch.column(1), "<i4", dims)
            if first:
                d = np.stack([squared(x, c) for c in history[0]], axis=1)
                new, best = d.argmin(axis=1), d.min(axis=1)  # argmin takes the smaller number
                bounds, asked = np.sqrt(d), np.zeros(d.shape, np.uint16)
            else:
                was = batch.column(2).to_numpy()
                bounds, asked = _matrix(batch.column(3), "<f8", k).copy(), _matrix(batch.column(4), "<u2", k).copy()
                new, best, _ = evaluate(x, was, bounds, asked, history)
            for j in range(k):
                came = (new == j) if first else (new == j) & (was != j)
                n[j] += came.sum()
                sums[j] += x[came].sum(axis=0, dtype=np.int64)
                if not first:
                    left = (was == j) & (new != j)
                    n[j] -= left.sum()
                    sums[j] -= x[left].sum(axis=0, dtype=np.int64)
                inertia[j] += best[new == j].sum()
            size = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(new.astype(np.int32)), _packed(bounds), _packed(asked), pa.array(best),
                    *[pa.nulls(size, t) for t in (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()))],
                ],
                names=schema.names,
            )
        if kind is not None:
            empty = [pa.nulls(k, t) for t in (kind, pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.int64())]
            totals = [pa.array(np.arange(k, dtype=np.int32)), pa.array(n), pa.array(inertia), pa.array(list(sums), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(empty + totals, names=schema.names)

    return rows.mapInArrow(run, schema)


def _totals(table: DataFrame, k: int, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Changes of counts and sums, and the inertia, per centroid, summed over tasks in Spark: k rows come to the driver."""
    added = F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(dims)])
    rows = table.where("of is not null").groupBy("of").agg(F.sum("n").alias("n"), F.sum("inertia").alias("inertia"), added.alias("sums")).collect()
    n, inertia, sums = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
    for r in rows:
        n[r["of"]], inertia[r["of"]], sums[r["of"]] = r["n"], r["inertia"], r["sums"]
    return n, inertia, sums


def _remove(spark, path: str) -> None:
    """Delete a round's table that the next one has replaced."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def cluster(
    vectors: DataFrame,
    k: int = 8,
    rounds: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    dims: int = 64,
    scale: float = 1024.0,
    seed: int = 3,
) -> tuple[DataFrame, list[np.ndarray], list[int]]:
    """Rows ``vec_id, cluster, distance`` (squared), the centroids of every round, and the final inertia of each cluster.

    Kept are vectors with exactly ``dims`` components, none null, NaN or infinite, scaled and floored
    to integers; components beyond 2**27 after scaling are an error. Rows that repeat an id or a
    vector count each; a null id is kept. With fewer than ``k`` vectors there are as many centroids as
    vectors; an empty table gives no rows and no centroids. A round assigns every vector to the nearest
    centroid (ties: the smaller number) and moves each centroid to the floored mean of its vectors; one
    without vectors stays. After ``rounds`` rounds vectors are assigned once more. Other columns are not read.

    The driver holds (rounds + 1) * k centroids. A round is one pass over the last round's table, written
    anew in the shared folder; a table is deleted once the next one is complete. A lost executor's
    tasks run again on the written table.
    """
    spark = vectors.sparkSession
    made = stored(integer_vectors(vectors, id_col, vector_col, dims, scale), "centroid-vectors")
    history = [starts(made, k, seed)]
    k = len(history[0])
    if not k:
        empty = T.StructType([T.StructField("vec_id", made.schema["vec_id"].dataType), *T.StructType.fromDDL("cluster int, distance long").fields])
        return spark.createDataFrame([], empty), [], []
    n, sums, state, last = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), made, None
    for turn in range(rounds + 1):
        path = new_folder(spark, f"centroid-round-{turn}")
        table = _pass(state, history)
        table.write.parquet(path)
        if last:
            _remove(spark, last)
        written = spark.read.schema(table.schema).parquet(path)
        more, inertia, added = _totals(written, k, dims)
        n, sums = n + more, sums + added
        state, last = written.where("of is null"), path
        if turn < rounds:
            history.append(np.array([s // c if c else old for s, c, old in zip(sums, n, history[-1])], np.int64))
    return state.select("vec_id", "cluster", "distance"), history, [int(x) for x in inertia]


def described(rows: DataFrame, history: list[np.ndarray], inertia: list[int]) -> DataFrame:
    """Adds ``cluster_inertia``, ``inertia`` and ``centroid_sha256`` (of the final centroid's components, joined by commas)."""
    if not history:
        return rows.selectExpr("*", "cast(null as long) cluster_inertia", "cast(null as long) inertia", "cast(null as string) centroid_sha256")
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in history[-1]]
    own = F.get(F.array(*[F.lit(x).cast("long") for x in inertia]), F.col("cluster"))
    name = F.get(F.array(*map(F.lit, names)), F.col("cluster"))
    return rows.select(
        "*", own.alias("cluster_inertia"), F.lit(sum(inertia)).cast("long").alias("inertia"), name.alias("centroid_sha256")
    )
