"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from normatile.session import materialize, new_folder

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and scan it; its shuffle files go as soon as it is written.

    With ``by`` every value of that column has a folder of its own.
    """
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        if by is None:
            return materialize(df, tag)
        path = new_folder(df.sparkSession, tag)
        df.write.partitionBy(by).parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        conf.set(CLEANUP, before)


def col(name: str) -> Column:
    """A column by its literal name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct: operators join on it without any name clash."""
    return F.struct(*[col(c) for c in df.columns])


def unpacked(df: DataFrame, row: str, like: DataFrame) -> DataFrame:
    """The columns of ``like`` back from the struct column ``row``."""
    return df.select(F.col(row).alias("_whole_row")).select(*[F.col("_whole_row").getField(c).alias(c) for c in like.columns])


def binary(array: pa.Array) -> pa.Array:
    """A string column as UTF-8 bytes; nulls become empty."""
    return array.cast(pa.binary()).fill_null(b"")


def by_bytes(batches: Iterable[pa.RecordBatch], column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that one piece holds at most ``limit`` bytes of text, or a single row."""
    for batch in batches:
        sizes = [0 if n is None else n for n in pc.binary_length(batch.column(column)).to_pylist()]
        start, total = 0, 0
        for i, size in enumerate(sizes):
            if i > start and total + size > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if batch.num_rows > start:
            yield batch.slice(start)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: T.StructType, limit: int, text: int = 1) -> DataFrame:
    """``fn`` over record batches of at most ``limit`` bytes in column number ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in by_bytes(batches, text, limit):
            out = fn(piece)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def schema_after(df: DataFrame, names: list[str], rest: str) -> T.StructType:
    """Output schema: columns of ``df`` as they are, then those of a DDL string."""
    return T.StructType([T.StructField(n, df.schema[n].dataType) for n in names] + (T.StructType.fromDDL(rest).fields if rest else []))
