"""Image files as a Spark data source: one bad file is one row with an error, not a failed job.

``files`` (path, length) come from a listing or any filter of a manifest. They are stored, and the
planner cuts the stored table into partitions of about equal bytes, reading nothing but the lengths;
a partition is a range of rows of one manifest file. Tasks open one image at a time, so memory is that
of one image. A row goes out as columns: no pixel passes through a Python object of its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from normatile.session import materialize
from normatile.sources import png

NAME = "normatile_images"
ARRAYS = "path string, height int, width int, channels int, pixels array<float>, error string"
PIXELS = "path string, y int, x int, c int, v int, error string"
SLICE = 1 << 16  # pixel rows sent at once


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path on it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


class Files(InputPartition):
    """Rows ``start`` to ``stop`` of one file of the stored manifest."""

    def __init__(self, manifest: str, start: int, stop: int):
        self.manifest, self.start, self.stop = manifest, start, stop


class ImageReader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["path"]
        self.layout = options.get("layout", "pixels")
        self.bytes = int(options.get("partitionBytes", 64 << 20))
        self.most = int(options.get("maxPixels", 64_000_000))

    def partitions(self) -> list[InputPartition]:
        system, folder = opened(self.folder)
        out: list[InputPartition] = []
        for fragment in sorted(ds.dataset(folder, filesystem=system, format="parquet", exclude_invalid_files=True).files):
            start, row, total = 0, 0, 0
            file = pq.ParquetFile(fragment, filesystem=system)
            for batch in file.iter_batches(1 << 16, columns=["length"]):
                ends = total + np.cumsum(batch.column(0).to_numpy())
                # A cut behind each row that passes another multiple of the partition size.
                for k in np.flatnonzero(np.diff(ends // self.bytes, prepend=total // self.bytes)).tolist():
                    out.append(Files(fragment, start, row + k + 1))
                    start = row + k + 1
                row, total = row + batch.num_rows, int(ends[-1]) if len(ends) else total
            if row > start:
                out.append(Files(fragment, start, row))
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no files at all
            return
        system, _ = opened(self.folder)
        table = pq.read_table(partition.manifest, columns=["path"], filesystem=system, partitioning=None)
        for path in table.column("path").slice(partition.start, partition.stop - partition.start).to_pylist():
            try:
                files, name = opened(path)
                with files.open_input_stream(name) as stream:
                    cube = png.decode(stream.read(), self.most)
            except (png.BadImage, OSError) as error:
                yield self._failed(path, str(error).splitlines()[0] if str(error) else type(error).__name__)
                continue
            yield from self._array(path, cube) if self.layout == "arrays" else self._pixels(path, cube)

    def _failed(self, path: str, error: str) -> pa.RecordBatch:
        nulls = [pa.nulls(1, t) for t in ([pa.int32()] * 3 + [pa.list_(pa.float32())] if self.layout == "arrays" else [pa.int32()] * 4)]
        names = [part.split()[0] for part in (ARRAYS if self.layout == "arrays" else PIXELS).split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([path]), *nulls, pa.array([error])], names=names)

    def _array(self, path: str, cube: np.ndarray) -> Iterator[pa.RecordBatch]:
        pixels = pa.ListArray.from_arrays(pa.array([0, cube.size], pa.int32()), pa.array(cube.ravel().astype(np.float32)))
        sizes = [pa.array([n], pa.int32()) for n in cube.shape]
        yield pa.RecordBatch.from_arrays(
            [pa.array([path]), *sizes, pixels, pa.nulls(1, pa.string())], names=["path", "height", "width", "channels", "pixels", "error"]
        )

    def _pixels(self, path: str, cube: np.ndarray) -> Iterator[pa.RecordBatch]:
        _, width, per = cube.shape
        flat = cube.reshape(-1)
        for start in range(0, len(flat), SLICE):
            at = np.arange(start, min(start + SLICE, len(flat)))
            places = [at // (width * per), at // per % width, at % per, flat[start : start + SLICE]]
            columns = [pa.array(p.astype(np.int32)) for p in places]
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(path, len(at)), *columns, pa.nulls(len(at), pa.string())], names=["path", "y", "x", "c", "v", "error"]
            )


class ImageSource(DataSource):
    """``spark.read.format("normatile_images").load(<stored table of path, length>)``.

    Options: ``layout`` (pixels or arrays), ``partitionBytes``, ``maxPixels``.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return ARRAYS if self.options.get("layout", "pixels") == "arrays" else PIXELS

    def reader(self, schema: T.StructType) -> ImageReader:
        return ImageReader(self.options)


def list_images(spark: SparkSession, root: str, suffix: str = ".png") -> DataFrame:
    """``path, length`` of all files below ``root`` with the suffix, empty ones too (Spark's file sources skip those).

    Folders are listed side by side in tasks, one round per level of the tree; no file is opened.
    """
    rows = "path string, length long, folder boolean"

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                system, name = opened(folder)
                infos = system.get_file_info(pafs.FileSelector(name))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([f"{folder.rstrip('/')}/{i.base_name}" for i in infos], pa.string()),
                        pa.array([i.size or 0 for i in infos], pa.int64()),
                        pa.array([i.type == pafs.FileType.Directory for i in infos], pa.bool_()),
                    ],
                    names=["path", "length", "folder"],
                )

    folders, found = spark.createDataFrame([(root,)], "path string"), None
    while True:
        level = materialize(folders.mapInArrow(listed, rows), "image-listing")
        files = level.where(~F.col("folder") & F.col("path").endswith(suffix)).select("path", "length")
        found = files if found is None else found.unionByName(files)
        folders = level.where("folder").select("path").repartition(spark.sparkContext.defaultParallelism)
        if level.where("folder").isEmpty():
            return found


def scan_images(files: DataFrame, layout: str = "pixels", max_pixels: int = 64_000_000, partition_bytes: int = 64 << 20) -> DataFrame:
    """Decode the PNG ``files`` (path, length): one row per pixel and channel, or per image.

    ``error`` says what is wrong with a file that can't be read (damaged, empty, gone, more than
    ``max_pixels`` pixels); such a file gives one row with NULL pixels. Only files listed are opened.
    Channels are R, G, B, or one grey; transparency is left out.
    """
    if layout not in ("pixels", "arrays"):
        raise ValueError(f"layout must be 'pixels' or 'arrays', got {layout!r}")
    spark = files.sparkSession
    spark.dataSource.register(ImageSource)
    listed = materialize(files.select("path", F.col("length").cast("long").alias("length")).where("path is not null"), "image-files")
    reader = spark.read.format(NAME).option("layout", layout)
    reader = reader.option("maxPixels", max_pixels).option("partitionBytes", partition_bytes)
    return reader.load(listed.inputFiles()[0].rsplit("/", 1)[0]) if listed.inputFiles() else _nothing(spark, layout)


def _nothing(spark: SparkSession, layout: str) -> DataFrame:
    return spark.createDataFrame([], ARRAYS if layout == "arrays" else PIXELS)


def write_images(pixels: DataFrame, folder: str, image: str = "image_id") -> DataFrame:
    """Write pixel rows (image, y, x, c, v) as ``folder/<image>.png``; gives (path, length) of the files.

    An image's pixels meet in one group, in any order; a missing pixel is black. A file is written
    beside its place and then moved there, so a repeated task leaves the same files.
    """
    cells = pixels.select(F.col(image).cast("string").alias("name"), *[F.col(c).cast("int").alias(c) for c in "yxcv"])

    def write(cells: pa.Table) -> pa.Table:
        y, x, c, v = (cells.column(n).to_numpy() for n in "yxcv")
        cube = np.zeros((y.max() + 1, x.max() + 1, 1 if c.max() == 0 else 3), np.uint8)
        cube[y, x, c] = v
        name, data = cells.column("name")[0].as_py(), png.encode(cube, np.full(len(cube), png.PAETH))
        system, base = opened(folder)
        system.create_dir(base, recursive=True)
        part = f"{base}/_{name}-{uuid.uuid4().hex}.part"
        with system.open_output_stream(part) as out:
            out.write(data)
        system.move(part, f"{base}/{name}.png")
        return pa.table({"path": [f"{folder}/{name}.png"], "length": [len(data)]})

    return materialize(cells.groupBy("name").applyInArrow(write, "path string, length long"), "image-written")
