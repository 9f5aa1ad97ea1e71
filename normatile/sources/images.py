"""Image folders as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normatile.operators.catalogue import attach_masks, manifest, mask_files
from normatile.sources.image_scan import list_images, scan_images


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Paths of all PNG files below ``root``; file contents are never read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.png")
        .load(root)
    )
    return files.select("path")


def image_manifest(spark: SparkSession, root: str) -> DataFrame:
    """The labelled catalogue of ``root/<category>/{train,test,ground_truth}/...`` with mask paths."""
    files = list_files(spark, root)
    return attach_masks(manifest(files), mask_files(files))


def image_arrays(spark: SparkSession, root: str, **options) -> DataFrame:
    """One row per readable image with its bytes in (y, x, channel) order: the input of an encoder."""
    return scan_images(list_images(spark, root), "arrays", **options).where("error is null").drop("error")


def image_pixels(spark: SparkSession, root: str, **options) -> DataFrame:
    """Readable images as ``(path, y, x, c, v)`` rows with channels in RGB order (grey: c = 0)."""
    return scan_images(list_images(spark, root), **options).where("error is null").drop("error")


def image_errors(spark: SparkSession, root: str, **options) -> DataFrame:
    """``path, error`` of the files below ``root`` that can't be read as images."""
    return scan_images(list_images(spark, root), **options).where("error is not null").select("path", "error")


def mask_pixels(spark: SparkSession, root: str, threshold: int = 127) -> DataFrame:
    """Masks as ``(path, y, x, m)`` with m in 0/1."""
    grey = image_pixels(spark, root).where(F.col("c") == 0)
    return grey.select("path", "y", "x", (F.col("v") > threshold).cast("int").alias("m"))
