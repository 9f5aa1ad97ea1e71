"""The labelled image catalogue: manifest, masks, ordinals, audits, augmentation choices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normatile.functions import paths
from normatile.functions.scores import label_of
from normatile.functions.seeded import seeded_choice, seeded_flag
from normatile.operators.ordering import head, with_position

# Augmentation methods that suit each category.
CATEGORY_METHODS = {
    "bottle": ["cutpaste", "crack"],
    "cable": ["cutpaste", "crack"],
    "capsule": ["cutpaste", "crack"],
    "carpet": ["cutpaste"],
    "grid": ["cutpaste", "crack"],
    "hazelnut": ["cutpaste", "crack"],
    "leather": ["cutpaste"],
    "metal_nut": ["cutpaste", "crack"],
    "pill": ["cutpaste", "crack"],
    "screw": ["cutpaste", "crack"],
    "tile": ["cutpaste", "crack"],
    "toothbrush": ["cutpaste", "crack"],
    "transistor": ["cutpaste", "crack"],
    "wood": ["cutpaste", "crack"],
    "zipper": ["cutpaste"],
    "default": ["cutpaste"],
}
REQUIRED_GROUPS = [("train", "good"), ("test", "good")]


def manifest(files: DataFrame, path: str = "path") -> DataFrame:
    """One row per image from ``.../<category>/<split>/<defect>/<name>.png`` paths.

    Only the splits ``train`` and ``test`` are images; the label comes from the folder ``good``.
    """
    p = F.col(path)
    image = p.endswith(".png") & paths.path_part(p, 3).isin("train", "test")
    defect = paths.parent_dir(p)
    return files.where(image).select(
        p.alias("path"),
        paths.path_part(p, 4).alias("category"),
        paths.path_part(p, 3).alias("split"),
        defect.alias("defect_type"),
        paths.base_name(p).alias("file_name"),
        paths.stem(p).alias("image_name"),
        label_of(defect).alias("label"),
    )


def mask_files(files: DataFrame, path: str = "path") -> DataFrame:
    """Ground-truth masks from ``.../<category>/ground_truth/<defect>/<name>_mask.png`` paths."""
    p = F.col(path)
    return files.where(p.endswith("_mask.png") & (paths.path_part(p, 3) == "ground_truth")).select(
        paths.path_part(p, 4).alias("category"),
        paths.parent_dir(p).alias("defect_type"),
        F.regexp_replace(paths.stem(p), "_mask$", "").alias("image_name"),
        p.alias("mask_path"),
    )


def attach_masks(images: DataFrame, masks: DataFrame) -> DataFrame:
    """Add ``mask_path``; NULL for training images, good images and images without a mask file."""
    joined = images.join(masks, ["category", "defect_type", "image_name"], "left")
    wanted = (F.col("split") == "test") & (F.col("label") == 1)
    return joined.withColumn("mask_path", F.when(wanted, F.col("mask_path"))).select(*images.columns, "mask_path")


def with_ordinal(images: DataFrame) -> DataFrame:
    """Stable index inside a category's split: by folder, then by file name."""
    return with_position(images, ["defect_type", "file_name"], ["category", "split"], "ordinal")


def dataset_audit(images: DataFrame) -> DataFrame:
    """Image counts per folder, and a row with ``missing`` set for each required folder not there."""
    counts = images.groupBy("category", "split", "defect_type").agg(F.count("*").alias("n_images"))
    folders = F.explode(F.array(*[F.struct(F.lit(s).alias("split"), F.lit(d).alias("defect_type")) for s, d in REQUIRED_GROUPS]))
    wanted = images.select("category").distinct().select("category", folders.alias("_f")).select("category", "_f.*")
    full = counts.join(wanted, ["category", "split", "defect_type"], "full")
    return full.select(
        "category", "split", "defect_type",
        F.coalesce("n_images", F.lit(0)).alias("n_images"),
        F.col("n_images").isNull().alias("missing"),
    )


def subset(images: DataFrame, ordinals: DataFrame) -> DataFrame:
    """Images whose ordinal is listed."""
    keys = [c for c in ("category", "split", "ordinal") if c in ordinals.columns]
    return images.join(ordinals, keys, "left_semi")


def first_anomalous(images: DataFrame, n: int, order: Sequence[str] = ("ordinal",)) -> DataFrame:
    return head(images.where(F.col("label") == 1), list(order), n)


def methods_for(category: Column) -> Column:
    """Augmentation methods of a category, whatever its case; unknown ones get the default."""
    entries = []
    for name, methods in CATEGORY_METHODS.items():
        entries += [F.lit(name), F.array(*[F.lit(m) for m in methods])]
    default = F.array(*[F.lit(m) for m in CATEGORY_METHODS["default"]])
    return F.coalesce(F.try_element_at(F.create_map(*entries), F.lower(category)), default)


def check_method(category: str, method: str) -> str:
    """Reject a method that does not suit a category."""
    allowed = CATEGORY_METHODS.get(category.lower(), CATEGORY_METHODS["default"])
    if method not in allowed:
        raise ValueError(f"method {method!r} is not available for {category!r}; available: {allowed}")
    return method


def method_errors(df: DataFrame, category: str, method: str | Column) -> DataFrame:
    """Rows whose explicit method does not suit their category."""
    return df.where(~F.array_contains(methods_for(F.col(category)), method if isinstance(method, Column) else F.lit(method)))


def augmentation_plan(
    images: DataFrame, key: str, category: str, p: float, seed: int = 42, method: str | None = None
) -> DataFrame:
    """Which images get a synthetic defect, and by which method: repeatable for a seed."""
    chosen = F.lit(method) if method is not None else seeded_choice(
        methods_for(F.col(category)), seed, F.lit("method"), F.col(key)
    )
    flag = seeded_flag(p, seed, F.lit("apply"), F.col(key))
    return images.withColumn("augment", flag).withColumn("method", F.when(F.col("augment"), chosen))
