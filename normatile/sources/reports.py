"""Sinks and stores: score reports, metric logs, profile versions."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normatile.functions.scores import label_name
from normatile.operators.ordering import join_null_safe
from normatile.session import committed, materialize

LOG_SCHEMA = "run_id string, epoch bigint, step bigint, key string, value double"


def rank_images(images: DataFrame, score: str = "score", tie: Sequence[str] = ("ordinal",)) -> DataFrame:
    """Most anomalous first; equal scores keep catalogue order."""
    return images.orderBy(F.desc(score), *tie)


def score_report(images: DataFrame, score: str = "score") -> DataFrame:
    """The columns of the score report, the score as text with six decimals."""
    return images.select(
        *(["category"] if "category" in images.columns else []),
        "defect_type",
        "image_name",
        F.col("path").alias("image_path"),
        F.format_string("%.6f", F.col(score).cast("double")).alias("anomaly_score"),
        "label",
        label_name(F.col("label")).alias("is_anomaly"),
    )


def write_score_report(images: DataFrame, path: str, score: str = "score", tie: Sequence[str] = ("path",)) -> None:
    """CSV files with a header, one folder per category, rows sorted by score within a file.

    A category's rows are range-partitioned by score, so that one large category is written by
    many tasks; reading its files in name order gives the whole ranking.
    """
    ranked = images.repartitionByRange("category", F.desc(score), *tie).sortWithinPartitions(
        "category", F.desc(score), *tie
    )
    score_report(ranked, score).write.mode("overwrite").option("header", True).partitionBy("category").csv(path)


def to_long_log(records: DataFrame, metrics: str = "metrics") -> DataFrame:
    """Explode a map of metrics into one row per key."""
    return records.select("run_id", "epoch", "step", F.explode(metrics).alias("key", "value")).select(
        "run_id", F.col("epoch").cast("long"), F.col("step").cast("long"), "key", F.col("value").cast("double")
    )


def append_metrics(records: DataFrame, path: str, metrics: str = "metrics", batch: str | int | None = None) -> None:
    """Append metric records to the long log, one folder per batch and run.

    A batch that is written again under its name (letters, digits, ``.``, ``_``, ``-``) replaces what it wrote
    before, whole or not: a retry gives each row once. Without a name every call is a batch of its own.
    """
    name = uuid.uuid4().hex if batch is None else str(batch)
    if not re.fullmatch(r"[A-Za-z0-9._-]+", name):
        raise ValueError(f"not a batch name: {name!r}")
    to_long_log(records, metrics).write.mode("overwrite").partitionBy("run_id").parquet(os.path.join(path, f"batch={name}"))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the batches that were written to their end."""
    folders = committed(spark, path, "batch")
    if not folders:
        return spark.createDataFrame([], LOG_SCHEMA)
    log = spark.read.schema(f"{LOG_SCHEMA}, batch string").option("basePath", path).parquet(*folders.values())
    return log.select("run_id", "epoch", "step", "key", "value")


def save_profile(profile: DataFrame, path: str, version: int, **metadata) -> None:
    """Write profile rows as a version, with any extra facts (epoch, metrics, ...) as columns.

    A version has a folder of its own: saving it again, after a failure say, replaces it.
    """
    extra = {name: F.lit(value) for name, value in metadata.items()}
    out = profile.drop("version").withColumns(extra)
    out.write.mode("overwrite").parquet(os.path.join(path, f"version={int(version)}"))


def load_profile(
    spark: SparkSession, path: str, group: Sequence[str] = (), version: int | None = None,
    defaults: DataFrame | None = None,
) -> DataFrame:
    """The given, or each group's latest, profile version that was written to its end.

    Folders say which versions there are, and the groups' keys which of them is the latest; matrices
    are read from the versions needed only. Stores without version folders are accepted as version 0. With
    ``defaults``, groups or fields that the store lacks keep their default.
    """
    group = list(group)
    folders = {int(v): folder for v, folder in committed(spark, path, "version").items()}

    def read(*versions: int) -> DataFrame:
        rows = spark.read.option("mergeSchema", True).option("basePath", path).parquet(*[folders[v] for v in versions])
        return rows.withColumn("version", F.col("version").cast("long"))

    if not folders:
        out = spark.read.parquet(path)
        if "version" not in out.columns:
            out = out.withColumn("version", F.lit(0).cast("long"))
        if version is not None:
            out = out.where(F.col("version") == version)
    elif version is not None:
        if version not in folders:
            raise ValueError(f"version {version} is not in the store, only {sorted(folders)}")
        out = read(version)
    elif not group:
        out = read(max(folders))
    else:
        newest = materialize(read(*folders).groupBy(*group).agg(F.max("version").alias("version")), "profile-versions")
        needed = [r["version"] for r in newest.select("version").distinct().collect()]  # at most one row per version folder
        out = join_null_safe(read(*needed), newest, [*group, "version"])
    if defaults is None:
        return out
    names = [c for c in defaults.columns if c not in group]
    known = out.select(*group, *[F.col(c).alias(f"_saved_{c}") for c in names if c in out.columns])
    keyed = join_null_safe(defaults, known, group, "left") if group else defaults.join(known, F.lit(True), "left")
    return keyed.select(
        *group,
        *[F.coalesce(f"_saved_{c}", c).alias(c) if c in out.columns else F.col(c) for c in names],
    )
