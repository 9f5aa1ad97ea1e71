"""Normal profiles kept up to date by a stream of patches, and scoring with the current profile.

Every micro-batch writes its results under its own batch number and reads only what earlier batches
wrote, so a batch that is run again after a failure replaces its own output with the same rows.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from normatile.operators.ordering import last_n
from normatile.operators.profile import REGULARIZATION, add_normal, averaged_profile, sliding_refits
from normatile.operators.scoring import mahalanobis
from normatile.session import materialize


def _state(spark: SparkSession, store: str, name: str, batch_id: int) -> DataFrame | None:
    """What the batch before wrote. Only the first batch may find nothing: a lost state is an error, not a fresh start."""
    return spark.read.parquet(os.path.join(store, name, f"batch={batch_id - 1}")) if batch_id else None


def profile_stream(
    patches: DataFrame,
    store: str,
    checkpoint: str,
    group: Sequence[str],
    every: int = 100,
    n: int = 10000,
    momentum: float = 0.1,
    reg: float = REGULARIZATION,
    step: str = "step",
    within: Sequence[str] = ("image_id", "patch_idx"),
    features: str = "embedding",
    label: str = "y",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start keeping ``store`` up to date from a stream of patches with a step number.

    The buffer of the last ``n`` normal patches per group is a table that each batch rewrites; it
    never grows beyond ``n`` rows per group. Profiles are refitted at steps 0, every, 2 * every, ...
    up to a group's latest step; a backlog of any number of refits is one set of jobs, and their
    average starts from the stored profile. ``history`` lists every refit (group..., refit, n).
    A batch's buffer, progress and profile are removed when the batch after the next one is written: a
    batch that is run again finds what it read.
    ``trigger`` goes to the writer, ``{"processingTime": "1 minute"}`` for a stream that runs on; by
    default what is there is read and the stream ends. Rows per batch are limited at the source.
    """
    group = list(group)
    columns = [*group, "n", "mu", "sigma", "sigma_inv"]

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession

        def write(df: DataFrame, name: str) -> DataFrame:
            path = os.path.join(store, name, f"batch={batch_id}")
            df.write.mode("overwrite").parquet(path)
            return spark.read.schema(df.schema).parquet(path)

        held, done, old = (_state(spark, store, name, batch_id) for name in ("buffer", "progress", "profile"))
        arrived = materialize(add_normal(batch, label), "arrived")
        known = arrived if held is None else held.unionByName(arrived)
        made = sliding_refits(known, every, n, step, within, group, features, reg, done)
        made = materialize(made, "stream-refits")
        write(made.select(*group, "refit", "n"), "history")
        fits = made.drop("sigma_inv")
        if old is not None:
            fits = old.select(*group, F.lit(-1).cast("long").alias("refit"), "n", "mu", "sigma").unionByName(fits)
        write(averaged_profile(fits, group, momentum).select(*columns), "profile")
        write(last_n(known, n, step, within, group), "buffer")
        reached = known.groupBy(*group).agg(F.floor(F.max(step) / every).cast("long").alias("done"))
        if done is not None:
            reached = reached.unionByName(done).groupBy(*group).agg(F.max("done").alias("done"))
        write(reached, "progress")
        for name in ("buffer", "progress", "profile"):
            _remove(spark, os.path.join(store, name, f"batch={batch_id - 2}"))

    return (
        patches.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a state that no batch can read any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def current_profile(spark: SparkSession, store: str) -> DataFrame | None:
    """The profile written by the latest batch that has one."""
    try:
        written = spark.read.parquet(os.path.join(store, "profile"))
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    latest = written.agg(F.max("batch")).first()[0]
    return spark.read.parquet(os.path.join(store, "profile", f"batch={latest}"))


def score_stream(
    patches: DataFrame, store: str, out: str, checkpoint: str, group: Sequence[str],
    features: str = "embedding", gamma: float | None = 1.3, trigger: dict | None = None,
) -> StreamingQuery:
    """Score arriving patches; each batch reads the profile that is current when it starts."""

    def run(batch: DataFrame, batch_id: int) -> None:
        profile = current_profile(batch.sparkSession, store)
        if profile is None:
            scored = batch.withColumn("deviation", F.lit(0.0))
        else:
            scored = mahalanobis(batch, profile, group, features, gamma)
        scored.write.mode("overwrite").parquet(os.path.join(out, f"batch={batch_id}"))

    return (
        patches.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )
