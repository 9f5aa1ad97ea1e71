"""Streaming jobs over rows derived from the tables, drained with availableNow.

Rows are fed in a few ordered portions: each is appended to a source folder, then the stream runs
until it has read it. Restarts go through the stream's checkpoint, as after a failure.
"""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from normatile.functions.scores import combined_metric
from normatile.operators.ordering import with_position
from normatile.plans import fixtures as fx
from normatile.plans.fixtures import r6, r9
from normatile.plans.registry import query
from normatile.plans.run_queries import STOP_SQL, combined
from normatile.plans.scoring_queries import EMA_SQL, profile64, profile_facts
from normatile.session import materialize, new_folder
from normatile.streaming import metric_stream, profile_stream

PORTIONS = 3


def feed(spark, df, by: str, start, shuffled: bool = False):
    """Append ``df`` in portions of ``by``, in its order or shuffled; ``start(stream, folder)`` drains each one."""
    stored = materialize(df, "feed")
    folder = new_folder(spark, "stream")
    source = os.path.join(folder, "source")
    if shuffled:
        portion = F.pmod(F.xxhash64(by), F.lit(PORTIONS))
    else:
        low, high = stored.agg(F.min(by), F.max(by)).first()
        portion = F.floor((F.col(by) - low) * PORTIONS / (high - low + 1))
    for i in range(PORTIONS):
        stored.where(portion == i).write.mode("append").parquet(source)
        stream = spark.readStream.schema(stored.schema).parquet(source)
        start(stream, folder).awaitTermination()
    return folder


@query("stream_profile", EMA_SQL, ("patches",))
def stream_profile(spark, sf):
    """The profile a stream arrives at equals the batch one."""

    def start(stream, folder):
        return profile_stream.profile_stream(
            stream, os.path.join(folder, "store"), os.path.join(folder, "checkpoint"), ["category"], every=2, n=60
        )

    folder = feed(spark, fx.arrivals(spark, sf), "step", start)
    store = os.path.join(folder, "store")
    fitted = profile_stream.current_profile(spark, store)
    refits = spark.read.parquet(os.path.join(store, "history")).groupBy("category").agg(
        (F.count("*") - 1).alias("version")
    )
    return profile_facts(fitted.join(refits, "category"))


@query("stream_score", "SELECT image_id, patch_idx, round(score, 6) AS deviation FROM scores", ("scores",))
def stream_score(spark, sf):
    """Arriving patches scored with a stored profile."""
    store = new_folder(spark, "store")
    profile64(spark, sf).write.parquet(os.path.join(store, "profile", "batch=0"))

    def start(stream, folder):
        return profile_stream.score_stream(
            stream, store, os.path.join(folder, "scored"), os.path.join(folder, "checkpoint"), ["category"]
        )

    folder = feed(spark, fx.patches(spark, sf), "image_id", start)
    scored = spark.read.parquet(os.path.join(folder, "scored"))
    return scored.select("image_id", "patch_idx", r6(F.col("deviation")).alias("deviation"))


@query(
    "stream_early_stop",
    STOP_SQL + " SELECT run_id, epoch, round(metric, 6) AS metric, round(best, 6) AS best, bad AS bad_epochs, stopped FROM fold",
    ("epoch_metrics",),
)
def stream_early_stop(spark, sf):
    """Early stopping with its state kept across batches of epochs."""
    metric = combined_metric(F.col("image_metric"), F.col("patch_metric"))
    epochs = combined(spark, sf).select("run_id", "epoch", metric.alias("metric"))

    def start(stream, folder):
        states = metric_stream.early_stop_stream(stream, patience=7, min_delta=0.001)
        return (
            states.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
            .option("checkpointLocation", os.path.join(folder, "checkpoint"))
            .start(os.path.join(folder, "states"))
        )

    folder = feed(spark, epochs, "epoch", start)
    out = spark.read.schema(metric_stream.STOP_SCHEMA).parquet(os.path.join(folder, "states"))
    return out.withColumns({c: r6(F.col(c)) for c in ("metric", "best")})


@query(
    "stream_running_loss",
    """SELECT run_id, epoch, key, round(avg(value), 9) AS running_mean, count(*) AS n_steps FROM metric_log
    GROUP BY ALL""",
    ("metric_log",),
)
def stream_running_loss(spark, sf):
    """Running means per epoch, each batch writing the rows it changed."""
    log = fx.metric_log(spark, sf).drop("user_id")

    def start(stream, folder):
        def write(batch, batch_id):
            batch.write.mode("overwrite").parquet(os.path.join(folder, "means", f"batch={batch_id}"))

        return (
            metric_stream.running_loss_stream(stream).writeStream.outputMode("update").trigger(availableNow=True)
            .option("checkpointLocation", os.path.join(folder, "checkpoint")).foreachBatch(write).start()
        )

    folder = feed(spark, log, "step", start)
    written = spark.read.parquet(os.path.join(folder, "means"))
    latest = written.groupBy("run_id", "epoch", "key").agg(
        F.max_by(F.struct("running_mean", "n_steps"), "batch").alias("_row")
    )
    return latest.select("run_id", "epoch", "key", r9(F.col("_row.running_mean")).alias("running_mean"), "_row.n_steps")




@query(
    "stream_running_loss_every",
    """SELECT run_id, epoch, key, n - 1 AS step, n AS n_steps, round(total / n, 9) AS running_mean FROM (
    SELECT *, sum(value) OVER w AS total, row_number() OVER w AS n FROM metric_log
    WINDOW w AS (PARTITION BY run_id, epoch, key ORDER BY step)) WHERE n % 10 = 0""",
    ("metric_log",),
)
def stream_running_loss_every(spark, sf):
    """Running means given out at every tenth step, though steps arrive shuffled and the stream restarts."""
    log = with_position(fx.metric_log(spark, sf).drop("user_id"), ["step"], ["run_id", "epoch", "key"], "at")
    log = log.select("run_id", "epoch", "key", F.col("at").alias("step"), "value")

    def start(stream, folder):
        means = metric_stream.running_loss_every(stream, 10)
        return (
            means.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
            .option("checkpointLocation", os.path.join(folder, "checkpoint"))
            .start(os.path.join(folder, "means"))
        )

    folder = feed(spark, log, "step", start, shuffled=True)
    out = spark.read.schema(metric_stream.EVERY_SCHEMA).parquet(os.path.join(folder, "means"))
    return out.withColumn("running_mean", r9(F.col("running_mean")))
