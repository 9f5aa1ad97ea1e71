"""Streams end where the batch operators do, and pick up where they stopped."""

import os

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from normatile.operators import profile, runs
from normatile.session import new_folder
from normatile.streaming import metric_stream, profile_stream
from tests.test_profile import matrix, vectors


def test_profile_stream_equals_batch(spark, rng):
    steps, per = 6, 8
    x = rng.normal(size=(steps * per, 3)).astype(np.float32)
    y = (rng.random(steps * per) < 0.2).astype(int)
    step = np.repeat(np.arange(steps), per)
    df = vectors(spark, x, g=np.where(np.arange(steps * per) % 4 == 0, "a", "b"), step=step, image_id=step, patch_idx=np.tile(np.arange(per), steps), y=y)
    folder = new_folder(spark, "test-stream")
    source, store = os.path.join(folder, "in"), os.path.join(folder, "store")
    for low, high in ((0, 2), (2, 5), (5, 6)):
        df.where(F.col("step").between(low, high - 1)).write.mode("append").parquet(source)
        stream = spark.readStream.schema(df.schema).parquet(source)
        profile_stream.profile_stream(stream, store, os.path.join(folder, "cp"), ["g"], every=2, n=15).awaitTermination()
    got = {r.g: r for r in profile_stream.current_profile(spark, store).collect()}
    want = {r.g: r for r in profile.ema_profile(profile.add_normal(df), every=2, n=15, group=["g"]).collect()}
    assert got.keys() == want.keys()
    for g in want:
        assert np.allclose(got[g].mu, want[g].mu) and np.allclose(matrix(got[g].sigma_inv), matrix(want[g].sigma_inv))
    held = spark.read.parquet(os.path.join(store, "buffer", "batch=2"))
    assert {r["count"] <= 15 for r in held.groupBy("g").count().collect()} == {True}


def test_early_stop_state_survives_restarts(spark):
    frame = pd.DataFrame({"run_id": ["a", "b"] * 9, "epoch": np.repeat(np.arange(9), 2), "metric": [0.5, 0.1, 0.6, 0.2, 0.6, 0.3, 0.6, 0.4, 0.6, 0.5, 0.9, 0.6, 0.9, 0.7, 0.9, 0.8, 0.9, 0.9]})
    df = spark.createDataFrame(frame)
    folder = new_folder(spark, "test-stop")
    for low in (0, 3, 6):
        df.where(F.col("epoch").between(low, low + 2)).write.mode("append").parquet(folder + "/in")
        states = metric_stream.early_stop_stream(spark.readStream.schema(df.schema).parquet(folder + "/in"), patience=3)
        (
            states.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
            .option("checkpointLocation", folder + "/cp").start(folder + "/out").awaitTermination()
        )
    out = spark.read.parquet(folder + "/out").toPandas().sort_values(["run_id", "epoch"])
    a, b = out[out.run_id == "a"], out[out.run_id == "b"]
    assert a["stopped"].tolist() == [False] * 4 + [True] * 5
    assert a["best"].iloc[-1] == 0.6 and not b["stopped"].any() and b["best"].iloc[-1] == 0.9


def test_stream_scores_zero_before_any_profile(spark, rng):
    df = vectors(spark, rng.normal(size=(6, 3)), g=["a"] * 6)
    folder = new_folder(spark, "test-score")
    df.write.parquet(folder + "/in")
    stream = spark.readStream.schema(df.schema).parquet(folder + "/in")
    profile_stream.score_stream(stream, folder + "/none", folder + "/out", folder + "/cp", ["g"]).awaitTermination()
    out = spark.read.parquet(folder + "/out")
    assert out.count() == 6 and out.where("deviation <> 0").count() == 0


def test_a_backlog_of_a_thousand_refits_is_one_set_of_jobs(spark, rng):
    """All refits of one batch at once, from an empty and from a filled store, equal the batch profile."""
    def rows(steps, first):
        n = len(steps)
        return vectors(spark, rng.normal(size=(n, 3)) + 0.01 * np.array(steps)[:, None], g=np.where(rng.random(n) < 0.7, "a", "b"), step=np.array(steps), image_id=np.array(steps), patch_idx=first + np.arange(n), y=(rng.random(n) < 0.1).astype(int))

    early, late = rows([0, 0, 1, 1, 2, 5], 0), rows(list(range(7, 1000)), 100)
    folder = new_folder(spark, "test-backlog")
    source, store = os.path.join(folder, "in"), os.path.join(folder, "store")
    jobs = []
    for part in (early, late):
        part.write.mode("append").parquet(source)
        before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
        stream = spark.readStream.schema(part.schema).parquet(source)
        profile_stream.profile_stream(stream, store, os.path.join(folder, "cp"), ["g"], every=1, n=20).awaitTermination()
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before)
    both = early.unionByName(late)
    got = {r.g: r for r in profile_stream.current_profile(spark, store).collect()}
    want = {r.g: r for r in profile.ema_profile(profile.add_normal(both), every=1, n=20, group=["g"]).collect()}
    assert got.keys() == want.keys() == {"a", "b"}
    for g in want:
        assert got[g].n == want[g].n and np.allclose(got[g].mu, want[g].mu) and np.allclose(matrix(got[g].sigma), matrix(want[g].sigma))
    refits = spark.read.parquet(os.path.join(store, "history")).groupBy("g").count().collect()
    assert max(r["count"] for r in refits) > 900
    assert jobs[1] < 150  # a refit is not a job


def test_superseded_state_is_removed(spark, rng):
    folder = new_folder(spark, "test-clean")
    for k in range(4):
        n = 6
        df = vectors(spark, rng.normal(size=(n, 2)), g=["a"] * n, step=[k] * n, image_id=[k] * n, patch_idx=range(n), y=[0] * n)
        df.write.mode("append").parquet(folder + "/in")
        stream = spark.readStream.schema(df.schema).parquet(folder + "/in")
        profile_stream.profile_stream(stream, folder + "/store", folder + "/cp", ["g"], every=2, n=8).awaitTermination()
    assert all(sorted(os.listdir(f"{folder}/store/{name}")) == ["batch=2", "batch=3"] for name in ("buffer", "progress", "profile"))
    assert profile_stream.current_profile(spark, folder + "/store").count() == 1


def test_running_means_every_k_steps_from_shuffled_batches(spark, rng):
    rows = [(run, e, "loss", s, float(rng.random())) for run in "ab" for e in range(3) for s in range(57 + 7 * e)]
    order = rng.permutation(len(rows))
    schema = "run_id string, epoch long, key string, step long, value double"
    folder = new_folder(spark, "test-every")
    for part in np.array_split(order, 5):
        chosen = [rows[i] for i in part] + [rows[part[0]]]  # one row comes twice
        spark.createDataFrame(chosen, schema).repartition(3).write.mode("append").parquet(folder + "/in")
        means = metric_stream.running_loss_every(spark.readStream.schema(schema).parquet(folder + "/in"), 10)
        (
            means.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
            .option("checkpointLocation", folder + "/cp").start(folder + "/out").awaitTermination()
        )
    got = spark.read.schema(metric_stream.EVERY_SCHEMA).parquet(folder + "/out").collect()
    want = runs.running_loss(spark.createDataFrame(rows, schema), 10).collect()
    assert len(got) == len(want) == len({(r.run_id, r.epoch, r.step) for r in got})
    exact = {(r.run_id, r.epoch, r.step): (r.n_steps, r.running_mean) for r in want}
    assert all(exact[r.run_id, r.epoch, r.step][0] == r.n_steps and np.isclose(exact[r.run_id, r.epoch, r.step][1], r.running_mean) for r in got)


def test_early_stop_stream_takes_many_epochs_at_once(spark, rng):
    n = 3000
    values = np.round(1 - np.exp(-np.arange(n) / 500) + rng.normal(0, 0.02, n), 4)
    frame = pd.DataFrame({"run_id": "a", "epoch": np.arange(n), "metric": np.where(rng.random(n) < 0.1, np.nan, values)})
    df = spark.createDataFrame(frame)
    folder = new_folder(spark, "test-stop-many")
    for low, high in ((0, 999), (1000, 1100), (1101, n)):
        df.where(F.col("epoch").between(low, high)).write.mode("append").parquet(folder + "/in")
        states = metric_stream.early_stop_stream(spark.readStream.schema(df.schema).parquet(folder + "/in"), patience=400, min_delta=0.01)
        (
            states.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
            .option("checkpointLocation", folder + "/cp").start(folder + "/out").awaitTermination()
        )
    got = spark.read.parquet(folder + "/out").toPandas().sort_values("epoch").reset_index(drop=True)
    want = runs.early_stopping(df, "metric", 400, min_delta=0.01).toPandas().sort_values("epoch").reset_index(drop=True)
    assert (got[["best", "bad_epochs", "stopped"]] == want[["best", "bad_epochs", "stopped"]]).all(axis=None)
