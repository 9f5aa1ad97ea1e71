"""Profiles against numpy, the exponential average against the sequential rule, and the store."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from normatile.operators import profile, scoring
from normatile.session import new_folder
from normatile.sources import reports


def vectors(spark, x, **columns):
    frame = pd.DataFrame({**columns, "embedding": [v.tolist() for v in x]})
    return spark.createDataFrame(frame).withColumn("embedding", F.col("embedding").cast("array<float>"))


def matrix(rows):
    return np.array([list(r) for r in rows])


def test_profile_matches_numpy_with_a_hot_group(spark, rng):
    x = rng.normal(size=(400, 20)).astype(np.float32)
    g = np.where(rng.random(400) < 0.8, "hot", "cold")
    df = vectors(spark, x, g=g).repartition(7)
    for row in profile.fit_profile(df, ["g"], reg=1e-3).collect():
        part = x[g == row.g].astype(float)
        sigma = np.cov(part.T) + 1e-3 * np.eye(20)
        assert row.n == len(part)
        assert np.allclose(row.mu, part.mean(axis=0))
        assert np.allclose(matrix(row.sigma), sigma)
        assert np.allclose(matrix(row.sigma_inv), np.linalg.inv(sigma))


def test_partial_sums_can_be_flushed(spark, rng, monkeypatch):
    x = rng.normal(size=(200, 5))
    df = vectors(spark, x, a=[i % 6 for i in range(200)], b=[str(i % 2) for i in range(200)])
    whole = {(r.a, r.b): r for r in profile.fit_profile(df, ["a", "b"]).collect()}
    monkeypatch.setattr(profile, "PARTIAL_BYTES", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        flushed = {(r.a, r.b): r for r in profile.fit_profile(df, ["a", "b"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert whole.keys() == flushed.keys() and len(whole) == 6
    for key in whole:
        assert np.allclose(matrix(whole[key].sigma), matrix(flushed[key].sigma))


def test_tall_and_wide_like_a_real_encoder(spark, rng):
    """Fewer rows than dimensions: singular without the regulariser."""
    x = rng.normal(size=(60, 150))
    fitted = profile.fit_profile(vectors(spark, x, g=["a"] * 60), ["g"], reg="1e-2")
    row = fitted.first()
    assert len(row.mu) == 150 and matrix(row.sigma_inv).shape == (150, 150)
    scores = scoring.mahalanobis(vectors(spark, x, g=["a"] * 60), fitted, ["g"]).toPandas()["deviation"]
    assert (scores >= 0).all() and np.isfinite(scores).all()


def test_single_row_has_no_profile(spark, rng):
    df = vectors(spark, rng.normal(size=(4, 3)), g=["a", "b", "b", "b"])
    assert [r.g for r in profile.fit_profile(df, ["g"]).collect()] == ["b"]
    assert {r.g for r in profile.fit_profile(df, ["g"], floor_one=True).collect()} == {"a", "b"}
    assert profile.fit_profile(df.where("g = 'z'"), ["g"]).count() == 0


def test_only_normal_patches_enter_the_buffer(spark, rng):
    x = rng.normal(size=(512, 4))
    y = np.zeros(512, int)
    y[:10] = 1
    df = vectors(spark, x, image_id=np.repeat([0, 1], 256), patch_idx=np.tile(np.arange(256), 2), y=y)
    df = df.withColumn("step", F.lit(0))
    row = profile.buffer_statistics(profile.add_normal(df), 1000).first()
    assert row.n == 502
    assert np.allclose(row.mu, x.astype(np.float32)[10:].mean(axis=0), atol=1e-6)
    short = profile.buffer_statistics(profile.add_normal(df), 100).first()
    assert short.n == 100 and np.allclose(short.mu, x[-100:].mean(axis=0), atol=1e-6)


@pytest.mark.parametrize("every,n", [(1, 12), (2, 9), (3, 100)])
def test_ema_matches_the_sequential_rule(spark, rng, every, n):
    steps, per = 8, 5
    x = rng.normal(size=(steps * per, 3)).astype(np.float32)
    step = np.repeat(np.arange(steps), per)
    # Step 4 brings no normal patches.
    alive = step != 4
    df = vectors(spark, x[alive], step=step[alive], image_id=step[alive], patch_idx=np.tile(np.arange(per), steps)[alive])
    row = profile.ema_profile(df, every=every, n=n, momentum=0.1).first()
    mu = sigma = None
    for at in range(0, steps, every):
        buffer = x[alive & (step <= at)][-n:].astype(float)
        m, s = buffer.mean(axis=0), np.cov(buffer.T) + 1e-6 * np.eye(3)
        mu, sigma = (m, s) if mu is None else (0.9 * mu + 0.1 * m, 0.9 * sigma + 0.1 * s)
    assert row.version == len(range(0, steps, every)) - 1
    assert np.allclose(row.mu, mu) and np.allclose(matrix(row.sigma), sigma)
    assert np.allclose(matrix(row.sigma_inv), np.linalg.inv(sigma))


def test_store_versions_defaults_and_legacy_form(spark, rng):
    fitted = profile.fit_profile(vectors(spark, rng.normal(size=(20, 2)), g=["a", "b"] * 10), ["g"])
    path = new_folder(spark, "store")
    reports.save_profile(fitted, path, 1, epoch=3)
    reports.save_profile(fitted.where("g = 'a'").withColumn("n", F.lit(99).cast("long")), path, 2, epoch=4, note="late")
    latest = {r.g: r for r in reports.load_profile(spark, path, ["g"]).collect()}
    assert latest["a"].n == 99 and latest["a"].version == 2 and latest["a"].note == "late"
    assert latest["b"].n == 10 and latest["b"].note is None
    legacy = new_folder(spark, "legacy")
    fitted.where("g = 'a'").select("g", "mu").write.parquet(legacy)
    loaded = {r.g: r for r in reports.load_profile(spark, legacy, ["g"], defaults=fitted).collect()}
    assert set(loaded) == {"a", "b"} and loaded["a"].n == 10


def test_a_version_saved_again_replaces_it_and_half_written_ones_do_not_count(spark, rng, capsys):
    fitted = profile.fit_profile(vectors(spark, rng.normal(size=(20, 2)), g=["a", "b"] * 10), ["g"])
    path = new_folder(spark, "store")
    for n in (1, 2):
        reports.save_profile(fitted.withColumn("n", F.lit(n).cast("long")), path, 1)
    reports.save_profile(fitted, path, 7)
    reports.save_profile(fitted.withColumn("n", F.lit(99).cast("long")), path, 8)
    os.remove(f"{path}/version=8/_SUCCESS")  # the writer died before its commit
    assert sorted((r.g, r.n, r.version) for r in reports.load_profile(spark, path, ["g"]).collect()) == [("a", 10, 7), ("b", 10, 7)]
    assert sorted((r.g, r.n) for r in reports.load_profile(spark, path, ["g"], version=1).collect()) == [("a", 2), ("b", 2)]
    files = reports.load_profile(spark, path, ["g"]).select("mu").inputFiles()
    assert files and all("version=7" in f or "profile-versions" in f for f in files)
    with pytest.raises(ValueError):
        reports.load_profile(spark, path, ["g"], version=8)
