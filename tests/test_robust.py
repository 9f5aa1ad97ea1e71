"""NULL keys, odd vectors, missing patches, far-off features: same answers at any size and width."""

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from normatile.operators import attention, ordering, profile, pruning, rollups, scoring
from tests.test_profile import matrix, vectors


@pytest.fixture
def eight_slices(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_null_groups_are_groups_in_every_ordering(eight_slices):
    spark = eight_slices
    df = spark.range(1000).select("id", F.when(F.col("id") % 5 == 0, F.lit("g")).alias("g"), F.lit(1).alias("v"))
    totals = ordering.running_totals(df, ["g"], ["id"], {"t": F.col("v")}).toPandas()
    assert totals[totals.g.isna()].t.max() == 800 and totals[totals.g == "g"].t.max() == 200
    assert ordering.assign_batches(df, "id", 8, drop_last=False, group=["g"]).count() == 1000
    parts = ordering.permutation_split(df, "id", group=["g"]).toPandas()
    assert parts[parts.g.isna()].part.value_counts().to_dict() == {"val": 400, "train": 400}
    bounds = {r.g: r.p_high for r in ordering.percentile_bounds(df, ["g"], "id", 0.0, 50.0).collect()}
    assert bounds[None] == pytest.approx(np.percentile([i for i in range(1000) if i % 5], 50))
    recent = ordering.last_n(df.withColumn("step", F.floor(F.col("id") / 10)), 15, "step", ["id"], ["g"]).toPandas()
    assert recent[recent.g.isna()].shape[0] == 15


def test_totals_that_start_with_null_are_carried(eight_slices):
    df = eight_slices.range(800).select("id", F.lit("g").alias("g"), F.when(F.col("id") >= 790, 1).alias("a"), F.lit(1).alias("b"))
    out = ordering.running_totals(df, ["g"], ["id"], {"a": F.col("a"), "b": F.col("b")}).drop("a", "b")
    assert "g" in out.columns
    out = ordering.running_totals(df, ["g"], ["id"], {"sa": F.col("a"), "sb": F.col("b")}).orderBy("id").toPandas()
    assert out.sb.tolist() == list(range(1, 801))


def test_covariance_far_from_zero(spark):
    rng = np.random.default_rng(1)
    x = 1e6 + 1e-2 * rng.normal(size=(20000, 2))
    df = spark.createDataFrame(pd.DataFrame({"g": "a", "embedding": x.tolist()})).repartition(6)
    row = profile.fit_profile(df, ["g"], reg=0.0).first()
    assert np.allclose(matrix(row.sigma), np.cov(x.T), rtol=1e-5) and np.allclose(row.mu, x.mean(axis=0))


def odd_vectors(spark, width, rng):
    good = rng.normal(size=(60, width))
    rows = [(i, "a" if i % 2 else None, v.tolist()) for i, v in enumerate(good)]
    bad = good[0].copy()
    bad[0] = np.nan
    rows += [(100, "a", bad.tolist()), (101, None, None), (102, "b", good[1].tolist()), (103, "a", [None] * width)]
    return spark.createDataFrame(rows, "patch_idx long, g string, embedding array<double>").repartition(4)


@pytest.mark.parametrize("width", [2, 8, 9, 64])
def test_scores_do_not_depend_on_width_or_model_size(spark, rng, width):
    df = odd_vectors(spark, width, rng)
    fitted = profile.fit_profile(df, ["g"], reg=1e-3).where("g is null or g <> 'b'")
    assert {r.g: r.n for r in fitted.collect()} == {"a": 30, None: 30}
    whole = {r.patch_idx: r.deviation for r in scoring.mahalanobis(df, fitted, ["g"]).collect()}
    dealt = {r.patch_idx: r.deviation for r in scoring.mahalanobis(df, fitted, ["g"], model_bytes=1).collect()}
    assert whole.keys() == dealt.keys() and len(whole) == 64
    for k, v in whole.items():
        assert (v is None) == (dealt[k] is None) and (v is None or np.isclose(v, dealt[k]))
    assert whole[100] is None and whole[101] is None and whole[103] is None and whole[102] == 0.0
    assert all(whole[i] > 0 for i in range(60))
    twice = fitted.unionByName(fitted)
    for size in (1 << 30, 1):
        with pytest.raises((ValueError, PySparkException)):
            scoring.mahalanobis(df, twice, ["g"], model_bytes=size).collect()


def test_many_groups_are_scored_in_one_shuffle_of_vectors(spark, rng):
    x = rng.normal(size=(400, 6))
    df = vectors(spark, x, g=[f"g{i % 20}" for i in range(400)], patch_idx=range(400))
    fitted = profile.fit_profile(df, ["g"], reg=1e-2)
    small = scoring.mahalanobis(df, fitted, ["g"], model_bytes=100)
    whole = scoring.mahalanobis(df, fitted, ["g"])
    a, b = (t.toPandas().sort_values("patch_idx").deviation.to_numpy() for t in (small, whole))
    assert np.allclose(a, b)


def test_missing_patches_leave_null_pixels(spark):
    rows = [(1, i, float(i)) for i in range(25)] + [(2, i, float(i)) for i in range(24)]
    df = spark.createDataFrame(rows, "image_id int, patch_idx int, score double")
    heat = rollups.heatmap(df, 5, 40).groupBy("image_id").agg(F.count("*").alias("n"), F.count("value").alias("known")).collect()
    found = {r.image_id: (r.n, r.known) for r in heat}
    assert found[1] == (1600, 1600) and found[2][0] == 1600 and 1400 < found[2][1] < 1600
    masks = spark.createDataFrame([(1, 3, 3, 1), (2, 5, 5, 1)], "image_id int, y int, x int, m int")
    got = rollups.pixel_auroc(df, masks, 5, 40).first()
    assert got.positives == 2 and got.positives + got.negatives == 1600 + found[2][1]
    shown = rollups.display_heatmap(df, 5, 40).groupBy("image_id").agg(F.count("value").alias("k")).collect()
    assert {r.image_id: r.k for r in shown} == {1: 1600, 2: found[2][1]}
    with pytest.raises(PySparkException):
        rollups.heatmap(df.withColumn("patch_idx", F.col("patch_idx") + 1), 5, 40).collect()


def test_images_without_queries_keep_their_patches(spark, rng):
    x = rng.normal(size=(8, 3))
    patches = vectors(spark, x, image_id=[0] * 4 + [1] * 4, patch_idx=[0, 1, 2, 3] * 2)
    queries = vectors(spark, rng.normal(size=(2, 3)), image_id=[0, 0], query_idx=[0, 1])
    out = {(r.image_id, r.patch_idx): (r.importance, r.n_queries) for r in attention.attention(patches, queries).collect()}
    assert len(out) == 8 and out[1, 0] == (0.0, 0) and out[0, 0][1] == 2


def test_pruning_uses_all_logits_or_says_so(spark, rng):
    rows = [(0, i, rng.normal(size=5).tolist(), float(rng.random())) for i in range(30)]
    df = spark.createDataFrame(rows, "image_id long, patch_idx long, logits array<double>, deviation double")
    kept = [
        {r.patch_idx for r in pruning.prune_patches(df, n_max=30, n_min=4, t_steps=4, window_patches=w).collect()} for w in (100, 1)
    ]
    assert kept[0] == kept[1]
    with pytest.raises(ValueError):
        pruning.prune_patches(df, 3, n_max=30, n_min=4, t_steps=4)


def test_attention_without_some_vectors(spark, rng):
    """NULL and NaN vectors and a NULL image: those patches are unknown, the others share all attention."""
    rows, queries = [], []
    for image in (0, 1, None):
        for p in range(8):
            v = rng.normal(size=3).tolist()
            if image == 0 and p in (2, 5, 6):
                v = {2: None, 5: [1.0, float("nan"), 0.0], 6: [1.0, None, 0.0]}[p]
            rows.append((image, p, v))
        queries += [(image, q, rng.normal(size=3).tolist()) for q in range(2)]
    queries += [(0, 7, [float("inf"), 0.0, 0.0]), (1, 7, None)]
    patches = spark.createDataFrame(rows, "image_id long, patch_idx long, embedding array<double>").repartition(3)
    asked = spark.createDataFrame(queries, "image_id long, query_idx long, embedding array<double>")
    out = {(r.image_id, r.patch_idx): r for r in attention.attention(patches, asked).collect()}
    assert len(out) == 24
    for image in (0, 1, None):
        good = [(p, np.array(v)) for i, p, v in rows if i == image and not (image == 0 and p in (2, 5, 6))]
        q = np.array([v for i, _, v in queries if i == image and v is not None and np.isfinite(v).all()])
        logits = np.stack([v for _, v in good]) @ q.T / np.sqrt(3)
        e = np.exp(logits - logits.max(axis=0))
        weights = e / e.sum(axis=0)
        for k, (p, _) in enumerate(good):
            assert np.allclose(out[image, p].weights, weights[k]) and np.isclose(out[image, p].importance, weights[k].sum())
            assert out[image, p].n_queries == 2
        assert np.isclose(sum(out[image, p].importance for p, _ in good), 2)
    assert all(out[0, p].weights is None and out[0, p].importance is None for p in (2, 5, 6))


@pytest.mark.parametrize("window_patches", [100, 1])
def test_pruning_drops_patches_without_a_score_first(spark, window_patches):
    rows = [(1, p, None if p == 3 else [float(p), 0.0], 0.0) for p in range(6)] + [(1, 6, [9.0, float("nan")], 0.0), (1, 7, [9.0, 9.0], None)]
    rows += [(None, p, [float(p), 0.0], 0.0) for p in range(6)]
    df = spark.createDataFrame(rows, "image_id long, patch_idx long, logits array<double>, deviation double")
    kept = pruning.prune_patches(df, n_max=2, n_min=2, t_steps=1, window_patches=window_patches).collect()
    assert {(r.image_id, r.patch_idx) for r in kept} == {(1, 4), (1, 5), (None, 4), (None, 5)}
