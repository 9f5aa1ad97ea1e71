"""Scores, attention and pruning against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from normatile.functions import schedules
from normatile.operators import attention, profile, pruning, scoring, vectors
from tests.test_profile import vectors as table


def grid(spark, x, images):
    per = len(x) // images
    return table(
        spark, x, image_id=np.repeat(np.arange(images), per), patch_idx=np.tile(np.arange(per), images),
        g=np.repeat([f"g{i % 3}" for i in range(images)], per),
    )


@pytest.mark.parametrize("width", [4, 30])
def test_mahalanobis_matches_numpy(spark, rng, width):
    x = rng.normal(size=(240, width)).astype(np.float32)
    df = grid(spark, x, 6)
    fitted = profile.fit_profile(df, ["g"])
    out = scoring.mahalanobis(df, fitted, ["g"], gamma=1.3).toPandas()
    plain = scoring.mahalanobis(df, fitted, ["g"], gamma=None).toPandas()
    merged = out.merge(plain, on=["image_id", "patch_idx"])
    wide = x.astype(float).reshape(6, 40, width)
    for g in range(3):
        part = wide[g::3].reshape(-1, width)
        p = np.linalg.inv(np.cov(part.T) + 1e-6 * np.eye(width))
        for i in (g, g + 3):
            c = wide[i] - part.mean(axis=0)
            q = np.einsum("nd,de,ne->n", c, p, c)
            rows = merged[merged.image_id == i].sort_values("patch_idx")
            assert np.allclose(rows["deviation_y"], q)
            assert np.allclose(rows["deviation_x"], (q + 1e-8) ** 1.3)
            assert not np.allclose(rows["deviation_x"], rows["deviation_y"])


def test_models_larger_than_one_broadcast_are_scored_in_pieces(spark, rng):
    df = grid(spark, rng.normal(size=(240, 12)), 6)
    fitted = profile.fit_profile(df, ["g"])
    whole = scoring.mahalanobis(df, fitted, ["g"]).toPandas()
    pieces = scoring.mahalanobis(df, fitted, ["g"], model_bytes=12 * 12 * 8).toPandas()
    both = whole.merge(pieces, on=["image_id", "patch_idx"])
    assert len(pieces) == 240 and np.allclose(both["deviation_x"], both["deviation_y"])


@pytest.mark.parametrize("width", [4, 12])
def test_no_profile_scores_zero(spark, rng, width):
    df = grid(spark, rng.normal(size=(60, width)), 6)
    fitted = profile.fit_profile(df, ["g"])
    out = scoring.mahalanobis(df, fitted.where("g = 'g1'"), ["g"]).toPandas()
    assert (out.loc[out.g != "g1", "deviation"] == 0).all() and (out.loc[out.g == "g1", "deviation"] > 0).all()
    none = scoring.mahalanobis(df, fitted.where("g = 'zz'"), ["g"]).toPandas()
    assert (none["deviation"] == 0).all() and len(none) == 60


def test_image_score(spark):
    rows = [(1, i, float(v)) for i, v in enumerate([5, 1, 9, 7])] + [(2, 0, 4.0), (2, 1, 2.0)]
    out = dict(scoring.image_score(spark.createDataFrame(rows, "image_id int, patch_idx int, score double")).collect())
    assert out == {1: 7.0, 2: 3.0}


def softmax(l):
    e = np.exp(l - l.max(axis=0))
    return e / e.sum(axis=0)


@pytest.mark.parametrize("scale", [1.0, 400.0])
def test_attention_matches_numpy_and_sums_to_one(spark, rng, scale):
    p = (rng.normal(size=(3, 150, 8)) * scale).astype(np.float32)
    q = rng.normal(size=(3, 4, 6))
    w, b = rng.normal(size=(8, 6)), rng.normal(size=8)
    patches = grid(spark, p.reshape(-1, 8), 3)
    queries = table(spark, q.reshape(-1, 6), image_id=np.repeat(np.arange(3), 4), query_idx=np.tile(np.arange(4), 3))
    out = attention.attention(patches, queries.withColumn("embedding", F.col("embedding").cast("array<double>")), weight=w, bias=b)
    out = out.toPandas().sort_values(["image_id", "patch_idx"])
    weights = np.array(out["weights"].tolist()).reshape(3, 150, 4)
    assert np.allclose(weights.sum(axis=1), 1.0, atol=1e-9)
    assert (out["importance"] >= 0).all() and (out["n_queries"] == 4).all()
    for i in range(3):
        want = softmax(p[i].astype(float) @ (q[i].astype(np.float32) @ w.T + b).T / np.sqrt(8))
        assert np.allclose(weights[i], want, atol=1e-7)


def test_schedule(spark):
    steps = spark.range(16).select("id", schedules.keep_count(F.col("id")).alias("n")).toPandas().sort_values("id")["n"]
    assert steps.iloc[0] == 256 and steps.iloc[15] == 32 and (steps.diff().dropna() <= 0).all()
    assert schedules.keep_counts(8, 256, 32) == [256, 218, 185, 155, 128, 105, 85, 65]
    assert steps.tolist()[:15] == schedules.keep_counts(15, 256, 32)


def simulate(l, d, steps):
    left = np.arange(len(d))
    for n in steps:
        score = 0.4 * softmax(l[left]).sum(axis=1) + 0.4 * d[left]
        left = np.sort(left[np.lexsort((left, -score))[:n]])
    return set(left)


@pytest.mark.parametrize("window_patches", [1000, 40, 1])
def test_pruning_routes_agree_with_numpy(spark, rng, window_patches):
    sizes = {0: 50, 1: 30, 2: 12}
    rows, want = [], {}
    for image, n in sizes.items():
        l, d = rng.normal(size=(n, 3)), rng.random(n)
        rows += [(image, i, l[i].tolist(), float(d[i])) for i in range(n)]
        want[image] = simulate(l, d, schedules.keep_counts(5, 50, 6))
    df = spark.createDataFrame(rows, "image_id long, patch_idx long, logits array<double>, deviation double")
    out = pruning.prune_patches(df, 3, n_max=50, n_min=6, t_steps=5, window_patches=window_patches).toPandas()
    got = {i: set(part["patch_idx"]) for i, part in out.groupby("image_id")}
    assert got == want


def test_pruning_stops_where_nothing_is_removed(spark, rng):
    rows = [(0, i, [0.0, 1.0], float(i)) for i in range(20)] + [(1, i, [0.0, 1.0], float(i)) for i in range(25)]
    df = spark.createDataFrame(rows, "image_id long, patch_idx long, logits array<double>, deviation double")
    out = pruning.prune_patches(df, 2, n_max=20, n_min=4, t_steps=4, on_noop="stop")
    assert dict(out.groupBy("image_id").count().collect()) == {0: 20, 1: schedules.keep_counts(4, 20, 4)[-1]}
    assert pruning.active_steps(20, 4, 20, 4) == schedules.keep_counts(4, 20, 4)[1:]
    assert pruning.active_steps(20, 4, 20, 4, "stop") == []
    with pytest.raises(ValueError):
        pruning.prune_patches(df, 2, on_noop="maybe")


def test_vector_layers_match_numpy(spark, rng):
    x = rng.normal(size=(37, 6)).astype(np.float32)
    w, b, w2 = rng.normal(size=(5, 6)), rng.normal(size=5), rng.normal(size=5)
    df = table(spark, x, i=range(37)).repartition(3)
    v = F.col("embedding")
    out = df.select(
        "i", vectors.linear(v, w, b).alias("l"), vectors.layernorm_linear(v, w, b).alias("n"),
        vectors.mlp_head(v, w, b, w2, 0.5).alias("h"), vectors.center(v, F.array(*[F.lit(1.0)] * 6)).alias("c"),
    ).toPandas().sort_values("i")
    xd = x.astype(float)
    norm = (xd - xd.mean(1, keepdims=True)) / np.sqrt(xd.var(1, keepdims=True) + 1e-5)
    from math import erf

    h = xd @ w.T + b
    gelu = 0.5 * h * (1 + np.vectorize(erf)(h / np.sqrt(2)))
    assert np.allclose(np.array(out["l"].tolist()), h)
    assert np.allclose(np.array(out["n"].tolist()), norm @ w.T + b)
    assert np.allclose(out["h"], gelu @ w2 + 0.5)
    assert np.allclose(np.array(out["c"].tolist()), xd - 1.0)


def test_tokens_split_and_join(spark):
    tokens = spark.createDataFrame([(0, t, [float(t)]) for t in range(4)], "image_id long, token_idx long, embedding array<double>")
    cls, body = vectors.keep_cls(tokens), vectors.drop_cls(tokens)
    assert [r.patch_idx for r in body.orderBy("patch_idx").collect()] == [0, 1, 2] and cls.count() == 1
    again = vectors.concat_tokens(cls, body)
    assert sorted(map(tuple, again.select("image_id", "token_idx").collect())) == [(0, t) for t in range(4)]
    assert vectors.centroid(body).first().embedding == [2.0]
