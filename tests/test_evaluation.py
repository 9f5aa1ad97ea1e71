"""Ranking metrics against pair counting and brute force."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from normatile.functions.scores import combined_metric, squash
from normatile.operators import evaluation as ev


def frame(spark, scores, labels, g=None):
    data = pd.DataFrame({"s": np.asarray(scores, float), "y": np.asarray(labels, int)})
    if g is not None:
        data["g"] = g
    return spark.createDataFrame(data)


def pair_auroc(s, y):
    s, y = np.asarray(s, float), np.asarray(y)
    pos, neg = s[y == 1][:, None], s[y == 0][None, :]
    return ((pos > neg) + 0.5 * (pos == neg)).mean() if pos.size and neg.size else None


def brute_curve(s, y):
    s, y = np.asarray(s, float), np.asarray(y)
    out = []
    for t in np.unique(s):
        hit = s >= t
        out.append((t, y[hit].mean(), y[hit].sum() / y.sum()))
    return out


def test_metrics_match_brute_force_with_ties_and_a_hot_group(spark, rng):
    n = 1200
    g = np.where(rng.random(n) < 0.8, "hot", "cold")
    s = rng.integers(0, 40, n) / 8.0
    y = (rng.random(n) < 0.2 + s / 10).astype(int)
    df = frame(spark, s, y, g).repartition(6)
    summary = {r.g: r for r in ev.summarize(ev.ranking(df, "s", "y", ["g"]), ["g"]).collect()}
    f1 = {r.g: r for r in ev.best_f1(df, "s", "y", ["g"]).collect()}
    curve = ev.pr_curve(df, "s", "y", ["g"]).toPandas()
    for key in ("hot", "cold"):
        part = g == key
        points = brute_curve(s[part], y[part])
        assert np.isclose(summary[key].auroc, pair_auroc(s[part], y[part]))
        recalls = [0.0] + [r for _, _, r in points[::-1]]
        ap = sum((b - a) * p for a, b, (_, p, _) in zip(recalls, recalls[1:], points[::-1]))
        assert np.isclose(summary[key].average_precision, ap)
        best = [2 * p * r / (p + r + 1e-8) for _, p, r in points]
        assert np.isclose(f1[key].best_f1, max(best)) and f1[key].threshold == points[int(np.argmax(best))][0]
        got = curve[(curve.g == key) & curve.threshold.notna()].sort_values("threshold")
        assert np.allclose(got[["threshold", "precision", "recall"]], points)
        end = curve[(curve.g == key) & curve.threshold.isna()]
        assert end[["precision", "recall"]].values.tolist() == [[1.0, 0.0]]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 12), st.booleans()), min_size=1, max_size=40))
def test_auroc_is_unchanged_by_monotone_maps(spark, rows):
    s, y = [a for a, _ in rows], [int(b) for _, b in rows]
    df = frame(spark, s, y)
    got = ev.auroc(df, "s", "y").first().auroc
    want = pair_auroc(s, y)
    assert (got is None) == (want is None)
    if want is not None:
        assert np.isclose(got, want)
        assert np.isclose(ev.auroc(df.withColumn("s", squash(F.col("s"))), "s", "y").first().auroc, want)


def test_one_class_is_undefined(spark):
    df = frame(spark, [1, 2, 3, 4], [1, 1, 0, 0], ["a", "a", "b", "b"])
    out = {r.g: r for r in ev.auroc(df, "s", "y", ["g"]).collect()}
    assert out["a"].auroc is None and out["b"].auroc is None
    assert {r.n_classes for r in ev.class_counts(df, "y", ["g"]).collect()} == {1}
    assert ev.class_counts(df, "y").first().n_classes == 2
    assert {r.g for r in ev.pr_curve(df, "s", "y", ["g"]).collect()} == {"a"}


def test_combined_metric(spark):
    df = spark.createDataFrame([(0.8, 0.6), (0.8, None), (None, 0.6), (None, None)], "a double, b double")
    assert [r[0] for r in df.select(combined_metric(F.col("a"), F.col("b"))).collect()] == [pytest.approx(0.7), 0.8, None, None]


def test_inventory_and_pairing(spark):
    df = frame(spark, [0.5, 2.0, 1.0], [0, 1, 1])
    row = ev.score_inventory(df, "s", "y").first()
    assert (row.total, row.normal, row.anomaly, row.min_score, row.max_score) == (3, 1, 2, 0.5, 2.0)
    scores = spark.createDataFrame([(1, 0), (1, 1)], "image_id int, patch_idx int")
    truth = spark.createDataFrame([(1, 1, 1)], "image_id int, patch_idx int, y int")
    paired = ev.pair_labels(scores, truth, ["image_id", "patch_idx"], "y")
    assert {r.patch_idx: r.y for r in paired.collect()} == {0: 0, 1: 1}
