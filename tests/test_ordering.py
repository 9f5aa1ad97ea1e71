"""Running totals, positions, percentiles and buffers against pandas, with one very large group."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from normatile.operators import ordering


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    n = 5000
    frame = pd.DataFrame(
        {
            "g": np.where(rng.random(n) < 0.7, "hot", rng.choice(list("abc"), n)),
            "k": rng.permutation(n),
            "v": rng.integers(0, 100, n),
        }
    )
    return frame, spark.createDataFrame(frame)


def test_running_totals_match_pandas(spark, skewed):
    frame, df = skewed
    spread = df.repartition(16)
    out = ordering.running_totals(spread, ["g"], ["k"], {"total": F.col("v"), "n": F.lit(1).cast("long")}).toPandas()
    want = frame.sort_values(["g", "k"])
    want["total"] = want.groupby("g")["v"].cumsum()
    want["n"] = want.groupby("g").cumcount() + 1
    out = out.sort_values(["g", "k"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(out, want.reset_index(drop=True), check_dtype=False)


def test_large_group_is_spread_over_slices(spark, skewed):
    _, df = skewed
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sliced = df.repartitionByRange(4, "g", "k").withColumn("s", F.spark_partition_id())
        slices = sliced.where("g = 'hot'").select("s").distinct().count()
        out = ordering.running_totals(df, ["g"], ["k"], {"n": F.lit(1).cast("long")})
        assert slices > 1
        assert out.where("g = 'hot'").agg(F.max("n")).first()[0] == df.where("g = 'hot'").count()
        assert out.groupBy("g", "n").count().where("count > 1").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_positions_without_group_and_descending(spark, skewed):
    frame, df = skewed
    out = ordering.with_position(df, [F.desc("k")]).toPandas().set_index("k")["position"]
    want = pd.Series(range(len(frame)), index=sorted(frame["k"], reverse=True))
    assert (out.sort_index() == want.sort_index()).all()


@pytest.mark.parametrize("low,high", [(5.0, 95.0), (0.0, 100.0), (33.3, 50.0)])
def test_percentiles_match_numpy(spark, skewed, low, high):
    frame, df = skewed
    out = ordering.percentile_bounds(df, ["g"], "v", low, high).toPandas().set_index("g")
    for g, part in frame.groupby("g"):
        want = np.percentile(part["v"], [low, high])
        assert np.allclose(out.loc[g, ["p_low", "p_high"]].astype(float), want)


def test_percentiles_without_group(spark, skewed):
    frame, df = skewed
    row = ordering.percentile_bounds(df, [], "v").first()
    assert np.allclose([row.p_low, row.p_high], np.percentile(frame["v"], [5, 95]))


@pytest.mark.parametrize("per_step", [8, 1000])
def test_last_n(spark, per_step):
    """Steps inside and cut; with 1000 rows a step a whole group lies in one step."""
    frame = pd.DataFrame({"g": ["a"] * 60 + ["b"] * 7, "step": [i // per_step for i in range(67)], "pos": range(67), "v": "x"})
    df = spark.createDataFrame(frame).repartition(5)
    for n in (1, 8, 11, 100):
        out = ordering.last_n(df, n, "step", ["pos"], ["g"])
        want = frame.sort_values(["step", "pos"]).groupby("g").tail(n)
        assert out.columns == df.columns and sorted(out.toPandas()["pos"]) == sorted(want["pos"])


def test_last_n_ranks_no_group_in_one_window(spark, capsys):
    df = spark.range(100).selectExpr("1 as g", "0 as step", "id as pos")
    ordering.last_n(df, 7, "step", ["pos"], ["g"]).explain()
    plan = capsys.readouterr().out
    assert all("_slice" in line for line in plan.splitlines() if "Window " in line)


def test_split_is_exact_disjoint_and_repeatable(spark, skewed):
    _, df = skewed
    first = ordering.permutation_split(df, "k", seed=1, n_val=10).toPandas().set_index("k")["part"]
    again = ordering.permutation_split(df.repartition(9), "k", seed=1, n_val=10).toPandas().set_index("k")["part"]
    other = ordering.permutation_split(df, "k", seed=2, n_val=10).toPandas().set_index("k")["part"]
    assert (first == "val").sum() == 10 and len(first) == len(df.toPandas())
    assert (first.sort_index() == again.sort_index()).all()
    assert not (first.sort_index() == other.sort_index()).all()


def test_split_size_is_clamped(spark):
    df = spark.range(3).withColumnRenamed("id", "k")
    assert ordering.permutation_split(df, "k", n_val=99).where("part = 'val'").count() == 2
    assert ordering.permutation_split(df, "k", n_val=0).where("part = 'val'").count() == 1
    assert ordering.permutation_split(df, "k").where("part = 'val'").count() == 1


def test_batches(spark, skewed):
    _, df = skewed
    out = ordering.assign_batches(df, "k", 64, seed=5, epoch=2)
    sizes = out.groupBy("batch_id").count().toPandas()
    assert set(sizes["count"]) == {64} and len(sizes) == 5000 // 64
    kept = ordering.assign_batches(df, "k", 64, shuffle=False, drop_last=False)
    assert kept.count() == 5000
    assert kept.where("position <> k").count() == 0
    first = {r.k for r in out.where("batch_id = 0").collect()}
    assert first != {r.k for r in ordering.assign_batches(df, "k", 64, seed=5, epoch=3).where("batch_id = 0").collect()}


def test_top_k_and_samples(spark, skewed):
    frame, df = skewed
    out = ordering.top_k(df, ["g"], "v", "k", 3).toPandas()
    want = frame.sort_values(["v", "k"], ascending=[False, True]).groupby("g").head(3)
    assert sorted(out["k"]) == sorted(want["k"])
    sample = [r.k for r in ordering.sample_rows(df, "k", 50).collect()]
    assert len(set(sample)) == 50 and sample == [r.k for r in ordering.sample_rows(df.repartition(5), "k", 50).collect()]
    assert sorted(r.k for r in ordering.shuffled(df, "k").collect()) == sorted(frame["k"])
