"""Folds, running means and losses against plain Python."""

import math
import os

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from normatile.functions import schedules
from normatile.operators import losses, rules, runs
from normatile.session import new_folder
from normatile.sources import reports


def stop_rule(values, patience, mode, delta):
    best, bad, stopped, out = None, 0, False, []
    for v in values:
        if not stopped and v is not None:
            if best is None:
                best = v
            elif (v > best + delta) if mode == "max" else (v < best - delta):
                best, bad = v, 0
            else:
                bad += 1
                stopped = bad >= patience
        out.append((best, bad, stopped))
    return out


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(0, 8)), min_size=1, max_size=25), st.sampled_from(["max", "min"]))
def test_early_stopping(spark, values, mode):
    rows = [(run, e, None if v is None else v / 4) for run in "ab" for e, v in enumerate(values if run == "a" else values[::-1])]
    df = spark.createDataFrame(rows, "run_id string, epoch long, m double").repartition(5)
    out = runs.early_stopping(df, "m", patience=3, mode=mode, min_delta=0.25).toPandas()
    for run in "ab":
        got = out[out.run_id == run].sort_values("epoch")
        want = stop_rule([v for r, _, v in rows if r == run], 3, mode, 0.25)
        for (best, bad, stopped), row in zip(want, got.itertuples()):
            assert (row.bad_epochs, row.stopped) == (bad, stopped)
            assert (best is None and pd.isna(row.best)) or best == row.best


def test_mode_is_checked():
    with pytest.raises(ValueError):
        rules.EarlyStop("m", 3, "up", 0.0)


def gate_rule(rows, tolerance):
    best, out = None, []
    for a, b in rows:
        save = False
        if a is not None and b is not None:
            if best is None:
                save = True
            else:
                da, db = a - best[0], b - best[1]
                save = (da > 0 and -db <= tolerance) or (db > 0 and -da <= tolerance)
        best = (a, b) if save else best
        out.append((best, save))
    return out


def sliced(rule, frame, cuts):
    """Outcomes of a run cut into slices, each knowing only the functions of those before it."""
    state, out = rule.start, []
    for a, b in zip([0, *cuts], [*cuts, len(frame)]):
        part = frame.iloc[a:b]
        if len(part):
            out.append(pd.DataFrame(rule.outcome(part, state)))
            state = rule.after([np.asarray(x, float) for x in rule.summary(part)], state)
    return pd.concat(out, ignore_index=True)


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_rules_by_slices_equal_rules_by_rows(data):
    values = data.draw(st.lists(st.one_of(st.none(), st.integers(0, 9)), min_size=1, max_size=60))
    other = data.draw(st.lists(st.one_of(st.none(), st.integers(0, 9)), min_size=len(values), max_size=len(values)))
    cuts = sorted(data.draw(st.lists(st.integers(0, len(values)), max_size=5)))
    mode, patience, delta = data.draw(st.tuples(st.sampled_from(["max", "min"]), st.integers(1, 6), st.sampled_from([0.0, 0.25, 0.6])))
    scale = lambda v: None if v is None else v / 4
    frame = pd.DataFrame({"m": list(map(scale, values)), "p": list(map(scale, other))}, dtype=object)
    got = sliced(rules.EarlyStop("m", patience, mode, delta), frame, cuts)
    for (best, bad, stopped), row in zip(stop_rule(frame["m"], patience, mode, delta), got.itertuples()):
        assert (row.bad_epochs, row.stopped) == (bad, stopped)
        assert (best is None and np.isnan(row.best)) or best == row.best
    got = sliced(rules.CheckpointGate("m", "p", delta), frame, cuts)
    for (best, save), row in zip(gate_rule(zip(frame["m"], frame["p"]), delta), got.itertuples()):
        assert row.saved == save and (best is None and np.isnan(row.best_image) or best == (row.best_image, row.best_patch))


def test_one_long_run_lies_in_many_slices(spark):
    n = 60_000
    df = spark.range(n, numPartitions=6).selectExpr("'r' as run_id", "id as epoch", "round(1 - exp(-id / 15000.0) + (hash(id) % 1000) / 1e4, 6) as m")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        out = runs.early_stopping(df, "m", patience=5000, min_delta=0.001)
        frame = out.toPandas().sort_values("epoch")
        gate = runs.checkpoint_gate(df.withColumn("p", -F.col("m")), "m", "p", tolerance=0.05).toPandas().sort_values("epoch")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = stop_rule(frame["m"].tolist(), 5000, "max", 0.001)
    assert frame["best"].tolist() == [w[0] for w in want] and frame["bad_epochs"].tolist() == [w[1] for w in want]
    want = gate_rule(zip(gate["m"].tolist(), gate["p"].tolist()), 0.05)
    assert gate["saved"].tolist() == [w[1] for w in want]


def test_checkpoint_gate(spark):
    rows = [(0.5, 0.5), (0.6, 0.49), (0.55, 0.6), (0.6, 0.58), (0.7, None), (0.61, 0.57), (0.61, 0.57), (0.9, 0.9)]
    df = spark.createDataFrame([("r", e, a, b, e >= 7) for e, (a, b) in enumerate(rows)], "run_id string, epoch long, image_metric double, patch_metric double, stopped boolean")
    out = runs.checkpoint_gate(df, tolerance=0.02).toPandas().sort_values("epoch")
    best, want = None, []
    for e, (a, b) in enumerate(rows):
        save = False
        if b is not None and e < 7:
            if best is None:
                save = True
            else:
                da, db = a - best[0], b - best[1]
                save = (da > 0 and db >= -0.02) or (db > 0 and da >= -0.02)
        best = (a, b) if save else best
        want.append((best, save))
    assert [((r.best_image, r.best_patch), r.saved) for r in out.itertuples()] == want


def test_fold_keeps_state_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame([("r", e, float(e % 5)) for e in range(100)], "run_id string, epoch long, m double").repartition(9)
        out = runs.early_stopping(df, "m", patience=1000).toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert out.sort_values("epoch")["bad_epochs"].iloc[-1] == 95


def test_running_means_and_summary(spark, rng):
    rows = [("r", e, e * 40 + s, "loss", float(rng.random())) for e in range(3) for s in range(35)]
    df = spark.createDataFrame(rows, "run_id string, epoch long, step long, key string, value double")
    out = runs.running_loss(df, 10).toPandas().sort_values("step")
    want = [(e, e * 40 + k - 1, np.mean([r[4] for r in rows if r[1] == e][:k])) for e in range(3) for k in (10, 20, 30)]
    assert [(r.epoch, r.step) for r in out.itertuples()] == [w[:2] for w in want]
    assert np.allclose(out["running_mean"], [w[2] for w in want])
    low = runs.run_summary(df, {"loss": "min"}).first()
    values = [r[4] for r in rows]
    assert low.best_value == min(values) and low.best_step == rows[int(np.argmin(values))][2] and low.last_value == values[-1]
    assert runs.run_summary(df).first().best_value == max(values)
    assert np.allclose(sorted(r.mean_value for r in runs.epoch_means(df).collect()), sorted(np.mean(values[i * 35 : i * 35 + 35]) for i in range(3)))


def test_log_append(spark):
    path = new_folder(spark, "log")
    for step in (1, 2):
        df = spark.createDataFrame([("r", 1, step, {"a": 1.0 * step, "b": 2.0})], "run_id string, epoch int, step int, metrics map<string,double>")
        reports.append_metrics(df, path)
    assert sorted(map(tuple, reports.read_metrics(spark, path).select("step", "key", "value").collect())) == [
        (1, "a", 1.0), (1, "b", 2.0), (2, "a", 2.0), (2, "b", 2.0)
    ]


def test_a_repeated_append_gives_each_row_once(spark):
    path = new_folder(spark, "log")
    rows = lambda steps: spark.createDataFrame([("r", 1, s, {"a": float(s)}) for s in steps], "run_id string, epoch int, step int, metrics map<string,double>")
    assert reports.read_metrics(spark, path).count() == 0
    reports.append_metrics(rows([1, 2]), path, batch="one")
    reports.append_metrics(rows([3]), path, batch="two")
    os.remove(f"{path}/batch=two/_SUCCESS")  # it failed before its commit
    assert sorted(r.step for r in reports.read_metrics(spark, path).collect()) == [1, 2]
    for _ in range(2):
        reports.append_metrics(rows([3, 4]), path, batch="two")
    reports.append_metrics(rows([5]), path)
    log = reports.read_metrics(spark, path)
    assert sorted(r.step for r in log.collect()) == [1, 2, 3, 4, 5] and log.columns == ["run_id", "epoch", "step", "key", "value"]
    with pytest.raises(ValueError):
        reports.append_metrics(rows([6]), path, batch="a/b")


def test_schedules(spark):
    got = spark.range(40).select("id", schedules.lr_factor(F.col("id"), 10, 40).alias("f")).toPandas().sort_values("id")["f"]
    want = [s / 10 if s < 10 else 0.5 * (1 + math.cos(math.pi * (s - 10) / 30)) for s in range(40)]
    assert np.allclose(got, want)
    assert spark.range(1).select(schedules.lr_factor(F.col("id"), 0, 0)).first()[0] == 1.0
    assert spark.range(1).select(schedules.global_step(F.lit(3), 100, F.lit(4))).first()[0] == 205


def bce(p, y):
    return -(y * max(math.log(p), -100) + (1 - y) * max(math.log(1 - p) if p < 1 else -100, -100))


def test_losses(spark, rng):
    s, y = rng.gamma(1.0, 20.0, 300), rng.integers(0, 2, 300)
    df = spark.createDataFrame(pd.DataFrame({"s": s, "y": y, "k": range(300)}))
    p = 1 / (1 + np.exp(-(s / (1 + s / 10)) / 2))
    each = np.array([bce(a, b) for a, b in zip(p, y)])
    pt = np.where(y == 1, p, 1 - p)
    at = np.where(y == 1, 0.25, 0.75)
    c = s / (1 + s / 100)
    total = lambda **kw: losses.total_loss(df, "s", "y", **kw).first()
    assert np.isclose(total(loss="bce", patch_weight=2.0).total, 2 * each.mean())
    assert np.isclose(total(loss="focal", gamma=4.0).patch, (at * (1 - pt) ** 4 * each).mean())
    assert np.isclose(total(loss="clustering").patch, c.mean() + 0.1 * c.var(ddof=1))
    row = total(loss="clustering", use_pseudo=True, pseudo_keys=("k",))
    assert np.isclose(row.total, row.patch + row.pseudo)
    assert "pseudo" not in losses.total_loss(df, "s", "y", loss="bce", use_pseudo=True).columns
    big = spark.range(50000).withColumns({"s": F.lit(1.0), "y": F.lit(0)})
    pseudo = losses.total_loss(big, "s", "y", loss="clustering", use_pseudo=True, pseudo_keys=("id",)).first().pseudo
    assert pseudo == pytest.approx(0.01 / math.sqrt(2 * math.pi), rel=0.03)


def test_cross_entropy_is_floored(spark):
    df = spark.createDataFrame([(0.0, 1), (1.0, 0), (1.0, 1)], "p double, y int")
    assert [r[0] for r in df.select(losses.cross_entropy(F.col("p"), F.col("y"))).collect()] == [100.0, 100.0, 0.0]
