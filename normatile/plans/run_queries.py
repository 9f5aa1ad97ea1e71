"""Metric logs, schedules, early stopping and losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from normatile.functions import schedules
from normatile.functions.scores import combined_metric
from normatile.operators import losses, runs
from normatile.plans import fixtures as fx
from normatile.plans.fixtures import r6, r9
from normatile.plans.registry import query
from normatile.plans.scoring_queries import scored64
from normatile.session import new_folder
from normatile.sources import reports


@query(
    "epoch_means",
    """SELECT run_id, epoch, key, round(avg(value), 9) AS mean_value, count(*) AS n_steps
    FROM metric_log GROUP BY ALL""",
    ("metric_log",),
)
def epoch_means(spark, sf):
    return runs.epoch_means(fx.metric_log(spark, sf)).withColumn("mean_value", r9(F.col("mean_value")))


@query(
    "running_loss",
    """SELECT run_id, epoch, key, step, n AS n_steps, round(total / n, 9) AS running_mean FROM (
    SELECT *, sum(value) OVER w AS total, row_number() OVER w AS n FROM metric_log
    WINDOW w AS (PARTITION BY run_id, epoch, key ORDER BY step)) WHERE n % 10 = 0""",
    ("metric_log",),
)
def running_loss(spark, sf):
    return runs.running_loss(fx.metric_log(spark, sf), 10).withColumn("running_mean", r9(F.col("running_mean")))


@query(
    "run_summary",
    """SELECT run_id, key, round(max_by(value, step), 6) AS last_value, round(max(value), 6) AS best_value,
    min(step) FILTER (value = top) AS best_step, count(*) AS n_logged FROM (
    SELECT *, max(value) OVER (PARTITION BY run_id, key) AS top FROM metric_log) GROUP BY ALL""",
    ("metric_log",),
)
def run_summary(spark, sf):
    out = runs.run_summary(fx.metric_log(spark, sf))
    return out.withColumns({c: r6(F.col(c)) for c in ("last_value", "best_value")})


@query(
    "lr_schedule",
    """SELECT step, global_step, round(CASE WHEN global_step < 5 * n THEN CAST(global_step AS DOUBLE) / greatest(1, 5 * n)
    ELSE 0.5 * (1 + cos(pi() * CAST(global_step - 5 * n AS DOUBLE) / greatest(1, 30 * n - 5 * n))) END, 6) AS lr_factor
    FROM (SELECT step, (epoch - 1) * n + step % n + 1 AS global_step, n FROM metric_log,
    (SELECT max(c) AS n FROM (SELECT count(*) AS c FROM metric_log GROUP BY epoch)))""",
    ("metric_log",),
)
def lr_schedule(spark, sf):
    """Every logged step's learning-rate factor: 5 warm-up epochs of 30, steps numbered over epochs."""
    log = fx.metric_log(spark, sf)
    per_epoch = log.groupBy("epoch").agg(F.count("*").alias("c")).agg(F.max("c").alias("n")).scalar()
    steps = log.select("step", "epoch", per_epoch.alias("n"))
    at = schedules.global_step(F.col("epoch"), F.col("n"), F.col("step") % F.col("n"))
    steps = steps.withColumn("global_step", at)
    factor = schedules.lr_factor(F.col("global_step"), F.col("n") * 5, F.col("n") * 30)
    return steps.select("step", "global_step", r6(factor).alias("lr_factor"))


@query(
    "metrics_log_roundtrip",
    """SELECT run_id, epoch, step, key, value FROM metric_log
    UNION ALL SELECT run_id, epoch, step, 'user', CAST(user_id AS DOUBLE) FROM metric_log""",
    ("metric_log",),
)
def metrics_log_roundtrip(spark, sf):
    """Maps of metrics appended to a partitioned log and read back as long rows."""
    log = fx.metric_log(spark, sf)
    pairs = F.create_map(F.lit("loss"), F.col("value"), F.lit("user"), F.col("user_id").cast("double"))
    folder = new_folder(spark, "metrics")
    reports.append_metrics(log.select("run_id", "epoch", "step", pairs.alias("metrics")), folder)
    return reports.read_metrics(spark, folder)


def combined(spark, sf):
    both = fx.epoch_metrics(spark, sf)
    # Some epochs have no patch metric, a few have neither.
    patch = F.when(F.col("epoch") % 4 != 0, F.col("patch_metric"))
    image = F.when(F.col("epoch") % 8 != 0, F.col("image_metric"))
    return both.select("run_id", "epoch", image.alias("image_metric"), patch.alias("patch_metric"))


_COMBINED = """combined AS (SELECT run_id, epoch, CASE WHEN epoch % 8 <> 0 THEN image_metric END AS image_metric,
CASE WHEN epoch % 4 <> 0 THEN patch_metric END AS patch_metric FROM epoch_metrics)"""
_METRIC = "coalesce((image_metric + patch_metric) / 2, image_metric)"


@query(
    "combined_metric",
    f"WITH {_COMBINED} SELECT run_id, epoch, round({_METRIC}, 6) AS metric FROM combined",
    ("epoch_metrics",),
)
def combined_metric_query(spark, sf):
    both = combined(spark, sf)
    return both.select("run_id", "epoch", r6(combined_metric(F.col("image_metric"), F.col("patch_metric"))).alias("metric"))


STOP_SQL = f"""WITH RECURSIVE {_COMBINED},
series AS (SELECT run_id, epoch, {_METRIC} AS metric, row_number() OVER (PARTITION BY run_id ORDER BY epoch) AS rn
  FROM combined),
fold AS (SELECT run_id, epoch, rn, metric, metric AS best, 0 AS bad, false AS stopped FROM series WHERE rn = 1
  UNION ALL SELECT s.run_id, s.epoch, s.rn, s.metric,
  CASE WHEN f.stopped OR s.metric IS NULL THEN f.best WHEN f.best IS NULL OR s.metric > f.best + 0.001 THEN s.metric
  ELSE f.best END,
  CASE WHEN f.stopped OR s.metric IS NULL THEN f.bad WHEN f.best IS NULL OR s.metric > f.best + 0.001 THEN 0
  ELSE f.bad + 1 END,
  f.stopped OR (s.metric IS NOT NULL AND f.best IS NOT NULL AND NOT (s.metric > f.best + 0.001) AND f.bad + 1 >= 7)
  FROM fold f JOIN series s ON s.run_id = f.run_id AND s.rn = f.rn + 1)"""


@query(
    "early_stopping",
    STOP_SQL + """ SELECT run_id, epoch, round(metric, 6) AS metric, round(best, 6) AS best, bad AS bad_epochs, stopped FROM fold""",
    ("epoch_metrics",),
)
def early_stopping(spark, sf):
    metric = combined_metric(F.col("image_metric"), F.col("patch_metric"))
    epochs = combined(spark, sf).withColumn("metric", metric)
    out = runs.early_stopping(epochs, "metric", patience=7, min_delta=0.001)
    return out.withColumns({c: r6(F.col(c)) for c in ("metric", "best")})


GATE_SQL = """WITH RECURSIVE series AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY epoch) AS rn
  FROM epoch_metrics),
fold AS (SELECT run_id, epoch, rn, image_metric AS best_image, patch_metric AS best_patch, true AS saved
  FROM series WHERE rn = 1
  UNION ALL SELECT run_id, epoch, rn, CASE WHEN save THEN image_metric ELSE best_image END,
  CASE WHEN save THEN patch_metric ELSE best_patch END, save FROM (
  SELECT s.run_id, s.epoch, s.rn, s.image_metric, s.patch_metric, f.best_image, f.best_patch,
  (s.image_metric > f.best_image AND f.best_patch - s.patch_metric <= 0.02)
  OR (s.patch_metric > f.best_patch AND f.best_image - s.image_metric <= 0.02) AS save
  FROM fold f JOIN series s ON s.run_id = f.run_id AND s.rn = f.rn + 1))
SELECT run_id, epoch, round(best_image, 6) AS best_image, round(best_patch, 6) AS best_patch, saved FROM fold"""


@query("checkpoint_gate", GATE_SQL, ("epoch_metrics",))
def checkpoint_gate(spark, sf):
    out = runs.checkpoint_gate(fx.epoch_metrics(spark, sf))
    return out.select("run_id", "epoch", r6(F.col("best_image")).alias("best_image"), r6(F.col("best_patch")).alias("best_patch"), "saved")


# --- losses -------------------------------------------------------------------------------------


def loss_rows(spark, sf):
    return fx.table(spark, sf, "lineitem").select(
        "l_linestatus",
        (F.col("l_extendedprice") / 10000.0).alias("score"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        "l_orderkey",
        "l_linenumber",
    )


_ROWS = """(SELECT l_linestatus, l_extendedprice / 10000 AS s, CAST(l_returnflag = 'R' AS DOUBLE) AS t FROM lineitem)"""
_P = f"""(SELECT *, 1 / (1 + exp(-(s / (1 + s / 10)) / 2)) AS p FROM {_ROWS})"""


@query(
    "clustering_loss",
    f"""SELECT l_linestatus, round(avg(c) + 0.1 * var_samp(c), 6) AS patch, round(avg(c) + 0.1 * var_samp(c), 6) AS total
    FROM (SELECT l_linestatus, s / (1 + s / 100) AS c FROM {_ROWS}) GROUP BY l_linestatus""",
)
def clustering_loss(spark, sf):
    out = losses.total_loss(loss_rows(spark, sf), "score", "y", ["l_linestatus"], "clustering")
    return out.select("l_linestatus", r6(F.col("patch")).alias("patch"), r6(F.col("total")).alias("total"))


@query(
    "bce_loss",
    f"""SELECT l_linestatus, round(avg(-(t * ln(p) + (1 - t) * ln(1 - p))), 6) AS patch,
    round(0.5 * avg(-(t * ln(p) + (1 - t) * ln(1 - p))), 6) AS total FROM {_P} GROUP BY l_linestatus""",
)
def bce_loss(spark, sf):
    out = losses.total_loss(loss_rows(spark, sf), "score", "y", ["l_linestatus"], "bce", patch_weight=0.5)
    return out.select("l_linestatus", r6(F.col("patch")).alias("patch"), r6(F.col("total")).alias("total"))


@query(
    "focal_loss",
    f"""SELECT l_linestatus, round(avg((0.25 * t + 0.75 * (1 - t)) * power(1 - (p * t + (1 - p) * (1 - t)), 2)
    * -(t * ln(p) + (1 - t) * ln(1 - p))), 6) AS patch FROM {_P} GROUP BY l_linestatus""",
)
def focal_loss(spark, sf):
    out = losses.total_loss(loss_rows(spark, sf), "score", "y", ["l_linestatus"], "focal")
    return out.select("l_linestatus", r6(F.col("patch")).alias("patch"))


@query(
    "pseudo_loss",
    f"""SELECT l_linestatus, round(pseudo, 6) AS pseudo, round(patch + pseudo, 6) AS total FROM (
    SELECT l_linestatus, avg(c) + 0.1 * var_samp(c) AS patch, avg(greatest((s + 0.01 * g) - s, 0)) AS pseudo FROM (
    SELECT l_linestatus, s, s / (1 + s / 100) AS c, {fx.md5_normal("42", "l_orderkey", "l_linenumber")} AS g
    FROM (SELECT *, l_extendedprice / 10000 AS s FROM lineitem)) GROUP BY l_linestatus)""",
)
def pseudo_loss(spark, sf):
    out = losses.total_loss(
        loss_rows(spark, sf), "score", "y", ["l_linestatus"], "clustering", use_pseudo=True,
        pseudo_keys=("l_orderkey", "l_linenumber"),
    )
    return out.select("l_linestatus", r6(F.col("pseudo")).alias("pseudo"), r6(F.col("total")).alias("total"))


@query(
    "custom_loss",
    "SELECT category, round(avg(abs(score - y)), 6) AS patch FROM scores GROUP BY category",
    ("scores",),
)
def custom_loss(spark, sf):
    """A loss registered by the caller."""
    losses.register_loss("absolute", lambda score, y: F.avg(F.abs(score - y)))
    out = losses.total_loss(scored64(spark, sf), "score", "y", ["category"], "absolute")
    return out.select("category", r6(F.col("patch")).alias("patch"))
