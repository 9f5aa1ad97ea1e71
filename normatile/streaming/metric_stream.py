"""Early stopping and running means over a stream of metric rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from normatile.operators.rules import EarlyStop

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVERY_SCHEMA = "run_id string, epoch bigint, key string, step bigint, n_steps bigint, running_mean double"
STOP_SCHEMA = "run_id string, epoch bigint, metric double, best double, bad_epochs int, stopped boolean"


class StopCounter(StatefulProcessor):
    """One small state per run: best value, epochs without gain, stop flag."""

    def __init__(self, patience: int, mode: str, min_delta: float):
        self.rule = EarlyStop("metric", patience, mode, min_delta)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("stop", "best double, bad_epochs int, stopped boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.rule.start
        if self.state.exists():
            best, bad, stopped = self.state.get()
            state = (np.nan if best is None else best, float(bad), float(stopped))
        frame = pd.concat(list(rows)).sort_values("epoch")
        out = self.rule.outcome(frame, state)
        best, bad, stopped = self.rule.end(out)
        self.state.update((None if np.isnan(best) else best, int(bad), bool(stopped)))
        yield pd.DataFrame({"run_id": key[0], "epoch": frame["epoch"].to_numpy(), "metric": frame["metric"].to_numpy(), **out})

    def close(self) -> None:
        pass


def early_stop_stream(
    epochs: DataFrame, patience: int = 7, mode: str = "max", min_delta: float = 0.0
) -> DataFrame:
    """Stop state after each arriving epoch of ``(run_id, epoch, metric)``; epochs come in order."""
    epochs.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return epochs.groupBy("run_id").transformWithStateInPandas(
        statefulProcessor=StopCounter(patience, mode, min_delta),
        outputStructType=STOP_SCHEMA,
        outputMode="Append",
        timeMode="None",
    )


def running_loss_stream(log: DataFrame) -> DataFrame:
    """Running mean and step count per epoch and key; write it in update or complete mode."""
    return log.groupBy("run_id", "epoch", "key").agg(
        F.avg("value").alias("running_mean"), F.count("value").alias("n_steps")
    )


class RunningMean(StatefulProcessor):
    """Sum and count of the steps that came without a gap, and the steps that came too early."""

    def __init__(self, every: int, first: int):
        self.every, self.first = every, first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", "n bigint, total double")
        self.early = handle.getValueState("early", "steps array<bigint>, values array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, total = (int(self.sums.get()[0]), float(self.sums.get()[1])) if self.sums.exists() else (0, 0.0)
        frame = pd.concat(list(rows))
        steps, values = frame["step"].to_numpy(np.int64), frame["value"].to_numpy(np.float64)
        if self.early.exists():
            kept = self.early.get()
            steps = np.concatenate([np.asarray(kept[0], np.int64), steps])
            values = np.concatenate([np.asarray(kept[1], np.float64), values])
        steps, first_seen = np.unique(steps, return_index=True)  # a step that comes again changes nothing
        values = values[first_seen]
        late = np.searchsorted(steps, n + self.first)
        steps, values = steps[late:], values[late:]
        ready = int((steps == n + self.first + np.arange(len(steps))).sum())  # steps are distinct: equal up to the first gap
        sums = total + np.cumsum(values[:ready])
        counts = n + 1 + np.arange(ready)
        out = counts % self.every == 0
        if ready:
            self.sums.update((n + ready, float(sums[-1])))
        self.early.update((steps[ready:].tolist(), values[ready:].tolist()))
        run, epoch, name = key
        yield pd.DataFrame(
            {"run_id": run, "epoch": epoch, "key": name, "step": steps[:ready][out], "n_steps": counts[out], "running_mean": sums[out] / counts[out]}
        )

    def close(self) -> None:
        pass


def running_loss_every(log: DataFrame, every: int = 10, first: int = 0) -> DataFrame:
    """Mean of all values since the epoch began, given out once at every ``every``-th step, in append mode.

    ``log``: ``run_id, epoch, key, step, value`` with steps numbered ``first``, ``first`` + 1, ... inside each
    (run_id, epoch, key). They may arrive in any order and more than once; a step waits in the state until
    all before it are there. The state holds two numbers and the waiting steps.
    """
    log.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return log.groupBy("run_id", "epoch", "key").transformWithStateInPandas(
        statefulProcessor=RunningMean(every, first), outputStructType=EVERY_SCHEMA, outputMode="Append", timeMode="None"
    )
