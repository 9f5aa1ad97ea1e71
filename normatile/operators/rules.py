"""Ordered rules as scans: a row's outcome depends on earlier outcomes, yet no task walks a whole run.

A rule is a function from the state before a slice of rows to the state after it. Each slice first
sums up that function for every state that may come in (a few arrays); per run these are applied
in order, slice by slice; then each slice, knowing its state, gives its rows their outcomes. Inside a
slice work is on whole arrays: jumps from one improvement to the next, never row by row.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from normatile.operators.ordering import join_null_safe
from normatile.session import materialize

State = tuple[float, ...]


class EarlyStop:
    """Best value, epochs without gain, stop flag.

    The first defined value sets the best; a value gains if it beats the best by more than ``min_delta``;
    ``patience`` epochs without gain stop the run, and nothing changes after. Undefined epochs change
    nothing. State: best (NaN: none yet), epochs without gain, stopped.

    Only running maxima of a slice can be its next best, so they, with the state that each leads
    to, are the slice's function.
    """

    emitted = "best double, bad_epochs int, stopped boolean"
    start: State = (np.nan, 0.0, 0.0)

    def __init__(self, metric: str, patience: int, mode: str, min_delta: float):
        if mode not in ("max", "min"):
            raise ValueError(f"mode must be 'max' or 'min', got {mode!r}")
        self.inputs = [metric]
        self.sign = 1.0 if mode == "max" else -1.0
        self.patience, self.delta = max(1, patience), min_delta

    def _peaks(self, frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Which rows are defined, their values (higher is better), the running maxima's places and next gains."""
        values = self.sign * frame[self.inputs[0]].to_numpy(np.float64, na_value=np.nan)
        known = ~np.isnan(values)
        v = values[known]
        before = np.concatenate([[-np.inf], np.maximum.accumulate(v)[:-1]]) if len(v) else v
        places = np.flatnonzero((v > before) | (np.arange(len(v)) == 0))
        gain = np.searchsorted(v[places], v[places] + self.delta, side="right")
        return known, v, places, gain

    def _ends(self, v: np.ndarray, places: np.ndarray, gain: np.ndarray) -> np.ndarray:
        """For each running maximum the last one of its chain of gains, stops included."""
        jump = np.arange(len(places))
        has = gain < len(places)
        reach = np.zeros(len(places), bool)
        reach[has] = places[gain[has]] - places[has] <= self.patience
        jump[reach] = gain[reach]
        while True:
            further = jump[jump]
            if (further == jump).all():
                return jump
            jump = further

    def summary(self, frame: pd.DataFrame) -> list[np.ndarray]:
        """Number of defined rows; running maxima: values, places, best and place at the end of each one's chain."""
        _, v, places, gain = self._peaks(frame)
        end = self._ends(v, places, gain)
        peaks = v[places]
        return [np.array([float(len(v))]), peaks, places.astype(float), peaks[end], places[end].astype(float)]

    def _entry(self, peaks: np.ndarray, places: np.ndarray, count: int, state: State) -> tuple[int, float]:
        """The first running maximum that gains on the state (or -1), and the place of a stop before it (or inf)."""
        if np.isnan(state[0]):
            return (0, np.inf) if count else (-1, np.inf)
        k = int(np.searchsorted(peaks, self.sign * state[0] + self.delta, side="right"))
        first = places[k] if k < len(peaks) else count
        stop = self.patience - state[1] - 1
        if stop < first:
            return -1, stop
        return (k, np.inf) if k < len(peaks) else (-1, np.inf)

    def after(self, summary: list[np.ndarray], state: State) -> State:
        count, peaks, places, best, last = int(summary[0][0]), *summary[1:]
        if state[2] or not count:
            return state
        k, stop = self._entry(peaks, places, count, state)
        if k < 0:
            return (state[0], float(self.patience), 1.0) if stop < count else (state[0], state[1] + count, 0.0)
        bad = count - 1 - last[k]
        return (self.sign * best[k], min(bad, float(self.patience)), float(bad >= self.patience))

    def outcome(self, frame: pd.DataFrame, state: State) -> dict[str, np.ndarray]:
        known, v, places, gain = self._peaks(frame)
        count = len(v)
        at = np.arange(count)
        best, bad, stopped = np.full(count, state[0]), state[1] + at + 1, np.zeros(count, bool)
        if state[2]:
            bad, stopped = np.full(count, state[1]), ~stopped
        elif count:
            k, stop = self._entry(v[places], places, count, state)
            if k >= 0:
                chain = self._chain(places, gain, k)
                turn = np.searchsorted(chain, at, side="right") - 1
                inside = turn >= 0
                best[inside] = self.sign * v[chain[turn[inside]]]
                bad[inside] = at[inside] - chain[turn[inside]]
            first = np.flatnonzero(bad >= self.patience)
            if len(first):
                stopped[first[0] :] = True
                best[first[0] :], bad[first[0] :] = best[first[0]], bad[first[0]]
        row = np.cumsum(known) - 1  # the last defined row up to here
        some = row >= 0
        out = {"best": np.full(len(known), state[0]), "bad_epochs": np.full(len(known), int(state[1]), np.int32), "stopped": np.full(len(known), bool(state[2]))}
        for name, values in (("best", best), ("bad_epochs", bad), ("stopped", stopped)):
            out[name][some] = values[row[some]]
        return out

    def _chain(self, places: np.ndarray, gain: np.ndarray, k: int) -> np.ndarray:
        """Places of the gains from running maximum ``k`` on, by doubling."""
        jump = np.append(np.minimum(gain, len(places)), len(places))
        seen = np.zeros(len(places) + 1, bool)
        seen[k] = True
        while True:
            before = int(seen.sum())
            seen[jump[seen]] = True
            jump = jump[jump]
            if int(seen.sum()) == before:
                return places[np.flatnonzero(seen[:-1])]

    def end(self, out: dict[str, np.ndarray]) -> State:
        return (float(out["best"][-1]), float(out["bad_epochs"][-1]), float(out["stopped"][-1]))


class CheckpointGate:
    """Which epochs save, and the pair of best metrics after each.

    An epoch saves if one metric improves and the other improves, stays, or falls by no more than
    ``tolerance``; saving replaces both bests. Epochs without both metrics, and stopped ones, never save.
    State: both bests (NaN: none yet).

    A row that an earlier row of the slice matches or beats in both metrics is never the first to save,
    whatever comes in: the others, with the pair that each leads to, are the slice's function.
    """

    emitted = "best_image double, best_patch double, saved boolean"
    start: State = (np.nan, np.nan)

    def __init__(self, image: str, patch: str, tolerance: float, stopped: str | None = None):
        self.inputs = [image, patch] + ([stopped] if stopped else [])
        self.tolerance, self.stopped = tolerance, stopped

    def _pairs(self, frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        table = frame[self.inputs[:2]].to_numpy(np.float64, na_value=np.nan)
        known = ~np.isnan(table).any(axis=1)
        if self.stopped:
            known &= ~frame[self.stopped].fillna(False).to_numpy(bool)
        return known, table[known]

    def _saves(self, pairs: np.ndarray, state) -> np.ndarray:
        if np.isnan(state[0]):
            return np.ones(len(pairs), bool)
        image, patch = pairs[:, 0] - state[0], pairs[:, 1] - state[1]
        return ((image > 0) & (-patch <= self.tolerance)) | ((patch > 0) & (-image <= self.tolerance))

    def _next(self, pairs: np.ndarray, at: int, state) -> int:
        """The first row from ``at`` on that saves, or the number of rows; looks at ever longer stretches."""
        size = 64
        while at < len(pairs):
            hits = self._saves(pairs[at : at + size], state)
            if hits.any():
                return at + int(hits.argmax())
            at, size = at + size, size * 2
        return len(pairs)

    def _chain(self, pairs: np.ndarray, at: int, known: dict[int, int] | None = None) -> list[int]:
        """Rows that save from row ``at`` on; stops at a row of ``known``."""
        chain = []
        while at < len(pairs):
            chain.append(at)
            if known is not None and at in known:
                break
            at = self._next(pairs, at + 1, pairs[at])
        return chain

    def _entries(self, pairs: np.ndarray) -> list[int]:
        """Rows that no earlier row matches or beats in both metrics."""
        first: list[int] = []
        stairs = np.empty((0, 2))  # the best pairs so far: ascending in the first metric, so descending in the second
        for at in range(0, len(pairs), 512):
            block = pairs[at : at + 512]
            step = np.searchsorted(stairs[:, 0], block[:, 0])
            fresh = np.append(stairs[:, 1], -np.inf)[step] < block[:, 1]
            earlier = (block[None] >= block[:, None]).all(axis=2) & np.tri(len(block), k=-1, dtype=bool)
            fresh &= ~earlier.any(axis=1)
            first += (at + np.flatnonzero(fresh)).tolist()
            both = np.vstack([stairs, block[fresh]])
            both = both[np.lexsort((both[:, 1], both[:, 0]))[::-1]]
            top = np.maximum.accumulate(np.concatenate([[-np.inf], both[:, 1]]))[:-1]
            stairs = both[both[:, 1] > top][::-1]
        return first

    def summary(self, frame: pd.DataFrame) -> list[np.ndarray]:
        _, pairs = self._pairs(frame)
        first = self._entries(pairs)
        ends: dict[int, int] = {}
        for k in first:
            chain = self._chain(pairs, k, ends)
            last = ends.get(chain[-1], chain[-1])
            ends.update((c, last) for c in chain)
        last = [ends[k] for k in first]
        return [pairs[first, 0], pairs[first, 1], pairs[last, 0], pairs[last, 1]] if first else [np.empty(0)] * 4

    def after(self, summary: list[np.ndarray], state: State) -> State:
        hits = self._saves(np.stack(summary[:2], axis=1), state)
        if not hits.any():
            return state
        k = int(hits.argmax())
        return float(summary[2][k]), float(summary[3][k])

    def outcome(self, frame: pd.DataFrame, state: State) -> dict[str, np.ndarray]:
        known, pairs = self._pairs(frame)
        saves = np.zeros(len(pairs), bool)
        saves[self._chain(pairs, self._next(pairs, 0, state))] = True
        saved = np.zeros(len(known), bool)
        saved[known] = saves
        turn = np.cumsum(saved) - 1
        bests = np.vstack([pairs[saves], np.array([state])])  # the last row: what came in
        image, patch = bests[np.where(turn >= 0, turn, -1)].T
        return {"best_image": image, "best_patch": patch, "saved": saved}


def scan_rule(df: DataFrame, keys: Sequence[str], order: str, rule) -> DataFrame:
    """``keys, order, the rule's inputs and outcome`` for every row; rows of a run come in ``order``.

    Rows are dealt by ranges of (keys, order), so a long run lies in many slices and a task has many
    short runs. A NULL key is a run. Per run one task reads the slices' functions, no rows.
    """
    keys = list(keys)
    columns = list(dict.fromkeys([*keys, order, *rule.inputs]))
    sliced = df.select(*columns).repartitionByRange(*keys, order).withColumn("_slice", F.spark_partition_id())
    sliced = materialize(sliced, "rule-slices")
    field = {f.name: f for f in sliced.schema.fields}
    by = [field[k] for k in keys]

    def functions(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = rule.summary(rows.sort_values(order))
        return pd.DataFrame([[*key, [np.asarray(a, np.float64).tolist() for a in found]]], columns=["_slice", *keys, "_function"])

    listed = T.StructType([field["_slice"], *by, T.StructField("_function", T.ArrayType(T.ArrayType(T.DoubleType())))])
    each = sliced.groupBy("_slice", *keys).applyInPandas(functions, listed)

    def entered(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        state, out = rule.start, []
        for number, function in rows.sort_values("_slice")[["_slice", "_function"]].itertuples(index=False):
            out.append([number, *key, list(state)])
            state = rule.after([np.asarray(a, np.float64) for a in function], state)
        return pd.DataFrame(out, columns=["_slice", *keys, "_state"])

    states = T.StructType([field["_slice"], *by, T.StructField("_state", T.ArrayType(T.DoubleType()))])
    states = materialize(each.groupBy(*keys).applyInPandas(entered, states), "rule-states")
    schema = T.StructType([field[c] for c in columns] + T.StructType.fromDDL(rule.emitted).fields)

    def outcomes(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        state = tuple(rows["_state"].iloc[0])
        return rows[columns].assign(**rule.outcome(rows, state))

    joined = join_null_safe(sliced, states, ["_slice", *keys])
    return joined.groupBy("_slice", *keys).applyInPandas(outcomes, schema)
