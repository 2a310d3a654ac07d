"""Structured Streaming forms of the counts, stays, models and Bayes-factor monitors.

Inputs are streams of positions (agent, ts timestamp, zone) or of step log factors; watermarks
bound the state. Each batch operator has the same meaning on the rows that arrive in time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def occupancy_stream(positions: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, zone, n): distinct agents in each zone and tumbling window, counted exactly: first by agent, then agents."""
    seen = positions.withWatermark("ts", late).groupBy(F.window("ts", length), "zone", "agent").agg(F.count(F.lit(1)).alias("_n"))
    own = seen.groupBy(F.window(F.window_time("window"), length), "zone").agg(F.count(F.lit(1)).alias("n"))
    return own.select(F.col("window.start").alias("start"), "zone", "n")


def event_count_stream(positions: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(start, zone, n): positions in each zone and tumbling or sliding window."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    own = positions.withWatermark("ts", late).groupBy(window, "zone").agg(F.count(F.lit(1)).alias("n"))
    return own.select(F.col("window.start").alias("start"), "zone", "n")


def stay_stream(positions: DataFrame, gap: str = "2 hours", late: str = "10 minutes") -> DataFrame:
    """(agent, zone, start, stop, n): sessions of positions in a zone without a gap."""
    own = positions.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "agent", "zone").agg(F.count(F.lit(1)).alias("n"))
    return own.select("agent", "zone", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n")


class Transitions(StatefulProcessor):
    """Each agent's last zone, and the positions that the watermark has not passed: these wait, so that rows of later
    batches still take their place in time order. What it has passed gives (agent, ts, origin, dest).
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "zone long")
        self.waiting = handle.getListState("waiting", "ts long, number long, zone long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows))
        new = list(zip(frame["micros"].tolist(), frame["number"].tolist(), frame["zone"].tolist(), strict=True))
        yield from self._passed(key, timerValues, new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._passed(key, timerValues, [])

    def _passed(self, key, timerValues, new: list[tuple]) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        rows = sorted([*(tuple(r) for r in self.waiting.get()), *new]) if self.waiting.exists() else sorted(new)
        done = [r for r in rows if r[0] <= 1000 * mark]
        left = rows[len(done) :]
        before, out = self.last.get()[0] if self.last.exists() else None, []
        for micros, _, zone in done:
            if before is not None:
                out.append((key[0], pd.Timestamp(micros, unit="us"), before, zone))
            before = zone
        if done:
            self.last.update((before,))
        if left:
            self.waiting.put(left)
            self.handle.registerTimer(left[0][0] // 1000 + 1)
        elif self.waiting.exists():
            self.waiting.clear()
        yield pd.DataFrame(out, columns=["agent", "ts", "origin", "dest"])

    def close(self) -> None:
        pass


def transition_stream(positions: DataFrame, late: str = "10 minutes", number: str | None = None) -> DataFrame:
    """(agent, ts, origin, dest): moves of each agent across batches, in the order of time (and number, for equal times).

    A position counts once the watermark has passed it; one that comes later than that is dropped, as by any window.
    """
    own = positions.withWatermark("ts", late)
    rows = own.select("agent", "ts", F.unix_micros("ts").alias("micros"), (F.col(number) if number else F.lit(0)).cast("long").alias("number"), "zone").groupBy("agent")
    return rows.transformWithStateInPandas(Transitions(), "agent long, ts timestamp, origin long, dest long", "Append", "EventTime")


def bayes_step(log_l: float, run: int, h: float | None) -> tuple[float, int]:
    """The factor's recursion; a missing step counts as 0."""
    h = 0.0 if h is None or math.isnan(h) else h
    return h + min(0.0, log_l), run + 1 if log_l < 0 else 1


class BayesMonitor(StatefulProcessor):
    """Running cumulative log Bayes factor of each key; gives a row for each step and flags log_l under the threshold."""

    def __init__(self, threshold: float):
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("factor", "log_l double, run long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("slot", kind="stable")
        log_l, run = self.state.get() if self.state.exists() else (0.0, 0)
        out = []
        for slot, h in zip(frame["slot"], frame["h"], strict=True):
            log_l, run = bayes_step(log_l, run, h)
            out.append((key[0], int(slot), log_l, run, log_l <= self.threshold))
        self.state.update((float(log_l), int(run)))
        yield pd.DataFrame(out, columns=["agent", "slot", "log_l", "run_len", "flagged"])

    def close(self) -> None:
        pass


def bayes_stream(steps: DataFrame, threshold: float) -> DataFrame:
    """(agent, slot, log_l, run_len, flagged) of a stream of (agent, slot, h)."""
    schema = "agent long, slot long, log_l double, run_len long, flagged boolean"
    return steps.select("agent", "slot", "h").groupBy("agent").transformWithStateInPandas(BayesMonitor(threshold), schema, "Append", "None")


class ModelMonitor(StatefulProcessor):
    """A static sequential logistic model of each key: forecasts a row, then learns from it; the state is kept between batches."""

    def __init__(self, features: list[str], variance: float = 50.0):
        self.features, self.variance = features, variance

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("model", "a array<double>, r array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        import numpy as np

        from wayfold.operators.dglm import Design, State, filtered

        design = Design(len(self.features))
        state = State.prior(design.size, self.variance)
        if self.state.exists():
            a, r = self.state.get()
            state = State(np.array(a), np.array(r).reshape(design.size, design.size))
        frame = pd.concat(list(rows)).sort_values("slot", kind="stable")
        y = frame["y"].to_numpy(float)
        p, _, _ = filtered(y, np.ones(len(y)), frame[self.features].to_numpy(float).reshape(len(y), -1), design, state)
        self.state.update((state.a.tolist(), state.r.ravel().tolist()))
        yield pd.DataFrame({"agent": key[0], "slot": frame["slot"].to_numpy(), "p_hat": p, "y": y})

    def close(self) -> None:
        pass


def model_stream(rows: DataFrame, features: list[str], variance: float = 50.0) -> DataFrame:
    """(agent, slot, p_hat, y) of a stream of (agent, slot, y, features)."""
    own = rows.select("agent", "slot", "y", *features).groupBy("agent")
    return own.transformWithStateInPandas(ModelMonitor(features, variance), "agent long, slot long, p_hat double, y double", "Append", "None")
