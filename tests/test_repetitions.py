"""Calibration where an agent's panel is: the same draws, candidates and factors as by tables of all runs."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wayfold.operators import dglm, inject, repetitions
from wayfold.plans import detection

SETUP = detection.Setup(per_day=8, slots=96, test_days=3, min_stay=2, min_taken=1)
HOW = {"threshold": 0.15, "tries": 40, "min_stay": 2, "max_shift": 3}


def some_panel(spark, drop=lambda a, s: False):
    """Five agents; some begin later, and swaps of days leave gaps in their runs."""
    rng, rows = random.Random(5), []
    for agent, begin in enumerate((0, 0, 0, 5, 21)):
        zone = 1
        for slot in range(96):
            if rng.random() < 0.3:
                zone = rng.choice([1, 2, 3]) if agent % 2 else [1, 3, 2, 1][(slot // 3) % 4]
            if slot >= begin and not drop(agent, slot):
                rows.append((agent, slot, zone))
    return spark.createDataFrame(rows, "agent long, slot long, zone long").repartition(4).cache()


def test_draws_are_those_of_the_tables(spark):
    rows = [(a, a % 50, 7 * a % 1000, d) for a in range(3000) for d in (2, 29)]
    made = [r["x"] for r in spark.createDataFrame(rows, "a long, r long, t long, d long").select(inject.draw(3, F.col("a"), F.col("r"), F.col("t"), F.col("d"), F.lit(2)).alias("x")).collect()]
    assert (repetitions.draws(np.array([f"3|{a}|{r}|{t}|{d}|2".encode() for a, r, t, d in rows])) == made).all()
    with pytest.raises(ValueError, match="55"):
        repetitions.draws(np.array([b"1" * 56]))


def test_runs_of_an_agent_are_those_of_the_tables(spark):
    panel = detection.kept(some_panel(spark))
    cube = detection.kept(detection.forecast_cube(panel, SETUP))
    own, tables = ({tuple(r)[:3]: r["score"] for r in made(panel, cube, SETUP, 3, 7, **HOW).collect()} for made in (detection.by_agent, detection.by_verdicts))
    assert own.keys() == tables.keys() and 6 <= len(own) < 30
    assert all(abs(own[k] - tables[k]) < 1e-9 for k in own) and sum(abs(x) > 0.01 for x in own.values()) > 5


def test_other_panels_go_through_tables(spark, monkeypatch):
    """A gap within a day, a slot beside the axis, another option: by_verdicts(); else by_agent()."""
    asked = []
    for name in ("by_agent", "by_verdicts"):
        monkeypatch.setattr(detection, name, lambda *_, name=name, **__: asked.append(name) or spark.createDataFrame([], "agent long, rep long, positive boolean, score double"))
    panel, cube = some_panel(spark), spark.createDataFrame([(1, 1, 1, 1.0)], "origin long, dest long, slot long, p double")
    detection.calibrated(panel, cube, SETUP, **HOW)
    detection.calibrated(some_panel(spark, lambda a, s: (a, s) == (2, 43)), cube, SETUP, **HOW)
    detection.calibrated(panel.withColumn("slot", F.col("slot") + 8), cube, SETUP, **HOW)
    detection.calibrated(panel, cube, SETUP, mode="early", **HOW)
    assert asked == ["by_agent", "by_verdicts", "by_verdicts", "by_verdicts"]


def test_matches_by_table_are_solutions():
    """Steps from tabled starts end where steps from afar do, on the table's range and beyond it."""
    rng = np.random.default_rng(2)
    f, q = np.clip(rng.normal(size=4000) * rng.choice([0.1, 3, 15, 200], 4000), -dglm.WIDEST, dglm.WIDEST), np.exp(rng.uniform(-22, 11, 4000))
    alpha, beta = dglm.betas_of(f, q)
    (da, db), (ta, tb) = (x.reshape(2, -1) for x in dglm.polygammas_of(np.concatenate((alpha, beta)))[:2])
    assert np.allclose(da - db, f, rtol=1e-9, atol=2e-9) and np.allclose((ta + tb) / q, 1, atol=1e-7)
    far = dglm._newton(f, q, *dglm._starts(f, q))
    assert np.allclose(np.log(far[0]), np.log(alpha), atol=1e-6) and np.allclose(np.log(far[1]), np.log(beta), atol=1e-6)


def test_models_hand_over_few_rows_at_once():
    """However many rows a task filters together, what it hands over at once is few; all rows are there, in order."""

    class Rows:
        repartition = sortWithinPartitions = lambda self, *_: self
        mapInPandas = lambda self, run, _: run

    frame = pd.DataFrame({"k": np.repeat(np.arange(300), 200), "slot": np.tile(np.arange(200), 300)})
    made = list(dglm.by_series(Rows(), ["k"], ["slot"], "", lambda frames: (f for f in frames))(iter([frame])))
    assert max(map(len, made)) <= dglm.HANDED + 200 < 30_000 and pd.concat(made, ignore_index=True).equals(frame)


def test_draws_of_injected_days_are_made_together(monkeypatch):
    """However many repetitions are injected, their draws take as many calls as for one; training's rows are made for one of both runs."""
    rng = np.random.default_rng(1)
    zones = np.repeat((rng.integers(0, 3, (6, 12, 1)) + [0, 1, 2]) % 3, [3, 1, 4], axis=2).reshape(6, 96).astype(np.int16)  # a stay, a passage, a stay
    calls, rows, draws, made = [], [], repetitions.draws, getattr(repetitions.Factors, "_rows", None)
    monkeypatch.setattr(repetitions, "draws", lambda m: calls.append(len(m)) or draws(m))
    monkeypatch.setattr(repetitions.Factors, "_rows", lambda self, z: rows.append((len(z), made(self, z))) or rows[-1][1], raising=False)
    out = repetitions.scores(list(range(6)), zones, np.full((96, 3, 3), 1 / 3), SETUP, repetitions.Injection(**(HOW | {"threshold": 0.03})), 4, 7)
    assert len(out) > 20 and len(calls) < 80 < sum(calls)
    for count, own in rows:
        assert len(own["series"]) and own["series"].max() < 3 * (count // 2) < own["late_series"].max()


def test_corrected_steps_are_solutions():
    rng = np.random.default_rng(4)
    f, q = np.clip(rng.normal(size=4000) * rng.choice([0.1, 3, 15, 200], 4000), -dglm.WIDEST, dglm.WIDEST), np.exp(rng.uniform(-22, 11, 4000))
    for own, far in zip(repetitions._betas(f, q), dglm._newton(f, q, *dglm._starts(f, q)), strict=True):
        assert np.allclose(np.log(own), np.log(far), atol=1e-7)
    alpha, beta = repetitions._betas(np.zeros(300), np.exp(np.linspace(-13, 9, 300)))
    assert (alpha == beta).all()
