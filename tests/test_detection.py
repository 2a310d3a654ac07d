"""The detection pipeline on a small population with one agent whose days change."""

from __future__ import annotations

import pytest

from wayfold.operators import counts
from wayfold.plans import detection

SETUP = detection.Setup(per_day=8, slots=96, test_days=3, min_stay=2, min_taken=1)


@pytest.fixture(scope="module")
def panel(spark):
    usual, other = [1, 1, 1, 2, 3, 3, 3, 1], [3, 3, 1, 1, 1, 2, 2, 3]
    rows = []
    for agent in range(4):
        for day in range(12):
            path = other if agent == 3 and day >= 9 else usual
            rows += [(agent, 8 * day + s, z if (agent + day + s) % 17 else 2) for s, z in enumerate(path)]
    return spark.createDataFrame(rows, "agent long, slot long, zone long").repartition(4).cache()


@pytest.fixture(scope="module")
def cube(panel):
    return detection.group_cube(panel).cache()


def test_group_cube_rows_sum_to_one(cube):
    from wayfold.operators.probability import row_sums_off

    assert row_sums_off(cube).count() == 0 and cube.filter("p < 0").count() == 0


def test_features_know_nothing_of_their_slot(spark, panel, cube):
    """Changing what happens in the last slots leaves all earlier rows' features as they were."""
    names = ["agent", "origin", "dest", "slot", "kernel_prob", "lag1", "lag2", "gate", "pm_kernel_prob"]
    changed = panel.selectExpr("agent", "slot", "case when slot >= 90 then 2 else zone end as zone")
    a, b = ({(r["agent"], r["origin"], r["dest"], r["slot"]): tuple(r)[4:] for r in detection.model_rows(p, cube, SETUP)[0].filter("slot < 90").select(*names).collect()} for p in (panel, changed))
    assert a == b and len(a) > 50


def test_verdicts(panel, cube):
    made = {r["agent"]: r for r in detection.verdicts(panel, cube, SETUP).collect()}
    assert set(made) == {0, 1, 2, 3}
    for r in made.values():
        assert r["log_l"] == r["log_l"] and abs(r["log_l"]) < 1e6 and r["run_len"] >= 1 and 0 <= r["accuracy"] <= 1
    assert made[3]["log_l"] < max(made[a]["log_l"] for a in (0, 1, 2))


def test_assembled_rows_are_probabilities(panel, cube):
    rows, cells = detection.model_rows(panel, cube, SETUP)
    made = detection.forecasts(rows, SETUP)
    assert made.filter("p_pm <= 0 or p_pm >= 1 or p_oam <= 0 or p_oam >= 1").count() == 0
    assert made.filter(f"slot <= {SETUP.end_of_training} and p_pm != p_oam").count() == 0
    full = detection.assembled(cells, made, cube, "p_oam")
    assert full.filter("p < -1e-9 or p > 1 + 1e-9").count() == 0
    assert full.select("agent", "origin", "dest", "slot").distinct().count() == full.count()
    assert counts.transitions(panel).join(full.filter("p is not null"), ["agent", "origin", "dest", "slot"], "left_anti").count() < 0.35 * counts.transitions(panel).count()


def test_calibration_scores_every_successful_repetition(panel, cube):
    scores, thresholds = detection.calibrated(panel, cube, SETUP, repetitions=2, threshold=0.01, tries=3, min_stay=2, max_shift=2)
    rows = scores.collect()
    assert rows and all(r["score"] == r["score"] for r in rows)
    pairs = {(r["agent"], r["rep"]) for r in rows}
    assert all(sum((r["agent"], r["rep"]) == p for r in rows) == 2 for p in pairs)
    assert all(r["fpr"] <= 0.1 for r in thresholds.collect())


def test_cube_and_features_of_a_slot_ignore_its_moves(spark, panel):
    """The cube is rebuilt from the changed panel: up to the first changed slot, itself included, nothing may differ."""
    names = ["agent", "origin", "dest", "slot", "kernel_prob", "lag1", "lag2", "gate"]
    cells, features = [], []
    for p in (panel, panel.selectExpr("agent", "slot", "case when slot >= 90 then 2 else zone end as zone")):
        cube = detection.forecast_cube(p, SETUP).cache()
        cells.append({tuple(r)[:3]: round(r["p"], 9) for r in cube.filter("slot <= 90").select("origin", "dest", "slot", "p").collect()})
        features.append({tuple(r)[:4]: [round(x, 9) for x in tuple(r)[4:]] for r in detection.model_rows(p, cube, SETUP)[0].filter("slot <= 90").select(*names).collect()})
    assert cells[0] == cells[1] and len(cells[0]) == 9 * 90
    both = features[0].keys() & features[1].keys()
    assert any(k[3] == 90 for k in both) and all(features[0][k] == features[1][k] for k in both)


def test_cube_covers_origins_without_a_model(spark, panel):
    """Zone 9 is first left after training: no forecast, equal shares in every slot."""
    cube = detection.forecast_cube(panel.selectExpr("agent", "slot", "case when agent = 0 and slot >= 80 then 9 else zone end as zone"), SETUP)
    assert {(r["dest"], r["p"]) for r in cube.filter("origin = 9").collect()} == {(z, 0.25) for z in (1, 2, 3, 9)}
    assert cube.filter("origin = 9").count() == 4 * 95


def test_verdicts_from_forecasts(panel):
    made = {r["agent"]: r["log_l"] for r in detection.verdicts(panel, detection.forecast_cube(panel, SETUP), SETUP).collect()}
    assert set(made) == {0, 1, 2, 3} and made[3] < max(made[a] for a in (0, 1, 2))


def test_calibrate_is_registered_whole(spark, panel, monkeypatch):
    """50 repetitions with the reference's retries and threshold; an agent without a scored repetition keeps a row."""
    from wayfold.plans import models

    asked = {}

    def calibrated(panel, cube, **options):
        asked.update(options)
        return None, spark.createDataFrame([(0, -1.0)], "agent long, tau double")

    monkeypatch.setattr(models, "coarse", lambda *_: panel)
    monkeypatch.setattr(models.detection, "forecast_cube", lambda p: p)
    monkeypatch.setattr(models.detection, "calibrated", calibrated)
    assert {r["agent"]: r["tau"] for r in models.calibrate(spark, "").collect()} == {0: -1.0, 1: None, 2: None, 3: None}
    assert asked["repetitions"] == 50 and asked.get("threshold", 0.175) == 0.175 and asked.get("tries", 1000) == 1000


def test_asked_rows_are_the_cascade_of_valid_pairs(panel):
    """Made from moves and pairs, without the cells of pairs that aren't valid; kept steps are compressed tables."""
    from wayfold.operators import sequence

    end = SETUP.end_of_training
    asked = counts.onehot_to_cascade(counts.indicator(counts.transitions(panel)))
    types = sequence.classify_zones(panel.filter(f"slot <= {end}"), ["agent"], SETUP.min_stay)
    valid = counts.by_zone_type(counts.valid_pairs(asked, end, SETUP.min_taken).filter("valid"), types)
    wanted = asked.join(valid, ["agent", "origin", "dest"]).select("agent", "origin", "dest", "slot", "y", "rank", "kind")
    made = detection.kept(detection.asked_rows(panel, SETUP), dealt=True)
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, wanted.collect())) and made.count() > 100
    assert made.columns == wanted.columns and all(f.endswith(".zstd.parquet") for f in made.inputFiles())
    assert panel.sparkSession.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"
