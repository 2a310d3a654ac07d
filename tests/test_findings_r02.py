"""Model and injection queries on larger tables: what tasks hold and hand over, and results that stay as they were."""

from __future__ import annotations

import numpy as np

from wayfold.operators import dglm


def test_bare_models_forecast_alike(spark):
    """Bare models hand over forecasts only; without path, just last rows have means; forecasts are the same."""
    rng = np.random.default_rng(3)
    data = [(int(k), 0, int(s), int(rng.random() < 0.4), 2.0, bool(s < 30), float(rng.normal())) for k in range(5) for s in range(40 - k)]
    rows = spark.createDataFrame(data, "k long, od long, slot long, y int, weight double, update boolean, x double")
    full, last, bare = (dglm.agent_models(rows, ["k"], ["x"], 1, **o).orderBy("k", "slot").collect() for o in ({}, {"path": False}, {"bare": True}))
    assert [tuple(r) for r in bare] == [tuple(r)[:5] for r in full] and len(bare[0]) == 5
    assert sum(r["m"] is not None for r in last) == 5
    assert [tuple(r) for r in last if r["a"] is not None] == [tuple(r) for r in full if r["a"] is not None]


def test_candidates_are_drawn_and_counted_in_place(spark):
    """All candidates of a day are drawn beside its zones, without a further exchange; the log's shares are those of the injected panel."""
    from wayfold.operators import detect, inject

    days = [[1] * 8 + [2] * (3 + a % 3) + [3] * 8 + [2] * (5 - a % 3) for a in range(4)]
    rows = [(a, 24 * d + s, z) for a in range(4) for d in range(3) for s, z in enumerate(days[a]) if not (d == 2 and s == 9 and a == 1)]
    panel = spark.createDataFrame(rows, "agent long, slot long, zone long")
    table = inject.days_of(panel, ["agent"], 24, 24, 72, 4).cache()
    drawn = inject.shifts_of(table, ["agent"], 6, attempts=(0, 1000))
    assert drawn.count() == 8000 and "Exchange" not in drawn._jdf.queryExecution().executedPlan().toString().split("InMemoryTableScan")[0]
    made, log = inject.inject_until(panel, ["agent"], 24, 24, 72, 0.15, 30, 1, min_stay=4, max_shift=6)
    shares = {r["agent"]: r["changed"] for r in detect.changed_share(made, panel, ["agent"], 24, 72).collect()}
    assert {r["agent"]: round(r["changed"], 9) for r in log.collect()} == {a: round(x, 9) for a, x in shares.items()} and any(shares.values())


def test_even_odds_stay_even():
    """A model that knows nothing forecasts 0.5, on no side of a threshold of 0.5 by the rounding of Newton steps."""
    q = np.geomspace(1e-3, 1e4, 400)
    alpha, beta = dglm.betas_of(np.zeros(400), q)
    assert (alpha == beta).all() and all(a == b for a, b in (dglm.beta_of(0.0, x) for x in q[::20]))
    for x in (1e-4, 0.3, 5.99, 6.0, 7.5, 1e6):
        assert np.allclose([p[0] for p in dglm.polygammas_of(np.array([x]))], dglm.polygammas(x), rtol=1e-9)


def test_forecasts_take_pairs_along(spark):
    """Pairs go along with a model's rows: no join of the forecasts with them, and no t where nobody reads it."""
    from wayfold.plans import detection

    rng = np.random.default_rng(4)
    names = [*detection.FEATURES, *(f"pm_{c}" for c in detection.FEATURES)]
    data = [(a, "k", 10 + d, 20 + d, 1 + d, s, int(rng.random() < 0.4), 1.0, *map(float, rng.normal(size=8))) for a in range(3) for s in range(40) for d in range(2)]
    rows = spark.createDataFrame(data, "agent long, kind string, origin long, dest long, od long, slot long, y int, weight double, " + ", ".join(f"{c} double" for c in names))
    setup = detection.Setup(per_day=8, slots=40, test_days=2)
    made, bare = detection.forecasts(rows, setup), detection.forecasts(rows, setup, bare=True)
    assert "Join" not in made._jdf.queryExecution().executedPlan().toString() and "t" not in bare.columns
    key = ["agent", "kind", "origin", "dest", "slot"]
    known = {tuple(r) for r in rows.select(*key).collect()}
    assert {tuple(r) for r in made.select(*key).collect()} == known and made.count() == len(known) == 240
    assert sorted(map(tuple, bare.collect())) == sorted(map(tuple, made.select(bare.columns).collect()))


def test_states_alone_are_handed_over(spark):
    """With ends a model hands over a row a series: the one that the whole result has for it, with its state."""
    rng = np.random.default_rng(5)
    data = [(int(k), 0, int(s), int(rng.random() < 0.4), 2.0, True, float(rng.normal())) for k in range(5) for s in range(40 - k)]
    rows = spark.createDataFrame(data, "k long, od long, slot long, y int, weight double, update boolean, x double")
    full, ends = dglm.agent_models(rows, ["k"], ["x"], 1), dglm.agent_models(rows, ["k"], ["x"], 1, ends=True)
    assert ends.columns == full.columns and ends.count() == 5
    assert sorted(map(tuple, ends.collect())) == sorted(map(tuple, full.filter("r is not null").collect()))


def test_moves_have_what_all_cells_say(spark):
    """A row a move, without a table of all cells: both probabilities and the likeliest destination as from assembled()."""
    from wayfold.operators import counts, detect
    from wayfold.plans import detection

    rng = np.random.default_rng(6)
    rows = [(a, s, int(rng.choice([1, 2, 3, 4], p=[0.5, 0.3, 0.15, 0.05]))) for a in range(6) for s in range(96)]
    panel = spark.createDataFrame(rows, "agent long, slot long, zone long")
    setup = detection.Setup(per_day=8, slots=96, test_days=3, min_stay=2, min_taken=4)
    cube = detection.group_cube(panel).cache()
    model, cells = detection.model_rows(panel, cube, setup)
    made, moves = detection.forecasts(model, setup).cache(), counts.transitions(panel)
    assert cells.join(made, ["agent", "origin"], "left_anti").count() and cells.join(made, ["agent", "origin", "dest"], "left_anti").count()
    own = detection.by_move(cells, made, cube, 72).cache()
    pm, oam = (detection.assembled(cells, made, cube, c) for c in ("p_pm", "p_oam"))
    wanted = {(r["agent"], r["slot"]): round(r["h"], 9) for r in detect.step_log_factor(moves, pm, oam, ["agent"]).collect()}
    assert {(r["agent"], r["slot"]): round(r["h"], 9) for r in own.select("agent", "slot", detect.log_factor(own["p_pm"], own["p_oam"]).alias("h")).collect()} == wanted and len(wanted) == 6 * 95
    best = {(r["agent"], r["slot"]): (r["origin"], r["dest"], round(r["p"], 9), r["real_dest"]) for r in detect.argmax_destination(oam, moves, ["agent"], 72).collect()}
    assert {(r["agent"], r["slot"]): (r["origin"], r["best"]["dest"], round(r["best"]["p"], 9), r["real_dest"]) for r in own.filter("best is not null").collect()} == best and best
    table = detection.kept(own)
    assert detection.kept(table) is table and detection.kept(table.filter("slot > 3")) is not table
