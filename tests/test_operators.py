"""Worked examples and properties of the mobility operators."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.operators import counts, detect, dglm, graph, inject, kernel, probability, sequence
from wayfold.sources import events, files


def toy(spark):
    """Three agents, four slots."""
    paths = {0: [1, 2, 3, 3], 1: [2, 2, 3, 1], 2: [1, 3, 3, 3]}
    return spark.createDataFrame([(a, t, z) for a, p in paths.items() for t, z in enumerate(p)], "agent long, slot long, zone long")


def got(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_transition_counts_and_ranks(spark):
    od = counts.od_counts(toy(spark))
    assert got(od, "origin", "dest", "slot", "n") == [(1, 2, 1, 1), (1, 3, 1, 1), (2, 2, 1, 1), (2, 3, 2, 2), (3, 1, 3, 1), (3, 3, 2, 1), (3, 3, 3, 2)]
    ranks = {(o, d): (t, r) for o, d, t, r in got(counts.od_ranked(od), "origin", "dest", "total", "rank")}
    assert ranks == {(1, 2): (1, 1), (1, 3): (1, 2), (2, 3): (2, 1), (2, 2): (1, 2), (3, 3): (3, 1), (3, 1): (1, 2)}


def test_cascade_sizes(spark):
    occupied = spark.createDataFrame([(z, t, n) for z, row in {1: [2, 1, 0, 1], 2: [1, 2, 1, 0], 3: [0, 1, 3, 3]}.items() for t, n in enumerate(row)], "zone long, slot long, n long")
    cells = {(1, 2): [1, 0, 0], (1, 3): [1, 1, 0], (2, 3): [0, 1, 0], (3, 1): [0, 0, 1]}
    od = spark.createDataFrame([(*p, t + 1, n) for p, row in cells.items() for t, n in enumerate(row)], "origin long, dest long, slot long, n long")
    ranked = spark.createDataFrame([(1, 2, 1), (1, 3, 2), (2, 3, 1), (3, 1, 1)], "origin long, dest long, rank long")
    sizes = {}
    for o, d, t, s in got(counts.cascade_sizes(od, ranked, occupied, 1, 3), "origin", "dest", "slot", "size"):
        sizes.setdefault((o, d), []).append(s)
    assert sizes == {(1, 2): [2, 1, 0], (1, 3): [1, 1, 0], (2, 3): [1, 2, 1], (3, 1): [0, 1, 3]}


def test_run_lengths(spark):
    series = spark.createDataFrame([(0, t, z) for t, z in enumerate([1, 2, 2, 2, 2, 2, 3, 3, 3, 2])], "agent long, slot long, zone long")
    assert {r["zone"]: r["lens"] for r in sequence.stay_lengths(series, ["agent"]).collect()} == {1: [1], 2: [5, 1], 3: [3]}


def test_run_length_breaks_on_null_and_gap(spark):
    rows = [(0, t, y) for t, y in [(0, 1), (1, 1), (2, 0), (3, None), (4, 1), (6, 1), (7, 0), (8, 0)]]
    made = sequence.run_length(spark.createDataFrame(rows, "agent long, slot long, y int"), ["agent"]).orderBy("slot").collect()
    assert [r["run_len"] for r in made] == [1, 2, 2, None, 1, 1, 1, 0]


def test_decayed_mean_stay_equals_recursion(spark):
    rng = np.random.default_rng(3)
    y = (rng.random(300) < 0.7).astype(int).tolist()
    series = spark.createDataFrame([(0, t, v) for t, v in enumerate(y)], "agent long, slot long, y int")
    made = [r["mean_stay"] for r in sequence.decayed_mean_stay(series, ["agent"]).orderBy("slot").collect()]
    run, weight, total, expected = 0, 0.0, 0.0, []
    for v in y:
        if v == 1:
            run += 1
        else:
            if run:
                weight, total = 0.8 * weight + 1, 0.8 * total + run
            run = 0
        expected.append(total / weight if weight else None)
    assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-9) for a, b in zip(made, expected, strict=True))


def test_grid(spark):
    assert (geo.Grid().rows, geo.Grid().cols, geo.Grid(cell=0.001).rows, geo.Grid(cell=0.001).cols) == (108, 125, 1072, 1250)
    from pyspark.sql import functions as F

    row = spark.range(1).select(geo.zone_index(F.lit(36.024971), F.lit(-84.211232), geo.Grid(cell=0.001)).alias("z"), geo.zone_index(F.lit(0.0), F.lit(0.0)).alias("edge")).first()
    assert row["z"] == 643242 and row["edge"] == 124


def test_haversine(spark):
    from pyspark.sql import functions as F

    lit = [F.lit(float(x)) for x in (36, -84, 36.01, -83.99)]
    row = spark.range(1).select(geo.haversine_m(lit[0], lit[1], lit[2], lit[1]).alias("a"), geo.haversine_m(lit[0], lit[1], lit[0], lit[3]).alias("b"), geo.haversine_m(*lit).alias("c")).first()
    assert [round(x, 3) for x in row] == [1111.951, 899.587, 1430.241]


def test_bayes_factor_example_and_recursion(spark):
    rng = np.random.default_rng(5)
    for h in ([-1.0, -2.0, 5.0, -1.0], rng.normal(size=400).round(3).tolist()):
        steps = spark.createDataFrame([(0, t, x) for t, x in enumerate(h)], "agent long, slot long, h double")
        made = detect.cumulative_bayes_factor(steps, ["agent"]).orderBy("slot").collect()
        log_l, run, expected = 0.0, 0, []
        for x in h:
            run = run + 1 if log_l < 0 else 1
            log_l = x + min(0.0, log_l)
            expected.append((log_l, run))
        assert all(abs(r["log_l"] - e[0]) < 1e-9 and r["run_len"] == e[1] for r, e in zip(made, expected, strict=True))


def test_stick_breaking_round_trip(spark):
    sticks = spark.createDataFrame([(1, 0, k, v) for k, v in enumerate([0.5, 0.5, 1.0], 1)], "origin long, slot long, rank long, p double")
    mult = probability.stick_to_multinomial(sticks, ["origin"])
    assert [r["p"] for r in mult.orderBy("rank").collect()] == [0.5, 0.25, 0.25]
    assert [r["p"] for r in probability.multinomial_to_cascade(mult, ["origin"]).orderBy("rank").collect()] == [0.5, 0.5, 1.0]


def test_null_poisons_later_sticks(spark):
    sticks = spark.createDataFrame([(1, 0, 1, 0.5), (1, 0, 2, None), (1, 0, 3, 0.2)], "origin long, slot long, rank long, p double")
    assert [r["p"] for r in probability.stick_to_multinomial(sticks, ["origin"]).orderBy("rank").collect()] == [0.5, None, None]


def test_full_transition_rows_sum_to_one(spark):
    part = spark.createDataFrame([(0, 1, 0, 0.6), (1, 0, 0, 1.0)], "origin long, dest long, slot long, p double")
    zones = spark.createDataFrame([(z,) for z in range(3)], "zone long")
    cube = probability.full_transition(part, zones)
    assert probability.row_sums_off(cube).count() == 0 and cube.count() == 6


def brute_kernel(y, n, per_day, h, reach, decay, alpha, beta, same_day):
    out = []
    for t in range(len(y)):
        d, s = divmod(t, per_day)
        a, b = alpha, alpha + beta
        for u in range(len(y)):
            e, r = divmod(u, per_day)
            gap = min(abs(r - s), per_day - abs(r - s))
            if gap <= reach and (e < d or same_day and e == d and r < s):
                w = math.exp(-(d - e) / decay - (gap / h) ** 2)
                a, b = a + w * y[u], b + w * n[u]
        out.append(a / b)
    return out


@pytest.mark.parametrize("same_day", [True, False])
@pytest.mark.parametrize("reach", [2, 7])
def test_kernel_equals_brute_force(spark, same_day, reach):
    rng = np.random.default_rng(1)
    n = rng.integers(1, 9, 6 * 8)
    y = (n * rng.random(len(n))).astype(int)
    series = spark.createDataFrame([(0, int(t), int(a), int(b)) for t, (a, b) in enumerate(zip(y, n, strict=True))], "k long, slot long, y long, n long")
    made = kernel.binomial_forecast(series, ["k"], 8, 360, reach * 180, 5.0, same_day=same_day).orderBy("slot").collect()
    expected = brute_kernel(y, n, 8, 2, reach, 5.0, 1, 1, same_day)
    assert np.allclose([r["value"] for r in made], expected)


def test_gamma_functions():
    d, t, u = dglm.polygammas(1.0)
    assert abs(d + 0.5772156649015329) < 1e-9 and abs(t - math.pi**2 / 6) < 1e-9 and abs(u + 2.4041138063191886) < 1e-7
    for f, q in ((0.0, 10.0), (3.0, 0.1), (-5.0, 2.0), (0.2, 50.0)):
        (da, ta, _), (db, tb, _) = (dglm.polygammas(x) for x in dglm.beta_of(f, q))
        assert abs(da - db - f) < 1e-6 and abs(ta + tb - q) < 1e-6 * q


def test_static_model_learns_the_rate():
    rng = np.random.default_rng(2)
    n = np.full(400, 20.0)
    y = rng.binomial(20, 0.3, 400).astype(float)
    design = dglm.Design(0)
    p, m, v = dglm.filtered(y, n, np.zeros((400, 0)), design, dglm.State.prior(1, 10.0))
    assert abs(p[-1] - y.sum() / n.sum()) < 0.01 and ((0 < p) & (p < 1)).all() and v[-1, 0] < 0.01


def test_empty_slots_only_evolve():
    design = dglm.Design(0, True, [(24, 1)])
    state = dglm.State.prior(design.size, 10.0)
    _, m, _ = dglm.filtered(np.zeros(5), np.zeros(5), np.zeros((5, 0)), design, state)
    assert np.allclose(m, 0)


def test_matched_betas_solve_their_equations_in_few_steps(monkeypatch):
    calls, plain = [], dglm.polygammas
    monkeypatch.setattr(dglm, "polygammas", lambda x: calls.append(x) or plain(x))
    grid = [(f, q) for f in (0.0, 0.1, 1.0, -3.0, 6.0, -10.0, 20.0, -35.0, 120.0, -400.0) for q in (1e-8, 1e-4, 0.01, 1.0, 3.99, 4.01, 10.0, 100.0, 3000.0, 1e5)]
    many = dglm.betas_of(*map(np.array, zip(*grid, strict=True)))
    for i, (f, q) in enumerate(grid):
        calls.clear()
        a, b = dglm.beta_of(f, q)
        assert len(calls) <= 2 * 9 and np.allclose([x[i] for x in many], [a, b], rtol=1e-9, atol=0)
        (da, ta, _), (db, tb, _) = plain(a), plain(b)
        assert abs(da - db - f) < 1e-9 and abs((ta + tb) / q - 1) < 1e-9


def test_model_resumes_from_its_state():
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(60, 2)), (rng.random(60) < 0.5).astype(float)
    design, whole = dglm.Design(2), dglm.State.prior(3, 50.0)
    p, _, _ = dglm.filtered(y, np.ones(60), x, design, whole)
    state = dglm.State.prior(3, 50.0)
    first, _, _ = dglm.filtered(y[:30], np.ones(30), x[:30], design, state)
    second, _, _ = dglm.filtered(y[30:], np.ones(30), x[30:], design, state)
    assert np.allclose(p, np.concatenate((first, second)))


def test_series_together_equal_series_alone():
    """Against the plain filter, series by series: unlike lengths, gaps, extra trials, seasons and discounts."""
    rng = np.random.default_rng(6)
    for design in (dglm.Design(2), dglm.Design(1, True, [(8, 2)], 0.98, 0.99, 0.97)):
        series, plain = [], []
        for size in (1, 40, 7, 0, 23):
            n = rng.integers(0, 4, size).astype(float)
            y = np.where(rng.random(size) < 0.1, np.nan, np.minimum(n, rng.integers(0, 3, size)))
            x, extra = rng.normal(size=(size, design.regressors)), rng.integers(0, 3, size).astype(float)
            series.append(dglm.Series(y, n, x, dglm.State.prior(design.size, 10.0), extra))
            plain.append((y, n, x, dglm.State.prior(design.size, 10.0), extra))
        made = dglm.filtered_together(series, design)
        for own, (p, m, v), (y, n, x, state, extra) in zip(series, made, plain, strict=True):
            expected = dglm.filtered(y, n, x, design, state, extra)
            assert all(np.allclose(a, b, atol=1e-8) for a, b in zip((p, m, v), expected, strict=True))
            assert np.allclose(own.state.a, state.a, atol=1e-8) and np.allclose(own.state.r, state.r, atol=1e-8)


def model_frame(spark, keys=7, slots=60):
    rng = np.random.default_rng(12)
    rows = [(k if k else None, 0, t, int(rng.random() < 0.4), 3, float(rng.normal()), 2.5, t % 9 != 4) for k in range(keys) for t in range(slots - 5 * k)]
    return spark.createDataFrame(rows, "k long, od long, slot long, y int, n int, x double, weight double, update boolean").repartition(5)


@pytest.mark.parametrize("kind", ["group", "agent"])
def test_stopping_and_resuming_equals_one_pass(spark, monkeypatch, kind):
    monkeypatch.setattr(dglm, "TOGETHER", 3)
    rows = model_frame(spark)

    def fit(part, states=None):
        if kind == "group":
            return dglm.group_models(part, ["k"], ["x"], 8, discounts=(0.98, 0.99, 1.0), states=states)
        return dglm.agent_models(part, ["k"], ["x"], 1, True, states=states)

    whole = {(r["k"], r["slot"]): r for r in fit(rows).collect()}
    assert len(whole) == rows.count() and sum(r["r"] is not None for r in whole.values()) == 7
    states = dglm.last_states(fit(rows.filter("slot < 28")), ["k"])
    tail = fit(rows.filter("slot >= 28"), states).collect()
    assert len(tail) == rows.filter("slot >= 28").count()
    for r in tail:
        own = whole[r["k"], r["slot"]]
        assert abs(r["p_hat"] - own["p_hat"]) < 1e-9 and np.allclose(r["m"], own["m"], atol=1e-8)
        assert (r["r"] is None) == (own["r"] is None) and (r["r"] is None or np.allclose(r["r"], own["r"], atol=1e-8))


@pytest.mark.parametrize("kind", ["group", "agent"])
def test_a_series_without_new_rows_keeps_its_state(spark, kind):
    rows = model_frame(spark, 5, 40)

    def fit(part, states=None):
        made = dglm.group_models(part, ["k"], ["x"], 8, states=states) if kind == "group" else dglm.agent_models(part, ["k"], ["x"], states=states)
        return made.checkpoint()

    states = dglm.last_states(fit(rows.filter("slot < 22")), ["k"])
    tail = fit(rows.filter("slot >= 22"), states)
    assert tail.filter("k = 4").count() == 0 and tail.count() == rows.filter("slot >= 22").count()
    kept = {r["k"]: r for r in dglm.last_states(tail, ["k"], states).collect()}
    whole = {r["k"]: r for r in dglm.last_states(fit(rows), ["k"]).collect()}
    assert set(kept) == set(whole) == {None, 1, 2, 3, 4}
    assert all(np.allclose(kept[k]["r"], whole[k]["r"], atol=1e-8) for k in kept)
    assert fit(rows.filter("slot < 0"), states).count() == 0


def metres(a, b):
    """Great circle by the haversine formula."""
    p, q = (math.radians(x[0]) for x in (a, b))
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * geo.EARTH_RADIUS_M * math.asin(math.sqrt(h))


def scattered(spark, seed, n=40, groups=14):
    rng = np.random.default_rng(seed)
    at = {z: (36 + rng.random() * 0.2, -84 + rng.random() * 0.2) for z in range(n)}
    label = {z: int(rng.integers(0, groups)) for z in range(n)}
    label = {z: min(y for y in label if label[y] == c) for z, c in label.items()}  # named by their least zone
    return at, label, spark.createDataFrame([(z, *at[z], label[z]) for z in at], "zone long, lat double, lon double, label long")


def gap(at, xs, ys):
    return min(metres(at[x], at[y]) for x in xs for y in ys)


@pytest.mark.parametrize("seed", [1, 2])
def test_merge_small_equals_plain_steps(spark, seed):
    at, label, frame = scattered(spark, seed)
    members = lambda c: [z for z in label if label[z] == c]
    start = dict(label)
    sizes = {c: len(members(c)) for c in set(label.values())}
    large = sorted(c for c in sizes if sizes[c] >= 3)
    plan = {}
    for c in sorted(c for c in sizes if sizes[c] < 3):
        own = members(c)
        found = min((gap(at, own, members(x)), x) for x in large)
        plan[c] = found[0]
        label.update(dict.fromkeys(own, found[1]))
    made = graph.merge_small(frame, 3).collect()
    assert {r["zone"]: r["label"] for r in made} == label
    assert all(r["was"] == start[r["zone"]] and (r["gap_m"] is None) == (r["was"] not in plan) for r in made)
    assert all(abs(r["gap_m"] - plan[r["was"]]) < 1e-6 for r in made if r["was"] in plan)


@pytest.mark.parametrize("seed", [3, 4])
@pytest.mark.parametrize("by_size", [False, True])
def test_two_stage_merge_equals_plain_steps(spark, seed, by_size):
    at, start, frame = scattered(spark, seed)
    most, least, far = 6, 3, 9000.0
    first = {c: [z for z in start if start[z] == c] for c in set(start.values())}
    now = {c: list(z) for c, z in first.items()}
    roomy = [c for c in first if least <= len(first[c]) < most]
    asked = []
    for c in (c for c in first if len(first[c]) < least):
        d, to = min((gap(at, first[c], first[x]), x) for x in roomy)
        asked.append(((-len(first[c]), d, c) if by_size else (d, -len(first[c]), c), c, d, to))
    lonely = []
    for _, c, d, to in sorted(asked):
        if d <= far and len(now[to]) + len(first[c]) <= most:
            now[to] += now.pop(c)
        else:
            lonely.append(c)
    joined = {c: c for c in lonely}
    for d, a, b in sorted((gap(at, first[a], first[b]), a, b) for i, a in enumerate(lonely) for b in lonely[i + 1 :]):
        if joined[a] == a and joined[b] == b and len(now[a]) + len(now[b]) <= most and d <= far:
            now[a] += now.pop(b)
            joined[b] = a
    expected = {z: min(own) for own in now.values() for z in own}
    made = graph.two_stage_merge(frame, most, least, far, far, by_size).collect()
    assert {r["zone"]: r["label"] for r in made} == expected and any(r["gap_m"] for r in made)


def forest(nodes, edges):
    """Components' least members."""
    out = {}
    for n in sorted(nodes):
        todo = [n]
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = n
                todo += [b for a, b, *_ in edges if a == x] + [a for a, b, *_ in edges if b == x]
    return out


def test_skater_equals_plain_steps(spark):
    """The spanning forest by taking edges away from the heaviest on, as long as they lie on a cycle; then the cuts one by one."""
    own = grid_zones(spark, 5)
    rng = np.random.default_rng(1)
    costs = [(r["src"], r["dst"], float(rng.permutation(200)[0])) for r in graph.radius_edges(own, 1250.0).filter("src < dst").orderBy("src", "dst").collect()]
    costs = [(a, b, c + i / 1000) for i, (a, b, c) in enumerate(costs)]
    nodes = [r["zone"] for r in own.collect()]
    tree = list(costs)
    for e in sorted(costs, key=lambda e: -e[2]):
        rest = [x for x in tree if x != e]
        if forest(nodes, rest) == forest(nodes, tree):
            tree = rest
    while True:
        label = forest(nodes, tree)
        sizes = {c: sum(v == c for v in label.values()) for c in set(label.values())}
        heaviest = [max((e for e in tree if label[e[0]] == c), key=lambda e: e[2]) for c in sizes if sizes[c] > 9]
        if not heaviest:
            break
        tree = [e for e in tree if e not in heaviest]
    while len(set(forest(nodes, tree).values())) < 7:
        tree.remove(max(tree, key=lambda e: e[2]))
    made = graph.skater(own, spark.createDataFrame(costs, "src long, dst long, cost double"), 7, 9)
    assert {r["zone"]: r["label"] for r in made.collect()} == forest(nodes, tree)


def test_flow_clusters_equal_plain_ward(spark):
    """Ward by its definition on pairwise squared distances, without the update formula's order."""
    rng = np.random.default_rng(2)
    zones, n = grid_zones(spark, 3), 9
    names = sorted(r["zone"] for r in zones.collect())
    flow = rng.permutation(n * n).reshape(n, n).astype(float) + 1
    flows = spark.createDataFrame([(names[i], names[j], int(flow[i, j])) for i in range(n) for j in range(n)], "origin long, dest long, n long")
    gaps = {(r["src"], r["dst"]): r["dist_m"] for r in graph.distance_matrix(zones).collect()}
    d = np.maximum(flow, flow.T)
    d[np.array([[gaps[a, b] > 2000 for b in names] for a in names])] = 2 * d.max()
    groups = {i: [i] for i in range(n)}
    square = {(i, j): d[i, j] ** 2 for i in range(n) for j in range(n) if i < j}
    while len(groups) > 4:
        i, j = min(square, key=lambda p: (square[p], p))
        a, b = len(groups[i]), len(groups[j])
        for k in [k for k in groups if k not in (i, j)]:
            ik, jk, c = tuple(sorted((i, k))), tuple(sorted((j, k))), len(groups[k])
            square[ik] = ((a + c) * square[ik] + (b + c) * square.pop(jk) - c * square[i, j]) / (a + b + c)
        groups[i] += groups.pop(j)
        square = {p: v for p, v in square.items() if j not in p}
    made = {r["zone"]: r["label"] for r in graph.flow_clusters(flows, graph.distance_matrix(zones), 2000.0, 4).collect()}
    expected = {names[i]: c for c, own in groups.items() for i in own}
    assert all((made[a] == made[b]) == (expected[a] == expected[b]) for a in names for b in names)


def grid_zones(spark, n=6):
    return spark.createDataFrame([(r * 10 + c, 36.0 + r * 0.01, -84.0 + c * 0.01) for r in range(n) for c in range(n)], "zone long, lat double, lon double")


def test_radius_edges_are_the_four_neighbours(spark):
    edges = graph.radius_edges(grid_zones(spark), 1250.0)
    assert edges.count() == 2 * 2 * 6 * 5
    assert all(abs(r["src"] - r["dst"]) in (1, 10) for r in edges.collect())


def test_capped_clusters_hold_and_connect(spark):
    own = grid_zones(spark)
    edges = graph.radius_edges(own, 1250.0)
    labels = graph.capped_components(graph.components(own, edges), edges, 7)
    parts = {}
    for r in labels.collect():
        parts.setdefault(r["label"], set()).add(r["zone"])
    assert sum(map(len, parts.values())) == 36 and max(map(len, parts.values())) <= 7
    for zones in parts.values():
        seen, todo = set(), [min(zones)]
        while todo:
            z = todo.pop()
            if z in zones and z not in seen:
                seen.add(z)
                todo += [z - 1, z + 1, z - 10, z + 10]
        assert seen == zones
    merged = graph.two_stage_merge(own.join(labels, "zone"), 9, 4)
    assert max(r["count"] for r in merged.groupBy("label").count().collect()) <= 9
    assert min(r["count"] for r in graph.merge_small(own.join(labels, "zone"), 4).groupBy("label").count().collect()) >= 4


def test_skater_bounds_and_counts(spark):
    own = grid_zones(spark)
    costs = graph.radius_edges(own, 1250.0).filter("src < dst").selectExpr("src", "dst", "dist_m + src as cost")
    made = [r["count"] for r in graph.skater(own, costs, 6, 10).groupBy("label").count().collect()]
    assert sum(made) == 36 and max(made) <= 10 and len(made) >= 6


def test_hierarchical_single_is_components():
    rng = np.random.default_rng(0)
    points = rng.random((40, 1)) * 10
    distance = np.abs(points - points.T)
    made = graph.agglomerated(distance.copy(), 0.3, None, "single")
    order = np.argsort(points[:, 0])
    expected = np.concatenate(([0], np.cumsum(np.diff(points[order, 0]) > 0.3)))
    assert len(set(made)) == expected[-1] + 1 and all((made[a] == made[b]) == (expected[i] == expected[i + 1]) for i, (a, b) in enumerate(zip(order, order[1:])))


def day_panel(spark):
    day = [1] * 6 + [2] * 2 + [3] * 6 + [4] * 2 + [1] * 8
    return spark.createDataFrame([(a, d * 24 + s, z) for a in range(3) for d in range(6) for s, z in enumerate(day)], "agent long, slot long, zone long")


@pytest.mark.parametrize("mode", ["early", "late", "random"])
def test_injection_keeps_length_and_moves_the_passage(spark, mode):
    panel = day_panel(spark)
    shifts = inject.chosen_shifts(panel, ["agent"], 24, 72, 144, 5, 4, pick="first", mode=mode, seed=3)
    made = inject.injected(panel, shifts, ["agent"], 24)
    assert made.count() == panel.count() and shifts.filter("shift > 4").count() == 0
    share = {r["agent"]: r["changed"] for r in detect.changed_share(made, panel, ["agent"], 72, 144).collect()}
    assert len(share) == 3 and all(0 < x < 0.5 for x in share.values())
    assert all(r["changed"] == 0 for r in detect.changed_share(made, panel, ["agent"], 0, 72).collect())


def test_injection_by_hand(spark):
    panel = day_panel(spark).filter("agent = 0 and slot < 24")
    one = inject.chosen_shifts(panel, ["agent"], 24, 0, 24, 5, 4, pick="first", mode="early", seed=1)
    d = one.first()["shift"]
    made = [r["zone"] for r in inject.injected(panel, one, ["agent"], 24).orderBy("slot").collect()]
    assert made == [1] * (6 - d) + [2] * 2 + [3] * (6 + d) + [4] * 2 + [1] * 8


def test_day_swaps_are_a_permutation(spark):
    panel = day_panel(spark)
    swaps = inject.day_swaps(panel, ["agent"], 24, 96, 144, 9)
    made = inject.swapped(panel, swaps, ["agent"], 24)
    assert got(made, "agent", "slot") == got(panel, "agent", "slot")
    days = [r["from_day"] for r in swaps.filter("agent = 0 and day >= 4").collect()]
    assert len(set(days)) == 2 and max(days) < 4


def test_threshold_curves_equal_a_sweep(spark):
    rng = np.random.default_rng(8)
    rows = [(0, float(s), bool(p)) for s, p in zip(rng.integers(0, 9, 60), rng.random(60) < 0.4, strict=True)]
    curves = detect.threshold_curves(spark.createDataFrame(rows, "k long, score double, positive boolean"), ["k"])
    p = sum(r[2] for r in rows)
    for r in curves.collect():
        tp = sum(1 for x in rows if x[1] <= r["tau"] and x[2])
        fp = sum(1 for x in rows if x[1] <= r["tau"] and not x[2])
        assert (r["tp"], r["fp"]) == (tp, fp) and abs(r["recall"] - tp / p) < 1e-12
    assert {(r["n_pos"], r["n_neg"]) for r in curves.collect()} == {(p, 60 - p)}
    none = detect.threshold_by_recall(curves.filter("tau > 2"), ["k"], 0.0).first()
    assert not none["feasible"] and none["fpr"] == min(r["fpr"] for r in curves.filter("tau > 2").collect())
    best = detect.threshold_by_recall(curves, ["k"], 0.2).first()
    assert best["feasible"]
    assert best["fpr"] <= 0.2 and best["recall"] == max(r["recall"] for r in curves.collect() if r["fpr"] <= 0.2)


def test_panel_carries_forward_and_ignores_nulls(spark):
    rows = [(1, 7, "2024-01-01 00:10:00", "click", '{"k": 5}'), (2, 7, "2024-01-01 00:50:00", "view", '{"k": 6}'), (3, 7, "2024-01-01 03:00:00", "click", None), (4, 7, "2024-01-01 04:00:00", "view", '{"k": 8}')]
    frame = spark.createDataFrame(rows, "event_id long, user_id long, ts string, event_type string, props string").selectExpr("*", "1.0 as value").selectExpr("event_id", "user_id", "to_timestamp(ts) as ts", "event_type", "props", "value")
    made = got(events.panel(events.pings(frame), "zone", 6), "slot", "zone")
    assert made == [(0, 6), (1, 6), (2, 6), (3, 6), (4, 8), (5, 8)]
    assert events.panel(events.pings(frame.limit(0))).count() == 0


def test_files_round_trip(spark, tmp_path):
    panel = toy(spark)
    files.write_table(panel, f"{tmp_path}/t", ["agent"])
    assert got(files.read_table(spark, f"{tmp_path}/t"), "agent", "slot", "zone") == got(panel, "agent", "slot", "zone")
    files.write_csv(panel, f"{tmp_path}/c")
    assert got(files.read_csv(spark, f"{tmp_path}/c", panel.schema), "agent", "slot", "zone") == got(panel, "agent", "slot", "zone")
    assert got(files.to_long(files.to_wide(panel, [0, 1, 2, 3])), "agent", "slot", "zone") == got(panel, "agent", "slot", "zone")
    assert files.count_files(spark, f"{tmp_path}/c", "*.csv") >= 1


def test_scan_agents_by_name(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    for s, a in ((0, 1), (0, 12), (3, 1)):
        pq.write_table(pa.table({"latitude": [36.0], "longitude": [-84.0]}), f"{tmp_path}/subpop_{s}_agent_{a}.parquet")
    assert got(files.scan_agents(spark, str(tmp_path)), "subpop", "agent_id") == [(0, 1), (0, 12), (3, 1)]
    assert got(files.scan_agents(spark, str(tmp_path), 3), "subpop", "agent_id") == [(3, 1)]


def test_prefix_keeps_single_destinations_and_zero_occupancy(spark):
    ranked = spark.createDataFrame([(1, 1, 5, 1), (2, 1, 90, 1), (2, 2, 9, 2), (2, 3, 1, 3)], "origin long, dest long, total long, rank long")
    occupied = spark.createDataFrame([(2, 0, 100)], "zone long, slot long, n long")
    assert got(counts.prefix_pairs(ranked, occupied, 0.95), "origin", "dest") == [(1, 1), (2, 1), (2, 2)]


def test_hold_filter(spark):
    rows = [(0, t, 36.0 + d / 111195.08, -84.0) for t, d in enumerate([0, 10, 70, 75, 174])]
    frame = spark.createDataFrame(rows, "agent long, slot long, lat double, lon double")
    made = [round((r["lat_adj"] - 36.0) * 111195.08) for r in sequence.hold_adjusted(frame, ["agent"], ["slot"], 50.0).orderBy("slot").collect()]
    assert made == [0, 0, 70, 70, 174]


def test_injection_goes_on_until_it_passes(spark):
    """Held against all candidates in full; a key that needs more than the first round passes, and its panel is that candidate's."""
    paths = [[1] * 7 + [2, 3] + [4] * 8 + [1] * 7, [5] * 6 + [6] + [7] * 9 + [2] + [5] * 7]
    panel = spark.createDataFrame([(a, 24 * d + s, z) for a in range(6) for d in range(4) for s, z in enumerate(paths[(a + d) % 2])], "agent long, slot long, zone long")
    numbered = panel.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(59))))
    own, options = ["agent", "attempt"], {"min_stay": 3, "max_shift": 6}
    every = inject.injected(numbered, inject.chosen_shifts(numbered, own, 24, 48, 96, seed=1, **options), own, 24).cache()
    share = {(a, t): c for a, t, c in got(detect.changed_share(every, numbered, own, 48, 96), "agent", "attempt", "changed")}
    firsts = {v: {a: next((t for t in range(60) if share[a, t] > v), 59) for a in range(6)} for v in sorted(set(share.values()))}
    threshold, first = next((v, f) for v, f in firsts.items() if any(8 <= t < 59 for t in f.values()))
    made, log = inject.inject_until(panel, ["agent"], 24, 48, 96, threshold, 60, 1, **options)
    assert {r["agent"]: r["attempt"] for r in log.collect()} == first
    assert all(abs(r["changed"] - share[r["agent"], r["attempt"]]) < 1e-12 and r["success"] == (r["changed"] >= threshold) for r in log.collect())
    wanted = [(r["agent"], r["slot"], r["zone"]) for r in every.collect() if r["attempt"] == first[r["agent"]]]
    assert got(made, "agent", "slot", "zone") == sorted(wanted)


def test_decay_has_no_fixed_frame(spark):
    """At 0.99 a run 300 runs ago still weighs 0.05."""
    rng = np.random.default_rng(3)
    y = (rng.random(2500) < 0.5).astype(int).tolist()
    made = sequence.decayed_mean_stay(spark.createDataFrame(list(enumerate(y)), "slot long, y int").selectExpr("0 as k", "*"), ["k"], decay=0.99).orderBy("slot").collect()
    run, weight, total = 0, 0.0, 0.0
    for v, r in zip(y, made, strict=True):
        if v == 0 and run:
            weight, total = 0.99 * weight + 1, 0.99 * total + run
        run = run + 1 if v else 0
        assert (r["mean_stay"] is None) == (weight == 0) and (not weight or abs(r["mean_stay"] - total / weight) < 1e-9)


def test_dwell_runs_follow_the_tolerance(spark):
    rows = [(0, t, 36.0 + d, -84.0) for t, d in enumerate([0, 1e-7, 2e-7, 0.5, 0.5, 0.9])] + [(0, 6, None, None), (0, 7, None, None)]
    made = sequence.dwell_positions(spark.createDataFrame(rows, "k long, slot long, lat double, lon double"), ["k"], ["slot"], least=3).orderBy("slot").collect()
    assert [(r["dwell_len"], r["staying"]) for r in made] == [(3, True)] * 3 + [(2, False)] * 2 + [(1, False)] * 3


def test_passing_ids_and_their_first_form(spark):
    labels = spark.createDataFrame([(1, 0), (2, 3)], "zone long, label long")
    assert got(graph.passing_ids(labels), "zone", "label") == [(1, -2), (2, -5)] and got(graph.passing_ids(labels, compat=True), "zone", "label") == [(1, -1), (2, -4)]


def test_sparse_product_equals_dense(spark):
    rng = np.random.default_rng(7)
    part = [(o, d, t, float(p)) for o in range(6) for t in range(4) if rng.random() < 0.8 for d, p in zip(rng.permutation(6)[:3].tolist(), rng.dirichlet([1] * 3) * rng.choice([0.7, 1.0]), strict=True)]
    partial, zones = spark.createDataFrame(part, "origin long, dest long, slot long, p double"), spark.range(6).withColumnRenamed("id", "zone")
    dense = probability.multistep(probability.full_transition(partial, zones), 2)[2]
    expected = {(r["origin"], r["dest"], r["slot"]): r["p"] for r in dense.collect()}
    asked = spark.createDataFrame([(o, d, t) for o in range(6) for d in range(6) for t in range(3)], "origin long, dest long, slot long")
    made = probability.sparse_two_step(*probability.sparse_cube(partial, 6), asked).collect()
    assert len(made) == 108 and all(abs(r["p"] - expected.get((r["origin"], r["dest"], r["slot"]), 0.0)) < 1e-9 for r in made)


def test_results_are_kept_by_agent(spark, tmp_path):
    from wayfold.plans.detection import result_table

    made = spark.createDataFrame([(a, -float(a), 1, 0.5, 0.5) for a in range(9)], "agent long, log_l double, run_len long, accuracy double, move_accuracy double")
    thresholds = spark.createDataFrame([(a, -4.0, 0.9, 0.1) for a in range(8)], "agent long, tau double, recall double, fpr double")
    table = result_table(made, thresholds)
    files.write_results(table, f"{tmp_path}/r")
    assert got(files.read_results(spark, f"{tmp_path}/r", [3, 5, 8]), "agent", "flagged") == [(3, False), (5, True), (8, False)]
    assert files.read_results(spark, f"{tmp_path}/r").count() == 9
