"""Registered queries of the graph, model, injection and detection operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.functions.geo import centre
from wayfold.operators import counts, detect, dglm, graph, inject, kernel, sequence
from wayfold.plans import detection, sql
from wayfold.plans.mobility import KIND, PER_DAY, QUERIES, SLOTS, SPS, coarse, fine, gate_sql, located, od_series, pings, query, r6
from wayfold.session import kept

B, C = sql.base("zone"), sql.base("coarse")


def zones(spark, sf_dir):
    """(zone, lat, lon): visited fine zones at their cells' centres."""
    own = pings(spark, sf_dir).filter("zone is not null").select("zone").distinct()
    lat, lon = centre(F.floor(F.col("zone") / 10), F.pmod("zone", F.lit(10)))
    return own.select("zone", lat.alias("lat"), lon.alias("lon"))


@query(B + "SELECT src, dst, round(dist_m, 3) AS dist_m FROM edges WHERE dist_m <= 1250")
def radius_edges(spark, sf_dir):
    return graph.radius_edges(zones(spark, sf_dir), 1250.0).select("src", "dst", F.round("dist_m", 3).alias("dist_m"))


@query(B + "SELECT src, dst, round(dist_m, 3) AS dist_m FROM edges UNION ALL SELECT zone, zone, 0.0 FROM zgrid")
def distance_matrix(spark, sf_dir):
    return graph.distance_matrix(zones(spark, sf_dir)).select("src", "dst", F.round("dist_m", 3).alias("dist_m"))


@query(B + ", reach AS (SELECT zone, zone AS r FROM zgrid UNION SELECT reach.zone, e.dst FROM reach JOIN edges e ON e.src = reach.r AND e.dist_m <= 950) SELECT zone, min(r) AS label FROM reach GROUP BY zone")
def components(spark, sf_dir):
    own = zones(spark, sf_dir)
    return graph.components(own, graph.radius_edges(own, 950.0))


@query(B + ", pool AS (SELECT least(origin, dest) AS src, greatest(origin, dest) AS dst, max(p) AS p FROM (SELECT origin, dest, n / CAST(sum(n) OVER (PARTITION BY origin) AS DOUBLE) AS p FROM (SELECT origin, dest, sum(n) AS n FROM od WHERE origin <> dest GROUP BY ALL)) GROUP BY ALL) SELECT e.src, e.dst, round(coalesce(p.p, 0), 6) AS cost FROM edges e LEFT JOIN pool p ON p.src = e.src AND p.dst = e.dst WHERE e.src < e.dst AND e.dist_m <= 1250")
def adj_cost(spark, sf_dir):
    pooled = counts.pooled_probability(counts.od_counts(fine(spark, sf_dir)), None, False)
    return graph.adjacency_costs(graph.radius_edges(zones(spark, sf_dir), 1250.0), pooled).select("src", "dst", *r6("cost"))


@query(B + "SELECT DISTINCT zone FROM panel WHERE zone NOT IN (SELECT zone FROM zone_class WHERE staying AND rank <= 2)")
def passing_zones(spark, sf_dir):
    panel = fine(spark, sf_dir)
    staying = sequence.classify_zones(panel, ["agent"]).filter("staying and rank <= 2")
    return graph.passing_zones(panel, staying)


@query(B + "SELECT zone, -(zone // 10 + 2) AS label FROM zgrid")
def passing_ids(spark, sf_dir):
    return graph.passing_ids(zones(spark, sf_dir).select("zone", F.floor(F.col("zone") / 10).cast("long").alias("label")))


@query(B + ", deg AS (SELECT z.zone, count(e.dst) + 1 AS d FROM zgrid z LEFT JOIN edges e ON e.src = z.zone AND e.dist_m <= 1250 GROUP BY z.zone), core AS (SELECT zone FROM deg WHERE d >= 5), reach AS (SELECT zone, zone AS r FROM core UNION SELECT reach.zone, e.dst FROM reach JOIN edges e ON e.src = reach.r AND e.dist_m <= 1250 JOIN core c ON c.zone = e.dst), lab AS (SELECT zone, min(r) AS label FROM reach GROUP BY zone), bord AS (SELECT e.src AS zone, min(l.label) AS b FROM edges e JOIN lab l ON l.zone = e.dst WHERE e.dist_m <= 1250 GROUP BY e.src) SELECT z.zone, coalesce(l.label, b.b, -1) AS label, l.label IS NOT NULL AS core FROM zgrid z LEFT JOIN lab l ON l.zone = z.zone LEFT JOIN bord b ON b.zone = z.zone")
def dbscan(spark, sf_dir):
    return graph.dbscan(zones(spark, sf_dir), 1250.0, 5)


def _capped(spark, sf_dir, most: int = 15):
    own = zones(spark, sf_dir)
    edges = graph.radius_edges(own, 1250.0)
    return own.join(graph.capped_components(graph.components(own, edges), edges, most), "zone")


@query()
def capped_clusters(spark, sf_dir):
    return _capped(spark, sf_dir).select("zone", "label")


@query()
def merge_small(spark, sf_dir):
    return graph.merge_small(_capped(spark, sf_dir, 6), 4)


@query()
def two_stage_merge(spark, sf_dir):
    return graph.two_stage_merge(_capped(spark, sf_dir, 6), 15, 4)


@query()
def skater(spark, sf_dir):
    own = zones(spark, sf_dir)
    pooled = counts.pooled_probability(counts.od_counts(fine(spark, sf_dir)), None, False)
    costs = graph.adjacency_costs(graph.radius_edges(own, 1250.0), pooled, keep=True)
    return graph.skater(own, costs, 12, 15)


@query()
def hier_avg(spark, sf_dir):
    made = graph.position_clusters(located(spark, sf_dir).select("event_id", "agent", "lat", "lon"), ["agent"], 60.0)
    return graph.centred(made, ["agent"]).select("event_id", "agent", "cluster_id", "lat_adj", "lon_adj")


@query()
def flow_clusters(spark, sf_dir):
    flows = counts.od_counts(fine(spark, sf_dir)).groupBy("origin", "dest").agg(F.sum("n").alias("n"))
    return graph.flow_clusters(flows, graph.distance_matrix(zones(spark, sf_dir)), 5000.0, 10)


# models


def _group_rows(spark, sf_dir):
    """Rows of the group model with the four features: kernel logit, occupancy change, day and weekday."""
    panel = kept(coarse(spark, sf_dir))
    series = od_series(panel).join(counts.od_ranked(counts.od_counts(panel)).select("origin", "dest", "rank"), ["origin", "dest"])
    smooth = kernel.binomial_forecast(series, ["origin", "dest"], PER_DAY, 120, 240)
    own = kept(series.join(smooth, ["origin", "dest", "slot"], "left").withColumn("value", F.coalesce("value", F.lit(0.5))))
    return detection.with_features(own, panel, detection.Setup(), 0).select("origin", "dest", "slot", "y", "n", *detection.GROUP_FEATURES)


def _shown(made):
    return made.select("origin", "dest", "slot", "p_hat", "y", "n", F.element_at("m", 1).alias("level"), F.element_at("v", 1).alias("level_var"))


@query()
def group_dglm(spark, sf_dir):
    return _shown(dglm.group_models(_group_rows(spark, sf_dir), ["origin", "dest"], detection.GROUP_FEATURES, PER_DAY))


@query()
def group_dglm_states(spark, sf_dir):
    made = dglm.group_models(_group_rows(spark, sf_dir), ["origin", "dest"], detection.GROUP_FEATURES, PER_DAY)
    return dglm.last_states(made, ["origin", "dest"])


@query()
def group_dglm_resume(spark, sf_dir):
    """The last week's rows, filtered from the states that a run up to there left."""
    rows, keys = _group_rows(spark, sf_dir), ["origin", "dest"]
    split = SLOTS - 7 * PER_DAY
    states = dglm.last_states(dglm.group_models(rows.filter(F.col("slot") < split), keys, detection.GROUP_FEATURES, PER_DAY), keys)
    return _shown(dglm.group_models(rows.filter(F.col("slot") >= split), keys, detection.GROUP_FEATURES, PER_DAY, states=states))


def _prepared(spark, sf_dir):
    panel = kept(coarse(spark, sf_dir))
    cube = detection.forecast_cube(panel)
    return panel, cube, *detection.model_rows(panel, cube)


@query()
def agent_dglm(spark, sf_dir):
    rows = _prepared(spark, sf_dir)[2].withColumn("update", F.col("slot") <= detection.Setup().end_of_training)
    return dglm.agent_models(rows, ["agent", "kind"], detection.FEATURES, upweight=1, bare=True).select("agent", "kind", "od", "slot", "p_hat", "y")


@query()
def agent_dglm_resume(spark, sf_dir):
    """The rows after training, filtered from the states that training left; rare answers count as whole trials."""
    rows, keys, end = _prepared(spark, sf_dir)[2].withColumn("update", F.lit(True)), ["agent", "kind"], detection.Setup().end_of_training
    states = dglm.last_states(dglm.agent_models(rows.filter(F.col("slot") <= end), keys, detection.FEATURES, upweight=1, ends=True), keys)
    made = dglm.agent_models(rows.filter(F.col("slot") > end), keys, detection.FEATURES, 1, True, states=states, bare=True)
    return made.select("agent", "kind", "od", "slot", "p_hat", "y")


@query()
def oam_pm(spark, sf_dir):
    return detection.forecasts(_prepared(spark, sf_dir)[2]).select("agent", "kind", "origin", "dest", "slot", "y", "p_pm", "p_oam", "t")


@query()
def oam_pm_summary(spark, sf_dir):
    made = detection.forecasts(_prepared(spark, sf_dir)[2], bare=True).withColumn("p_hat", F.col("p_oam"))
    return detect.binary_summary(made, ["agent", "kind"])


END = detection.Setup().end_of_training
LOGIT = "round(greatest(-10.0, least(10.0, ln(greatest(1e-9, least(1 - 1e-9, {x})) / (1 - greatest(1e-9, least(1 - 1e-9, {x})))))), 6)"
OWN = f""", truns AS (SELECT agent, zone, count(*) AS len FROM (SELECT *, slot - row_number() OVER (PARTITION BY agent, zone ORDER BY slot) AS g FROM panel WHERE slot <= {END}) GROUP BY agent, zone, g),
tclass AS (SELECT agent, zone, max(len) >= 6 AS staying FROM truns GROUP BY ALL),
taken AS (SELECT agent, origin, dest FROM cind GROUP BY ALL HAVING coalesce(sum(CASE WHEN slot < {END} THEN y END), 0) > 5),
own AS (SELECT c.agent, c.origin, c.dest, {KIND.replace('v.', 'c.')}, c.slot, c.y FROM cind c JOIN taken t ON t.agent = c.agent AND t.origin = c.origin AND t.dest = c.dest JOIN tclass z ON z.agent = c.agent AND z.zone = c.origin),
selfs AS (SELECT agent, origin, dest, slot, y FROM own WHERE kind = 'staying_to_self'), """
OTHERS = """, oc AS (SELECT *, slot // 24 AS day, slot % 24 AS s FROM own WHERE kind <> 'staying_to_self'), od1 AS (SELECT agent, origin, dest, day, t.s, max(y) AS one FROM oc a JOIN (SELECT unnest(range(0, 24)) AS s) t ON least(abs(a.s - t.s), 24 - abs(a.s - t.s)) <= 1 GROUP BY ALL),
kp AS (SELECT agent, origin, dest, slot, (0.5 + y) / (1 + n) AS value FROM ksums UNION ALL SELECT a.agent, a.origin, a.dest, a.slot, (0.5 + coalesce(sum(d.one), 0)) / (1 + count(d.one)) FROM oc a LEFT JOIN od1 d ON d.agent = a.agent AND d.origin = a.origin AND d.dest = a.dest AND d.s = a.s AND d.day < a.day GROUP BY a.agent, a.origin, a.dest, a.slot)"""
FROZEN = f""", lg AS (SELECT agent, origin, dest, slot, lag(gate) OVER (PARTITION BY agent, origin, dest ORDER BY slot) AS gate FROM gate1),
ft AS (SELECT o.agent, o.kind, o.origin, o.dest, o.slot, coalesce(k.value, 0.5) AS k, CAST(coalesce(g.gate, 0) AS DOUBLE) AS gate FROM own o LEFT JOIN kp k ON k.agent = o.agent AND k.origin = o.origin AND k.dest = o.dest AND k.slot = o.slot LEFT JOIN lg g ON g.agent = o.agent AND g.origin = o.origin AND g.dest = o.dest AND g.slot = o.slot),
fz AS (SELECT f.*, CASE WHEN f.slot > {END} THEN coalesce(l.k, 0.5) ELSE f.k END AS pk, CASE WHEN f.slot > {END} THEN coalesce(l.gate, 0.0) ELSE f.gate END AS pg FROM ft f LEFT JOIN ft l ON l.slot > {END} - 24 AND l.slot <= {END} AND l.agent = f.agent AND l.origin = f.origin AND l.dest = f.dest AND l.slot % 24 = f.slot % 24)
SELECT agent, kind, origin, dest, slot, {LOGIT.format(x='k')} AS kernel_prob, {LOGIT.format(x='pk')} AS pm_kernel_prob, CAST(gate AS DOUBLE) AS gate, CAST(pg AS DOUBLE) AS pm_gate FROM fz"""


@query(C + OWN + sql.kernel("SELECT agent, origin, dest, slot, y, 1 AS n FROM selfs", ["agent", "origin", "dest"], 1, 2, 14.0, ["y", "n"], False) + OTHERS + gate_sql(1, "=", 1, -1.0, 18.0, "selfs") + FROZEN)
def empirical_prob(spark, sf_dir):
    rows = detection.with_empirical(detection.asked_rows(coarse(spark, sf_dir)))
    made = kept(detection.numbered_rows(rows, ["kernel_prob", "gate"]), dealt=True)
    return made.select("agent", "kind", "origin", "dest", "slot", *r6("kernel_prob", "pm_kernel_prob"), "gate", "pm_gate")


# injection and detection


def _draw(seed: int, *columns: str) -> str:
    return f"(CAST('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(columns)})), 1, 10) AS BIGINT) / CAST(1099511627776 AS DOUBLE))"


SHIFTS = f""", tr AS (SELECT a.agent, a.day, a.s AS s1, a.e, b.s AS s2, b.e AS e2, a.zone AS z1, b.zone AS z2, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY a.agent, a.day) AS n FROM st a JOIN st b ON a.agent = b.agent AND a.day = b.day AND b.s = (SELECT min(c.s) FROM st c WHERE c.agent = a.agent AND c.day = a.day AND c.s > a.e) WINDOW w AS (PARTITION BY a.agent, a.day ORDER BY a.s)),
ch AS (SELECT *, {_draw(1, 'agent', 'day', "'2'")} < CAST(0.5 AS DOUBLE) AS early FROM tr WHERE day >= 22 AND k = floor({_draw(1, 'agent', 'day', "'1'")} * n)),
mo AS (SELECT *, least(6, CASE WHEN early THEN e - s1 ELSE e2 - s2 END) AS most FROM ch),
lo AS (SELECT *, CASE WHEN early THEN 1 ELSE floor(most * CAST(0.7 AS DOUBLE)) END AS low FROM mo),
one AS (SELECT *, CAST(low + floor({_draw(1, 'agent', 'day', "'3'")} * (most - low + 1)) AS BIGINT) AS d FROM lo)"""


@query(C + SPS + SHIFTS + " SELECT p.agent, p.slot, CASE WHEN o.early AND p.slot + d >= e AND p.slot + d < s2 THEN n.zone WHEN NOT o.early AND p.slot - d >= e AND p.slot - d < s2 THEN m.zone WHEN o.early AND p.slot >= s2 - d AND p.slot < s2 THEN z2 WHEN NOT o.early AND p.slot >= e AND p.slot < e + d THEN z1 ELSE p.zone END AS zone FROM panel p LEFT JOIN (SELECT * FROM one WHERE d > 0) o ON o.agent = p.agent AND o.day = p.slot // 24 LEFT JOIN panel n ON n.agent = p.agent AND n.slot = p.slot + d LEFT JOIN panel m ON m.agent = p.agent AND m.slot = p.slot - d")
def inject_sps(spark, sf_dir):
    panel = coarse(spark, sf_dir)
    shifts = inject.chosen_shifts(panel, ["agent"], PER_DAY, 22 * 24, SLOTS, 3, 6, seed=1)
    return inject.injected(panel, shifts, ["agent"], PER_DAY)


@query()
def inject_anomaly(spark, sf_dir):
    return inject.inject_until(coarse(spark, sf_dir), ["agent"], PER_DAY, 22 * 24, SLOTS, seed=1, min_stay=3, max_shift=6)[1]


SWAPS = f", drawn AS (SELECT agent, e, row_number() OVER (PARTITION BY agent ORDER BY {_draw(2, 'agent', 'e')}, e) AS k FROM (SELECT DISTINCT agent FROM panel), (SELECT unnest(range(0, 23)) AS e)), swaps AS (SELECT agent, 22 + k AS day, e AS from_day FROM drawn WHERE k <= 7 UNION ALL SELECT agent, e, 22 + k FROM drawn WHERE k <= 7)"


@query(C + SWAPS + " SELECT p.agent, coalesce(s.day * 24 + p.slot % 24, p.slot) AS slot, p.zone FROM panel p LEFT JOIN swaps s ON s.agent = p.agent AND s.from_day = p.slot // 24")
def swap_days(spark, sf_dir):
    panel = coarse(spark, sf_dir)
    return inject.swapped(panel, inject.day_swaps(panel, ["agent"], PER_DAY, 23 * 24, SLOTS, 2), ["agent"], PER_DAY)


@query()
def detect_agents(spark, sf_dir):
    panel = kept(coarse(spark, sf_dir))
    return detection.verdicts(panel, detection.forecast_cube(panel))


@query()
def calibrate(spark, sf_dir):
    panel = kept(coarse(spark, sf_dir))
    thresholds = detection.calibrated(panel, detection.forecast_cube(panel), repetitions=50, min_stay=3, max_shift=6)[1]
    return panel.select("agent").distinct().join(thresholds, "agent", "left")


__all__ = ["QUERIES"]
