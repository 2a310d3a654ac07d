"""Common table expressions that the DuckDB forms of the queries share."""

from __future__ import annotations

COARSE = "CAST(list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 AS BIGINT)"
LAT_MIN, LON_MIN, CELL, ROWS, COLS = "CAST(35.51009030444566 AS DOUBLE)", "CAST(-84.95347326088375 AS DOUBLE)", "CAST(0.01 AS DOUBLE)", 108, 125
HAVERSINE = "CAST(2 * 6371008.8 AS DOUBLE) * asin(least(1.0, sqrt(pow(sin(radians({la2} - {la1}) / 2), 2) + cos(radians({la1})) * cos(radians({la2})) * pow(sin(radians({lo2} - {lo1}) / 2), 2))))"


def haversine(la1: str, lo1: str, la2: str, lo2: str) -> str:
    return HAVERSINE.format(la1=la1, lo1=lo1, la2=la2, lo2=lo2)


PINGS = f"""raw AS (SELECT event_id, user_id AS agent, ts, CAST(floor((epoch(ts) - 1704067200) / 3600) AS BIGINT) AS slot, CAST(json_extract_string(props, '$.k') AS BIGINT) AS zone, {COARSE} AS coarse, value FROM events),
pings AS (SELECT *, {LAT_MIN} + (zone // 10 + CAST(0.5 AS DOUBLE)) * {CELL} + ((event_id * 7919) % 1000 / CAST(1000.0 AS DOUBLE) - CAST(0.5 AS DOUBLE)) * CAST(0.0009 AS DOUBLE) AS lat,
  {LON_MIN} + (zone % 10 + CAST(0.5 AS DOUBLE)) * {CELL} + ((event_id * 7919) % 1000 / CAST(1000.0 AS DOUBLE) - CAST(0.5 AS DOUBLE)) * CAST(0.0009 AS DOUBLE) AS lon FROM raw)"""


def base(zone: str = "zone") -> str:
    """Panel, moves, counts, occupancy, ranks and runs of fine (zone) or coarse (coarse) zones."""
    return f"""WITH RECURSIVE {PINGS},
last_ping AS (SELECT agent, slot, z AS zone FROM (SELECT agent, slot, {zone} AS z, row_number() OVER (PARTITION BY agent, slot ORDER BY ts DESC, event_id DESC) AS k FROM pings) WHERE k = 1),
spans AS (SELECT agent, zone, slot, coalesce(lead(slot) OVER (PARTITION BY agent ORDER BY slot), 720) AS until FROM last_ping),
panel AS (SELECT agent, unnest(range(slot, until)) AS slot, zone FROM spans),
moves AS (SELECT agent, slot, origin, dest FROM (SELECT agent, slot, lag(zone) OVER (PARTITION BY agent ORDER BY slot) AS origin, zone AS dest FROM panel) WHERE origin IS NOT NULL),
od AS (SELECT origin, dest, slot, count(*) AS n FROM moves GROUP BY ALL),
occ AS (SELECT zone, slot, count(*) AS n FROM panel GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY total DESC, first_slot, dest) AS rank FROM (SELECT origin, dest, CAST(sum(n) AS BIGINT) AS total, min(slot) AS first_slot FROM od GROUP BY ALL)),
runs AS (SELECT agent, zone, min(slot) AS run_start, max(slot) + 1 AS run_end, count(*) AS len FROM (SELECT *, slot - row_number() OVER (PARTITION BY agent, zone ORDER BY slot) AS g FROM panel) GROUP BY agent, zone, g),
slots AS (SELECT unnest(range(1, 720)) AS slot),
od_dense AS (SELECT r.origin, r.dest, s.slot, r.rank, coalesce(o.n, 0) AS n FROM ranked r CROSS JOIN slots s LEFT JOIN od o ON o.origin = r.origin AND o.dest = r.dest AND o.slot = s.slot),
sizes AS (SELECT d.origin, d.dest, d.slot, d.n, greatest(0, coalesce(c.n, 0) - d.earlier) AS size FROM
  (SELECT *, coalesce(CAST(sum(n) OVER (PARTITION BY origin, slot ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS earlier FROM od_dense) d
  LEFT JOIN occ c ON c.zone = d.origin AND c.slot = d.slot - 1),
mult AS (SELECT a.origin, r.dest, a.slot, r.rank, coalesce(o.n, 0) / CAST(a.total AS DOUBLE) AS p FROM (SELECT origin, slot, sum(n) AS total FROM od GROUP BY ALL) a JOIN ranked r ON r.origin = a.origin LEFT JOIN od o ON o.origin = a.origin AND o.dest = r.dest AND o.slot = a.slot),
casc AS (SELECT origin, dest, slot, rank, greatest(0.0, least(1.0, p / greatest(1 - coalesce(sum(p) OVER (PARTITION BY origin, slot ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 1e-12))) AS v FROM mult),
pairs AS (SELECT agent, origin, dest, row_number() OVER (PARTITION BY agent, origin ORDER BY f) AS rank FROM (SELECT agent, origin, dest, min(slot) AS f FROM moves GROUP BY ALL)),
ind AS (SELECT m.agent, m.origin, p.dest, m.slot, CAST(m.dest = p.dest AS INT) AS y, p.rank FROM moves m JOIN pairs p ON p.agent = m.agent AND p.origin = m.origin),
cind AS (SELECT agent, origin, dest, slot, y, rank FROM (SELECT *, max(CASE WHEN y = 1 THEN rank END) OVER (PARTITION BY agent, origin, slot) AS r FROM ind) WHERE rank <= r),
zone_class AS (SELECT agent, zone, n / CAST(sum(n) OVER (PARTITION BY agent) AS DOUBLE) AS share, longest >= 6 AS staying, row_number() OVER (PARTITION BY agent ORDER BY n DESC, zone) AS rank FROM (SELECT agent, zone, CAST(sum(len) AS BIGINT) AS n, max(len) AS longest FROM runs GROUP BY ALL)),
zgrid AS (SELECT DISTINCT zone, {LAT_MIN} + (zone // 10 + CAST(0.5 AS DOUBLE)) * {CELL} AS lat, {LON_MIN} + (zone % 10 + CAST(0.5 AS DOUBLE)) * {CELL} AS lon FROM raw WHERE zone IS NOT NULL),
edges AS (SELECT a.zone AS src, b.zone AS dst, {haversine("a.lat", "a.lon", "b.lat", "b.lon")} AS dist_m FROM zgrid a CROSS JOIN zgrid b WHERE a.zone <> b.zone),
stay AS (SELECT agent, slot, CAST(origin = dest AS INT) AS y FROM moves)
"""


def kernel(cells: str, keys: list[str], h: int, reach: int, decay: float, names: list[str], same_day: bool = True) -> str:
    """Brute-force kernel sums of each name for every target cell: all pairs of a key's cells, as defined."""
    on = " AND ".join(f"c.{k} = t.{k}" for k in keys)
    sums = ", ".join(f"coalesce(sum(w * x_{n}), 0) AS {n}" for n in names)
    early = "(c.day < t.day OR c.day = t.day AND c.s < t.s)" if same_day else "c.day < t.day"
    distance = "least(abs(c.s - t.s), 24 - abs(c.s - t.s))"
    return f"""kcells AS (SELECT *, slot // 24 AS day, slot % 24 AS s FROM ({cells})),
kpairs AS (SELECT {", ".join(f"t.{k}" for k in keys)}, t.slot, exp(-(t.day - c.day) / CAST({decay} AS DOUBLE)) * exp(-pow({distance} / CAST({h} AS DOUBLE), 2)) AS w, {", ".join(f"c.{n} AS x_{n}" for n in names)}
  FROM kcells t LEFT JOIN kcells c ON {on} AND {early} AND {distance} <= {reach}),
ksums AS (SELECT {", ".join(keys)}, slot, {sums} FROM kpairs GROUP BY ALL)"""
