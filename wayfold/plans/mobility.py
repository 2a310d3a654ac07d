"""Registered queries of the mobility operators: counts, sequences, kernels, probabilities and detection.

Each entry has the Spark plan and, where SQL can express it, the DuckDB form. Doubles are
rounded to six places on both sides, as sums may run in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions import geo, numeric
from wayfold.operators import counts, detect, kernel, probability, sequence
from wayfold.plans import sql
from wayfold.sources import events

PER_DAY, SLOTS, TRAIN_END = 24, events.SLOTS, 21 * 24
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pings(spark, sf_dir) -> DataFrame:
    return events.pings(read(spark, sf_dir))


def fine(spark, sf_dir) -> DataFrame:
    return events.panel(pings(spark, sf_dir), "zone")


def coarse(spark, sf_dir) -> DataFrame:
    return events.panel(pings(spark, sf_dir), "coarse")


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


B, C = sql.base("zone"), sql.base("coarse")


# counts


@query(B + "SELECT agent, slot, zone FROM panel")
def panel_locf(spark, sf_dir):
    return fine(spark, sf_dir)


@query(B + "SELECT * FROM od")
def od_counts(spark, sf_dir):
    return counts.od_counts(fine(spark, sf_dir))


@query(B + "SELECT origin, dest, slot, count(*) AS n FROM (SELECT slot, lag(zone, 2) OVER (PARTITION BY agent ORDER BY slot) AS origin, zone AS dest FROM panel) WHERE origin IS NOT NULL AND origin <> dest GROUP BY ALL")
def od_counts_lag2_noself(spark, sf_dir):
    return counts.od_counts(fine(spark, sf_dir), 2, False)


@query(B + "SELECT * FROM ranked")
def od_ranked(spark, sf_dir):
    return counts.od_ranked(counts.od_counts(fine(spark, sf_dir)))


@query(B + "SELECT * FROM occ")
def occupancy(spark, sf_dir):
    return counts.occupancy(fine(spark, sf_dir))


@query(B + "SELECT z.zone, s.slot, coalesce(o.n, 0) AS n FROM (SELECT DISTINCT zone FROM occ) z CROSS JOIN (SELECT unnest(range(0, 720)) AS slot) s LEFT JOIN occ o ON o.zone = z.zone AND o.slot = s.slot")
def occupancy_dense(spark, sf_dir):
    return counts.dense(counts.occupancy(fine(spark, sf_dir)), ["zone"], 0, SLOTS - 1)


def sizes(panel: DataFrame) -> DataFrame:
    od = counts.od_counts(panel)
    return counts.cascade_sizes(od, counts.od_ranked(od), counts.occupancy(panel), 1, SLOTS - 1)


@query(C + "SELECT origin, dest, slot, CAST(size AS BIGINT) AS size FROM sizes")
def cascade_sizes(spark, sf_dir):
    return sizes(coarse(spark, sf_dir))


@query(B + ", f AS (SELECT r.*, sum(total) OVER w / CAST(greatest(coalesce(o.occ, 0), 1) AS DOUBLE) AS cum_frac, (sum(total) OVER w - total) / CAST(greatest(coalesce(o.occ, 0), 1) AS DOUBLE) AS before, count(*) OVER (PARTITION BY origin) AS k FROM ranked r LEFT JOIN (SELECT zone, sum(n) AS occ FROM occ GROUP BY ALL) o ON o.zone = r.origin WINDOW w AS (PARTITION BY origin ORDER BY rank)) SELECT origin, dest, rank, round(cum_frac, 6) AS cum_frac FROM f WHERE k < 2 OR before < 0.9")
def prefix_pairs(spark, sf_dir):
    panel = fine(spark, sf_dir)
    return counts.prefix_pairs(counts.od_ranked(counts.od_counts(panel)), counts.occupancy(panel), 0.9).withColumns({"cum_frac": F.round("cum_frac", 6)})


@query(B + "SELECT o.origin, o.slot, o.n - coalesce(c.n, 0) AS diff FROM (SELECT origin, slot, CAST(sum(n) AS BIGINT) AS n FROM od GROUP BY ALL) o LEFT JOIN occ c ON c.zone = o.origin AND c.slot = o.slot - 1")
def conservation(spark, sf_dir):
    panel = fine(spark, sf_dir)
    return counts.conservation(counts.od_counts(panel), counts.occupancy(panel))


POOLED = ", t AS (SELECT origin, dest, sum(n) AS n FROM od {where} GROUP BY ALL) SELECT origin, dest, round(n / CAST(sum(n) OVER (PARTITION BY origin) AS DOUBLE), 6) AS p FROM t"


@query(B + POOLED.format(where=""))
def pooled_prob(spark, sf_dir):
    return counts.pooled_probability(counts.od_counts(fine(spark, sf_dir))).select("origin", "dest", *r6("p"))


@query(B + POOLED.format(where="WHERE origin <> dest AND origin <> 0 AND dest <> 0"))
def pooled_prob_noself(spark, sf_dir):
    return counts.pooled_probability(counts.od_counts(fine(spark, sf_dir)), 0, False).select("origin", "dest", *r6("p"))


@query(B + "SELECT origin, dest, CAST(sum(n) AS BIGINT) AS n FROM od GROUP BY ALL")
def od_pooled(spark, sf_dir):
    return counts.od_counts(fine(spark, sf_dir)).groupBy("origin", "dest").agg(F.sum("n").alias("n"))


@query(B + ", s AS (SELECT o.origin, o.dest, sum(o.n / coalesce(CAST(c.n AS DOUBLE), 0.1)) / 719 AS mean_p FROM od o LEFT JOIN occ c ON c.zone = o.origin AND c.slot = o.slot - 1 GROUP BY ALL) SELECT origin, dest, round(mean_p, 6) AS mean_p, row_number() OVER (PARTITION BY origin ORDER BY round(mean_p, 9) DESC, dest) AS rank FROM s")
def dest_by_mean_prob(spark, sf_dir):
    panel = fine(spark, sf_dir)
    return counts.by_mean_probability(counts.od_counts(panel), counts.occupancy(panel), SLOTS - 1).select("origin", "dest", *r6("mean_p"), "rank")


@query(B + ", s AS (SELECT zone // 10 AS cluster_id, zone, sum(n) AS n FROM occ GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY cluster_id) AS a, sum(n) OVER (PARTITION BY cluster_id ORDER BY n DESC, zone ROWS UNBOUNDED PRECEDING) AS u FROM s) SELECT cluster_id, zone, round(n / CAST(a AS DOUBLE), 6) AS share, round(u / CAST(a AS DOUBLE), 6) AS cum FROM c WHERE (u - n) / CAST(a AS DOUBLE) <= 0.9")
def subzone_prefix(spark, sf_dir):
    occupied = counts.occupancy(fine(spark, sf_dir))
    clusters = occupied.select("zone").distinct().withColumn("cluster_id", F.floor(F.col("zone") / 10).cast("long"))
    return counts.share_prefix(occupied, clusters, 0.9).select("cluster_id", "zone", *r6("share", "cum"))


@query(B + ", t AS (SELECT agent, origin, dest, count(*) AS total FROM moves WHERE origin <> dest GROUP BY ALL), r AS (SELECT *, sum(total) OVER (PARTITION BY agent, origin) AS a, sum(total) OVER w - total AS b, row_number() OVER w AS rank FROM t WINDOW w AS (PARTITION BY agent, origin ORDER BY total DESC, dest ROWS UNBOUNDED PRECEDING)) SELECT agent, origin, dest, total, rank FROM r WHERE a >= 2 AND b < 0.95 * a")
def individual_prefix(spark, sf_dir):
    return counts.agent_prefix_pairs(counts.transitions(fine(spark, sf_dir)))


# indicators


@query(C + "SELECT agent, origin, dest, slot, y FROM ind")
def indicator(spark, sf_dir):
    return counts.indicator(counts.transitions(coarse(spark, sf_dir))).select("agent", "origin", "dest", "slot", "y")


def cascade_cells(panel: DataFrame) -> DataFrame:
    return counts.onehot_to_cascade(counts.indicator(counts.transitions(panel)))


@query(C + "SELECT agent, origin, dest, slot, y FROM cind")
def onehot_cascade(spark, sf_dir):
    return cascade_cells(coarse(spark, sf_dir)).select("agent", "origin", "dest", "slot", "y")


VALID = f", v AS (SELECT agent, origin, dest, CAST(coalesce(sum(CASE WHEN slot < {TRAIN_END} THEN y END), 0) AS BIGINT) AS n FROM cind GROUP BY ALL), valid AS (SELECT *, n > 5 AS valid FROM v)"


@query(C + VALID + " SELECT * FROM valid")
def rare_valid(spark, sf_dir):
    return counts.valid_pairs(cascade_cells(coarse(spark, sf_dir)), TRAIN_END, 5)


KIND = "CASE WHEN NOT z.staying THEN 'passing_to_any' WHEN v.origin = v.dest THEN 'staying_to_self' ELSE 'staying_to_other' END AS kind"


@query(C + VALID + f" SELECT v.agent, v.origin, v.dest, n, valid, {KIND} FROM valid v JOIN zone_class z ON z.agent = v.agent AND z.zone = v.origin")
def od_by_type(spark, sf_dir):
    panel = coarse(spark, sf_dir)
    pairs = counts.valid_pairs(cascade_cells(panel), TRAIN_END, 5)
    return counts.by_zone_type(pairs, sequence.classify_zones(panel, ["agent"])).select("agent", "origin", "dest", "n", "valid", "kind")


@query(C + f"SELECT agent, origin, dest, slot + k * 24 AS slot, y FROM cind, (SELECT unnest(range(1, 8)) AS k) WHERE slot >= {TRAIN_END - 24} AND slot < {TRAIN_END}")
def freeze_last_day(spark, sf_dir):
    return counts.frozen(cascade_cells(coarse(spark, sf_dir)), PER_DAY, 7, TRAIN_END).select("agent", "origin", "dest", "slot", "y")


XY = ", f AS (SELECT agent, origin * 5 + dest AS od, slot, y, (origin + 1) / CAST(dest + origin + 2 AS DOUBLE) AS x FROM cind), l AS (SELECT agent, od, slot, y, greatest(-10.0, least(10.0, ln(x / (1 - x)))) AS x FROM f), c AS (SELECT *, coalesce(lag(y) OVER w <> y, true) AS ch FROM l WINDOW w AS (PARTITION BY agent, od ORDER BY slot)), g AS (SELECT *, sum(CAST(ch AS INT)) OVER (PARTITION BY agent, od ORDER BY slot) AS run FROM c), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY agent, od, run ORDER BY slot) AS pos FROM g) WHERE pos <= 2), m AS (SELECT *, avg(CAST(y AS DOUBLE)) OVER (PARTITION BY agent ORDER BY slot, od ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mean FROM k) SELECT agent, od, slot, y, round(x, 6) AS x, round(CASE WHEN mean > 0 THEN (1 - mean) / mean END, 6) AS weight FROM m"


@query(C + XY)
def xy_summary(spark, sf_dir):
    cells = cascade_cells(coarse(spark, sf_dir)).withColumn("od", F.col("origin") * 5 + F.col("dest")).withColumn("x", (F.col("origin") + 1) / (F.col("dest") + F.col("origin") + 2))
    return counts.xy_rows(cells, ["agent"], ["x"], ["x"], 2).select("agent", "od", "slot", "y", *r6("x", "weight"))


@query(B + ", k AS (SELECT agent, slot, zone FROM last_ping), g AS (SELECT agent, slot, slot - row_number() OVER (PARTITION BY agent ORDER BY slot) AS g FROM k) SELECT agent, min(slot) AS start, max(slot) + 1 AS stop FROM g GROUP BY agent, g")
def interval_merge(spark, sf_dir):
    return sequence.merged_intervals(pings(spark, sf_dir).filter("zone is not null"), ["agent"])


@query(C + f"SELECT agent, max(CASE WHEN slot = 100 THEN zone END) AS s100, max(CASE WHEN slot = 400 THEN zone END) AS s400, max(CASE WHEN slot = 719 THEN zone END) AS s719 FROM panel GROUP BY agent")
def panel_pivot(spark, sf_dir):
    from wayfold.sources.files import to_wide

    wide = to_wide(coarse(spark, sf_dir), [100, 400, 719])
    return wide.select("agent", *[F.col(f"`{s}`").alias(f"s{s}") for s in (100, 400, 719)])


@query(B + "SELECT agent, zone, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY agent) AS DOUBLE), 6) AS share FROM panel GROUP BY agent, zone")
def zone_value_counts(spark, sf_dir):
    from pyspark.sql import Window

    own = fine(spark, sf_dir).groupBy("agent", "zone").agg(F.count(F.lit(1)).alias("n"))
    return own.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("agent")), 6))


@query(B + "SELECT agent, event_id, slot, zone FROM (SELECT agent, event_id, slot, zone, row_number() OVER (PARTITION BY agent ORDER BY md5(concat_ws('|', '42', event_id)), event_id) AS k FROM pings) WHERE k <= 20")
def stratified_sample(spark, sf_dir):
    from wayfold.sources.files import stratified_sample as sample

    return sample(pings(spark, sf_dir).select("agent", "event_id", "slot", "zone"), ["agent"], ["event_id"], 20, 42)


# geometry


@query(B + f"SELECT event_id, CAST(greatest(0, least({sql.ROWS - 1}, floor((lat - {sql.LAT_MIN}) / {sql.CELL}))) * {sql.COLS} + greatest(0, least({sql.COLS - 1}, floor((lon - {sql.LON_MIN}) / {sql.CELL}))) AS BIGINT) AS zone FROM pings WHERE zone IS NOT NULL")
def grid_index(spark, sf_dir):
    return pings(spark, sf_dir).filter("zone is not null").select("event_id", geo.zone_index(F.col("lat"), F.col("lon")).alias("zone"))


@query(f"WITH z AS (SELECT unnest(range(0, {sql.ROWS * sql.COLS})) AS zone) SELECT zone, zone // {sql.COLS} AS zrow, zone % {sql.COLS} AS zcol, round({sql.LAT_MIN} + (zone // {sql.COLS} + 0.5) * {sql.CELL}, 7) AS lat, round({sql.LON_MIN} + (zone % {sql.COLS} + 0.5) * {sql.CELL}, 7) AS lon FROM z")
def grid_center(spark, sf_dir):
    grid = geo.Grid()
    zones = spark.range(grid.rows * grid.cols).select(F.col("id").alias("zone")).select("zone", geo.zone_row(F.col("zone")).alias("zrow"), geo.zone_col(F.col("zone")).alias("zcol"))
    lat, lon = geo.centre(F.col("zrow"), F.col("zcol"))
    return zones.select("zone", "zrow", "zcol", F.round(lat, 7).alias("lat"), F.round(lon, 7).alias("lon"))


STEPS = f", st AS (SELECT *, coalesce({sql.haversine('la', 'lo', 'lat', 'lon')}, 0.0) AS step_m FROM (SELECT *, lag(lat) OVER w AS la, lag(lon) OVER w AS lo, row_number() OVER w AS k FROM pings WHERE zone IS NOT NULL WINDOW w AS (PARTITION BY agent ORDER BY ts, event_id)))"


def located(spark, sf_dir) -> DataFrame:
    return pings(spark, sf_dir).filter("zone is not null")


@query(B + STEPS + " SELECT event_id, round(step_m, 3) AS step_m FROM st")
def step_haversine(spark, sf_dir):
    return sequence.step_lengths(located(spark, sf_dir), ["agent"], ["ts", "event_id"]).select("event_id", F.round("step_m", 3).alias("step_m"))


@query(B + STEPS + " SELECT event_id, round(last_value(CASE WHEN step_m > 2000 OR k = 1 THEN lat END IGNORE NULLS) OVER w, 7) AS lat_adj, round(last_value(CASE WHEN step_m > 2000 OR k = 1 THEN lon END IGNORE NULLS) OVER w, 7) AS lon_adj FROM st WINDOW w AS (PARTITION BY agent ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def hold_adjust(spark, sf_dir):
    own = sequence.hold_adjusted(located(spark, sf_dir), ["agent"], ["ts", "event_id"], 2000.0)
    return own.select("event_id", F.round("lat_adj", 7).alias("lat_adj"), F.round("lon_adj", 7).alias("lon_adj"))


@query("SELECT event_id, CAST(date_diff('day', (SELECT min(ts) FROM events), ts) AS INT) AS day_idx, CAST(hour(ts) // 6 AS INT) AS block FROM events")
def day_block(spark, sf_dir):
    rows = read(spark, sf_dir).select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    first = rows.agg(F.min("ts").alias("first"))
    return rows.join(F.broadcast(first)).select("event_id", F.datediff("ts", "first").alias("day_idx"), F.floor(F.hour("ts") / 6).cast("int").alias("block"))


@query("WITH t AS (SELECT slot, to_timestamp(1704067200 + slot * 3600) AT TIME ZONE 'UTC' AS ts FROM (SELECT unnest(range(0, 720)) AS slot)) SELECT slot, CAST(hour(ts) >= 11 OR hour(ts) < 0 AS INT) AS is_day, CAST(NOT (hour(ts) >= 11 OR hour(ts) < 0) AS INT) AS is_night, CAST(isodow(ts) <= 5 AS INT) AS is_weekday, CAST(isodow(ts) > 5 AS INT) AS is_weekend FROM t")
def time_indicators(spark, sf_dir):
    from wayfold.functions.calendar import time_indicators as flags

    slots = spark.range(SLOTS).select(F.col("id").alias("slot"))
    ts = F.timestamp_seconds(F.lit(events.ORIGIN_S) + F.col("slot") * events.SLOT_S)
    return slots.select("slot", *[c.alias(n) for n, c in flags(ts, 11 * 60, 0).items()])


MAPPED = ", staying AS (SELECT DISTINCT zone FROM zone_class WHERE staying), zmap AS (SELECT zone, 1000 + zone // 7 AS cluster_id FROM staying)"


@query(B + MAPPED + " SELECT p.agent, p.slot, CASE WHEN s.zone IS NULL THEN -1 ELSE coalesce(m.cluster_id, p.zone) END AS cluster FROM panel p LEFT JOIN staying s ON s.zone = p.zone LEFT JOIN zmap m ON m.zone = p.zone")
def zone_recode(spark, sf_dir):
    panel = fine(spark, sf_dir)
    staying = sequence.classify_zones(panel, ["agent"]).filter("staying").select("zone").distinct()
    mapping = staying.withColumn("cluster_id", (F.floor(F.col("zone") / 7) + 1000).cast("long"))
    return counts.recoded(panel, mapping, staying)


# sequences


@query(B + "SELECT * FROM runs")
def stay_runs(spark, sf_dir):
    return sequence.runs(fine(spark, sf_dir), ["agent"])


@query(B + "SELECT agent, zone, string_agg(CAST(len AS VARCHAR), ',' ORDER BY run_start) AS lens FROM runs GROUP BY ALL")
def stay_lengths(spark, sf_dir):
    own = sequence.stay_lengths(fine(spark, sf_dir), ["agent"])
    return own.select("agent", "zone", F.array_join(F.transform("lens", lambda x: x.cast("string")), ",").alias("lens"))


SPLIT = ", split AS (SELECT agent, zone, avg(len) AS mean_len, avg(len) > 1 AND count(*) FILTER (len > 1) >= 2 AS staying, avg(len) > 1 AS staying_eda FROM runs GROUP BY ALL)"


@query(B + SPLIT + " SELECT agent, zone, round(mean_len, 6) AS mean_len, staying, staying_eda FROM split")
def staying_split(spark, sf_dir):
    table = sequence.runs(fine(spark, sf_dir), ["agent"])
    loose = sequence.staying_split(table, ["agent"], False).select("agent", "zone", F.col("staying").alias("staying_eda"))
    return sequence.staying_split(table, ["agent"]).join(loose, ["agent", "zone"]).select("agent", "zone", *r6("mean_len"), "staying", "staying_eda")


BUCKET = "CASE WHEN {x} >= 96 THEN 'a_8h' WHEN {x} >= 48 THEN 'b_4h' WHEN {x} >= 24 THEN 'c_2h' ELSE 'd_0h' END"


@query(B + SPLIT + f", z AS (SELECT agent, {BUCKET.format(x='mean_len')} AS bucket, count(*) AS n FROM split WHERE staying GROUP BY ALL), a AS (SELECT DISTINCT agent, unnest(['a_8h', 'b_4h', 'c_2h', 'd_0h']) AS bucket FROM split) SELECT a.bucket, coalesce(n, 0) AS n_zones, count(*) AS n_agents FROM a LEFT JOIN z ON z.agent = a.agent AND z.bucket = a.bucket GROUP BY ALL")
def stay_buckets(spark, sf_dir):
    return sequence.bucket_histogram(sequence.staying_split(sequence.runs(fine(spark, sf_dir), ["agent"]), ["agent"]), ["agent"])


@query(B + SPLIT + f", z AS (SELECT DISTINCT zone, {BUCKET.format(x='floor(mean_len)')} AS b FROM split WHERE staying) SELECT x.b AS b1, y.b AS b2, count(*) AS n FROM z x JOIN z y ON x.zone = y.zone GROUP BY ALL")
def bucket_contingency(spark, sf_dir):
    return sequence.bucket_contingency(sequence.staying_split(sequence.runs(fine(spark, sf_dir), ["agent"]), ["agent"]))


@query(B + "SELECT agent, zone, round(share, 6) AS share, staying, rank FROM zone_class")
def zone_class(spark, sf_dir):
    return sequence.classify_zones(fine(spark, sf_dir), ["agent"]).select("agent", "zone", *r6("share"), "staying", "rank")


SPS = ", dr AS (SELECT agent, slot // 24 AS day, zone, min(slot) AS s, max(slot) + 1 AS e FROM (SELECT *, slot - row_number() OVER (PARTITION BY agent, slot // 24, zone ORDER BY slot) AS g FROM panel) GROUP BY agent, slot // 24, zone, g), st AS (SELECT dr.* FROM dr WHERE e - s >= 3 AND EXISTS (SELECT 1 FROM runs r WHERE r.agent = dr.agent AND r.zone = dr.zone AND r.len >= 3))"


@query(C + SPS + " SELECT a.agent, a.day, a.s AS s1_start, a.e AS s1_end, b.s AS s2_start, b.e AS s2_end, a.zone AS z1, b.zone AS z2 FROM st a JOIN st b ON a.agent = b.agent AND a.day = b.day AND b.s = (SELECT min(c.s) FROM st c WHERE c.agent = a.agent AND c.day = a.day AND c.s > a.e)")
def sps_triplets(spark, sf_dir):
    return sequence.sps_triplets(coarse(spark, sf_dir), ["agent"], PER_DAY, 3)


def stay_series(panel: DataFrame) -> DataFrame:
    return counts.transitions(panel).select("agent", "slot", (F.col("origin") == F.col("dest")).cast("int").alias("y"))


RUNLEN = ", a AS (SELECT agent, slot, y, sum(CASE WHEN y = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY agent ORDER BY slot) AS g FROM stay), rl AS (SELECT agent, slot, y, CASE WHEN y = 1 THEN count(*) FILTER (y = 1) OVER (PARTITION BY agent, g ORDER BY slot) ELSE coalesce((SELECT 0), 0) END AS c, g FROM a), rn AS (SELECT agent, slot, y, CASE WHEN y = 1 THEN c ELSE coalesce(lag(c) OVER (PARTITION BY agent ORDER BY slot), 0) END AS run_len FROM rl)"


@query(C + RUNLEN + " SELECT agent, slot, y, CAST(run_len AS BIGINT) AS run_len FROM rn")
def run_length(spark, sf_dir):
    return sequence.run_length(stay_series(coarse(spark, sf_dir)), ["agent"]).select("agent", "slot", "y", "run_len")


DECAY = ", dn AS (SELECT agent, slot, run_len AS l, row_number() OVER (PARTITION BY agent ORDER BY slot) AS k FROM rn WHERE y = 0 AND run_len > 0), dm AS (SELECT a.agent, a.slot, sum(pow(0.8, a.k - b.k) * b.l) / sum(pow(0.8, a.k - b.k)) AS m FROM dn a JOIN dn b ON a.agent = b.agent AND b.k <= a.k GROUP BY ALL), ms AS (SELECT rn.agent, rn.slot, rn.y, rn.run_len, last_value(m IGNORE NULLS) OVER (PARTITION BY rn.agent ORDER BY rn.slot ROWS UNBOUNDED PRECEDING) AS mean_stay FROM rn LEFT JOIN dm ON dm.agent = rn.agent AND dm.slot = rn.slot)"


@query(C + RUNLEN + DECAY + " SELECT agent, slot, round(mean_stay, 6) AS mean_stay FROM ms")
def mean_stay_decay(spark, sf_dir):
    return sequence.decayed_mean_stay(stay_series(coarse(spark, sf_dir)), ["agent"]).select("agent", "slot", *r6("mean_stay"))


@query(C + RUNLEN + DECAY + " SELECT agent, slot, round(CASE WHEN mean_stay IS NOT NULL THEN greatest(run_len - (mean_stay - 6.0), 0.0) ELSE 0.0 END, 6) AS pressure FROM ms")
def leave_pressure(spark, sf_dir):
    return sequence.leave_pressure(stay_series(coarse(spark, sf_dir)), ["agent"]).select("agent", "slot", *r6("pressure"))


@query(C + ", st AS (SELECT *, coalesce(lag(y) OVER (PARTITION BY agent ORDER BY slot) <> y, true) AS ch FROM stay), g AS (SELECT *, sum(CAST(ch AS INT)) OVER (PARTITION BY agent ORDER BY slot) AS run FROM st) SELECT agent, slot, y FROM (SELECT *, row_number() OVER (PARTITION BY agent, run ORDER BY slot) AS pos FROM g) WHERE pos <= 2")
def streak_prune(spark, sf_dir):
    return sequence.drop_beyond_streak(stay_series(coarse(spark, sf_dir)), ["agent"], ["slot"], 2).select("agent", "slot", "y")


def gate_sql(n: int, same: str, ident: int, sign: float, threshold: float = 2.0, cells: str = "cind") -> str:
    """Signed leave gates of the asked cells whose origin and destination are `same` (= or <>)."""
    return f""", gr{n} AS (SELECT *, CASE WHEN y = {ident} THEN row_number() OVER (PARTITION BY agent, origin, dest, y, g ORDER BY slot) END AS own FROM (SELECT *, slot - row_number() OVER (PARTITION BY agent, origin, dest, y ORDER BY slot) AS g FROM {cells} WHERE origin {same} dest)),
gl{n} AS (SELECT *, CASE WHEN y = {ident} THEN own WHEN lag(slot) OVER w = slot - 1 THEN coalesce(lag(own) OVER w, 0) ELSE 0 END AS len FROM gr{n} WINDOW w AS (PARTITION BY agent, origin, dest ORDER BY slot)),
gd{n} AS (SELECT agent, origin, dest, slot, len, row_number() OVER (PARTITION BY agent, origin, dest ORDER BY slot) AS k FROM gl{n} WHERE y <> {ident} AND len > 0),
gm{n} AS (SELECT a.agent, a.origin, a.dest, a.slot, sum(pow(0.8, a.k - b.k) * b.len) / sum(pow(0.8, a.k - b.k)) AS m FROM gd{n} a JOIN gd{n} b ON a.agent = b.agent AND a.origin = b.origin AND a.dest = b.dest AND b.k <= a.k GROUP BY ALL),
gate{n} AS (SELECT agent, origin, dest, slot, CASE WHEN mean IS NOT NULL THEN {sign} * CAST(round(len - (mean - {threshold}), 9) > 0 AS INT) END AS gate FROM (SELECT l.*, last_value(m IGNORE NULLS) OVER (PARTITION BY l.agent, l.origin, l.dest ORDER BY l.slot ROWS UNBOUNDED PRECEDING) AS mean FROM gl{n} l LEFT JOIN gm{n} m ON m.agent = l.agent AND m.origin = l.origin AND m.dest = l.dest AND m.slot = l.slot))"""


GATES = gate_sql(1, "=", 1, -1.0) + gate_sql(2, "<>", 0, 1.0) + ", gates AS (SELECT * FROM gate1 UNION ALL SELECT * FROM gate2)"


@query(C + GATES + " SELECT agent, origin, dest, slot, CAST(gate AS DOUBLE) AS gate FROM gates")
def leave_gate(spark, sf_dir):
    return sequence.signed_leave_gate(cascade_cells(coarse(spark, sf_dir)), ["agent"], 0.8, 2.0).select("agent", "origin", "dest", "slot", "gate")


@query(C + GATES + f" SELECT agent, origin, dest, slot + k * 24 AS slot, CAST(coalesce(gate, 0) AS DOUBLE) AS gate FROM gates, (SELECT unnest(range(1, 8)) AS k) WHERE slot >= {TRAIN_END - 24} AND slot < {TRAIN_END}")
def leave_gate_frozen(spark, sf_dir):
    made = sequence.signed_leave_gate(cascade_cells(coarse(spark, sf_dir)), ["agent"], 0.8, 2.0).withColumn("gate", F.coalesce("gate", F.lit(0.0)))
    return counts.frozen(made, PER_DAY, 7, TRAIN_END).select("agent", "origin", "dest", "slot", "gate")


@query(B + "SELECT p.agent, p.slot, p.zone, r.len AS dwell_len FROM panel p JOIN runs r ON r.agent = p.agent AND p.slot >= r.run_start AND p.slot < r.run_end")
def dwell_points(spark, sf_dir):
    return sequence.dwell(fine(spark, sf_dir), ["agent"]).select("agent", "slot", "zone", "dwell_len")


@query(B + ", st AS (SELECT *, coalesce(abs(lat - lag(lat) OVER w) <= 0.02 + 1e-5 * abs(lag(lat) OVER w) AND abs(lon - lag(lon) OVER w) <= 0.02 + 1e-5 * abs(lag(lon) OVER w), false) AS same FROM pings WHERE zone IS NOT NULL WINDOW w AS (PARTITION BY agent ORDER BY ts, event_id)), g AS (SELECT *, sum(CAST(NOT same AS INT)) OVER (PARTITION BY agent ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM st) SELECT event_id, count(*) OVER (PARTITION BY agent, run) AS dwell_len, count(*) OVER (PARTITION BY agent, run) >= 2 AS staying FROM g")
def dwell_runs(spark, sf_dir):
    """Runs of positions within a tolerance of the one before."""
    return sequence.dwell_positions(located(spark, sf_dir), ["agent"], ["ts", "event_id"], 0.02, 2).select("event_id", "dwell_len", "staying")


# kernels


def od_series(panel: DataFrame) -> DataFrame:
    od = counts.od_counts(panel)
    return sizes(panel).join(od, ["origin", "dest", "slot"], "left").select("origin", "dest", "slot", F.coalesce("n", F.lit(0)).alias("y"), F.col("size").alias("n"))


@query(C + ", " + sql.kernel("SELECT origin, dest, slot, n AS y, size AS n FROM sizes WHERE size > 0", ["origin", "dest"], 2, 4, 5.0, ["y", "n"]) + " SELECT origin, dest, slot, round((1 + y) / (2 + n), 6) AS value FROM ksums")
def kernel_binom(spark, sf_dir):
    return kernel.binomial_forecast(od_series(coarse(spark, sf_dir)), ["origin", "dest"], PER_DAY, 120, 240).select("origin", "dest", "slot", *r6("value"))


OCC = "SELECT z.zone, s.slot, coalesce(o.n, 0) AS n, 1.0 AS w FROM (SELECT DISTINCT zone FROM occ) z CROSS JOIN (SELECT unnest(range(0, 720)) AS slot) s LEFT JOIN occ o ON o.zone = z.zone AND o.slot = s.slot"


def dense_occupancy(panel: DataFrame) -> DataFrame:
    return counts.dense(counts.occupancy(panel), ["zone"], 0, SLOTS - 1)


@query(C + ", " + sql.kernel(OCC, ["zone"], 2, 4, 5.0, ["n", "w"]) + " SELECT zone, slot, round((1 + n) / (1 + w), 6) AS value FROM ksums")
def kernel_occ(spark, sf_dir):
    return kernel.count_forecast(dense_occupancy(coarse(spark, sf_dir)), ["zone"], PER_DAY, 120, 240).select("zone", "slot", *r6("value"))


@query(C + ", " + sql.kernel(OCC, ["zone"], 2, 4, 5.0, ["n", "w"]).replace("c.s < t.s)", "CASE WHEN t.s = 0 THEN c.s < 23 ELSE c.s < t.s - 1 END)") + " SELECT zone, slot, round((1 + n) / (1 + w), 6) AS value FROM ksums")
def kernel_occ_compat(spark, sf_dir):
    return kernel.count_forecast(dense_occupancy(coarse(spark, sf_dir)), ["zone"], PER_DAY, 120, 240, compat_gap=True).select("zone", "slot", *r6("value"))


@query(C + ", " + sql.kernel("SELECT agent, slot, y, 1 AS n FROM stay", ["agent"], 1, 2, 14.0, ["y", "n"], False) + " SELECT agent, slot, round((0.5 + y) / (1 + n), 6) AS value FROM ksums")
def kernel_bin(spark, sf_dir):
    return kernel.binary_forecast(stay_series(coarse(spark, sf_dir)), ["agent"], PER_DAY, 60, 120).select("agent", "slot", *r6("value"))


SWITCH = ", sc AS (SELECT agent, slot, slot // 24 AS day, slot % 24 AS s, y FROM stay), dd AS (SELECT a.agent, a.day, t.s, max(y) AS one FROM sc a JOIN (SELECT unnest(range(0, 24)) AS s) t ON least(abs(a.s - t.s), 24 - abs(a.s - t.s)) <= 1 GROUP BY ALL) SELECT a.agent, a.slot, round((0.5 + coalesce(sum(pow(0.9, a.day - d.day) * d.one), 0)) / (1 + coalesce(sum(pow(0.9, a.day - d.day)), 0)), 6) AS value FROM sc a LEFT JOIN dd d ON d.agent = a.agent AND d.s = a.s AND d.day < a.day GROUP BY a.agent, a.slot"


@query(C + SWITCH)
def switch_prob(spark, sf_dir):
    return kernel.switch_probability(stay_series(coarse(spark, sf_dir)), ["agent"], PER_DAY, 60, 0.9).select("agent", "slot", *r6("value"))


@query(C + ", x AS (SELECT agent, slot, CAST(y AS DOUBLE) AS v, row_number() OVER (PARTITION BY agent ORDER BY slot) AS k FROM stay) SELECT a.agent, a.slot, round(sum(pow(1 - 2 / 7.0, a.k - b.k) * b.v) / sum(pow(1 - 2 / 7.0, a.k - b.k)), 6) AS value FROM x a JOIN x b ON a.agent = b.agent AND b.k <= a.k GROUP BY a.agent, a.slot")
def ewm(spark, sf_dir):
    own = stay_series(coarse(spark, sf_dir)).select("agent", "slot", F.col("y").cast("double").alias("value"))
    return kernel.ewm_mean(own, ["agent"], 6.0).select("agent", "slot", *r6("value"))


@query(C + ", " + sql.kernel(OCC, ["zone"], 2, 4, 5.0, ["n", "w"]) + " SELECT m.origin, m.dest, m.slot, round(ln(1 + o.n / ((1 + k.n) / (1 + k.w)) * m.p), 6) AS value FROM mult m JOIN occ o ON o.zone = m.origin AND o.slot = m.slot JOIN ksums k ON k.zone = m.origin AND k.slot = m.slot - 1")
def occ_change(spark, sf_dir):
    panel = coarse(spark, sf_dir)
    smooth = kernel.count_forecast(dense_occupancy(panel), ["zone"], PER_DAY, 120, 240)
    return probability.occupancy_change(counts.occupancy(panel), smooth, multinomial(panel)).select("origin", "dest", "slot", *r6("value"))


@query(C + "SELECT origin, dest, slot // 24 AS day, slot % 24 AS s, n AS y, CAST(size AS BIGINT) AS n, size > 0 AS mask FROM sizes")
def day_slot_matrix(spark, sf_dir):
    own = kernel.day_slot_cells(od_series(coarse(spark, sf_dir)), PER_DAY)
    return own.select("origin", "dest", "day", "s", "y", "n", (F.col("n") > 0).alias("mask"))


EMPIRICAL = (
    ", kc AS (SELECT c.agent, c.origin, c.dest, "
    + "CASE WHEN NOT z.staying THEN 'passing_to_any' WHEN c.origin = c.dest THEN 'staying_to_self' ELSE 'staying_to_other' END AS kind, c.slot, c.y FROM cind c JOIN zone_class z ON z.agent = c.agent AND z.zone = c.origin), "
    + sql.kernel("SELECT agent, origin, dest, kind, slot, y, 1 AS n FROM kc WHERE kind = 'staying_to_self'", ["agent", "origin", "dest", "kind"], 1, 2, 14.0, ["y", "n"], False)
    + ", oc AS (SELECT *, slot // 24 AS day, slot % 24 AS s FROM kc WHERE kind <> 'staying_to_self'), od1 AS (SELECT agent, origin, dest, day, t.s, max(y) AS one FROM oc a JOIN (SELECT unnest(range(0, 24)) AS s) t ON least(abs(a.s - t.s), 24 - abs(a.s - t.s)) <= 1 GROUP BY ALL), osw AS (SELECT a.agent, a.origin, a.dest, a.kind, a.slot, (0.5 + coalesce(sum(d.one), 0)) / (1 + count(d.one)) AS v FROM oc a LEFT JOIN od1 d ON d.agent = a.agent AND d.origin = a.origin AND d.dest = a.dest AND d.s = a.s AND d.day < a.day GROUP BY ALL)"
    + " SELECT agent, origin, dest, kind, slot, round((0.5 + y) / (1 + n), 6) AS value FROM ksums UNION ALL SELECT agent, origin, dest, kind, slot, round(v, 6) AS value FROM osw"
)


@query(C + EMPIRICAL)
def empirical_kernel(spark, sf_dir):
    panel = coarse(spark, sf_dir)
    cells = counts.by_zone_type(cascade_cells(panel).select("agent", "origin", "dest", "slot", "y"), sequence.classify_zones(panel, ["agent"]))
    return kernel.empirical_probability(cells, ["agent", "origin", "dest"], PER_DAY).select("agent", "origin", "dest", "kind", "slot", *r6("value"))


# probabilities


def multinomial(panel: DataFrame) -> DataFrame:
    od = counts.od_counts(panel)
    active = od.groupBy("origin", "slot").agg(F.sum("n").alias("_t"))
    pairs = counts.od_ranked(od).select("origin", "dest", "rank")
    return active.join(pairs, "origin").join(od, ["origin", "dest", "slot"], "left").select("origin", "dest", "slot", "rank", (F.coalesce("n", F.lit(0)) / F.col("_t")).alias("p"))


def cascade(panel: DataFrame) -> DataFrame:
    return probability.multinomial_to_cascade(multinomial(panel), ["origin"])


@query(C + "SELECT origin, dest, slot, round(v, 6) AS p FROM casc")
def mult_to_cascade(spark, sf_dir):
    return cascade(coarse(spark, sf_dir)).select("origin", "dest", "slot", *r6("p"))


@query(C + "SELECT origin, dest, slot, round(p, 6) AS p FROM mult")
def cascade_to_mult(spark, sf_dir):
    return probability.stick_to_multinomial(cascade(coarse(spark, sf_dir)), ["origin"]).select("origin", "dest", "slot", *r6("p"))


STICKS = ", sm AS (SELECT origin, dest, slot, v / 2 * coalesce(product(1 - v / 2) OVER (PARTITION BY origin, slot ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS p FROM casc)"


def halved(panel: DataFrame) -> DataFrame:
    return probability.stick_to_multinomial(cascade(panel).withColumn("p", F.col("p") / 2), ["origin"])


@query(C + STICKS + " SELECT origin, dest, slot, round(p, 6) AS p FROM sm")
def stick_to_mult(spark, sf_dir):
    return halved(coarse(spark, sf_dir)).select("origin", "dest", "slot", *r6("p"))


@query(C + STICKS + " SELECT origin, slot, round(1 - sum(p), 6) AS rest FROM sm GROUP BY ALL")
def stick_leftover(spark, sf_dir):
    return probability.leftover(halved(coarse(spark, sf_dir)), ["origin"]).select("origin", "slot", *r6("rest"))


FULL = ", part AS (SELECT * FROM mult WHERE rank <= 2 AND p > 1e-12), prow AS (SELECT origin, slot, 1 - coalesce(sum(p), 0) AS rest, count(*) AS k FROM part GROUP BY ALL), cube AS (SELECT r.origin, z.zone AS dest, r.slot, coalesce(q.p, r.rest / nullif(5 - r.k, 0), 0) AS p FROM (SELECT o.origin, o.slot, coalesce(w.rest, 1.0) AS rest, coalesce(w.k, 0) AS k FROM (SELECT DISTINCT origin, slot FROM mult) o LEFT JOIN prow w ON w.origin = o.origin AND w.slot = o.slot) r CROSS JOIN (SELECT DISTINCT zone FROM panel) z LEFT JOIN part q ON q.origin = r.origin AND q.slot = r.slot AND q.dest = z.zone)"


def cube_of(panel: DataFrame) -> DataFrame:
    return probability.full_transition(multinomial(panel).filter("rank <= 2"), panel.select("zone").distinct())


@query(C + FULL + " SELECT origin, dest, slot, round(p, 6) AS p FROM cube")
def full_transition(spark, sf_dir):
    return cube_of(coarse(spark, sf_dir)).select("origin", "dest", "slot", *r6("p"))


TWO = ", two AS (SELECT a.origin, b.dest, a.slot, sum(a.p * b.p) AS p FROM cube a JOIN cube b ON b.origin = a.dest AND b.slot = a.slot + 1 GROUP BY ALL)"


@query(C + FULL + TWO + " SELECT origin, dest, slot, round(p, 6) AS p FROM two")
def two_step(spark, sf_dir):
    return probability.multistep(cube_of(coarse(spark, sf_dir)), 2)[2].select("origin", "dest", "slot", *r6("p"))


@query(C + FULL + TWO + " SELECT origin, dest, slot, round(p + 1e-9, 6) AS p FROM two WHERE p > 1e-12")
def two_step_packed(spark, sf_dir):
    zones = list(range(len(events.KINDS)))
    cube = probability.packed_cube(cube_of(coarse(spark, sf_dir)), zones)
    return probability.unpacked_cube(probability.chained_packed(cube, cube, 1), zones).filter("p > 1e-12").select("origin", "dest", "slot", F.round(F.col("p") + 1e-9, 6).alias("p"))


@query(C + FULL + TWO + " SELECT origin, slot, round(sum(p), 6) AS total FROM two GROUP BY ALL HAVING abs(sum(p) - 1) > 1e-3")
def two_step_rows_off(spark, sf_dir):
    return probability.row_sums_off(probability.multistep(cube_of(coarse(spark, sf_dir)), 2)[2], 1e-3).select("origin", "slot", *r6("total"))


@query(C + FULL + " SELECT origin, dest, slot, round(CASE WHEN p < 0.05 THEN 0 ELSE p END, 6) AS p FROM cube")
def sparsify(spark, sf_dir):
    return probability.sparsified(cube_of(coarse(spark, sf_dir)), 0.05).select("origin", "dest", "slot", *r6("p"))


KSTEP = ", k AS (SELECT i.agent, i.origin, i.dest, i.slot, coalesce(t.p, 0) AS f FROM cind i LEFT JOIN panel w ON w.agent = i.agent AND w.slot = i.slot - 2 LEFT JOIN panel e ON e.agent = i.agent AND e.slot = i.slot LEFT JOIN two t ON t.origin = w.zone AND t.dest = {dest} AND t.slot = i.slot - 1) SELECT agent, origin, dest, count(*) AS cells, round(sum(f), 6) AS total, round(sum(f * slot) + 0.000017, 3) AS moment FROM k GROUP BY ALL"


SPARSE = ", sp AS (SELECT origin, dest, slot, CAST(0.9 AS DOUBLE) * n / sum(n) OVER (PARTITION BY origin, slot) AS p FROM od), zs AS (SELECT DISTINCT zone FROM panel), fl AS (SELECT origin, slot, coalesce((1 - sum(p)) / nullif((SELECT count(*) FROM zs) - count(*), 0), 0) AS f FROM sp GROUP BY ALL), ak AS (SELECT DISTINCT origin, dest, slot - 1 AS slot FROM (SELECT slot, lag(zone, 2) OVER (PARTITION BY agent ORDER BY slot) AS origin, zone AS dest FROM panel) WHERE origin IS NOT NULL) SELECT a.origin, a.dest, a.slot, round(sum(coalesce(x.p, f.f) * coalesce(y.p, g.f)), 6) AS p FROM ak a JOIN fl f ON f.origin = a.origin AND f.slot = a.slot JOIN fl g ON g.slot = a.slot + 1 LEFT JOIN sp x ON x.origin = a.origin AND x.slot = a.slot AND x.dest = g.origin LEFT JOIN sp y ON y.origin = g.origin AND y.slot = g.slot AND y.dest = a.dest GROUP BY a.origin, a.dest, a.slot"


@query(B + SPARSE)
def two_step_fine(spark, sf_dir):
    """On the fine zones, what two steps give to each pair that agents really went between: nine tenths by counts, a tenth spread over the other zones."""
    panel = fine(spark, sf_dir)
    cells, fills = probability.sparse_cube(shares(panel).withColumn("p", 0.9 * F.col("p")), panel.select("zone").distinct().count())
    asked = counts.od_counts(panel, 2).select("origin", "dest", (F.col("slot") - 1).alias("slot"))
    return probability.sparse_two_step(cells, fills, asked).select("origin", "dest", "slot", *r6("p"))


def _kstep(panel: DataFrame, compat: bool) -> DataFrame:
    two = probability.multistep(cube_of(panel), 2)[2]
    own = probability.kstep_feature(cascade_cells(panel).select("agent", "origin", "dest", "slot"), panel, two, 2, compat)
    return own.groupBy("agent", "origin", "dest").agg(F.count(F.lit(1)).alias("cells"), F.round(F.sum("feature"), 6).alias("total"), F.round(F.sum(F.col("feature") * F.col("slot")) + 0.000017, 3).alias("moment"))


@query(C + FULL + TWO + KSTEP.format(dest="i.dest"))
def kstep_feature(spark, sf_dir):
    return _kstep(coarse(spark, sf_dir), False)


@query(C + FULL + TWO + KSTEP.format(dest="e.zone"))
def kstep_feature_compat(spark, sf_dir):
    return _kstep(coarse(spark, sf_dir), True)


RARE = ", md AS (SELECT * FROM casc WHERE rank <= 3), mm AS (SELECT origin, dest, slot, v * coalesce(product(1 - v) OVER (PARTITION BY origin, slot ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS p FROM md), rs AS (SELECT origin, slot, 1 - sum(p) AS rest FROM mm GROUP BY ALL), rr AS (SELECT origin, dest, count(*) OVER (PARTITION BY origin) AS n FROM ranked WHERE rank > 3), asm AS (SELECT * FROM mm UNION ALL SELECT r.origin, r.dest, s.slot, s.rest / r.n AS p FROM rr r JOIN rs s ON s.origin = r.origin)"


def assembled(panel: DataFrame) -> DataFrame:
    made = cascade(panel)
    rare = made.filter("rank > 3").select("origin", "dest").distinct()
    return probability.with_rare(made.filter("rank <= 3"), rare, [])


@query(C + RARE + " SELECT origin, dest, slot, round(p, 6) AS p FROM asm")
def rare_assemble(spark, sf_dir):
    return assembled(coarse(spark, sf_dir)).select("origin", "dest", "slot", *r6("p"))


@query(C + FULL + RARE + ", often AS (SELECT origin FROM (SELECT origin, sum(n) AS n FROM od WHERE origin <> dest GROUP BY ALL) QUALIFY n >= avg(n) OVER ()) SELECT origin, dest, slot, round(p, 6) AS p FROM asm WHERE origin IN (SELECT origin FROM often) UNION ALL SELECT m.origin, m.dest, m.slot, round(c.p, 6) AS p FROM mult m LEFT JOIN cube c ON c.origin = m.origin AND c.dest = m.dest AND c.slot = m.slot % 168 WHERE m.origin NOT IN (SELECT origin FROM often)")
def rare_append(spark, sf_dir):
    """Origins with as many moves away as the average are modelled; the others get the group's probabilities."""
    panel = coarse(spark, sf_dir)
    away = counts.od_counts(panel).filter("origin <> dest").groupBy("origin").agg(F.sum("n").alias("n"))
    often = away.join(F.broadcast(away.agg(F.avg("n").alias("usual")))).filter("n >= usual").select("origin")
    fitted = assembled(panel).join(often, "origin", "left_semi")
    return probability.append_unmodelled(fitted, multinomial(panel), cube_of(panel), [], 168).select("origin", "dest", "slot", *r6("p"))


@query(C + ", " + sql.kernel("SELECT origin, dest, slot, n AS y, size AS n FROM sizes WHERE size > 0", ["origin", "dest"], 2, 4, 5.0, ["y", "n"]) + ", fc AS (SELECT origin, dest, slot, (1 + y) / (2 + n) AS p FROM ksums) SELECT d.origin, d.dest, d.slot, round(last_value(f.p IGNORE NULLS) OVER (PARTITION BY d.origin, d.dest ORDER BY d.slot ROWS UNBOUNDED PRECEDING), 6) AS p FROM od_dense d LEFT JOIN fc f ON f.origin = d.origin AND f.dest = d.dest AND f.slot = d.slot")
def prob_ffill(spark, sf_dir):
    panel = coarse(spark, sf_dir)
    made = kernel.binomial_forecast(od_series(panel), ["origin", "dest"], PER_DAY, 120, 240).withColumnRenamed("value", "p")
    grid = sizes(panel).select("origin", "dest", "slot")
    return probability.filled_forward(grid, made, ["origin", "dest"]).select("origin", "dest", "slot", *r6("p"))


@query(C + ", " + sql.kernel("SELECT origin, dest, slot, n AS y, size AS n FROM sizes WHERE size > 0", ["origin", "dest"], 2, 4, 5.0, ["y", "n"]) + ", q AS (SELECT origin, dest, slot, (1 + y) / (2 + n) AS p FROM ksums) SELECT d.origin, d.dest, d.slot, round(ln(coalesce(q.p, 0.5) / (1 - coalesce(q.p, 0.5))), 6) AS value FROM od_dense d LEFT JOIN q ON q.origin = d.origin AND q.dest = d.dest AND q.slot = d.slot")
def logit_kernel(spark, sf_dir):
    panel = coarse(spark, sf_dir)
    made = kernel.binomial_forecast(od_series(panel), ["origin", "dest"], PER_DAY, 120, 240)
    own = sizes(panel).join(made, ["origin", "dest", "slot"], "left")
    return own.select("origin", "dest", "slot", F.round(numeric.logit(F.coalesce("value", F.lit(0.5))), 6).alias("value"))


# detection


HSTEP = ", pool AS (SELECT origin, dest, n / CAST(sum(n) OVER (PARTITION BY origin) AS DOUBLE) AS p FROM (SELECT origin, dest, sum(n) AS n FROM od GROUP BY ALL)), hs AS (SELECT m.agent, m.slot, ln(greatest(p.p, 1e-12)) - ln(greatest(q.p, 1e-12)) AS h FROM moves m JOIN pool p ON p.origin = m.origin AND p.dest = m.dest JOIN mult q ON q.origin = m.origin AND q.dest = m.dest AND q.slot = m.slot)"
BAYES = ", ss AS (SELECT agent, slot, h, sum(h) OVER w AS s, row_number() OVER w AS t FROM hs WINDOW w AS (PARTITION BY agent ORDER BY slot)), mx AS (SELECT *, max(s) OVER (PARTITION BY agent ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM ss)"


def step_factors(panel: DataFrame) -> DataFrame:
    pooled = counts.pooled_probability(counts.od_counts(panel))
    return detect.step_log_factor(counts.transitions(panel), pooled, shares(panel), ["agent"])


def shares(panel: DataFrame) -> DataFrame:
    """(origin, dest, slot, p): the moves' shares of their origin and slot; cells without a move are absent."""
    own = counts.od_counts(panel)
    return own.join(own.groupBy("origin", "slot").agg(F.sum("n").alias("_t")), ["origin", "slot"]).select("origin", "dest", "slot", (F.col("n") / F.col("_t")).alias("p"))


@query(C + HSTEP + BAYES + " SELECT agent, slot, round(s - greatest(0, coalesce(m, 0)), 5) AS log_l FROM mx")
def bayes_factor(spark, sf_dir):
    own = detect.cumulative_bayes_factor(step_factors(coarse(spark, sf_dir)), ["agent"])
    return own.select("agent", "slot", F.round("log_l", 5).alias("log_l"))


LUCK = ", hs AS (SELECT user_id AS agent, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS slot, CAST(CAST(json_extract_string(props, '$.k') AS INT) % 7 - 3 AS DOUBLE) AS h FROM events)"


@query("WITH x AS (SELECT 1)" + LUCK + BAYES + ", z AS (SELECT a.agent, a.slot, a.s - greatest(0, coalesce(a.m, 0)) AS log_l, a.t - coalesce((SELECT max(b.t) FROM ss b WHERE b.agent = a.agent AND b.t < a.t AND b.s = a.m AND a.m >= 0), 0) AS run_len FROM mx a) SELECT agent, slot, log_l, run_len FROM z")
def bayes_factor_runs(spark, sf_dir):
    from pyspark.sql import Window

    own = read(spark, sf_dir).select(F.col("user_id").alias("agent"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("slot"), (F.get_json_object("props", "$.k").cast("int") % 7 - 3).cast("double").alias("h"))
    return detect.cumulative_bayes_factor(own, ["agent"]).select("agent", "slot", "log_l", "run_len")


ARG = ", am AS (SELECT m.agent, m.slot, m.origin, q.dest, q.p, m.dest AS real_dest, row_number() OVER (PARTITION BY m.agent, m.slot ORDER BY q.p DESC, q.dest) AS k FROM moves m JOIN mult q ON q.origin = m.origin AND q.slot = m.slot)"


@query(C + ARG + " SELECT agent, slot, origin, dest, round(p, 6) AS p, real_dest FROM am WHERE k = 1")
def argmax_dest(spark, sf_dir):
    panel = coarse(spark, sf_dir)
    return detect.argmax_destination(shares(panel), counts.transitions(panel), ["agent"]).select("agent", "slot", "origin", "dest", *r6("p"), "real_dest")


@query(C + ARG + " SELECT agent, count(*) AS n, round(avg(CAST(dest = real_dest AS INT)), 6) AS accuracy, count(*) FILTER (origin <> real_dest) AS moves, round(avg(CAST(dest = real_dest AS INT)) FILTER (origin <> real_dest), 6) AS move_accuracy FROM am WHERE k = 1 GROUP BY agent")
def accuracy(spark, sf_dir):
    panel = coarse(spark, sf_dir)
    own = detect.argmax_destination(shares(panel), counts.transitions(panel), ["agent"])
    return detect.accuracies(own, ["agent"]).select("agent", "n", *r6("accuracy"), "moves", *r6("move_accuracy"))


SUMMARY = ", c AS (SELECT agent, count(*) FILTER (NOT hit AND y = 0) AS tn, count(*) FILTER (hit AND y = 0) AS fp, count(*) FILTER (NOT hit AND y = 1) AS fn, count(*) FILTER (hit AND y = 1) AS tp FROM (SELECT s.agent, s.y, (0.5 + k.y) / (1 + k.n) >= 0.8 AS hit FROM stay s JOIN ksums k ON k.agent = s.agent AND k.slot = s.slot) GROUP BY agent) SELECT agent, tn, fp, fn, tp, round((tn + tp) / CAST(tn + fp + fn + tp AS DOUBLE), 6) AS accuracy, round(coalesce(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 0), 6) AS precision, round(coalesce(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 0), 6) AS recall, round(coalesce(2 * tp / CAST(nullif(2 * tp + fp + fn, 0) AS DOUBLE), 0), 6) AS f1, round(coalesce((tp * CAST(tn AS DOUBLE) - fp * CAST(fn AS DOUBLE)) / nullif(sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) AS mcc FROM c"


@query(C + ", " + sql.kernel("SELECT agent, slot, y, 1 AS n FROM stay", ["agent"], 1, 2, 14.0, ["y", "n"], False) + SUMMARY)
def binary_metrics(spark, sf_dir):
    series = stay_series(coarse(spark, sf_dir))
    made = kernel.binary_forecast(series, ["agent"], PER_DAY, 60, 120).withColumnRenamed("value", "p_hat")
    own = detect.binary_summary(series.join(made, ["agent", "slot"]), ["agent"], 0.8)
    return own.select("agent", "tn", "fp", "fn", "tp", *r6("accuracy", "precision", "recall", "f1", "mcc"))


CURVES = "WITH s AS (SELECT event_type AS run, round(value, 1) AS score, user_id % 4 = 0 OR value < 20 AS positive FROM events), t AS (SELECT DISTINCT run, CAST(score AS DOUBLE) AS tau FROM s UNION ALL SELECT DISTINCT run, CAST('inf' AS DOUBLE) FROM s UNION ALL SELECT DISTINCT run, CAST('-inf' AS DOUBLE) FROM s), c AS (SELECT t.run, tau, count(*) FILTER (positive AND score <= tau) AS tp, count(*) FILTER (NOT positive AND score <= tau) AS fp, count(*) FILTER (positive) AS p, count(*) FILTER (NOT positive) AS n FROM t JOIN s ON s.run = t.run GROUP BY ALL), r AS (SELECT run, tau, tp, fp, p AS n_pos, n AS n_neg, coalesce(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 0) AS precision, coalesce(tp / CAST(nullif(p, 0) AS DOUBLE), 0) AS recall, coalesce(fp / CAST(nullif(n, 0) AS DOUBLE), 0) AS fpr FROM c)"


def curves(spark, sf_dir) -> DataFrame:
    own = read(spark, sf_dir).select(F.col("event_type").alias("run"), F.round("value", 1).alias("score"), ((F.col("user_id") % 4 == 0) | (F.col("value") < 20)).alias("positive"))
    return detect.threshold_curves(own, ["run"])


@query(CURVES + " SELECT run, CASE WHEN isinf(tau) THEN CAST(tau AS VARCHAR) ELSE CAST(CAST(tau * 10 AS BIGINT) AS VARCHAR) END AS tau10, tp, fp, round(precision, 6) AS precision, round(recall, 6) AS recall, round(fpr, 6) AS fpr FROM r")
def threshold_curves(spark, sf_dir):
    name = F.when(F.col("tau") == float("inf"), "inf").when(F.col("tau") == float("-inf"), "-inf").otherwise(F.round(F.col("tau") * 10).cast("long").cast("string"))
    return curves(spark, sf_dir).select("run", name.alias("tau10"), "tp", "fp", *r6("precision", "recall", "fpr"))


@query(CURVES + ", b AS (SELECT *, coalesce(1.25 * precision * recall / nullif(0.25 * precision + recall, 0), 0) AS f FROM r WHERE fpr <= 0.1), k AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY round(f, 12) DESC, tau DESC) AS q FROM b) SELECT run, round(tau, 1) AS tau, round(precision, 6) AS precision, round(recall, 6) AS recall, round(fpr, 6) AS fpr, true AS feasible, n_pos, n_neg FROM k WHERE q = 1")
def threshold_fbeta(spark, sf_dir):
    return detect.threshold_by_fbeta(curves(spark, sf_dir), ["run"], 0.1).select("run", F.round("tau", 1).alias("tau"), *r6("precision", "recall", "fpr"), "feasible", "n_pos", "n_neg")


@query(CURVES + ", k AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY round(recall, 12) DESC, round(fpr, 12), round(precision, 12) DESC, tau DESC) AS q FROM r WHERE fpr <= 0.1) SELECT run, round(tau, 1) AS tau, round(precision, 6) AS precision, round(recall, 6) AS recall, round(fpr, 6) AS fpr, true AS feasible, n_pos, n_neg FROM k WHERE q = 1")
def threshold_recall(spark, sf_dir):
    return detect.threshold_by_recall(curves(spark, sf_dir), ["run"], 0.1).select("run", F.round("tau", 1).alias("tau"), *r6("precision", "recall", "fpr"), "feasible", "n_pos", "n_neg")


@query(C + ", f AS (SELECT agent, slot + 24 AS slot, zone FROM panel) SELECT coalesce(a.agent, b.agent) AS agent, round(avg(CAST(a.zone IS DISTINCT FROM b.zone AS INT)), 6) AS changed FROM (SELECT * FROM panel WHERE slot >= 504 AND slot < 672) a FULL JOIN (SELECT * FROM f WHERE slot >= 504 AND slot < 672) b ON a.agent = b.agent AND a.slot = b.slot GROUP BY 1")
def changed_share(spark, sf_dir):
    panel = coarse(spark, sf_dir)
    shifted = panel.withColumn("slot", F.col("slot") + 24)
    return detect.changed_share(panel, shifted, ["agent"], 504, 672).select("agent", *r6("changed"))


FIRST = ", tr AS (SELECT a.agent, a.day, a.s, a.e, b.s AS s2, b.zone AS z2, row_number() OVER (PARTITION BY a.agent, a.day ORDER BY a.s) AS k FROM st a JOIN st b ON a.agent = b.agent AND a.day = b.day AND b.s = (SELECT min(c.s) FROM st c WHERE c.agent = a.agent AND c.day = a.day AND c.s > a.e)), one AS (SELECT * FROM tr WHERE k = 1 AND day >= 22)"


@query(C + SPS + FIRST + " SELECT p.agent, p.slot, CASE WHEN p.slot >= o.e - 1 AND p.slot < o.s2 - 1 THEN n.zone WHEN p.slot = o.s2 - 1 THEN o.z2 ELSE p.zone END AS zone FROM panel p LEFT JOIN one o ON o.agent = p.agent AND o.day = p.slot // 24 LEFT JOIN panel n ON n.agent = p.agent AND n.slot = p.slot + 1")
def inject_first_early(spark, sf_dir):
    from wayfold.operators import inject

    panel = coarse(spark, sf_dir)
    shifts = inject.chosen_shifts(panel, ["agent"], PER_DAY, 22 * 24, SLOTS, 3, 1, pick="first", mode="early")
    return inject.injected(panel, shifts, ["agent"], PER_DAY)


@query(B + ", cm AS (SELECT agent, slot, origin // 10 AS o, dest // 10 AS d, origin, dest FROM moves WHERE origin <> dest) SELECT count(*) AS moves, count(*) FILTER (o <> d) AS kept, round(count(*) FILTER (o <> d) / CAST(count(*) AS DOUBLE), 6) AS ratio FROM cm")
def capture_ratio(spark, sf_dir):
    panel = fine(spark, sf_dir)
    grouped = panel.withColumn("zone", F.floor(F.col("zone") / 10).cast("long"))
    return detect.capture_ratio(counts.transitions(panel), counts.transitions(grouped)).select("moves", "kept", *r6("ratio"))
