"""Registered queries that run as streams over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.plans import sql
from wayfold.plans.mobility import BAYES, QUERIES, query
from wayfold.sources import events
from wayfold.streaming import monitors
from wayfold.streaming.tables import drained, event_stream


def _positions(spark, sf_dir):
    return events.pings(event_stream(spark, f"{sf_dir}/events.parquet")).filter("zone is not null").select("event_id", "agent", "ts", "zone", "value")


@query("WITH " + sql.PINGS + ", w AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS start, zone, count(*) AS n FROM pings WHERE zone IS NOT NULL GROUP BY ALL) SELECT epoch_ms(start) // 1000 AS start, zone, n FROM w WHERE start + INTERVAL '1 hour' <= (SELECT max(ts) FROM pings) - INTERVAL '10 minutes'")
def stream_event_counts(spark, sf_dir):
    """Positions by zone and hour; hours that the watermark has passed."""
    made = drained(monitors.event_count_stream(_positions(spark, sf_dir)), "stream-counts")
    return made.select(F.unix_timestamp("start").alias("start"), "zone", "n")


PASSED = "(SELECT date_trunc('milliseconds', max(ts)) FROM pings) - INTERVAL '10 minutes'"


@query("WITH " + sql.PINGS + f", m AS (SELECT agent, ts, lag(zone) OVER (PARTITION BY agent ORDER BY ts, event_id) AS origin, zone AS dest FROM pings WHERE zone IS NOT NULL AND ts <= {PASSED}) SELECT agent, origin, dest, count(*) AS n FROM m WHERE origin IS NOT NULL GROUP BY ALL")
def stream_transitions(spark, sf_dir):
    """Moves between each agent's successive positions, pooled; positions that the watermark has passed."""
    made = drained(monitors.transition_stream(_positions(spark, sf_dir), number="event_id"), "stream-moves")
    return made.groupBy("agent", "origin", "dest").agg(F.count(F.lit(1)).alias("n"))


@query("WITH " + sql.PINGS + f", w AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS start, zone, count(DISTINCT agent) AS n FROM pings WHERE zone IS NOT NULL GROUP BY ALL) SELECT epoch_ms(start) // 1000 AS start, zone, n FROM w WHERE start + INTERVAL '1 hour' <= {PASSED}")
def stream_occupancy(spark, sf_dir):
    """Distinct agents by zone and hour; hours that the watermark has passed."""
    made = drained(monitors.occupancy_stream(_positions(spark, sf_dir)), "stream-occupancy")
    return made.select(F.unix_timestamp("start").alias("start"), "zone", "n")


@query("WITH " + sql.PINGS + f", g AS (SELECT agent, zone, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL '48 hours', true) AS new FROM pings WHERE zone IS NOT NULL WINDOW w AS (PARTITION BY agent, zone ORDER BY ts)), s AS (SELECT *, sum(CAST(new AS INT)) OVER (PARTITION BY agent, zone ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), e AS (SELECT agent, zone, min(ts) AS start, max(ts) + INTERVAL '48 hours' AS stop, count(*) AS n FROM s GROUP BY agent, zone, k) SELECT agent, zone, epoch_us(start) AS start, epoch_us(stop) AS stop, n FROM e WHERE stop <= {PASSED}")
def stream_stays(spark, sf_dir):
    """Sessions of an agent's positions in a zone, less than two days apart, that the watermark has passed."""
    made = drained(monitors.stay_stream(_positions(spark, sf_dir), "48 hours"), "stream-stays")
    return made.select("agent", "zone", F.unix_micros("start").alias("start"), F.unix_micros("stop").alias("stop"), "n")


@query()
def stream_model(spark, sf_dir):
    """A logistic model of each agent, in the order of event_id: is the event on an even row of the grid, by its value."""
    rows = _positions(spark, sf_dir).select("agent", F.col("event_id").alias("slot"), (F.floor(F.col("zone") / 10) % 2).cast("int").alias("y"), (F.col("value") / 100).alias("x"))
    return drained(monitors.model_stream(rows, ["x"]), "stream-model")


@query("WITH x AS (SELECT 1), hs AS (SELECT user_id AS agent, event_id AS slot, CAST(CAST(json_extract_string(props, '$.k') AS INT) % 7 - 3 AS DOUBLE) AS h FROM events)" + BAYES + " SELECT agent, slot, s - greatest(0, coalesce(m, 0)) AS log_l, s - greatest(0, coalesce(m, 0)) <= -9 AS flagged FROM mx")
def stream_bayes(spark, sf_dir):
    """The Bayes-factor monitor over events in the order of event_id."""
    steps = _positions(spark, sf_dir).select("agent", F.col("event_id").alias("slot"), (F.col("zone") % 7 - 3).cast("double").alias("h"))
    return drained(monitors.bayes_stream(steps, -9.0), "stream-bayes").select("agent", "slot", "log_l", "flagged")


__all__ = ["QUERIES"]
