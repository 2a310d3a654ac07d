"""Adapter from the events table to positions and regular trajectory panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.geo import Grid, centre

#: Start of the time axis, slot length in seconds, and slots; all can be passed instead.
ORIGIN_S, SLOT_S, SLOTS = 1704067200, 3600, 720
#: Coarse zones are numbered in this order.
KINDS = ["click", "error", "purchase", "signup", "view"]


def slot_of(ts: Column, origin_s: int = ORIGIN_S, slot_s: int = SLOT_S) -> Column:
    return F.floor((F.unix_micros(ts.cast("timestamp")) / F.lit(1_000_000) - F.lit(origin_s)) / F.lit(slot_s)).cast("long")


def pings(events: DataFrame, slot_s: int = SLOT_S, grid: Grid = Grid()) -> DataFrame:
    """(event_id, agent, ts, slot, zone, coarse, lat, lon, value): one position for each event.

    zone is k of props on a 10 by 10 block of cells; positions are the cell's centre and a fixed
    jitter by event_id that stays inside the cell.
    """
    zone = F.get_json_object("props", "$.k").cast("long")
    jitter = (F.pmod(F.col("event_id") * 7919, F.lit(1000)) / F.lit(1000.0) - F.lit(0.5)) * F.lit(0.0009)
    lat, lon = centre(F.floor(F.col("zone") / 10), F.pmod("zone", F.lit(10)), grid)
    coarse = (F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("event_type")) - 1).cast("long")
    base = events.select("event_id", F.col("user_id").alias("agent"), F.col("ts").cast("timestamp").alias("ts"), slot_of(F.col("ts"), slot_s=slot_s).alias("slot"), zone.alias("zone"), coarse.alias("coarse"), "value")
    return base.withColumn("lat", lat + jitter).withColumn("lon", lon + jitter)


def panel(positions: DataFrame, zone: str = "zone", slots: int = SLOTS) -> DataFrame:
    """(agent, slot, zone): the last position in each slot, carried forward to the next one or to the end.

    Slots before an agent's first position are absent. The gap to the next position is filled
    by exploding its range. Positions are dealt by agent once, which serves the aggregate, the
    gaps, and later windows by agent.
    """
    dealt = positions.select("agent", "slot", "ts", "event_id", zone).filter(F.col(zone).isNotNull()).repartition("agent")
    last = dealt.groupBy("agent", "slot").agg(F.max_by(F.col(zone), F.struct("ts", "event_id")).alias("zone"))
    until = F.coalesce(F.lead("slot").over(Window.partitionBy("agent").orderBy("slot")), F.lit(slots))
    return last.select("agent", "zone", "slot", until.alias("until")).filter("until > slot").select("agent", F.explode(F.sequence(F.col("slot"), F.col("until") - 1)).alias("slot"), "zone")
