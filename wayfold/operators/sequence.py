"""Runs, stays and what follows from them. Series are long: keys, an integer slot, and a value."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.geo import haversine_m
from wayfold.functions.numeric import ratio


def with_runs(series: DataFrame, keys: list[str], value: str = "zone") -> DataFrame:
    """series and run_id: a number that grows with each change of value or gap in slots."""
    w = Window.partitionBy(*keys).orderBy("slot")
    change = F.coalesce(~F.lag(value).over(w).eqNullSafe(F.col(value)) | (F.col("slot") - F.lag("slot").over(w) != 1), F.lit(True))
    return series.withColumn("_c", change.cast("long")).withColumn("run_id", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_c")


def runs(series: DataFrame, keys: list[str], value: str = "zone") -> DataFrame:
    """(keys, value, run_start, run_end, len): maximal runs; run_end is exclusive."""
    own = with_runs(series, keys, value).groupBy(*keys, "run_id", value).agg(F.min("slot").alias("run_start"), (F.max("slot") + 1).alias("run_end"), F.count(F.lit(1)).alias("len"))
    return own.drop("run_id")


def stay_lengths(series: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, zone, lens): the run lengths of each zone, in time order."""
    ordered = F.sort_array(F.collect_list(F.struct("run_start", "len")))
    return runs(series, keys).groupBy(*keys, "zone").agg(F.transform(ordered, lambda r: r["len"]).alias("lens"))


def staying_split(run_table: DataFrame, keys: list[str], need_two_long: bool = True) -> DataFrame:
    """(keys, zone, mean_len, staying): staying if the mean run exceeds 1 and, if asked, two runs do."""
    own = run_table.groupBy(*keys, "zone").agg(F.avg("len").alias("mean_len"), F.count_if(F.col("len") > 1).alias("_long"))
    rule = (F.col("mean_len") > 1) & ((F.col("_long") >= 2) if need_two_long else F.lit(True))
    return own.select(*keys, "zone", "mean_len", rule.alias("staying"))


#: Lower bounds of mean stay in slots and the buckets' names, longest first.
BUCKETS = [(96, "a_8h"), (48, "b_4h"), (24, "c_2h"), (0, "d_0h")]


def bucket(length: Column, buckets: list[tuple[int, str]] = BUCKETS) -> Column:
    out = None
    for low, name in buckets:
        out = F.when(length >= low, name) if out is None else out.when(length >= low, name)
    return out


def bucket_histogram(split: DataFrame, keys: list[str], buckets=BUCKETS) -> DataFrame:
    """(bucket, n_zones, n_agents): how many agents have n_zones staying zones in a bucket, zero included."""
    staying = split.filter("staying").withColumn("bucket", bucket(F.col("mean_len"), buckets)).groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("n"))
    names = split.select(*keys).distinct().withColumn("bucket", F.explode(F.array(*[F.lit(b) for _, b in buckets])))
    return names.join(staying, [*keys, "bucket"], "left").groupBy("bucket", F.coalesce("n", F.lit(0)).alias("n_zones")).agg(F.count(F.lit(1)).alias("n_agents"))


def bucket_contingency(split: DataFrame, buckets=BUCKETS) -> DataFrame:
    """(b1, b2, n): zones that some agent stays in by the (truncated) mean of b1, and some by that of b2."""
    zones = split.filter("staying").select("zone", bucket(F.floor("mean_len"), buckets).alias("b")).distinct()
    return zones.withColumnRenamed("b", "b1").join(zones.withColumnRenamed("b", "b2"), "zone").groupBy("b1", "b2").agg(F.count(F.lit(1)).alias("n"))


def classify_zones(series: DataFrame, keys: list[str], min_stay: int = 6) -> DataFrame:
    """(keys, zone, share, staying, rank): staying if any run reaches min_stay; ranked by share, then zone."""
    own = runs(series, keys).groupBy(*keys, "zone").agg(F.sum("len").alias("_n"), F.max("len").alias("_longest"))
    w = Window.partitionBy(*keys)
    rank = F.row_number().over(w.orderBy(F.desc("_n"), "zone"))
    return own.select(*keys, "zone", ratio(F.col("_n"), F.sum("_n").over(w)).alias("share"), (F.col("_longest") >= min_stay).alias("staying"), rank.cast("long").alias("rank"))


def day_runs(series: DataFrame, keys: list[str], per_day: int) -> DataFrame:
    """Runs cut at day borders, with day."""
    return runs(series.withColumn("day", F.floor(F.col("slot") / per_day).cast("long")), [*keys, "day"])


def sps_triplets(series: DataFrame, keys: list[str], per_day: int, min_stay: int) -> DataFrame:
    """(keys, day, s1_start, s1_end, s2_start, s2_end, z1, z2): each stay of a day with the next stay that begins after a gap.

    A stay is a day's run of at least min_stay slots in a zone that has such a run anywhere in
    the key's series. Since runs of a day are disjoint, the next stay after a gap is the first
    or the second that follows.
    """
    zones = runs(series, keys).filter(F.col("len") >= min_stay).select(*keys, "zone").distinct()
    stays = day_runs(series, keys, per_day).filter(F.col("len") >= min_stay).join(zones, [*keys, "zone"], "left_semi")
    w = Window.partitionBy(*keys, "day").orderBy("run_start")
    nxt = [F.lead(F.struct(F.col("run_start").alias("s"), F.col("run_end").alias("e"), F.col("zone").alias("z")), k).over(w) for k in (1, 2)]
    later = stays.select(*keys, "day", "run_start", "run_end", "zone", nxt[0].alias("n1"), nxt[1].alias("n2"))
    found = F.when(F.col("n1.s") > F.col("run_end"), F.col("n1")).otherwise(F.col("n2"))
    out = later.withColumn("n", found).filter("n is not null and n.s > run_end")
    return out.select(*keys, "day", F.col("run_start").alias("s1_start"), F.col("run_end").alias("s1_end"), F.col("n.s").alias("s2_start"), F.col("n.e").alias("s2_end"), F.col("zone").alias("z1"), F.col("n.z").alias("z2"))


def merged_intervals(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, stop): maximal intervals of consecutive slots; stop is exclusive."""
    w = Window.partitionBy(*keys).orderBy("slot")
    own = points.select(*keys, "slot").distinct().withColumn("_g", F.col("slot") - F.row_number().over(w))
    return own.groupBy(*keys, "_g").agg(F.min("slot").alias("start"), (F.max("slot") + 1).alias("stop")).drop("_g")


def run_length(series: DataFrame, keys: list[str], identifier: int = 1, value: str = "y") -> DataFrame:
    """series and run_len: length so far on rows that equal the identifier; on another value, the length just ended.

    An absent slot or a null value resets the count.
    """
    own = with_runs(series, keys, value)
    at = F.row_number().over(Window.partitionBy(*keys, "run_id").orderBy("slot"))
    own = own.withColumn("_len", F.when(F.col(value) == identifier, at))
    w = Window.partitionBy(*keys).orderBy("slot")
    before = F.when(F.col("slot") - F.lag("slot").over(w) == 1, F.coalesce(F.lag("_len").over(w), F.lit(0))).otherwise(0)
    return own.withColumn("run_len", F.when(F.col(value) == identifier, F.col("_len")).when(F.col(value).isNotNull(), before).cast("long")).drop("_len", "run_id")


def frame_of(decay: float) -> int:
    """Values after which decay to the power of their age is below what a double's sum keeps."""
    if not 0 <= decay < 1:
        raise ValueError("decay must be from 0 to below 1")
    return 1 if decay == 0 else math.ceil(math.log(1e-17) / math.log(decay))


def decayed_mean_stay(series: DataFrame, keys: list[str], identifier: int = 1, decay: float = 0.8, value: str = "y") -> DataFrame:
    """run_length() and mean_stay: mean of run lengths completed so far, older ones weighted by decay; null before the first."""
    own = run_length(series, keys, identifier, value)
    ended = own.withColumn("_done", F.when((F.col(value) != identifier) & (F.col("run_len") > 0), F.col("run_len").cast("double")))
    w = Window.partitionBy(*keys).orderBy("slot")
    number = F.sum(F.when(F.col("_done").isNotNull(), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ended = ended.withColumn("_k", number)
    done = ended.filter("_done is not null").select(*keys, "_k", "_done")
    recent = F.collect_list("_done").over(Window.partitionBy(*keys).orderBy("_k").rowsBetween(-(frame_of(decay) - 1), 0))
    total = F.aggregate("_l", F.lit(0.0), lambda a, x: a * decay + x)
    weight = F.aggregate("_l", F.lit(0.0), lambda a, x: a * decay + 1.0)
    means = done.withColumn("_l", recent).select(*keys, "_k", (total / weight).alias("mean_stay"))
    return ended.join(means, [*keys, "_k"], "left").drop("_k", "_done")


def leave_pressure(series: DataFrame, keys: list[str], decay: float = 0.8, threshold: float = 6.0) -> DataFrame:
    """decayed_mean_stay() and pressure: how far the present stay is beyond the mean less the threshold, 0 at least."""
    own = decayed_mean_stay(series, keys, 1, decay)
    return own.withColumn("pressure", F.greatest(F.col("run_len") - (F.col("mean_stay") - threshold), F.lit(0.0)))


def signed_leave_gate(cells: DataFrame, keys: list[str], decay: float = 0.8, threshold: float = 6.0) -> DataFrame:
    """cells (keys, origin, dest, slot, y) and gate: whether the present run is longer than the mean less the threshold.

    Rows with origin = dest count runs of 1 and get minus the indicator, others runs of 0 and
    plus; null while there is no mean.
    """
    od = [*keys, "origin", "dest"]
    out = []
    for same, identifier, sign in ((True, 1, -1.0), (False, 0, 1.0)):
        part = cells.filter((F.col("origin") == F.col("dest")) == F.lit(same))
        own = decayed_mean_stay(part, od, identifier, decay)
        over = F.round(F.col("run_len") - (F.col("mean_stay") - threshold), 9) > 0  # ties must not hang on rounding
        out.append(own.select(*od, "slot", "y", F.when(F.col("mean_stay").isNotNull(), over.cast("double") * sign).alias("gate")))
    return out[0].unionByName(out[1])


def drop_beyond_streak(rows: DataFrame, keys: list[str], order: list[str], most: int = 2, value: str = "y") -> DataFrame:
    """rows without those that come after `most` equal values in a row within their keys."""
    w = Window.partitionBy(*keys).orderBy(*order)
    change = F.coalesce(F.lag(value).over(w) != F.col(value), F.lit(True)).cast("long")
    own = rows.withColumn("_c", change).withColumn("_run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.row_number().over(Window.partitionBy(*keys, "_run").orderBy(*order))
    return own.withColumn("_at", at).filter(F.col("_at") <= most).drop("_c", "_run", "_at")


def dwell(series: DataFrame, keys: list[str]) -> DataFrame:
    """series and dwell_len: the whole length of the run that each row is in."""
    own = with_runs(series, keys)
    return own.withColumn("dwell_len", F.count(F.lit(1)).over(Window.partitionBy(*keys, "run_id"))).drop("run_id")


def dwell_positions(positions: DataFrame, keys: list[str], order: list[str], tolerance: float = 1e-6, least: int = 5) -> DataFrame:
    """positions with dwell_len and staying: the length of the run of positions that each differ from the one before by up to
    tolerance degrees (and 1e-5 of it) in both coordinates, and whether that is at least `least`. A null position is a run of its own.
    """
    w = Window.partitionBy(*keys).orderBy(*order)

    def close(c: str) -> Column:
        before = F.lag(c).over(w)
        return F.coalesce(F.abs(F.col(c) - before) <= tolerance + 1e-5 * F.abs(before), F.lit(False))

    own = positions.withColumn("_c", (~(close("lat") & close("lon"))).cast("long"))
    own = own.withColumn("_run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    length = F.count(F.lit(1)).over(Window.partitionBy(*keys, "_run"))
    return own.withColumn("dwell_len", length).withColumn("staying", F.col("dwell_len") >= least).drop("_c", "_run")


def step_lengths(positions: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """positions and step_m: great-circle metres from the position before; 0 for the first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    step = haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    return positions.withColumn("step_m", F.coalesce(step, F.lit(0.0)))


def hold_adjusted(positions: DataFrame, keys: list[str], order: list[str], threshold_m: float = 50.0) -> DataFrame:
    """step_lengths() and lat_adj, lon_adj: steps up to the threshold hold the adjusted position before.

    The loop is a forward fill of the last position that moved.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    own = step_lengths(positions, keys, order)
    moved = (F.col("step_m") > threshold_m) | (F.row_number().over(w) == 1)
    own = own.withColumn("_moved", moved)
    frame = w.rowsBetween(Window.unboundedPreceding, 0)
    for name in ("lat", "lon"):
        own = own.withColumn(f"{name}_adj", F.last(F.when(F.col("_moved"), F.col(name)), ignorenulls=True).over(frame))
    return own.drop("_moved")
