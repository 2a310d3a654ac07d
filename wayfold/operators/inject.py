"""Seeded anomalies and day swaps on panels (keys, slot, zone), all keys at once.

Every random choice is a hash of seed, keys and day, so results don't depend on partitioning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.operators.sequence import sps_triplets
from wayfold.session import kept


def draw(seed: int, *columns: Column) -> Column:
    """A number in [0, 1): the first 40 bits of the MD5 of seed and columns, joined by '|'; any SQL engine can draw it too."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 10), 16, 10).cast("double") / F.lit(float(1 << 40))


def chosen_shifts(panel: DataFrame, keys: list[str], per_day: int, first: int, last: int, min_stay: int = 12, max_shift: int = 60, pick: str = "random", k: int = 0, mode: str = "random", seed: int = 0, attempts: tuple[int, int] | None = None) -> DataFrame:
    """(keys, day, triplet, early, shift): one stay-pass-stay a day in [first, last) and how far it moves.

    pick: 'first', 'k' or 'random'; mode: 'early', 'late' or 'random'. Early: 1 to
    min(max_shift, first stay); late: from 0.7 of min(max_shift, second stay) on. A shift of 0 is left out.
    attempts (from, to): a choice for each attempt, which is a key then.
    """
    return shifts_of(days_of(panel, keys, per_day, first, last, min_stay), keys, max_shift, pick, k, mode, seed, attempts).filter("shift > 0")


def days_of(panel: DataFrame, keys: list[str], per_day: int, first: int, last: int, min_stay: int = 12) -> DataFrame:
    """(keys, day, all): each day in [first, last) with its stay-pass-stays, by their begin."""
    days = sps_triplets(panel, keys, per_day, min_stay).filter((F.col("day") >= first // per_day) & (F.col("day") <= (last - 1) // per_day))
    names = ["s1_start", *(c for c in days.columns if c not in (*keys, "day", "s1_start"))]
    return days.groupBy(*keys, "day").agg(F.sort_array(F.collect_list(F.struct(*names))).alias("all"))


def shifts_of(days: DataFrame, keys: list[str], max_shift: int = 60, pick: str = "random", k: int = 0, mode: str = "random", seed: int = 0, attempts: tuple[int, int] | None = None) -> DataFrame:
    """chosen_shifts() of days_of() a panel, shifts of 0 included: no step is dealt. days may have attempt; further columns stay."""
    more = [c for c in days.columns if c not in (*keys, "day", "all", "attempt")]
    if "attempt" not in keys and (attempts or "attempt" in days.columns):
        keys = [*keys, "attempt"]
    if attempts:
        days = days.withColumn("attempt", F.explode(F.sequence(F.lit(attempts[0]), F.lit(attempts[1] - 1))))
    names = [F.col(c) for c in keys]
    wanted = {"first": F.lit(0), "k": F.lit(k), "random": F.floor(draw(seed, *names, F.col("day"), F.lit(1)) * F.size("all"))}[pick]
    own = days.withColumn("_x", F.get("all", wanted.cast("int")))
    own = (own.filter("_x is not null") if pick == "k" else own).select(*keys, "day", "_x.*", *more)
    early = {"early": F.lit(True), "late": F.lit(False), "random": draw(seed, *names, F.col("day"), F.lit(2)) < 0.5}[mode]
    own = own.withColumn("early", early)
    most = F.least(F.lit(max_shift), F.when(F.col("early"), F.col("s1_end") - F.col("s1_start")).otherwise(F.col("s2_end") - F.col("s2_start")))
    least = F.when(F.col("early"), F.lit(1)).otherwise(F.floor(most * 0.7))
    shift = least + F.floor(draw(seed, *names, F.col("day"), F.lit(3)) * (most - least + 1))
    return own.withColumn("shift", shift.cast("long"))


def injected(panel: DataFrame, shifts: DataFrame, keys: list[str], per_day: int) -> DataFrame:
    """The panel with each day's passage moved by its shift and the gap filled by the zone behind it.

    One join by key and day tells what each slot becomes; moved slots take the zone of the
    panel at slot + shift (early) or slot - shift (late), by a second join on slots.
    """
    own = panel.withColumn("day", F.floor(F.col("slot") / per_day).cast("long")).join(shifts, [*keys, "day"], "left")
    slot, p0, p1, d = F.col("slot"), F.col("s1_end"), F.col("s2_start"), F.col("shift")
    move = F.when(F.col("early"), d).otherwise(-d)
    moved = (slot + move >= p0) & (slot + move < p1)
    filled = F.when(F.col("early"), (slot >= p1 - d) & (slot < p1)).otherwise((slot >= p0) & (slot < p0 + d))
    behind = F.when(F.col("early"), F.col("z2")).otherwise(F.col("z1"))
    told = own.select(*keys, "slot", "zone", F.coalesce(moved, F.lit(False)).alias("_moved"), F.when(F.coalesce(filled, F.lit(False)), behind).alias("_fill"), F.coalesce(slot + move, slot).alias("_from"))
    source = panel.select(*keys, F.col("slot").alias("_from"), F.col("zone").alias("_zone"))
    out = told.join(source, [*keys, "_from"], "left")
    return out.select(*keys, "slot", F.when(F.col("_moved"), F.col("_zone")).when(F.col("_fill").isNotNull(), F.col("_fill")).otherwise(F.col("zone")).alias("zone"))


def _changes(per_day: int, first: int, last: int) -> Column:
    """How many slots of [first, last) injected() would change by a row's shift; _zones has its day's slots (there, zone)."""
    p0, p1, d = F.col("s1_end"), F.col("s2_start"), F.col("shift")
    start = F.col("day") * per_day
    begin, end = F.when(F.col("early"), p0 - d).otherwise(p0), F.when(F.col("early"), p1).otherwise(p1 + d)
    begin, end = F.greatest(begin, start, F.lit(first)), F.least(end, start + per_day, F.lit(last)) - 1
    move, behind = F.when(F.col("early"), d).otherwise(-d), F.when(F.col("early"), F.col("z2")).otherwise(F.col("z1"))
    found = lambda s: F.get("_zones", (s - start).cast("int"))

    def differs(s: Column) -> Column:
        moved = (s + move >= p0) & (s + move < p1)
        return found(s)["there"] & ~F.when(moved, found(s + move)["zone"]).otherwise(behind).eqNullSafe(found(s)["zone"])

    return F.when(begin <= end, F.size(F.filter(F.sequence(begin, end), differs))).otherwise(0)


def inject_until(panel: DataFrame, keys: list[str], per_day: int, first: int, last: int, threshold: float = 0.175, tries: int = 1000, seed: int = 0, **options) -> tuple[DataFrame, DataFrame]:
    """(panel, log): for each key the first of `tries` seeded candidates that changes over threshold of [first, last), else the last one.

    log has keys, attempt, changed and success (changed >= threshold). Rounds of 8, 40, 200 and so on
    candidates are made for the keys that have not passed, each round written to the checkpoint
    folder. What a choice changes is counted from its day's zones, an array that lies in the same row.
    """
    panel = kept(panel)
    inside = F.col("slot").between(first, last - 1)
    pending = kept(panel.filter(inside).groupBy(*keys).agg(F.count(F.lit(1)).alias("_size")))
    own, drawn = [*keys, "attempt"], {c: options.pop(c) for c in ("max_shift", "pick", "k", "mode") if c in options}
    zones = panel.withColumn("day", F.floor(F.col("slot") / per_day).cast("long")).groupBy(*keys, "day").agg(F.map_from_entries(F.collect_list(F.struct("slot", "zone"))).alias("_zones"))
    slots = F.sequence(F.col("day") * per_day, F.col("day") * per_day + (per_day - 1))
    zones = zones.select(*keys, "day", F.transform(slots, lambda s: F.struct(F.map_contains_key("_zones", s).alias("there"), F.try_element_at("_zones", s).alias("zone"))).alias("_zones"))
    days = kept(days_of(panel, keys, per_day, first, last, **options).join(zones, [*keys, "day"]))
    tasks = max(4 * panel.sparkSession.sparkContext.defaultParallelism, int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    logs, shifts, start, size = [], [], 0, 8
    while start < tries:
        stop = min(tries, start + size)
        left = days.join(pending.select(*keys), keys, "left_semi").repartition(tasks, *keys)  # few bytes, much work: not to be coalesced
        made = shifts_of(left, keys, seed=seed, attempts=(start, stop), **drawn)
        total = made.select(*own, _changes(per_day, first, last).alias("_c")).groupBy(*own).agg(F.sum("_c").alias("_c"))
        every = pending.withColumn("attempt", F.explode(F.sequence(F.lit(start), F.lit(stop - 1))))
        share = every.join(total, own, "left").withColumn("changed", F.coalesce("_c", F.lit(0)) / F.col("_size"))
        order = F.when(F.col("changed") > threshold, F.col("attempt")).otherwise(2 * stop - F.col("attempt"))
        best = kept(share.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("_r = 1").select(*own, "changed", "_size"))
        over = best if stop == tries else best.filter(F.col("changed") > threshold)
        logs.append(over.select(*own, "changed"))
        shifts.append(shifts_of(days.drop("_zones").join(over.select(*own), keys), keys, seed=seed, **drawn).filter("shift > 0").drop("attempt"))
        pending = best.filter(F.col("changed") <= threshold).select(*keys, "_size")
        if stop == tries or pending.isEmpty():
            break
        start, size = stop, 5 * size
    log = reduce(DataFrame.unionByName, logs).withColumn("success", F.col("changed") >= threshold)
    return injected(panel, reduce(DataFrame.unionByName, shifts), keys, per_day), log


def day_swaps(panel: DataFrame, keys: list[str], per_day: int, first: int, last: int, seed: int = 0) -> DataFrame:
    """(keys, day, from_day): each day in [first, last) and a distinct earlier day, drawn without replacement, trade places.

    first and last are day borders; there must be as many earlier days as days in the window.
    """
    if first % per_day or last % per_day or first // per_day < (last - first) // per_day:
        raise ValueError("the window must lie on day borders, after as many days as it has")
    start, days = first // per_day, (last - first) // per_day
    agents = panel.select(*keys).distinct()
    early = agents.withColumn("_e", F.explode(F.sequence(F.lit(0), F.lit(start - 1))))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(draw(seed, *[F.col(c) for c in keys], F.col("_e")), "_e"))
    pairs = early.withColumn("_k", rank).filter(F.col("_k") <= days).withColumn("_l", F.lit(start - 1) + F.col("_k"))
    one = pairs.select(*keys, F.col("_l").cast("long").alias("day"), F.col("_e").cast("long").alias("from_day"))
    return one.unionByName(pairs.select(*keys, F.col("_e").cast("long").alias("day"), F.col("_l").cast("long").alias("from_day")))


def swapped(panel: DataFrame, swaps: DataFrame, keys: list[str], per_day: int) -> DataFrame:
    """The panel with days exchanged."""
    own = panel.withColumn("from_day", F.floor(F.col("slot") / per_day).cast("long"))
    out = own.join(swaps, [*keys, "from_day"], "left")
    slot = F.coalesce(F.col("day") * per_day + F.pmod("slot", F.lit(per_day)), F.col("slot"))
    return out.select(*keys, slot.alias("slot"), "zone")
