"""Kernel smoothing over time of day and earlier days, as two passes: an exploded slot pass and a day window.

The weight of cell (d', s') for target (d, s) is exp(-(d - d') / decay_days) for d' <= d times
exp(-(delta / h)^2) for circular slot distance delta <= W. It is separable, so no day-by-slot
product is ever formed; each cell meets 2 W + 1 targets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.numeric import day_index, slot_of_day


def offsets(per_day: int, reach: int) -> list[tuple[int, int]]:
    """(shift, distance) of each target slot within reach, each slot of the day once."""
    found: dict[int, tuple[int, int]] = {}
    for o in sorted(range(-reach, reach + 1), key=abs):
        found.setdefault(o % per_day, (o, abs(o)))
    return sorted(found.values())


def day_slot_cells(series: DataFrame, per_day: int) -> DataFrame:
    """series (slot, ...) with day and s, the slot of the day."""
    return series.withColumn("day", day_index(F.col("slot"), per_day)).withColumn("s", slot_of_day(F.col("slot"), per_day))


def _spread(cells: DataFrame, keys: list[str], per_day: int, reach: int, names: list[str]) -> DataFrame:
    """Each cell to every target slot in reach on its day: (keys, day, t, s, dist, names)."""
    steps = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(d).alias("dist")) for o, d in offsets(per_day, reach)])
    out = cells.select(*keys, "day", "s", *names, F.explode(steps).alias("_x"))
    return out.select(*keys, "day", F.pmod(F.col("s") + F.col("_x.o"), F.lit(per_day)).cast("long").alias("t"), "s", F.col("_x.dist").alias("dist"), *names)


def smoothed_sums(cells: DataFrame, keys: list[str], per_day: int, h: int, reach: int, decay_days: float, names: list[str], same_day: bool = True, compat_gap: bool = False) -> DataFrame:
    """(keys, day, s, names): kernel-weighted sums of each name for every slot in reach of a cell.

    Same-day cells count if they are earlier (same_day). compat_gap leaves out the slot just
    before too, and lets slot 0 see all of its day but the last slot, as the original method does.
    """
    near = _spread(cells, keys, per_day, reach, names).withColumn("_w", F.exp(-F.pow(F.col("dist") / F.lit(float(h)), 2)))
    early = F.col("s") < F.col("t")
    if compat_gap:
        early = F.when(F.col("t") == 0, F.col("s") < per_day - 1).otherwise(F.col("s") < F.col("t") - 1)
    sums = []
    for n in names:
        sums.append(F.sum(F.col("_w") * F.col(n)).alias(f"_a_{n}"))
        sums.append(F.sum(F.when(early, F.col("_w") * F.col(n)).otherwise(0.0)).alias(f"_e_{n}"))
    own = near.groupBy(*keys, "day", F.col("t").alias("s")).agg(*sums)
    past = Window.partitionBy(*keys, "s").orderBy("day").rangeBetween(Window.unboundedPreceding, -1)
    growth, fade = F.exp(F.col("day") / F.lit(decay_days)), F.exp(-F.col("day") / F.lit(decay_days))
    made = []
    for n in names:
        before = F.coalesce(F.sum(growth * F.col(f"_a_{n}")).over(past), F.lit(0.0)) * fade
        made.append((before + (F.col(f"_e_{n}") if same_day else F.lit(0.0))).alias(n))
    return own.select(*keys, "day", "s", *made)


def _bins(minutes: float, slot_minutes: float) -> int:
    return max(1, round(minutes / slot_minutes))


def binomial_forecast(series: DataFrame, keys: list[str], per_day: int, h_minutes: float = 30, reach_minutes: float = 60, decay_days: float = 5.0, alpha: float = 1.0, beta: float = 1.0, same_day: bool = True, every: bool = False) -> DataFrame:
    """(keys, slot, value): Beta posterior mean of y out of n by what came before; rows with n > 0 only, or every row.

    series (keys, slot, y, n). Without any earlier weight the prior mean.
    """
    minutes = 1440 / per_day
    cells = day_slot_cells(series if every else series.filter("n > 0"), per_day)
    sums = smoothed_sums(cells, keys, per_day, _bins(h_minutes, minutes), _bins(reach_minutes, minutes), decay_days, ["y", "n"], same_day)
    targets = cells.select(*keys, "slot", "day", "s").join(sums, [*keys, "day", "s"])
    return targets.select(*keys, "slot", ((F.lit(alpha) + F.col("y")) / (F.lit(alpha + beta) + F.col("n"))).alias("value"))


def binary_forecast(series: DataFrame, keys: list[str], per_day: int, h_minutes: float = 15, reach_minutes: float = 90, decay_days: float = 14.0, alpha: float = 0.5, beta: float = 0.5, same_day: bool = False) -> DataFrame:
    """binomial_forecast() of a 0/1 series y; null y is left out."""
    own = series.filter("y is not null").withColumn("n", F.lit(1))
    return binomial_forecast(own, keys, per_day, h_minutes, reach_minutes, decay_days, alpha, beta, same_day)


def count_forecast(series: DataFrame, keys: list[str], per_day: int, h_minutes: float = 30, reach_minutes: float = 60, decay_days: float = 5.0, a0: float = 1.0, b0: float = 1.0, compat_gap: bool = False) -> DataFrame:
    """(keys, slot, value): Gamma-Poisson mean of counts n (zero cells included) by what came before."""
    minutes = 1440 / per_day
    cells = day_slot_cells(series.filter("n is not null").withColumn("w", F.lit(1.0)), per_day)
    sums = smoothed_sums(cells, keys, per_day, _bins(h_minutes, minutes), _bins(reach_minutes, minutes), decay_days, ["n", "w"], True, compat_gap)
    targets = cells.select(*keys, "slot", "day", "s").join(sums, [*keys, "day", "s"])
    return targets.select(*keys, "slot", ((F.lit(a0) + F.col("n")) / (F.lit(b0) + F.col("w"))).alias("value"))


def switch_probability(series: DataFrame, keys: list[str], per_day: int, reach_minutes: float = 60, discount: float = 1.0, alpha: float = 0.5, beta: float = 0.5) -> DataFrame:
    """(keys, slot, value): share of earlier days whose window around the slot has a 1, among those with any value.

    Older days count discount to the power of their age; smoothed by a Beta prior.
    """
    reach = max(0, round(reach_minutes / (1440 / per_day)))
    cells = day_slot_cells(series.filter("y is not null"), per_day)
    near = _spread(cells, keys, per_day, reach, ["y"]).groupBy(*keys, "day", F.col("t").alias("s"))
    days = near.agg(F.max((F.col("y") == 1).cast("double")).alias("_one")).withColumn("_any", F.lit(1.0))
    past = Window.partitionBy(*keys, "s").orderBy("day").rangeBetween(Window.unboundedPreceding, -1)
    rate = math.log(discount)

    def total(name: str) -> Column:
        return F.coalesce(F.sum(F.exp(F.lit(-rate) * F.col("day")) * F.col(name)).over(past), F.lit(0.0)) * F.exp(F.lit(rate) * F.col("day"))

    hist = days.select(*keys, "day", "s", total("_one").alias("_num"), total("_any").alias("_den"))
    targets = cells.select(*keys, "slot", "day", "s").join(hist, [*keys, "day", "s"])
    return targets.select(*keys, "slot", ((F.lit(alpha) + F.col("_num")) / (F.lit(alpha + beta) + F.col("_den"))).alias("value"))


def ewm_mean(series: DataFrame, keys: list[str], span: float, value: str = "value") -> DataFrame:
    """value becomes its exponentially weighted mean over earlier rows, weights (1 - 2 / (span + 1)) to the age."""
    keep = 1 - 2 / (span + 1)
    frame = 1 if keep <= 0 else math.ceil(math.log(1e-17) / math.log(keep))
    w = Window.partitionBy(*keys).orderBy("slot").rowsBetween(-(frame - 1), 0)
    own = series.withColumn("_l", F.collect_list(value).over(w))
    num = F.aggregate("_l", F.lit(0.0), lambda a, x: a * keep + x)
    den = F.aggregate("_l", F.lit(0.0), lambda a, x: a * keep + 1.0)
    return own.withColumn(value, num / den).drop("_l")


def empirical_probability(cells: DataFrame, keys: list[str], per_day: int, span: float = 1.0) -> DataFrame:
    """(keys, kind, slot, value): binary_forecast() for staying_to_self pairs, smoothed switch_probability() for the others.

    cells has keys, kind, slot and y on the slots where the pair is asked.
    """
    own = [*keys, "kind"]
    stays = binary_forecast(cells.filter("kind = 'staying_to_self'"), own, per_day)
    others = ewm_mean(switch_probability(cells.filter("kind != 'staying_to_self'"), own, per_day), own, span)
    return stays.unionByName(others)
