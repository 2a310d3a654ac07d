"""Scalar transforms of probabilities and counts, and slot arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clipped(p: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), p))


def logit(p: Column, eps: float = 1e-9, bound: float = 10.0) -> Column:
    """ln(p / (1 - p)) of p clipped to [eps, 1 - eps], itself clipped to [-bound, bound]; null stays null."""
    q = clipped(p, eps, 1 - eps)
    return F.when(p.isNotNull(), clipped(F.ln(q / (1 - q)), -bound, bound))


def day_index(slot: Column, per_day: int) -> Column:
    return F.floor(slot / F.lit(per_day)).cast("long")


def slot_of_day(slot: Column, per_day: int) -> Column:
    return F.pmod(slot, F.lit(per_day)).cast("long")


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))
