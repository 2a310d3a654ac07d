"""Calendar flags of timestamps (session time zone)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def time_indicators(ts: Column, day_start: int, day_end: int) -> dict[str, Column]:
    """is_day, is_night, is_weekday, is_weekend as 0/1; bounds in minutes of the day, over midnight if start is not before end."""
    minute = F.hour(ts) * 60 + F.minute(ts)
    inside = (minute >= day_start) & (minute < day_end) if day_start < day_end else (minute >= day_start) | (minute < day_end)
    weekday = F.weekday(ts) < 5
    return {"is_day": inside.cast("int"), "is_night": (~inside).cast("int"), "is_weekday": weekday.cast("int"), "is_weekend": (~weekday).cast("int")}
