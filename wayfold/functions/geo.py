"""Grid and great-circle column functions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6371008.8


@dataclass(frozen=True)
class Grid:
    """A latitude/longitude grid of square cells. The defaults are fixed values of the data model."""

    lat_min: float = 35.51009030444566
    lat_max: float = 36.5818509
    lon_min: float = -84.95347326088375
    lon_max: float = -83.70374631780497
    cell: float = 0.01

    @property
    def rows(self) -> int:
        return math.ceil((self.lat_max - self.lat_min) / self.cell)

    @property
    def cols(self) -> int:
        return math.ceil((self.lon_max - self.lon_min) / self.cell)


def _at(value: Column, low: float, cell: float, n: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((value - F.lit(low)) / F.lit(cell))))


def zone_index(lat: Column, lon: Column, grid: Grid = Grid()) -> Column:
    """Flat cell number; points beyond the bounds fold into the edge cells."""
    return (_at(lat, grid.lat_min, grid.cell, grid.rows) * grid.cols + _at(lon, grid.lon_min, grid.cell, grid.cols)).cast("long")


def zone_row(zone: Column, grid: Grid = Grid()) -> Column:
    return F.floor(zone / F.lit(grid.cols)).cast("long")


def zone_col(zone: Column, grid: Grid = Grid()) -> Column:
    return F.pmod(zone, F.lit(grid.cols)).cast("long")


def centre(row: Column, col: Column, grid: Grid = Grid()) -> tuple[Column, Column]:
    """Latitude and longitude of a cell's centre."""
    return F.lit(grid.lat_min) + (row + F.lit(0.5)) * F.lit(grid.cell), F.lit(grid.lon_min) + (col + F.lit(0.5)) * F.lit(grid.cell)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))
