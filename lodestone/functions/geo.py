"""Grid cells and coordinate checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cell(degrees: Column, size: float = 1.0) -> Column:
    """The grid index, rounded down: -0.5 lies in cell -1."""
    return F.floor(degrees / F.lit(size))


def usable(lat: Column, lon: Column) -> Column:
    """Both coordinates are there and are numbers."""
    return lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)


def in_bounds(lat: Column, lon: Column) -> Column:
    return lat.between(-90, 90) & lon.between(-180, 180)


def both_or_none(lat: Column, lon: Column) -> Column:
    return lat.isNull() == lon.isNull()


def boosted(similarity: Column, in_range: Column, boost: float) -> Column:
    return similarity + F.when(in_range, F.lit(boost)).otherwise(0.0)
