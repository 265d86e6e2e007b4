"""Occurrence grids and neighbourhood lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.geo import cell, usable


def cell_counts(df: DataFrame, size: float = 1.0, minimum: int = 1, slug: str = "slug", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """(slug, clat, clon, n) of cells with at least ``minimum`` observations."""
    cells = df.where(usable(F.col(lat), F.col(lon))).select(slug, cell(F.col(lat), size).alias("clat"), cell(F.col(lon), size).alias("clon"))
    return cells.groupBy(slug, "clat", "clon").agg(F.count("*").alias("n")).where(F.col("n") >= minimum)


def nested_index(cells: DataFrame, species: DataFrame | None = None, slug: str = "slug") -> DataFrame:
    """(slug, cells): the sorted list of a species' cells; with ``species``, empty ones are kept."""
    lists = cells.groupBy(slug).agg(F.array_sort(F.collect_list(F.array("clat", "clon"))).alias("cells"))
    if species is None:
        return lists
    empty = F.array().cast("array<array<bigint>>")
    return species.select(slug).distinct().join(lists, slug, "left").withColumn("cells", F.coalesce("cells", empty))


def in_range(points: DataFrame, cells: DataFrame, key: str, size: float = 1.0, slug: str = "slug", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Distinct (key, slug): species with a cell in the 3 x 3 cells around a point.

    Nine offsets make the neighbourhood an equi-join.  Points are first collapsed to the cells
    they lie in, so a popular cell is looked up once.  Nothing wraps at the date line or poles.
    """
    at = points.where(usable(F.col(lat), F.col(lon))).select(key, cell(F.col(lat), size).alias("plat"), cell(F.col(lon), size).alias("plon"))
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    around = at.select("plat", "plon").distinct().select("plat", "plon", F.explode(steps).alias("s")).select("plat", "plon", (F.col("plat") + F.col("s.a")).alias("clat"), (F.col("plon") + F.col("s.b")).alias("clon"))
    near = around.join(cells.select(slug, "clat", "clon").distinct(), ["clat", "clon"]).select("plat", "plon", slug).distinct()
    return at.join(near, ["plat", "plon"]).select(key, slug).distinct()
