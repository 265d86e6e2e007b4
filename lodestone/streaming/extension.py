"""Streaming forms of two operators.  An extension: batch is the engine's main mode."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lodestone.operators.geo import cell_counts


def first_per_key_stream(stream: DataFrame, key: str, event_time: str, delay: str = "10 minutes") -> DataFrame:
    """Drops rows whose key was seen within the watermark's delay; older state is let go."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def known_cells_stream(stream: DataFrame, history: DataFrame, size: float = 1.0, slug: str = "slug") -> DataFrame:
    """A stream of observations with how often history saw their species in their cell."""
    from pyspark.sql import functions as F

    from lodestone.functions.geo import cell

    known = cell_counts(history, size, slug=slug)
    at = stream.withColumn("clat", cell(F.col("lat"), size)).withColumn("clon", cell(F.col("lon"), size))
    return at.join(known, [slug, "clat", "clon"], "left")
