"""Upsert and insert-ignore over plain tables, as rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.curate import first_per_key


def upsert(target: DataFrame, incoming: DataFrame, key: str, backfill: tuple[str, ...], order: str) -> DataFrame:
    """The target after the incoming rows: new keys are added; for known keys the ``backfill``
    columns take the last incoming value that is not null, and other columns never change."""
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in backfill]
    fixed = [F.min_by(c, order).alias(c) for c in target.columns if c != key and c not in backfill]
    new = incoming.groupBy(key).agg(*last, *fixed)
    t, n = target.select(F.lit(True).alias("_old"), "*").alias("t"), new.alias("n")
    columns = []
    for c in target.columns:
        old, fresh = F.col(f"t.{c}"), F.col(f"n.{c}")
        columns.append((F.coalesce(old, fresh) if c == key else F.coalesce(fresh, old) if c in backfill else F.when(F.col("t._old"), old).otherwise(fresh)).alias(c))
    return t.join(n, F.col(f"t.{key}") == F.col(f"n.{key}"), "full").select(*columns)


def insert_ignore(target: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """The rows to append: the first incoming row of each key that the target does not have."""
    first = first_per_key(incoming, key, order)
    return first.join(target.select(key), key, "left_anti").select(*[c for c in incoming.columns if c in target.columns or c == key])


def numbered(df: DataFrame, order: str, start: int = 1) -> DataFrame:
    """With serial ids, for a small batch of new dimension rows."""
    return df.withColumn("id", F.row_number().over(Window.orderBy(order)) + (start - 1))
