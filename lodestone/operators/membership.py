"""A filter of bounded size that knows which hashes a table has, as a broadcast table of bitmaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.storage import stored

#: A bitmap of this many bits is 4 kB, a row; the largest filter has 2^13 rows (32 MB).
_ROW_BITS, _MOST_ROWS = 32_768, 1 << 13
#: Names that no table has.
_BIT, _ROW, _BITS = ("__lodestone_" + n for n in ("bit", "row", "bits"))


def membership(keys: DataFrame, key: str) -> tuple[DataFrame, int]:
    """(bitmaps, how many): a filter that knows which 64-bit hashes ``keys`` has, as a broadcast table.

    A hash sets one bit of a bitmap; there are 16 bits or more a key until the table has reached
    its fixed size (32 MB), however many keys there are.  Past that size, more and more rows pass
    that are not among the keys, and none is ever held back that is: what passes must be tested
    again.  See ``with_membership``.
    """
    n = keys.count()
    rows = 1
    while rows * _ROW_BITS < 16 * n and rows < _MOST_ROWS:
        rows *= 2
    at = keys.select(F.pmod(F.col(key), F.lit(rows * _ROW_BITS)).alias("b")).select(F.floor(F.col("b") / _ROW_BITS).cast("int").alias(_ROW), (F.col("b") % _ROW_BITS).alias("b"))
    bits = stored(at.groupBy(_ROW).agg(F.bitmap_construct_agg("b").alias(_BITS)), "membership")
    return bits, rows


def with_membership(df: DataFrame, hashed: Column, table: tuple[DataFrame, int], name: str) -> DataFrame:
    """``df`` with a flag: false where the hash is certainly not among the table's keys."""
    bits, rows = table
    b = F.pmod(hashed, F.lit(rows * _ROW_BITS))
    there = df.withColumn(_BIT, b).withColumn(_ROW, F.floor(F.col(_BIT) / _ROW_BITS).cast("int"))
    within = F.col(_BIT) % _ROW_BITS
    byte = F.conv(F.hex(F.substring(F.col(_BITS), (F.floor(within / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    flag = F.coalesce(F.getbit(byte, (within % 8).cast("int")) == 1, F.lit(False))
    return there.join(F.broadcast(bits), _ROW, "left").withColumn(name, flag).drop(_BIT, _ROW, _BITS)
