"""Maps of ids in a fixed number of bits, to keep unneeded rows out of a shuffle.

A map never loses an id; other ids may share its bit. It only thins out the rows before
an exact join, and beyond its size it lets more of them through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lograin.session import materialize

BITS = 24
BUCKET_BITS = 15


def _bit(key: Column) -> Column:
    return F.coalesce(key, F.lit(0)).cast("long").bitwiseAND((1 << BITS) - 1)


def id_map(ids: DataFrame, key: str) -> DataFrame:
    """(bucket, bits): at most 512 rows of 4 KB."""
    bit = _bit(F.col(key))
    inside = bit.bitwiseAND((1 << BUCKET_BITS) - 1)
    built = ids.groupBy(F.shiftright(bit, BUCKET_BITS).alias("bucket")).agg(F.bitmap_construct_agg(inside).alias("bits"))
    return materialize(built)


def _holds(bit: Column, bits: Column) -> Column:
    inside = bit.bitwiseAND((1 << BUCKET_BITS) - 1)
    byte = F.conv(F.hex(F.substring(bits, (F.shiftright(inside, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.pow(F.lit(2), inside.bitwiseAND(7)).cast("int")) != 0


def thin(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows whose ``key`` may be in ``ids``; follow it with the exact join."""
    return split_by_map(rows, F.col(key), ids)[0]


def split_by_map(rows: DataFrame, key: Column, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose key may be in ``ids``, and rows whose key is not."""
    bit, bucket, bits = _bit(key), free_name(rows, "bucket"), free_name(rows, "bits")
    small = F.broadcast(ids.select(F.col("bucket").alias(bucket), F.col("bits").alias(bits)))  # 2 MB at most
    met = rows.join(small, F.shiftright(bit, BUCKET_BITS) == F.col(bucket), "left")
    hit = F.coalesce(_holds(bit, F.col(bits)), F.lit(False))
    return met.filter(hit).select(*rows.columns), met.filter(~hit).select(*rows.columns)


def free_name(rows: DataFrame, wanted: str) -> str:
    """``wanted``, or a longer name that no column of ``rows`` has."""
    taken = {c.lower() for c in rows.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
