"""Joins of many rows to one row each, where single keys may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key counts as heavy beyond this share of all rows, so there are at most as many heavy keys.
HEAVY = 256


def join_to_one(many: DataFrame, one: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join; ``one`` has a row per key and shares no other column name with ``many``.

    Rows of a heavy key are dealt out by a salt, one per HEAVY-th part of all rows; only the
    rows of ``one`` that have such a key are repeated, and the list of heavy keys has at
    most HEAVY rows. ``many`` should be a table: it is read twice.
    """
    share = many.count() // HEAVY + 1
    heavy = many.groupBy(*keys).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > share)
    salts = F.broadcast(heavy.select(*keys, F.ceil(F.col("_rows") / share).alias("_salts")))
    spread = F.coalesce("_salts", F.lit(1))
    left = many.join(salts, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*many.columns), spread)).drop("_salts")
    right = one.join(salts, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), spread - 1))).drop("_salts")
    return left.join(right, [*keys, "_salt"]).drop("_salt")
