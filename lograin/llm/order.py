"""Global positions of rows without sorting in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lograin.session import materialize


def positions(df: DataFrame, keys: list, name: str = "position") -> DataFrame:
    """Add the 0-based position of each row in the order of ``keys``.

    Rows are range partitioned and written with the number of their range; the only
    global step is a running sum over one row per range.
    """
    ranged = materialize(df.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = ranged.groupBy("_range").agg(F.count("*").alias("_n")).select(
        F.col("_range").alias("_start_of"), F.coalesce(before, F.lit(0)).alias("_before")
    )
    local = F.row_number().over(Window.partitionBy("_range").orderBy(*keys)) - 1
    joined = ranged.join(starts, F.col("_range") == F.col("_start_of"))
    return joined.withColumn(name, F.col("_before") + local).drop("_range", "_start_of", "_before")
