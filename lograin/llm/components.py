"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lograin.session import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """(vertex, component) for every vertex of the (a, b) edges; the component is its smallest vertex.

    Alternates large-star and small-star steps until no edge changes. Every step is a
    partial aggregate of minima joined back, so a vertex of high degree is not one
    task's group, and each round is written to the shared folder.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = materialize(edges), None
    while True:
        both = edges.union(edges.select("b", "a")).toDF("a", "b")
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("u")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = large.join(least, F.col("a") == F.col("u")).select(
            F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")
        )
        following = materialize(small.select("e.*").filter("a <> b").distinct())
        after = following.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(edges)
        edges = following
        if after == before:
            break
        before = after
    roots = edges.select(F.col("b").alias("a"), "b")
    return edges.union(roots).distinct().toDF("vertex", "component")
