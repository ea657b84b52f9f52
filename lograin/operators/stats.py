"""Counts per origin and template, for whole inputs and reporting intervals."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lograin.functions.json_shape import with_shape
from lograin.functions.patterns import LEVEL_NAMES
from lograin.functions.text import with_message
from lograin.functions.times import micros
from lograin.params import Params
from lograin.sources.entries import FILE_SOURCE


def severity_filter(entries: DataFrame, params: Params) -> DataFrame:
    return entries.filter(F.col("level").isin(*params.severity_levels))


#: Levels in the order of their codes.
_LEVELS = ("", *LEVEL_NAMES)
_CODES = 16


def first_entry() -> Column:
    """Place of the earliest entry and the code of its level, as one number.

    Time, then ``event_id``, then the level's code are its digits, so the level of
    the first entry is a plain minimum: its buffer has a fixed width, which keeps the
    aggregation hashed, and partial results merge by another minimum.
    """
    code = F.array_position(F.array(*map(F.lit, _LEVELS)), F.col("level")) - 1
    wide = "decimal(38,0)"
    number = F.coalesce("event_id", F.lit(0)).cast("decimal(20,0)") + F.lit(Decimal(1 << 63))
    place = micros(F.col("ts")).cast("decimal(18,0)") * F.lit(Decimal(1 << 64))
    return F.min((place + number).cast("decimal(36,0)") * F.lit(Decimal(_CODES)) + code.cast(wide)).cast(wide)


def level_of(first: Column) -> Column:
    """Level that a number of :func:`first_entry` holds."""
    code = F.pmod(first, F.lit(Decimal(_CODES))).cast("int")
    return F.get(F.array(*map(F.lit, _LEVELS)), code)


def partial_measures() -> list[Column]:
    """Measures that merge; see :func:`merged_measures`."""
    return [
        F.count("*").alias("count"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
        first_entry().alias("first_entry"),
    ]


def merged_measures() -> list[Column]:
    return [
        F.sum("count").alias("count"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.min("first_entry").alias("first_entry"),
    ]


def with_level(measured: DataFrame) -> DataFrame:
    names = [name for name in measured.columns if name != "first_entry"]
    return measured.select(*names, level_of(F.col("first_entry")).alias("level"))


def log_stats(entries: DataFrame, params: Params) -> DataFrame:
    """Count, first and last occurrence and level per (source, message)."""
    return with_level(with_message(entries, params).groupBy("source", "message").agg(*partial_measures()))


def file_stats(entries: DataFrame, params: Params, keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts of lines read from files, which carry no time of their own."""
    return with_message(entries, params).groupBy(*keys, "source", "message").agg(F.count("*").alias("count"))


def nonempty_shape(documents: DataFrame) -> DataFrame:
    """Documents that have a fingerprint."""
    return documents.filter("shape <> ''")


def json_shape_counts(documents: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Documents per fingerprint; documents without one do not count."""
    shapes = nonempty_shape(with_shape(documents.select(*keys, "document")))
    counts = shapes.groupBy(*keys, F.col("shape").alias("message")).agg(F.count("*").alias("count"))
    return counts.select(*keys, F.lit(FILE_SOURCE).alias("source"), "message", "count")


def interval_parts(entries: DataFrame, params: Params) -> DataFrame:
    """Mergeable statistics of every reporting interval in ``entries``."""
    measured = (
        with_message(entries, params)
        .groupBy(F.window("ts", params.interval), "source", "message")
        .agg(*partial_measures())
    )
    return measured.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        "source", "message", "count", "first_seen", "last_seen", "first_entry",
    )


def interval_report(entries: DataFrame, params: Params) -> DataFrame:
    """Statistics of every reporting interval, intervals without rows absent."""
    return with_level(interval_parts(entries, params))


def with_report_day(intervals: DataFrame, params: Params) -> DataFrame:
    """Name the day, beginning at the configured hour, an interval starts in."""
    day = F.window("window_start", "1 day", "1 day", params.day_offset)
    return intervals.withColumn("report_day", day["start"])


def daily_report(entries: DataFrame, params: Params, merge: bool = False) -> DataFrame:
    """Interval batches of each day, listed one after another.

    ``merge`` folds the batches of a day into one row per message.
    """
    parts = with_report_day(interval_parts(entries, params), params)
    if not merge:
        return with_level(parts)
    return with_level(parts.groupBy("report_day", "source", "message").agg(*merged_measures()))


def interval_union(*batches: DataFrame) -> DataFrame:
    """List interval batches together without merging their rows."""
    union, *others = batches
    for batch in others:
        union = union.unionByName(batch)
    return union


def final_report(entries: DataFrame, params: Params) -> DataFrame:
    """Statistics of the interval that is still open at the last entry.

    Its start is a scalar, so the scan reads no earlier entries.
    """
    last = entries.agg(F.max("ts").alias("ts"))
    start = last.select(F.window("ts", params.interval)["start"].alias("start"))
    return interval_report(entries.filter(F.col("ts") >= start.scalar()), params)


def nonempty_report(intervals: DataFrame) -> DataFrame:
    """Intervals that have anything to report, with their number of rows."""
    return intervals.groupBy("window_start", "window_end").agg(F.count("*").alias("messages"))
