"""Report lines: a title, then per origin its messages, most frequent first.

Lines are rows that carry the columns they are ordered by, so a report of any
size is written by a range-partitioned sort (see ``sources.sinks``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lograin.functions.times import clock
from lograin.params import Params

# Texts readers of the reports look for.
RULE = "----------------------------------"
PARTIAL_TITLE = "\tPARTIAL REPORT"
FINAL_TITLE = "\tFINAL REPORT"
FILE_TITLE = "\tRESULT"
DAILY_TITLE = "DIARY REPORT - Set time: [{hour}]"
ORIGIN_LINE = "ORIGIN: [%s]"
MESSAGE_LINE = "- [%d] %s -- (First seen %s - Last seen %s)"
SHAPE_LINE = "- Data: [%s] - Count: [%d]"

ORDER = ["section", "source", "entry", "rank", "message"]
_TITLE, _BODY, _END = 0, 1, 2


def _lines(rows: DataFrame, keys: list[str], title: str, entry_line: Column) -> DataFrame:
    """One line per row, one per origin, and frames around each ``keys`` group."""

    def lines(section, entry, text, source=F.lit(""), rank=F.lit(0), message=F.lit("")):
        return F.struct(
            F.lit(section).alias("section"), source.alias("source"), F.lit(entry).alias("entry"),
            rank.cast("long").alias("rank"), message.alias("message"), text.alias("line"),
        )

    entries = rows.select(
        *keys, lines(_BODY, 1, entry_line, F.col("source"), -F.col("count"), F.col("message")).alias("row")
    )
    origins = rows.groupBy(*keys, "source").agg(F.count("*").alias("_n")).select(
        *keys, lines(_BODY, 0, F.format_string(ORIGIN_LINE, "source"), F.col("source")).alias("row")
    )
    frame = F.explode(
        F.array(lines(_TITLE, 0, F.lit(title)), lines(_TITLE, 1, F.lit(RULE)), lines(_END, 0, F.lit(RULE)))
    )
    # a group without rows has no report, so the frames come from the rows too
    groups = rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 0")
    frames = groups.select(*keys, frame.alias("row"))
    return entries.unionByName(origins).unionByName(frames).select(*keys, "row.*")


def _message_line() -> Column:
    return F.format_string(MESSAGE_LINE, "count", "message", clock(F.col("first_seen")), clock(F.col("last_seen")))


def console_report(stats: DataFrame, final: bool = False) -> DataFrame:
    """Lines of a partial or final report; ``stats`` should be materialized."""
    return _lines(stats, [], FINAL_TITLE if final else PARTIAL_TITLE, _message_line())


def interval_console_reports(intervals: DataFrame) -> DataFrame:
    """Lines of one partial report per interval."""
    return _lines(intervals, ["window_start"], PARTIAL_TITLE, _message_line())


def daily_lines(daily: DataFrame, params: Params) -> DataFrame:
    """Lines of one report per day, its interval batches one after another."""
    title = DAILY_TITLE.format(hour=params.hour)
    lines = _lines(daily, ["report_day", "window_start"], title, _message_line())
    body = lines.filter(F.col("section") == _BODY)
    frames = lines.filter(F.col("section") != _BODY).groupBy("report_day", *ORDER, "line").agg(
        F.min("window_start").alias("window_start")
    )
    return body.unionByName(frames.select(*lines.columns))


def file_report(stats: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Lines of the report on a distilled log file, or of one for each of ``keys``."""
    return _lines(stats, list(keys), FILE_TITLE, _message_line())


def json_report(counts: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Lines of the report on a distilled JSON file, or of one for each of ``keys``."""
    return _lines(counts, list(keys), FILE_TITLE, F.format_string(SHAPE_LINE, "message", "count"))
