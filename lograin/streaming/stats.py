"""Interval statistics of an unbounded feed, and what is due when an interval or a day ends.

Below the given path:

``parts/since=a/upto=b``   mergeable rows of micro-batches a to b
``reports/window_start=…`` report lines of a finished interval
``outbox/window_start=…``  requests of a finished interval's payloads
``daily/report_date=…``    report of a finished day, where ``generate_logs_file`` asks for it
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from lograin.functions.times import micros
from lograin.operators import payloads, reports
from lograin.operators.stats import interval_parts, merged_measures, with_level, with_report_day
from lograin.params import Params
from lograin.session import discard, materialize
from lograin.sources import sinks

_KEYS = ["window_start", "window_end", "source", "message"]


def parts_writer(entries: DataFrame, params: Params, path: str, fan: int = 4, delay: str | None = None) -> DataStreamWriter:
    """Write every micro-batch's interval statistics below ``path``, for :func:`latest_rows`.

    Each batch is aggregated for itself and merged on reading, so there is no
    watermark and no entry is too late. Folders form a tree: whenever ``fan`` to the power k
    batches are complete, theirs become one, so a row is written again once per level, a
    logarithmic number of times, and a reader opens that many folders. Folders that a
    merged one covers are deleted when the next batch begins. A repeated batch overwrites its own folder.

    With a ``delay``, the reports and requests of every interval, and the report of every day, that ended
    so long before the newest entry are written by the batch that finds them ended; see :func:`flush`.
    """
    delay_us = None
    if delay is not None:
        delay_us = entries.sparkSession.range(1).select(F.expr(f"unix_micros(timestamp_micros(0) + interval {delay})")).first()[0]

    def write(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        _sweep(spark, path)
        interval_parts(rows, params).write.mode("overwrite").parquet(_folder(path, batch_id, batch_id))
        merge(spark, path, batch_id, fan)
        if delay_us is not None:
            newest = spark.read.parquet(_folder(path, *_covering(spark, path, batch_id))).agg(F.max(micros(F.col("last_seen")))).first()[0]
            if newest is not None:
                flush(spark, path, params, newest - delay_us)

    return entries.writeStream.foreachBatch(write)


def _folder(path: str, since: int, upto: int) -> str:
    return f"{path}/parts/since={since}/upto={upto}"


def _folders(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """(since, upto) of all complete folders: a logarithmic number."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    files = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.globStatus(hadoop(f"{path}/parts/since=*/upto=*/_SUCCESS")) or []
    names = [str(entry.getPath().getParent()).rsplit("/", 2)[1:] for entry in found]
    return sorted((int(a.partition("=")[2]), int(b.partition("=")[2])) for a, b in names)


def _outermost(folders: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Folders that no other one covers."""
    return [f for f in folders if not any(o != f and o[0] <= f[0] and f[1] <= o[1] for o in folders)]


def _covering(spark: SparkSession, path: str, batch: int) -> tuple[int, int]:
    return next(f for f in _outermost(_folders(spark, path)) if f[0] <= batch <= f[1])


def merge(spark: SparkSession, path: str, batch: int, fan: int) -> None:
    """Merge the batches of the largest block of ``fan`` ** k batches that ends with this one."""
    size = 1
    while (batch + 1) % (size * fan) == 0:
        size *= fan
    since = batch + 1 - size
    folders = _folders(spark, path)
    if size > 1 and (since, batch) not in folders:
        inner = [f for f in _outermost(folders) if since <= f[0] and f[1] <= batch]
        parts = spark.read.parquet(*[_folder(path, *f) for f in inner])
        _merged(parts).write.mode("overwrite").parquet(_folder(path, since, batch))


def _sweep(spark: SparkSession, path: str) -> None:
    """Delete folders that a merged one covers; readers of the batch before have had time to go on."""
    folders = _folders(spark, path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    files = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in set(folders) - set(_outermost(folders)):
        files.delete(hadoop(_folder(path, *folder)), True)


def _merged(parts: DataFrame) -> DataFrame:
    return parts.groupBy(*_KEYS).agg(*merged_measures())


def latest_rows(spark: SparkSession, path: str) -> DataFrame:
    """Statistics of every interval over all batches written so far."""
    return with_level(_merged(spark.read.parquet(*[_folder(path, *f) for f in _outermost(_folders(spark, path))])))


def flush(spark: SparkSession, path: str, params: Params, upto_us: int | None = None) -> None:
    """Write what is due of the intervals and days that ended by ``upto_us``, or of all.

    Every interval, and every day, comes into being whole by one rename and is written once, however often
    the batch is repeated. Entries that come later count in :func:`latest_rows` only.
    """
    rows = latest_rows(spark, path)
    ended = F.lit(True) if upto_us is None else micros(F.col("window_end")) <= upto_us
    written = sinks.published(spark, f"{path}/reports")
    name = F.date_format("window_start", "yyyy-MM-dd'T'HHmmss")
    due = materialize(rows.filter(ended & ~name.isin(written) if written else ended))
    if not due.isEmpty():
        # requests first: an interval counts as written with its report
        if any(target.on_aggregation for target in params.integrations):
            outbox = payloads.integration_outbox(due, params, ("window_start",)).withColumn("headers", F.to_json("headers"))
            _staged(spark, outbox.withColumn("window_start", name), f"{path}/outbox", "window_start", text=False)
        lines = reports.interval_console_reports(due).withColumn("window_start", name)
        _staged(spark, lines, f"{path}/reports", "window_start", text=True)
    discard(due)
    if params.generate_logs_file:
        days = with_report_day(rows, params)
        if upto_us is not None:
            days = days.filter(micros(F.col("report_day")) + int(dt.timedelta(days=1).total_seconds() * 1e6) <= upto_us)
        days = materialize(days)
        if not days.isEmpty():
            sinks.write_daily_files(reports.daily_lines(days, params), f"{path}/daily")
        discard(days)


def _staged(spark: SparkSession, rows: DataFrame, path: str, key: str, text: bool) -> None:
    staged = f"{path}/_staged-{uuid.uuid4().hex}"
    if text:
        order = [key, *reports.ORDER]
        ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("line", key)
        ordered.write.partitionBy(key).text(staged, lineSep="\n")
    else:
        rows.write.partitionBy(key).parquet(staged)
    sinks.publish(spark, staged, path)
