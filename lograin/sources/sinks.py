"""Writers of report lines, in order and without a single-file bottleneck."""

from __future__ import annotations

import re
import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lograin.functions.times import day
from lograin.operators.reports import ORDER


def _ordered(lines: DataFrame, *leading: str) -> DataFrame:
    order = [*leading, *ORDER]
    return lines.repartitionByRange(*order).sortWithinPartitions(*order)


def report_path(input_path: str, on: date, suffix: str = "normalized") -> str:
    """Name of the report next to a distilled file."""
    folder, slash, file = input_path.rpartition("/")
    name = re.sub(r"\.[^.]*$", "", file)
    return f"{folder}{slash}{name}_{on:%Y-%m-%d}_{suffix}.log"


def write_report(lines: DataFrame, path: str) -> None:
    """Write a report as text parts whose names follow the line order."""
    _ordered(lines).select("line").write.mode("overwrite").text(path, lineSep="\n")


def write_file_reports(lines: DataFrame, path: str, on: date) -> None:
    """Write the reports of many files below ``path``, one folder ``report=<name>`` each, in one job."""
    suffix = F.when(F.col("kind") == "json", "normalized-json").otherwise("normalized")
    name = F.concat(F.regexp_replace("file_path", r"\.[^./]*$", ""), F.lit(f"_{on:%Y-%m-%d}_"), suffix, F.lit(".log"))
    _ordered(lines.withColumn("report", name), "report").select("line", "report").write.mode("overwrite").partitionBy("report").text(path, lineSep="\n")


def write_daily_files(lines: DataFrame, path: str) -> list[str]:
    """Write daily reports to ``path/report_date=<day>``, each day once, and name the days written.

    All days are staged in a hidden folder first; then every day that has no report
    yet comes into being by one rename of its folder. A run that is repeated, or ended anywhere
    on the way and repeated, leaves one whole report a day; a day with a report is left alone.
    """
    spark = lines.sparkSession
    staged = f"{path}/_staged-{uuid.uuid4().hex}"
    dated = lines.withColumn("report_date", day(F.col("report_day")))
    # within a day: title, then the interval batches in time order
    ordered = ["report_date", "section", "window_start", *ORDER[1:]]
    (
        dated.repartitionByRange(*ordered)
        .sortWithinPartitions(*ordered)
        .select("line", "report_date")
        .write.partitionBy("report_date")
        .text(staged, lineSep="\n")
    )
    return publish(spark, staged, path)


def published(spark: SparkSession, path: str) -> list[str]:
    """Values of the partition folders below ``path``, as their names have them."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    files = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.listStatus(hadoop(path)) if files.exists(hadoop(path)) else []
    return sorted(name.partition("=")[2] for name in (entry.getPath().getName() for entry in found) if name[:1] not in "_.")


def publish(spark: SparkSession, staged: str, path: str) -> list[str]:
    """Rename the staged folders that have no namesake below ``path``; one entry per day or interval."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    files = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    written = []
    for entry in files.listStatus(hadoop(staged)):
        name = entry.getPath().getName()
        if entry.isDirectory() and not files.exists(hadoop(path, name)):
            if not files.rename(entry.getPath(), hadoop(path, name)):
                raise OSError(f"{name} could not be published below {path}")
            written.append(name.partition("=")[2])
    files.delete(hadoop(staged), True)
    return sorted(written)


def rename_files(spark: SparkSession, path: str, extension: str) -> None:
    """Give the files of a folder, which Spark's writers name themselves, another extension."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    files = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for entry in files.listStatus(hadoop(path)):
        name = entry.getPath().getName()
        if name.startswith("part-"):
            files.rename(entry.getPath(), hadoop(path, re.sub(r"\.[^.]*$", "", name) + extension))
