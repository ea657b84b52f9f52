"""End-to-end plans: distil a file, report on a feed."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lograin.operators import reports, stats
from lograin.params import Params
from lograin.session import materialize
from lograin.sources import files, json_stream, sinks
from lograin.sources.entries import file_entries

Distiller = Callable[[SparkSession, str, Params], DataFrame]


def distill_text(spark: SparkSession, path: str, params: Params) -> DataFrame:
    """Template counts of the lines of text files."""
    return stats.file_stats(file_entries(files.text_lines(spark, path), params.id_log), params)


def distill_json(spark: SparkSession, path: str, params: Params) -> DataFrame:
    """Shape counts of the documents of JSON files; malformed texts fail the job."""
    return stats.json_shape_counts(json_stream.stream_documents(spark, path))


# The distiller an extension selects; add entries for other kinds of files.
DISTILLERS: dict[str, Distiller] = {
    **dict.fromkeys(files.TEXT_EXTENSIONS, distill_text),
    **dict.fromkeys(files.JSON_EXTENSIONS, distill_json),
}


def file_extension(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return name[name.rindex("."):] if "." in name else ""


def distill_file(spark: SparkSession, path: str, params: Params, extension: str | None = None) -> DataFrame:
    """Statistics of a file; ``extension`` names the kind of a folder of files."""
    extension = file_extension(path) if extension is None else extension
    if extension not in DISTILLERS:
        raise ValueError(f"unsupported file extension: {extension}")
    return DISTILLERS[extension](spark, path, params)


def distill_to_report(spark: SparkSession, path: str, out: str, params: Params, extension: str | None = None) -> None:
    """Distil a file and write its report; lines were seen when they were read."""
    extension = file_extension(path) if extension is None else extension
    read_at = {"first_seen": F.current_timestamp(), "last_seen": F.current_timestamp()}
    counts = materialize(distill_file(spark, path, params, extension).withColumns(read_at))
    lines = reports.json_report(counts) if extension in files.JSON_EXTENSIONS else reports.file_report(counts)
    sinks.write_report(lines, out)


def distill_folder(spark: SparkSession, path: str, params: Params) -> DataFrame:
    """Statistics of every file below a folder, each by the distiller of its extension.

    Columns: file_path, kind, source, message, count. One plan per kind, whatever the
    number of files; an unknown extension fails before anything is read.
    """
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("file_path"))
    kind = files.kind_of(files.extension(F.regexp_extract("file_path", "[^/]*$", 0)))
    names = names.select("file_path", kind.alias("kind"))
    kinds = {row["kind"] for row in names.select("kind").distinct().collect()}
    found = []
    if "text" in kinds:
        lines = files.lines_by_extension(spark, path, pattern=files.named(files.TEXT_EXTENSIONS)).select("file_path", "content")
        found.append(stats.file_stats(file_entries(lines, params.id_log), params, ("file_path",)).withColumn("kind", F.lit("text")))
    if "json" in kinds:
        documents = json_stream.stream_documents(spark, path, pattern=files.named(files.JSON_EXTENSIONS))
        found.append(stats.json_shape_counts(documents, ("file_path",)).withColumn("kind", F.lit("json")))
    columns = ["file_path", "kind", "source", "message", "count"]
    if not found:
        return spark.createDataFrame([], "file_path string, kind string, source string, message string, count long")
    return stats.interval_union(*[rows.select(*columns) for rows in found])


def distill_folder_to_reports(spark: SparkSession, path: str, out: str, params: Params, on: date) -> DataFrame:
    """Distil a folder and write the report of every file below ``out/report=<name>``; returns the statistics.

    Names are those of :func:`sinks.report_path`, with the path below the folder.
    """
    read_at = {"first_seen": F.current_timestamp(), "last_seen": F.current_timestamp()}
    counts = materialize(distill_folder(spark, path, params).withColumns(read_at))
    text, data = counts.filter("kind = 'text'"), counts.filter("kind = 'json'")
    lines = reports.file_report(text, ("file_path", "kind")).unionByName(reports.json_report(data, ("file_path", "kind")))
    sinks.write_file_reports(lines, out, on)
    return counts
