"""Every operator as a query over the warehouse tables."""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lograin.functions import json_shape as J
from lograin.functions import text as T
from lograin.functions.times import alert_time, clock, day
from lograin.operators import notify, payloads, reports, stats
from lograin.operators.bursts import Bursts
from lograin.params import Integration, Params
from lograin.plans import inputs
from lograin.plans.distill import distill_file, distill_folder
from lograin.session import materialize, scratch_path
from lograin.sources import files, json_stream as json_stream_, sinks
from lograin.sources.entries import file_entries
from lograin.streaming import queries as streams

Query = Callable[[SparkSession, str], DataFrame]

# Configuration of the registered queries.
PARAMS = Params(
    id_log=inputs.ID_LOG,
    limit_break=86_400.0,
    slice_rows=1_000,  # several slices in every table, however small
    report_interval=60.0,
    hour="06:00:00",
    webhook_urls=(
        "https://discord.com/api/webhooks/1",
        "https://hooks.slack.com/services/2",
        "https://example.org/hook",
    ),
    integrations=(
        Integration("https://example.org/ingest", {"X-Token": "t1"}, on_aggregation=True),
        Integration("https://example.org/unused", {}, on_aggregation=False),
    ),
)
WORDS = Params(id_log=inputs.ID_LOG, words=("took", "ms", "lick", "c", "props"))

# A long list: all runs of three of some letters, then of two and single ones, which the runs before them win over.
_LETTERS = "etaoinsrlh"
MANY_WORDS = Params(words=tuple("".join(run) for n in (3, 2, 1) for run in product(_LETTERS, repeat=n) if n > 1 or run[0] in "aeo"))

QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# --- lines ---------------------------------------------------------------


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines at hand: event lines and the lines of documents."""
    events = inputs.event_entries(spark, sf_dir).select(
        F.lit("event").alias("origin"), F.col("event_id").alias("id"), F.lit(0).alias("line_no"), "content"
    )
    documents = inputs.document_lines(spark, sf_dir).select(
        F.lit("document").alias("origin"), F.col("doc_id").alias("id"), "line_no", "content"
    )
    return events.unionByName(documents)


def _line_query(name: str, function: Callable[[Column], Column]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _lines(spark, sf_dir).select("origin", "id", "line_no", function(F.col("content")).alias("result"))

    QUERIES[name] = run


_line_query("trim_space", T.trim_space)
_line_query("strip_ipv4", T.strip_ipv4)
_line_query("strip_log_id", lambda c: T.strip_log_id(c, F.lit(inputs.ID_LOG), PARAMS))
_line_query("lower_text", T.lower_text)
_line_query("strip_dates", lambda c: T.strip_dates(T.lower_text(c)))
_line_query("strip_levels", T.strip_levels)
_line_query("extract_level", T.extract_level)
_line_query("remove_words", lambda c: T.remove_words(T.lower_text(c), WORDS))
_line_query("remove_many_words", lambda c: T.remove_words(T.lower_text(c), MANY_WORDS))
_line_query("sanitize_line", lambda c: T.sanitize_line(c, F.lit(inputs.ID_LOG), WORDS))
_line_query("mask_digits", T.mask_digits)
_line_query("cluster_key", lambda c: T.cluster_key(c, F.lit(inputs.ID_LOG), PARAMS))
_line_query("entry_level", T.extract_level)
_line_query("first_ip", T.first_ip)


@query
def text_lines(spark, sf_dir):
    path = scratch_path(spark, "lines")
    inputs.table(spark, sf_dir, "documents").select("text").write.text(path, lineSep="\n")
    return files.text_lines(spark, path)


@query
def source_by_extension(spark, sf_dir):
    path = scratch_path(spark, "mixed")
    inputs.table(spark, sf_dir, "documents").select("text").write.text(path, lineSep="\n")
    bodies = inputs.table(spark, sf_dir, "events").select("event_id", "event_type", "props")
    bodies.write.mode("append").json(path, lineSep="\n")
    return files.lines_by_extension(spark, path).select("extension", "kind", "content")


@query
def stream_entries(spark, sf_dir):
    return streams.stream_entries(spark, sf_dir)


@query
def log_entries(spark, sf_dir):
    return inputs.event_entries(spark, sf_dir)


@query
def format_times(spark, sf_dir):
    ts = F.col("ts")
    return inputs.table(spark, sf_dir, "events").select(
        "event_id", clock(ts).alias("clock"), day(ts).alias("day"), alert_time(ts).alias("alert_time")
    )


# --- statistics and reports ----------------------------------------------


def _entries(spark, sf_dir) -> DataFrame:
    return inputs.event_entries(spark, sf_dir)


def _file_entries(spark, sf_dir) -> DataFrame:
    return file_entries(inputs.document_lines(spark, sf_dir), inputs.ID_LOG)


@query
def severity_filter(spark, sf_dir):
    entries = T.with_message(_entries(spark, sf_dir), PARAMS)
    return stats.severity_filter(entries, PARAMS).select("event_id", "ts", "level", "message")


@query
def log_stats(spark, sf_dir):
    return stats.log_stats(_entries(spark, sf_dir), PARAMS)


@query
def file_stats(spark, sf_dir):
    return stats.file_stats(_file_entries(spark, sf_dir), PARAMS)


@query
def interval_report(spark, sf_dir):
    return stats.interval_report(_entries(spark, sf_dir), PARAMS)


@query
def daily_report(spark, sf_dir):
    return stats.daily_report(_entries(spark, sf_dir), PARAMS)


@query
def daily_report_merged(spark, sf_dir):
    return stats.daily_report(_entries(spark, sf_dir), PARAMS, merge=True)


@query
def interval_union(spark, sf_dir):
    """Batches of the event feed and of the conversations feed, listed together."""
    turns = inputs.conversation_entries(spark, sf_dir)
    return stats.interval_union(
        stats.interval_report(_entries(spark, sf_dir), PARAMS), stats.interval_report(turns, PARAMS)
    )


@query
def final_report(spark, sf_dir):
    return stats.final_report(_entries(spark, sf_dir), PARAMS)


@query
def nonempty_report(spark, sf_dir):
    return stats.nonempty_report(stats.interval_report(_entries(spark, sf_dir), PARAMS))


@query
def console_report(spark, sf_dir):
    lines = reports.console_report(materialize(log_stats(spark, sf_dir)), final=True)
    return lines.select("section", "source", "line")


@query
def interval_console_reports(spark, sf_dir):
    lines = reports.interval_console_reports(materialize(interval_report(spark, sf_dir)))
    return lines.select("window_start", "section", "source", "line")


@query
def daily_file(spark, sf_dir):
    """Daily reports written as text and read back."""
    path = scratch_path(spark, "daily")
    lines = reports.daily_lines(materialize(daily_report(spark, sf_dir)), PARAMS)
    sinks.write_daily_files(lines, path)
    return spark.read.text(path, lineSep="\n").select(F.col("report_date").cast("string"), F.col("value").alias("line"))


@query
def file_report(spark, sf_dir):
    """The report on the event lines' statistics, written as text and read back."""
    path = scratch_path(spark, "report")
    sinks.write_report(reports.file_report(materialize(log_stats(spark, sf_dir))), path)
    return spark.read.text(path, lineSep="\n").select(F.col("value").alias("line"))


@query
def file_distiller(spark, sf_dir):
    """Statistics of a text file, picked by its extension."""
    path = scratch_path(spark, "distil")
    inputs.table(spark, sf_dir, "documents").select("text").write.text(path, lineSep="\n")
    return distill_file(spark, path, PARAMS, extension=".txt").select("source", "message", "count")


def _mixed_folder(spark: SparkSession, sf_dir: str) -> str:
    """Document lines as text files and laid-out events as JSON files, in one folder."""
    path = scratch_path(spark, "folder")
    inputs.table(spark, sf_dir, "documents").select("text").write.text(f"{path}/logs", lineSep="\n")
    bodies = inputs.pretty_bodies(spark, sf_dir).repartition(3, "event_id").select("body")
    # texts that run over lines, in files of the extension that selects the JSON distiller
    bodies.write.text(f"{path}/data", lineSep="\n")
    sinks.rename_files(spark, f"{path}/data", ".json")
    return path


@query
def folder_distiller(spark, sf_dir):
    """Statistics of all files of a folder, each by its extension."""
    counts = distill_folder(spark, _mixed_folder(spark, sf_dir), PARAMS)
    return counts.groupBy("kind", "source", "message").agg(F.sum("count").alias("count"))


# --- JSON ------------------------------------------------------------------


def _documents(spark, sf_dir) -> DataFrame:
    return files.json_documents(inputs.json_bodies(spark, sf_dir))


@query
def json_documents(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", "pos", J.json_kind(F.col("document")).alias("kind"))


@query
def json_values(spark, sf_dir):
    values = files.json_values(inputs.json_texts(spark, sf_dir)).filter("fault is null")
    return values.groupBy("doc_id", J.json_kind(F.col("value")).alias("kind")).agg(F.count("*").alias("n"))


@query
def json_rejects(spark, sf_dir):
    return files.json_rejects(inputs.json_texts(spark, sf_dir))


@query
def json_stream(spark, sf_dir):
    """Nodes of the documents of files whose values run over lines, splits and chunks."""
    path = scratch_path(spark, "stream")
    inputs.pretty_bodies(spark, sf_dir).repartition(3, "event_id").select("body").write.text(path, lineSep="\n")
    documents = json_stream_.stream_documents(spark, path, limit=1 << 16)
    return J.json_nodes(documents.select("document")).groupBy("path", "kind", "value").agg(F.count("*").alias("n"))


@query
def json_is_id(spark, sf_dir):
    """Identifier test of hashes, words, urls and document lines."""
    event = F.explode(F.array(F.md5(F.col("event_id").cast("string")), F.hex("event_id"), F.col("event_type")))
    texts = (
        inputs.table(spark, sf_dir, "events").select(event.alias("value"))
        .unionByName(inputs.table(spark, sf_dir, "pages").select(F.col("url").alias("value")))
        .unionByName(inputs.document_lines(spark, sf_dir).select(F.col("content").alias("value")))
    )
    return texts.select("value", J.json_is_id(F.col("value")).alias("is_id"))


@query
def json_shape(spark, sf_dir):
    return J.with_shape(_documents(spark, sf_dir)).select("doc_id", "pos", "shape")


@query
def json_nodes(spark, sf_dir):
    return J.json_nodes(_documents(spark, sf_dir)).select("doc_id", "pos", "path", "kind", "value")


@query
def sort_keys(spark, sf_dir):
    keys = F.array_join(J.sort_keys(F.col("document")), ",")
    return _documents(spark, sf_dir).select("doc_id", "pos", keys.alias("sorted_keys")).filter("sorted_keys is not null")


@query
def nonempty_shape(spark, sf_dir):
    return stats.nonempty_shape(json_shape(spark, sf_dir))


@query
def json_shape_counts(spark, sf_dir):
    return stats.json_shape_counts(_documents(spark, sf_dir))


@query
def json_report(spark, sf_dir):
    lines = reports.json_report(materialize(json_shape_counts(spark, sf_dir)))
    return lines.select("section", "source", "line")


# --- payloads ---------------------------------------------------------------


@query
def origin_payload(spark, sf_dir):
    return payloads.joined(payloads.origin_payload(log_stats(spark, sf_dir), PARAMS), ("source",), "payload")


@query
def origin_payload_parts(spark, sf_dir):
    """The same objects, written in segments of four messages."""
    small = Params(id_log=inputs.ID_LOG, payload_messages=4)
    return payloads.joined(payloads.origin_payload(log_stats(spark, sf_dir), small), ("source",), "payload")


@query
def report_payload(spark, sf_dir):
    return payloads.joined(payloads.report_payload(log_stats(spark, sf_dir), PARAMS), (), "body")


@query
def report_payload_parts(spark, sf_dir):
    """The same array, written in segments of twelve messages."""
    small = Params(id_log=inputs.ID_LOG, payload_messages=12)
    return payloads.joined(payloads.report_payload(log_stats(spark, sf_dir), small), (), "body")


@query
def payload_formatter(spark, sf_dir):
    return payloads.joined(payloads.payload_formatter("json")(log_stats(spark, sf_dir), PARAMS), (), "body")


@query
def day_payloads(spark, sf_dir):
    return payloads.joined(payloads.day_payloads(daily_report(spark, sf_dir), PARAMS), ("report_day", "window_start"), "body")


@query
def enabled_integrations(spark, sf_dir):
    """Page urls as integrations, every other one enabled."""
    table = inputs.table(spark, sf_dir, "pages").select("url", (F.col("page_id") % 2 == 0).alias("on_aggregation"))
    return payloads.enabled_integrations(table)


@query
def integration_fanout(spark, sf_dir):
    reports_ = stats.nonempty_report(interval_report(spark, sf_dir))
    fanned = payloads.integration_fanout(reports_, PARAMS)
    return fanned.select("window_start", "window_end", "messages", "url")


@query
def integration_outbox(spark, sf_dir):
    outbox = payloads.integration_outbox(interval_report(spark, sf_dir), PARAMS, ("window_start",))
    return payloads.joined(outbox.withColumn("headers", F.to_json("headers")), ("window_start", "url", "headers"), "body")


# --- bursts -----------------------------------------------------------------


def _bursts(spark, sf_dir) -> Bursts:
    return Bursts(_entries(spark, sf_dir), PARAMS)


@query
def severity_windows(spark, sf_dir):
    return _bursts(spark, sf_dir).severity_windows()


@query
def severity_alerts(spark, sf_dir):
    return _bursts(spark, sf_dir).severity_alerts()


@query
def overall_input(spark, sf_dir):
    return _bursts(spark, sf_dir).overall_input().select("event_id", "ts", "level")


@query
def overall_windows(spark, sf_dir):
    return _bursts(spark, sf_dir).overall_windows()


@query
def overall_alerts(spark, sf_dir):
    return _bursts(spark, sf_dir).overall_alerts()


@query
def burst_ip(spark, sf_dir):
    return _bursts(spark, sf_dir).burst_ip()


@query
def alerts(spark, sf_dir):
    return _bursts(spark, sf_dir).alerts()


@query
def alert_routing(spark, sf_dir):
    routed = notify.alert_routing(alerts(spark, sf_dir), PARAMS)
    return routed.select("category", "window_start", "ts", "count", "url", "kind")


@query
def discord_payload(spark, sf_dir):
    return notify.discord_payload(notify.alert_routing(alerts(spark, sf_dir), PARAMS))


@query
def slack_payload(spark, sf_dir):
    return notify.slack_payload(notify.alert_routing(alerts(spark, sf_dir), PARAMS))


# --- streams -----------------------------------------------------------------


@query
def stream_log_stats(spark, sf_dir):
    return streams.stream_log_stats(spark, sf_dir, PARAMS)


@query
def stream_interval_reports(spark, sf_dir):
    return streams.stream_interval_reports(spark, sf_dir, PARAMS)


@query
def stream_alerts(spark, sf_dir):
    return streams.stream_alerts(spark, sf_dir, PARAMS)
