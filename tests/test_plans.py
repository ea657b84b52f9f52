"""What the plans of the hot paths must and must not contain."""

import dataclasses
import datetime as dt
import decimal
import shutil

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from lograin.operators import payloads
from lograin.operators.bursts import Bursts
from lograin.plans.catalog import PARAMS, QUERIES
from lograin.plans import inputs
from lograin.session import scratch_path
from lograin.sources import sinks
from lograin.streaming import alerts as alert_stream
from lograin.streaming import queries as streams
from lograin.streaming import stats as streaming_stats

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name", ["cluster_key", "first_ip", "log_stats", "interval_report", "daily_report", "final_report"]
)
def test_no_python_in_batch_plans(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    assert "Python" not in text and "InPandas" not in text
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_aggregates_before_the_shuffle(spark):
    text = plan(QUERIES["log_stats"](spark, SF_DIR))
    assert text.count("Exchange hashpartitioning") == 1 and "partial_count" in text


def test_scan_reads_needed_columns_only(spark):
    text = plan(QUERIES["format_times"](spark, SF_DIR))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in text


def test_final_report_filters_in_the_scan(spark):
    assert "PushedFilters: [GreaterThanOrEqual(ts," in plan(QUERIES["final_report"](spark, SF_DIR))


def test_fingerprint_is_computed_once(spark):
    """Counts read a table of fingerprints, and nothing else of it."""
    text = plan(QUERIES["json_shape_counts"](spark, SF_DIR))
    assert "array_join" not in text and text.count("ReadSchema: struct<shape:string>") == 1


def test_lowered_line_is_computed_once(spark):
    text = plan(QUERIES["log_stats"](spark, SF_DIR))
    assert text.count("lower(") == 1


def test_statistics_need_no_sort(spark):
    for name in ("log_stats", "interval_report", "daily_report", "daily_report_merged"):
        assert "SortAggregate" not in plan(QUERIES[name](spark, SF_DIR))


def test_streamed_statistics_lose_nothing(spark, tmp_path):
    """Interleaved files, one per micro-batch, and merges in between: none of them is late."""
    entries = inputs.event_entries(spark, SF_DIR)
    for part in range(9):
        piece = entries.filter(entries.event_id % 9 == part)
        piece.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    feed = spark.readStream.schema(entries.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    writer = streaming_stats.parts_writer(feed, PARAMS, out, fan=2).option("checkpointLocation", str(tmp_path / "progress"))
    writer.trigger(availableNow=True).start().awaitTermination()
    assert streaming_stats._outermost(streaming_stats._folders(spark, out)) == [(0, 7), (8, 8)]
    assert rows_of(streaming_stats.latest_rows(spark, out)) == rows_of(QUERIES["interval_report"](spark, SF_DIR))


def rows_of(df):
    names = ["source", "message", "count", "level"]
    return sorted((str(r["window_start"]), str(r["last_seen"]), *[r[n] for n in names]) for r in df.collect())


def test_batches_merge_in_a_tree(spark, tmp_path, monkeypatch):
    """After 200 batches: few folders, rows written a logarithmic number of times, any batch repeated, all counted."""
    parts = spark.createDataFrame(
        [(dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2), "s", "m", 1, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1), decimal.Decimal(0))],
        "window_start timestamp_ntz, window_end timestamp_ntz, source string, message string, count long, first_seen timestamp_ntz, last_seen timestamp_ntz, first_entry decimal(38,0)",
    )
    out, merged = str(tmp_path / "out"), []
    monkeypatch.setattr(streaming_stats, "_merged", lambda df, inner=streaming_stats._merged: merged.append(len(df.inputFiles())) or inner(df))
    parts.coalesce(1).write.parquet(str(tmp_path / "one"))
    for batch in range(200):
        for _ in range(2 if batch % 50 == 15 else 1):
            streaming_stats._sweep(spark, out)
            shutil.copytree(tmp_path / "one", streaming_stats._folder(out, batch, batch), dirs_exist_ok=True)
            streaming_stats.merge(spark, out, batch, 4)
    folders = streaming_stats._folders(spark, out)
    outer = streaming_stats._outermost(folders)
    assert outer == [(0, 63), (64, 127), (128, 191), (192, 195), (196, 199)] and len(folders) < 12
    assert len(merged) == 50
    assert streaming_stats.latest_rows(spark, out).first()["count"] == 200


def test_intervals_and_days_are_flushed_once(spark, tmp_path):
    entries = inputs.event_entries(spark, SF_DIR)
    params = dataclasses.replace(PARAMS, generate_logs_file=True)
    feed = streams.ordered_feed(spark, SF_DIR, 3)
    out = str(tmp_path / "out")
    writer = streaming_stats.parts_writer(feed, params, out, delay="1 minute").option("checkpointLocation", str(tmp_path / "progress"))
    writer.trigger(availableNow=True).start().awaitTermination()
    last = entries.agg({"ts": "max"}).first()[0]
    whole = QUERIES["interval_report"](spark, SF_DIR)
    starts = {r[0] for r in whole.select("window_start").distinct().collect()}
    names = {f"{s:%Y-%m-%dT%H%M%S}" for s in starts if s + dt.timedelta(hours=1) <= last - dt.timedelta(minutes=1)}
    assert set(sinks.published(spark, f"{out}/reports")) == set(sinks.published(spark, f"{out}/outbox")) == names
    days = set(sinks.published(spark, f"{out}/daily"))
    assert days and f"{last:%Y-%m-%d}" not in days
    streaming_stats.flush(spark, out, params)
    streaming_stats.flush(spark, out, params)
    assert set(sinks.published(spark, f"{out}/reports")) == {f"{s:%Y-%m-%dT%H%M%S}" for s in starts}
    written = sorted(tuple(r) for r in spark.read.text(f"{out}/daily").selectExpr("cast(report_date as string)", "value").collect())
    assert written == sorted(tuple(r) for r in QUERIES["daily_file"](spark, SF_DIR).collect())
    requests = payloads.joined(spark.read.parquet(f"{out}/outbox"), ("window_start", "url"), "body").select("body").collect()
    expected = QUERIES["integration_outbox"](spark, SF_DIR).select("body").collect()
    assert sorted(map(tuple, requests)) == sorted(map(tuple, expected))


def test_alerts_come_while_the_feed_goes_on(spark, tmp_path):
    feed, out = streams.ordered_feed(spark, SF_DIR, 4), str(tmp_path / "out")
    params = dataclasses.replace(PARAMS, severity_threshold=1, overall_threshold=5)
    writer = alert_stream.alert_writer(feed, params, out, delay="1 minute").option("checkpointLocation", str(tmp_path / "progress"))
    writer.trigger(availableNow=True).start().awaitTermination()
    early = spark.read.parquet(f"{out}/alerts")
    assert {r["batch"] for r in early.select("batch").distinct().collect()} == {0, 1, 2, 3}
    expected = Bursts(inputs.event_entries(spark, SF_DIR), params).alerts()
    assert early.count() > 0.9 * expected.count()
    assert alert_stream.late_counts(spark, out).count() == 0
    alert_stream.flush_alerts(spark, params, out)
    names = ["category", "window_start", "ts", "count", "ip"]
    found = alert_stream.stream_alerts(spark, out)
    assert sorted(map(str, found.select(*names).collect())) == sorted(map(str, expected.select(*names).collect()))


def test_feed_makes_its_lines_once(spark, monkeypatch):
    """The table is rendered in one pass whatever the number of pieces; each piece is later than the one before."""
    whole, made = inputs.event_entries(spark, SF_DIR), []
    monkeypatch.setattr(streams.inputs, "event_entries", lambda spark, sf_dir: whole.filter(F.expr("ts > timestamp_ntz'1970-01-01'")))
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, write=DataFrameWriter.parquet: (made.append(self._df), write(self, path))[1])
    feed, names = streams.ordered_feed(spark, SF_DIR, 4), ["event_id", "ts", "content"]
    assert sum("took" in df._jdf.queryExecution().optimizedPlan().toString() for df in made) == 1
    path = scratch_path(spark, "read")
    feed.writeStream.foreachBatch(lambda rows, batch: rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")).trigger(availableNow=True).start().awaitTermination()
    pieces = spark.read.parquet(path)
    ends = pieces.groupBy("batch").agg(F.min("ts"), F.max("ts")).orderBy("batch").collect()
    assert len(ends) == 4 and all(a[2] < b[1] for a, b in zip(ends, ends[1:]))
    assert sorted(map(tuple, pieces.select(*names).collect())) == sorted(map(tuple, whole.select(*names).collect()))
