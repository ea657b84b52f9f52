"""Burst plans against a fold over single events."""

import datetime as dt
import random
from collections import Counter

import pytest

from lograin import Params
from lograin.operators import bursts as bursts_module
from lograin.operators import chain
from lograin.operators.bursts import Bursts
from lograin.operators.chain import window_starts
from lograin.session import materialize
from lograin.streaming.alerts import alert_writer, flush_alerts, late_counts, stream_alerts
from tests import fold

START = dt.datetime(2024, 5, 1)
SECOND = fold.SECOND


def random_times(rng, limit, size):
    """Times with ties and with gaps below, at and above the limit."""
    us, times = rng.randrange(10 * limit), []
    for _ in range(size):
        times.append(us)
        gap = rng.choice([0, 1, limit // 50, limit // 7, limit // 3, limit - 1, limit, limit + 1, 3 * limit])
        us += gap if rng.random() < 0.3 else rng.randrange(1 + limit // rng.choice([3, 20, 200]))
    return times


def spy(monkeypatch, *names):
    """Count the calls of functions of the chain module."""
    calls = Counter()

    def watched(name, original):
        def run(*args):
            calls[name] += 1
            return original(*args)

        return run

    for name in names:
        monkeypatch.setattr(chain, name, watched(name, getattr(chain, name)))
    return calls


def chain_cases(spark, limit, sizes):
    rng = random.Random(3)
    cases = {f"case{i}": random_times(rng, limit, size) for i, size in enumerate(sizes)}
    rows = [(name, us) for name, times in cases.items() for us in sorted(set(times))]
    expected = [(name, us) for name, times in cases.items() for us in fold.openings(times, limit)]
    return cases, materialize(spark.createDataFrame(rows, "category string, us long")), sorted(expected)


def opening_rows(df):
    return sorted((row["category"], row["start_us"]) for row in df.collect())


@pytest.mark.parametrize(
    "max_group_rows, way", [(8_000_000, "_starts_by_slices"), (400, "_starts_by_slices"), (1, "_starts_by_lifting")]
)
def test_openings(spark, monkeypatch, max_group_rows, way):
    """The measured density selects the way, the openings stay the same."""
    calls = spy(monkeypatch, "_starts_by_slices", "_starts_by_lifting")
    limit, sizes = 10 * SECOND, [1, 2, 5, 40, 400, 1500] * 3
    cases, counts, expected = chain_cases(spark, limit, sizes)
    found = window_starts(counts, limit, max_group_rows)
    assert calls == {way: 1}
    assert opening_rows(found) == expected
    firsts = {row["category"]: row["start_us"] for row in found.filter("first").collect()}
    assert firsts == {name: min(times) for name, times in cases.items()}


@pytest.mark.parametrize("span, max_rows, levels", [(1, 20, 3), (3, 60, 2), (5, 10**6, 1)])
def test_composed_slices(spark, monkeypatch, span, max_rows, levels):
    """Step functions too many for one task are composed, level upon level."""
    calls = spy(monkeypatch, "_entry_deadlines")
    limit = 10 * SECOND
    _, counts, expected = chain_cases(spark, limit, [1, 3, 50, 800, 2000, 2500])
    assert opening_rows(chain._starts_by_slices(counts, limit, span, max_rows, {})) == expected
    assert calls["_entry_deadlines"] >= levels


@pytest.mark.parametrize("max_rows", [10**6, 20])
def test_slices_stream_through_their_tasks(spark, max_rows):
    """No slice, nor all step functions of a category, are handed to a task as one group; slices may lie across batches."""
    limit, size = 10 * SECOND, "spark.sql.execution.arrow.maxRecordsPerBatch"
    _, counts, expected = chain_cases(spark, limit, [1, 3, 50, 800, 1500])
    before = spark.conf.get(size)
    try:
        spark.conf.set(size, 7)
        found = chain._starts_by_slices(counts, limit, 2, max_rows, {})
        assert opening_rows(found) == expected
    finally:
        spark.conf.set(size, before)
    assert "InPandas" not in found._jdf.queryExecution().toString()


@pytest.mark.parametrize("way", ["slices", "composed", "lifting"])
def test_chain_goes_on_from_open_windows(spark, way):
    limit = 10 * SECOND
    cases, _, expected = chain_cases(spark, limit, [2, 30, 60, 400])
    halves = {name: sorted(set(times)) for name, times in cases.items()}
    later = [(name, us) for name, times in halves.items() for us in times[len(times) // 2 :]]
    opened = {name: [us for case, us in expected if case == name and us < halves[name][len(halves[name]) // 2]] for name in cases}
    deadlines = {name: found[-1] + limit for name, found in opened.items() if name != "case0"}
    counts = materialize(spark.createDataFrame(later, "category string, us long"))
    if way == "lifting":
        found = chain._starts_by_lifting(counts, limit, limit // 7, deadlines)
    else:
        found = chain._starts_by_slices(counts, limit, 2, 10**6 if way == "slices" else 5, deadlines)
    goal = [(name, us) for name, us in expected if us > opened[name][-1] and name != "case0"]
    goal += [("case0", us) for us in fold.openings([us for name, us in later if name == "case0"], limit)]
    assert opening_rows(found) == sorted(goal)


def bursty_times(rng, limit, size):
    """Stretches of different density between gaps around the limit."""
    us, times = 0, []
    while len(times) < size:
        rate = rng.choice([30, 300, 2000])
        for _ in range(rng.randrange(1, 400)):
            times.append(us)
            us += rng.choice([0, 0, 1, 5 * SECOND]) if rng.random() < 0.1 else rng.randrange(1 + limit // rate)
        us += rng.choice([0, limit - 1, limit, limit + 1, 3 * limit])
    return times[:size]


def entries(spark, rng, limit, size):
    """Random entries, event ids not in time order."""
    times, levels = bursty_times(rng, limit, size), ["error", "CRITICAL", "info", "debug", ""]
    ids = rng.sample(range(10 * size), size)
    events = [(us, event_id, rng.choices(levels, [4, 1, 2, 1, 1])[0]) for us, event_id in zip(times, ids)]
    rows = [
        (event_id, START + dt.timedelta(microseconds=us), f"{level} from 10.0.{event_id % 7}.{event_id % 256} x")
        for us, event_id, level in events
    ]
    frame = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, content string")
    return frame, [(us, event_id, level.upper()) for us, event_id, level in events]


def offset(ts):
    return (ts - START) // dt.timedelta(microseconds=1)


def alert_rows(df):
    return sorted((r["category"], offset(r["window_start"]), offset(r["ts"]), r["count"]) for r in df.collect())


@pytest.mark.parametrize("seed, limit_seconds, size", [(11, 30, 2000), (2, 120, 5000)])
def test_detection(spark, seed, limit_seconds, size):
    rng = random.Random(seed)
    frame, events = entries(spark, rng, limit_seconds * SECOND, size)
    alerts, severe, overall = fold.detect(events, limit_seconds * SECOND)
    assert {alert[0] for alert in alerts} == {"ERROR", "CRITICAL", "AGGREGATE_TRAFFIC"}
    per_window = Counter(alert[:2] for alert in alerts)
    assert max(per_window.values()) == (10 if limit_seconds > 100 else 6)
    found = Bursts(materialize(frame), Params(limit_break=float(limit_seconds)))
    assert alert_rows(found.alerts()) == alerts
    counted = {r["event_id"]: (offset(r["window_start"]), r["count"]) for r in found.severity_windows().collect()}
    assert counted == severe
    counted = {r["event_id"]: (offset(r["window_start"]), r["count"]) for r in found.overall_windows().collect()}
    assert counted == overall


def test_next_times(spark):
    rng = random.Random(9)
    cases = {f"case{i}": sorted(set(random_times(rng, 100, 300))) for i in range(3)}
    counts = spark.createDataFrame([(name, us) for name, times in cases.items() for us in times], "category string, us long")
    expected = {(name, us): min((t for t in times if t > us + 100), default=None) for name, times in cases.items() for us in times}
    for width in (1, 7, 100, 10**9):
        assert {(r["category"], r["us"]): r["next"] for r in chain._next_times(counts, 100, width).collect()} == expected


def test_alerts_stream_through_batches(spark):
    """Windows cut by the batches that tasks read, the same alerts."""
    frame, events = entries(spark, random.Random(2), 120 * SECOND, 3000)
    alerts, _, _ = fold.detect(events, 120 * SECOND)
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert alert_rows(Bursts(materialize(frame), Params(limit_break=120.0, slice_rows=50)).alerts()) == alerts
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)


def test_crowded_times_are_numbered_by_bands(spark, monkeypatch):
    monkeypatch.setattr(bursts_module, "_ID_BAND_BITS", 1)
    frame, events = entries(spark, random.Random(5), 20 * SECOND, 1500)
    _, severe, overall = fold.detect(events, 20 * SECOND)
    found = Bursts(materialize(frame), Params(limit_break=20.0))
    counted = {r["event_id"]: (offset(r["window_start"]), r["count"]) for r in found.severity_windows().collect()}
    assert counted == severe
    counted = {r["event_id"]: (offset(r["window_start"]), r["count"]) for r in found.overall_windows().collect()}
    assert counted == overall


def test_address_is_that_of_the_first_event_ever(spark):
    frame, events = entries(spark, random.Random(8), 10 * SECOND, 300)
    ips = {r["category"]: r["ip"] for r in Bursts(materialize(frame), Params()).burst_ip().collect()}

    def first(levels):
        event_id = min(event for event in events if event[2] in levels)[1]
        return f"10.0.{event_id % 7}.{event_id % 256}"

    assert ips == {
        "ERROR": first({"ERROR"}),
        "CRITICAL": first({"CRITICAL"}),
        "AGGREGATE_TRAFFIC": first({"ERROR", "CRITICAL", "INFO", "DEBUG", ""}),
    }


def test_no_events(spark):
    empty = spark.createDataFrame([], "event_id long, ts timestamp_ntz, content string")
    found = Bursts(empty, Params())
    assert found.alerts().count() == found.severity_windows().count() == found.overall_windows().count() == 0


@pytest.mark.parametrize("shuffled", [False, True])
def test_streamed_alerts_equal_the_fold(spark, tmp_path, shuffled):
    """Several micro-batches, in order or not, every one cutting through open windows."""
    frame, events = entries(spark, random.Random(11), 30 * SECOND, 2000)
    rows = sorted(frame.collect(), key=lambda row: (row["ts"], row["event_id"]))
    for part in range(4):
        piece = rows[part::4] if shuffled else rows[part * 500 : part * 500 + 500]
        spark.createDataFrame(piece, frame.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    feed = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out, params = str(tmp_path / "out"), Params(limit_break=30.0)
    # neighbouring batches share a time even where files follow each other
    writer = alert_writer(feed, params, out, delay="36500 days" if shuffled else "1 microseconds")
    writer.option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start().awaitTermination()
    flush_alerts(spark, params, out)
    assert late_counts(spark, out).count() == 0
    expected, _, _ = fold.detect(events, 30 * SECOND)
    found = stream_alerts(spark, out)
    assert found.count() > 20
    assert alert_rows(found) == list(expected)
    firsts = {row["category"]: row["ip"] for row in Bursts(materialize(frame), Params()).burst_ip().collect()}
    assert {row["category"]: row["ip"] for row in found.collect()} == firsts


def test_late_events_are_set_aside(spark, tmp_path):
    frame, _ = entries(spark, random.Random(5), 30 * SECOND, 400)
    rows = sorted(frame.collect(), key=lambda row: (row["ts"], row["event_id"]))
    for piece in (rows[200:], rows[:200]):
        spark.createDataFrame(piece, frame.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    feed = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    writer = alert_writer(feed, Params(limit_break=30.0), out, delay="1 microseconds")
    writer.option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start().awaitTermination()
    assert late_counts(spark, out).selectExpr("sum(n)").first()[0] == 200
