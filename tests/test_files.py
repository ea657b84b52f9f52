"""Readers, reports and writers of files."""

import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from lograin import Params
from lograin.operators import reports, stats
from lograin.plans.distill import distill_file, distill_folder, distill_folder_to_reports, distill_to_report, file_extension
from lograin.session import materialize
from lograin.sources import files, sinks

PARAMS = Params(id_log="app", hour="06:00:00")


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode())
    return str(path)


def lines_below(folder):
    parts = sorted(glob.glob(os.path.join(folder, "part-*")))
    return [line for part in parts for line in open(part, encoding="utf-8").read().split("\n")[:-1]]


def test_text_lines(spark, tmp_path):
    path = write(tmp_path / "a.log", "one\r\n\n two\rhalf \r\r\nlast")
    assert [row[0] for row in files.text_lines(spark, path).collect()] == ["one", "", " two\rhalf \r", "last"]


def test_distill_text_file(spark, tmp_path):
    path = write(tmp_path / "in.log", "app_1 ERROR: disk 5\napp_2 error: disk 6\n\ninfo hi\n")
    rows = {row["message"]: row["count"] for row in distill_file(spark, path, PARAMS).collect()}
    assert rows == {"ERROR: disk *": 2, "": 1, "INFOhi": 1}
    distill_to_report(spark, path, str(tmp_path / "out"), PARAMS)
    lines = lines_below(tmp_path / "out")
    assert lines[:3] == ["\tRESULT", reports.RULE, "ORIGIN: [file-reader]"]
    assert lines[3].startswith("- [2] ERROR: disk * -- (First seen ")
    assert lines[-1] == reports.RULE and len(lines) == 7


def test_distill_json_file(spark, tmp_path):
    path = write(tmp_path / "in.json", '{"a": 1}\n\n{"a": 2.5}\n[{"a": "x y"}, {}, null]\n7\n')
    distill_to_report(spark, path, str(tmp_path / "out"), PARAMS)
    assert lines_below(tmp_path / "out") == [
        "\tRESULT",
        reports.RULE,
        "ORIGIN: [file-reader]",
        "- Data: [a:<NUM>||] - Count: [2]",
        "- Data: [a:x y||] - Count: [1]",
        reports.RULE,
    ]


def test_whole_json_files(spark, tmp_path):
    write(tmp_path / "in" / "a.json", '[\n  {"a":\n 1},\n  {"b": 2}\n]\n')
    documents = files.json_documents(files.json_bodies(spark, str(tmp_path / "in"), whole_files=True))
    assert documents.count() == 2


def test_distil_json_in_any_layout(spark, tmp_path):
    """A pretty-printed array, values one after another, and lines."""
    write(tmp_path / "in" / "a.json", '[\n  {"a":\n 1},\n  {"b": 2}\n]\n')
    write(tmp_path / "in" / "b.json", '{"a": 1} {"a": 2}\n{\n"a": 3}\n')
    write(tmp_path / "in" / "c.json", '{"a": 1}\n{"c": "x y"}\n')
    rows = {row["message"]: row["count"] for row in distill_file(spark, str(tmp_path / "in"), PARAMS, ".json").collect()}
    assert rows == {"a:<NUM>||": 5, "b:<NUM>||": 1, "c:x y||": 1}


def test_distil_a_folder(spark, tmp_path):
    """All files of a kind in one plan, every file with its own counts and report."""
    write(tmp_path / "in" / "a.log", "error: disk 5\nerror: disk 6\n")
    write(tmp_path / "in" / "sub" / "b.json", '{"a": 1}\n')
    write(tmp_path / "in" / "c.json", '[\n{"a": 1},\n{"a":\n2}]')
    write(tmp_path / "in" / "d.txt", "error: disk 7\n")
    counts = distill_folder_to_reports(spark, str(tmp_path / "in"), str(tmp_path / "out"), PARAMS, dt.date(2024, 3, 9))
    rows = {(r["file_path"].rsplit("/", 1)[1], r["kind"], r["message"]): r["count"] for r in counts.collect()}
    assert rows == {
        ("a.log", "text", "ERROR: disk *"): 2, ("d.txt", "text", "ERROR: disk *"): 1, ("b.json", "json", "a:<NUM>||"): 1, ("c.json", "json", "a:<NUM>||"): 2,
    }
    folders = {name.rsplit("%2F", 1)[1]: name for name in os.listdir(tmp_path / "out") if name.startswith("report=")}
    assert sorted(folders) == [
        "a_2024-03-09_normalized.log", "b_2024-03-09_normalized-json.log", "c_2024-03-09_normalized-json.log", "d_2024-03-09_normalized.log",
    ]
    assert "- [2] ERROR: disk * --" in lines_below(tmp_path / "out" / folders["a_2024-03-09_normalized.log"])[3]
    assert lines_below(tmp_path / "out" / folders["c_2024-03-09_normalized-json.log"])[3] == "- Data: [a:<NUM>||] - Count: [2]"
    assert distill_folder(spark, str(tmp_path / "in" / "sub"), PARAMS).count() == 1
    write(tmp_path / "in" / "c.csv", "x")
    with pytest.raises(Exception, match="unsupported file extension"):
        distill_folder(spark, str(tmp_path / "in"), PARAMS)


def test_extensions(spark, tmp_path):
    for name, text in {"a.log": "l", "b.txt": "t", "c.json": "{}", "d.LOG": "x", "e": "y", "f.log.csv": "z"}.items():
        write(tmp_path / "in" / name, text)
    lenient = files.lines_by_extension(spark, str(tmp_path / "in"), strict=False)
    kinds = {row["content"]: (row["extension"], row["kind"]) for row in lenient.collect()}
    assert kinds == {
        "l": (".log", "text"),
        "t": (".txt", "text"),
        "{}": (".json", "json"),
        "x": (".LOG", "rejected"),
        "y": ("", "rejected"),
        "z": (".csv", "rejected"),
    }
    with pytest.raises(Exception, match="unsupported file extension"):
        files.lines_by_extension(spark, str(tmp_path / "in")).collect()
    with pytest.raises(ValueError, match="unsupported file extension"):
        distill_file(spark, "/data/x.csv", PARAMS)
    assert [file_extension(path) for path in ("/a.b/c", "c.tar.gz", ".log")] == ["", ".gz", ".log"]


def test_report_path():
    on = dt.date(2024, 3, 9)
    assert sinks.report_path("/logs/app.log", on) == "/logs/app_2024-03-09_normalized.log"
    assert sinks.report_path("/logs/a.b.json", on, "normalized-json") == "/logs/a.b_2024-03-09_normalized-json.log"


def entries(spark):
    rows = [
        (1, dt.datetime(2024, 1, 1, 5, 59, 58), "s1", "app", "error: a 1"),
        (2, dt.datetime(2024, 1, 1, 5, 59, 59), "s1", "app", "error: a 2"),
        (3, dt.datetime(2024, 1, 1, 6, 0, 0), "s1", "app", "error: a 3"),
        (4, dt.datetime(2024, 1, 1, 23, 0, 0), "s0", "app", "b"),
        (5, dt.datetime(2024, 1, 2, 5, 0, 0), "s1", "app", "error: a 4"),
    ]
    return spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, source string, id_log string, content string")


def test_daily_files_list_interval_batches(spark, tmp_path):
    out = str(tmp_path / "daily")
    daily = materialize(stats.daily_report(entries(spark), PARAMS))
    sinks.write_daily_files(reports.daily_lines(daily, PARAMS), out)
    assert lines_below(f"{out}/report_date=2024-01-01") == [
        "DIARY REPORT - Set time: [06:00:00]",
        reports.RULE,
        "ORIGIN: [s1]",
        "- [1] ERROR: a * -- (First seen 06:00:00 - Last seen 06:00:00)",
        "ORIGIN: [s0]",
        "- [1] b -- (First seen 23:00:00 - Last seen 23:00:00)",
        "ORIGIN: [s1]",
        "- [1] ERROR: a * -- (First seen 05:00:00 - Last seen 05:00:00)",
        reports.RULE,
    ]
    assert lines_below(f"{out}/report_date=2023-12-31")[3].startswith("- [2] ERROR: a *")
    assert sinks.write_daily_files(reports.daily_lines(daily, PARAMS), out) == []
    assert len(lines_below(f"{out}/report_date=2024-01-01")) == 9


def test_a_day_is_written_once_whatever_ends_a_run(spark, tmp_path, monkeypatch):
    """A run that ends after staging, or between two days, and is repeated."""
    out = str(tmp_path / "daily")
    lines = reports.daily_lines(materialize(stats.daily_report(entries(spark), PARAMS)), PARAMS)
    publish = sinks.publish
    monkeypatch.setattr(sinks, "publish", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        sinks.write_daily_files(lines, out)
    assert not glob.glob(f"{out}/report_date=*")
    monkeypatch.setattr(sinks, "publish", publish)
    staged = glob.glob(f"{out}/_staged-*")[0]
    os.rename(f"{staged}/report_date=2023-12-31", f"{out}/report_date=2023-12-31")  # what a run that ended there leaves
    assert sinks.write_daily_files(lines, out) == ["2024-01-01"]
    assert sinks.write_daily_files(lines, out) == []
    shown = spark.read.text(out, lineSep="\n").groupBy("report_date").count().collect()
    assert sorted(r["count"] for r in shown) == [5, 9]


def test_merged_days(spark):
    merged = stats.daily_report(entries(spark), PARAMS, merge=True)
    rows = {(row["report_day"].day, row["source"]): (row["count"], row["level"]) for row in merged.collect()}
    assert rows == {(31, "s1"): (2, "ERROR"), (1, "s1"): (2, "ERROR"), (1, "s0"): (1, "")}


def test_console_report_of_nothing_is_empty(spark):
    nothing = stats.log_stats(entries(spark).filter("false"), PARAMS)
    assert reports.console_report(nothing).count() == 0


def test_final_report_is_the_open_interval(spark):
    assert [row["last_seen"].hour for row in stats.final_report(entries(spark), PARAMS).collect()] == [5]


def test_level_is_that_of_the_first_entry(spark):
    rows = [
        (9, dt.datetime(2024, 1, 1), "s", "", "1.1.1.1info x"),
        (8, dt.datetime(2024, 1, 1), "s", "", "info x"),
        (7, dt.datetime(2024, 1, 1, 0, 0, 1), "s", "", "1.1.1.1info x"),
    ]
    frame = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, source string, id_log string, content string")
    (row,) = stats.log_stats(frame.filter("event_id > 7"), PARAMS).filter(F.col("message").startswith("INFO")).collect()
    assert row["level"] == "INFO"
