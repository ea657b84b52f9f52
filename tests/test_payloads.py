"""Payloads, requests and alert messages."""

import datetime as dt
import json

from pyspark.sql import functions as F

from lograin import Integration, Params
from lograin.operators import notify, payloads

STATS = "source string, message string, count long, first_seen timestamp_ntz, last_seen timestamp_ntz"


def stats(spark, sizes):
    seen = dt.datetime(2024, 1, 1, 1, 2, 3, 120000)
    rows = [(s, f'm{i} "q" é', i + 1, seen, seen.replace(microsecond=0)) for s, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, STATS)


def whole(rows, text="body"):
    return "".join(r[text] for r in sorted(rows, key=lambda r: r["segment"]))


def test_a_report_is_one_array(spark):
    text = whole(payloads.report_payload(stats(spark, {"b": 1, "a": 2}), Params()).collect())
    body = json.loads(text)
    assert [origin["origin"] for origin in body] == ["a", "b"]
    assert body[1]["data"] == [
        {"count": 1, "firstSeen": "2024-01-01T01:02:03.12Z", "lastSeen": "2024-01-01T01:02:03Z", "message": 'm0 "q" é'}
    ]
    assert text.startswith('[{"origin":"a","data":[{"count":1,"firstSeen":')
    assert payloads.report_payload(stats(spark, {}), Params()).count() == 0


def test_segments_of_any_size_make_up_the_same_bytes(spark):
    """A hot origin lies in many rows of bounded size, and still is one object of one array."""
    sizes = {"hot": 3000, 'x]} "': 3, "y": 60}
    texts = set()
    for most in (1, 50, 10_000):
        rows = payloads.report_payload(stats(spark, sizes), Params(payload_messages=most)).collect()
        assert max(row["body"].count('"firstSeen"') for row in rows) <= most
        texts.add(whole(rows))
    (text,) = texts
    found = {origin["origin"]: [entry["message"] for entry in origin["data"]] for origin in json.loads(text)}
    assert {name: len(messages) for name, messages in found.items()} == sizes
    assert all(messages == sorted(messages, key=str.encode) for messages in found.values()) and list(found) == sorted(found, key=str.encode)


def test_origins_and_keys_have_texts_of_their_own(spark):
    rows = stats(spark, {"a": 7, "b": 5}).withColumn("day", F.col("count") % 2)
    found = payloads.origin_payload(rows, Params(payload_messages=2), ("day",)).collect()
    groups = {(r["day"], r["source"]) for r in found}
    assert groups == {(d, s) for d in (0, 1) for s in "ab"} and sum(r["messages"] for r in found) == 12
    for day, source in groups:
        one = json.loads(whole([r for r in found if (r["day"], r["source"]) == (day, source)], "payload"))
        assert one["origin"] == source and {entry["count"] % 2 for entry in one["data"]} == {day}
    bodies = payloads.report_payload(rows, Params(payload_messages=3), ("day",)).collect()
    for day in (0, 1):
        body = json.loads(whole([r for r in bodies if r["day"] == day]))
        assert [origin["origin"] for origin in body] == ["a", "b"]


def test_outbox(spark):
    params = Params(
        integrations=(
            Integration("http://a", {"X": "1", "user-agent": "mine"}, True),
            Integration("http://b", {}, False),
            Integration("http://c", {}, True),
        )
    )
    rows = payloads.integration_outbox(stats(spark, {"s": 1}), params).collect()
    assert {row["url"]: row["headers"] for row in rows} == {
        "http://a": {"X": "1", "User-Agent": params.user_agent},
        "http://c": {"User-Agent": params.user_agent},
    }
    assert payloads.integration_outbox(stats(spark, {"s": 1}), Params()).count() == 0


def alerts(spark):
    at = dt.datetime(2024, 1, 2, 3, 4, 5)
    schema = "category string, window_start timestamp_ntz, ts timestamp_ntz, count long, ip string"
    return spark.createDataFrame([("ERROR", at, at, 11, None)], schema)


def test_routing_and_messages(spark):
    urls = ("https://discord.com/x", "https://hooks.slack.com/y", "http://discord.com", "https://other")
    routed = notify.alert_routing(alerts(spark), Params(webhook_urls=urls))
    assert {row["url"]: row["kind"] for row in routed.collect()} == {urls[0]: "discord", urls[1]: "slack"}
    (discord,) = notify.discord_payload(routed).collect()
    embed = json.loads(discord["body"])["embeds"][0]
    fields = {field["name"]: field["value"] for field in embed["fields"]}
    assert embed["title"] == "ERROR" and embed["timestamp"] == "2024-01-02T03:04:05Z"
    assert fields["Start Time"] == "02-01-2024, 03:04" and fields["Counts"] == "11" and fields["IP"] == "<nil>"
    (slack,) = notify.slack_payload(routed).collect()
    blocks = json.loads(slack["body"])["blocks"]
    assert [block["type"] for block in blocks] == ["header", "section", "divider", "context"]
    assert blocks[2] == {"type": "divider"} and "emoji" not in blocks[1]["text"]
    assert "Count: 11 - Start Time: 02-01-2024, 03:04 - Category: ERROR - IP: <nil>" in blocks[1]["text"]["text"]
    assert notify.alert_routing(alerts(spark), Params()).count() == 0
