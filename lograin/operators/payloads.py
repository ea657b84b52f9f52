"""Reports as JSON bodies and the requests that carry them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lograin.functions.times import payload_time
from lograin.params import Params
from lograin.session import materialize


def _rfc3339(ts: Column) -> Column:
    """UTC time text without trailing zeros in its fraction."""
    return F.concat(F.regexp_replace(payload_time(ts), r"\.?0*Z\z", ""), F.lit("Z"))


def _segments(stats: DataFrame, params: Params, keys: tuple[str, ...], group: list[str], listed: bool) -> DataFrame:
    """Texts of about ``params.payload_messages`` messages that make up, in the order of ``segment``, one JSON text per group.

    Messages are range partitioned in the order in which they are written, so their places in it
    deal them out to segments and no group is put together in one task. What opens and
    closes an origin, or the list of all of them, stands at its first and its last place.
    """
    order = [*keys, "source", "message"]
    item = F.to_json(
        F.struct("count", _rfc3339(F.col("first_seen")).alias("firstSeen"), _rfc3339(F.col("last_seen")).alias("lastSeen"), "message")
    )
    ranged = stats.repartitionByRange(*order).sortWithinPartitions(*order)
    items = materialize(ranged.select(*keys, "source", item.alias("item"), F.monotonically_increasing_id().alias("place")))
    bounds = [F.min("place").alias("first"), F.max("place").alias("last")]
    origins = items.groupBy(*keys, "source").agg(*bounds)
    # the header of an object is that of an empty one, cut open
    opening = F.regexp_replace(F.to_json(F.struct(F.col("source").alias("origin"), F.array().cast("array<int>").alias("data"))), r"\]\}\z", "")
    opens = origins.select(F.col("first").alias("place"), opening.alias("opening"))
    closes = origins.select(F.col("last").alias("place"), F.lit("]}").alias("closing"))
    if listed:
        lists = items.groupBy(*keys).agg(*bounds).filter("first is not null")
        begins = lists.select(F.col("first").alias("place"), F.lit("[").alias("begin"))
        ends = lists.select(F.col("last").alias("place"), F.lit("]").alias("end"))
        opens = opens.join(begins, "place", "left").select("place", F.concat(F.coalesce("begin", F.lit(",")), "opening").alias("opening"))
        closes = closes.join(ends, "place", "left").select("place", F.concat("closing", F.coalesce("end", F.lit(""))).alias("closing"))
    # places are unique: joins of one row with one row
    placed = items.join(opens, "place", "left").join(closes, "place", "left")
    text = F.concat(F.coalesce("opening", F.lit(",")), "item", F.coalesce("closing", F.lit("")))
    segment = F.floor(F.col("place") / params.payload_messages).alias("segment")
    texts = F.array_sort(F.collect_list(F.struct("place", text.alias("text"))))
    return placed.groupBy(*group, segment).agg(F.count("*").alias("messages"), F.array_join(F.transform(texts, lambda t: t["text"]), "").alias("payload"))


def origin_payload(stats: DataFrame, params: Params, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per origin one JSON object that lists its messages, as texts that follow each other by ``segment``."""
    return _segments(stats, params, keys, [*keys, "source"], listed=False)


def report_payload(stats: DataFrame, params: Params, keys: tuple[str, ...] = ()) -> DataFrame:
    """One JSON array over all origins of a report, as texts that follow each other by ``segment``."""
    return _segments(stats, params, keys, list(keys), listed=True).drop("messages").withColumnRenamed("payload", "body")


def joined(segments: DataFrame, keys: tuple[str, ...], text: str) -> DataFrame:
    """Whole texts, for groups that are known to be small."""
    parts = F.array_sort(F.collect_list(F.struct("segment", F.col(text).alias("text"))))
    whole = F.array_join(F.transform(parts, lambda part: part["text"]), "").alias(text)
    sums = [F.sum("messages").alias("messages")] if "messages" in segments.columns else []
    return segments.groupBy(*keys).agg(*sums, whole).filter(F.col(text) != "")


def day_payloads(daily: DataFrame, params: Params) -> DataFrame:
    """Bodies of every interval batch of a day."""
    return report_payload(daily, params, ("report_day", "window_start"))


# The formatter a destination selects: statistics to rows with a ``body``.
FORMATTERS: dict[str, Callable[..., DataFrame]] = {"json": report_payload, "socket": report_payload}


def payload_formatter(destination: str) -> Callable[..., DataFrame]:
    return FORMATTERS.get(destination, report_payload)


def _request_headers(headers, params: Params) -> dict[str, str]:
    own = {name: value for name, value in headers.items() if name.lower() != "user-agent"}
    return own | {"User-Agent": params.user_agent}


def enabled_integrations(integrations: DataFrame) -> DataFrame:
    """Integrations, given as a table, that want aggregated reports."""
    return integrations.filter("on_aggregation")


def integration_fanout(reports: DataFrame, params: Params) -> DataFrame:
    """One row per report and enabled integration of the configuration.

    The configuration is a literal of the query, so rows fan out in place.
    """
    targets = [
        F.struct(
            F.lit(target.url).alias("url"),
            F.create_map(
                *[F.lit(text) for pair in _request_headers(target.headers, params).items() for text in pair]
            ).alias("headers"),
        )
        for target in params.integrations
        if target.on_aggregation
    ]
    if not targets:
        targets = F.array().cast("array<struct<url:string,headers:map<string,string>>>")
        return reports.select("*", F.inline(targets))
    return reports.select("*", F.inline(F.array(*targets)))


def integration_outbox(stats: DataFrame, params: Params, keys: tuple[str, ...] = ()) -> DataFrame:
    """Requests to post: url, headers and body of every enabled integration; bodies are sent in the order of ``segment``."""
    bodies = payload_formatter(params.destination)(stats, params, keys)
    return integration_fanout(bodies, params).select(*keys, "segment", "url", "headers", "body")
