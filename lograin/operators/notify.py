"""Alert messages for chat webhooks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lograin.functions.times import alert_time
from lograin.operators.payloads import _rfc3339
from lograin.params import Params

# Webhook kinds by url prefix, the text of a missing address, colour and
# field titles of an embed, layout of a summary.
WEBHOOK_PREFIXES = {"discord": "https://discord.com", "slack": "https://hooks.slack.com"}
NO_IP = "<nil>"

COLOR = 16777215
EMBED_FIELDS = ("Errors", "Category", "Start Time", "Counts", "IP")
SUMMARY = "```%s\nCount: %%d - Start Time: %%s - Category: %%s - IP: %%s```"

# Our own wording.
HEADLINE = "Traffic is above its limit."
AUTHOR = "lograin"
FOOTER = "log distillation"


def webhook_kind(url: Column) -> Column:
    """Kind of a webhook url, NULL when it is none we can format for."""
    kind = F.lit(None).cast("string")
    for name, prefix in WEBHOOK_PREFIXES.items():
        kind = F.when(url.startswith(prefix), name).otherwise(kind)
    return kind


def alert_routing(alerts: DataFrame, params: Params) -> DataFrame:
    """One row per alert and webhook that has a kind."""
    urls = F.array(*[F.lit(url) for url in params.webhook_urls]).cast("array<string>")
    routed = alerts.withColumn("url", F.explode(urls)).withColumn("kind", webhook_kind(F.col("url")))
    return routed.filter("kind is not null")


def _ip() -> Column:
    return F.coalesce("ip", F.lit(NO_IP))


def discord_payload(routed: DataFrame) -> DataFrame:
    def entry(name: str, value: Column, inline: bool = True) -> Column:
        return F.struct(F.lit(name).alias("name"), value.alias("value"), F.lit(inline).alias("inline"))

    fields = F.array(
        entry(EMBED_FIELDS[0], F.lit(HEADLINE), inline=False),
        entry(EMBED_FIELDS[1], F.col("category")),
        entry(EMBED_FIELDS[2], alert_time(F.col("window_start"))),
        entry(EMBED_FIELDS[3], F.col("count").cast("string")),
        entry(EMBED_FIELDS[4], _ip()),
    )
    embed = F.struct(
        F.col("category").alias("title"),
        F.lit(HEADLINE).alias("description"),
        F.lit(COLOR).alias("color"),
        fields.alias("fields"),
        F.struct(F.lit(AUTHOR).alias("name")).alias("author"),
        F.struct(F.lit(FOOTER).alias("text")).alias("footer"),
        _rfc3339(F.col("ts")).alias("timestamp"),
    )
    body = F.to_json(F.struct(F.lit("").alias("content"), F.array(embed).alias("embeds")))
    return routed.filter("kind = 'discord'").select("category", "ts", "url", body.alias("body"))


def slack_payload(routed: DataFrame) -> DataFrame:
    text_type = "struct<type:string,text:string,emoji:boolean>"

    def text(kind: str, value: Column, emoji: bool | None) -> Column:
        return F.struct(F.lit(kind).alias("type"), value.alias("text"), F.lit(emoji).alias("emoji")).cast(text_type)

    def block(kind: str, text: Column | None = None, elements: Column | None = None) -> Column:
        # to_json leaves out NULL fields
        return F.struct(
            F.lit(kind).alias("type"),
            (F.lit(None) if text is None else text).cast(text_type).alias("text"),
            (F.lit(None) if elements is None else elements).cast(f"array<{text_type}>").alias("elements"),
        )

    summary = F.format_string(
        SUMMARY % HEADLINE,
        "count", alert_time(F.col("window_start")), "category", _ip(),
    )
    blocks = F.array(
        block("header", text("plain_text", F.col("category"), True)),
        block("section", text("mrkdwn", summary, None)),
        block("divider"),
        block("context", elements=F.array(text("plain_text", F.lit(f"Author: {AUTHOR}"), True))),
    )
    body = F.to_json(F.struct(F.lit("").alias("text"), blocks.alias("blocks")))
    return routed.filter("kind = 'slack'").select("category", "ts", "url", body.alias("body"))
