"""Column functions that turn a raw log line into its template key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lograin.functions import patterns as P
from lograin.params import Params


def trim_space(text: Column) -> Column:
    """Trim Unicode white space (``trim`` alone strips only the plain space)."""
    return F.btrim(text, F.lit(P.SPACES))


def strip_ipv4(text: Column) -> Column:
    return F.regexp_replace(text, P.IP, "")


def strip_log_id(text: Column, id_log: Column, params: Params) -> Column:
    """Remove ``<configured id>_<digits>`` from entries that carry an id."""
    without = F.regexp_replace(text, P.log_id(params.id_log), "")
    return F.when(F.length(id_log) > 0, without).otherwise(text)


def lower_text(text: Column) -> Column:
    return F.lower(text)


def strip_dates(text: Column) -> Column:
    return F.regexp_replace(text, P.DATE, "")


def strip_levels(text: Column) -> Column:
    return trim_space(F.regexp_replace(text, P.LEVEL, ""))


def extract_level(text: Column) -> Column:
    """First level word in upper case, empty when there is none."""
    return F.upper(F.regexp_extract(text, P.LEVEL, 0))


def remove_words(text: Column, params: Params) -> Column:
    """Delete the configured words in one pass; earlier words win a position."""
    pattern = P.any_word(params.words)
    return F.regexp_replace(text, pattern, "") if pattern else text


def mask_digits(text: Column) -> Column:
    return trim_space(F.regexp_replace(text, r"\d+", "*"))


def lowered_line(content: Column, id_log: Column, params: Params) -> Column:
    return lower_text(strip_log_id(strip_ipv4(trim_space(content)), id_log, params))


def clean_line(low: Column, params: Params) -> Column:
    return remove_words(strip_levels(strip_dates(low)), params)


def sanitize_line(content: Column, id_log: Column, params: Params) -> Column:
    low = lowered_line(content, id_log, params)
    return F.concat(extract_level(low), clean_line(low, params))


def cluster_key(content: Column, id_log: Column, params: Params) -> Column:
    return mask_digits(sanitize_line(content, id_log, params))


def first_ip(content: Column) -> Column:
    """First blank-separated token that is an address or a CIDR block.

    Returns the address part as written, NULL when no token qualifies.
    """
    token = F.regexp_extract(content, P.LONE_IP, 0)
    return F.nullif(F.split_part(token, F.lit("/"), F.lit(1)), F.lit(""))


def with_message(entries: DataFrame, params: Params) -> DataFrame:
    """Add ``level`` (of the raw line) and ``message`` (its template key).

    The lowered line feeds both the key's prefix and its body, so it gets a
    projection of its own and is evaluated once per row.
    """
    low = lowered_line(F.col("content"), F.col("id_log"), params)
    key = mask_digits(F.concat(extract_level(F.col("_low")), clean_line(F.col("_low"), params)))
    return (
        entries.withColumn("_low", low)
        .withColumns({"level": extract_level(F.col("content")), "message": key})
        .drop("_low")
    )
