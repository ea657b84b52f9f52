"""Readers of log files and JSON files."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# File kinds by (case-sensitive) extension.
TEXT_EXTENSIONS = (".log", ".txt")
JSON_EXTENSIONS = (".json",)


def text_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines split on ``\\n``, one trailing ``\\r`` dropped; blank lines are rows."""
    lines = spark.read.text(path, lineSep="\n", recursiveFileLookup=True)
    return lines.select(_without_cr(F.col("value")).alias("content"))


def _without_cr(line: Column) -> Column:
    return F.regexp_replace(line, "\\r\\z", "")


def extension(file_name: Column) -> Column:
    return F.regexp_extract(file_name, r"\.[^.]*$", 0)


def kind_of(extension: Column, strict: bool = True) -> Column:
    """``text`` or ``json``; other extensions fail the job, or are ``rejected`` when ``strict`` is off."""
    unknown = F.lit("rejected")
    if strict:
        message = F.concat(F.lit("unsupported file extension: "), extension)
        unknown = F.raise_error(message).cast("string")
    return F.when(extension.isin(*TEXT_EXTENSIONS), "text").when(extension.isin(*JSON_EXTENSIONS), "json").otherwise(unknown)


def named(extensions: tuple[str, ...]) -> str:
    """A glob pattern of file names with one of ``extensions``."""
    return "*{" + ",".join(extensions) + "}"


def lines_by_extension(spark: SparkSession, path: str | list[str], strict: bool = True, pattern: str | None = None) -> DataFrame:
    """Every line below ``path`` with the kind its file's extension selects.

    Other extensions fail the job, or become rows of kind ``rejected`` when
    ``strict`` is off.
    """
    lines = spark.read.text(path, lineSep="\n", recursiveFileLookup=True, pathGlobFilter=pattern).select(
        F.col("_metadata.file_path").alias("file_path"),
        extension(F.col("_metadata.file_name")).alias("extension"),
        _without_cr(F.col("value")).alias("content"),
    )
    return lines.withColumn("kind", kind_of(F.col("extension"), strict))


def json_bodies(spark: SparkSession, path: str | list[str], whole_files: bool = False) -> DataFrame:
    """One row per JSON text: a line, or a whole file holding a single value."""
    if whole_files:
        texts = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    else:
        texts = spark.read.text(path, lineSep="\n", recursiveFileLookup=True)
    return texts.select(F.col("value").alias("body")).filter(F.trim(F.regexp_replace("body", r"\s", "")) != "")


#: Stands behind a text when it is parsed, to tell where the parser stopped.
_MARK = "7d1f0c52-end-of-text"
_BLANKS = re.compile(r"[ \t\r\n]*")


def _single(body: Column) -> Column:
    """The value of a text that is one JSON value and nothing else, by one parse.

    The parser stops after the first value without looking at what follows, so the text
    goes into brackets with a mark behind it, which has to be met right there.
    """
    boxed = F.try_parse_json(F.concat(F.lit("[["), body, F.lit(f'],"{_MARK}"]')))
    met = F.try_variant_get(boxed, "$[1]", "string") == _MARK
    alone = F.try_variant_get(boxed, "$[0][1]", "variant").isNull() & F.try_variant_get(boxed, "$[2]", "variant").isNull()
    return F.when(met & alone & ~F.contains(body, F.lit(_MARK)), F.try_variant_get(boxed, "$[0][0]", "variant"))


def _decode(text: str) -> list[tuple[str, str | None]]:
    """Texts of the values that follow each other in ``text``; what can't be decoded comes last, with a fault."""

    def constant(name: str):
        raise ValueError(name)

    decoder, at, out = json.JSONDecoder(parse_constant=constant), 0, []
    while True:
        at = _BLANKS.match(text, at).end()
        if at == len(text):
            return out
        try:
            _, end = decoder.raw_decode(text, at)
        except ValueError:
            return [*out, (text[at:], "malformed")]
        except RecursionError:
            return [*out, (text[at:], "nested too deep")]
        out.append((text[at:end], None))
        at = end


def json_values(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Every JSON value of each text, in ``value``; what is none has its text in ``rejected`` and a ``fault``.

    Texts of a single value, the usual case, stay in native code. Only others go through
    a decoder that goes on after each value; a text is parsed once to tell. Of equal keys in one object the last counts in
    sessions that :func:`lograin.session.prepare` has set up.
    """
    rest = [name for name in bodies.columns if name != body]
    parsed = bodies.withColumn("_value", _single(F.col(body)))
    decode = F.pandas_udf(lambda texts: texts.map(_decode, na_action="ignore"), "array<struct<text:string,fault:string>>")
    # a filter would move below the parser and parse again, so a row's parts are NULL or a list
    others = F.when(F.col("_value").isNull(), F.coalesce(F.col(body), F.lit("")))
    split = parsed.select(*rest, "_value", decode(others).alias("_parts"))
    row = "array<struct<value:variant,rejected:string,fault:string>>"
    whole = F.array(F.struct(F.col("_value"), F.lit(None), F.lit(None))).cast(row)

    def part(p: Column) -> Column:
        value = F.when(p["fault"].isNull(), F.try_parse_json(p["text"]))
        fault = F.coalesce(p["fault"], F.lit("nested too deep"))
        return F.get(F.transform(F.array(value), lambda v: F.struct(v, F.when(v.isNull(), p["text"]), F.when(v.isNull(), fault))), 0)

    found = F.when(F.col("_value").isNotNull(), whole).otherwise(F.transform("_parts", part).cast(row))
    return split.select(*rest, F.inline(found))


def json_rejects(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Texts, or ends of texts, that are no JSON values, with the fault."""
    return json_values(bodies, body).filter(F.col("fault").isNotNull()).drop("value")


def json_documents(bodies: DataFrame, strict: bool = True, body: str = "body") -> DataFrame:
    """Documents of each value: an object itself, every element of an array.

    Other top-level values hold no document. What is no JSON fails the job; with
    ``strict`` off it is left to :func:`json_rejects`.
    """
    kind = F.schema_of_variant(F.col("value"))
    elements = F.when(kind.startswith("OBJECT"), F.array(F.col("value"))).when(
        kind.startswith("ARRAY"), F.col("value").cast("array<variant>")
    )
    rest = [name for name in bodies.columns if name != body]
    if strict:
        message = F.concat(F.lit("not JSON ("), F.col("fault"), F.lit("): "), F.substring("rejected", 1, 200))
        elements = F.when(F.col("fault").isNotNull(), F.raise_error(message).cast("array<variant>")).otherwise(elements)
    return json_values(bodies, body).select(*rest, F.posexplode(elements).alias("pos", "document"))
