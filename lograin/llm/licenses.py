"""License scans by diagonal voting, in DataFrame functions only.

Every text becomes words (A-Z lowered); every run of ``GRAM`` words is hashed and joined to
the positions of the same run in short templates. A match at word ``pos`` of the text and
``tpos`` of the template votes for the diagonal pos - tpos. Diagonals at most ``DRIFT``
words apart are merged, as inserted or missing words shift one; the share of the
template's runs that a merged diagonal holds is its score. The words of each match are
compared, not only their hashes.

Phrases have to stand word for word: a place is one diagonal that holds all of a phrase's
runs. Notices need a share of ``share``; their labels come on top of the phrases'.

Templates are a parameter: a literal table of a few hundred runs, broadcast whatever the
corpus. Texts are read once and never shuffled; what leaves the scan is one row per
document and one per match, keyed by a number of the row, so rows that repeat an id or
have none stay apart. Per diagonal no more than a template's positions are gathered.

Defined cases: null and empty texts have no words, no labels and score 0; repeated rows are
rows of their own; an empty table gives no rows; other columns are ignored. A very
long text is one row of words in a task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lograin.session import materialize

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM = 3
DRIFT = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Beginnings of well-known license notices, as public texts have them.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
    " documentation files the software to deal in the software without restriction": "mit",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache-2",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the"
    " following conditions are met": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the"
    " free software foundation": "gpl",
    "this work is licensed under the gnu general public license": "gpl",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc",
}


def _rows(phrases: Mapping[str, str], notices: Mapping[str, str]) -> tuple[list[tuple], list[tuple]]:
    """Templates (template, label, exact, runs) and their runs (template, tpos, words)."""
    templates, runs = [], []
    for exact, texts in ((True, phrases), (False, notices)):
        for text, label in texts.items():
            words, number = text.split(), len(templates)
            if len(words) < GRAM:
                raise ValueError(f"a template has {GRAM} words at least: {text!r}")
            templates.append((number, label, exact, len(words) - GRAM + 1))
            runs += [(number, at, words[at : at + GRAM]) for at in range(len(words) - GRAM + 1)]
    return templates, runs


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def _all(conditions: Sequence[Column]) -> Column:
    return reduce(Column.__and__, conditions)


def matches(docs: DataFrame, runs: list[tuple]) -> DataFrame:
    """(row, doc_id, n_words, pos, template, tpos): a row per match, and one or more per document."""
    spark = docs.sparkSession
    grams = spark.createDataFrame(runs, "template int, tpos int, words array<string>")
    parts = [F.col("words")[i].alias(f"t{i}") for i in range(GRAM)]
    grams = F.broadcast(grams.select("template", "tpos", *parts, F.xxhash64(*[F.col("words")[i] for i in range(GRAM)]).alias("hash")))
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), words_of(F.col("text")).alias("words"))
    shifted = [F.slice("words", i + 1, F.size("words")).alias(f"w{i}") for i in range(GRAM)]
    zipped = texts.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), *shifted)
    listed = zipped.select("row", "doc_id", "n_words", F.posexplode_outer(F.arrays_zip(*[f"w{i}" for i in range(GRAM)])).alias("pos", "run"))
    here = [F.col("run")[f"w{i}"] for i in range(GRAM)]
    met = listed.withColumn("own", F.xxhash64(*here)).join(grams, F.col("own") == F.col("hash"), "left")
    same = F.coalesce(_all([h == F.col(f"t{i}") for i, h in enumerate(here)]), F.lit(False))
    first = F.coalesce(F.col("pos") == 0, F.lit(True))
    return met.filter(same | first).select("row", "doc_id", "n_words", "pos", F.when(same, F.col("template")).alias("template"), "tpos")


def spans(found: DataFrame, templates: list[tuple]) -> DataFrame:
    """(row, template, label, exact, start, share): merged diagonals; phrases keep theirs apart."""
    table = found.sparkSession.createDataFrame(templates, "number int, label string, exact boolean, runs int")
    voted = found.filter(F.col("template").isNotNull()).groupBy("row", "template", (F.col("pos") - F.col("tpos")).alias("diagonal"))
    voted = voted.agg(F.collect_set("tpos").alias("held"), F.min("pos").alias("start"))
    voted = voted.join(F.broadcast(table), F.col("template") == F.col("number"))
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("exact") | (F.col("diagonal") - F.lag("diagonal").over(order) > DRIFT), F.lit(True))
    merged = voted.withColumn("apart", apart.cast("int")).withColumn("span", F.sum("apart").over(order))
    each = merged.select("row", "template", "span", "label", "exact", "runs", "start", F.explode("held").alias("tpos"))
    one = each.groupBy("row", "template", "span", "label", "exact", "runs", "tpos").agg(F.min("start").alias("start"))
    share = (F.count("*") / F.first("runs")).alias("share")
    return one.groupBy("row", "template", "span", "label", "exact").agg(F.min("start").alias("start"), share)


def scan(
    docs: DataFrame, phrases: Mapping[str, str] = PHRASES, notices: Mapping[str, str] = NOTICES, share: float = 0.6
) -> DataFrame:
    """Words, phrase places and labels of every document.

    Columns: doc_id, n_words, n_base, first_word, last_word (of the phrases' places),
    base_labels, labels (comma-joined, sorted; empty if none), score (best share of any template).
    """
    templates, runs = _rows(phrases, notices)
    found = materialize(matches(docs, runs))
    held = spans(found, templates)
    place = F.col("exact") & (F.col("share") == 1)
    taken = place | (~F.col("exact") & (F.col("share") >= share))
    judged = held.groupBy("row").agg(
        F.count_if(place).alias("n_base"), F.min(F.when(place, F.col("start"))).alias("first_word"), F.max(F.when(place, F.col("start"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(place, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(taken, F.col("label")))), ",").alias("labels"),
        F.max("share").alias("score"),
    )
    docs_once = found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"))
    joined = docs_once.join(judged, "row", "left")
    return joined.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long"), F.col("last_word").cast("long"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
