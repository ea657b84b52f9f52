"""The corpus pipeline: quality, line dedup, near dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept;
all but the last return the columns of ``documents``. Decisions are narrow rows; a
document's text is shuffled only where its row changes or its decision has to be looked up.

A row is known by its id and the hash of its text, so rows that repeat an id are judged one
by one. Empty tables pass through every stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lograin.llm import bpe, chosen_path, line_dedup, mixing, rules
from lograin.llm.idmap import id_map, split_by_map
from lograin.session import materialize

LAST = (1 << 63) - 1


def _row_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), F.coalesce("text", F.lit("")))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose key is not in ``gone`` (_key)."""
    gone = materialize(gone.distinct())
    touched, others = split_by_map(docs, _row_key(), id_map(gone, "_key"))
    return touched.withColumn("_key", _row_key()).join(gone, "_key", "left_anti").drop("_key").unionByName(others)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; trained on the labels that op8 trains on."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(fold != 1).select("doc_id", F.col("quality").alias("label"))
    measured = materialize(rules.statistics(docs, _row_key()).withColumnRenamed("_more0", "_key"))
    model = rules.fit(measured, labels)
    return _without(docs, measured.filter(model.score() < 0.5).select("_key"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that equal or nearly equal an earlier line go, and documents left without any line."""
    left = line_dedup.dedup_lines(docs)
    changed = (F.col("n_equal") > 0) | (F.col("n_near") > 0)
    blank = F.coalesce(F.regexp_count("text", F.lit(r"\S")), F.lit(0)) == 0
    kept = left.filter(~changed | ~blank)
    size = F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return kept.select(*[size.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (five-word shingles, similarity 0.8)."""
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("_own")
    groups = chosen_path.near_duplicates(docs.select(_row_key().alias("doc_id"), "text"), 5, 80, 100)
    groups = groups.select(F.col("doc_id").alias("_of"), F.col("component_id").alias("_group")).groupBy("_of", "_group").agg(F.count("*").alias("_n"))
    named = docs.select(own, _row_key().alias("_key")).distinct()
    members = materialize(named.join(groups, F.col("_key") == F.col("_of")).select("_own", "_key", "_group", "_n"))
    # the smallest id stays; of rows that repeat it, the one with the smallest hash
    first = members.groupBy("_group").agg(F.min(F.struct("_own", "_key")).alias("_first")).withColumnRenamed("_group", "_in")
    judged = members.join(first, F.col("_group") == F.col("_in"))
    out = materialize(judged.filter((F.col("_key") != F.col("_first")["_key"]) | (F.col("_n") > 1)).select("_key", (F.col("_key") == F.col("_first")["_key"]).alias("_stays")))
    touched, others = split_by_map(docs, _row_key(), id_map(out, "_key"))
    gone, repeated = out.filter(~F.col("_stays")).select("_key"), out.filter("_stays").select("_key")
    touched = touched.withColumn("_key", _row_key()).join(gone, "_key", "left_anti")
    once = touched.join(repeated, "_key", "left_semi").dropDuplicates(["_key"])
    return touched.join(repeated, "_key", "left_anti").unionByName(once).drop("_key").unionByName(others)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated as often as the mix takes them."""
    rated = mixing.mix(docs.select(_row_key().alias("doc_id"), "source", "text"))
    taken = rated.groupBy("doc_id").agg(F.max("copies").alias("_copies")).withColumnRenamed("doc_id", "_of")
    taken = materialize(taken.filter("_copies > 0"))
    joined = docs.withColumn("_key", _row_key()).join(taken, F.col("_key") == F.col("_of"))
    copies = F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))
    return joined.withColumn("_copy", copies).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row: count, digests of the ids and of the decoded bytes."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("line dedup", line_dedup_stage),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources", mix_sources),
    ("byte-level BPE", tokens),
]

#: The fitted classifier, the dual's iterations and the tokenizer are beyond SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "zstd")
    return docs
