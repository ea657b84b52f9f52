"""Registered queries of the training-data operators, over whole tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lograin.llm import bpe, centroids, chosen_path, cuckoo, licenses, line_dedup, mixing, prefix_trie, rules, sharding, token_files, topk, toxicity
from lograin.llm.sql import LICENSES_SQL, PREFIX_TRIE_SQL, centroids_sql
from lograin.session import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    labels = _table(spark, sf_dir, "labels").filter(fold != 2).select("doc_id", F.col("toxic").alias("label"))
    scored = toxicity.score_toxicity(_table(spark, sf_dir, "documents"), labels)
    held_out = F.coalesce(fold == 2, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as definition:
        tokenizer = definition.read()
    path = scratch_path(spark, "tokens")
    token_files.write(_table(spark, sf_dir, "documents"), tokenizer, path, end_id=2)
    return token_files.read(spark, path)


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), k=20, every=20, scale=64)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode_documents(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shard_by_metadata(_table(spark, sf_dir, "documents"), 16)
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32")
    return left.select("doc_id", "n_lines", "n_equal", "n_near", crc)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    labels = _table(spark, sf_dir, "labels").filter(fold != 1).select("doc_id", F.col("quality").alias("label"))
    scored = rules.score_quality(_table(spark, sf_dir, "documents"), labels)
    held_out = F.coalesce(fold == 1, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(_table(spark, sf_dir, "documents"), size=4, numerator=80, denominator=100)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cuckoo.exact_dedup(_table(spark, sf_dir, "documents"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_table(spark, sf_dir, "embeddings"), k=16, rounds=3, dims=64, scale=64).drop("measured")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"), block=20, heads=4)


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_mixing": op2_mixing,
    "op3_token_files": op3_token_files,
    "op4_topk": op4_topk,
    "op5_bpe": op5_bpe,
    "op6_sharding": op6_sharding,
    "op7_line_dedup": op7_line_dedup,
    "op8_quality": op8_quality,
    "op9_near_dedup": op9_near_dedup,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_centroids": op11_centroids,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_licenses": op13_licenses,
}

OP4_SQL = """
with vectors as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as double)) as v
  from embeddings
  where vec_id is not null and embedding is not null
    and list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false))) is not false
),
scores as (
  select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.v, c.v) as bigint) as score
  from vectors q, vectors c where q.vec_id % 20 = 0 and c.vec_id <> q.vec_id
)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
from scores
qualify rank <= 20
"""

OP10_SQL = """
with texts as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as plain
  from documents
)
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
  doc_id is not distinct from max(doc_id) over same as kept, sha256(plain) as text_sha256
from texts
window same as (partition by plain)
"""

ORACLES = {
    "op4_topk": OP4_SQL,
    "op10_exact_dedup": OP10_SQL,
    "op11_centroids": centroids_sql(),
    "op12_prefix_trie": PREFIX_TRIE_SQL,
    "op13_licenses": LICENSES_SQL,
}
