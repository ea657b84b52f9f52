"""Exact deduplication with a sharded cuckoo-filter index.

An index is a few tables in the shared folder. Digests are spread over shards; a shard
has one cuckoo filter and a bucket of stored keys (digest, largest document id, number of
copies). A batch is probed against the filters alone: a digest that its filter doesn't know is
new, a hit is verified against the shard's stored keys. New digests join their filter; one
that overflows is built anew from the stored keys with twice the buckets. Insertion
appends the batch to the keys and writes the filters, it does not write older keys again.

The SHA-256 digest stands for the content: a hit whose digest is stored is the same text.
Copies are folded into (digest, largest id, count) before they reach a shard, so a
group that holds a third of all rows is one row there.

Defined cases: a null text counts as empty; a null id never wins against another id,
and a group of null ids only keeps null; repeated rows are copies of each other
and share their ``kept`` mark; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lograin.session import discard, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLOTS = 4
MAX_KICKS = 200
FILTER = "shard int, buckets int, slots binary"
KEY = "shard int, digest binary, keep_id long, copies long"
#: Insertions that exact_dedup takes for a corpus.
BATCHES = 4
#: Keys a shard is planned for; a shard may grow beyond it, its filter then doubles.
SHARD_KEYS = 50_000


class Filter:
    """Cuckoo filter with 16-bit fingerprints (0: free) in buckets of four slots."""

    def __init__(self, buckets: int = 64, slots: bytes | None = None):
        self.mask = buckets - 1
        self.table = [0] * (buckets * SLOTS) if slots is None else np.frombuffer(slots, "<u2").tolist()

    @classmethod
    def holding(cls, keys: list[bytes], buckets: int) -> Filter:
        """A filter of ``buckets`` or the next double of it that has room for all keys."""
        while True:
            built = cls(buckets)
            if all(map(built.add, keys)):
                return built
            buckets *= 2

    @property
    def buckets(self) -> int:
        return self.mask + 1

    def to_bytes(self) -> bytes:
        return np.asarray(self.table, "<u2").tobytes()

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[8:10], "little") or 1
        first = int.from_bytes(digest[:8], "little") & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & self.mask

    def __contains__(self, digest: bytes) -> bool:
        mark, first, second = self._places(digest)
        table, a, b = self.table, first * SLOTS, second * SLOTS
        return mark in table[a : a + SLOTS] or mark in table[b : b + SLOTS]

    def add(self, digest: bytes) -> bool:
        """False on overflow; the filter must then be built anew, a mark has lost its place."""
        mark, first, second = self._places(digest)
        for bucket in (first, second):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.table[slot]:
                    self.table[slot] = mark
                    return True
        bucket = second
        for kick in range(MAX_KICKS):
            slot = bucket * SLOTS + kick % SLOTS
            mark, self.table[slot] = self.table[slot], mark
            bucket = self._other(bucket, mark)
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.table[slot]:
                    self.table[slot] = mark
                    return True
        return False

    def remove(self, digest: bytes) -> None:
        mark, first, second = self._places(digest)
        for bucket in (first, second):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.table[slot] == mark:
                    self.table[slot] = 0
                    return
        raise KeyError(digest)


def _stored(rows: pd.DataFrame, buckets: int) -> Filter:
    return Filter(int(rows["buckets"].iloc[0]), rows["slots"].iloc[0]) if len(rows) else Filter(buckets)


def _filter_row(shard: int, buckets: int, slots: bytes | None) -> pd.DataFrame:
    return pd.DataFrame({"shard": np.array([shard], np.int32), "buckets": np.array([buckets], np.int32), "slots": [slots]})


def _probe(buckets: int):
    def apply(key, batch: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
        known = _stored(filters, buckets)
        return batch.loc[[d in known for d in batch["digest"]], ["shard", "digest"]]

    return apply


def _add(buckets: int):
    """The filter with the batch's digests; without slots if it has no room for them."""

    def apply(key, batch: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
        grown = _stored(filters, buckets)
        fits = all(map(grown.add, batch["digest"]))
        return _filter_row(key[0], grown.buckets, grown.to_bytes() if fits else None)

    return apply


def _remove(buckets: int):
    def apply(key, batch: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
        left = _stored(filters, buckets)
        for digest in batch["digest"]:
            left.remove(digest)
        return _filter_row(key[0], left.buckets, left.to_bytes())

    return apply


def _resize(key, keys: pd.DataFrame, full: pd.DataFrame) -> pd.DataFrame:
    built = Filter.holding(keys["digest"].tolist(), 2 * int(full["buckets"].iloc[0]))
    return _filter_row(key[0], built.buckets, built.to_bytes())


@dataclass(frozen=True)
class CuckooIndex:
    """Immutable version of an index; every change gives the next version.

    ``filters``: (shard, buckets, slots). ``live``: (shard, digest, keep_id, copies), one row per
    live digest as it was first inserted. ``later``: the same columns, one row per digest and later insertion.
    """

    filters: DataFrame
    live: DataFrame
    later: DataFrame
    shards: int
    buckets: int

    @classmethod
    def empty(cls, spark: SparkSession, expected: int) -> CuckooIndex:
        """An index laid out for ``expected`` keys, at least 16 shards."""
        shards = max(16, -(-expected // SHARD_KEYS))
        buckets = 1 << max(6, (-(-expected // (3 * shards))).bit_length())
        return cls(spark.createDataFrame([], FILTER), spark.createDataFrame([], KEY), spark.createDataFrame([], KEY), shards, buckets)

    def _dealt(self, digests: DataFrame) -> DataFrame:
        shard = F.pmod(F.xxhash64("digest"), F.lit(self.shards)).cast("int").alias("shard")
        return digests.filter("digest is not null").select(shard, *[c for c in digests.columns if c != "shard"])

    def _with_filters(self, batch: DataFrame, apply, schema: str) -> DataFrame:
        return batch.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(apply, schema)

    def hits(self, digests: DataFrame) -> DataFrame:
        """(shard, digest) of the distinct digests that the filters know, not verified."""
        batch = self._dealt(digests.select("digest").distinct())
        return self._with_filters(batch, _probe(self.buckets), "shard int, digest binary")

    def _verified(self, digests: DataFrame) -> DataFrame:
        """Hits that are stored: only their buckets of the keys are compared, what no filter knows is not."""
        return materialize(self.hits(digests).join(self.live, ["shard", "digest"], "left_semi"))

    def insert(self, batch: DataFrame) -> CuckooIndex:
        """Add (doc_id, digest) rows; equal digests become one key with the largest id.

        Writes as much as the batch holds, and the filters.
        """
        folded = batch.groupBy("digest").agg(F.max("doc_id").cast("long").alias("keep_id"), F.count("*").alias("copies"))
        folded = materialize(self._dealt(folded))
        seen = self._verified(folded)
        fresh = materialize(folded.join(seen, ["shard", "digest"], "left_anti"))
        again = materialize(folded.join(seen, ["shard", "digest"], "left_semi"))
        for used in (folded, seen):
            discard(used)
        live = self.live.unionByName(fresh)
        filters = materialize(self._with_filters(fresh, _add(self.buckets), FILTER))
        full = filters.filter("slots is null")
        if not full.isEmpty():
            stored = live.join(full.select("shard"), "shard", "left_semi")
            built = stored.groupBy("shard").cogroup(full.groupBy("shard")).applyInPandas(_resize, FILTER)
            filters = materialize(filters.filter("slots is not null").unionByName(built))
        return CuckooIndex(filters, live, self.later.unionByName(again), self.shards, self.buckets)

    def delete(self, digests: DataFrame) -> CuckooIndex:
        """Remove live digests with all their copies; unknown ones are ignored."""
        gone = self._verified(digests)
        filters = materialize(self._with_filters(gone, _remove(self.buckets), FILTER))
        live, later = (materialize(rows.join(gone, ["shard", "digest"], "left_anti")) for rows in (self.live, self.later))
        return CuckooIndex(filters, live, later, self.shards, self.buckets)

    def lookup(self, digests: DataFrame) -> DataFrame:
        """(digest, keep_id, copies) of those digests the index holds: filter hits, verified by their stored keys."""
        return self.hits(digests).join(self._totals(), ["shard", "digest"]).select("digest", "keep_id", "copies")

    def keys(self) -> DataFrame:
        """(digest, keep_id, copies) of every live digest."""
        return self._totals().select("digest", "keep_id", "copies")

    def _totals(self) -> DataFrame:
        more = self.later.groupBy("shard", "digest").agg(F.max("keep_id").alias("later_id"), F.sum("copies").alias("more"))
        return self.live.join(more, ["shard", "digest"], "left").select(
            "shard", "digest", F.greatest("keep_id", "later_id").alias("keep_id"),
            (F.col("copies") + F.coalesce("more", F.lit(0))).alias("copies"),
        )


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest): SHA-256 of the text with A-Z lowered."""
    plain = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    return docs.select("doc_id", F.unhex(F.sha2(plain.cast("binary"), 256)).alias("digest"))


def exact_dedup(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """Every document with the id that stays for its text, as a fresh index knows it.

    The documents enter in ``batches`` by a hash of their ids, so copies meet in the index: a
    copy of an earlier batch is a hit of the filter, verified there. All are looked up at the end.

    Columns: doc_id, keep_id, group_size, kept, text_sha256.
    """
    marked = materialize(digests(docs))
    index = CuckooIndex.empty(docs.sparkSession, marked.count())
    for number in range(batches):
        index = index.insert(marked.filter(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == number))
    return marked.join(index.lookup(marked), "digest").select(
        "doc_id", "keep_id", F.col("copies").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
