"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models, of toxic and of ordinary text, share their lowest order: words that
are too rare in the labelled text have the same continuation probability in both, so
they say nothing about the class. A text's evidence is its log-likelihood ratio, normalised
by length, over the whole text and over the windows where it is largest (a long text may be toxic
in one place); a logistic curve turns it into a score.

Counts are numbers of distinct labelled texts, over all of them, and stay tables as the models
do: both grow with the labelled text. To score, the models go to the tasks in shards of about
:data:`SHARD` keys by ranges of the key's hash; a task looks up the distinct words and pairs of some
megabytes of text, one shard after another, and holds what it has found and one shard. Words and
pairs in fewer than :data:`RARE` labelled texts have no ratio of their own at any size of the input: the word's
is zero, the pair is scored by backoff. The curve is fitted on at most :data:`CURVE_ROWS` labelled texts that
the counts leave out.

Defined cases: null and empty texts have no evidence and get the score of a ratio of zero;
labels that are null are ignored, a text with both labels counts for both; repeated
rows count once in training and are scored each; without labels of both kinds the
score is the share of label 1 (0 without labels); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lograin.llm import logistic
from lograin.llm.bpe import text_slices
from lograin.llm.idmap import id_map, thin
from lograin.llm.words import WordHashes, mixed
from lograin.session import discard, materialize

RARE = 5
#: Keys of a shard of the models; how many shards there are grows with the models.
SHARD = 1 << 18
WINDOWS = (1, 4, 16, 64)
CURVE_PART, CURVE_ROWS = 5, 20_000
COUNTS = "toxic long, ordinary long"

_WORKER: list[WordHashes] = []


def _hashes() -> WordHashes:
    if not _WORKER:
        _WORKER.append(WordHashes())
    return _WORKER[0]


@dataclass(frozen=True)
class Model:
    """Log ratios: of words after unknown or rare words, of pairs, and of backing off.

    All of them, or those that some texts can meet.
    """

    words: np.ndarray  # sorted hashes
    word_ratio: np.ndarray
    backoff: np.ndarray
    pairs: np.ndarray  # sorted keys, by pair_keys
    pair_ratio: np.ndarray

    def ratios(self, hashes: np.ndarray) -> np.ndarray:
        """Log-likelihood ratio of every word given the one before it."""
        index, known = _index(self.words, hashes)
        if not len(self.words):
            return np.zeros(len(hashes))
        ratio = np.where(known, self.word_ratio[index], 0.0)
        both = np.flatnonzero(known[1:] & known[:-1])
        ratio[both + 1] += self.backoff[index[both]]
        if len(self.pairs):
            at, hit = _index(self.pairs, pair_keys(hashes[both], hashes[both + 1]))
            ratio[both[hit] + 1] = self.pair_ratio[at[hit]]
        return ratio

    def evidence(self, hashes: np.ndarray) -> list[float]:
        """Mean ratio of the text and the largest mean of a window of each length."""
        ratio = self.ratios(hashes)
        if not len(ratio):
            return [0.0] * (1 + len(WINDOWS))
        run = np.concatenate(([0.0], np.cumsum(ratio)))
        found = [run[-1] / len(ratio)]
        for size in WINDOWS:
            size = min(size, len(ratio))
            found.append(float((run[size:] - run[:-size]).max() / size))
        return found


@dataclass(frozen=True)
class Shards:
    """Both models in shards, each of sorted keys and the columns of :class:`Model`."""

    words: list[Broadcast]
    pairs: list[Broadcast]

    def model(self, texts: list[np.ndarray]) -> Model:
        """What these texts, as hashes of their words, can meet of the models."""
        flat = np.concatenate(texts) if texts else np.zeros(0, np.uint64)
        words, word_ratio, backoff = _met(self.words, np.unique(flat))
        pairs, pair_ratio = _met(self.pairs, np.unique(pair_keys(flat[:-1], flat[1:])))
        return Model(words, word_ratio, backoff, pairs, pair_ratio)


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(mixed(first) + second)


def _index(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    index = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return index, keys[index] == wanted if len(keys) else np.zeros(len(wanted), bool)


def _met(shards: list[Broadcast], keys: np.ndarray) -> list[np.ndarray]:
    """Columns of the shards' rows that have one of the sorted ``keys``, in their order."""
    edges = np.arange(1, len(shards), dtype=np.uint64) * np.uint64((1 << 64) // len(shards) if len(shards) > 1 else 0)
    found = []
    for shard, own in zip(shards, np.split(keys, np.searchsorted(keys, edges))):
        # read anew, as a worker would keep each value
        table = shard.load_from_path(shard._path) if getattr(shard, "_path", None) else shard.value
        at, hit = _index(table[0], own)
        found.append([column[at[hit]] for column in table])
    return [np.concatenate(columns) for columns in zip(*found)]


def _shipped(table: DataFrame) -> list[Broadcast]:
    """Shards of ``table``, whose first column is the key; the driver holds one shard at a time."""
    key, *others = table.columns
    bits = max(0, (table.count() - 1) // SHARD).bit_length()
    shard = F.shiftrightunsigned(key, 64 - bits).cast("int") if bits else F.lit(0)
    dealt = materialize(table.withColumn("shard", shard).repartition("shard").sortWithinPartitions("shard"))
    shards = []
    for number in range(1 << bits):
        rows = dealt.filter(F.col("shard") == number).toArrow()
        keys = rows.column(key).to_numpy().view(np.uint64)
        order = np.argsort(keys)
        shards.append(table.sparkSession.sparkContext.broadcast([keys[order], *(rows.column(c).to_numpy()[order] for c in others)]))
    discard(dealt)
    return shards


def _counted(names: list[str]):
    """Numbers of toxic and ordinary texts that hold a word, or with two names a pair, summed by slice."""

    def columns(hashes: np.ndarray) -> list[np.ndarray]:
        return [hashes] if len(names) == 1 else [pair_keys(hashes[:-1], hashes[1:]), hashes[:-1], hashes[1:]]

    def distinct(found: list[np.ndarray]) -> list[np.ndarray]:
        at = np.unique(found[0], return_index=True)[1]
        return [c[at] for c in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column("label").to_numpy()
            for start, texts in text_slices(batch, "text", 1 << 23):
                sets = [distinct(columns(_hashes().of(t))) for t in texts]
                flat = [np.concatenate(c) for c in zip(*sets)]
                label = np.repeat(labels[start : start + len(texts)], [len(s[0]) for s in sets])
                keys, at, place = np.unique(flat[0], return_index=True, return_inverse=True)
                toxic = np.bincount(place, weights=label, minlength=len(keys)).astype(np.int64)
                every = np.bincount(place, minlength=len(keys))
                own = [c[at].view(np.int64) for c in flat[-len(names) :]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*own, toxic, every - toxic)], names=[*names, "toxic", "ordinary"])

    return run


def _summed(train: DataFrame, *names: str) -> DataFrame:
    schema = ", ".join([*(f"{n} long" for n in names), COUNTS])
    counts = train.select("text", "label").mapInArrow(_counted([*names]), schema)
    return counts.groupBy(*names).agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        first, second = (batch.column(i).to_numpy().view(np.uint64) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(pair_keys(first, second).view(np.int64)), batch.column(2)], names=["key", "ratio"])


def _discount(ones: float, twos: float) -> float:
    return ones / (ones + 2 * twos) if ones and twos else 0.75


def count_models(train: DataFrame) -> Shards:
    """Both models from (text, label) rows."""
    classes = ("toxic", "ordinary")
    enough = F.col("toxic") + F.col("ordinary") >= RARE

    def few(counts: DataFrame) -> list[float]:
        rows = counts.agg(*[F.sum((F.col(c) == n).cast("long")) for c in classes for n in (1, 2)]).first()
        return [_discount(rows[2 * i] or 0, rows[2 * i + 1] or 0) for i in range(2)]

    unigrams = materialize(_summed(train, "word"))
    word_cuts = few(unigrams)
    known = materialize(unigrams.filter(enough))
    discard(unigrams)
    pairs = materialize(_summed(train, "first", "second"))
    pair_cuts = few(pairs)
    kinds = [F.sum((F.col(c) > 0).cast("long")).alias(f"kinds_{c}") for c in classes]
    after = pairs.groupBy(F.col("first").alias("word")).agg(*[F.sum(c).alias(f"in_{c}") for c in classes], *kinds)
    before = pairs.groupBy(F.col("second").alias("word")).agg(F.count("*").alias("continued"))
    # merged at every size: words have no bound that would allow to broadcast them
    words = known.join(after.hint("merge"), "word", "left").join(before.hint("merge"), "word", "left")
    words = materialize(words.fillna(0))
    sums = words.agg(F.count("*"), F.sum("continued"), *[F.sum(c) for c in classes], *[F.sum((F.col(c) > 0).cast("long")) for c in classes]).first()
    sums = [float(s or 0) for s in sums]
    shared = (F.col("continued") + 1) / F.lit(sums[1] + sums[0] + 1)

    def own(i: int) -> Column:
        total = max(sums[2 + i], 1.0)
        return F.greatest(F.col(classes[i]) - word_cuts[i], F.lit(0.0)) / total + max(word_cuts[i] * sums[4 + i] / total, 1e-3) * shared

    def left(i: int) -> Column:
        seen = F.col(f"in_{classes[i]}")
        return F.when(seen > 0, F.greatest(pair_cuts[i] * F.col(f"kinds_{classes[i]}") / F.greatest(seen, F.lit(1)), F.lit(1e-3))).otherwise(1.0)

    ratio, backoff = (F.log(f(0)) - F.log(f(1)) for f in (own, left))
    firsts = words.select(F.col("word").alias("first"), *[f(i).alias(f"{n}{i}") for i in range(2) for n, f in (("left", left), ("seen", lambda i: F.greatest(f"in_{classes[i]}", F.lit(1))))])
    seconds = words.select(F.col("word").alias("second"), *[own(i).alias(f"own{i}") for i in range(2)])
    kept = pairs.filter(enough).join(firsts.hint("merge"), "first").join(seconds.hint("merge"), "second")
    chance = [F.greatest(F.col(classes[i]) - pair_cuts[i], F.lit(0.0)) / F.col(f"seen{i}") + F.col(f"left{i}") * F.col(f"own{i}") for i in range(2)]
    kept = materialize(kept.select("first", "second", (F.log(chance[0]) - F.log(chance[1])).alias("ratio")))
    discard(pairs)
    shards = Shards(_shipped(words.select("word", ratio.alias("ratio"), backoff.alias("backoff"))), _shipped(kept.mapInArrow(_keyed, "key long, ratio double")))
    for used in (known, words, kept):
        discard(used)
    return shards


def _scored(shards: Shards, weights: np.ndarray | None, intercept: float):
    """Evidence of each text, or with weights its score."""
    names = [f"e{i}" for i in range(1 + len(WINDOWS))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_slices(batch, "text", 1 << 23):
                hashes = [_hashes().of(t) for t in texts]
                model = shards.model(hashes)
                found = np.array([model.evidence(h) for h in hashes]).reshape(-1, len(names))
                own = batch.slice(start, len(texts))
                if weights is None:
                    yield pa.RecordBatch.from_arrays([own.column("label"), *map(pa.array, found.T.copy())], names=["label", *names])
                else:
                    score = 1 / (1 + np.exp(-np.clip(found @ weights + intercept, -30, 30)))
                    yield pa.RecordBatch.from_arrays([own.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    return run


def training_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, label, part): every distinct labelled text once per label.

    ``labels`` has (doc_id, label). Only texts with a label are shuffled.
    """
    marks = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"))
    wanted = materialize(
        marks.join(labels.filter("label is not null and doc_id is not null"), "doc_id")
        .groupBy("mark", "label").agg(F.min("doc_id").alias("of"))
    )
    texts = thin(docs.select("doc_id", "text"), "doc_id", id_map(wanted, "of"))
    # merged at every size: the labels have no bound that would allow to broadcast them
    joined = texts.join(wanted.hint("merge"), F.col("doc_id") == F.col("of")).filter(F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("mark"))
    part = F.pmod(F.xxhash64("mark", F.lit("part")), F.lit(CURVE_PART)).cast("int").alias("part")
    return materialize(joined.select("text", F.col("label").cast("int").alias("label"), part, "mark"), "zstd")


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score) of every document, from models of the labelled ones.

    ``labels``: (doc_id, label), 1 for toxic, of documents that training may see.
    """
    texts = docs.select("doc_id", "text")
    train = training_texts(texts, labels)
    kinds = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(kinds) < 2:
        return texts.select("doc_id", F.lit(float(1 in kinds)).alias("score"))
    shards = count_models(train.filter("part > 0"))
    curve = train.filter("part = 0").orderBy("mark").limit(CURVE_ROWS).select("text", "label")
    names = ", ".join(f"e{i} double" for i in range(1 + len(WINDOWS)))
    rows = curve.mapInArrow(_scored(shards, None, 0.0), f"label int, {names}").toPandas().to_numpy(float)
    if len(np.unique(rows[:, 0])) < 2:
        weights, intercept = np.eye(1 + len(WINDOWS))[0], float(np.log(kinds[1] / kinds[0]))
    else:
        weights, intercept = logistic.fit(rows[:, 1:], rows[:, 0])
    discard(train)
    return texts.mapInArrow(_scored(shards, weights, intercept), "doc_id long, score double")
