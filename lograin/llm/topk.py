"""Exact top-k inner products by a three-phase uniform threshold.

A score is the sum of partial scores over groups of dimensions; each group of each block
of candidates is one list. Phase 1 takes the best ``k`` entries of every list and
gathers their scores; the k-th best of them is a cutoff that the true top k reach.
Phase 2 hands the cutoffs to all lists: an entry whose total reaches the
cutoff has a part of at least cutoff / groups in some list (parts counted from the
list's smallest), so only such entries are collected, and dropped when the parts
collected plus the threshold for the others stay below. Phase 3 resolves the rest
exactly and keeps, per query, what reaches the cutoff.

Queries and candidates meet as blocks of bounded size, candidates in order of bands of their length.
Phase 1 multiplies each pair of blocks once. A product is at most the product of the lengths, so a
block of queries is not sent to the bands that are too short for its cutoffs, and in a
pair of blocks the queries and candidates that cannot meet are left out before anything is
multiplied in phases 2 and 3. Vectors of one length leave nothing to prune by it. A block hands on at
most ``k`` entries per query, so equal vectors cannot flood the result, and best scores are merged
:data:`MERGED` lists at a time, ``k`` of which go on.

Defined cases: vectors that are null or hold null or non-finite components take no
part, nor do rows without an id; shorter vectors count as padded with zeros; rows
repeating an id are candidates each, also of one another, and queries each; an empty vector scores 0; an empty
table gives no rows; other columns are ignored. Scores must fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lograin.session import materialize

CANDIDATE_BLOCK, QUERY_BLOCK, SLICE = 4096, 512, 128
GROUPS = 4
#: Lists of best scores that are merged at a time, and bands of vector lengths.
MERGED, BANDS = 64, 64
#: Part of a bound that rounding may cost.
ROUNDING = 1e-9
BLOCK_SQL = "block int, ids binary, own binary, matrix binary, lengths array<double>"


def _pack(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """One row per block: ids and a matrix of longs, padded to its longest vector."""
    vectors = rows.column("vector").combine_chunks()
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.chunk(0)
    lengths = np.diff(vectors.offsets.to_numpy())
    matrix = np.zeros((len(lengths), int(lengths.max(initial=0))), "<i8")
    matrix[np.arange(matrix.shape[1]) < lengths[:, None]] = vectors.flatten().to_numpy()
    found = {n: [rows.column(c).to_numpy().astype("<i8").tobytes()] for n, c in (("ids", "vec_id"), ("own", "row"))}
    lengths = pa.array([_lengths(matrix)], pa.list_(pa.float64()))
    return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), **found, "matrix": [matrix.tobytes()], "lengths": lengths})


def _lengths(matrix: np.ndarray) -> np.ndarray:
    return np.sqrt((matrix.astype(np.float64) ** 2).sum(axis=1))


def _blocks(vectors: DataFrame, size: int) -> tuple[DataFrame, list[tuple[int, float]]]:
    """Blocks of about ``size`` vectors by bands of length, and (blocks, largest length) of each band, shortest first."""
    wanted = min(BANDS, -(-vectors.count() // size))  # no more bands than whole blocks
    shares = [i / wanted for i in range(1, wanted)]
    cuts = sorted(set(vectors.agg(F.percentile_approx("length", shares)).first()[0] or [])) if shares else []
    band = sum((F.col("length") > c).cast("int") for c in cuts) if cuts else F.lit(0)
    banded = vectors.withColumn("band", band)
    stats = {r["band"]: r for r in banded.groupBy("band").agg(F.count("*").alias("n"), F.max("length").alias("longest")).collect()}
    bands, first, pick = [], 0, F.lit(0)
    for b in sorted(stats):
        count = -(-stats[b]["n"] // size)
        pick = F.when(F.col("band") == b, first + F.pmod(F.xxhash64("row"), F.lit(count))).otherwise(pick)
        bands.append((count, stats[b]["longest"]))
        first += count
    packed = banded.select("vec_id", "row", "vector", pick.cast("int").alias("block")).groupBy("block").applyInArrow(_pack, BLOCK_SQL)
    return materialize(packed), bands


def first_block(reach: Column, bands: list[tuple[int, float]]) -> Column:
    """The first block of the first band with a vector as long as ``reach``."""
    short = F.lit(0)
    for count, longest in bands[:-1]:
        short = short + F.when(F.lit(longest) < reach, count).otherwise(0)
    return short.cast("int")


class _Cell:
    """One block of queries against one block of candidates."""

    def __init__(self, row: dict):
        self.query_ids, self.ids, self.query_own, self.own = (np.frombuffer(row[n], "<i8") for n in ("query_ids", "ids", "query_own", "own"))
        queries, items = (
            np.frombuffer(row[n], "<i8").reshape(len(i), -1) for n, i in (("queries", self.query_ids), ("matrix", self.ids))
        )
        dims = max(queries.shape[1], items.shape[1], GROUPS)
        queries, items = (np.pad(m, ((0, 0), (0, dims - m.shape[1]))) for m in (queries, items))
        bound = float(np.abs(queries).max(initial=0)) * float(np.abs(items).max(initial=0)) * dims
        exact = np.float64 if bound < 2**53 else np.int64  # doubles hold these sums exactly
        self.queries, self.items = queries.astype(exact), np.ascontiguousarray(items.astype(exact).T)
        self.lowest = -np.inf if exact is np.float64 else np.iinfo(np.int64).min
        self.groups = [slice(g * dims // GROUPS, (g + 1) * dims // GROUPS) for g in range(GROUPS)]

    def slices(self, queries: np.ndarray, items: np.ndarray | slice = slice(None)) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray]]:
        """Some queries of a slice, their lists over some candidates, and which entries are the query itself."""
        columns, own = self.items[:, items], self.own[items]
        for start in range(0, len(queries), SLICE):
            part = queries[start : start + SLICE]
            yield part, [self.queries[part, g] @ columns[g] for g in self.groups], self.query_own[part, None] == own


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of each row's k largest entries, in no order."""
    k = min(k, scores.shape[1])
    return np.argpartition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k :]


def _gather(k: int):
    schema = pa.schema([("query_block", pa.int32()), ("block", pa.int32()), ("query", pa.int32()), ("scores", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                cell = _Cell(row)
                for part, lists, own in cell.slices(np.arange(len(cell.query_ids))):
                    listed = np.zeros(own.shape, bool)
                    for scores in lists:
                        np.put_along_axis(listed, _best(np.where(own, cell.lowest, scores), k), True, axis=1)
                    total = np.where(listed & ~own, sum(lists), cell.lowest)
                    top = np.take_along_axis(total, _best(total, k), axis=1)
                    found = [r[r > cell.lowest].astype(np.int64) for r in top]
                    blocks = [pa.array(np.full(len(found), row[n], np.int32)) for n in ("query_block", "block")]
                    yield pa.RecordBatch.from_arrays([*blocks, pa.array(part.astype(np.int32)), pa.array(found, pa.list_(pa.int64()))], schema=schema)

    return run


def _resolve(k: int):
    names = ("query_block", "query", "query_id", "vec_id", "score")
    schema = pa.schema([(n, pa.int32() if n in names[:2] else pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                cell = _Cell(row)
                cutoffs = np.array(row["cutoffs"], np.int64)
                queries, items = _in_reach(cutoffs, np.array(row["query_lengths"]), np.array(row["lengths"]))
                for part, lists, own in cell.slices(queries, items):
                    query, item, score = _survivors(lists, own, cutoffs[part])
                    item = items[item]
                    order = np.lexsort((cell.ids[item], -score, query))
                    query, item, score = query[order], item[order], score[order]
                    rank = np.arange(len(query)) - np.searchsorted(query, query)
                    query, item, score = (a[rank < k] for a in (query, item, score))
                    query = part[query]
                    columns = [np.full(len(query), row["query_block"]), query, cell.query_ids[query], cell.ids[item], score]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def _in_reach(cutoffs: np.ndarray, queries: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Queries and candidates, by their lengths, that some product of lengths lets reach a cutoff."""
    slack = ROUNDING * np.abs(cutoffs) + ROUNDING
    some = np.flatnonzero(queries * items.max(initial=0) >= cutoffs - slack)
    # the length a candidate needs for the easiest of these queries
    wanted = np.where(queries[some] > 0, (cutoffs - slack)[some] / np.maximum(queries[some], 1e-300), 0.0)
    return some, np.flatnonzero(items >= wanted.min(initial=np.inf))


def _survivors(lists: list[np.ndarray], own: np.ndarray, cutoff: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Queries, candidates and scores of a slice that reach the cutoff, by phases 2 and 3."""
    least = [scores.min(axis=1) for scores in lists]
    need = cutoff.astype(np.float64) - sum(m.astype(np.float64) for m in least)
    threshold = np.ceil(need / len(lists))
    bound, seen = np.zeros(own.shape), ~own & (need <= 0)[:, None]
    for scores, low in zip(lists, least):
        part = scores - low[:, None]
        reported = part >= (need / len(lists))[:, None]
        bound += np.where(reported, part, threshold[:, None])
        seen |= reported
    query, item = np.nonzero(seen & ~own & (bound >= need[:, None]))
    score = sum(scores[query, item] for scores in lists).astype(np.int64)
    reach = score >= cutoff[query]
    return query[reach], item[reach], score[reach]


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64) -> DataFrame:
    """For each vector whose id is divisible by ``every``, its ``k`` best among all others.

    Components become floor(scale * x). Columns: query_id, rank, vec_id, score.
    """
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("vector")
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & usable)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), whole)
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x)).alias("length")
    rows = materialize(rows.select("vec_id", "vector", length, F.monotonically_increasing_id().alias("row")))
    items, bands = _blocks(rows, CANDIDATE_BLOCK)
    queries, _ = _blocks(rows.filter(F.col("vec_id") % every == 0), QUERY_BLOCK)
    queries = queries.select(
        F.col("block").alias("query_block"), F.col("ids").alias("query_ids"), F.col("own").alias("query_own"),
        F.col("matrix").alias("queries"), F.col("lengths").alias("query_lengths"),
    )
    last = max(sum(count for count, _ in bands) - 1, 0)

    def cells(left: DataFrame, first: Column) -> DataFrame:
        met = left.withColumn("block", F.explode(F.sequence(first, F.lit(last))))
        return met.join(items.hint("shuffle_hash"), "block")

    gathered = cells(queries, F.lit(0)).mapInArrow(_gather(k), "query_block int, block int, query int, scores array<long>")
    cutoffs = _cutoffs(gathered, k, last + 1).groupBy("query_block").agg(
        F.sort_array(F.collect_list(F.struct("query", "cutoff"))).getField("cutoff").alias("cutoffs")
    )
    waiting = queries.join(materialize(cutoffs), "query_block")
    found = cells(waiting, first_block(shortest_reach(), bands)).mapInArrow(
        _resolve(k), "query_block int, query int, query_id long, vec_id long, score long"
    )
    rank = F.row_number().over(Window.partitionBy("query_block", "query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _cutoffs(gathered: DataFrame, k: int, blocks: int) -> DataFrame:
    """(query_block, query, cutoff) of (query_block, block, query, scores): the k-th best score, or none."""
    best = F.slice(F.sort_array(F.flatten(F.collect_list("scores")), asc=False), 1, k).alias("scores")
    while blocks > 1:
        gathered = gathered.groupBy("query_block", "query", F.floor(F.col("block") / MERGED).cast("int").alias("block")).agg(best)
        blocks = -(-blocks // MERGED)
    ordered = F.sort_array("scores", asc=False)
    kth = F.coalesce(F.get(ordered, F.lit(k - 1)), F.lit(-(1 << 62))).alias("cutoff")
    return gathered.select("query_block", "query", kth)


def shortest_reach() -> Column:
    """The length a candidate needs to reach the cutoff of the easiest query of a block."""

    def one(query: Column) -> Column:
        cutoff = query["cutoffs"] - ROUNDING * F.abs(query["cutoffs"]) - ROUNDING
        return F.when(query["query_lengths"] > 0, cutoff / query["query_lengths"]).otherwise(0.0)

    return F.array_min(F.transform(F.arrays_zip("cutoffs", "query_lengths"), one))
