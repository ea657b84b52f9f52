"""Near-duplicate groups by a chosen-path set similarity join.

A document's set of word shingles is embedded as 128 minwise tokens (one permutation,
binned and densified). A tree sends each set down to children by the tokens at one or two
positions that the node chooses at random, 1 / threshold on average, so a pair that
is as similar as the threshold keeps meeting along some path. Nodes that are small are
compared exhaustively, large ones branch on; independent trees repeat this. With ten
trees a pair exactly at the threshold fails to meet with a probability of 1e-8 after one level, 3e-5
after three, 2e-4 after four and, with the spread of the share of equal tokens, up to 2.6e-3 after five; levels
four and five come up only among over 64 different texts that share much.

Comparing tokens only proposes. Sets that may be linked form candidate groups; within
each, links are confirmed on the full sets. Both steps return a spanning forest of
their group instead of all pairs: components need no more, and no group floods the
output. Groups beyond a tile are dealt over pairs of tiles, each pair a task's
share, so nothing is cut off.

Equal sets are one class from the start. Trees and links are about classes; documents
join their class at the end.

Defined cases: a null text or one without words has an empty set, links with nothing and
is its own component; a text with fewer words than a shingle is one shingle;
repeated rows belong to one class and share their marks; null ids never become a
component's id unless all its ids are null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lograin.llm.components import components
from lograin.llm.words import WordHashes, mixed, shingles
from lograin.session import materialize

TOKENS = 128
TREES, LEVELS, LIMIT = 10, 5, 64
TILE, SET_TILE = 2048, 1024
#: Bits of the map of documents whose sets are needed again; beyond it more sets are read, never fewer.
MAP_BITS = 24

_WORKER: list[WordHashes] = []


def _hashes() -> WordHashes:
    if not _WORKER:
        _WORKER.append(WordHashes())
    return _WORKER[0]


def _draw(*seeds: int) -> int:
    return xxhash.xxh3_64_intdigest(b"".join(int(s).to_bytes(8, "little", signed=True) for s in seeds))


#: For each empty bin, the bins it borrows from, in order.
BORROW = np.array([[_draw(j, a) % TOKENS for a in range(4 * TOKENS)] for j in range(TOKENS)])
EDGES = np.arange(TOKENS, dtype=np.uint64) << np.uint64(57)


def tokens(hashes: np.ndarray) -> np.ndarray:
    """Minwise tokens (32 bits) of a non-empty sorted set of hashes."""
    at = np.searchsorted(hashes, EDGES)
    first = hashes[np.minimum(at, len(hashes) - 1)]
    filled = (at < len(hashes)) & (first >> np.uint64(57) == np.arange(TOKENS, dtype=np.uint64))
    if not filled.all():
        usable = filled[BORROW]
        source = np.where(usable.any(axis=1), BORROW[np.arange(TOKENS), usable.argmax(axis=1)], np.flatnonzero(filled)[0])
        first = np.where(filled, first, first[source])
    return ((first >> np.uint64(25)) & np.uint64(0xFFFFFFFF)).astype("<u4")


def _class_of(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)


def _describe(size: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("class", pa.int64()), ("tokens", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, classes, found = [], [], []
            for text in batch.column("text"):
                own = shingles(_hashes().of(text.as_py()), size)
                counts.append(len(own))
                classes.append(_class_of(own) if len(own) else None)
                found.append(tokens(own).tobytes() if len(own) else None)
            columns = [batch.column("doc_id"), *(pa.array(c, f.type) for c, f in zip((counts, classes, found), list(schema)[1:]))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def _positions(node: int) -> list[int]:
    """Positions a node branches by: one, or two for one node in four."""
    draw = _draw(node)
    return sorted({(draw >> 8) % TOKENS, *([(draw >> 20) % TOKENS] if draw & 3 == 0 else [])})


def _children(nodes: np.ndarray, position: int, values: np.ndarray) -> np.ndarray:
    seed = np.uint64(_draw(position, 1))
    return mixed(mixed(nodes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + seed) + values.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def _branch(trees: list[int] | None):
    """Rows (node, class) of the next level; ``trees``: the roots instead of a column of nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sets = np.frombuffer(b"".join(batch.column("tokens").to_pylist()), "<u4").reshape(-1, TOKENS)
            classes = batch.column("class").to_numpy()
            every = np.arange(len(classes))
            if trees is not None:
                parts = [(root, every) for root in trees]
            else:
                nodes = batch.column("node").to_numpy()
                order = np.argsort(nodes, kind="stable")
                own, starts = np.unique(nodes[order], return_index=True)
                parts = list(zip(own.tolist(), np.split(order, starts[1:])))
            for node, rows in parts:
                for position in _positions(node):
                    child = _children(np.full(len(rows), node, np.int64).view(np.uint64), position, sets[rows, position])
                    yield pa.RecordBatch.from_arrays([pa.array(child), pa.array(classes[rows])], names=["node", "class"])

    return run


def terminal_nodes(classes: DataFrame) -> DataFrame:
    """(node, class, size) of all nodes that are compared, from (class, tokens)."""
    roots = [_draw(tree, 7) >> 1 for tree in range(TREES)]
    members = classes.select("class", "tokens").mapInArrow(_branch(roots), "node long, class long")
    ends = None
    for level in range(1, LEVELS + 1):
        members = materialize(members.distinct() if level > 1 else members)
        sizes = members.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1")
        live = materialize(members.join(sizes.withColumnRenamed("node", "of"), F.col("node") == F.col("of")).drop("of"))
        large = live.filter(F.col("size") > LIMIT)
        end = live if level == LEVELS else live.filter(F.col("size") <= LIMIT)
        ends = end if ends is None else ends.union(end)
        if level == LEVELS or large.isEmpty():
            return ends
        members = large.select("node", "class").join(classes.select("class", "tokens"), "class").mapInArrow(
            _branch(None), "node long, class long"
        )


def _tiled(rows: DataFrame, group: str, tile: int) -> DataFrame:
    """Deal the members of groups over ``tile`` rows to pairs of tiles: adds ``part``."""
    tiles = F.ceil(F.col("size") / tile).cast("int")
    own = F.pmod(F.xxhash64("class"), tiles).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), tiles - 1), lambda t: F.least(t, own) * tiles + F.greatest(t, own))
    return rows.withColumn("part", F.explode(pairs)).withColumn("place", F.xxhash64(group, "part"))


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups, from batches sorted by group and part."""
    held: list[pa.RecordBatch] = []

    def key(batch: pa.RecordBatch, row: int) -> tuple:
        return batch.column(0)[row].as_py(), batch.column(1)[row].as_py()

    for batch in batches:
        if not batch.num_rows:
            continue
        last = key(batch, batch.num_rows - 1)
        groups, parts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        same = (groups == last[0]) & (parts == last[1])
        start = int(np.argmax(same)) if same.any() else batch.num_rows
        if start == 0 and (not held or key(held[-1], held[-1].num_rows - 1) == last):
            held.append(batch)
            continue
        done = held + ([batch.slice(0, start)] if start else [])
        if done:
            yield pa.Table.from_batches(done)
        held = [batch.slice(start)]
    if held:
        yield pa.Table.from_batches(held)


def _groups(table: pa.Table) -> list[tuple[int, int]]:
    keys = np.stack([table.column(i).to_numpy() for i in (0, 1)])
    starts = np.flatnonzero(np.concatenate(([True], (keys[:, 1:] != keys[:, :-1]).any(axis=0))))
    return list(zip(starts.tolist(), [*starts[1:].tolist(), keys.shape[1]]))


def _least_matches(n: np.ndarray, other: np.ndarray, threshold: float) -> np.ndarray:
    """Matching tokens below which a linked pair practically never falls (4.5 deviations)."""
    bins = 0.6 * np.minimum(np.minimum(n, other), TOKENS)
    deviation = np.sqrt(threshold * (1 - threshold) / np.maximum(bins, 1))
    return np.maximum(threshold - 4.5 * deviation, 0.25) * TOKENS


def _propose(threshold: float):
    """Forests of candidate links of whole nodes: rows (a, b)."""

    def near(sets: np.ndarray, n: np.ndarray, of_sets: np.ndarray, of_n: np.ndarray) -> np.ndarray:
        ratio = np.minimum(n, of_n) >= threshold * np.maximum(n, of_n)
        return ratio & ((sets == of_sets).sum(axis=1) >= _least_matches(n, of_n, threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _streamed(batches):
            classes, n = (table.column(c).to_numpy() for c in ("class", "n"))
            sets = np.frombuffer(b"".join(table.column("tokens").to_pylist()), "<u4").reshape(-1, TOKENS)
            groups = _groups(table)
            left = np.array([a for a, b in groups if b - a == 2], np.int64)
            hit = near(sets[left], n[left], sets[left + 1], n[left + 1]) if len(left) else np.zeros(0, bool)
            a, b = [classes[left[hit]]], [classes[left[hit] + 1]]
            for start, end in (g for g in groups if g[1] - g[0] > 2):
                rest, queue = np.arange(start + 1, end), [start]
                while len(rest):
                    if not queue:
                        queue, rest = [int(rest[0])], rest[1:]
                        continue
                    of = queue.pop()
                    found = near(sets[rest], n[rest], sets[of], n[of])
                    linked, rest = rest[found], rest[~found]
                    queue.extend(linked.tolist())
                    a.append(np.full(len(linked), classes[of]))
                    b.append(classes[linked])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (a, b)], names=["a", "b"])

    return run


def _sets(size: int, bits: bytes):
    """(class, hashes) of the documents marked in the map."""
    marked = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").astype(bool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.flatnonzero(marked[batch.column("doc_id").fill_null(0).to_numpy() & ((1 << MAP_BITS) - 1)])
            for start in range(0, len(rows), 500):
                part = batch.take(pa.array(rows[start : start + 500])).column("text")
                own = [s for s in (shingles(_hashes().of(text.as_py()), size) for text in part) if len(s)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_class_of(s) for s in own], pa.int64()), pa.array([s.tobytes() for s in own], pa.binary())],
                    names=["class", "hashes"],
                )

    return run


def _confirm(numerator: int, denominator: int):
    """Forests of links confirmed on full sets, of whole candidate groups: rows (a, b)."""

    def forest(classes: list[int], sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        sizes = np.array([len(s) for s in sets])
        rest, queue, built = np.arange(1, len(sets)), [0], 0
        owner = postings = values = None
        while len(rest):
            if not queue:
                queue, rest = [int(rest[0])], rest[1:]
                continue
            if owner is None or len(rest) < built / 2:  # inverted lists of the sets left
                built = len(rest)
                flat = np.concatenate([sets[i] for i in rest])
                order = np.argsort(flat, kind="stable")
                owner = np.repeat(rest, sizes[rest])[order]
                values, starts = np.unique(flat[order], return_index=True)
                postings = np.append(starts, len(flat))
            of = queue.pop()
            at = np.minimum(np.searchsorted(values, sets[of]), len(values) - 1)
            at = at[values[at] == sets[of]]
            begin, count = postings[at], postings[at + 1] - postings[at]
            where = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())
            common = np.bincount(owner[where], minlength=len(sets))[rest]
            union = sizes[rest] + sizes[of] - common
            linked = denominator * common >= numerator * union
            for i in rest[linked]:
                yield classes[of], classes[i]
            queue.extend(rest[linked].tolist())
            rest = rest[~linked]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _streamed(batches):
            classes, hashes = table.column("class").to_pylist(), table.column("hashes")
            for start, end in _groups(table):
                own = {classes[i]: i for i in range(start, end)}  # copies of a class once
                sets = [np.frombuffer(hashes[i].as_buffer(), "<u8") for i in own.values()]
                pairs = list(forest(list(own), sets))
                if pairs:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*pairs)], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, size: int = 4, numerator: int = 80, denominator: int = 100) -> DataFrame:
    """Every document with the component of its links.

    Documents link if denominator * |intersection| >= numerator * |union| of their sets.
    Columns: doc_id, n_shingles, component_id (smallest id in reach), kept.
    """
    spark, threshold = docs.sparkSession, numerator / denominator
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    described = materialize(texts.mapInArrow(_describe(size), "doc_id long, n long, class long, tokens binary"))
    classes = materialize(
        described.filter("class is not null").groupBy("class")
        .agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("tokens").alias("tokens"))
    )
    ends = _tiled(terminal_nodes(classes), "node", TILE).select("node", "part", "place", "class")
    compared = ends.join(classes.select("class", "n", "tokens"), "class").repartition("place").sortWithinPartitions("node", "part")
    proposed = compared.select("node", "part", "class", "n", "tokens").mapInArrow(_propose(threshold), "a long, b long")
    candidates = components(proposed)
    sized = candidates.groupBy("component").agg(F.count("*").alias("size")).withColumnRenamed("component", "of")
    grouped = candidates.join(sized, F.col("component") == F.col("of")).select(F.col("vertex").alias("class"), F.col("component").alias("group"), "size")
    grouped = materialize(grouped)

    place = F.coalesce("least", F.lit(0)).bitwiseAND((1 << MAP_BITS) - 1)
    marks = grouped.join(classes.select("class", "least"), "class").select(place.alias("bit"))
    rows = marks.groupBy(F.shiftright("bit", 15).alias("bucket")).agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(32767)).alias("bits")).collect()
    bits = bytearray(1 << (MAP_BITS - 3))  # at most 2 MB, whatever the input
    for row in rows:
        bits[row["bucket"] * 4096 : row["bucket"] * 4096 + 4096] = row["bits"]
    sets = texts.mapInArrow(_sets(size, bytes(bits)), "class long, hashes binary")
    tiled = _tiled(grouped, "group", SET_TILE).select("group", "part", "place", "class")
    verified = sets.join(tiled, "class").repartition("place").sortWithinPartitions("group", "part")
    links = verified.select("group", "part", "class", "hashes").mapInArrow(_confirm(numerator, denominator), "a long, b long")
    linked = components(links)

    known = classes.select("class", "least").join(linked, F.col("class") == F.col("vertex"), "left")
    known = materialize(known.select("class", "least", F.coalesce("component", "class").alias("component")))
    smallest = known.groupBy("component").agg(F.min("least").alias("component_id")).withColumnRenamed("component", "of")
    marked = materialize(known.join(smallest, F.col("component") == F.col("of")).select(F.col("class").alias("of_class"), "component_id"))
    joined = described.select("doc_id", "n", "class").join(marked, F.col("class") == F.col("of_class"), "left")
    component = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )
