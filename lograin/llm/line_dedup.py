"""Line deduplication by a segment-partition edit join.

A line goes if an equal line, or one within a few edits, stands earlier (in the order of
document id and line number). The threshold is two edits, one for lines under 32
characters and none under 16, by the shorter line of a pair.

Equal lines are one class. For the join, a line of length l is cut into threshold + 1
segments, which are its index keys together with l and the segment's number. Two lines
within the threshold share one segment, at a place that differs by a few positions, so
a line probes with those of its substrings that can match a segment of a line of its
own length or up to the threshold shorter. Keys with one line are dropped
where they meet; for the others the lines are fetched and compared by a banded
bit-parallel edit distance, many pairs at once.

Only narrow rows are shuffled: digests of lines, packed keys, then the texts of lines
that share a key, and the documents that lose lines. A task that collects keys
holds one row per different key, and groups of lines over a tile are dealt to pairs of
tiles, so a frequent segment is not one task's. Comparisons return at most one row per line.

Defined cases: null and empty texts have no lines and stay; blank lines are never compared and
never go; texts are cut at line feeds only; null ids come last; rows that share an id, or have none,
are documents of their own in the order of a hash of their text, and of rows that repeat id and text
one stands first and the others lose their lines as equal; an empty table gives no rows. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lograin.llm.bpe import text_slices
from lograin.llm.chosen_path import _streamed
from lograin.llm.idmap import id_map, split_by_map, thin
from lograin.session import discard, materialize

MOST = 2
#: Characters a line needs for each edit it may differ by.
PER_EDIT = 16
PACK_BYTES = 4 << 20
TILE = 1024
PAIRS_AT_ONCE = 1 << 17
LAST = (1 << 63) - 1


def threshold(length: int) -> int:
    return min(MOST, length // PER_EDIT)


def segments(length: int, tau: int) -> list[tuple[int, int]]:
    """(start, length) of the tau + 1 even segments of a line."""
    parts, rest = tau + 1, length
    cuts, start = [], 0
    for i in range(parts):
        size = rest // (parts - i)
        cuts.append((start, size))
        start, rest = start + size, rest - size
    return cuts


def places(length: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Index keys and probes of a line of this length: (start, size, seed).

    A probe that is an index key, too, is left out: lines of one length meet there anyway.
    """
    tau = threshold(length)
    own = [(start, size, length * 8 + i) for i, (start, size) in enumerate(segments(length, tau))]
    probes = []
    for shorter in range(max(length - MOST, PER_EDIT), length + 1):
        tau, more = threshold(shorter), length - shorter
        if more > tau:
            continue
        for i, (start, size) in enumerate(segments(shorter, tau)):
            low = max(start - i, start + more - (tau - i), 0)
            high = min(start + i, start + more + (tau - i), length - size)
            probes += [(at, size, shorter * 8 + i) for at in range(low, high + 1) if more or at != start]
    return own, probes


def _pack(parts: int):
    """Keys of all lines, packed by part: rows (part, keys, lines); the lowest bit of a line marks a probe."""
    schema = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("lines", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple] = {}
        digest = xxhash.xxh3_64_intdigest
        keys: list[int] = []
        lines: list[int] = []

        def flush() -> pa.RecordBatch:
            key, line = np.array(keys, np.uint64), np.array(lines, np.uint64)
            keys.clear(), lines.clear()
            part = (key >> np.uint64(32)).astype(np.int64) % parts
            order = np.argsort(part, kind="stable")
            own, starts = np.unique(part[order], return_index=True)
            pieces = [[a.tobytes() for a in np.split(x[order], starts[1:])] for x in (key, line)]
            return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), *(pa.array(p, pa.binary()) for p in pieces)], schema=schema)

        for batch in batches:
            for _, texts in text_slices(batch, "text"):
                for line in {line for text in texts for line in text.split("\n") if len(line) >= PER_EDIT and line.strip()}:
                    length = len(line)
                    if length not in known:
                        if len(known) > 50_000:
                            known.clear()
                        known[length] = places(length)
                    own, probes = known[length]
                    number = xxhash.xxh64_intdigest(line.encode(), seed=42) & ~1
                    keys += [digest(line[a : a + n].encode(), seed=s) for a, n, s in own]
                    lines += [number] * len(own)
                    keys += [digest(line[a : a + n].encode(), seed=s) for a, n, s in probes]
                    lines += [number | 1] * len(probes)
                if len(keys) * 16 >= PACK_BYTES:
                    yield flush()
        if keys:
            yield flush()

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, line) of the keys that more than one line has; holds one line per key of a part."""
    part, seen, first, told = None, np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)

    def merge(key: np.ndarray, line: np.ndarray) -> pa.RecordBatch:
        nonlocal seen, first, told
        order = np.argsort(key, kind="stable")
        key, line = key[order], line[order]
        own, starts, place = np.unique(key, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(seen, own), max(len(seen) - 1, 0))
        old = seen[at] == own if len(seen) else np.zeros(len(own), bool)
        holder = np.where(old, first[at], line[starts]) if len(seen) else line[starts]
        differs = np.zeros(len(own), bool)
        np.logical_or.at(differs, place, line >> np.uint64(1) != holder[place] >> np.uint64(1))
        was = np.where(old, told[at], False) if len(seen) else np.zeros(len(own), bool)
        give = (differs | was)[place]
        late = differs & old & ~was  # the holder came with an earlier batch
        out_key, out_line = np.concatenate([key[give], own[late]]), np.concatenate([line[give], holder[late]])
        told[at[old & differs]] = True
        fresh = ~old
        merged = np.concatenate([seen, own[fresh]])
        order = np.argsort(merged, kind="stable")
        seen, first, told = merged[order], np.concatenate([first, holder[fresh]])[order], np.concatenate([told, differs[fresh]])[order]
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (out_key, out_line)], names=["key", "line"])

    for batch in batches:
        for own, keys, lines in zip(batch.column("part").to_pylist(), batch.column("keys"), batch.column("lines")):
            if own != part:
                part, seen, first, told = own, np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)
            yield merge(np.frombuffer(keys.as_buffer(), np.uint64), np.frombuffer(lines.as_buffer(), np.uint64))


def within(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, a: np.ndarray, b: np.ndarray, tau: np.ndarray) -> np.ndarray:
    """Whether the texts of each pair (a, b) are within tau (at most MOST) edits.

    Bits are the diagonals of a band of 2 * MOST + 1 around the main one. A word per number
    of edits holds the diagonals reached so far; a character of the first
    text moves all of them at once, and pairs without any left are dropped.
    """
    band = 2 * MOST + 1
    every = np.uint8((1 << band) - 1)
    padded = np.concatenate([codes, np.full(1, 0xFFFFFFFF, np.uint32)])
    close = np.zeros(len(a), bool)
    live = np.flatnonzero(np.abs(lengths[a] - lengths[b]) <= tau)
    x, y, n, m, limit = starts[a[live]], starts[b[live]], lengths[a[live]], lengths[b[live]], tau[live]
    reach = [np.full(len(live), 1 << MOST, np.uint8)]
    for _ in range(MOST):
        reach.append((reach[-1] << 1 | reach[-1]) & every)
    step = 0
    while len(live):
        end = n == step
        if end.any():
            want = np.uint8(1) << (m - n + MOST).astype(np.uint8)
            final = np.choose(limit, reach)
            close[live[end & (final & want != 0)]] = True
            keep = ~end
        else:
            keep = np.choose(limit, reach) != 0
        if not keep.all():
            live, x, y, n, m, limit = (v[keep] for v in (live, x, y, n, m, limit))
            reach = [r[keep] for r in reach]
            if not len(live):
                break
        char = padded[x + step]
        match = np.zeros(len(live), np.uint8)
        for d in range(band):
            place = step + d - MOST
            inside = (place >= 0) & (place < m)
            other = padded[np.where(inside, y + place, len(codes))]
            match |= (other == char).astype(np.uint8) << d
        following = [reach[0] & match]
        for e in range(1, MOST + 1):
            moved = (reach[e] & match) | reach[e - 1] | reach[e - 1] >> 1 | following[e - 1] << 1
            following.append(moved & every)
        reach, step = following, step + 1
    return close


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(line, mark) of lines with an earlier line within the threshold, by groups in order."""
    for table in _streamed(batches):
        text = table.column("text").to_pylist()
        lengths = np.array([len(t) for t in text], np.int64)
        starts = np.cumsum(lengths) - lengths
        codes = np.frombuffer("".join(text).encode("utf-32-le"), np.uint32)
        keys = np.stack([table.column(i).to_numpy() for i in (0, 1)])
        edge = np.flatnonzero(np.concatenate(([True], (keys[:, 1:] != keys[:, :-1]).any(axis=0), [True])))
        gone = np.zeros(len(text), bool)
        taus = np.minimum(MOST, lengths // PER_EDIT)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        count = 0

        def settle() -> None:
            nonlocal count
            if held:
                a, b = (np.concatenate(v) for v in zip(*held))
                open_pairs = ~gone[b]
                a, b = a[open_pairs], b[open_pairs]
                gone[b[within(codes, starts, lengths, a, b, np.minimum(taus[a], taus[b]))]] = True
            held.clear()
            count = 0

        for begin, end in zip(edge[:-1], edge[1:]):
            for pivot in range(begin, end - 1):
                later = np.arange(pivot + 1, end)
                later = later[~gone[later]]
                held.append((np.full(len(later), pivot), later))
                count += len(later)
                if count >= PAIRS_AT_ONCE:
                    settle()
        settle()
        rows = pa.array(np.flatnonzero(gone))
        yield pa.RecordBatch.from_arrays([table.column(c).combine_chunks().take(rows) for c in ("line", "mark")], names=["line", "mark"])


def _at() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))


def _own() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _blank(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, r"^\s+", "")) == ""


def _lines(docs: DataFrame, *more: Column) -> DataFrame:
    """(at, own, line_no, line, mark, text) of all lines that aren't blank."""
    cut = docs.select(_at().alias("at"), _own().alias("own"), F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    kept = cut.filter(~_blank(F.col("text")))
    return kept.select("at", "own", "line_no", F.xxhash64("text").alias("line"), F.crc32(F.col("text").cast("binary")).alias("mark"), *more)


def dropped_lines(docs: DataFrame) -> DataFrame:
    """(at, own, line_no, near) of every line that goes.

    ``at`` is the id, the largest long for null, ``own`` the hash of the text. Rows that
    repeat both are judged as the first of them.
    """
    texts = docs.select("doc_id", "text")
    lines = materialize(_lines(texts))
    firsts = materialize(lines.groupBy("line", "mark").agg(F.min(F.struct("at", "own", "line_no")).alias("first")))

    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(64, -(-size // (16 << 20)))
    packed = texts.mapInArrow(_pack(parts), "part int, keys binary, lines binary")
    dealt = packed.repartition(parts, "part").sortWithinPartitions("part")
    even = F.col("line").bitwiseAND(-2)
    members = materialize(
        dealt.mapInArrow(_shared, "key long, line long")
        .groupBy("key", even.alias("even")).agg(F.min(F.col("line").bitwiseAND(1)).alias("probe"))
    )
    sizes = members.groupBy("key").agg(F.count("*").alias("size"), F.min("probe").alias("index")).filter("size > 1 and index = 0")
    tiles = F.ceil(F.col("size") / TILE).cast("int")
    own = F.pmod(F.xxhash64("even"), tiles).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), tiles - 1), lambda t: F.least(t, own) * tiles + F.greatest(t, own))
    grouped = members.join(sizes.withColumnRenamed("key", "of"), F.col("key") == F.col("of")).select("key", F.explode(pairs).alias("part"), "even")
    grouped = materialize(grouped)

    needed = id_map(grouped.select("even"), "even")
    classes = thin(firsts.withColumn("even", even), "even", needed).join(grouped.select("even").distinct(), "even", "left_semi")
    classes = materialize(classes.select("even", "line", "mark", "first.*"))
    found = thin(_lines(split_by_map(texts, _at(), id_map(classes, "at"))[0], "text").withColumn("even", even), "even", needed)
    found = found.join(classes, ["even", "line", "mark", "at", "own", "line_no"]).dropDuplicates(["line", "mark"])
    met = grouped.join(found, "even").withColumn("place", F.xxhash64("key", "part"))
    met = met.repartition("place").sortWithinPartitions("key", "part", "at", "own", "line_no", "mark")
    near = met.select("key", "part", "line", "mark", "text").mapInArrow(_verify, "line long, mark long").distinct()
    near = materialize(near.select(F.col("line").alias("near_line"), F.col("mark").alias("near_mark")))

    equal = (F.col("line") == F.col("near_line")) & (F.col("mark") == F.col("near_mark"))
    judged = firsts.join(near, equal, "left").select(
        F.col("line").alias("of"), F.col("mark").alias("of_mark"), "first", F.col("near_line").isNotNull().alias("near")
    )
    first = F.struct("at", "own", "line_no") == F.col("first")
    whole = lines.join(judged, (F.col("line") == F.col("of")) & (F.col("mark") == F.col("of_mark")))
    gone = materialize(whole.filter(~first | F.col("near")).select("at", "own", "line_no", (first & F.col("near")).alias("near")))
    for used in (lines, firsts, members, grouped, classes, near):
        discard(used)
    return gone


def dedup_lines(docs: DataFrame) -> DataFrame:
    """All documents with their lines that stay.

    ``text`` is the text left; columns n_lines, n_equal and n_near count its lines and those
    that went as equal to an earlier line or as near one. The other columns are those of ``docs``.
    """
    # columns of the caller travel as one, so that their names meet none of ours
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    wrapped = docs.select("doc_id", "text", F.struct(F.lit(0).alias("none"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(others)]).alias("rest"))
    left = {c: F.col(f"rest.c{i}") for i, c in enumerate(others)} | {"doc_id": F.col("doc_id"), "text": F.col("text")}
    counts = ("n_lines", "n_equal", "n_near")
    return _dedup_lines(wrapped).select(*[left[c].alias(c) for c in docs.columns if c not in counts], *counts)


def _dedup_lines(docs: DataFrame) -> DataFrame:
    """The same for tables of doc_id, text and rest."""
    near, row = F.col("near"), F.xxhash64("_at", "_own")
    gone = dropped_lines(docs).groupBy(F.col("at").alias("_at"), F.col("own").alias("_own")).agg(
        F.collect_set(F.when(~near, F.col("line_no"))).alias("_same"), F.collect_set(F.when(near, F.col("line_no"))).alias("_close")
    )
    rows = docs.select(_at().alias("_at"), _own().alias("_own")).groupBy("_at", "_own").agg(F.count("*").alias("_rows"))
    # merged at every size: neither side has a bound
    judged = gone.join(rows.filter("_rows > 1").hint("merge"), ["_at", "_own"], "full").withColumn("_row", row)
    judged = materialize(judged)
    touched, others = split_by_map(docs, F.xxhash64(_at(), _own()), id_map(judged, "_row"))
    joined = touched.join(judged.drop("_row").hint("merge"), (_at() == F.col("_at")) & (_own() == F.col("_own")), "left")
    once, repeated = joined.filter("_rows is null"), joined.filter("_rows is not null")
    number = F.row_number().over(Window.partitionBy("_at", "_own").orderBy("_at"))
    counts = {"_equal": F.coalesce(F.size("_same"), F.lit(0)).cast("long"), "_near": F.coalesce(F.size("_close"), F.lit(0)).cast("long")}
    counts["_gone"] = F.concat("_same", "_close")
    once = once.withColumns(counts).withColumn("_copy", F.lit(False))
    repeated = repeated.withColumns(counts).withColumn("_copy", number > 1)
    nothing = {"_gone": F.lit(None).cast("array<int>"), "_equal": F.lit(0).cast("long"), "_near": F.lit(0).cast("long"), "_copy": F.lit(False)}
    drop = ("_at", "_own", "_same", "_close", "_rows")
    both = once.drop(*drop).unionByName(repeated.drop(*drop)).unionByName(others.withColumns(nothing))
    lines = F.split("text", "\n")
    left = F.filter(lines, lambda line, i: ~F.array_contains("_gone", i))
    blank = F.filter(lines, _blank)
    text = F.when(F.col("_copy"), F.array_join(blank, "\n")).when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    equal = F.when(F.col("_copy"), F.coalesce(F.size(lines) - F.size(blank), F.lit(0)).cast("long")).otherwise(F.col("_equal"))
    close = F.when(F.col("_copy"), F.lit(0).cast("long")).otherwise(F.col("_near"))
    counted = both.withColumns({"n_lines": F.coalesce(F.when(F.col("text") == "", 0).otherwise(F.size(lines)), F.lit(0)).cast("long"), "_left": text})
    return counted.select("doc_id", F.col("_left").alias("text"), "rest", "n_lines", equal.alias("n_equal"), close.alias("n_near"))
