"""Sharding by a k-d tree over document metadata.

The dimensions are the length of the text and, where the table has them, its language and source, which
get a place each by their names' hash. Equal texts take the smallest value of their group in every
dimension, so they lie at one point whatever their rows say.

Every node splits along its widest metadata dimension at the weighted median (weight:
bytes), all nodes of a level at once, until each leaf holds its share of the bytes.
A dimension's order is one long: the scaled value, then bits of the text's hash, so
texts that are equal lie together in any order. Cuts are found by histograms over a
shrinking key range, at most :data:`BINS` sums a node and round; a cut stops at a
bin border as soon as that border is near enough. Only where a single key outweighs
the tolerance - a large group of equal texts - its documents are divided by the hash
of their ids, so no group keeps a shard from its share.

Defined cases: null metadata is a value of its own, at the lower end; a null text has no bytes and the checksum of the empty text; rows that
repeat an id and text may meet in either shard; fewer documents than shards leave
shards empty; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lograin.session import discard, materialize

BINS = 1024
HASH_BITS = 40
SCALE_BITS = 22
#: A cut may miss its weight by this part of a leaf's bytes ...
TOLERANCE = 1e-3
#: ... or by this part where it would divide equal texts otherwise.
GROUP_TOLERANCE = 1e-2
SLOT_ROWS = 20_000
SALTS = 16


@dataclass
class _Cut:
    """Search for the key of one node at which ``want`` of its bytes lie below."""

    dim: int
    want: float
    lo: int
    hi: int
    below: float = 0.0
    key: int | None = None  # rows with a smaller key go left ...
    tie_want: float | None = None  # ... and, if set, rows with this key by their tie hash

    def width(self) -> int:
        return max(1, -(-(self.hi - self.lo) // BINS))


def metadata(docs: DataFrame) -> dict[str, Column]:
    """Default dimensions: log of the length, and language and source as places between 0 and 1."""
    named = [c for c in ("lang", "source") if c in docs.columns]
    places = {c: (F.crc32(F.col(c).cast("string").cast("binary")) + 1) / float(1 << 32) for c in named}
    return {"length": F.log2(F.octet_length(F.coalesce("text", F.lit(""))) + 1.0), **places}


def _agreed(measured: DataFrame, dims: list[str]) -> DataFrame:
    """Rows of equal texts with the smallest value of each dimension in their group.

    Only groups whose rows differ are joined, each dealt in :data:`SALTS` parts.
    """
    edges = [f(d).alias(f"{f.__name__}_{d}") for d in dims for f in (F.min, F.max)]
    differ = reduce(or_, [F.col(f"min_{d}") < F.col(f"max_{d}") for d in dims])
    mixed = measured.groupBy("mark", "text_crc32").agg(*edges).filter(differ)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    mixed = mixed.select("mark", "text_crc32", salts, *[f"min_{d}" for d in dims])
    salted = measured.withColumn("salt", F.pmod("tie", F.lit(SALTS)).cast("int"))
    joined = salted.join(mixed, ["mark", "text_crc32", "salt"], "left")
    others = [c for c in measured.columns if c not in dims]
    return joined.select(*others, *[F.coalesce(f"min_{d}", d).alias(d) for d in dims])


def _sums(rows: DataFrame, key: Column, ranges: dict[int, tuple[int, int, int]]) -> dict[int, dict[int, int]]:
    """Bytes by node and bin; ``ranges`` maps a node to (lo, hi, bin width) of its keys. At most nodes * BINS rows."""
    node = F.col("node")
    pick = [F.element_at(F.create_map(*[F.lit(x) for n, r in ranges.items() for x in (n, r[i])]), node) for i in range(3)]
    lo, hi, width = pick
    cell = F.floor((key - lo) / width)
    inside = rows.filter(node.isin(*ranges)).filter((key >= lo) & (key < hi))
    sums = inside.groupBy("node", cell.cast("int").alias("cell")).agg(F.sum("size").alias("bytes")).collect()
    out: dict[int, dict[int, int]] = {n: {} for n in ranges}
    for row in sums:
        out[row["node"]][row["cell"]] = row["bytes"]
    return out


def _search(rows: DataFrame, cuts: dict[int, _Cut], key: Column, slack: float, key_slack: float) -> None:
    """Shrink the ranges of all open cuts round by round.

    A cut takes a bin border within ``slack``, or the nearer side of a single key
    within ``key_slack``; else that key is left to be divided.
    """
    while open_cuts := {n: c for n, c in cuts.items() if c.key is None}:
        sums = _sums(rows, key, {n: (c.lo, c.hi, c.width()) for n, c in open_cuts.items()})
        for n, cut in open_cuts.items():
            width, run = cut.width(), cut.below
            for cell in sorted(sums[n]):
                start, after = cut.lo + cell * width, run + sums[n][cell]
                if after <= cut.want - slack:
                    run = after
                    continue
                if abs(run - cut.want) <= min(slack, abs(after - cut.want)):
                    cut.key, cut.below = start, run
                elif abs(after - cut.want) <= slack:
                    cut.key, cut.below = start + width, after
                elif width == 1:
                    miss = min(abs(run - cut.want), abs(after - cut.want))
                    cut.tie_want = cut.want if miss > key_slack else None
                    if miss > key_slack or abs(run - cut.want) <= miss:
                        cut.key, cut.below = start, run
                    else:
                        cut.key, cut.below = start + 1, after
                else:
                    cut.lo, cut.hi, cut.below = start, min(cut.hi, start + width), run
                break
            else:
                cut.key = cut.hi


def shard_by_metadata(
    docs: DataFrame, shards: int = 16, dimensions: Mapping[str, Column] | None = None
) -> DataFrame:
    """Deal all documents to ``shards`` leaves of near equal bytes along ``dimensions``, or :func:`metadata`.

    Columns: doc_id, size (UTF-8 bytes + 1), text_crc32, shard, slot (from 0 in each shard).
    """
    values = dict(dimensions or metadata(docs))
    text = F.coalesce("text", F.lit(""))
    measured = docs.select(
        F.col("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("mark"),
        F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("tie")), 1).alias("tie"),
        *[F.coalesce(v.cast("double"), F.lit(0.0)).alias(f"d{i}") for i, v in enumerate(values.values())],
    )
    measured = materialize(_agreed(materialize(measured), [f"d{i}" for i in range(len(values))]))
    dims = range(len(values))
    bounds = measured.agg(*[f(f"d{i}") for i in dims for f in (F.min, F.max)], F.sum("size")).first()
    total = bounds[-1] or 0
    spans = [(bounds[2 * i] or 0.0, max((bounds[2 * i + 1] or 0.0) - (bounds[2 * i] or 0.0), 1e-12)) for i in dims]
    top = (1 << SCALE_BITS) - 1

    def key(i: int) -> Column:
        scaled = F.floor((F.col(f"d{i}") - spans[i][0]) / spans[i][1] * top)
        return F.shiftleft(scaled, HASH_BITS) + F.shiftrightunsigned("mark", 64 - HASH_BITS)

    rows = measured.select("doc_id", "size", "text_crc32", "tie", *[key(i).alias(f"k{i}") for i in dims], F.lit(0).alias("node"), F.lit(0).alias("leaf"))
    leaves = {0: (0, shards)}  # node -> first leaf, number of leaves
    slack = TOLERANCE * total / shards
    older = measured
    while split := {n: v for n, v in leaves.items() if v[1] > 1}:
        edges = [f(f"k{i}").alias(f"{f.__name__}{i}") for i in dims for f in (F.min, F.max)]
        stats = {r["node"]: r for r in rows.filter(F.col("node").isin(*split)).groupBy("node").agg(F.sum("size").alias("bytes"), *edges).collect()}
        cuts = {}
        for n, (_, count) in split.items():
            if n in stats:
                widest = max(dims, key=lambda i: (stats[n][f"max{i}"] - stats[n][f"min{i}"], -i))
                want = stats[n]["bytes"] * (count // 2) / count
                cuts[n] = _Cut(widest, want, stats[n][f"min{widest}"], stats[n][f"max{widest}"] + 1)
        own = _own_key({n: c.dim for n, c in cuts.items()}, len(values))
        _search(rows, cuts, own, slack, slack / TOLERANCE * GROUP_TOLERANCE)
        ties = {n: _Cut(0, c.tie_want, 0, (1 << 63) - 1, c.below) for n, c in cuts.items() if c.tie_want is not None}
        if ties:
            keys = F.create_map(*[F.lit(x) for n in ties for x in (n, cuts[n].key)])
            _search(rows.filter(own == F.element_at(keys, F.col("node"))), ties, F.col("tie"), slack, float("inf"))
        right = F.lit(False)
        for n, c in cuts.items():
            past = own >= c.key
            if n in ties:
                past = (own > c.key) | ((own == c.key) & (F.col("tie") >= ties[n].key))
            right = F.when(F.col("node") == n, past).otherwise(right)
        # children: node numbers of a binary heap
        child = F.when(F.col("node").isin(*split), F.col("node") * 2 + 1 + right.cast("int")).otherwise(F.col("node"))
        rows = materialize(rows.withColumn("node", child.cast("int")))
        discard(older)
        older = rows
        grown = {n: v for n, v in leaves.items() if n not in split}
        for n, (first, count) in split.items():
            grown[2 * n + 1] = (first, count // 2)
            grown[2 * n + 2] = (first + count // 2, count - count // 2)
        leaves = grown
    numbers = F.create_map(*[F.lit(x) for n, (first, _) in leaves.items() for x in (n, first)])
    dealt = rows.select("doc_id", "size", "text_crc32", "tie", F.element_at(numbers, F.col("node")).cast("int").alias("shard"))
    return with_slots(dealt)


def _own_key(dims: dict[int, int], count: int) -> Column:
    """The key of a row's node along the dimension its node splits."""
    own = F.lit(None).cast("long")
    for i in range(count):
        nodes = [n for n, d in dims.items() if d == i]
        if nodes:
            own = F.when(F.col("node").isin(*nodes), F.col(f"k{i}")).otherwise(own)
    return own


def with_slots(dealt: DataFrame) -> DataFrame:
    """Number each shard's rows from 0 without gaps, by cells of the tie hash, so no shard is one task."""
    rows = dealt.count()
    cells = max(16, -(-rows // SLOT_ROWS))
    dealt = dealt.withColumn("cell", F.pmod("tie", F.lit(cells)).cast("int"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", "cell").agg(F.count("*").alias("n")).select(
        F.col("shard").alias("of"), F.col("cell").alias("of_cell"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")
    )
    local = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("tie", "doc_id", "text_crc32")) - 1
    ranked = dealt.withColumn("local", local)
    return ranked.join(starts, (F.col("shard") == F.col("of")) & (F.col("cell") == F.col("of_cell"))).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("local")).alias("slot")
    )
