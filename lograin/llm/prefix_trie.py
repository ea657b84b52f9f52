"""Prefix trie of conversations, its subtree totals by parallel tree contraction.

Conversations are first rebuilt: the opening turns of a block's first conversation, then
their own. A prefix is known by the sum of hashes of (place, turn) over its turns, 128 bits,
so signatures of all prefixes are running sums: turns are range partitioned over whole
conversations, summed inside their range, and the few conversations that ranges cut get the
sum of the ranges before. Equal signatures are one node.

Contraction works on (node, parent) rows with a weight per node and one per edge. A round

* rakes all leaves: their weight goes to the parent, their own total is known;
* compresses unary nodes by independent coins: one whose only child doesn't go as well is taken
  out, its child hangs on the node above, the weight passed over moves to the edge.

A coin is a hash of node and round; it doesn't depend on the data. Chains of any length thus take a logarithmic number of rounds, each of them a few joins on
unique keys; sums over children are partial aggregates. Then the rounds are undone in reverse:
a compressed node's total is its child's total plus what was passed over.

Children find their parents through a join that deals out parents with very many children.
Ids of conversations that end in a node are joined in chunks of a range of ids each; the
hash of a node's list, sequential by nature, streams over these chunks with constant memory.

Defined cases: rows without a conversation id take no part; null roles and texts are empty;
equal turn numbers are ordered by role, then text; repeated rows are turns of their own;
texts of any length are hashed whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lograin.llm.skew import join_to_one
from lograin.session import discard, materialize, scratch_path

WORD = r"[^\x20\x09-\x0D]+"
PIECES = ["p0", "p1", "p2", "p3"]
LOW32 = (1 << 32) - 1
#: Ids of one chunk lie within a range of this size.
CHUNK = 4096
ROOT = -1
NO_ENDS = hashlib.sha256(b"").hexdigest()


def _ordered(conversations: DataFrame) -> DataFrame:
    """(conv, part, at, turn_hash, words): turns in order; part and at are range and place in it."""
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("nth"),
        F.coalesce("role", F.lit("")).alias("speaker"), F.coalesce("text", F.lit("")).alias("said"),
        F.monotonically_increasing_id().alias("tie"),  # lets ranges cut between repeated rows
    )
    keys = ["conv", "nth", "speaker", "said", "tie"]
    turn = F.sha2(F.concat(F.length("speaker").cast("string"), F.lit(":"), "speaker", "said"), 256)
    words = F.regexp_count("said", F.lit(WORD)).cast("long")
    seq = F.monotonically_increasing_id()
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = ranged.select("conv", F.unhex(turn).alias("turn_hash"), words.alias("words"), seq.alias("seq"))
    at = F.col("seq").bitwiseAND((1 << 33) - 1)
    return materialize(ranged).select("conv", F.shiftright("seq", 33).alias("part"), at.alias("at"), "turn_hash", "words")


def _pieces(place: Column) -> list[Column]:
    """The hash of a turn at a place, as four numbers of 32 bits."""
    hashes = [F.xxhash64(F.lit(salt), place, F.col("turn_hash")) for salt in (1, 2)]
    return [part.alias(f"g{2 * i + j}") for i, h in enumerate(hashes) for j, part in enumerate((F.shiftrightunsigned(h, 32), h.bitwiseAND(LOW32)))]


def _packed(pieces: list[Column]) -> list[Column]:
    a, b, c, d = pieces
    return [F.shiftleft(a, 32).bitwiseOR(b.bitwiseAND(LOW32)), F.shiftleft(c, 32).bitwiseOR(d.bitwiseAND(LOW32))]


def rebuilt_turns(conversations: DataFrame, block: int, heads: int) -> tuple[DataFrame, DataFrame]:
    """Turns (conv, depth, s0, s1, q0, q1, words, last) with the signatures of prefix and parent, and all conversations (conv, total)."""
    turns = _ordered(conversations)
    spans = turns.groupBy("conv", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    spans = materialize(spans)
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    convs = spans.groupBy("conv").agg(F.sum("n").alias("n_turns"))
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % heads
    convs = convs.select("conv", "n_turns", h.alias("h"), (F.col("conv") - F.col("conv") % block).alias("base"))

    # the first turns of the conversations that others start with: at most heads - 1 rows each
    starts = spans.filter((F.col("conv") % block == 0) & (F.col("before") < heads - 1))
    opening = turns.filter(F.col("conv") % block == 0).join(starts, ["conv", "part"])
    opening = opening.withColumn("pos", F.col("at") - F.col("first") + F.col("before")).filter(F.col("pos") < heads - 1)
    opening = opening.select("conv", "pos", "words", *_pieces(F.col("pos")))
    upto = Window.partitionBy("conv").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    opening = materialize(opening.select("*", *[F.sum(f"g{i}").over(upto).alias(f"p{i}") for i in range(4)]))
    listed = opening.groupBy(F.col("conv").alias("base")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("pos"), *PIECES))).alias("opens")  # at most heads - 1
    )
    taken = F.least("h", F.coalesce(F.size("opens"), F.lit(0)))
    convs = convs.join(listed, "base", "left").withColumn("b", F.greatest(taken, F.lit(0)))
    last_open = F.get("opens", (F.col("b") - 1).cast("int"))
    convs = materialize(convs.select(
        "conv", "h", "base", F.col("b").cast("long").alias("b"), (F.col("b") + F.greatest(F.col("n_turns") - F.col("h"), F.lit(0))).alias("total"),
        *[F.when(F.col("b") > 0, last_open[p]).otherwise(0).alias(f"base_{p}") for p in PIECES],
    ))

    own = turns.join(spans.drop("n").join(convs, "conv"), ["conv", "part"])
    own = own.withColumn("pos", F.col("at") - F.col("first") + F.col("before")).filter(F.col("pos") >= F.col("h"))
    own = own.withColumn("place", F.col("b") + F.col("pos") - F.col("h")).select("*", *_pieces(F.col("place")))
    inside = Window.partitionBy("conv", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    own = own.select(
        "conv", "part", "place", "words", "total", *[f"g{i}" for i in range(4)],
        *[(F.sum(f"g{i}").over(inside) + F.col(f"base_p{i}")).alias(f"p{i}") for i in range(4)],
    )
    own = materialize(own)
    # only conversations that a range cuts: at most two in each range
    cut = spans.groupBy("conv").agg(F.count("*").alias("n_parts")).filter("n_parts > 1").select("conv")
    sums = own.join(F.broadcast(cut), "conv", "left_semi").groupBy("conv", "part").agg(*[F.sum(f"g{i}").alias(f"c{i}") for i in range(4)])
    carried = sums.select("conv", "part", *[F.sum(f"c{i}").over(earlier).alias(f"c{i}") for i in range(4)])
    whole = own.join(F.broadcast(carried), ["conv", "part"], "left")
    whole = whole.select("*", *[(F.col(f"p{i}") + F.coalesce(f"c{i}", F.lit(0))).alias(f"f{i}") for i in range(4)])

    def shaped(rows: DataFrame, pieces: str, place: str) -> DataFrame:
        here = [F.col(f"{pieces}{i}") for i in range(4)]
        above = [F.col(f"{pieces}{i}") - F.col(f"g{i}") for i in range(4)]
        s, q = _packed(here), _packed(above)
        depth = (F.col(place) + 1).cast("long")
        return rows.select(
            "conv", depth.alias("depth"), s[0].alias("s0"), s[1].alias("s1"), q[0].alias("q0"), q[1].alias("q1"), "words", (depth == F.col("total")).alias("last")
        )

    lent = opening.withColumnRenamed("conv", "base").join(convs.select("conv", "h", "base", "total"), "base").filter(F.col("pos") < F.col("h"))
    return materialize(shaped(whole, "f", "place").unionByName(shaped(lent, "p", "pos"))), convs.select("conv", "total")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by node and chunk -> the hash of each node's ids; one hash state is held."""
    key, state = None, None
    columns: tuple[list, ...] = ([], [], [], [])

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_pydict(dict(zip(("depth", "s0", "s1", "ends_sha256"), columns)))
        for c in columns:
            c.clear()
        return made

    def close() -> None:
        for c, v in zip(columns, (*key, state.hexdigest())):
            c.append(v)

    for rows in batches:
        for *own, ids in zip(*[rows.column(c).to_pylist() for c in ("depth", "s0", "s1", "ids")]):
            if own != key:
                if key is not None:
                    close()
                key, state = own, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if columns[0]:
            yield batch()
    if key is not None:
        close()
        yield batch()


def _ends(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(depth, s0, s1, ends_sha256) of nodes in which conversations end."""
    ends = turns.filter("last").select("conv", "depth", "s0", "s1")
    ends = ends.unionByName(convs.filter("total = 0").select("conv", *[F.lit(0).cast("long").alias(c) for c in ("depth", "s0", "s1")]))
    chunk = F.floor(F.col("conv") / CHUNK).alias("chunk")
    listed = ends.groupBy("depth", "s0", "s1", chunk).agg(F.array_join(F.sort_array(F.collect_list("conv")), ",").alias("ids"))
    keys = ["depth", "s0", "s1"]
    streamed = listed.repartition(*keys).sortWithinPartitions(*keys, "chunk").select(*keys, "ids")
    return streamed.mapInArrow(_digests, "depth long, s0 long, s1 long, ends_sha256 string")


def trie_nodes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(node, parent, depth, conv_id, parent_conv_id, n_convs, words, ends_sha256), the root being node ROOT."""
    grouped = turns.groupBy("depth", "s0", "s1").agg(
        F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"), F.max("q0").alias("q0"), F.max("q1").alias("q1"),
    )
    root = convs.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    zero = F.lit(0).cast("long")
    root = root.select(zero.alias("depth"), zero.alias("s0"), zero.alias("s1"), "conv_id", "n_convs", zero.alias("words"), zero.alias("q0"), zero.alias("q1"))
    number = F.when(F.col("depth") == 0, F.lit(ROOT)).otherwise(F.monotonically_increasing_id())
    nodes = grouped.unionByName(root).join(_ends(turns, convs), ["depth", "s0", "s1"], "left")
    nodes = materialize(nodes.withColumn("node", number).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS))))
    top = nodes.filter("depth = 0").withColumns({"parent": F.lit(None).cast("long"), "parent_conv_id": F.lit(None).cast("long")})
    below = nodes.filter("depth > 0").withColumn("above", F.col("depth") - 1)
    above = nodes.select(
        F.col("depth").alias("above"), F.col("s0").alias("q0"), F.col("s1").alias("q1"), F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")
    )
    names = ["node", "parent", "depth", "conv_id", "parent_conv_id", "n_convs", "words", "ends_sha256"]
    return materialize(join_to_one(below, above, ["above", "q0", "q1"]).select(*names).unionByName(top.select(*names)))


def _coin(node: str, turn: int) -> Column:
    return F.xxhash64(F.lit(turn), F.col(node)).bitwiseAND(1) == 1


def subtree_totals(tree: DataFrame) -> DataFrame:
    """(node, leaves, saved): sums over each node's subtree of a tree (node, parent, leaves, saved); the top's parent is null."""
    spark, zero = tree.sparkSession, F.lit(0).cast("long")
    folder, done = scratch_path(spark, "totals"), []

    def finish(rows: DataFrame) -> None:
        done.append(f"{folder}/{len(done)}")
        rows.select("node", "leaves", "saved").write.parquet(done[-1])

    def finished(paths: list[str]) -> DataFrame:
        """Totals known from some folders, as one scan."""
        return spark.read.schema("node long, leaves long, saved long").parquet(*paths)

    active = materialize(tree.select("node", "parent", "leaves", "saved", zero.alias("edge_leaves"), zero.alias("edge_saved")))
    compressed = []
    while not active.isEmpty():
        turn = len(compressed)
        kids = active.filter("parent is not null").groupBy("parent").agg(F.count("*").alias("n"), F.min("node").alias("child"))
        state = materialize(active.join(kids.withColumnRenamed("parent", "of"), F.col("node") == F.col("of"), "left").drop("of"))
        discard(active)
        leaves, inner = state.filter("n is null"), state.filter("n is not null")
        finish(leaves)
        given = leaves.filter("parent is not null").groupBy(F.col("parent").alias("to")).agg(
            F.sum(F.col("leaves") + F.col("edge_leaves")).alias("more_leaves"), F.sum(F.col("saved") + F.col("edge_saved")).alias("more_saved")
        )
        # a unary node whose coin is 1, unless its only child is a leaf or goes itself
        going = inner.filter((F.col("n") == 1) & _coin("node", turn) & F.col("parent").isNotNull())
        staying = inner.filter((F.col("n") > 1) | ~_coin("node", turn)).select(
            F.col("node").alias("child"), F.col("edge_leaves").alias("below_leaves"), F.col("edge_saved").alias("below_saved")
        )
        passed = materialize(going.join(staying, "child").select(
            "node", "child", F.col("parent").alias("above"),
            (F.col("leaves") + F.col("below_leaves")).alias("leaves"), (F.col("saved") + F.col("below_saved")).alias("saved"),
            (F.col("leaves") + F.col("edge_leaves")).alias("edge_more_leaves"), (F.col("saved") + F.col("edge_saved")).alias("edge_more_saved"),
        ))
        compressed.append(passed)
        # a node goes or is handed on, never both
        changes = passed.select(F.col("node").alias("key"), F.lit(True).alias("gone"), *[F.lit(None).cast("long").alias(c) for c in ("above", "edge_more_leaves", "edge_more_saved")])
        changes = changes.unionByName(passed.select(F.col("child").alias("key"), F.lit(False).alias("gone"), "above", "edge_more_leaves", "edge_more_saved"))
        left = inner.join(given, F.col("node") == F.col("to"), "left").join(changes, F.col("node") == F.col("key"), "left")
        left = left.filter(~F.coalesce("gone", F.lit(False)))

        def plus(column: str, more: str) -> Column:
            return (F.col(column) + F.coalesce(more, F.lit(0))).alias(column)

        active = materialize(left.select(
            "node", F.coalesce("above", "parent").alias("parent"), plus("leaves", "more_leaves"), plus("saved", "more_saved"),
            plus("edge_leaves", "edge_more_leaves"), plus("edge_saved", "edge_more_saved"),
        ))
        discard(state)
    # a compressed node's child was finished in a later round, or is by now
    chains: list[str] = []
    for turn, passed in reversed(list(enumerate(compressed))):
        known = finished(done[turn + 1 : len(compressed)] + chains or done[:1]).withColumnsRenamed({"node": "child", "leaves": "sub_leaves", "saved": "sub_saved"})
        undone = passed.join(known, "child")
        finish(undone.select("node", (F.col("leaves") + F.col("sub_leaves")).alias("leaves"), (F.col("saved") + F.col("sub_saved")).alias("saved")))
        chains.append(done[-1])
    return finished(done) if done else tree.select("node", "leaves", "saved")


def prefix_trie(conversations: DataFrame, block: int = 20, heads: int = 4) -> DataFrame:
    """The trie of rebuilt conversations, one row per node.

    Conversation c takes its first crc32(c) % ``heads`` turns from conversation c - c % ``block``.
    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.
    """
    turns, convs = rebuilt_turns(conversations, block, heads)
    nodes = trie_nodes(turns, convs)
    kids = nodes.filter("parent is not null").groupBy(F.col("parent").alias("of")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(kids, F.col("node") == F.col("of"), "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    nodes = materialize(nodes.drop("of"))
    weights = nodes.select("node", "parent", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    totals = subtree_totals(weights).select("node", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    return nodes.join(totals, "node").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
