"""Centroids, prefix tries and license scans: plain versions, awkward rows, hot groups."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lograin.llm import centroids, licenses, prefix_trie, skew
from tests.llm.test_operators import CLASH, found

# --- 11 centroids -----------------------------------------------------------------


def plain_clusters(rows, k, rounds, dims):
    kept = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in rows if usable(v, dims)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest()))
    centres = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        members = defaultdict(list)
        for _, v in kept:
            members[nearest(v)[1]].append(v)
        centres = [[sum(x) // len(members[n]) for x in zip(*members[n])] if n in members else c for n, c in enumerate(centres)]
    out = [(i, *reversed(nearest(v))) for i, v in kept]
    sums = defaultdict(int)
    for _, n, d in out:
        sums[n] += d
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, n, d, sums[n], sum(sums.values()), hashes[n]) for i, n, d in out), key=repr)


def usable(v, dims):
    return v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)


COLUMNS = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def test_clusters_of_awkward_vectors(spark):
    rng, nan, inf = np.random.default_rng(3), float("nan"), float("inf")
    rows = [(i, (rng.normal(size=6) * 2 + i % 4).tolist()) for i in range(120)]
    rows += [(i, [0.5] * 6) for i in range(200, 240)] + [(200, [0.5] * 6), (None, [1.0] * 6), (500, [-0.0] * 6), (501, [0.0] * 6)]
    rows += [(300, None), (301, []), (302, [1.0] * 5), (303, [nan] * 6), (304, [None] * 6), (305, [inf] * 6), (306, [1e7] * 6), (307, [-3e5] * 6)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("clash") for c in ("cluster", "vector", "n", "dim", "total")})
    for leading in (2, 6):
        got = centroids.cluster(vectors, k=5, rounds=3, dims=6, leading=leading)
        assert found(got, *COLUMNS) == plain_clusters(rows, 5, 3, 6)
    few = [(1, [1.0] * 6), (2, [1.0] * 6), (3, [2.0] * 6)]
    assert found(centroids.cluster(spark.createDataFrame(few, "vec_id long, embedding array<float>"), 5, 3, 6), *COLUMNS) == plain_clusters(few, 5, 3, 6)
    assert centroids.cluster(vectors.limit(0), dims=6).count() == 0


def test_bounds_spare_most_centroids_and_lose_none():
    rng = np.random.default_rng(5)
    middles = rng.integers(-4000, 4000, (16, 64)).astype(float)
    vectors = np.floor(middles[rng.integers(0, 16, 3000)] + rng.normal(size=(3000, 64)) * 40)
    products = vectors.T @ vectors
    frame = centroids.Frame.fit(len(vectors), vectors.sum(axis=0), products, 8)
    best, distance, measured = centroids.nearest(vectors, *frame.of(vectors), frame, middles)
    whole = ((vectors[:, None, :] - middles[None]) ** 2).sum(axis=2)
    assert (best == whole.argmin(axis=1)).all() and (distance == whole.min(axis=1)).all()
    assert measured.mean() < 1.1


# --- 12 prefix trie -----------------------------------------------------------------


def plain_trie(rows, block=20, heads=4):
    talks = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            talks[conv].append((turn is not None, turn or 0, role or "", text or ""))
    talks = {c: [t[2:] for t in sorted(turns)] for c, turns in talks.items()}
    members, ends, kids, parents = defaultdict(list), defaultdict(list), defaultdict(set), {}
    for c in talks:
        h = zlib.crc32(str(c).encode()) % heads
        turns = talks.get(c - c % block, [])[:h] + talks[c][h:]
        for d in range(len(turns) + 1):
            key = tuple(turns[:d])
            members[key].append(c)
            if d:
                parents[key] = key[:-1]
                kids[key[:-1]].add(key)
        ends[tuple(turns)].append(c)
    leaves, saved = defaultdict(int), defaultdict(int)
    for key in sorted(members, key=len, reverse=True):
        leaves[key] += not kids[key]
        saved[key] += (len(members[key]) - 1) * (len(key[-1][1].encode().split()) if key else 0)
        if key:
            leaves[parents[key]] += leaves[key]
            saved[parents[key]] += saved[key]
    return sorted(
        (
            (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k],
             hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest())
            for k, m in members.items()
        ),
        key=repr,
    )


TRIE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def trie_of(spark, rows):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    clash = {c: F.lit("clash") for c in (*CLASH, "node", "parent", "depth", "conv", "words", "pos", "n_convs")}
    return found(prefix_trie.prefix_trie(frame.withColumns(clash)), *TRIE)


def test_trie_of_awkward_rows(spark):
    rows = [
        (20, 1, "user", "hello there"), (20, None, None, None), (21, 0, "user", "hello there"), (21, 0, "user", "hello there"), (21, 0, "assistant", "x " * 5000),
        (22, 0, "user", ""), (None, 0, "user", "nobody's"), (25, 3, "a", "b:c"), (26, 3, "a:", "bc"), (47, 0, "user", "lone"), (60, 0, "user", "one two"),
        *[(61 + i, t, "user", f"word{t} of many") for i in range(15) for t in range(i % 5)], (99, 0, None, "é　wide space"), (100_000, 5, "user", "far"),
    ]
    assert trie_of(spark, rows) == plain_trie(rows)
    assert trie_of(spark, rows[:0]) == []
    assert trie_of(spark, [(None, 0, "user", "x")]) == []


def test_trie_of_chains_stars_and_copies(spark):
    """A long conversation, a first turn that hundreds share, and hundreds of equal conversations."""
    rng = random.Random(4)
    rows = [(7, t, "user", f"step {t}") for t in range(300)]
    rows += [(1000 + i, t, "user", "common opening" if t == 0 else f"own {i} {t}") for i in range(300) for t in range(3)]
    rows += [(5000 + 31 * i, t, "assistant", f"copied {t}") for i in range(300) for t in range(5)]
    rows += [(rng.randrange(20_000, 20_100), t, "user", rng.choice("ab")) for t in range(400)]
    rng.shuffle(rows)
    assert trie_of(spark, rows) == plain_trie(rows)


def test_contraction_takes_logarithmic_rounds(spark, monkeypatch):
    written = []
    keep = prefix_trie.materialize
    monkeypatch.setattr(prefix_trie, "materialize", lambda df: written.append(1) or keep(df))
    tree = spark.createDataFrame([(i, i - 1 if i else None, int(i == 499), 1) for i in range(500)], "node long, parent long, leaves long, saved long")
    totals = {r["node"]: (r["leaves"], r["saved"]) for r in prefix_trie.subtree_totals(tree).collect()}
    assert totals == {i: (1, 500 - i) for i in range(500)}
    assert len(written) < 5 * 30


def test_join_to_one_spreads_heavy_keys(spark):
    many = spark.createDataFrame([(0 if i % 2 else i, i) for i in range(2000)] + [(None, -1)], "k long, v long")
    one = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    joined = skew.join_to_one(many, one, ["k"])
    assert found(joined, "k", "v", "w") == sorted(((0 if i % 2 else i, i, 0 if i % 2 else 2 * i) for i in range(2000)), key=repr)


# --- 13 licenses ---------------------------------------------------------------------

MIT = next(text for text, label in licenses.NOTICES.items() if label == "mit")


def labels_of(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r for r in licenses.scan(docs).collect()}


def test_phrases_stand_word_for_word(spark):
    rows = labels_of(
        spark, "Under the MIT-License; under the mit  license. Apache License, Version 2.0", "under the old mit license", "cc by nc nc by cc by nc", "cc\x00by\x7fnc", "ccé by nc", "mitK under the mit license",
    )
    assert (rows[0]["n_words"], rows[0]["n_base"], rows[0]["first_word"], rows[0]["last_word"], rows[0]["base_labels"]) == (13, 3, 0, 8, "apache-2,mit")
    assert rows[0]["score"] == 1.0 and rows[1]["n_base"] == 0 and rows[1]["first_word"] is None and rows[1]["base_labels"] == ""
    assert (rows[2]["n_base"], rows[2]["first_word"], rows[2]["last_word"]) == (2, 0, 5)
    assert rows[3]["n_base"] == 1 and rows[4]["n_base"] == 0
    assert (rows[5]["n_words"], rows[5]["first_word"]) == (5, 1)


def test_notices_survive_small_changes(spark):
    words = MIT.split()
    changed = words[:10] + ["really"] + words[10:15] + words[16:]
    rows = labels_of(spark, MIT.upper(), " ".join(["before"] * 50 + changed), " ".join(words[:8]), " ".join(words[::-1]), f"{MIT} {MIT}")
    assert [rows[i]["labels"] for i in range(5)] == ["mit", "mit", "", "", "mit"]
    assert rows[0]["score"] == rows[4]["score"] == 1.0 and 0.6 <= rows[1]["score"] < 1.0 and 0 < rows[2]["score"] < 0.6
    assert all(r["base_labels"] == "" and r["n_base"] == 0 for r in rows.values())


def test_licenses_of_awkward_rows(spark):
    clash = {c: F.lit("clash") for c in (*CLASH, "row", "words", "template", "pos", "label", "hash", "tpos")}
    rows = [(1, "under the mit license"), (1, "under the mit license"), (None, "cc by nc"), (None, None), (2, ""), (3, " \n"), (4, "cc by nc " * 20_000), (5, "x " * 100_000)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").withColumns(clash))
    goal = [(1, 4, 1, "mit"), (1, 4, 1, "mit"), (None, 3, 1, "cc-by-nc"), (None, 0, 0, ""), (2, 0, 0, ""), (3, 0, 0, ""), (4, 60_000, 20_000, "cc-by-nc"), (5, 100_000, 0, "")]
    assert found(got, "doc_id", "n_words", "n_base", "labels") == sorted(goal, key=repr)
    assert licenses.scan(got.select("doc_id", F.lit("x").alias("text")).limit(0)).count() == 0


def test_templates_need_a_run(spark):
    with pytest.raises(ValueError):
        licenses.scan(spark.createDataFrame([(1, "x")], "doc_id long, text string"), {"two words": "x"})


def test_licenses_use_no_python_workers(spark):
    templates, runs = licenses._rows(licenses.PHRASES, licenses.NOTICES)
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = licenses.spans(licenses.matches(docs, runs), templates)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
