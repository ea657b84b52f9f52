"""Every operator on whole small tables against plain versions, and on awkward rows.

The awkward table has null ids, texts and sources, empty, blank and very long texts, ties,
repeated rows and extra columns whose names clash with those that operators use.
"""

import base64
import json
import os

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lograin.llm import (
    bpe, chosen_path, chunks, components, cuckoo, line_dedup, mixing, queries, rans, rules, sharding, token_files, topk, toxicity,
)
from lograin.session import scratch_path
from tests import compare
from tests.llm import reference

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
PROSE = "the quick brown fox jumps over the lazy dog while seven wizards brew a potion of green tea and honey"
AWKWARD = [
    (1, PROSE, "a", 7), (2, PROSE.upper(), "a", 7), (2, PROSE.upper(), "a", 7), (3, PROSE + " tonight", None, 7), (4, "", "b", None),
    (5, None, "b", 7), (None, PROSE, "a", 7), (None, None, None, None), (6, " \n\t ", "é", 7), (7, "word " * 30_000, "b", 7),
    (8, "one\ntwo\n\none", "b", 7), (9, "日本語 text　with spaces  and\r\nreturns", "é", 7), (10, "é" * 5000, "c", 7),
    (11, "x", "c", 7), (12, PROSE + "\n" + PROSE.replace("fox", "fax") + "\n" + PROSE, "c", 7), (-5, "negative " * 9, "c", 7),
]
CLASH = ["size", "n", "key", "shard", "label", "node", "bucket", "part", "class", "place", "source_size", "copies", "_key", "at", "line", "n_lines"]


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SF_DIR)


@pytest.fixture(scope="module")
def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = spark.createDataFrame(AWKWARD, "doc_id long, text string, source string, n_chars long")
    return rows.withColumns({c: F.lit("clash") for c in CLASH} | {"lang": F.lit(None).cast("string")})


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.limit(0)


def found(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, duck, name):
    assert compare.spark_rows(queries.QUERIES[name](spark, SF_DIR)) == compare.duck_rows(duck, queries.ORACLES[name])


# --- 1 toxicity ----------------------------------------------------------------


def test_toxicity_finds_held_out_cases(spark):
    big = "/root/testdata/sf0.01"
    scored = queries.op1_toxicity(spark, big)
    rows = scored.join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").filter("held_out").select("toxic", "score", "predicted").collect()
    ranks = [(a["score"] > b["score"]) + 0.5 * (a["score"] == b["score"]) for a in rows if a["toxic"] for b in rows if not b["toxic"]]
    assert sum(ranks) / len(ranks) > 0.7
    assert scored.count() == scored.filter("score between 0 and 1").count() == 1000
    assert scored.filter("predicted <> cast(score >= 0.3 as int)").isEmpty()


def test_toxicity_of_awkward_rows(spark, awkward, empty):
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(1, 13)] + [(None, 1), (2, None)], "doc_id long, label int")
    assert found(toxicity.score_toxicity(awkward, labels).filter("score between 0 and 1"), "doc_id") == sorted(((r[0],) for r in AWKWARD), key=repr)
    assert toxicity.score_toxicity(empty, labels.limit(0)).count() == 0
    assert {r["score"] for r in toxicity.score_toxicity(awkward, labels.filter("label = 1")).collect()} == {1.0}


def test_toxic_words_raise_the_ratio():
    hashes = toxicity._hashes()
    words = np.sort(hashes.of("plain vile"))
    ratio = np.where(words == hashes.of("vile")[0], 3.0, -0.1)
    nothing = np.zeros(0, np.int64)
    model = toxicity.Model(words, ratio, np.zeros(2), nothing, nothing.astype(float))
    assert model.evidence(hashes.of("plain " * 99 + "vile"))[1] == 3.0
    assert model.evidence(hashes.of("unknown words"))[0] == 0.0


def test_models_keep_every_word_and_pair(spark):
    filler = " ".join(f"w{i}" for i in range(140_000))
    rows = [(f"{filler} own{i}", 0) for i in range(6)] + [(f"rare vile words {i}", 1) for i in range(5)] + [(f"rare good words {i}", 0) for i in range(5)]
    shards = toxicity.count_models(spark.createDataFrame(rows, "text string, label int"))
    hashes = toxicity._hashes().of("rare vile good w139999")
    model = shards.model([hashes])
    assert sorted(model.words) == sorted(hashes)
    assert len(model.pairs) == 1 and len(shards.model([toxicity._hashes().of(filler)]).pairs) == 139_999
    assert model.ratios(hashes)[1] > 0 > model.ratios(hashes)[2]


def test_models_equal_plain_ones_in_any_number_of_shards(spark, documents, monkeypatch):
    rows = [(text, i % 2) for i, (_, text) in enumerate(documents) if text][:60]
    expected = reference.kneser_ney(rows, toxicity.RARE)
    for size in (60, 1 << 18):
        monkeypatch.setattr(toxicity, "SHARD", size)
        shards = toxicity.count_models(spark.createDataFrame(rows, "text string, label int"))
        assert (len(shards.words) > 1) == (size == 60)
        for text, _ in rows[:20]:
            hashes = toxicity._hashes().of(text)
            assert np.allclose(shards.model([hashes]).ratios(hashes), expected(text))


# --- 2 mixing ------------------------------------------------------------------


def test_mix_meets_its_targets(spark):
    rows = queries.op2_mixing(spark, SF_DIR).collect()
    sources = {}
    for r in rows:
        assert r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        known = sources.setdefault(r["source"], [0, r["source_size"], r["target"], 0, 0])
        known[0], known[3], known[4] = known[0] + r["taken"], known[3] + r["size"], max(known[4], r["size"])
    names = sorted(sources, key=lambda s: (s is None, (s or "").encode()))
    goal, weights = 1.5 * sum(s[1] for s in sources.values()), dict(zip(names, [5, 2, 1] * len(names)))
    low, high = 0.0, goal
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(2 * sources[n][1], weights[n] * level) for n in names) < goal else (low, level)
    for name, (taken, size, target, summed, largest) in sources.items():
        assert size == summed and target == pytest.approx(min(2 * size, weights[name] * high), rel=1e-6)
        assert abs(taken - target) <= largest
    again = queries.op2_mixing(spark, SF_DIR)
    assert found(again, "doc_id", "taken") == sorted(((r["doc_id"], r["taken"]) for r in rows), key=repr)


def test_mix_of_awkward_rows(awkward, empty):
    rows = mixing.mix(awkward).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    assert sum(r["size"] for r in rows) == sum(len((t or "").encode().split()) for _, t, *_ in AWKWARD)
    assert mixing.mix(empty).count() == 0


# --- 3 token files ---------------------------------------------------------------


def token_rows(docs, tokenizer):
    start, rows = 0, []
    coded = [(doc is None, doc or 0, doc, np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")) for doc, text in docs]
    for *_, doc, ids in sorted(coded, key=lambda r: (r[0], r[1], r[3].astype("<u2").tobytes())):
        rows.append((doc, start, len(ids), reference.crc(ids.tobytes())))
        start += len(ids)
    return sorted(rows, key=repr)


def test_token_files(spark, documents, awkward, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    assert found(queries.op3_token_files(spark, SF_DIR), "doc_id", "start", "n_tokens", "ids_crc32") == token_rows(documents, tokenizer)
    definition = open(path, encoding="utf-8").read()
    special = [(1, "end <|endoftext|> here"), (2, "a<|endoftext|>"), (3, "<|endoftext|>  \n<|endoftext|>."), (4, "plain")]
    tables = ((awkward, [r[:2] for r in AWKWARD]), (empty, []), (spark.createDataFrame(special, "doc_id long, text string"), special))
    assert tokenizer.encode(special[0][1], add_special_tokens=False).ids.count(50256) == 1
    for docs, rows in tables:
        out = scratch_path(spark, "tokens")
        token_files.write(docs, definition, out)
        assert found(token_files.read(spark, out), "doc_id", "start", "n_tokens", "ids_crc32") == token_rows(rows, tokenizer)


def test_columns_of_texts_equal_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    definition, tokenizer = open(path, encoding="utf-8").read(), Tokenizer.from_file(path)
    words = token_files.Words(definition, "H")
    cache = chunks.ColumnCache(words.encode, words.whole, limit=500, longest=6)
    rng = np.random.default_rng(3)
    parts = [" ", " ", " ", "\n", "  ", "\n\n", ".", ",", "...", "a", "words", "s", "'s", "'ll", "'", "é", "ñ", "ß", "×", "ª", "١", "ɏ", "ɐ", "中", "😀"]
    parts += ["0", "12", "-", '"', "_", "<|endoftext|>", "<|", "\t", "\0", "\x01", "\x1c", "\x7f", "\x85", "\xa0", "\u3000", "\u200b"]
    texts = ["".join(rng.choice(parts, n)) for n in rng.integers(0, 14, 8000)] + [None, "", "x" * 5000, " one word" * 1000]
    for start in range(0, len(texts), 2500):
        for first, column in chunks.column_slices(pa.array(texts[start : start + 2500]), 3000):
            assert column[0].as_py() == texts[start + first]
            for text, found in zip(column.to_pylist(), cache.values_of(column, b"\2\0").to_pylist(), strict=True):
                assert np.frombuffer(found, "<u2").tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids + [2], text


def test_different_words_of_a_column_are_encoded_once_by_the_model_alone():
    words = token_files.Words(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read(), "H")
    words.tokenizer = None  # the whole tokenizer, pretokenizing
    met = []
    cache = chunks.ColumnCache(lambda parts: (met.extend(parts), words.encode(parts))[1], words.whole)
    for _ in range(2):
        cache.values_of(pa.array(["Été or tea, not tea. It's 5 past\nnoon, " + "tea " * 50 + "tea"] * 20))
    assert met.count(" tea") == met.count(",") == met.count(" or") == met.count("\nnoon") == 1


def test_tokenizers_of_another_kind_encode_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    parts = json.load(open(path, encoding="utf-8"))
    parts["pre_tokenizer"]["add_prefix_space"] = True
    changed = json.dumps(parts)
    texts = ["one two", "", None, " three. "]
    rows = token_files._cache(changed, "H").values_of(pa.array(texts), b"\2\0").to_pylist()
    expected = [Tokenizer.from_str(changed).encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
    assert [np.frombuffer(r, "<u2").tolist() for r in rows] == expected


def test_white_space_of_both_expressions_is_the_same():
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    found = pc.match_substring_regex(pa.array(letters), chunks.UNCUT).to_pylist()
    assert found == [c == "\0" or bool(chunks.OTHER_SPACE.search(c)) for c in letters]


@pytest.mark.parametrize("sizes", [[0, 1, 31, 32, 33], [rans.SEGMENT, rans.SEGMENT + 1, rans.BLOCK], []])
def test_rans_round_trip(sizes):
    rng = np.random.default_rng(0)
    blocks = [(rng.zipf(1.2, n) % 60_000).astype(np.int64) for n in sizes]
    ids, counts = np.unique(np.concatenate([*blocks, [5]]), return_counts=True)
    table = rans.Table.fit(ids, counts)
    coded = rans.encode(blocks, table)
    assert all((a == b).all() for a, b in zip(blocks, rans.decode(coded, table, table.slots()), strict=True))
    if sum(sizes) > 1000:
        broken = rans.Block(**{**coded[-1].__dict__, "checks": [c ^ 1 for c in coded[-1].checks]})
        with pytest.raises(ValueError):
            rans.decode([broken], table, table.slots())


def test_crc_of_joined_strings():
    for a, b in ((b"", b"abc"), (b"abc", b""), (b"hello ", b"world" * 1000)):
        assert rans.crc32_join(reference.crc(a), reference.crc(b), len(b)) == reference.crc(a + b)


# --- 4 top k -------------------------------------------------------------------


def test_top_k_awkward(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [((i * 7 + j * 3) % 11) / 8 - 0.6 for j in range(6)]) for i in range(50)]
    rows += [(60, [0.5] * 6), (61, [0.5] * 6), (80, [0.5] * 6), (100, [nan] * 6), (120, None), (140, [None] * 6), (160, [inf] * 6), (180, []), (None, [1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("block", F.lit("clash"))
    usable = [r for r in rows if r[0] is not None]
    as_float = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in usable]
    assert found(topk.top_k(vectors, 7, 20), "query_id", "rank", "vec_id", "score") == sorted(reference.best(as_float, 7, 20), key=repr)
    assert topk.top_k(vectors.limit(0), 7, 20).count() == 0


def test_top_k_of_repeated_ids_and_vectors_of_all_lengths(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 16)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    monkeypatch.setattr(topk, "MERGED", 3)
    rng = np.random.default_rng(3)
    rows = [(int(i), (rng.normal(size=8) * 1.5 ** (i % 17)).round(3).tolist()) for i in range(300)]
    rows += [(40, [1.0] * 8)] * 3 + [(41, [0.0] * 8), (60, [0.0] * 8), (80, rows[5][1]), (5, rows[5][1])]
    whole = np.floor(np.array([v for _, v in rows]) * 64).astype(np.int64)
    ids, expected = np.array([i for i, _ in rows]), []
    for at in np.flatnonzero(ids % 20 == 0):
        others = np.delete(np.arange(len(rows)), at)
        best = sorted((-int(whole[at] @ whole[o]), int(ids[o])) for o in others)[:7]
        expected += [(int(ids[at]), rank, vec, -score) for rank, (score, vec) in enumerate(best, 1)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 7, 20)
    assert found(got, "query_id", "rank", "vec_id", "score") == sorted(expected, key=repr)


def test_short_candidates_are_not_multiplied(spark):
    bands = [(3, 1.0), (2, 5.0), (4, 9.0)]
    rows = spark.createDataFrame([([40, 90], [10.0, 10.0]), ([70, 90], [10.0, 10.0]), ([-5, 90], [10.0, 0.0])], "cutoffs array<long>, query_lengths array<double>")
    assert [r[0] for r in rows.select(topk.first_block(topk.shortest_reach(), bands)).collect()] == [3, 5, 0]
    queries, items = topk._in_reach(np.array([50, 90]), np.array([10.0, 10.0]), np.array([1.0, 5.0, 8.0]))
    assert queries.tolist() == [0] and items.tolist() == [1, 2]


# --- 5 BPE ---------------------------------------------------------------------


@pytest.fixture(scope="module")
def encodings():
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return bpe.TreeEncoder(ranks, public_tokenizers.PATTERN), plain


def bpe_rows(docs, plain):
    rows = []
    for doc, text in docs:
        ids = plain.encode_ordinary(text or "")
        rows.append((doc, len(ids), reference.sha(" ".join(map(str, ids)).encode()), reference.sha((text or "").encode())))
    return sorted(rows, key=repr)


def test_bpe(spark, documents, awkward, empty, encodings):
    columns = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert found(queries.op5_bpe(spark, SF_DIR), *columns) == bpe_rows(documents, encodings[1])
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    for docs, rows in ((awkward, [r[:2] for r in AWKWARD]), (empty, [])):
        assert found(bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN), *columns) == bpe_rows(rows, encodings[1])


def test_tree_equals_plain_merging(encodings, monkeypatch):
    tree, plain = encodings
    rng = np.random.default_rng(1)
    letters = list("ab \n\t　é'stllve12.,!  \x1c\x85\xa0中文😀AZ\0")
    monkeypatch.setattr(bpe, "LEAF_CHARS", 24)
    for i in range(600):
        text = "".join(rng.choice(letters, rng.integers(0, 150)))
        assert tree.encode(text) == plain.encode_ordinary(text)
        cache = chunks.ChunkCache(lambda parts: [tree.encode(p) for p in parts], limit=5, longest=4)
        for _ in range(2):
            values = list(cache.values_of([text, text])[1])
            assert [x for v in values for x in v] == plain.encode_ordinary(text)
    for text in ("a" * 3000, "ab" * 3000, "".join(rng.choice(list("abcdefgh"), 5000))):
        assert tree.encode(text) == plain.encode_ordinary(text)
        assert tree.decode(tree.encode(text)) == text.encode()


def test_strings_merged_together_equal_single_ones(encodings):
    tree, plain = encodings
    rng = np.random.default_rng(6)
    strings = [rng.choice(list(b"abcdeersting \xc3\xa9\xe4\xff0123"), n).astype(np.uint8).tobytes() for n in rng.integers(0, 33, 3000)]
    merged = bpe.Merger(tree.ranks).merge(strings)
    for s in strings:
        assert np.frombuffer(merged[s], "<u2").tolist() == tree.merge(s)


# --- 6 sharding ------------------------------------------------------------------


def test_shards_hold_equal_bytes(spark, documents):
    rows = queries.op6_sharding(spark, "/root/testdata/sf0.01").collect()
    slots, sizes = {}, {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
    assert sorted(sizes) == list(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) < 1.1 * sum(sizes.values()) / 16


def test_a_large_group_is_divided(spark):
    rows = spark.createDataFrame([(i, "copy of a text" if i % 3 else f"text {i} of its own") for i in range(900)], "doc_id long, text string")
    shards = sharding.shard_by_metadata(rows, 5).groupBy("shard").agg(F.sum("size").alias("bytes")).collect()
    assert len(shards) == 5 and max(r["bytes"] for r in shards) < 1.05 * sum(r["bytes"] for r in shards) / 5


def test_shards_follow_the_metadata(spark):
    """The cuts separate sources, then lengths; equal texts meet whatever their rows say."""
    rows = [(i, f"{i:06d} some words of a text", "en", f"source {i % 2}") for i in range(400)]
    schema = "doc_id long, text string, lang string, source string"
    dealt = sharding.shard_by_metadata(spark.createDataFrame(rows, schema), 2)
    assert len({(r["doc_id"] % 2, r["shard"]) for r in dealt.collect()}) == 2
    lengths = [(i, f"{i:06d}" + "x" * (10 + 3 * i), "en", "one") for i in range(400)]
    dealt = sharding.shard_by_metadata(spark.createDataFrame(lengths, schema), 4).collect()
    spans = {}
    for r in dealt:
        spans.setdefault(r["shard"], []).append(r["size"])
    ordered = sorted((min(v), max(v)) for v in spans.values())
    assert all(a[1] < b[0] for a, b in zip(ordered, ordered[1:]))
    copies = [(i, f"text {i // 4} of four copies", ("en", "de", None, "fr")[i % 4], f"source {i % 3}") for i in range(2000)]
    dealt = sharding.shard_by_metadata(spark.createDataFrame(copies, schema), 8).collect()
    places = {}
    for r in dealt:
        places.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert len(places) == 500 and all(len(p) == 1 for p in places.values())
    weights = [sum(r["size"] for r in dealt if r["shard"] == n) for n in range(8)]
    assert max(weights) < 1.05 * sum(weights) / 8


def test_equal_texts_stay_together(spark):
    """Every text of the table lies in one shard, but groups too large for that."""
    big = "/root/testdata/sf0.01"
    dealt = queries.op6_sharding(spark, big).collect()
    places, total = {}, sum(r["size"] for r in dealt)
    for r in dealt:
        shards, size = places.get((r["text_crc32"], r["size"]), (set(), 0))
        places[r["text_crc32"], r["size"]] = shards | {r["shard"]}, size + r["size"]
    assert {r["law"] for r in dealt} == {"bytes"}
    assert all(len(shards) == 1 or size > sharding.GROUP_TOLERANCE * total / 16 for shards, size in places.values())


def test_shards_of_awkward_rows(awkward, empty):
    got = found(sharding.shard_by_metadata(awkward, 3), "doc_id", "size", "text_crc32")
    expected = [(d, len((t or "").encode()) + 1, reference.crc((t or "").encode())) for d, t, *_ in AWKWARD]
    assert got == sorted(expected, key=repr)
    assert sharding.shard_by_metadata(empty, 3).count() == 0


# --- 7 line dedup ----------------------------------------------------------------


def test_lines(spark, documents):
    expected = reference.kept_lines(sorted(documents))
    got = queries.op7_line_dedup(spark, SF_DIR).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == {d: (n, e, c, reference.crc(t.encode())) for d, (n, e, c, t) in expected.items()}


def test_near_lines(spark, awkward, empty):
    base = "a line of text that is long enough for two edits"
    texts = [base, base + "!!", base[3:], base.replace("text", "tent"), base + "!!!", "short line 12345", "short line 12346", "tiny", "tiny", base]
    rows = [(i, t + "\nown line of number %d %s" % (i, "x" * 7 * i)) for i, t in enumerate(texts)]
    left = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    expected = reference.kept_lines(rows)
    assert {r["doc_id"]: (r["n_lines"], r["n_equal"], r["n_near"], r["text"]) for r in left.collect()} == expected
    got = line_dedup.dedup_lines(awkward)
    assert got.count() == len(AWKWARD) and set(awkward.columns) <= set(got.columns)
    assert {r["doc_id"]: r["text"] for r in got.collect()}[12] == ""
    assert line_dedup.dedup_lines(empty).count() == 0


def test_lines_of_rows_without_an_id_of_their_own(spark):
    base = "a line of text that is long enough for two edits"
    texts = [f"first {base}\nunique line of row {i} {'z' * 5 * i}\n{base}{'!' * (i % 3)}" for i in range(6)] + [f"x\n{base}\nanother"] * 3 + ["", None, " \n "]
    rows = [(doc, text) for doc in (None, 4) for text in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = sorted(
        ((r["doc_id"] is None, r["doc_id"] or 0, r["own"], r["text"] or "", r["text"], r["doc_id"]) for r in docs.withColumn("own", line_dedup._own()).collect()), key=lambda k: k[:4]
    )
    expected = reference.kept_lines([(i, k[4]) for i, k in enumerate(keyed)])
    # null texts stay null
    want = [(k[5], n, e, c, None if k[4] is None else t) for k, (n, e, c, t) in zip(keyed, (expected[i] for i in range(len(keyed))))]
    got = line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_equal", "n_near", "text")
    assert found(got, *got.columns) == sorted(want, key=repr)


def test_banded_distance():
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("ab"), rng.integers(0, 12))) for _ in range(80)]
    lengths = np.array([len(t) for t in texts])
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    a, b = (x.ravel() for x in np.meshgrid(np.arange(80), np.arange(80)))
    for tau in (0, 1, 2):
        got = line_dedup.within(codes, np.cumsum(lengths) - lengths, lengths, a, b, np.full(len(a), tau))
        assert got.tolist() == [reference.within_edits(texts[i], texts[j], tau) for i, j in zip(a, b)]


def test_lines_keep_clashing_columns(spark):
    """Columns of the caller come out as they went in, whatever they are called."""
    names = ["_key", "_gone", "_own", "_at", "_bits", "_bucket", "bucket", "bits", "_rows", "_row", "_same", "_copy", "near", "rest", "c0"]
    rows = [(i, f"a shared line of some length\nown line {i} of a text", *[f"{n} {i}" for n in names]) for i in range(6)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", *names])
    got = line_dedup.dedup_lines(docs.unionByName(docs.filter("doc_id = 3")))
    assert got.columns == [*docs.columns, "n_lines", "n_equal", "n_near"]
    assert found(got, "doc_id", *names) == sorted([(r[0], *r[2:]) for r in [*rows, rows[3]]], key=repr)
    assert {r["doc_id"] for r in got.filter("n_equal = 0").collect()} == {0}


# --- 8 quality -------------------------------------------------------------------


def test_quality_of_held_out_rows(spark):
    big = "/root/testdata/sf0.01"
    scored = queries.op8_quality(spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").filter("held_out")
    right = scored.filter("predicted = quality").count()
    assert right > 0.9 * scored.count()


def test_quality_of_awkward_rows(spark, awkward, empty):
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(1, 13)] + [(2, None)], "doc_id long, label int")
    assert rules.score_quality(awkward, labels).filter("score between 0 and 1").count() == len(AWKWARD)
    assert rules.score_quality(awkward, labels.limit(0)).filter("score > 0.9").count() == len(AWKWARD)
    assert rules.score_quality(empty, labels).count() == 0


def test_sample_is_the_first_by_hash(spark):
    known = spark.range(30_000).select(F.col("id").alias("doc_id"), *[F.rand(i).alias(c) for i, c in enumerate(rules.STATISTICS)], (F.col("id") % 2).alias("label"))
    plain = known.orderBy(F.xxhash64("doc_id", *rules.STATISTICS), "label").limit(500)
    assert found(rules.first_rows(known, 500), "doc_id") == found(plain, "doc_id")


def test_rules_mean_the_same_on_both_sides(spark):
    rng = np.random.default_rng(3)
    x = rng.random((400, len(rules.STATISTICS)))
    y = ((x[:, 0] > 0.5) & (x[:, 5] < 0.4)).astype(float)
    model = rules.select(x, y, rules.propose(x, y))
    frame = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], ["doc_id", *rules.STATISTICS])
    scores = [r["s"] for r in frame.select("doc_id", model.score().alias("s")).orderBy("doc_id").collect()]
    assert np.mean((np.array(scores) > 0.5) == y) > 0.97 and len(model.rules) < 60


# --- 9 near dedup ----------------------------------------------------------------


def test_near_groups(spark, documents):
    expected = reference.near_groups(documents, 4)
    got = queries.op9_near_dedup(spark, SF_DIR).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == expected
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_a_large_near_group_is_tiled(spark, monkeypatch):
    monkeypatch.setattr(chosen_path, "TILE", 16)
    monkeypatch.setattr(chosen_path, "SET_TILE", 16)
    monkeypatch.setattr(chosen_path, "LIMIT", 4)
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(80)]
    rows = []
    for doc in range(90):
        own = list(words)
        for at in rng.integers(0, 80, doc % 4):
            own[at] = f"x{rng.integers(1000)}"
        rows.append((doc, " ".join(own)))
    got = chosen_path.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == reference.near_groups(rows, 4)


def test_near_groups_of_awkward_rows(awkward, empty):
    got = chosen_path.near_duplicates(awkward, 4).collect()
    by_id = {r["doc_id"]: r for r in got}
    assert len(got) == len(AWKWARD) and by_id[2]["component_id"] == by_id[3]["component_id"] == 1
    assert by_id[4]["n_shingles"] == by_id[5]["n_shingles"] == 0 and by_id[5]["kept"] and by_id[11]["n_shingles"] == 1
    assert chosen_path.near_duplicates(empty, 4).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (7, 8), (300, 200)]
    got = dict(tuple(r) for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(1, 41), 1), **dict.fromkeys(range(100, 130), 100), 200: 200, 300: 200}


# --- 10 exact dedup ----------------------------------------------------------------


def test_exact_dedup_of_awkward_rows(awkward, empty):
    rows = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in cuckoo.exact_dedup(awkward).collect()}
    assert {(1, 2, 4, False), (2, 2, 4, True), (None, 2, 4, False), (4, 5, 3, False), (5, 5, 3, True), (11, 11, 1, True)} <= rows
    assert cuckoo.exact_dedup(empty).count() == 0


def test_index_inserts_deletes_and_finds(spark):
    docs = spark.createDataFrame([(i, f"text {i % 700}") for i in range(1000)], "doc_id long, text string")
    marked = cuckoo.digests(docs)
    index = cuckoo.CuckooIndex.empty(spark, 10).insert(marked.filter("doc_id < 500")).insert(marked.filter("doc_id >= 500"))
    assert index.keys().count() == 700 and index.keys().filter("copies = 2 and keep_id >= 700").count() == 300
    gone = marked.filter("doc_id < 100")
    index = index.delete(gone).delete(cuckoo.digests(spark.createDataFrame([(1, "unknown")], "doc_id long, text string")))
    assert index.lookup(marked).count() == 600 and index.lookup(gone).count() == 0
    assert index.insert(gone).lookup(gone).count() == 100


def test_index_decides_by_its_filters(spark):
    rows = [(i, f"text {i % 600}") for i in range(900)]
    marked = cuckoo.digests(spark.createDataFrame(rows, "doc_id long, text string"))
    first = cuckoo.CuckooIndex.empty(spark, 10).insert(marked.filter("doc_id < 600"))
    assert first.hits(marked.filter("doc_id >= 600")).count() == 300 and first.later.count() == 0
    unknown = cuckoo.digests(spark.createDataFrame([(i, f"new {i}") for i in range(500)], "doc_id long, text string"))
    assert first.hits(unknown).count() < 10
    then = first.insert(marked.filter("doc_id >= 600"))
    assert then.live.count() == 600 and then.later.count() == 300
    # a key that the filter doesn't know is not found, stored or not
    blind = cuckoo.CuckooIndex(first.filters.limit(0), first.live, first.later, first.shards, first.buckets)
    assert blind.lookup(marked).count() == 0 and then.lookup(marked).filter("copies = 2").count() == 300


def test_overflow_builds_the_filter_from_stored_keys(spark):
    marked = cuckoo.digests(spark.createDataFrame([(i, f"text {i}") for i in range(9000)], "doc_id long, text string"))
    index = cuckoo.CuckooIndex.empty(spark, 10).insert(marked.filter("doc_id < 2000"))
    small = {r["shard"]: r["buckets"] for r in index.filters.collect()}
    index = index.insert(marked.filter("doc_id >= 2000"))
    assert all(r["buckets"] > small[r["shard"]] == 64 for r in index.filters.collect())
    assert index.lookup(marked).count() == index.keys().count() == 9000


@pytest.mark.parametrize("batches", [1, 3, 7])
def test_exact_dedup_of_any_number_of_batches(spark, documents, batches):
    docs = spark.createDataFrame(documents, "doc_id long, text string")
    groups = {}
    for doc, text in documents:
        groups.setdefault((text or "").translate(str.maketrans(cuckoo.UPPER, cuckoo.LOWER)), []).append(doc)
    expected = sorted(((d, max(g), len(g)) for g in groups.values() for d in g), key=repr)
    assert found(cuckoo.exact_dedup(docs, batches), "doc_id", "keep_id", "group_size") == expected


def test_filter_overflow_is_resized():
    keys = [base64.b16decode(reference.sha(str(i).encode()).upper()) for i in range(3000)]
    assert not all(map(cuckoo.Filter(64).add, keys))
    known = cuckoo.Filter.holding(keys, 64)
    assert known.buckets > 64 and all(k in known for k in keys)
    for key in keys[:1500]:
        known.remove(key)
    assert all(k in known for k in keys[1500:]) and sum(k in known for k in keys[:1500]) < 20


# --- pipeline ----------------------------------------------------------------------


def test_pipeline_keeps_what_it_should(spark, documents):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = {name: None for name, _ in corpus_pipeline.STAGES}
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "quality classifier" and len(rows) == 5
    current = docs
    for name, stage in corpus_pipeline.STAGES:
        before, current = current, corpus_pipeline.materialize(stage(spark, current, SF_DIR))
        if name != "byte-level BPE":
            assert current.columns == docs.columns
        had, has = before.count(), current.count()
        if name == "line dedup":
            left = reference.kept_lines(sorted(tuple(r) for r in before.select("doc_id", "text").collect()))
            stays = {d: t for d, (n, e, c, t) in left.items() if t.strip() or not e + c}
            assert {r["doc_id"]: r["text"] for r in current.collect()} == stays
        if name == "MinHash near-dedup":
            groups = reference.near_groups([tuple(r) for r in before.select("doc_id", "text").collect()], 5)
            assert {r["doc_id"] for r in current.collect()} == {g for _, g in groups.values()}
        assert has <= 2 * had


def test_pipeline_stages_take_awkward_rows(spark, awkward, empty):
    plain = awkward.select("doc_id", "text", "lang", "source", "n_chars")
    for rows in (plain, plain.limit(0)):
        for _, stage in corpus_pipeline.STAGES[1:]:
            rows = corpus_pipeline.materialize(stage(spark, rows, SF_DIR))
    assert rows.count() == 0
