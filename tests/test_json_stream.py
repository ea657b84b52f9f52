"""JSON files cut in parallel, against a plain decoder."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lograin.sources import json_stream as S


@pytest.fixture
def small_splits(spark):
    kept = {name: spark.conf.get(name) for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for name, value in kept.items():
        spark.conf.set(name, value)


def random_value(rng, depth):
    kind = rng.random()
    if depth > 3 or kind < 0.4:
        return rng.choice([1, -2.5e3, True, None, 'a"}{][,\\', "\\\\", "x y", "é ", ""])
    if kind < 0.7:
        return {rng.choice('abc,"}') + str(i): random_value(rng, depth + 1) for i in range(rng.randrange(4))}
    return [random_value(rng, depth + 1) for _ in range(rng.randrange(4))]


def documents_of(value):
    return [value] if isinstance(value, dict) else value if isinstance(value, list) else []


def read(spark, path, **how):
    rows = S.stream_documents(spark, path, **how).select(*S.PLACE, "unit", F.to_json("document").alias("text")).collect()
    found = {}
    for row in sorted(rows, key=lambda r: tuple(r)[:4]):
        found.setdefault(row["file_path"].rsplit("/", 1)[1], []).append(json.loads(row["text"]))
    return found


@pytest.mark.parametrize("separator, limit", [("}", 1), ("}", 300), (",", 40), ("\n", 1 << 20)])
def test_files_equal_a_plain_decoder(spark, tmp_path, small_splits, separator, limit):
    """Pretty-printed and dense values, arrays longer than a split, strings full of brackets."""
    rng, expected = random.Random(1), {}
    for number in range(4):
        values = [random_value(rng, 0) if i % 10 else [random_value(rng, 1) for _ in range(200)] for i in range(30)]
        texts = [json.dumps(v, indent=rng.choice([None, 2]), ensure_ascii=rng.random() < 0.5) for v in values]
        (tmp_path / f"{number}.json").write_text(rng.choice(["\n", " \r\n"]).join(texts) + rng.choice(["", "\n"]), encoding="utf-8")
        expected[f"{number}.json"] = [d for v in values for d in documents_of(v)]
    assert read(spark, str(tmp_path), separator=separator, limit=limit) == expected


def test_one_array_of_one_line(spark, tmp_path, small_splits):
    """A dense array over many splits: neither a line nor a value nor a file is ever one row."""
    values = [{"n": i, "text": "x" * (i % 50)} for i in range(3000)]
    (tmp_path / "a.json").write_text(json.dumps(values))
    assert read(spark, str(tmp_path), limit=1000) == {"a.json": values}
    sizes = S.chunks(spark, str(tmp_path), limit=1000).agg(F.max("size"), F.count("*"), F.countDistinct("block")).first()
    assert sizes[0] < 1200 and sizes[1] > 100 and sizes[2] > 10


BROKEN = {
    '{"a":1} {"b":2': ['{"a":1}', "!"], "[1,2,]": ["1", "2", "!"], "[1,,2]": ["1", "!", "2"], "[1}": ["!"], '{"a":1]': ["!"], "{} x": ["{}", "!"],
    "[1 2]": ["!"], '1 "a b" true': [], "[]  [ ] {}": ["{}"], "[1]]": ["1", "!"], '{"a":1},{"b":2}': ['{"a":1}', "!", '{"b":2}'], "": [], " \n": [],
    "[": ["!"], '[1,"x': ["1", "!"], "nul": ["!"], '﻿{"a":1}': ['{"a":1}'], '﻿{"a":1': ["!"], '"ab': ["!"], '[{"a":1}': ["!"], '{"v":1}}': ['{"v":1}', "!"],
    '[{"a":1},{"b":[1,2}]': ['{"a":1}', "!"], "[[1],[2]]\n{}": ["[1]", "[2]", "{}"], '{"a":1,"a":2}': ['{"a":2}'],
}


@pytest.mark.parametrize("limit", [1, 1 << 20])
def test_faults_are_found(spark, tmp_path, limit):
    for number, text in enumerate(BROKEN):
        (tmp_path / f"{number:02}.json").write_text(text, encoding="utf-8")
    (tmp_path / "99.json").write_bytes(b'{"a":"\xff"}')
    rows = S.stream_values(spark, str(tmp_path), limit=limit).select(*S.PLACE, "unit", F.to_json("value").alias("text"), "fault").collect()
    found = {f"{number:02}.json": [] for number in range(len(BROKEN))}
    for row in sorted(rows, key=lambda r: tuple(r)[:4]):
        found.setdefault(row["file_path"].rsplit("/", 1)[1], []).append("!" if row["fault"] else row["text"])
    assert found.pop("99.json") == ["!"]
    assert list(found.values()) == list(BROKEN.values())
    with pytest.raises(Exception, match="not JSON in"):
        S.stream_documents(spark, str(tmp_path)).collect()
    assert S.stream_documents(spark, str(tmp_path), strict=False).count() == sum(t != "!" for texts in BROKEN.values() for t in texts)


def test_effects_compose():
    """The effect of two pieces is that of both one after the other."""
    rng = random.Random(3)
    for _ in range(2000):
        text = "".join(rng.choice('{}[],"x') for _ in range(rng.randrange(30))).encode()
        at = rng.randrange(len(text) + 1)
        first, second, whole = (S.effect(part) for part in (text[:at], text[at:], text))
        assert whole[0] == (first[0] + second[0]) % 2
        for inside in (0, 1):
            (d1, l1, k1), (d2, l2, k2), (d, low, kind) = (
                e[1 + 3 * i : 4 + 3 * i] for e, i in ((first, inside), (second, (inside + first[0]) % 2), (whole, inside))
            )
            assert d == d1 + d2 and low == min(l1, d1 + l2)
            assert kind == (k2 if d1 + l2 < l1 or (d1 + l2 == l1 and k2) else 0 if d1 + l2 == l1 else k1)
