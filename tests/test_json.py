"""Fingerprints and nodes of JSON documents."""

import json
import random

from pyspark.sql import functions as F

from lograin.functions import json_shape as J
from lograin.sources import files


def documents(spark, bodies):
    return files.json_documents(spark.createDataFrame(list(enumerate(bodies)), "no int, body string"), strict=False)


def shapes(spark, bodies, depth=J.DEPTH):
    rows = J.with_shape(documents(spark, bodies), depth=depth).orderBy("no", "pos").collect()
    return [row["shape"] for row in rows]


def expected(value):
    if isinstance(value, dict):
        return "".join(f"{k}:{expected(value[k])}||" for k in sorted(value, key=lambda k: k.encode()))
    if isinstance(value, list):
        return "".join(f"{i}:{expected(v)}" for i, v in enumerate(value))
    if value is None:
        return ""
    if isinstance(value, bool):
        return "<BOOL>"
    if isinstance(value, (int, float)):
        return "<NUM>"
    if " " not in value and (len(value.encode()) > 20 or not is_hex(value)):
        return "<ID>"
    return value


def is_hex(text):
    try:
        return len(bytes.fromhex(text)) * 2 == len(text)
    except ValueError:
        return False


def test_golden_shapes(spark):
    golden = {
        '{"b":1,"a":[true,null,"x y","abc"],"id":"550e8400-e29b-41d4-a716-446655440000"}': [
            "a:0:<BOOL>1:2:x y3:<ID>||b:<NUM>||id:<ID>||"
        ],
        '{"z":{"q":[{"w":"ab"},{"w":"hello world"}]},"e":"","n":null}': [
            "e:||n:||z:q:0:w:ab||1:w:hello world||||||"
        ],
        '[1,{"a":1},"plain",null,[]]': ["<NUM>", "a:<NUM>||", "<ID>", "", ""],
        "{}": [""],
        "5": [],
        '"text"': [],
        '{"a":1,"a":"two words"}': ["a:two words||"],
        "{broken": [],
    }
    assert shapes(spark, list(golden)) == [shape for part in golden.values() for shape in part]


def random_value(rng, depth):
    kind = rng.randrange(8 if depth else 5)
    if kind > 6:
        return {rng.choice("aBcé\U0001F600zß\uff01") + str(rng.randrange(12)): random_value(rng, depth - 1) for _ in range(rng.randrange(5))}
    if kind > 4:
        return [random_value(rng, depth - 1) for _ in range(rng.randrange(13))]
    return [None, rng.random() < 0.5, rng.choice([0, -1.5e30, 10**25, 7]), rng.choice(["", "ab", "abc", "a b", "x" * 21, "FF" * 11]), "é"][kind]


def test_random_documents_of_any_depth(spark):
    rng = random.Random(7)
    values = [{"v": random_value(rng, depth)} for depth in (1, 3, 5, 8) for _ in range(40)]
    bodies = [json.dumps(value, ensure_ascii=rng.random() < 0.5) for value in values]
    assert shapes(spark, bodies) == [expected(value) for value in values]
    # the same documents, most of them too deep for one pass
    assert shapes(spark, bodies, depth=2) == [expected(value) for value in values]


def test_depth_has_no_limit(spark):
    """As deep as texts can be parsed, in objects and arrays by turns."""
    depth = 900
    body = '{"k":[' * (depth // 2) + '{"v":true},7' + "]}" * (depth // 2)
    assert shapes(spark, [body, "[1]"]) == ["k:0:" * (depth // 2) + "v:<BOOL>||1:<NUM>" + "||" * (depth // 2), "<NUM>"]
    nodes = J.json_nodes(documents(spark, [body]))
    assert nodes.count() == depth + 3
    assert nodes.orderBy(F.length("path").desc()).first()["path"] == "$" + ".k[0]" * (depth // 2) + ".v"


def test_fingerprints_use_no_python(spark):
    plan = J.with_shape(documents(spark, ["{}"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_nodes_of_any_step(spark):
    bodies = ['{"a":[1,{"b":{"c":[[2]]}}],"d":{}}']
    rows = sorted(tuple(r) for r in J.json_nodes(documents(spark, bodies)).select("path", "kind").collect())
    for depth in (1, 3):
        assert sorted(tuple(r) for r in J.json_nodes(documents(spark, bodies), depth=depth).select("path", "kind").collect()) == rows


def test_a_long_text_of_many_values(spark):
    body = '{"a":1} ' * 60_000
    assert files.json_values(spark.createDataFrame([(body,)], "body string")).count() == 60_000


def test_nodes_count_every_value(spark):
    rows = J.json_nodes(documents(spark, ['{"a":[1,{"b":null}],"c":"x"}'])).collect()
    assert [(row["path"], row["kind"], row["value"]) for row in rows] == [
        ("$", "object", None),
        ("$.a", "array", None),
        ("$.a[0]", "number", "1"),
        ("$.a[1]", "object", None),
        ("$.a[1].b", "null", None),
        ("$.c", "string", "x"),
    ]


def test_every_value_of_a_text_counts(spark):
    texts = ['{"a":1} {"b":2}', '{"a":1} garbage', "[1],[2]", '1],[2', '{"a":1},"v":2', ' \n{"x":\n 1}\n[{"y":2}] 3', "NaN", "", '{"a":1,"a":2}']
    bodies = spark.createDataFrame(list(enumerate(texts)), "no int, body string")
    found = [(r["no"], r["v"], r["rejected"]) for r in files.json_values(bodies).selectExpr("no", "to_json(value) as v", "rejected").collect()]
    assert sorted(found, key=repr) == sorted(
        [
            (0, '{"a":1}', None), (0, '{"b":2}', None), (1, '{"a":1}', None), (1, None, "garbage"), (2, "[1]", None), (2, None, ",[2]"),
            (3, "1", None), (3, None, "],[2"), (4, '{"a":1}', None), (4, None, ',"v":2'), (5, '{"x":1}', None), (5, '[{"y":2}]', None),
            (5, "3", None), (6, None, "NaN"), (8, '{"a":2}', None),
        ],
        key=repr,
    )
    assert sorted(r["no"] for r in files.json_documents(bodies, strict=False).collect()) == [0, 0, 1, 2, 4, 5, 5, 8]


def test_deep_texts_are_never_lost(spark):
    deep = [("[" * n + "1" + "]" * n) for n in (900, 1200, 5000)]
    bodies = spark.createDataFrame(list(enumerate(deep)), "no int, body string")
    values = files.json_values(bodies)
    assert values.count() == 3
    assert {r["no"] for r in files.json_rejects(bodies).collect()} == {1, 2}


def test_strict_reading_fails_the_job(spark):
    import pytest

    for text in ("{oops", '{"a":1} garbage'):
        bodies = spark.createDataFrame([(text,)], "body string")
        with pytest.raises(Exception, match="not JSON"):
            files.json_documents(bodies).collect()


def test_is_id(spark):
    golden = {"abc": True, "abcd": False, "": False, "two words": False, "a" * 20: False, "a" * 22: True, "é" * 11: True, "ab\n": True}
    rows = spark.createDataFrame(list(enumerate(golden)), "no int, value string").orderBy("no")
    assert [row[0] for row in rows.select(J.json_is_id(F.col("value"))).collect()] == list(golden.values())


def test_a_text_is_parsed_once(spark):
    """One pass over the texts whatever they hold, and one look at the kind of each scalar."""
    bodies = ['{"a":"b c"}', '{"a":1} [2,{"b":null}]', "{broken", "", None, "[" * 1100 + "]" * 1100]
    values = files.json_values(spark.createDataFrame(list(enumerate(bodies)), "no int, body string"))
    plan = values.filter("fault is null")._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("LogicalRDD") + plan.count("LocalRelation") == 1
    rows = values.select("no", F.to_json("value").alias("value"), F.substring("rejected", 1, 7).alias("rejected"), "fault").collect()
    assert sorted(map(tuple, rows), key=str) == [
        (0, '{"a":"b c"}', None, None), (1, '[2,{"b":null}]', None, None), (1, '{"a":1}', None, None),
        (2, None, "{broken", "malformed"), (5, None, "[" * 7, "nested too deep"),
    ]
    shape = spark.range(1).select(J._shape(F.parse_json(F.lit("1")), 1))._jdf.queryExecution().analyzed().toString()
    assert shape.count("schema_of_variant") + shape.count("schemaOfVariant") <= 4  # two of them in the name of the column
