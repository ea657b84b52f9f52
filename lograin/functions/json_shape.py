"""Structural fingerprint and nodes of JSON values, in native expressions.

One nested expression covers a number of levels, which serves usual documents. What lies deeper is
taken from the tokens of its text by windows, at any depth, and its paths are put together in a
logarithmic number of joins. Only documents that deep take part in it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lograin.session import materialize

MAX_ID_LENGTH = 20  # fixed value: longer blank-free strings are identifiers
DEPTH = 8  # levels that one expression covers; what lies deeper takes another way
NODE_DEPTH = 12
NODES = "array<struct<path:string,kind:string,value:string,rest:variant>>"


def _kind_name(kind: Column) -> Column:
    return (
        F.when(kind == "VOID", "null")
        .when(kind.isin("OBJECT", "ARRAY", "STRING", "BOOLEAN"), F.lower(kind))
        .otherwise("number")
    )


def json_kind(value: Column) -> Column:
    """``object``, ``array``, ``string``, ``boolean``, ``number`` or ``null``."""
    return _kind_name(F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0))


def json_is_id(text: Column) -> Column:
    """A string without blanks that is long or not the text of whole hex bytes."""
    hex_bytes = text.rlike("^(?:[0-9A-Fa-f]{2})*\\z")
    return ~F.contains(text, F.lit(" ")) & ((F.octet_length(text) > MAX_ID_LENGTH) | ~hex_bytes)


def sorted_members(value: Column) -> Column:
    """Members of a JSON object in byte order of their keys, NULL for others."""

    def by_key(a, b):
        return F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)

    return F.array_sort(F.map_entries(value.try_cast("map<string,variant>")), by_key)


def sort_keys(value: Column) -> Column:
    return F.transform(sorted_members(value), lambda member: member["key"])


def _children(value: Column, stepped: bool = False) -> Column:
    """Children of either container with the texts around them, NULL for scalars; ``stepped``, with the steps of paths instead.

    One list for both kinds keeps nested expressions linear in their depth.
    """

    def child(name, item, post, step):
        if stepped:
            return F.struct(item.alias("v"), F.concat(*step).alias("step"))
        return F.struct(F.concat(name, F.lit(":")).alias("pre"), item.alias("v"), F.lit(post).alias("post"))

    return F.coalesce(
        F.transform(
            sorted_members(value), lambda m: child(m["key"], m["value"], "||", [F.lit("."), m["key"]])
        ),
        F.transform(
            value.try_cast("array<variant>"),
            lambda v, i: child(i.cast("string"), v, "", [F.lit("["), i.cast("string"), F.lit("]")]),
        ),
    )


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that it names more than once and that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _leaf(value: Column) -> Column:
    """Text of a scalar in fingerprints, NULL for containers."""

    def of_kind(kind: Column) -> Column:
        text = _bound(value.cast("string"), lambda t: F.when(json_is_id(t), "<ID>").otherwise(t))
        return (
            F.when(kind == "STRING", text)
            .when(kind == "BOOLEAN", "<BOOL>")
            .when(kind == "VOID", "")
            .when(~(kind.startswith("OBJECT") | kind.startswith("ARRAY")), "<NUM>")
        )

    return _bound(F.schema_of_variant(value), of_kind)


def _shape(value: Column, depth: int) -> Column:
    """Fingerprint of a value; NULL wherever a container lies too deep."""
    leaf = _leaf(value)
    if depth == 0:
        return leaf
    inner = F.transform(_children(value), lambda c: F.concat(c["pre"], _shape(c["v"], depth - 1), c["post"]))
    joined = _bound(inner, lambda texts: F.when(~F.exists(texts, F.isnull), F.array_join(texts, "")))
    return F.coalesce(joined, leaf)


def with_shape(documents: DataFrame, document: str = "document", depth: int = DEPTH) -> DataFrame:
    """The fingerprint of each JSON value, of any nesting, as ``shape`` in place of the value.

    All documents go through one native expression of ``depth`` levels; those that lie
    deeper through :func:`_deep_values`.
    """
    keep = [name for name in documents.columns if name != document]
    shaped = documents.withColumn("shape", _shape(F.col(document), depth))
    deeper = F.when(F.col("shape").isNull(), F.col(document)).alias("_value")
    shaped = materialize(shaped.select(*keep, "shape", deeper, F.monotonically_increasing_id().alias("_key")))
    deep = shaped.filter("_value is not null")
    if deep.isEmpty():
        return shaped.drop("_value", "_key")
    values = _deep_values(deep.select("_key", "_value"))
    # a member's name or an element's number, then its value; behind a member's subtree a mark
    own = F.struct("order", F.concat("label", F.coalesce(_leaf(F.try_parse_json("token")), F.lit(""))).alias("text"))
    end = F.when(F.col("member"), F.struct(F.concat("order", F.lit("~")).alias("order"), F.lit("||").alias("text")))
    ordered = F.array_sort(F.collect_list("piece"))
    folded = values.select("_key", F.explode(F.array_compact(F.array(own, end))).alias("piece")).groupBy("_key").agg(
        F.array_join(F.transform(ordered, lambda piece: piece["text"]), "").alias("_deep")
    )
    return shaped.drop("_value").join(folded, "_key", "left").select(*keep, F.coalesce("shape", "_deep").alias("shape"))


def _node(path: Column, value: Column, rest: Column) -> Column:
    kind = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    scalar = ~kind.isin("OBJECT", "ARRAY", "VOID")
    text = F.when(scalar, value.cast("string"))
    return F.struct(path.alias("path"), _kind_name(kind).alias("kind"), text.alias("value"), rest.alias("rest"))


def _below(value: Column, path: Column, depth: int) -> Column:
    """Nodes inside of a container; those ``depth`` levels below it keep what they contain."""

    def child(c: Column) -> Column:
        own = F.concat(path, c["step"])
        if depth == 1:
            return F.array(_node(own, c["v"], F.when(_leaf(c["v"]).isNull(), c["v"])))
        return F.concat(F.array(_node(own, c["v"], F.lit(None).cast("variant"))), _below(c["v"], own, depth - 1))

    return F.coalesce(F.flatten(F.transform(_children(value, stepped=True), child)), F.array().cast(NODES))


def json_nodes(documents: DataFrame, document: str = "document", depth: int = NODE_DEPTH) -> DataFrame:
    """One row per value inside each JSON document, the document included, at any depth.

    Columns: ``path`` (``$.key`` and ``$[index]`` steps), ``kind`` and, for
    scalars, ``value``. One native expression works out ``depth`` levels of all documents,
    :func:`_deep_values` what lies below them.
    """
    keep = [name for name in documents.columns if name != document]
    root, value = F.lit("$"), F.col(document)
    own = F.array(_node(root, value, F.lit(None).cast("variant")))
    found = documents.select(*keep, F.inline(F.concat(own, _below(value, root, depth))))
    found = materialize(found.withColumn("_key", F.monotonically_increasing_id()))
    deep = found.filter("rest is not null")
    top = found.drop("rest", "_key")
    if deep.isEmpty():
        return top
    values = _deep_values(deep.select("_key", F.col("rest").alias("_value"))).filter("path <> ''")
    named = values.select("_key", F.col("path").alias("_below"), _node(F.col("path"), F.try_parse_json(F.col("token")), F.lit(None).cast("variant")).alias("_node"))
    below = deep.select(*keep, "_key", "path").join(named, "_key")
    return top.unionByName(below.select(*keep, F.concat("path", "_below").alias("path"), "_node.kind", "_node.value"))


#: A JSON text as written without blanks between its tokens.
_TOKEN = r'"(?:[^"\\]|\\.)*+"|[\[\]{},:]|[^\[\]{},:"]++'


def _deep_values(rows: DataFrame) -> DataFrame:
    """All values inside of variants (_key, _value), the variants included, by windows over their tokens.

    Columns: _key, token (a scalar's text, ``{}`` or ``[]`` of containers), path, label (``name:`` or ``index:``),
    member (whether of an object), order (sorts values as the fingerprint lists them).

    What a token stands in is the last container opened at its level. Paths and orders
    are put together by doubling: in each round every value takes on its ancestor's
    stretch of steps and its ancestor's ancestor, so rounds grow with the logarithm of the depth.
    """
    tokens = F.posexplode(F.regexp_extract_all(F.to_json("_value"), F.lit(_TOKEN), F.lit(0))).alias("at", "token")
    opens, closes = F.col("token").isin("{", "["), F.col("token").isin("}", "]")
    in_text = Window.partitionBy("_key").orderBy("at")
    after = F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(in_text)
    placed = rows.select("_key", tokens).withColumn("after", after)
    # an opening token stands in its container's parent and begins the container
    level = F.when(opens, F.array(F.col("after") - 1, F.col("after"))).when(closes, F.array(F.col("after") + 1)).otherwise(F.array("after"))
    roles = placed.select("_key", "at", "token", F.posexplode(level).alias("role", "level"))
    begins = F.col("role") == 1
    of_level = Window.partitionBy("_key", "level").orderBy("at", "role")
    inside = F.last(F.when(begins, F.struct(F.col("at").alias("at"), (F.col("token") == "{").alias("named"))), ignorenulls=True).over(of_level)
    roles = roles.withColumn("box", inside).filter(~begins)
    of_box = Window.partitionBy("_key", "box.at").orderBy("at")
    number = F.count_if(F.col("token") == ",").over(of_box)
    colon = F.lag("token").over(of_box) == ":"
    name = F.lag("token", 2).over(of_box)
    numbered = roles.select("*", number.alias("number"), F.coalesce(colon, F.lit(False)).alias("behind_colon"), name.alias("name"))
    named = F.coalesce("box.named", F.lit(False))
    is_value = F.when(named, F.col("behind_colon")).otherwise(~F.col("token").isin(",", "}", "]"))
    name = F.try_parse_json("name").cast("string")
    values = numbered.filter(is_value).select(
        "_key", "at", F.col("box.at").alias("up"), named.alias("member"),
        F.when(opens, F.when(F.col("token") == "{", "{}").otherwise("[]")).otherwise(F.col("token")).alias("token"),
        F.when(F.col("box").isNotNull(), F.when(named, name).otherwise(F.col("number").cast("string"))).alias("name"), "number",
    )
    siblings = Window.partitionBy("_key", "up").orderBy(F.when(F.col("member"), F.col("name")), "number")
    rank = F.lpad(F.hex(F.row_number().over(siblings)), 8, "0")
    step = F.when(F.col("member"), F.concat(F.lit("."), "name")).otherwise(F.concat(F.lit("["), "name", F.lit("]")))
    values = values.select(
        "_key", "at", "up", "member", "token", F.coalesce(F.concat("name", F.lit(":")), F.lit("")).alias("label"),
        F.coalesce(step, F.lit("")).alias("path"), F.when(F.col("up").isNull(), "").otherwise(rank).alias("order"),
    )
    values = materialize(values)
    while not values.filter("up is not null").isEmpty():
        above = values.select("_key", F.col("at").alias("up"), F.col("up").alias("_up"), F.col("path").alias("_path"), F.col("order").alias("_order"))
        joined = values.join(above, ["_key", "up"], "left")
        values = materialize(joined.select(
            "_key", "at", F.col("_up").alias("up"), "member", "token", "label",
            F.concat(F.coalesce("_path", F.lit("")), "path").alias("path"), F.concat(F.coalesce("_order", F.lit("")), "order").alias("order"),
        ))
    return values
