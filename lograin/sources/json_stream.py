"""JSON files of any size and layout, cut into documents in parallel.

A file is a sequence of JSON values, laid out on lines or not. It is read in pieces that end
at a separator byte, wherever the splits of the file fall, and pieces are put together to
chunks of bounded size. What stands at the beginning of a chunk depends on everything
before it, but only through a state of three parts: inside a string or not, the nesting
depth, and the kind of the outermost open container. A chunk's effect on that state
is a few numbers for each of the two string states it may begin in:

* whether it holds an odd number of quotes,
* by how much the depth changes, and the lowest depth it comes to,
* the container opened last at that lowest depth.

Effects compose by running sums over the chunks of a file, one narrow row per chunk. Knowing
its state, every chunk is cut on its own: outermost objects are documents, and so is every
element of an outermost array, which may be as long as the file. Only documents
that lie across chunks are stitched together.

A separator can't follow an escaping backslash, as JSON has no such escape; ``}`` keeps
pieces small except in files that hold none for very long: take ``,`` there.

Files are read without decoding, so bytes that are no UTF-8 end up as a fault of their document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lograin.session import materialize

CHUNK_BYTES = 4 << 20
QUOTE, COMMA = ord('"'), ord(",")
OPENING, CLOSING = b"[{", b"]}"
BLANK = b" \t\r\n"
BOM = 3  # bytes of a mark that the reader drops from the beginning of a file

_WEIGHT = np.zeros(256, np.int64)
_WEIGHT[list(OPENING)], _WEIGHT[list(CLOSING)] = 1, -1
_SPECIAL = _WEIGHT != 0
_SPECIAL[[QUOTE, COMMA]] = True

PLACE = ["file_path", "block", "chunk"]
_EFFECT = [f"{name}{state}" for state in (0, 1) for name in ("depth", "lowest", "kind")]
_CHUNKS = (
    "file_path string, block long, chunk int, file_size long, size long, data binary, odd int, "
    "depth0 long, lowest0 long, kind0 int, depth1 long, lowest1 long, kind1 int"
)
_PARTS = "file_path string, block long, chunk int, unit int, opens boolean, closes boolean, role string, text binary, broken boolean"


def _specials(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of quotes, commas and brackets; escaped quotes are none."""
    plain = data.replace(b"\\\\", b"__").replace(b'\\"', b"__")
    codes = np.frombuffer(plain, np.uint8)
    at = np.flatnonzero(_SPECIAL[codes])
    return at, codes[at]


def _outside(codes: np.ndarray, inside: int) -> np.ndarray:
    """Which specials stand outside of strings; quotes don't."""
    quotes = codes == QUOTE
    return ~quotes & ((np.cumsum(quotes) + inside) % 2 == 0)


def effect(data: bytes) -> tuple[int, ...]:
    """odd, then for both string states at the beginning: change of depth, lowest depth, container opened last there (or 0)."""
    _, codes = _specials(data)
    out = [int(np.count_nonzero(codes == QUOTE) % 2)]
    for inside in (0, 1):
        brackets = codes[_outside(codes, inside) & (codes != COMMA)]
        depth = np.concatenate([[0], np.cumsum(_WEIGHT[brackets])])
        lowest = int(depth.min())
        last = int(np.flatnonzero(depth == lowest)[-1])
        out += [int(depth[-1]), lowest, int(brackets[last]) if last < len(brackets) else 0]
    return tuple(out)


def _chunked(separator: bytes, limit: int):
    """Pieces in the order of their file -> chunks with their effects."""
    names = [field.split()[0] for field in _CHUNKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, number, held, size = None, 0, [], 0

        def chunk() -> pa.RecordBatch:
            data = separator.join([*held, b""])
            row = (key[0], key[1], number, key[2], len(data), data, *effect(data))
            return pa.RecordBatch.from_pydict({n: [v] for n, v in zip(names, row)}, schema=_arrow(_CHUNKS))

        for batch in batches:
            paths, blocks, sizes, pieces = (batch.column(n) for n in ("file_path", "block", "file_size", "piece"))
            paths = paths.to_pylist()
            for own, piece in zip(zip(paths, blocks.to_pylist(), sizes.to_pylist()), pieces.to_pylist()):
                if held and (own != key or size >= limit):
                    yield chunk()
                    number, held, size = number + 1, [], 0
                if own != key:
                    key, number = own, 0
                held.append(piece)
                size += len(piece) + len(separator)
        if held:
            yield chunk()

    return run


def _arrow(ddl: str) -> pa.Schema:
    types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(name, types[kind]) for name, kind in (field.split() for field in ddl.split(", "))])


def chunks(
    spark: SparkSession, path: str | list[str], separator: str = "}", limit: int = CHUNK_BYTES, pattern: str | None = None
) -> DataFrame:
    """Chunks of all files below ``path``, or of those whose names follow a glob ``pattern``, with their effects on the state."""
    rows = spark.read.text(path, lineSep=separator, recursiveFileLookup=True, pathGlobFilter=pattern).select(
        F.col("value").cast("binary").alias("piece"), F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("file_size"),
    )
    return rows.mapInArrow(_chunked(separator.encode(), limit), _CHUNKS)


def entered(found: DataFrame) -> DataFrame:
    """Each chunk's state at its beginning (inside, depth, kind), and whether it ends its file and how.

    Windows run over one narrow row per chunk.
    """
    narrow = found.select(*PLACE, "file_size", "size", "odd", *_EFFECT)
    order = Window.partitionBy("file_path").orderBy("block", "chunk")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    inside = F.pmod(F.coalesce(F.sum("odd").over(before), F.lit(0)), F.lit(2)).cast("int")
    stated = narrow.withColumn("inside", inside)
    for name in ("depth", "lowest", "kind"):
        stated = stated.withColumn(name, F.when(F.col("inside") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1")))
    stated = stated.withColumn("depth_in", F.coalesce(F.sum("depth").over(before), F.lit(0)))
    # a chunk that comes down to no open container at all decides what is open after it
    opened = F.when(F.col("depth_in") + F.col("lowest") <= 0, F.col("kind"))
    stated = stated.withColumn("kind_in", F.coalesce(F.last(opened, ignorenulls=True).over(before), F.lit(0)))
    whole = Window.partitionBy("file_path")
    # the last piece of a file has no separator unless it stands in the file
    over = F.sum("size").over(whole) - F.col("file_size")
    last = F.lead("chunk").over(order).isNull()
    return stated.select(
        *PLACE, "inside", F.col("depth_in").alias("depth"), F.col("kind_in").alias("kind"),
        last.alias("last"), (last & over.isin(1, 1 - BOM)).alias("open_end"),
    )


@dataclass
class Cut:
    """Part of a document or of the text between outermost values, by bytes ``start`` to ``stop``."""

    start: int
    stop: int
    opens: bool  # the part has its beginning
    closes: bool  # and its end
    role: str  # value, first or later (elements of an array), between
    broken: bool = False


def cut(data: bytes, inside: int, depth: int, kind: int) -> Iterator[Cut]:
    """Parts of a chunk whose state at its beginning is known."""
    at, codes = _specials(data)
    outside = _outside(codes, inside)
    at, codes = at[outside], codes[outside]
    change = _WEIGHT[codes]
    after = depth + np.cumsum(change)
    # only these places can end or begin a part
    turning = (np.minimum(after, after - change) <= 0) | ((codes == COMMA) & (after == 1))
    start, opens = 0, False
    role = "between" if depth <= 0 else "value" if kind == ord("{") else "later"
    for place, code, level in zip(at[turning].tolist(), codes[turning].tolist(), after[turning].tolist()):
        if code == COMMA:
            if level == 1 and role in ("first", "later"):
                yield Cut(start, place, opens, True, role)
                start, opens, role = place + 1, True, "later"
        elif code in OPENING and level == 1:
            yield Cut(start, place, opens, True, "between")
            start, opens, role = (place, True, "value") if code == ord("{") else (place + 1, True, "first")
        elif code in CLOSING and level == 0:
            if role == "value":
                yield Cut(start, place + 1, opens, True, role, code != ord("}"))
            else:
                # an element that ends the array; empty ones are judged when they are whole
                yield Cut(start, place, opens, True, f"{role}-last", code != ord("]"))
            start, opens, role = place + 1, True, "between"
        elif level < 0:
            yield Cut(start, place + 1, opens, True, "between", True)
            return
    yield Cut(start, len(data), opens, False, role)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [field.split()[0] for field in _PARTS.split(", ")]
    for batch in batches:
        for row in batch.to_pylist():
            data = row["data"][:-1] if row["open_end"] else row["data"]
            out = []
            for number, part in enumerate(cut(data, row["inside"], row["depth"], row["kind"])):
                opens = part.opens or not (row["block"] or row["chunk"] or number)
                closes = part.closes or row["last"]
                text = data[part.start : part.stop]
                broken = part.broken or (not part.closes and row["last"] and part.role != "between")
                if opens and closes and not broken and not text.strip(BLANK) and part.role in ("between", "first-last"):
                    continue
                out.append((row["file_path"], row["block"], row["chunk"], number, opens, closes, part.role, text, broken))
            if out:
                yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*out))), schema=_arrow(_PARTS))


def units(
    spark: SparkSession, path: str | list[str], separator: str = "}", limit: int = CHUNK_BYTES, pattern: str | None = None
) -> DataFrame:
    """(file_path, block, chunk, unit, role, text, broken): documents in the order of their file, and what stands between.

    ``block, chunk, unit`` are where a unit begins.
    """
    found = materialize(chunks(spark, path, separator, limit, pattern), "zstd")
    states = materialize(entered(found))
    parts = materialize(found.select(*PLACE, "data").join(states, PLACE).mapInArrow(_parts, _PARTS), "zstd")
    whole = parts.filter("opens and closes").select(*PLACE, "unit", "role", "text", "broken")
    pieces = parts.filter("not (opens and closes)")
    # a part without a beginning belongs to the last one before it that has no end
    order = Window.partitionBy("file_path").orderBy("block", "chunk", "unit")
    begun = F.last(F.when(F.col("opens"), F.struct("block", "chunk", "unit")), ignorenulls=True).over(order)
    homes = materialize(pieces.select(*PLACE, "unit", "opens").withColumn("home", begun).drop("opens"))
    role = F.max_by("role", F.struct("block", "chunk", "unit"))  # that of the end, ...
    first = F.min_by("role", F.struct("block", "chunk", "unit"))  # ... but the beginning knows whether it is the first
    joined = pieces.join(homes, [*PLACE, "unit"]).groupBy("file_path", "home").agg(
        F.sort_array(F.collect_list(F.struct("block", "chunk", "unit", "text"))).alias("texts"),
        F.bool_or("broken").alias("broken"), role.alias("role"), first.alias("begin"),
    )
    text = F.aggregate("texts", F.lit(b""), lambda done, part: F.concat(done, part["text"]))
    role = F.when(F.col("begin") == "first", F.regexp_replace("role", "later", "first")).otherwise(F.col("role"))
    stitched = joined.select("file_path", "home.*", role.alias("role"), text.alias("text"), "broken")
    return whole.unionByName(stitched.select(*whole.columns))


def stream_values(
    spark: SparkSession, path: str | list[str], separator: str = "}", limit: int = CHUNK_BYTES, pattern: str | None = None
) -> DataFrame:
    """Documents of JSON files with their place, as ``value``; what is none has its text in ``rejected`` and a ``fault``.

    A document is an outermost object or an element of an outermost array. Other outermost
    values hold none and only show up if they are no JSON.
    """
    text = F.try_validate_utf8(F.col("text").cast("string"))
    found = units(spark, path, separator, limit, pattern).withColumn("body", text)
    blank = F.coalesce(F.btrim("body", F.lit(BLANK.decode())) == "", F.lit(False))
    # an array may be empty, but an element may not
    found = found.filter(~(blank & ~F.col("broken") & F.col("role").isin("between", "first-last")))

    def listed(text: Column) -> Column:
        """Parsed inside of brackets, as the parser looks at nothing behind the first value."""
        return F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).cast("array<variant>")

    # outermost scalars may follow each other with blanks between; they hold no document
    tokens = F.regexp_extract_all("body", F.lit(r'"(?:[^"\\]|\\.)*+"|[^ \t\r\n"]++|"'), F.lit(0))
    scalars = F.size(listed(F.array_join("tokens", ","))) == F.size("tokens")
    between = F.col("role") == "between"
    found = found.withColumn("tokens", F.when(between, tokens)).withColumn("listed", F.when(~between & ~F.col("broken"), listed(F.col("body"))))
    fine = F.when(between, ~F.col("broken") & scalars).otherwise(F.size("listed") == 1)
    fault = F.when(~F.coalesce(fine, F.lit(False)), "malformed")
    value = F.get("listed", F.lit(0))
    shown = F.when(fault.isNotNull(), F.coalesce("body", F.base64("text")))
    named = found.select(*PLACE, "unit", value.alias("value"), shown.alias("rejected"), fault.alias("fault"))
    return named.filter("value is not null or fault is not null")


def stream_documents(
    spark: SparkSession, path: str | list[str], strict: bool = True, separator: str = "}", limit: int = CHUNK_BYTES, pattern: str | None = None
) -> DataFrame:
    """``document`` of each file's values; what is no JSON fails the job, or is left to :func:`stream_values`."""
    values = stream_values(spark, path, separator, limit, pattern)
    document = F.col("value")
    if strict:
        message = F.concat(F.lit("not JSON in "), "file_path", F.lit(": "), F.substring("rejected", 1, 200))
        document = F.when(F.col("fault").isNotNull(), F.raise_error(message).cast("variant")).otherwise(document)
    else:
        values = values.filter("fault is null")
    return values.select(*PLACE, "unit", document.alias("document"))
