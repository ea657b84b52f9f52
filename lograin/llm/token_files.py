"""Token ids in block files, compressed by rANS with one shared frequency table.

``write`` encodes texts, orders documents by id and stores their ids as one stream: a
folder ``blocks`` (Parquet container, one row per block) and a folder ``table`` (one
row per id that occurs, its frequency). A block holds up to 65,536 ids in
interleaved lanes, checkpoints and checksums for each 16,384 of them, and the
pieces of documents that lie in it. ``read`` decodes blocks anywhere, in any
order; only (document, count, checksum) rows meet again afterwards.

Documents go to ranges of ids (shards) by quantiles of the id column, so the text is
encoded once and only ids are shuffled. A shard is one sorted stream through a
task, never held whole.

Strings of added tokens in a text become their ids, as the tokenizers library has it by default.

Defined cases: a null text is empty, such a document consists of the end id alone; null
ids come last; rows repeating an id stand next to each other, ordered by their token
ids; an empty table gives empty files; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from codecs import charmap_decode
from collections.abc import Iterable, Iterator
from itertools import accumulate, chain, compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from lograin.llm import rans
from lograin.llm.chunks import LETTERS, ColumnCache, column_slices, keep_garbage
from lograin.session import materialize

SHARD_BYTES = 8 << 20
MIN_SHARDS, MAX_SHARDS = 32, 100_000
BLOCKS_AT_ONCE = 48
PIECES = [("piece_doc", pa.list_(pa.int64())), ("piece_seq", pa.list_(pa.int64())), ("piece_n", pa.list_(pa.int32()))]
PIECES_SQL = "piece_doc array<long>, piece_seq array<long>, piece_n array<int>"
RAW = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n", pa.int32()), ("ids", pa.binary()), *PIECES])
RAW_SQL = f"shard int, block int, first long, n int, ids binary, {PIECES_SQL}"
FILE = pa.schema(
    [("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n", pa.int32()), ("states", pa.binary()),
     ("places", pa.list_(pa.int32())), ("checks", pa.list_(pa.int64())), ("words", pa.binary()), *PIECES]
)
FILE_SQL = f"shard int, block int, first long, n int, states binary, places array<int>, checks array<long>, words binary, {PIECES_SQL}"

#: The pretokenizer's matches in chunks of ASCII and Latin letters.
LATIN = re.compile(rf"[\x00-\x7f{LETTERS}]*")
MATCHES = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^ \n{LETTERS}0-9]+|[ \n]+(?![^ \n])|[ \n]+"
)


#: Tokenizer cache of this Python worker, kept from task to task.
_WORKER: dict[int, ColumnCache | Words] = {}


def _width(definition: str) -> str:
    """Type of the ids on their way to the blocks."""
    from tokenizers import Tokenizer

    return "H" if Tokenizer.from_str(definition).get_vocab_size() <= 1 << 16 else "I"


def _known_kind(definition: str, contents: list[str]) -> bool:
    """Whether texts may be cut into chunks and their words sent to the model: byte-level BPE, nothing else applied."""
    parts = json.loads(definition)
    first, model = parts.get("pre_tokenizer") or {}, parts["model"]
    return (
        not any(parts.get(name) for name in ("normalizer", "truncation", "padding"))
        and first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space", True)
        and model.get("type") == "BPE" and not model.get("dropout")
        and not any(token[flag] for token in parts.get("added_tokens") or [] for flag in ("single_word", "lstrip", "rstrip"))
        and not any(re.search(r"\s", content) or re.fullmatch(r"\w+[.,]?", content) for content in contents)
    )


def _byte_letters() -> str:
    """The character that stands for each byte in a byte-level vocabulary."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return "".join(chr(b if b in kept else next(others)) for b in range(256))


class Words:
    """Packed ids of chunks of a text.

    Pretokenizing costs the library more than its merges do. So chunks of ASCII and Latin letters are
    matched here and its model gets each different match; all others go to the whole tokenizer.
    """

    def __init__(self, definition: str, width: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.width = Tokenizer.from_str(definition), width
        contents = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.known_kind, self.model = _known_kind(definition, contents), self.tokenizer.model
        self.added = re.compile("|".join(map(re.escape, contents)) or r"(?!)")
        self.letters = _byte_letters()

    def _packed(self, found: list[list[int]]) -> list[bytes]:
        packed, size = array(self.width, chain.from_iterable(found)).tobytes(), array(self.width).itemsize
        stops = [size * n for n in accumulate(map(len, found), initial=0)]
        return [packed[a:b] for a, b in zip(stops, stops[1:])]

    def whole(self, text: str) -> bytes:
        return self._packed([self.tokenizer.encode(text, add_special_tokens=False).ids])[0]

    def _model_ids(self, matches: Iterable[str]) -> list[bytes]:
        tokenize, letters = self.model.tokenize, self.letters
        return self._packed([[token.id for token in tokenize(charmap_decode(m.encode(), "strict", letters)[0])] for m in matches])

    def _library_ids(self, parts: list[str]) -> Iterator[bytes]:
        for start in range(0, len(parts), 20_000):
            yield from self._packed([x.ids for x in self.tokenizer.encode_batch_fast(parts[start : start + 20_000], add_special_tokens=False)])

    def encode(self, parts: list[str]) -> Iterator[bytes]:
        plain = [(p[1:] if p[:1] == " " else p).isalpha() and (p.isascii() or LATIN.fullmatch(p) is not None) for p in parts]
        words = iter(self._model_ids(compress(parts, plain)))
        others = self._mixed_ids([part for part, alone in zip(parts, plain) if not alone])
        return (next(words) if alone else next(others) for alone in plain)

    def _mixed_ids(self, parts: list[str]) -> Iterator[bytes]:
        """Ids of chunks of several matches, or of other letters."""
        matches = [MATCHES.findall(p) if (p.isascii() or LATIN.fullmatch(p)) and not self.added.search(p) else None for p in parts]
        fresh = list(set(chain.from_iterable(filter(None, matches))))
        known = dict(zip(fresh, self._model_ids(fresh)))
        uncut = self._library_ids([part for part, found in zip(parts, matches) if found is None])
        for found in matches:
            yield next(uncut) if found is None else b"".join(map(known.__getitem__, found))

    def values_of(self, texts: pa.Array, end: bytes) -> pa.Array:
        """Every text on its own, for tokenizers of another kind."""
        return pa.array([self.whole(text or "") + end for text in texts.to_pylist()], pa.binary())


def _cache(definition: str, width: str) -> ColumnCache | Words:
    key = zlib.crc32(definition.encode())
    if key not in _WORKER:
        words = Words(definition, width)
        keep_garbage()
        _WORKER.clear()
        _WORKER[key] = ColumnCache(words.encode, words.whole, limit=500_000) if words.known_kind else words
    return _WORKER[key]


def _tokens(docs: DataFrame, definition: str, width: str, end_id: int, bounds: list[int]) -> DataFrame:
    """(doc_id, shard, ids) of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("shard", pa.int32()), ("ids", pa.binary())])
    end, edges = array(width, [end_id]).tobytes(), np.asarray(bounds, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _cache(definition, width)
        for batch in batches:
            keys = batch.column("doc_id")
            for start, texts in column_slices(batch.column("text")):
                own = keys.slice(start, len(texts))
                ids = cache.values_of(texts, end)
                shard = np.searchsorted(edges, own.fill_null(0).to_numpy(), side="left").astype(np.int32)
                shard[own.is_null().to_numpy(zero_copy_only=False)] = len(edges)
                yield pa.RecordBatch.from_arrays([own, pa.array(shard), ids], schema=schema)

    return docs.mapInArrow(run, "doc_id long, shard int, ids binary")


def _cutter(width: str):
    """Cut sorted documents of a shard into blocks of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _cut(batches, width)

    return run


def _cut(batches: Iterator[pa.RecordBatch], width: str) -> Iterator[pa.RecordBatch]:
    shard, parts, pieces, held, block, first, seq = None, [], [], 0, 0, 0, 0
    rows: list[tuple] = []

    def close() -> None:
        nonlocal parts, pieces, held, block, first
        if held:
            doc, number, count = zip(*pieces)
            rows.append((shard, block, first, held, np.concatenate(parts).tobytes(), list(doc), list(number), list(count)))
            block, first = block + 1, first + held
        parts, pieces, held = [], [], 0

    for batch in batches:
        for doc, own, data in zip(batch.column("doc_id").to_pylist(), batch.column("shard").to_pylist(), batch.column("ids")):
            if own != shard:
                close()
                shard, block, first, seq = own, 0, 0, 0
            ids, at = np.frombuffer(data.as_buffer(), width), 0
            while at < len(ids):
                take = min(rans.BLOCK - held, len(ids) - at)
                parts.append(ids[at : at + take])
                pieces.append((doc, seq, take))
                held, at = held + take, at + take
                if held == rans.BLOCK:
                    close()
            seq += 1
        yield from _raw(rows)
        rows = []
    close()
    yield from _raw(rows)


def _raw(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for start in range(0, len(rows), BLOCKS_AT_ONCE):
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*rows[start : start + BLOCKS_AT_ONCE]), RAW)], schema=RAW
        )


def _counter(width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for data in batch.column("ids"):
                found = np.bincount(np.frombuffer(data.as_buffer(), width))
                if len(found) > len(total):
                    found[: len(total)] += total
                    total = found
                else:
                    total[: len(found)] += found
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], names=["id", "n"])

    return run


def _encoder(table: rans.Table, width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCKS_AT_ONCE):
                part = batch.slice(start, BLOCKS_AT_ONCE)
                blocks = rans.encode([np.frombuffer(x.as_buffer(), width) for x in part.column("ids")], table)
                columns = {name: part.column(name) for name in ("shard", "block", "first", "n", "piece_doc", "piece_seq", "piece_n")}
                columns |= {name: pa.array([getattr(b, name) for b in blocks], FILE.field(name).type) for name in ("states", "places", "checks", "words")}
                yield pa.RecordBatch.from_arrays([columns[name] for name in FILE.names], schema=FILE)

    return run


def _decoder(table: rans.Table):
    schema = pa.schema(
        [("shard", pa.int32()), ("seq", pa.int64()), ("doc_id", pa.int64()), ("first", pa.int64()), ("n", pa.int64()), ("crc", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = table.slots()
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCKS_AT_ONCE):
                part = batch.slice(start, BLOCKS_AT_ONCE)
                rows = part.to_pylist()
                blocks = [rans.Block(r["n"], r["states"], r["places"], r["checks"], r["words"]) for r in rows]
                found: list[tuple] = []
                for row, ids in zip(rows, rans.decode(blocks, table, slots)):
                    raw, at = ids.astype("<u4"), 0
                    for doc, seq, n in zip(row["piece_doc"], row["piece_seq"], row["piece_n"]):
                        found.append((row["shard"], seq, doc, row["first"] + at, n, zlib.crc32(raw[at : at + n].tobytes())))
                        at += n
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)

    return run


@F.pandas_udf(LongType())
def _joined(parts: pd.Series) -> pd.Series:
    """CRC-32 of a document from those of its pieces, in order."""

    def one(pieces) -> int:
        crc = pieces[0]["crc"]
        for piece in pieces[1:]:
            crc = rans.crc32_join(crc, piece["crc"], 4 * piece["n"])
        return crc

    return parts.map(one)


def write(docs: DataFrame, definition: str, path: str, end_id: int = 2) -> None:
    """Encode all texts with a tokenizer of the tokenizers library, given as its JSON text."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = min(max(MIN_SHARDS, -(-size // SHARD_BYTES)), MAX_SHARDS)
    cuts = F.array(*[F.lit(i / shards) for i in range(1, shards)])
    bounds = named.agg(F.percentile_approx("doc_id", cuts, max(10_000, 10 * shards))).first()[0] or []
    width = _width(definition)
    tokens = _tokens(named, definition, width, end_id, sorted(set(bounds)))
    ordered = tokens.repartition(shards, "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_last(), "ids")
    raw = materialize(ordered.mapInArrow(_cutter(width), RAW_SQL), "zstd")
    counts = raw.select("ids").mapInArrow(_counter(width), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    table = rans.Table.fit(counts["id"].to_numpy(np.int64), counts["n"].to_numpy(np.int64))
    spark = docs.sparkSession
    rows = list(zip(table.ids.tolist(), table.freq.astype(int).tolist()))
    spark.createDataFrame(rows, "id long, freq long").coalesce(1).write.parquet(f"{path}/table")
    raw.mapInArrow(_encoder(table, width), FILE_SQL).write.parquet(f"{path}/blocks", compression="uncompressed")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    freqs = spark.read.parquet(f"{path}/table").toPandas()
    table = rans.Table.of(freqs["id"].to_numpy(np.int64), freqs["freq"].to_numpy(np.int64))
    blocks = spark.read.parquet(f"{path}/blocks")
    pieces = blocks.mapInArrow(_decoder(table), "shard int, seq long, doc_id long, first long, n long, crc long")
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    bases = blocks.groupBy("shard").agg(F.sum("n").alias("n")).select("shard", F.coalesce(before, F.lit(0)).alias("base"))
    whole = pieces.groupBy("shard", "seq").agg(
        F.first("doc_id").alias("doc_id"), F.min("first").alias("first"), F.sum("n").alias("n_tokens"),
        F.sort_array(F.collect_list(F.struct("first", "n", "crc"))).alias("pieces"),
    )
    return whole.join(bases, "shard").select(
        "doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", _joined("pieces").alias("ids_crc32")
    )
