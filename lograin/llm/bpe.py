"""Byte-level BPE encoding and decoding by a monoid tree reduction.

Encodings of byte strings form a monoid under :meth:`TreeEncoder.join`. A string is cut
in half until short leaves are left, then neighbours are joined up the tree. Joining
encodes a window of tokens at the seam anew and lets it grow until the tokens next to
its ends are stable: a sequence is the encoding of its bytes exactly if every two
neighbours are, taken by themselves, encoded as these two tokens. So only the pairs
at the window's ends have to be tested, never the whole string. Decoding joins token
bytes up the same kind of tree.

A text is first cut into the matches of the pretokenizer, each encoded on its own. Long
texts are matched by halves, too: matching depends on nothing before a match, so
the matches of the right half hold from the first start on that both sides share.

Short strings are leaves. Those that a task meets for the first time are merged together,
a column of arrays for each place in them, one merge of every string at a time.

Spark deals the texts; a task keeps a bounded cache of encoded chunks, ids packed to bytes.

Defined cases: a null text is empty; an empty text has no ids, and both its hashes
are those of empty strings; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lograin.llm.chunks import ChunkCache, keep_garbage

#: Characters matched in one go and bytes merged in one go; what is longer is halved.
LEAF_CHARS = 1 << 16
LEAF_BYTES = 12
NEVER = 1 << 62
#: Strings of at most so many bytes are merged together, those of similar length at a time.
WIDTHS = (8, 12, 16, 24, 32)
UNPAIRED = np.iinfo(np.int32).max
#: Encoded strings that a worker remembers, and the longest of them; they share halves.
KNOWN, KNOWN_BYTES = 300_000, 32
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def packed_type(ranks: dict[bytes, int]) -> str:
    """Type code of packed ids."""
    return "H" if max(ranks.values(), default=0) < 1 << 16 else "I"


class Merger:
    """Merges many short strings at a time."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = max(ranks.values(), default=0) + 1
        self.packed = np.dtype(packed_type(ranks))
        self.bytes = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for at in range(1, len(token)):
                left, right = ranks.get(token[:at]), ranks.get(token[at:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = rank
        # a hash table with as many rounds of probing as its fullest run needs
        self.mask = (1 << max(4, (4 * len(pairs)).bit_length())) - 1
        self.keys, self.values = np.full(self.mask + 1, -1, np.int64), np.full(self.mask + 1, UNPAIRED, np.int32)
        keys, values = np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs))
        place, self.probes = self._place(keys), 0
        while len(keys):
            self.probes += 1
            free = self.keys[place] < 0
            self.keys[place[free]], self.values[place[free]] = keys[free], values[free]
            left = self.keys[place] != keys  # of several at one place, one has got it
            keys, values, place = keys[left], values[left], (place[left] + 1) & self.mask

    def _place(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys * np.int64(0x9E3779B97F4A7C1)
        return (mixed ^ (mixed >> 32)) & self.mask

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of tokens, UNPAIRED where they don't merge; a token of -1 is none."""
        keys = np.where((left < 0) | (right < 0), -2, left.astype(np.int64) * self.size + right)
        place = self._place(keys)
        out = np.where(self.keys[place] == keys, self.values[place], UNPAIRED)
        open_ = np.flatnonzero((self.keys[place] != keys) & (self.keys[place] >= 0) & (keys >= 0))
        for _ in range(1, self.probes):
            if not len(open_):
                break
            place[open_] = (place[open_] + 1) & self.mask
            met = self.keys[place[open_]]
            hit = met == keys[open_]
            out[open_[hit]] = self.values[place[open_[hit]]]
            open_ = open_[~hit & (met >= 0)]
        return out

    def merge(self, strings: list[bytes]) -> dict[bytes, bytes]:
        """The packed ids of each string, none of which is longer than the last of WIDTHS."""
        out: dict[bytes, bytes] = {}
        low = -1
        for width in WIDTHS:
            chosen = [s for s in strings if low < len(s) <= width]
            low = width
            for start in range(0, len(chosen), 1 << 14):
                part = chosen[start : start + (1 << 14)]
                tokens, counts = self._merge(part, width)
                packed = tokens.astype(self.packed).tobytes()
                step = width * self.packed.itemsize
                stops = (np.arange(len(part)) * step + counts * self.packed.itemsize).tolist()
                out.update(zip(part, map(packed.__getitem__, map(slice, range(0, len(packed), step), stops))))
        return out

    def _merge(self, strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """A row of tokens for each string, and how many of them there are."""
        lengths = np.fromiter(map(len, strings), np.int64, len(strings))
        codes = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(-1, width)
        columns = np.arange(width)
        tokens = np.where(columns < lengths[:, None], self.bytes[codes], -1)
        ranks = self._ranks(tokens[:, :-1].ravel(), tokens[:, 1:].ravel()).reshape(-1, width - 1)
        ranks = np.hstack([ranks, np.full((len(ranks), 1), UNPAIRED, np.int32)])
        left = lengths.copy()
        rows = np.arange(len(tokens))
        while len(rows):
            own_tokens, own_ranks = tokens[rows], ranks[rows]
            every = np.arange(len(rows))
            at = own_ranks.argmin(axis=1)
            best = own_ranks[every, at]
            going = best != UNPAIRED
            if not going.all():
                rows, own_tokens, own_ranks, at, best = rows[going], own_tokens[going], own_ranks[going], at[going], best[going]
                every = np.arange(len(rows))
            if not len(rows):
                break
            # the right one of the pair goes, all behind it moves up
            source = np.minimum(columns + (columns > at[:, None]), width - 1)
            own_tokens = np.take_along_axis(own_tokens, source, axis=1)
            own_ranks = np.take_along_axis(own_ranks, source, axis=1)
            own_tokens[:, -1], own_ranks[:, -1] = -1, UNPAIRED
            own_tokens[every, at] = best
            before, behind = np.maximum(at - 1, 0), np.minimum(at + 1, width - 1)
            own_ranks[every, before] = np.where(at > 0, self._ranks(own_tokens[every, before], best), own_ranks[every, before])
            own_ranks[every, at] = np.where(at + 1 < width, self._ranks(best, own_tokens[every, behind]), UNPAIRED)
            tokens[rows], ranks[rows] = own_tokens, own_ranks
            left[rows] -= 1
        return tokens, left


class TreeEncoder:
    """Encoder for one set of ranks (token bytes -> id, lower merges first)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.names = {rank: str(rank) for rank in self.tokens}
        self.pattern = regex.compile(pattern)
        self._stable: dict[tuple[int, int], bool] = {}
        self._known: dict[bytes, list[int]] = {}

    # Byte strings

    def merge(self, data: bytes) -> list[int]:
        """Apply the merges to a whole string, lowest rank and leftmost first."""
        if len(data) > 256:
            return self._merge_long(data)
        rank, size = self.ranks.get, len(data)
        cuts = list(range(size + 1))
        pairs = [rank(data[i : i + 2], NEVER) for i in range(size - 1)]
        while pairs:
            best = min(pairs)
            if best == NEVER:
                break
            at = pairs.index(best)
            del cuts[at + 1], pairs[at]
            if at:
                pairs[at - 1] = rank(data[cuts[at - 1] : cuts[at + 1]], NEVER)
            if at < len(pairs):
                pairs[at] = rank(data[cuts[at] : cuts[at + 2]], NEVER)
        return [self.ranks[data[a:b]] for a, b in zip(cuts, cuts[1:])]

    def _merge_long(self, data: bytes) -> list[int]:
        """The same with a heap of pairs, for windows that had to grow far."""
        rank, size = self.ranks.get, len(data)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        heap = [(r, i, i + 1, i + 2) for i in range(size - 1) if (r := rank(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        live = bytearray(b"\1" * size)
        while heap:
            _, start, middle, end = heapq.heappop(heap)
            if not live[start] or after[start] != middle or middle >= size or after[middle] != end:
                continue
            live[middle], after[start] = 0, end
            if end < size:
                before[end] = start
                if (r := rank(data[start : after[end]])) is not None:
                    heapq.heappush(heap, (r, start, end, after[end]))
            if (left := before[start]) >= 0 and (r := rank(data[left:end])) is not None:
                heapq.heappush(heap, (r, left, start, end))
        starts = [i for i in range(size) if live[i]]
        return [self.ranks[data[i : after[i]]] for i in starts]

    def stable(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are when their bytes meet."""
        known = self._stable.get((left, right))
        if known is None:
            if len(self._stable) > 1 << 18:
                self._stable.clear()
            known = self.merge(self.tokens[left] + self.tokens[right]) == [left, right]
            self._stable[left, right] = known
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of two neighbouring encodings."""
        if not left or not right:
            return left or right
        if self.stable(left[-1], right[0]):
            return left + right
        back = ahead = 1
        while True:
            window = self.merge(b"".join(map(self.tokens.__getitem__, left[len(left) - back :] + right[:ahead])))
            grow_left = back < len(left) and not self.stable(left[-back - 1], window[0])
            grow_right = ahead < len(right) and not self.stable(window[-1], right[ahead])
            if not grow_left and not grow_right:
                return left[: len(left) - back] + window + right[ahead:]
            back = min(len(left), back + back * grow_left)
            ahead = min(len(right), ahead + ahead * grow_right)

    def encode_bytes(self, data: bytes) -> list[int]:
        if len(data) > KNOWN_BYTES:
            half = len(data) // 2
            return self.join(self.encode_bytes(data[:half]), self.encode_bytes(data[half:]))
        found = self._known.get(data)
        if found is None:
            if len(data) <= LEAF_BYTES:
                found = self.merge(data)
            else:
                half = len(data) // 2
                found = self.join(self.encode_bytes(data[:half]), self.encode_bytes(data[half:]))
            if len(self._known) > KNOWN:
                self._known.clear()
            self._known[data] = found
        return found

    def encode_match(self, match: str) -> list[int]:
        data = match.encode()
        whole = self.ranks.get(data)
        return self.encode_bytes(data) if whole is None else [whole]

    # Texts

    def matches(self, text: str) -> list[str]:
        """All matches of the pretokenizer."""
        letters = text[1:] if text[:1] == " " else text
        if letters.isalpha():
            return [text]
        if text[-1:] in (".", ",") and letters[:-1].isalpha():
            return [text[:-1], text[-1]]  # a stop after a word is a match of its own
        if len(text) <= LEAF_CHARS:
            return self.pattern.findall(text)
        return [text[a:b] for a, b in self._spans(text, 0, len(text))]

    def _spans(self, text: str, start: int, end: int) -> list[tuple[int, int]]:
        if end - start <= LEAF_CHARS:
            spans = (m.span() for m in self.pattern.finditer(text[start:end]))
            return [(a + start, b + start) for a, b in spans]
        seam = (start + end) // 2
        left, right = self._spans(text, start, seam), self._spans(text, seam, end)
        # a match that ends two characters before the seam has seen all it depends on
        while left and left[-1][1] > seam - 2:
            left.pop()
        starts = {a: i for i, (a, _) in enumerate(right)}
        at = left[-1][1] if left else start
        while at < end and at not in starts:
            found = self.pattern.match(text, at, end)
            left.append(found.span())
            at = found.end()
        return left + right[starts[at] :] if at < end else left

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.encode_match(m) for m in self.matches(text)))

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of the ids, joined up a tree."""
        if len(ids) <= 4096:
            return b"".join(map(self.tokens.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def text_slices(batch: pa.RecordBatch, column: str, most: int = 1 << 22) -> Iterator[tuple[int, list[str]]]:
    """Slices of a batch of about ``most`` characters: first row, texts."""
    texts, start, held = [], 0, 0
    for i, value in enumerate(batch.column(column)):
        text = value.as_py() or ""
        texts.append(text)
        held += len(text)
        if held >= most:
            yield start, texts
            texts, start, held = [], i + 1, 0
    if texts:
        yield start, texts


#: Encoder and bounded cache of this Python worker, kept from task to task.
_WORKER: dict[tuple[str, str], tuple[TreeEncoder, ChunkCache]] = {}


def _cached(encoder: TreeEncoder) -> tuple[TreeEncoder, ChunkCache]:
    merger, kind = Merger(encoder.ranks), packed_type(encoder.ranks)

    def encode(parts: list[str]) -> Iterator[bytes]:
        """Packed ids of each part."""
        matches = [encoder.matches(part) for part in parts]
        fresh = {m: m.encode() for m in set(chain.from_iterable(matches))}
        leaves = [data for data in fresh.values() if len(data) <= WIDTHS[-1] and data not in encoder.ranks]
        merged = merger.merge(leaves)
        known = {m: merged[data] if data in merged else array(kind, encoder.encode_match(m)).tobytes() for m, data in fresh.items()}
        return (known[found[0]] if len(found) == 1 else b"".join([known[m] for m in found]) for found in matches)

    return encoder, ChunkCache(encode)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, ids: bool = False) -> DataFrame:
    """Encode whole texts and decode the ids.

    Columns: doc_id, n_tokens, ids_sha256 (of decimal ids joined by spaces), decoded_sha256,
    and with ``ids`` the ids themselves as array<int>.
    """
    ranks, own = load_ranks(ranks_path), (ranks_path, pattern)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    if ids:
        schema = schema.append(pa.field("ids", pa.list_(pa.int32())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if own not in _WORKER:
            keep_garbage()
            _WORKER.clear()
            _WORKER[own] = _cached(TreeEncoder(ranks, pattern))
        encoder, cache = _WORKER[own]
        kind, names = packed_type(ranks), encoder.names
        for batch in batches:
            keys = batch.column("doc_id")
            for start, texts in text_slices(batch, "text"):
                rows: list[list] = [[], [], [], []]
                for values in cache.values_of(texts):
                    found = array(kind, b"".join(values)).tolist()
                    rows[0].append(len(found))
                    rows[1].append(hashlib.sha256(" ".join(map(names.__getitem__, found)).encode()).hexdigest())
                    rows[2].append(hashlib.sha256(encoder.decode(found)).hexdigest())
                    if ids:
                        rows[3].append(found)
                columns = [keys.slice(start, len(texts)), *map(pa.array, rows[:3])]
                if ids:
                    columns.append(pa.array(rows[3], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    named = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    return named.mapInArrow(run, RESULT + (", ids array<int>" if ids else ""))
