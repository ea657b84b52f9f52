"""Pieces of a text that no pretokenizer match crosses, so that each can be encoded on its own.

The pretokenizer's pattern starts a new match wherever white space follows a character
that isn't white space: only its white-space alternatives and a leading space reach
over white space, and they begin there. A chunk is a run of spaces and line feeds with the
characters up to the next run. Texts with any other white space are one chunk.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNKS = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
OTHER_SPACE = re.compile(r"[^\S \n]")
#: The same for Arrow's expressions, and the zero byte, which marks where a chunk begins.
UNCUT = r"[\x00\t\v\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Letters in every version of Unicode; a stop that may be part of a longer match.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
LONE_STOP = rf"(?:^|[^{LETTERS}0-9])[.,]"


def keep_garbage() -> None:
    """Let a worker look for cyclic garbage rarely: its caches hold millions of strings and no cycles."""
    gc.set_threshold(2_000_000, 50, 50)


def chunks(text: str) -> list[str]:
    return [text] if OTHER_SPACE.search(text) else CHUNKS.findall(text)


def _keys(text: str) -> list[str] | None:
    """Keys of a text whose words are parted by single spaces or line feeds, else None.

    A key stands for itself after a space; one that begins with a line feed or a zero
    byte stands for its chunk as it is (without the zero byte).
    """
    if not text or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n" or "\0" in text:
        return None
    keys = text.replace("\n", " \n").split(" ")
    keys[0] = "\0" + keys[0]
    return keys


def _chunk(key: str) -> str:
    return key[1:] if key[0] == "\0" else key if key[0] == "\n" else " " + key


class ChunkCache(dict):
    """Encoded chunks by key, at most about ``limit`` of them and none of over ``longest`` characters.

    ``encode`` maps a list of chunks to their values. Half of the memory is for the chunks of
    late; when it is full it takes the place of the other half, from which chunks that are met
    again come back. So frequent chunks stay whatever the vocabulary of the input.
    """

    def __init__(self, encode: Callable[[list[str]], Iterable], limit: int = 1_000_000, longest: int = 64):
        super().__init__()
        self.encode, self.limit, self.longest = encode, limit, longest
        self.earlier: dict = {}

    def values_of(self, texts: list[str]) -> list[Iterable]:
        """The values of each text's chunks, in order; to be read once."""
        if len(self) > self.limit // 2:
            self.earlier = dict(self)
            self.clear()
        split = [_keys(text) for text in texts]
        fresh = [k for k in set().union(*filter(None, split)) if k not in self]
        if self.earlier:
            again = {k: self.earlier[k] for k in fresh if k in self.earlier}
            self.update(again)
            fresh = [k for k in fresh if k not in again]
        other = {k for k in fresh if OTHER_SPACE.search(k)}
        fresh = [k for k in fresh if k not in other]
        more = dict(zip(fresh, self.encode(list(map(_chunk, fresh))))) if fresh else {}
        long = {k: v for k, v in more.items() if len(k) > self.longest}
        self.update(more)
        found = [
            self.encode(chunks(text)) if keys is None or other and not other.isdisjoint(keys) else map(self.__getitem__, keys)
            for keys, text in zip(split, texts)
        ]
        if long:
            found = list(map(list, found))
            for key in long:
                del self[key]
        return found


class ColumnCache(dict):
    """Values of whole Arrow columns of texts: each different chunk of a column is looked up once.

    Values are bytes; those of a text are joined. ``encode`` maps chunks to values, ``whole`` a text
    that can't be cut. Chunks that a column holds more than once are remembered, as many as :class:`ChunkCache` does.
    """

    def __init__(self, encode: Callable, whole: Callable, limit: int = 1_000_000, longest: int = 64):
        super().__init__()
        self.encode, self.whole, self.limit, self.longest = encode, whole, limit, longest
        self.earlier: dict = {}

    def _values(self, keys: list[str], counts: np.ndarray) -> list[bytes]:
        if len(self) > self.limit // 2:
            self.earlier = dict(self)
            self.clear()
        found = list(map(self.get, keys))
        if self.earlier:
            found = [self.earlier.get(key) if value is None else value for key, value in zip(keys, found)]
        fresh = [key for key, value in zip(keys, found) if value is None]
        more = self.encode(fresh)
        values = [next(more) if value is None else value for value in found]
        often = np.flatnonzero(counts > 1).tolist()
        self.update((keys[i], values[i]) for i in often if len(keys[i]) <= self.longest)
        return values

    def values_of(self, texts: pa.Array, end: bytes = b"") -> pa.Array:
        """The value of each text, followed by ``end``; a null text is empty."""
        texts = texts.cast(pa.string()).fill_null("")
        uncut = pc.match_substring_regex(texts, UNCUT)
        split = pc.split_pattern(_marked(pc.if_else(uncut, "", texts)), "\0")
        stops, coded = split.offsets.to_numpy(), split.values.dictionary_encode()
        del split
        every = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)
        keys, order = pc.binary_join(every, "\0")[0].as_py().split("\0"), coded.indices.to_numpy()
        values = [*self._values(keys, np.bincount(order)), end]
        order = np.insert(order, stops[1:], len(keys))
        firsts = stops + np.arange(len(stops), dtype=stops.dtype)
        for row in np.flatnonzero(uncut.to_numpy(zero_copy_only=False)).tolist():
            order[firsts[row]] = len(values)
            values.append(self.whole(texts[row].as_py()))
        joined = pa.array(values, pa.binary()).take(pa.array(order))
        _, offsets, data = joined.buffers()
        own = np.frombuffer(offsets, np.int32)[firsts]
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(own), data])


def _marked(texts: pa.Array) -> pa.Array:
    """Texts with a zero byte before each chunk but the first; stops that follow letters or digits begin one, too."""
    marked = pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n")
    runs = pc.match_substring_regex(texts, r"[ \n]{2}")
    if pc.any(runs).as_py():
        marked = pc.if_else(runs, pc.replace_substring_regex(pc.if_else(runs, texts, ""), r"[ \n]+", "\0\\0"), marked)
    odd = pc.match_substring_regex(texts, LONE_STOP)
    cut = pc.replace_substring(pc.replace_substring(marked, ".", "\0."), ",", "\0,")
    return pc.if_else(odd, marked, cut) if pc.any(odd).as_py() else cut


def column_slices(column: pa.Array, most: int = 1 << 24) -> Iterable[tuple[int, pa.Array]]:
    """Slices of a column of texts of about ``most`` bytes: first row, texts."""
    ends = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(column):
        before = ends[start - 1] if start else 0
        stop = min(len(column), int(np.searchsorted(ends, before + most)) + 1)
        yield start, column.slice(start, stop - start)
        start = stop
