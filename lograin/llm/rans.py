"""Static range asymmetric numeral system (rANS) over interleaved lanes, in numpy.

One frequency table serves all blocks. Token ``i`` of a block belongs to lane
``i % LANES``; all lanes of all blocks of a call advance together. States stay in
[2^31, 2^63) and give off 32-bit words, which a block keeps in the order in which the
decoder takes them. Every ``CHECK`` steps a checkpoint holds the lanes' states and
the place in the words, so that each segment can be decoded by itself.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

LANES = 32
CHECK = 512
SEGMENT = LANES * CHECK
BLOCK = 4 * SEGMENT
PRECISION = 20
LOW = np.uint64(1 << 31)
U32, WORD = np.uint64(0xFFFFFFFF), np.uint64(32)


@dataclass(frozen=True)
class Table:
    """Frequencies of the ids, summing to 2^PRECISION."""

    ids: np.ndarray
    freq: np.ndarray
    cum: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, freq: np.ndarray) -> Table:
        order = np.argsort(ids)
        freq = freq[order].astype(np.uint64)
        return cls(ids[order].astype(np.int64), freq, np.cumsum(freq) - freq)

    @classmethod
    def fit(cls, ids: np.ndarray, counts: np.ndarray) -> Table:
        """Scale counts so that every id keeps at least one part."""
        parts = 1 << PRECISION
        if len(ids) > parts // 2:
            raise ValueError("too many different ids for the table's precision")
        order = np.argsort(ids)
        ids, counts = ids[order], counts[order].astype(np.float64)
        freq = 1 + np.floor(counts / max(counts.sum(), 1) * (parts - len(ids))).astype(np.int64)
        if len(ids):
            freq[np.argmax(counts)] += parts - freq.sum()
        return cls.of(ids, freq)

    def symbols(self) -> np.ndarray:
        """Place of each id in the table, by id."""
        places = np.zeros(int(self.ids.max(initial=0)) + 1, np.int32)
        places[self.ids] = np.arange(len(self.ids))
        return places

    def slots(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ids), dtype=np.int32), self.freq.astype(np.int64))


@dataclass(frozen=True)
class Block:
    count: int
    states: bytes  # for each segment, the lanes' states
    places: list[int]  # for each segment, its first word
    checks: list[int]  # for each segment, the CRC-32 of its ids as little-endian 32-bit integers
    words: bytes


def encode(blocks: list[np.ndarray], table: Table) -> list[Block]:
    """Encode blocks of ids together."""
    counts = np.array([len(b) for b in blocks], np.int64)
    steps = int(-(-counts.max() // LANES)) if len(blocks) else 0
    symbols, places = np.zeros((len(blocks), steps * LANES), np.int32), table.symbols()
    for row, ids in zip(symbols, blocks):
        row[: len(ids)] = places[ids]
    symbols = np.ascontiguousarray(symbols.reshape(len(blocks), steps, LANES).transpose(1, 0, 2))
    lane, full = np.arange(LANES), int(counts.min()) if len(blocks) else 0
    bits, limit = np.uint64(PRECISION), np.uint64(63 - PRECISION)
    x = np.full((len(blocks), LANES), LOW, np.uint64)
    words = np.empty(symbols.shape, np.uint32)
    given = np.zeros(symbols.shape, bool)
    states: dict[int, np.ndarray] = {}
    for s in range(steps - 1, -1, -1):
        freq, start = table.freq.take(symbols[s]), table.cum.take(symbols[s])
        emit = x >= freq << limit
        active = None if (s + 1) * LANES <= full else s * LANES + lane < counts[:, None]
        if active is not None:
            emit &= active
        words[s], given[s] = x & U32, emit
        shifted = np.where(emit, x >> WORD, x)
        whole = shifted // freq
        pushed = (whole << bits) + (shifted - whole * freq) + start
        x = pushed if active is None else np.where(active, pushed, x)
        if s % CHECK == 0:
            states[s // CHECK] = x
    out = []
    for b, ids in enumerate(blocks):
        segments = max(1, -(-len(ids) // SEGMENT))
        own = given[:, b, :]
        per_step = np.concatenate(([0], np.cumsum(own.sum(1))))
        raw = ids.astype("<u4")
        out.append(
            Block(
                len(ids),
                b"".join(states[j][b].astype("<u8").tobytes() for j in range(segments) if j in states),
                [int(per_step[min(j * CHECK, steps)]) for j in range(segments)],
                [zlib.crc32(raw[j * SEGMENT : (j + 1) * SEGMENT].tobytes()) for j in range(segments)],
                words[:, b, :][own].astype("<u4").tobytes(),
            )
        )
    return out


def decode(blocks: list[Block], table: Table, slots: np.ndarray) -> list[np.ndarray]:
    """Decode all segments of all blocks side by side and check them."""
    starts, counts, places, base = [], [], [], 0
    for block in blocks:
        lanes = np.frombuffer(block.states, "<u8").reshape(-1, LANES)
        for j, place in enumerate(block.places[: len(lanes)]):
            starts.append(lanes[j])
            counts.append(min(SEGMENT, block.count - j * SEGMENT))
            places.append(base + place)
        base += len(block.words) // 4
    if not starts:
        return [np.empty(0, np.int64) for _ in blocks]
    words = np.frombuffer(b"".join(b.words for b in blocks) + bytes(4), "<u4").astype(np.uint64)
    x, n, at = np.array(starts, np.uint64), np.array(counts), np.array(places)
    steps, full, lane = int(-(-n.max() // LANES)), int(n.min()), np.arange(LANES)
    bits, low_bits = np.uint64(PRECISION), np.uint64((1 << PRECISION) - 1)
    out = np.empty((steps, len(n), LANES), np.int32)
    for s in range(steps):
        slot = x & low_bits
        out[s] = symbol = slots.take(slot.view(np.int64))
        popped = table.freq.take(symbol) * (x >> bits) + slot - table.cum.take(symbol)
        need = popped < LOW
        if (s + 1) * LANES > full:
            active = s * LANES + lane < n[:, None]
            need &= active
            popped = np.where(active, popped, x)
        taken = np.cumsum(need, axis=1)
        word = words.take(at[:, None] + taken - 1, mode="clip")
        x = np.where(need, (popped << WORD) | word, popped)
        at = at + taken[:, -1]
    flat = table.ids.astype(np.int32).take(out.transpose(1, 0, 2).reshape(len(n), -1))
    result, row = [], 0
    for block in blocks:
        parts = []
        for check in block.checks[: len(block.states) // (8 * LANES)]:
            ids = flat[row][: n[row]]
            if zlib.crc32(ids.astype("<u4").tobytes()) != check:
                raise ValueError("a segment's checksum doesn't match its ids")
            parts.append(ids)
            row += 1
        result.append(np.concatenate(parts) if parts else np.empty(0, np.int64))
    return result


def crc32_join(first: int, second: int, second_bytes: int) -> int:
    """CRC-32 of two byte strings put together, from theirs and the second's length."""
    factor, square = 0x80000000, 0x00800000  # 1 and x^8, bit-reflected
    n = second_bytes
    while n:
        if n & 1:
            factor = _times(factor, square)
        square = _times(square, square)
        n >>= 1
    return _times(factor, first) ^ second


def _times(a: int, b: int) -> int:
    """Product of two reflected polynomials modulo that of CRC-32."""
    product = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            product ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return product
