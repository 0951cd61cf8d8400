"""Vectorised word and byte handling over Arrow text columns.

Operators hand whole Arrow batches to these helpers inside ``mapInArrow``. A batch is cut into
blocks of a few megabytes, so memory stays bounded by the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BLOCK_BYTES = 4 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every output bit depends on every input bit."""
    x = x ^ (x >> U64(32))
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit numbers, the same in every process."""
    return mix(mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) + U64(seed * 2 + 1))


def byte_class(word: str) -> np.ndarray:
    """Boolean table over bytes. 'alnum': ASCII letters, digits, all bytes over 0x7F. 'space': all but ASCII white space."""
    table = np.zeros(256, dtype=bool)
    if word == "alnum":
        table[0x30:0x3A] = table[0x41:0x5B] = table[0x61:0x7B] = table[0x80:] = True
    else:
        table[:] = True
        table[[0x20, *range(0x09, 0x0E)]] = False
    return table


LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
_PLACE = stream(12, 4096)


def windows(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each offset on, as one number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    return np.ndarray((len(data),), dtype="<u8", buffer=padded, strides=(1,))


def runs(starts: np.ndarray, counts: np.ndarray, step: int = 1) -> np.ndarray:
    """starts[0], starts[0] + step, ..., counts[0] numbers in all; then the same of starts[1], and so on."""
    first = np.cumsum(counts) - counts
    return np.arange(counts.sum()) * step + np.repeat(starts - first * step, counts)


def blocks(batch: pa.RecordBatch, text: str = "text", most: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch into (rows, bytes, row offsets into bytes); a null text is empty."""
    column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield batch.slice(at, to - at), data[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
        at = to


class Words:
    """Spans and hashes of the words of a block; ``first[i]:first[i+1]`` are the words of row i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        inside = table[data]
        first, last = inside.copy(), inside.copy()
        if len(data):
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            cuts = offsets[(offsets > 0) & (offsets < len(data))]
            first[cuts] = inside[cuts]
            last[cuts - 1] = inside[cuts - 1]
        self.data, self.offsets = data, offsets
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.starts, offsets)

    @classmethod
    def spanning(cls, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Words:
        """Given spans, none of them empty, in place of words."""
        out = cls.__new__(cls)
        out.data, out.starts, out.ends = data, starts, ends
        return out

    def hashes(self) -> np.ndarray:
        """64-bit hashes of the words with A-Z lower-cased: mixed eight-byte parts, summed, with the length."""
        if not len(self.starts):
            return np.zeros(0, dtype=U64)
        sizes = self.ends - self.starts
        eight = windows(LOWER[self.data])
        total = mix((eight[self.starts] & (~U64(0) >> (U64(8) * (8 - np.minimum(sizes, 8)).astype(U64)))) + _PLACE[0])
        long = np.flatnonzero(sizes > 8)
        if len(long):
            rest = sizes[long] - 8
            parts = (rest + 7) // 8
            first = np.cumsum(parts) - parts
            values = eight[runs(self.starts[long] + 8, parts, 8)]
            values[first + parts - 1] &= ~U64(0) >> (U64(8) * ((-rest) % 8).astype(U64))
            place = runs(np.ones_like(parts), parts)
            values += _PLACE[np.minimum(place, len(_PLACE) - 1)]
            if parts.max() >= len(_PLACE):
                far = place >= len(_PLACE)
                values[far] = mix(values[far]) + place[far].astype(U64) * U64(0x9E3779B97F4A7C15)
            total[long] += np.add.reduceat(mix(values), first)
        return mix(total + sizes.astype(U64))


def hash_word(word: bytes) -> int:
    """The hash that ``Words.hashes`` gives a lone word."""
    data = np.frombuffer(word, dtype=np.uint8)
    block = Words(data, np.array([0, len(data)]), np.ones(256, dtype=bool))
    return int(block.hashes()[0])


def code_points(data: np.ndarray) -> np.ndarray:
    """For each byte offset 0..len(data), the number of characters before it."""
    return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])


def shingles(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive words of each row, and row bounds; a row with fewer words, but some, has one."""
    counts = np.diff(first)
    n = len(hashes)
    rolled = np.zeros(max(n - width + 1, 0), dtype=U64)
    for k in range(width):
        rolled += hashes[k : n - width + 1 + k] * U64(2 * (k * k + 7 * k) + 0x9E3779B97F4A7C15)
    rolled = mix(rolled)
    per_row = np.maximum(counts - width + 1, (counts > 0).astype(counts.dtype))
    bounds = np.concatenate([[0], np.cumsum(per_row)])
    out = np.zeros(bounds[-1], dtype=U64)
    row = np.repeat(np.arange(len(counts)), per_row)
    at = first[row] + np.arange(len(out)) - bounds[row]
    whole = counts[row] >= width
    out[whole] = rolled[at[whole]]
    for i in np.flatnonzero((counts > 0) & (counts < width)):
        part = hashes[first[i] : first[i + 1]]
        out[bounds[i]] = mix(np.array([sum(int(h) * (2 * k + 0xA24BAED4963EE407) for k, h in enumerate(part)) + len(part) & (1 << 64) - 1], dtype=U64))[0]
    return out, bounds
