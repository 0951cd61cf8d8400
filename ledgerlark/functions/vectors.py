"""Vector functions: norms, cosine distance and a hashing embedder, as Column expressions."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import STOP_WORDS


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cos; null for zero vectors."""
    return 1 - F.try_divide(dot(a, b), norm(a) * norm(b))


def l2_normalized(a: Column) -> Column:
    """A zero vector stays as it is."""
    length = norm(a)
    return F.when(length > 0, F.transform(a, lambda x: x / length)).otherwise(F.transform(a, lambda x: x.cast("double")))


_LOW = np.arange(256, dtype=np.uint8)
_LOW[0x41:0x5B] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
#: Words of up to _SHORT bytes are summed up by column: what a byte adds to their crc32 by how many follow it, and what the start adds by
#: their size. Stop words are of four letters at most, as numbers.
_SHORT, _BYTES = 32, 4 << 20
_BYTE = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _BYTE = np.where(_BYTE & 1, _BYTE >> 1 ^ np.uint32(0xEDB88320), _BYTE >> 1)
_ADDS, _START = [_BYTE], np.full(_SHORT + 1, 0xFFFFFFFF, dtype=np.uint32)
for _k in range(_SHORT):
    _ADDS.append(_BYTE[_ADDS[-1] & 255] ^ _ADDS[-1] >> np.uint32(8))
    _START[_k + 1] = _BYTE[_START[_k] & 255] ^ _START[_k] >> np.uint32(8)
_STOP = np.array(sorted(int.from_bytes(w.encode(), "little") for w in STOP_WORDS), dtype=np.uint64)


def _spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of letters and digits begin and end, each within a row."""
    inside = _WORD[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    first[cuts], last[cuts - 1] = inside[cuts], inside[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _word_counts(data: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    """How many of each row's words, without stop words, have each remainder of their crc32."""
    data = _LOW[data]
    starts, ends = _spans(data, offsets)
    size = ends - starts
    before = np.ndarray((len(data) + 1,), dtype="<u8", buffer=np.concatenate([np.zeros(8, dtype=np.uint8), data]), strides=(1,))  # the eight bytes before each place
    crc, some = _START[np.minimum(size, _SHORT)], np.arange(len(size))
    for k in range(0, _SHORT, 8):
        some = some[size[some] > k] if k else some
        if not len(some):
            break
        none = (8 * np.maximum(8 + k - size[some], 0)).astype(np.uint64)
        eight = before[np.maximum(ends[some] - k, 0)] >> none
        if not k:
            letters = eight
        eight = eight << none
        sums = crc[some]
        for j in range(8):
            sums ^= _ADDS[k + j][(eight >> np.uint64(8 * (7 - j))).astype(np.uint8)]
        crc[some] = sums
    crc = ~crc
    for i in np.flatnonzero(size > _SHORT).tolist():
        crc[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes())
    if not len(size):
        return np.zeros((len(offsets) - 1, width), dtype=np.int64)
    flat = np.repeat(np.arange(len(offsets) - 1) * width, np.diff(np.searchsorted(starts, offsets))) + crc % width
    few = np.flatnonzero(size <= 4)
    stop = few[_STOP[np.minimum(np.searchsorted(_STOP, letters[few]), len(_STOP) - 1)] == letters[few]]
    return (np.bincount(flat, minlength=(len(offsets) - 1) * width) - np.bincount(flat[stop], minlength=(len(offsets) - 1) * width)).reshape(-1, width)


def hashed_embedding(text: Column, width: int = 64) -> Column:
    """A deterministic embedding in Arrow batches: counts of hashed words, normalised; a null text is empty."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def embed(texts: pa.Array) -> pa.Array:
        texts = texts.cast(pa.large_string()).fill_null("")
        for upper, lower in (("\u0130", "i\u0307"), ("\u212a", "k")):  # the letters outside ASCII that have one of it in lower case
            if pc.any(pc.match_substring(texts, upper)).as_py():
                texts = pc.replace_substring(texts, upper, lower)
        n, parts, at = len(texts), [np.zeros((0, width))], 0
        ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, dtype=np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8) if n else np.zeros(0, dtype=np.uint8)
        while at < n:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + _BYTES, "right")) - 1)
            parts.append(_word_counts(data[ends[at] : ends[to]], ends[at : to + 1] - ends[at], width).astype(float))
            at = to
        out = np.concatenate(parts)
        out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(out.ravel()))

    return embed(text)
