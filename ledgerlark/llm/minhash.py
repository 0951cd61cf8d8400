"""One-permutation MinHash with optimal densification, and banded bucket keys."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .textblocks import U64, mix, stream


@lru_cache(maxsize=4)
def _donors(bins: int) -> np.ndarray:
    """Row b: the order in which an empty bin b asks the others, a permutation of its own."""
    return np.argsort(stream(31, bins * bins).reshape(bins, bins), axis=1).astype(np.int32)


def densify(signature: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Fill each empty bin from the first filled one in its own random order; rows without any stay zero."""
    bins = signature.shape[1]
    donors = _donors(bins)
    row, column = np.nonzero(~filled & filled.any(axis=1)[:, None])
    out = signature.copy()
    for attempt in range(bins):
        if not len(row):
            break
        donor = donors[column, attempt]
        hit = filled[row, donor]
        out[row[hit], column[hit]] = signature[row[hit], donor[hit]]
        row, column = row[~hit], column[~hit]
    return out


def bin_of(hashes: np.ndarray, bins: int) -> np.ndarray:
    """By the upper 20 bits; there are fewer than 4096 bins."""
    return (hashes >> U64(44)).astype(np.int32) * np.int32(bins) >> np.int32(20) if bins < 2048 else ((hashes >> U64(44)).astype(np.int64) * bins >> 20)


def signatures(hashes: np.ndarray, row: np.ndarray, rows: int, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Least hash of each bin of each row, densified, and whether the row has any hash."""
    empty = ~U64(0)
    flat = np.full(rows * bins, empty, dtype=U64)
    np.minimum.at(flat, row * bins + bin_of(hashes, bins), hashes)
    signature = flat.reshape(rows, bins)
    filled = signature != empty
    return densify(signature, filled), filled.any(axis=1)


def bands(signature: np.ndarray, per_band: int) -> np.ndarray:
    """One 64-bit bucket key for each ``per_band`` bins; keys of different bands differ."""
    rows, bins = signature.shape
    n = bins // per_band
    cut = signature[:, : n * per_band].reshape(rows, n, per_band)
    keys = np.zeros((rows, n), dtype=U64)
    for k in range(per_band):
        keys = mix(keys + cut[:, :, k])
    return mix(keys + stream(32, n)[None, :])
