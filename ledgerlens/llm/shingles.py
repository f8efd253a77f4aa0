"""Words and shingles of many texts at once, as numpy arrays over Arrow's UTF-8 buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are handled at once; a longer text is handled by itself.
CHUNK = 1 << 18
MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_lower = np.arange(256, dtype=np.uint64)
_lower[65:91] += np.uint64(32)
BYTE_CODE = mix(_lower + np.uint64(1))
_powers = odd_numbers(1 << 12, 3)


def place_codes(n: int) -> np.ndarray:
    global _powers
    if n > len(_powers):
        _powers = odd_numbers(max(n, 2 * len(_powers)), 3)
    return _powers


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; nulls are empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    values = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return values, offsets


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most so many bytes together, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i], starts[i] + 1, ... of all slices, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def line_bounds(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the lines of all rows, and each line's row. A line keeps the break that ends it."""
    breaks = np.flatnonzero(values == 10) + 1
    bounds = np.unique(np.concatenate((offsets, breaks)))
    # an empty row has no line
    return bounds, np.searchsorted(offsets, bounds[:-1], side="right") - 1


def words(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word with A-Z lowered, and the number of words in each unit.

    Units lie one after another, unit i from bounds[i] to bounds[i + 1]; a word ends with its unit.
    """
    inside = IS_WORD[values]
    edge = np.zeros(len(values) + 1, dtype=bool)
    edge[bounds] = True
    starts = np.flatnonzero(inside & (edge[:-1] | np.append(True, ~inside[:-1])))
    ends = np.flatnonzero(inside & (edge[1:] | np.append(~inside[1:], True))) + 1
    lengths = ends - starts
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(bounds) - 1, dtype=np.int64)
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    codes = BYTE_CODE[values[inside]] * place_codes(int(lengths.max()))[place]
    counts = np.diff(np.searchsorted(starts, bounds))
    return mix(np.add.reduceat(codes, first)), counts


def shingles(hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of k consecutive words in each unit, sorted within it, and their number.

    A unit of fewer words has one shingle of all its words, a unit without words none.
    """
    first = np.cumsum(counts) - counts
    number = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    at = ragged(first, number)
    end = np.repeat(first + counts, number)
    codes = odd_numbers(k, 11)
    padded = np.append(hashes, np.zeros(k, dtype=np.uint64))
    total = np.zeros(len(at), dtype=np.uint64)
    for j in range(k):
        total += np.where(at + j < end, padded[at + j] * codes[j], np.uint64(0))
    total = mix(total)
    owner = np.repeat(np.arange(len(counts)), number)
    order = np.argsort(total)
    order = order[np.argsort(owner[order].astype(np.uint16) if len(counts) < 1 << 16 else owner[order], kind="stable")]
    total, owner = total[order], owner[order]
    fresh = np.append(True, (total[1:] != total[:-1]) | (owner[1:] != owner[:-1])) if len(total) else np.zeros(0, dtype=bool)
    return total[fresh], np.bincount(owner[fresh], minlength=len(counts))


def set_keys(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One 64-bit number for each non-empty unit's set; equal sets have equal numbers."""
    first = (np.cumsum(counts) - counts)[counts > 0]
    return mix(np.add.reduceat(mix(hashes + np.uint64(0x5851F42D4C957F2D)), first)) if len(first) else np.zeros(0, dtype=np.uint64)


def signatures(hashes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """MinHash signatures of the non-empty units: the least value under each of `size` functions."""
    first = (np.cumsum(counts) - counts)[counts > 0]
    out = np.empty((len(first), size), dtype=np.uint32)
    if not len(first):
        return out
    base = (hashes >> np.uint64(32)).astype(np.uint32)
    low = hashes.astype(np.uint32)
    factors, adds = odd_numbers(size, 21).astype(np.uint32) | np.uint32(1), odd_numbers(size, 22).astype(np.uint32)
    for k in range(size):
        x = base * factors[k]
        x += low ^ adds[k]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        out[:, k] = np.minimum.reduceat(x, first)
    return out
