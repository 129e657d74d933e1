"""Arrow text columns as byte arrays: words, and hashes of any byte span from prefix sums.

The hash of bytes x[s:e] is the polynomial sum of table[x[i]] * BASE**-(i-s), modulo 2**64, mixed
at the end. One prefix sum gives the hash of every span, so words, n-grams and windows of a whole
batch cost a few numpy passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of text worked on at once inside a task; one longer text is worked on alone.
SLICE = 1 << 21
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _upto(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i in 0..n, kept between calls while short."""
    if len(_powers[0]) > n:
        return _powers[0], _powers[1]
    n = max(1 << n.bit_length(), SLICE // 4) if n < 2 * SLICE else n  # grows by doubling, not with each longer slice
    made = []
    for factor in (BASE, INVERSE):
        steps = np.full(n + 1, factor, np.uint64)
        steps[0] = 1
        made.append(np.cumprod(steps, dtype=np.uint64))
    if n <= 2 * SLICE:
        _powers[:] = made
    return made[0], made[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class Prefix:
    """Prefix sums of one array of bytes or of 64-bit codes; ``span`` hashes many spans at once."""

    def __init__(self, data: np.ndarray):
        self.power, inverse = _upto(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((TABLE[data] if data.dtype == np.uint8 else data) * inverse[: len(data)], out=self.sums[1:])

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.power[start])

    def grams(self, n: int) -> np.ndarray:
        """Hash of the n bytes from every position."""
        if len(self.sums) <= n:
            return np.zeros(0, np.uint64)
        return mix((self.sums[n:] - self.sums[:-n]) * self.power[: len(self.sums) - n])


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty."""
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        kind, width = column, np.int32
    else:
        kind, width = column.cast(pa.large_binary() if pa.types.is_large_binary(column.type) else pa.large_string()), np.int64
    if kind.null_count:
        kind = kind.fill_null(b"" if "binary" in str(kind.type) else "")
    buffers = kind.buffers()
    if len(kind) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], width)[kind.offset : kind.offset + len(kind) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first) of the maximal runs of true bytes, cut at rows; ``first[r]`` is the first run of row r."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1]))[: len(inside)]
    after = np.concatenate((inside[1:], [False]))[: len(inside)]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values[first[r]:first[r+1]] for each row r."""
    total = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return total[first[1:]] - total[first[:-1]]


def look_up(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, found) of wanted hashes in sorted keys."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    place = np.searchsorted(keys, wanted)
    place[place == len(keys)] = 0
    return place, keys[place] == wanted
