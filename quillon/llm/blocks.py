"""Vectorised views of text columns: words, word hashes and window hashes as numpy arrays.

Texts come as Arrow columns. They are worked off in slices of a few MB, so memory follows the slice
and not the batch; a text longer than a slice forms one of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE_CODES = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_WINDOW_CODES = _rng.integers(0, 2**64, 4096, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the 64 output bits (a bijection)."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64, or those of the inverse; kept between calls up to a bound."""
    key = "inverse" if inverse else "base"
    have = _powers.get(key)
    if have is None or len(have) < n:
        out = np.full(max(n, SLICE_BYTES), _BASE_INVERSE if inverse else _BASE, dtype=np.uint64)
        out[0] = 1
        have = np.cumprod(out, dtype=np.uint64)
        if len(have) <= 4 * SLICE_BYTES:
            _powers[key] = have
    return have[:n]


@dataclass
class Slice:
    """Consecutive rows of a batch: row numbers, their bytes back to back, and where each begins."""

    first: int
    data: np.ndarray  # uint8
    offsets: np.ndarray  # int64, one more than rows

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, row: int) -> bytes:
        return self.data[self.offsets[row] : self.offsets[row + 1]].tobytes()


@dataclass
class Words:
    """start, end: byte positions in the slice; of: first word of each row, and the total."""

    start: np.ndarray
    end: np.ndarray
    of: np.ndarray

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.of) - 1), np.diff(self.of))


def slices(texts: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Rows of a string column in order; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) else "")
    if not len(texts):
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, where, data = texts.buffers()
    ends = np.frombuffer(where, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + limit, side="right")) - 1)
        yield Slice(row, flat[ends[row] : ends[stop]], ends[row : stop + 1] - ends[row])
        row = stop


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; all other bytes stay."""
    return _LOWER[data]


def words(part: Slice) -> Words:
    """Maximal runs of bytes other than space and 0x09-0x0D, none across rows."""
    n = len(part.data)
    solid = ~_SPACE[part.data]
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[0] = after[-1] = False
        before[1:] = solid[:-1]
        after[:-1] = solid[1:]
        cuts = part.offsets[1:-1]
        before[cuts[cuts < n]] = False
        cuts = cuts[cuts > 0] - 1
        after[cuts] = False
    start = np.flatnonzero(solid & ~before)
    end = np.flatnonzero(solid & ~after) + 1
    return Words(start, end, np.searchsorted(start, part.offsets))


def word_hashes(data: np.ndarray, found: Words) -> np.ndarray:
    """64 bits for each word, equal for equal bytes."""
    return range_hashes(_BYTE_CODES[data], found.start, found.end)


def byte_codes(data: np.ndarray) -> np.ndarray:
    """A fixed random 64-bit code for each byte value."""
    return _BYTE_CODES[data]


def range_hashes(codes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """64 bits for each run codes[low:high], equal for equal runs wherever they lie."""
    sums = np.empty(len(codes) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(codes * powers(len(codes)), dtype=np.uint64, out=sums[1:])
    out = (sums[high] - sums[low]) * powers(len(codes) + 1, inverse=True)[low]
    return mix(out + (high - low).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def sliding_least(values: np.ndarray, size: int) -> np.ndarray:
    """The least of each size consecutive values."""
    n = len(values)
    if n < size:
        return np.zeros(0, values.dtype)
    grid = np.full(-(-n // size) * size, np.iinfo(values.dtype).max, values.dtype)
    grid[:n] = values
    grid = grid.reshape(-1, size)
    head = np.minimum.accumulate(grid, axis=1).ravel()
    tail = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[: n - size + 1], head[size - 1 : n])


def window_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """64 bits for each run of size consecutive codes; windows across rows are the caller's to leave out."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if size <= 16:
        out = np.zeros(n, np.uint64)
        for j in range(size):
            out += codes[j : j + n] * _WINDOW_CODES[j]
        return mix(out)
    sums = np.empty(len(codes) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(codes * powers(len(codes)), dtype=np.uint64, out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * powers(len(codes), inverse=True)[:n])


def whole(of: np.ndarray, total: int, size: int) -> np.ndarray:
    """For each window start of window_hashes over total codes: whether it ends in the row it starts in."""
    n = total - size + 1
    if n <= 0:
        return np.zeros(0, bool)
    crossing = np.zeros(n + 1, np.int32)
    ends = of[1:]
    low = np.clip(np.maximum(ends - size + 1, of[:-1]), 0, n)
    np.add.at(crossing, low, 1)
    np.add.at(crossing, np.clip(ends, 0, n), -1)
    return np.cumsum(crossing[:-1]) == 0


def shingle_sets(codes: np.ndarray, of: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct window hashes of each row; a row of fewer words has its whole sequence as one."""
    hashes = window_hashes(codes, size)
    out = []
    for a, b in zip(of[:-1].tolist(), of[1:].tolist(), strict=True):
        n = b - a
        if n >= size:
            out.append(np.unique(hashes[a : b - size + 1]))
        elif n:
            short = np.zeros(size, np.uint64)
            short[:n] = codes[a:b]
            out.append(window_hashes(short ^ np.uint64(n), size))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
