"""Vectorised word and shingle hashing over Arrow string columns.

Words are maximal runs of bytes outside ``\\x20`` and ``\\x09``-``\\x0D``.  UTF-8
continuation bytes never fall in that set, so splitting bytes splits characters
correctly.  All hashes are 64-bit, deterministic and independent of where a
document lies in its batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd multipliers of the polynomial hashes (fixed values of the hash definition).
BYTE_BASE = 0x9E3779B97F4A7C15 | 1
WORD_BASE = 0xC2B2AE3D27D4EB4F | 1
_MASK = (1 << 64) - 1

#: Bytes handled at once; temporary arrays take about 60 times as much.
PIECE = 1 << 18

_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, PIECE + 1, 2 * len(have) if have is not None else 0)
        table = np.full(size, base & _MASK, dtype=U64)
        table[0] = 1
        have = _powers[base] = np.cumprod(table, dtype=U64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values (splitmix finaliser)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def documents(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, its UTF-8 bytes) for each row; null counts as empty."""
    for lo, data, offsets in blocks(column):
        for i in range(len(offsets) - 1):
            yield lo + i, data[offsets[i] : offsets[i + 1]]


def blocks(column: pa.Array, size: int = PIECE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) over runs of whole rows of about ``size`` bytes; a longer row comes alone."""
    column = column.cast(pa.large_string()).fill_null("")
    _, off, buf = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(buf, dtype=np.uint8) if buf is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1)
        yield lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def _spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of each word; no word crosses an offset."""
    word = np.empty(len(data) + 2, dtype=bool)
    word[0] = word[-1] = False
    word[1:-1] = _IS_WORD[data]
    inner, before = word[1:-1], word[:-2]
    start = inner & ~before
    end = inner & ~word[2:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    start[cut] = inner[cut]
    end[cut - 1] = inner[cut - 1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


_inverse = pow(BYTE_BASE, -1, 1 << 64)


def _hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers(BYTE_BASE, len(data)), out=sums[1:])
    raw = (sums[ends] - sums[starts]) * powers(_inverse, len(data) + 1)[starts]
    return mix(raw + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def word_table(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, starts, ends, hashes): words of row i are first[i]..first[i+1]; starts and ends are bytes of ``data``."""
    starts, ends = _spans(data, offsets)
    first = np.searchsorted(starts, offsets)
    if lower:
        data = _LOWER[data]
    if len(data) <= 2 * PIECE:
        return first, starts, ends, _hash_spans(data, starts, ends)
    # A very long row: hash it piece by piece, cut between words.
    hashes = np.empty(len(starts), dtype=U64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + PIECE, side="right")))
        a = starts[lo]
        hashes[lo:hi] = _hash_spans(data[a : ends[hi - 1]], starts[lo:hi] - a, ends[lo:hi] - a)
        lo = hi
    return first, starts, ends, hashes


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive values."""
    if len(hashes) < n:
        return np.zeros(0, dtype=U64)
    out = np.empty(len(hashes) - n + 1, dtype=U64)
    if n <= 8:
        out[:] = hashes[: len(out)]
        for k in range(1, n):
            out *= U64(WORD_BASE)
            out += hashes[k : k + len(out)]
        return mix(out)
    step = PIECE
    inv = pow(WORD_BASE, -1, 1 << 64)
    for lo in range(0, len(out), step):
        hi = min(len(out), lo + step)
        part = hashes[lo : hi + n - 1]
        sums = np.zeros(len(part) + 1, dtype=U64)
        np.cumsum(part * powers(WORD_BASE, len(part)), out=sums[1:])
        out[lo:hi] = (sums[n:] - sums[: hi - lo]) * powers(inv, hi - lo)
    return mix(out)


def whole(hashes: np.ndarray) -> int:
    """Hash of a whole sequence of values."""
    total = int(np.sum(hashes * powers(WORD_BASE, len(hashes)), dtype=U64)) if len(hashes) else 0
    return int(mix(np.array([(total + len(hashes) * 0xA0761D6478BD642F) & _MASK], dtype=U64))[0])


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, values): values[first[i]:first[i+1]] are the sorted distinct n-word shingle hashes of row i, A-Z lowered.

    A row of fewer words is one shingle; a row without words has none.
    """
    first, _, _, hashes = word_table(data, offsets, lower=True)
    words = np.diff(first)
    per_row = np.where(words >= n, words - n + 1, words > 0)
    at = np.r_[0, np.cumsum(per_row)]
    values = np.empty(at[-1], dtype=U64)
    all_windows = windows(hashes, n)
    long = np.flatnonzero(words >= n)
    if len(long) == len(words):
        pick = np.arange(at[-1]) + np.repeat(first[:-1] - at[:-1], per_row)
        values[:] = all_windows[pick]
    else:
        for i in np.flatnonzero(words):
            values[at[i] : at[i + 1]] = all_windows[first[i] : first[i] + per_row[i]] if words[i] >= n else U64(whole(hashes[first[i] : first[i + 1]]))
    for i in np.flatnonzero(per_row > 1):
        values[at[i] : at[i + 1]].sort()
    fresh = np.ones(len(values), dtype=bool)
    fresh[1:] = values[1:] != values[:-1]
    fresh[at[:-1][per_row > 0]] = True
    return np.r_[0, np.cumsum(fresh)][at], values[fresh]


def sums_by_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum modulo 2**64 of each row's values."""
    total = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
