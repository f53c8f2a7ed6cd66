"""Word hashes of whole Arrow text columns, computed on the UTF-8 bytes with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.default_rng(20240229)
BYTE_HASH = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
POWER_BASE = np.uint64(0x9E3779B97F4A7C15)
_BLOCK = 1 << 16
with np.errstate(over="ignore"):
    POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(_BLOCK, POWER_BASE)]), dtype=np.uint64)
STEP = _RNG.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Space and the control characters 9 to 13 end a word.
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
#: For comparisons without punctuation, only letters, digits and non-ASCII bytes belong to a word.
NO_LETTER = np.ones(256, bool)
NO_LETTER[48:58] = NO_LETTER[65:91] = NO_LETTER[97:123] = False
NO_LETTER[128:] = False


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null reads as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data or b"", np.uint8), at


def text_slices(column: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of row runs with about ``most`` bytes; a longer text stands alone."""
    data, at = text_buffer(column)
    first = 0
    while first < len(column):
        end = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield first, end, data[at[first] : at[end]], at[first : end + 1] - at[first]
        first = end


def word_hashes(data: np.ndarray, at: np.ndarray, blank: np.ndarray = BLANK, fold: bool = True, places: bool = False) -> tuple[np.ndarray, ...]:
    """Hash of every word in row order, and for each row the place of its first word (one more entry at the end).

    With ``fold``, A-Z count as a-z. Words end at the bytes marked in ``blank`` and at the end of a text. With
    ``places``, the first byte and the end of every word follow.
    """
    none = np.zeros(0, np.uint64), np.zeros(len(at), np.int64), *[np.zeros(0, np.int64)] * (2 * places)
    if not len(data):
        return none
    low = LOWER[data] if fold else data
    inside = ~blank[low]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.empty(len(data), bool)
    before[0] = True
    np.logical_not(inside[:-1], out=before[1:])
    before |= edge[:-1]
    starts = np.flatnonzero(inside & before)
    if not len(starts):
        return none
    index = np.flatnonzero(inside)
    first = np.searchsorted(index, starts)
    length = np.diff(np.append(first, len(index)))
    place = np.arange(len(index)) - np.repeat(first, length)
    value = BYTE_HASH[low[index]]
    if length.max() <= _BLOCK:
        value *= POWERS[place]
    else:
        value *= POWERS[place % _BLOCK]
        value *= mix((place // _BLOCK).astype(np.uint64)) | np.uint64(1)
    return mix(np.add.reduceat(value, first) + length.astype(np.uint64)), np.searchsorted(starts, at), *[starts, starts + length][: 2 * places]


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``size`` words within a row, and the row offsets. A row with fewer words, but one at
    least, has its whole sequence as one shingle."""
    count = np.diff(first)
    runs = np.maximum(count - size + 1, (count > 0).astype(np.int64))
    out_at = np.concatenate([[0], np.cumsum(runs)])
    total = np.full(len(words), mix(np.array([size], np.uint64))[0])
    for k in range(size):
        total[: len(words) - k] += words[k:] * STEP[k]
    valid = np.ones(len(words), bool)
    for k in range(1, size):
        last = first[1:] - k
        valid[last[last >= first[:-1]]] = False
    for row in np.flatnonzero((count > 0) & (count < size)):
        begin = first[row]
        own = words[begin : first[row + 1]] * STEP[: count[row]]
        total[begin] = np.append(own, mix(count[row : row + 1].astype(np.uint64))).sum()
        valid[begin] = True
    return mix(total[valid]), out_at


def distinct_rows(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row, and their offsets."""
    hashes = hashes.copy()
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        hashes[a:b].sort()
    new = np.ones(len(hashes), bool)
    np.not_equal(hashes[1:], hashes[:-1], out=new[1:])
    new[at[:-1][at[:-1] < len(hashes)]] = True
    return hashes[new], np.concatenate([[0], np.cumsum(new)])[at]
