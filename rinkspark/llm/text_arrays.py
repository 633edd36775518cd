"""Numpy views of Arrow text: byte classes, words and word hashes of a whole
batch at once, without a Python loop over words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BYTES = np.arange(256, dtype=np.uint8)
#: A-Z to a-z, other bytes unchanged.
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 0x20, _BYTES).astype(np.uint8)
#: Bytes of words after lower-casing: 0-9, a-z and all of non-ASCII UTF-8.
WORD = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)

_MULTIPLIER = 0x9E3779B97F4A7C15


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and where each begins (with the end as
    last entry). The array holds no nulls."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of lower-cased texts: the lower-cased bytes, where each word
    begins and ends, and the first word of each text (with the end as last
    entry)."""
    low = LOWER[data]
    inside = WORD[low]
    first = np.zeros(len(low), bool)
    first[begins[:-1][begins[:-1] < len(low)]] = True
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:] & ~first[1:]
    starts = np.flatnonzero(inside & (~before | first))
    ends = np.flatnonzero(inside & ~after) + 1
    return low, starts, ends, np.searchsorted(starts, begins)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, equal for equal bytes wherever
    they are: differences of one running sum, brought to a common power."""
    return run_hashes(data.astype(np.uint64) + np.uint64(1), starts, ends)


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The same for runs of unsigned 64-bit values."""
    inverse, n = pow(_MULTIPLIER, -1, 1 << 64), len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _powers(_MULTIPLIER, n), out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * _powers(inverse, n + 1)[starts] + (ends - starts).astype(np.uint64))


def ragged(flat: np.ndarray, begins: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The entries of the given rows of a ragged table, end to end."""
    sizes = begins[rows + 1] - begins[rows]
    ends = np.cumsum(sizes)
    return flat[np.repeat(begins[rows] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
