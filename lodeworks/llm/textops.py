"""Byte-level words of Arrow string columns, hashed with NumPy: no Python object per word.

Words are runs of bytes other than space and 0x09-0x0D. All separators are single ASCII bytes, so a word is always
whole UTF-8. The 64-bit hash of a word is a sum of random byte values times powers of an odd base, taken from prefix
sums, then mixed. Texts are worked on in slices cut at separators, so memory is bounded for any text length.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
_RNG = np.random.default_rng(20240229)
BYTE_VALUES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 5
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[list(SEPARATORS)] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
LOWERED = BYTE_VALUES[LOWER]
_POWERS: list[np.ndarray] = []


#: What workers keep from task to task.
CACHES: list[dict] = []


def tidy(keep: dict | None = None) -> None:
    """Give freed memory back, and what other operators keep: workers live on between tasks, and an executor's workers
    share its memory."""
    for cache in CACHES:
        if cache is not keep:
            cache.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**j and its inverse modulo 2**64, for j below n."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, SLICE + 1)
        with np.errstate(over="ignore"):
            for k, base in enumerate((BASE, pow(BASE, -1, 2**64))):
                p = np.full(size, base & (2**64 - 1), dtype=np.uint64)
                p[0] = 1
                np.multiply.accumulate(p, out=p)
                _POWERS[k : k + 1] = [p]
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def string_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def word_marks(raw: np.ndarray, off: np.ndarray, is_word: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words; a text's end also ends a word."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    w = is_word[raw]
    s = w.copy()
    s[1:] &= ~w[:-1]
    e = w.copy()
    e[:-1] &= ~w[1:]
    full = off[:-1][off[1:] > off[:-1]]
    s[full] = w[full]
    last = off[1:][off[1:] > off[:-1]] - 1
    e[last] = w[last]
    return np.flatnonzero(s), np.flatnonzero(e) + 1


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = LOWERED) -> np.ndarray:
    """The hash of each span of bytes; spans are in order and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            begin = starts[at]
            to = max(int(np.searchsorted(ends, begin + SLICE, "right")), at + 1)
            part = raw[begin : ends[to - 1]]
            p, q = powers(len(part) + 1)
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(values[part] * p[: len(part)], out=total[1:])
            s, e = starts[at:to] - begin, ends[at:to] - begin
            out[at:to] = mix((total[e] - total[s]) * q[s] + (e - s).astype(np.uint64))
            at = to
    return out


def words(raw: np.ndarray, off: np.ndarray, values: np.ndarray = LOWERED, is_word: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and each text's offsets into them."""
    s, e = word_marks(raw, off, is_word)
    return hash_spans(raw, s, e, values), np.searchsorted(s, off)


def slices(off: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes, one text at least."""
    at, n = 0, len(off) - 1
    while at < n:
        to = max(int(np.searchsorted(off, off[at] + most, "right")) - 1, at + 1)
        yield at, min(to, n)
        at = min(to, n)


def pieces(col: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end text, bytes, offsets) of slices of a string column."""
    raw, off = string_bytes(col)
    for a, b in slices(off, most):
        yield a, b, raw[off[a] : off[b]], off[a : b + 1] - off[a]


_C = [np.uint64(x | 1) for x in _RNG.integers(1, 2**63, 64, dtype=np.uint64).tolist()]


def window_hashes(h: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """A hash of the words at the mask's positions for every window start in one run of words."""
    n = len(h) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(n, np.uint64)
        for k, at in enumerate(mask):
            total += h[at : at + n] * _C[k % 64]
        return mix(total)
