"""Words and word shingles of whole texts as 64-bit hashes, computed with numpy over Arrow buffers.

A word is a run of bytes other than space and 0x09-0x0D; A-Z count as a-z. Hashes do not depend on the batch a text
arrives in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19  # texts are taken together up to this size, one text at least

_rng = np.random.default_rng(20_240_601)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_CASED = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_CASED[_SPACE] = 0
_BYTE = _CASED.copy()
_BYTE[65:91] = _BYTE[97:123]
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LEN = np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def text_chunks(column: pa.Array | pa.ChunkedArray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of neighbouring texts of about `size` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        j = min(j, len(column))
        yield i, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def word_starts(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of each word, is-space mask, word offsets of the texts)."""
    space = _SPACE[data]
    first = ~space
    if len(data):
        first[1:] &= space[:-1] | False
        at = off[:-1][off[:-1] < len(data)]
        first[at] = ~space[at]
    starts = np.flatnonzero(first)
    return starts, space, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, word offsets of the texts)."""
    starts, space, woff = word_starts(data, off)
    return hashed(data, starts, space)[0], woff


_STEPS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]  # powers of _STEP and of its inverse


def _powers(n: int) -> list[np.ndarray]:
    """At least n powers of each, kept for the next call unless a very long text needed more."""
    if len(_STEPS[0]) >= n:
        return _STEPS
    size = max(n, 2 * CHUNK_BYTES)
    with np.errstate(over="ignore"):
        made = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)])) for x in (_STEP, _BACK)]
    if size <= 8 * CHUNK_BYTES:
        _STEPS[:] = made
    return made


def hashed(data: np.ndarray, starts: np.ndarray, space: np.ndarray, cased: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash, bytes) of each word; cased: A-Z and a-z are told apart."""
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    up, down = _powers(len(data))
    with np.errstate(over="ignore"):
        part = (_CASED if cased else _BYTE)[data]
        part *= up[: len(data)]
        seen = np.cumsum(~space, dtype=np.int64)
        size = np.diff(np.append(seen[starts] - 1, seen[-1]))
        return mix(np.add.reduceat(part, starts) * down[starts] + size.astype(np.uint64) * _LEN), size


def shingle_sets(data: np.ndarray, off: np.ndarray, width: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of `width` words; with fewer words, of all of them."""
    words, woff = word_hashes(data, off)
    with np.errstate(over="ignore"):
        weight = np.cumprod(np.full(width, np.uint64(0xD6E8FEB86659FD93)))
        n = max(0, len(words) - width + 1)
        runs = np.zeros(n, np.uint64)
        for j in range(width):
            runs += words[j : j + n] * weight[j]
        runs = mix(runs)
        for d in range(len(off) - 1):
            a, b = int(woff[d]), int(woff[d + 1])
            if b - a >= width:
                yield np.unique(runs[a : b - width + 1])
            elif b > a:
                yield mix((words[a:b] * weight[: b - a]).sum(keepdims=True) + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)
