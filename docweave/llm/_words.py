"""Word tables of Arrow text columns, made with numpy over whole byte buffers.

A block of texts is one byte array. Words are maximal runs of the bytes that a
lookup table marks; each gets a 64-bit hash from prefix sums of a polynomial
(so no Python object is made for a word). Upper-case A-Z count as lower case.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_BLOCK = 1 << 20
_RNG = np.random.Generator(np.random.PCG64(20240607))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)[_LOWER]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_POSITION = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | _U(1)
_powers = [np.ones(1, _U), np.ones(1, _U)]

#: bytes of words split at white space: all but space and \x09-\x0D
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, *range(9, 14)]] = False
#: bytes of words of letters and digits: [0-9A-Za-z] and all beyond ASCII
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


class Words(NamedTuple):
    """Words of some texts: ``ptr[i]:ptr[i + 1]`` are those of text i."""

    hashes: np.ndarray
    ptr: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on the input."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, _U)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def _hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of ``data[starts[i]:ends[i]]``, in pieces of about a block."""
    out = np.empty(len(starts), _U)
    i = 0
    while i < len(starts):
        at = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, at + _BLOCK, "right")))
        s, e = starts[i:j] - at, ends[i:j] - at
        n = int(e[-1])
        up, down = _power(n + 1)
        total = np.zeros(n + 1, _U)
        np.cumsum(_VALUE[data[at : at + n]] * up[:n], out=total[1:])
        out[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(_U))
        i = j
    return out


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    return np.frombuffer(raw, np.uint8) if raw else np.zeros(0, np.uint8), offsets


def blocks(column: pa.Array, word_bytes: np.ndarray) -> Iterator[tuple[int, int, Words]]:
    """(first text, end, their words) for runs of texts of about a block; a
    null counts as an empty text."""
    data, offsets = _buffers(column)
    first = 0
    while first < len(column):
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + _BLOCK, "right")) - 1)
        yield first, end, _table(data, offsets[first : end + 1], word_bytes)
        first = end


def _table(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray) -> Words:
    at, n = int(offsets[0]), int(offsets[-1] - offsets[0])
    rel = offsets - at
    if not n:
        return Words(np.zeros(0, _U), np.zeros(len(offsets), np.int64))
    text = data[at : at + n]
    inside = word_bytes[text]
    edge = np.zeros(n + 1, bool)
    edge[rel] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return Words(_hash(text, starts, ends), np.searchsorted(starts, rel))


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes below 2**63, ptr) of the runs of ``width`` words of each text;
    a text of fewer words, but not none, has its whole sequence as one."""
    w, ptr = words
    count = np.diff(ptr)
    short = (count > 0) & (count < width)
    n_out = np.where(short, 1, np.maximum(count - width + 1, 0))
    out_ptr = np.concatenate([[0], np.cumsum(n_out)])
    out = np.empty(out_ptr[-1], _U)
    if len(w) >= width:
        m = len(w) - width + 1
        h = np.zeros(m, _U)
        for i in range(width):
            h += w[i : i + m] * _POSITION[i]
        left = np.repeat(ptr[1:], count)[:m] - np.arange(m)
        keep = left >= width
        long_rows = np.repeat(~short, n_out)
        out[long_rows] = h[keep]
    for i in np.flatnonzero(short):
        s, e = int(ptr[i]), int(ptr[i + 1])
        out[out_ptr[i]] = (w[s:e] * _POSITION[: e - s]).sum(dtype=_U) + _U(e - s)
    return mix(out) >> _U(1), out_ptr
