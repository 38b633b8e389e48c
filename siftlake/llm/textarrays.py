"""Words, shingles and hashes of many texts at once: numpy arrays over the UTF-8 bytes of an Arrow column.

A word is a run of bytes other than space and \\x09-\\x0D, with A-Z lower-cased. All hashes are 64 bits wide.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are looked at together; the arrays over them take some fifty times as much.
LIMIT = 1 << 19
SHINGLE = 5
BASE, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
STEP = np.uint64(0xD6E8FEB86659FD93)
EMPTY = np.zeros(0, np.uint64)

_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
#: Word bytes if words are letters and digits: ASCII ones and all beyond ASCII.
ALNUM = np.ones(256, bool)
ALNUM[0:128] = False
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0, base ** 1, ... modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(1 << max(16, (n - 1).bit_length()), base, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps)
        if len(have) <= 8 * LIMIT:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of each value (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and where each begins; null is an empty text."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def ranges(offsets: np.ndarray, limit: int = LIMIT) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most `limit` bytes; a longer text stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, hi
        lo = hi


class Words(NamedTuple):
    """hashes of the words of a row range; first[i] to first[i + 1] are those of row i."""

    hashes: np.ndarray
    first: np.ndarray


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """sums[i]: polynomial hash of buf[:i], not yet shifted to its place."""
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(buf)), out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes from each start to its end; equal bytes have equal hashes wherever they stand."""
    h = (sums[ends] - sums[starts]) * powers(INVERSE, len(sums))[starts]
    return mix(h + (ends - starts).astype(np.uint64) * STEP)


def laid_out(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts of rows lo to hi with one space before, between and after them, and where each begins."""
    lengths = offsets[lo + 1 : hi + 1] - offsets[lo:hi]
    at = 1 + np.concatenate([[0], np.cumsum(lengths + 1)])
    buf = np.full(at[-1], 32, np.uint8)
    for a, s, e in zip(at.tolist(), offsets[lo:hi].tolist(), offsets[lo + 1 : hi + 1].tolist(), strict=False):
        buf[a : a + e - s] = data[s:e]
    return buf, at


def word_bounds(buf: np.ndarray, letters: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray]:
    inside = letters[buf]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    return edges[0::2], edges[1::2]


def words(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int, letters: np.ndarray = _WORD) -> Words:
    """Word hashes of rows lo to hi. A text beyond the limit is read piece by piece, cut between words."""
    if hi - lo == 1 and offsets[hi] - offsets[lo] > LIMIT:
        hashes = [_words(data, np.array(cut), 0, 1, letters).hashes for cut in _cuts(data, int(offsets[lo]), int(offsets[hi]))]
        every = np.concatenate(hashes)
        return Words(every, np.array([0, len(every)]))
    return _words(data, offsets, lo, hi, letters)


def _cuts(data: np.ndarray, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    while lo < hi:
        end = min(hi, lo + LIMIT)
        while end < hi and _WORD[data[end]]:
            step = np.flatnonzero(~_WORD[data[end : min(hi, end + LIMIT)]])
            end = min(hi, end + (int(step[0]) if len(step) else LIMIT))
        yield lo, end
        lo = end


def _words(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int, letters: np.ndarray) -> Words:
    buf, at = laid_out(data, offsets, lo, hi)
    buf = _LOWER[buf]
    starts, ends = word_bounds(buf, letters)
    return Words(span_hashes(prefix_sums(buf), starts, ends), np.searchsorted(starts, at))


def shingles(w: Words, size: int = SHINGLE) -> Words:
    """Hashes of each run of `size` words; a text of fewer words gives its whole sequence, one without words none."""
    n = np.diff(w.first)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(n.dtype))
    first = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(first[-1], np.uint64)
    h = w.hashes
    if len(h) >= size:
        runs = np.zeros(len(h) - size + 1, np.uint64)
        for k in range(size):
            runs = runs * STEP + h[k : len(h) - size + 1 + k]
        keep = np.zeros(len(runs), bool)
        ids = np.arange(len(runs))
        keep = ids + size <= np.repeat(w.first[1:], n)[: len(runs)]
        long = np.repeat(n >= size, count)
        out[long] = runs[keep]
    for i in np.flatnonzero((n > 0) & (n < size)).tolist():
        acc = 0
        for x in h[w.first[i] : w.first[i + 1]].tolist():
            acc = (acc * int(STEP) + x) & (2**64 - 1)
        out[first[i]] = (acc + int(n[i])) & (2**64 - 1)
    return Words(mix(out), first)


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = raw(column)
    for lo, hi in ranges(offsets):
        s = shingles(words(data, offsets, lo, hi))
        for a, b in zip(s.first[:-1].tolist(), s.first[1:].tolist(), strict=True):
            x = np.sort(s.hashes[a:b])
            yield x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) > 1 else x


def arrays(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column of numpy arrays."""
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=kind))
