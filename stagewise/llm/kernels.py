"""Vectorised text kernels on the UTF-8 bytes of Arrow string columns.

All word definitions of this subpackage cut at ASCII characters only, so they
can be evaluated on bytes: no byte of a multi-byte character is below 0x80.
Texts are processed whole, in slices of a bounded number of bytes; a text that
is larger than the bound makes a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes that belong to a word: all but white space, and letters and digits with all non-ASCII characters.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_ODD = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_ODD, -1, 1 << 64)
_TABLE = np.random.Generator(np.random.PCG64(20240517)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_POW = {}


def _pow(base: int, n: int) -> np.ndarray:
    have = _POW.get(base)
    if have is None or len(have) < n:
        have = _powers(base, max(n, (1 << 18) + 1))
        if len(have) <= (1 << 19):
            _POW[base] = have
    return have[:n]


def powers(inverse: bool, n: int) -> np.ndarray:
    """The first n powers of the base of range hashes, or of its inverse."""
    return _pow(_INVERSE if inverse else _ODD, n)


def slices(col: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of ``col`` with at most ``limit`` bytes of text, one row at least."""
    if not len(col):
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(size):
        base = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, base + limit, side="right")))
        yield at, end
        at = end


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null reads as empty."""
    col = pc.fill_null(col, "")
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    offsets = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(buf: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each row the number of words before it (one more entry at the end)."""
    inside = np.zeros(len(buf) + 1, dtype=bool)
    inside[:-1] = member[buf]
    first = np.zeros(len(buf) + 1, dtype=bool)
    first[offsets] = True
    before = np.zeros(len(buf) + 1, dtype=bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (first | ~before))
    ends = np.flatnonzero(before & (first | ~inside))
    return starts, ends, np.searchsorted(starts, offsets)


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0, piece: int = 1 << 18) -> np.ndarray:
    """64-bit hashes of byte ranges in ascending order: differences of prefix sums of table values times powers."""
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        end = max(at + 1, int(np.searchsorted(ends, base + piece, side="right")))
        span = buf[base : int(ends[end - 1])]
        total = np.zeros(len(span) + 1, dtype=np.uint64)
        np.cumsum(_TABLE[span] * _pow(_ODD, len(span)), out=total[1:])
        s = starts[at:end] - base
        out[at:end] = (total[ends[at:end] - base] - total[s]) * _pow(_INVERSE, len(span) + 1)[s]
        at = end
    return mix(out ^ np.uint64(seed))


def word_hashes(col: pa.Array, member: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of a string column, and word offsets by row."""
    buf, offsets = utf8(col)
    buf = LOWER[buf]
    starts, ends, rows = word_spans(buf, offsets, member)
    return hash_spans(buf, starts, ends, seed), rows


def word_counts(col: pa.Array, member: np.ndarray) -> np.ndarray:
    """Number of words in each row."""
    out = [np.zeros(0, np.int64)]
    for a, b in slices(col):
        buf, offsets = utf8(col.slice(a, b - a))
        out.append(np.diff(word_spans(buf, offsets, member)[2]))
    return np.concatenate(out).astype(np.int64)
