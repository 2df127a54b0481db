"""Vectorised word and shingle kernels over Arrow text columns.

Texts are handled as UTF-8 bytes in slabs of bounded size, so that a batch of
any length needs a bounded amount of working memory; only a single text that
is larger than a slab makes its slab larger.  Words are runs of bytes outside
``[\\x20\\x09-\\x0D]`` after A-Z have been lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

SLAB_BYTES = 1 << 21
_MUL = np.uint64(0x9E3779B97F4A7C15)
_SHINGLE_MUL = 0xD6E8FEB86659FD93
#: Spans of more bytes than this are hashed one by one, shorter ones eight bytes at a time side by side.
_SHORT = 64

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_IS_TEXT = ~_IS_SPACE


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


_LOW_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that every bit of a hash depends on all of it."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


@dataclass
class Slab:
    """Whole texts side by side: ``data[bounds[i]:bounds[i + 1]]`` is text ``first + i`` of the batch."""

    first: int
    data: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1


def as_text(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One array of strings with nulls made empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


def slabs(column: pa.Array, limit: int = SLAB_BYTES) -> Iterator[Slab]:
    """The texts of a column, in order, by slabs of about ``limit`` bytes."""
    text = as_text(column)
    n = len(text)
    if not n:
        return
    _, offsets, data = text.buffers()
    bounds = np.frombuffer(offsets, np.int64)[text.offset : text.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + limit, "right")) - 1)
        j = min(j, n)
        yield Slab(i, raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
        i = j


def span_digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold_case: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes of byte spans, as two numbers each; equal bytes give equal hashes wherever they stand.

    Every eight bytes are taken in by a mixing step, so that no pattern of bytes cancels out, as it would in a
    polynomial modulo a power of two.  The first numbers alone are 64-bit hashes.
    """
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = LOWER[data] if fold_case else data
    eight = np.ndarray(len(data) + 1, "<u8", padded.data, 0, (1,))  # the eight bytes from each place on
    size = ends - starts
    x = mix(size.astype(np.uint64))
    y = x * np.uint64(_SHINGLE_MUL)
    for at in range(0, _SHORT, 8):
        row = np.flatnonzero((size > at) & (size <= _SHORT)) if at else slice(None)
        if at and not len(row):
            break
        part = eight[starts[row] + at * (size[row] > at)] & _LOW_BYTES[np.clip(size[row] - at, 0, 8)]
        x[row], y[row] = mix(x[row] ^ part), mix(y[row] + part * _MUL)
    for i in np.flatnonzero(size > _SHORT).tolist():
        whole = xxhash.xxh3_128_intdigest(padded.data[starts[i] : ends[i]])
        x[i], y[i] = whole & 0xFFFFFFFFFFFFFFFF, whole >> 64
    return x, y


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold_case: bool = True) -> np.ndarray:
    """64-bit hashes of byte spans."""
    return span_digests(data, starts, ends, fold_case)[0]


@dataclass
class Words:
    """Word spans of a slab; those of text i are ``first[i]:first[i + 1]``."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def words(slab: Slab) -> Words:
    data, bounds = slab.data, slab.bounds
    if not len(data):
        return Words(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64))
    inside = _IS_TEXT[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return Words(starts, ends, np.searchsorted(starts, bounds))


def _rolled(word_hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words, not yet mixed."""
    n = max(0, len(word_hashes) - width + 1)
    out = np.zeros(n, np.uint64)
    for j in range(width if n else 0):
        out += word_hashes[j : j + n] * np.uint64(pow(_SHINGLE_MUL, j + 1, 2**64))
    return out


def short_text_hashes(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """For every run of n words, the shingle that a text of just these words has where shingles are longer."""
    return mix(_rolled(word_hashes, n) + np.uint64(n))


def shingle_hashes(word_hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``width``-word shingles of each text, and where each text's begin.

    A text with words but fewer than ``width`` of them has one shingle: all its words.
    """
    counts = np.diff(first)
    short = np.flatnonzero((counts > 0) & (counts < width))
    n = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    out_first = np.concatenate(([0], np.cumsum(n)))
    rolled = _rolled(word_hashes, width)
    total = int(out_first[-1])
    out = np.empty(total, np.uint64)
    if total:
        owner = np.repeat(np.arange(len(n)), n)
        at = first[:-1][owner] + (np.arange(total) - out_first[:-1][owner])
        full = counts[owner] >= width
        out[full] = rolled[at[full]]
    for i in short:
        own = word_hashes[first[i] : first[i + 1]]
        out[out_first[i]] = (_rolled(own, len(own)) + np.uint64(len(own)))[0]
    return mix(out), out_first
