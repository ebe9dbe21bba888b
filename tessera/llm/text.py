"""Words and hashes of whole Arrow batches of texts, with numpy on the bytes themselves.

Every function works on one flat byte buffer for many documents, so that the cost for each document
is a few array slices rather than Python objects for each word. Batches are cut into slices of about
``SLICE_BYTES``; a longer document forms a slice of its own, so memory follows the longest document.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 17
U = np.uint64

#: Byte classes: the spaces \x20 and \x09-\x0D, and everything else.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_seeded = np.random.Generator(np.random.PCG64(20240229))
_BYTES = _seeded.integers(1, 1 << 63, size=(2, 256), dtype=np.uint64) | U(1)
#: Odd multipliers of the two independent hash families, for bytes and for words.
_BASE = [0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95 | 1]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


class Words(NamedTuple):
    """Words of consecutive documents: byte spans, and the first word of each document."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def count(self) -> np.ndarray:
        return np.diff(self.first)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit value over all bits."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def powers(n: int, family: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the family's multiplier and of its inverse modulo 2**64, at least ``n``."""
    have = _powers.get(family)
    if have is None or len(have[0]) < n:
        size = max(n, SLICE_BYTES + (1 << 18))
        out = []
        for base in (_BASE[family], pow(_BASE[family], -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = _powers[family] = (out[0], out[1])
    return have


def span_hash(
    values: np.ndarray, start: np.ndarray, end: np.ndarray, family: int = 0
) -> np.ndarray:
    """64-bit hash of ``values[start:end]`` for many spans, from one running sum."""
    up, down = powers(len(values) + 1, family)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``SLICE_BYTES``: first row, end row, bytes, byte offsets of the rows.

    Null texts count as empty.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    kind = np.dtype(np.int64 if wide else np.int32)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, kind, n + 1, texts.offset * kind.itemsize).astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(at, at[lo] + SLICE_BYTES, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, flat[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray | None = None) -> Words:
    """Maximal runs of bytes that are no spaces, never across documents.

    ``kinds`` gives a class to each byte value, 0 for spaces; a word then also ends where the
    class changes.
    """
    n = len(data)
    kind = (~SPACE[data]).view(np.uint8) if kinds is None else kinds[data]
    edge = np.empty(n + 1, bool)
    edge[0] = edge[n] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:n])
    edge[offsets] = True
    at = np.flatnonzero(edge)
    start, end = at[:-1], at[1:]
    solid = kind[start] > 0 if n else np.zeros(0, bool)
    start, end = (start[solid], end[solid]) if n else (at[:0], at[:0])
    return Words(data, start, end, np.searchsorted(start, offsets, side="left"))


def word_hash(w: Words, family: int = 0, lower: bool = False) -> np.ndarray:
    """One 64-bit hash for each word; ``lower`` folds A-Z."""
    data = LOWER[w.data] if lower else w.data
    return span_hash(_BYTES[family][data], w.start, w.end, family)


def windows(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Start words of all windows of ``size`` words, and the first window of each document."""
    counts = np.maximum(np.diff(first) - size + 1, 0)
    ends = np.zeros(len(first), np.int64)
    np.cumsum(counts, out=ends[1:])
    start = np.arange(ends[-1]) + np.repeat(first[:-1] - ends[:-1], counts)
    return start, ends


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
