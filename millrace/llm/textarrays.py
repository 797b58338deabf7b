"""Whole-batch text primitives on NumPy: one flat byte buffer for many documents, cut at document boundaries."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Odd base of the polynomial hashes (mod 2**64) and its inverse.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def slices(batches: Iterable[pa.RecordBatch], column: str, max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each slice holds at most ``max_bytes`` of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, first = np.cumsum(sizes), 0
        while first < len(sizes):
            base = ends[first] - sizes[first]
            last = max(int(np.searchsorted(ends, base + max_bytes, "right")), first + 1)
            yield batch.slice(first, last - first)
            first = last


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts back to back and the len+1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.string()), "")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def flat_binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """As ``flat``, for a binary column without nulls."""
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def powers(n: int, inverse: bool = False) -> np.ndarray:
    name = "inverse" if inverse else "forward"
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), BASE_INVERSE if inverse else BASE, U64)
        steps[0] = 1
        have = _powers[name] = np.multiply.accumulate(steps)
    return have[:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] = sum of (byte + 1) * BASE**position over positions i..j-1."""
    out = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers(len(data)), out=out[1:])
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection that spreads every input bit."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def words(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of non-break bytes, and the index of each document's first word (len+1)."""
    inside = ~breaks[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    at = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[at] = inside[at]
    at = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    ends[at] = inside[at]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, equal for equal content wherever it stands."""
    sums = prefix_hashes(data)
    h = (sums[ends] - sums[starts]) * powers(len(data) + 1, inverse=True)[starts]
    return mix(h ^ (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingle hashes of each document, back to back, and their len+1 offsets.

    ``data`` should be lower-cased. A document of 1..k-1 words has its whole word sequence as its one shingle; one
    without words has none.
    """
    starts, ends, first = words(data, offsets)
    count = np.diff(first)
    h = span_hashes(data, starts, ends) if len(starts) else np.zeros(0, U64)
    doc = np.repeat(np.arange(len(count)), count)
    n = len(h)
    place = np.arange(n) - np.repeat(first[:-1], count)
    size = np.minimum(k, np.repeat(count, count))
    begin = place + size <= np.repeat(count, count)
    acc = np.zeros(n, U64)
    for i in range(k):
        part = np.zeros(n, U64)
        part[: n - i] = h[i:] if i else h
        acc = np.where(size > i, mix(acc * U64(0xA0761D6478BD642F) + part + U64(1)), acc)
    acc, doc = acc[begin], doc[begin]
    order = np.lexsort((acc, doc))
    acc, doc = acc[order], doc[order]
    fresh = np.ones(len(acc), bool)
    fresh[1:] = (acc[1:] != acc[:-1]) | (doc[1:] != doc[:-1])
    acc, doc = acc[fresh], doc[fresh]
    return acc, np.searchsorted(doc, np.arange(len(count) + 1))
