"""Word, hash and shingle tables over Arrow string columns, in numpy.

Everything here works on one Arrow batch inside an executor's Python worker. Batches are cut
into slices of about ``SLICE_BYTES`` of text, so the arrays stay small whatever the batch size;
a single longer text makes one longer slice.

Hashes are prefix-polynomial over bytes modulo 2**64 followed by a finaliser, so equal words get
equal hashes in every process (no ``PYTHONHASHSEED``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 21
BLOCK_BYTES = 1 << 20
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

#: Separators of raw words: the six ASCII white-space characters.
RAW_SEPARATORS = np.zeros(256, bool)
RAW_SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True
#: Separators of normalised words: every ASCII character that is no letter or digit.
PLAIN_SEPARATORS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 4096)
        steps = np.full(size, base, U64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=U64)
        if size <= 4 * BLOCK_BYTES:
            _powers[base] = have
    return have


@dataclass
class Words:
    """Words of a slice: byte ranges in ``data``, hashes, and row ``bounds`` (first word of each row)."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray
    rows: int

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.bounds))


def strings(column: pa.Array, lower: bool = False) -> pa.Array:
    """The column as large_string without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    return pc.utf8_lower(column) if lower else column


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a large_string array."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    got = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return got[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each part has at most ``limit`` bytes of text, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    total, start = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def hash_ranges(data: np.ndarray, starts: np.ndarray, *ends: np.ndarray) -> list[np.ndarray]:
    """64-bit hashes of the byte ranges from ``starts`` to each of ``ends``, worked off in blocks of bounded size.

    Ranges are ascending; the first of ``ends`` is the longest.
    """
    out = [np.empty(len(starts), U64) for _ in ends]
    i = 0
    while i < len(starts):
        s0 = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends[0], s0 + BLOCK_BYTES, side="right")))
        n = int(ends[0][j - 1]) - s0
        prefix = np.zeros(n + 1, U64)
        np.cumsum((data[s0 : s0 + n].astype(U64) + U64(1)) * _power(_BASE, n)[:n], out=prefix[1:])
        a = starts[i:j] - s0
        before, scale = prefix[a], _power(_INVERSE, n)[a]
        for got, end in zip(out, ends, strict=True):
            got[i:j] = (prefix[end[i:j] - s0] - before) * scale
        i = j
    return [mix(got ^ (end - starts).astype(U64)) for got, end in zip(out, ends, strict=True)]


def words(column: pa.Array, separators: np.ndarray = PLAIN_SEPARATORS, hashed: bool = True) -> Words:
    """Words of each row: maximal runs of bytes that are no separator. ``column`` comes from strings()."""
    data, at = raw(column)
    inside = ~separators[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[at] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    keep = inside[starts] if len(starts) else np.zeros(0, bool)
    starts, ends = starts[keep], ends[keep]
    got = hash_ranges(data, starts, ends)[0] if hashed else np.zeros(0, U64)
    return Words(data, starts, ends, got, np.searchsorted(starts, at), len(column))


def shingles(w: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each k consecutive words of a row, and the first shingle of each row (rows + 1).

    A row of 1 to k-1 words has one shingle of all its words; a row without words has none.
    """
    h, n = w.hashes, np.diff(w.bounds)
    short = (n > 0) & (n < k)
    per = np.where(n >= k, n - k + 1, short.astype(n.dtype))
    bounds = np.zeros(w.rows + 1, np.int64)
    np.cumsum(per, out=bounds[1:])
    row = np.repeat(np.arange(w.rows), per)
    first = np.arange(bounds[-1]) - bounds[:-1][row] + w.bounds[:-1][row]
    out = np.zeros(len(first), U64)
    long = ~short[row]
    base = first[long]
    got = np.zeros(len(base), U64)
    for j in range(k):
        got = got * U64(_BASE) + h[base + j]
    out[long] = got
    for r in np.flatnonzero(short):
        x = 0
        for y in h[w.bounds[r] : w.bounds[r + 1]].tolist():
            x = (x * _BASE + y) & (2**64 - 1)
        out[bounds[r]] = x ^ int(n[r])
    return mix(out), bounds


def window_hashes(h: np.ndarray, k: int, base: int = _BASE) -> np.ndarray:
    """Hash of each k consecutive entries of one array (row borders are the caller's business)."""
    if len(h) < k:
        return np.zeros(0, U64)
    got = np.zeros(len(h) - k + 1, U64)
    for j in range(k):
        got = got * U64(base) + h[j : j + len(got)]
    return mix(got)


def sequence_hash(h: np.ndarray, first: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """Hash of the sequences h[first:end]."""
    prefix = np.zeros(len(h) + 1, U64)
    np.cumsum(mix(h ^ U64(seed)) * _power(_BASE, len(h) + 1)[: len(h)], out=prefix[1:])
    return mix((prefix[end] - prefix[first]) * _power(_INVERSE, len(h) + 1)[first] + (end - first).astype(U64))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive entries, in log2(w) passes."""
    size = 1
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:]) if len(x) > size else x[:0]
        size *= 2
    rest = w - size
    return x if not rest else (np.minimum(x[:-rest], x[rest:]) if len(x) > rest else x[:0])


def group_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i+1]], zero for empty ranges."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.result_type(values.dtype, np.int64) if values.dtype.kind in "iub" else values.dtype)
    np.cumsum(values, axis=0, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
