"""Shared text kernels for Arrow tasks: document slices, word hashes, small column helpers.

A word is a run of bytes other than space and \\t \\n \\v \\f \\r, with A-Z lower-cased. Words
are identified by a 64-bit polynomial hash (random byte values, odd multiplier), computed
for a whole slice of documents with a few numpy passes over its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACES = b" \t\n\x0b\x0c\r"
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[list(SPACES)] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_rng = np.random.Generator(np.random.PCG64(20240117))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE = _BYTE[LOWER]
_R = 0x9E3779B97F4A7C15
_RINV = pow(_R, -1, 2**64)
_powers: dict[str, np.ndarray] = {}

SLICE_BYTES = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finalizer, element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _pow(base: int, name: str, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 65536)
        out = np.full(size, base, dtype=np.uint64)
        out[0] = 1
        have = _powers[name] = np.multiply.accumulate(out)
        if size > 4 * SLICE_BYTES:  # one huge word: don't keep its table
            _powers.pop(name)
    return have


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The text column as a plain string array, nulls as empty texts."""
    col = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_dictionary(col.type):
        col = col.dictionary_decode()
    return col.cast(pa.large_string()).fill_null("")


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a large_string array without a copy; offsets has len(col)+1."""
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[col.offset:col.offset + len(col) + 1]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return (np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0])


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about ``limit`` bytes (one longer document stands alone)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def _cuts(data: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Cut bytes into ranges of about ``limit``, only next to white space."""
    s, n = 0, len(data)
    while s < n:
        e = min(s + limit, n)
        while e < n:
            gap = np.flatnonzero(~IS_WORD[data[e:e + limit]])
            if len(gap):
                e += int(gap[0])
                break
            e = min(e + limit, n)
        yield s, e
        s = e


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, first): word hashes and byte ranges; ``first[d]:first[d+1]`` are the
    words of document d. ``offsets`` are the documents' byte offsets into ``data``."""
    hs, ss, es = [], [], []
    edge = offsets[1:-1]
    for a, b in _cuts(data, SLICE_BYTES):
        x = data[a:b]
        inside = IS_WORD[x]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        own = edge[(edge >= a) & (edge < b)] - a
        if len(own):
            begin[own] = inside[own]
        stop = np.zeros(len(x) + 1, dtype=bool)
        stop[1:] = inside
        stop[1:-1] &= ~inside[1:]
        if len(own):
            stop[own] = np.where(own > 0, inside[own - 1], False)
        s, e = np.flatnonzero(begin), np.flatnonzero(stop)
        acc = np.empty(len(x) + 1, dtype=np.uint64)
        acc[0] = 0
        np.cumsum(_BYTE[x] * _pow(_R, "up", len(x))[:len(x)], out=acc[1:])
        h = (acc[e] - acc[s]) * _pow(_RINV, "down", len(x))[s]
        hs.append(mix64(h + (e - s).astype(np.uint64)))
        ss.append(s + a)
        es.append(e + a)
    if not hs:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, np.zeros(len(offsets), np.int64)
    start = np.concatenate(ss)
    return np.concatenate(hs), start, np.concatenate(es), np.searchsorted(start, offsets)


def with_columns(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    """Replace or append columns; a column of the same name is replaced."""
    names, cols = list(batch.schema.names), list(batch.columns)
    for k, v in new.items():
        if k in names:
            cols[names.index(k)] = v
        else:
            names.append(k)
            cols.append(v)
    return pa.RecordBatch.from_arrays(cols, names=names)
