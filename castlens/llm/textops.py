"""Vectorised text helpers that run inside Arrow tasks (numpy over UTF-8 buffers, no per-word Python).

A word is a maximal run of bytes other than space and 0x09-0x0D, the pattern
``[^\\x20\\x09-\\x0D]+`` on the decoded text. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20      # texts are worked on in runs of about this many bytes; one long text is its own run
PIECE = 1 << 19            # byte-level arrays are made for this many bytes at a time

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_MUL = 0x9E3779B97F4A7C15
_M64 = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & _M64, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_INV = pow(_MUL, -1, 1 << 64)
_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _pow_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = PIECE
    while size < n:
        size *= 2
    if size not in _POW:
        _POW.clear()
        _POW[size] = (_powers(_MUL, size + 1), _powers(_INV, size + 1))
    return _POW[size]


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), applied elementwise."""
    h = h ^ np.uint64(seed & _M64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and where each begins (n + 1 offsets)."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    arr = arr.cast(pa.large_string())
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset:arr.offset + len(arr) + 1]
    raw = arr.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def runs(data: np.ndarray, off: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last + 1, bytes, offsets) of runs of whole texts of at most ``limit`` bytes, or one longer text."""
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield i, j, data[off[i]:off[j]], off[i:j + 1] - off[i]
        i = j


def spans(keep: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of True, cut at the offsets."""
    if not len(keep):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start, end = keep.copy(), keep.copy()
    start[1:] &= ~keep[:-1]
    end[:-1] &= ~keep[1:]
    inner = off[1:-1][off[1:-1] < len(keep)]
    start[inner] = keep[inner]
    before = inner[inner > 0] - 1
    end[before] = keep[before]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends of the words, and the number of words before each text (n + 1)."""
    ws, we = spans(~SPACE[data], off)
    return ws, we, np.searchsorted(ws, off)


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans are sorted and do not overlap. Equal bytes give equal hashes."""
    out = np.zeros(len(start), dtype=np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + PIECE, side="right")))
        a, b = int(start[i]), int(end[j - 1])
        power, inverse = _pow_tables(b - a)
        total = np.zeros(b - a + 1, dtype=np.uint64)
        np.cumsum((data[a:b].astype(np.uint64) + np.uint64(1)) * power[:b - a], out=total[1:])
        s, e = start[i:j] - a, end[i:j] - a
        out[i:j] = (total[e] - total[s]) * inverse[s]
        i = j
    return mix(out)


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words and the number of shingles before each text.

    A text of 1 to k - 1 words has one shingle, of all its words; one without words has none.
    """
    n = len(h)
    count = np.diff(first)
    per = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    before = np.concatenate(([0], np.cumsum(per)))
    doc = np.repeat(np.arange(len(count)), per)
    at = first[:-1][doc] + (np.arange(before[-1]) - before[:-1][doc])
    size = np.minimum(count, k)[doc]
    out = size.astype(np.uint64)
    for i in range(k):
        there = i < size
        out = np.where(there, mix(out * np.uint64(_MUL) + h[np.minimum(at + i, max(n - 1, 0))]) if n else out, out)
    return out, before


def distinct_per_text(h: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text, and how many there are before each text."""
    doc = np.repeat(np.arange(len(before) - 1), np.diff(before))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.searchsorted(doc[new], np.arange(len(before)))


def minhash(h: np.ndarray, before: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Signatures: for each text and permutation (a*x + b) mod 2^64, the upper 32 bits of the least value.

    Texts without values get the greatest value everywhere.
    """
    n = len(before) - 1
    out = np.full((n, len(a)), 0xFFFFFFFF, dtype=np.uint32)
    full = np.flatnonzero(np.diff(before) > 0)
    if len(full):
        at = before[:-1][full]
        for k in range(len(a)):
            v = h * a[k]
            v += b[k]
            v >>= np.uint64(32)
            out[full, k] = np.minimum.reduceat(v.astype(np.uint32), at)
    return out


def permutations(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and increments of n universal hash functions, from a seed."""
    x = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(_MUL), seed)
    return x[:n] | np.uint64(1), x[n:]


def code_points(data: np.ndarray) -> np.ndarray:
    """Number of code points before each byte (n + 1)."""
    out = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def groups(batches, keys: list[str]) -> Iterator[pa.Table]:
    """The groups of equal keys of a stream of record batches in which each group's rows stand together."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in cols:
            v = c.to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        cut = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            key = tuple(c[a].as_py() for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def whole_groups(batches, keys: list[str], rows: int = 4000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of a stream in which each group's rows stand together, and where groups begin.

    Tables hold ``rows`` rows or more (but for the last), so small groups are worked on many at a time.
    """
    held: list[pa.RecordBatch] = []
    count = 0

    def cuts(t: pa.Table) -> np.ndarray:
        change = np.ones(t.num_rows, dtype=bool)
        change[1:] = False
        for k in keys:
            v = t.column(k).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        return np.append(np.flatnonzero(change), t.num_rows)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count >= rows:
            t = pa.Table.from_batches(held).combine_chunks()
            at = cuts(t)
            if len(at) > 2:
                yield t.slice(0, int(at[-2])), at[:-1]
                held = t.slice(int(at[-2])).to_batches()
                count = t.num_rows - int(at[-2])
            else:
                held = t.to_batches()
    if count:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, cuts(t)


def fixed(col: pa.ChunkedArray, dtype) -> tuple[np.ndarray, np.ndarray]:
    """Values of a binary column that holds packed numbers, one row after another, and the offsets in values."""
    arr = pa.chunked_array(col).combine_chunks() if not isinstance(col, pa.ChunkedArray) else col.combine_chunks()
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], pa.large_binary())
    arr = arr.cast(pa.large_binary())
    size = np.dtype(dtype).itemsize
    off = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset:arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, np.int64)
    raw = arr.buffers()[2] if len(arr) else None
    data = np.frombuffer(raw, dtype=np.uint8)[off[0]:off[-1]] if raw is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data.view(dtype), (off - off[0]) // size


def pack(values: np.ndarray, before: np.ndarray) -> pa.Array:
    """The reverse of ``fixed``: one binary value of packed numbers for each range of values."""
    size = values.dtype.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(before) - 1,
                                 [None, pa.py_buffer((before * size).astype(np.int64).tobytes()),
                                  pa.py_buffer(np.ascontiguousarray(values).tobytes())]).cast(pa.binary())


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index reachable from each of n nodes over the links (a, b)."""
    label = np.arange(n)
    while True:
        was = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == was).all():
            return label
