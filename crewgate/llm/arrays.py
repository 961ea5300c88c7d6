"""Whole batches of texts as NumPy arrays: bytes, words, lines, hashes.

A word is a run of bytes other than space and \\t \\n \\v \\f \\r.  All counts
and hashes are computed over the concatenated UTF-8 bytes of a slice of
documents, never text by text.
"""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix64(x):
    """Finaliser of splitmix64 (public domain): a bijection on 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_TABLES: dict = {}


def powers(n: int, base=BASE):
    """base^0 .. base^(n-1) modulo 2^64; a view of a table that grows as needed."""
    p = _TABLES.get(int(base))
    if p is None or len(p) < n:
        p = np.full(max(1 << (max(n, 2) - 1).bit_length(), 1024), base, dtype=np.uint64)
        p[0] = 1
        p = _TABLES[int(base)] = np.multiply.accumulate(p, dtype=np.uint64)
    return p[:n]


def byte_class(chars: bytes):
    t = np.zeros(256, dtype=bool)
    t[np.frombuffer(chars, dtype=np.uint8)] = True
    return t


SPACE = byte_class(b" \t\n\v\f\r")
HEAD = np.array([(b & 0xC0) != 0x80 for b in range(256)])  # first byte of a code point


def text_bytes(column):
    """(bytes, offsets) of an Arrow string column; null counts as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column, "").cast(pa.large_binary())
    off = np.frombuffer(column.buffers()[1], dtype=np.int64)[
        column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def per_doc(values, offsets):
    """Sums of ``values`` (one per byte) per document."""
    c = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return c[offsets[1:]] - c[offsets[:-1]]


def segment_hash(data, start, end):
    """64-bit hash of each byte range [start, end): a polynomial in an odd base,
    from prefix sums over all bytes, divided by the power at its start."""
    if not len(start):
        return np.zeros(0, np.uint64)
    total = np.zeros(len(data) + 1, np.uint64)
    x = data.astype(np.uint64)
    x += np.uint64(1)
    x *= powers(len(data))
    np.cumsum(x, out=total[1:])
    h = total[end] - total[start]
    h *= powers(len(data), INVERSE)[start]
    return mix64(h + (end - start).astype(np.uint64))


def words(data, offsets):
    """(start, end, document) of every word; a word never spans two documents."""
    solid = ~SPACE[data]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    stop = solid.copy()
    stop[:-1] &= ~solid[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    begin[edge] = solid[edge]          # a document's first byte starts a word
    stop[edge - 1] = solid[edge - 1]   # and the byte before it ends one
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    doc = np.searchsorted(offsets, start, side="right") - 1
    return start, end, doc


def lines(data, offsets):
    """(start, end, document) of the non-empty pieces between \\n bytes."""
    cut = np.flatnonzero(data == 10)
    start = np.unique(np.concatenate([offsets[:-1], cut + 1]))
    start = start[start < len(data)]
    end = np.concatenate([start[1:], [len(data)]])
    if len(start):
        end = np.where(data[end - 1] == 10, end - 1, end)
    keep = end > start
    start, end = start[keep], end[keep]
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def windows(hashes, doc, n: int):
    """(position, hash) of every run of ``n`` words inside one document."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    p = powers(n)
    h = np.zeros(m, np.uint64)
    for i in range(n):
        h += hashes[i:i + m] * p[i]
    at = np.flatnonzero(doc[:m] == doc[n - 1:])
    return at, mix64(h[at])


def repeated(doc, key):
    """Mask of the entries whose (doc, key) occurs more than once, and of those
    equal to an earlier entry."""
    n = len(key)
    both, later = np.zeros(n, bool), np.zeros(n, bool)
    if n:
        order = np.lexsort((key, doc))
        same = (key[order][1:] == key[order][:-1]) & (doc[order][1:] == doc[order][:-1])
        both[order[1:]] |= same
        both[order[:-1]] |= same
        later[order[1:]] = same   # lexsort is stable: the first of equals comes first
    return both, later


def covered(at, n: int, total: int):
    """Mask of the ``total`` positions inside any window [p, p + n), p in ``at``."""
    d = np.zeros(total + 1, np.int64)
    np.add.at(d, at, 1)
    np.add.at(d, at + n, -1)
    return np.cumsum(d[:-1]) > 0
