"""Operator 1: best-fit packing of documents into fixed-length sequences.

A document is its token ids, as the ``tokenizers`` library gives them (a control
string of the vocabulary file becomes its id), and an end id.  One longer than the limit is cut
into pieces of exactly the limit, the remainder in front; full pieces are
sequences of their own.  The other pieces are packed by bounded-space online
best-fit: a bitset over the amounts of free space says which open sequences
there are, a piece goes to the one with the least free space that still holds
it, and where none does a new one opens; if the fixed number of open sequences
is reached, the fullest closes first.

Scale.  Tokenising is a map over the input.  Only one small row per document
(id, length, checksums) is shuffled, by a hash, so no key or source can make a
partition large, and every partition packs its rows by itself.  Pieces arrive
in windows of ``WINDOW`` documents, longest first, in hash order of the rows,
so the result depends on the rows and the partition count alone.

Edge cases.  Null and empty texts are the end id alone.  Rows repeated any
number of times are packed once each.  Null ids are packed like others.  An
empty table gives no row.  Other columns of the input are never read.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewgate.llm.bpe_tree import Codec

LIMIT, END_ID = 1024, 2       # fixed by the contract
OPEN, WINDOW = 8192, 8192
DOC_SCHEMA = "doc_id long, at long, n_tokens long, crcs array<long>"
SCHEMA = ("doc_id long, piece int, start long, length long, ids_crc32 long, "
          "sequence_id long, offset long")


def cuts(n: int, limit: int = LIMIT) -> list[int]:
    """Start positions of the pieces of ``n`` tokens, then ``n``."""
    first = n % limit or limit
    return [0, *range(first, n, limit), n] if n > limit else [0, n]


class OpenBins:
    """Open sequences by free space: a bitset of the amounts that occur."""

    def __init__(self, limit: int, most: int):
        self.limit, self.most = limit, most
        self.bits, self.by_free, self.n_open, self.n_bins = 0, [[] for _ in range(limit + 1)], 0, 0

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        b = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        self.n_open -= 1
        return b

    def place(self, size: int) -> tuple[int, int]:
        """(sequence, offset) for a piece of ``size`` <= limit tokens."""
        if size == self.limit:      # never open, so none closes for it
            self.n_bins += 1
            return self.n_bins - 1, 0
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1   # lowest amount that fits
            b = self._take(free)
        else:
            if self.n_open >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)   # the fullest closes
            b, free = self.n_bins, self.limit
            self.n_bins += 1
        left = free - size
        if left:
            self.by_free[left].append(b)
            self.bits |= 1 << left
            self.n_open += 1
        return b, self.limit - free


def piece_rows(documents: DataFrame, path: str, pattern: str, limit: int = LIMIT,
               end_id: int = END_ID) -> DataFrame:
    """One row per document: its length and the checksum of every piece."""
    def run(batches):
        import pyarrow as pa

        codec = Codec(path, pattern)
        at = TaskContext.get().partitionId() << 33
        tail = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                lengths, crcs = [], []
                for text in part.column("text"):
                    raw = codec.whole(text.as_py() or "").tobytes() + tail
                    edge = cuts(len(raw) // 4, limit)
                    lengths.append(len(raw) // 4)
                    crcs.append([zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(edge, edge[1:])])
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id").cast(pa.int64()),
                    "at": pa.array(range(at, at + len(lengths)), pa.int64()),
                    "n_tokens": pa.array(lengths, pa.int64()),
                    "crcs": pa.array(crcs, pa.list_(pa.int64()))})
                at += len(lengths)
    return documents.select("doc_id", "text").mapInArrow(run, DOC_SCHEMA)


def packer(limit: int, most: int, window: int):
    def run(batches):
        import pyarrow as pa

        bins = OpenBins(limit, most)
        base = TaskContext.get().partitionId() << 40
        waiting = []

        def flush():
            rows = []
            for n, doc, crcs in sorted(waiting, key=lambda w: -w[0] % limit):
                edge = cuts(n, limit)
                for k, crc in enumerate(crcs):
                    size = edge[k + 1] - edge[k]
                    b, offset = bins.place(size)
                    rows.append((doc, k, edge[k], size, crc, base + b, offset))
            waiting.clear()
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int32() if i == 1 else pa.int64())
                 for i, c in enumerate(columns)], names)

        names = [f.split()[0] for f in SCHEMA.split(", ")]
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in ("n_tokens", "doc_id", "crcs"))):
                waiting.append(row)
                if len(waiting) >= window:
                    yield flush()
        if waiting:
            yield flush()
    return run


def pack(documents: DataFrame, path: str, pattern: str, limit: int = LIMIT,
         end_id: int = END_ID, open_bins: int = OPEN, window: int = WINDOW) -> DataFrame:
    """Pack all documents; one row per piece (``SCHEMA``)."""
    rows = piece_rows(documents, path, pattern, limit, end_id)
    spread = rows.repartition("at").sortWithinPartitions(F.xxhash64("at"), "at")
    return spread.mapInArrow(packer(limit, open_bins, window), SCHEMA)
