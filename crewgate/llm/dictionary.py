"""Distinct-word exchange: texts as word positions, every distinct word once.

Texts are split into words and written as positions into the word list of a
block (some MB of text).  The list itself is dealt to buckets by a hash of the
word, so that all blocks' copies of a word meet in one task and each distinct
word is worked on once in the whole corpus; the answers return to the blocks,
where the positions put them back into every text.  However often a word
occurs, it crosses the exchange once per block, so no word is a hot key.

``code`` makes the block rows, ``answer`` works on the buckets, ``rejoin`` puts
block rows and answers together.  The rows go through two exchanges in one
plan, with nothing written in between; a lost task recomputes its own rows
alone, and block numbers follow from the input partition.  Rows (``SCHEMA``)
hold, by ``kind``:

  TEXTS    doc ids, flags, word counts and word positions of some documents
  PAGE     the words of one bucket (``seq``) in a block, with their places
  ANSWER   what a bucket replied to a page
  SUMMARY  what a bucket has to say about its words, for no block

Buffers are compressed arrays.  A position is 0 for a word's first occurrence in
its block (the next place in the list) and its place + 1 otherwise.
"""

from __future__ import annotations

import itertools
import zlib
from collections import defaultdict

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewgate.llm.common import slices

TEXTS, PAGE, ANSWER, SUMMARY = 0, 1, 2, 3
SCHEMA = ("kind int, block long, seq long, doc_ids array<long>, flags binary, counts binary, "
          "payload binary")
BLOCK_BYTES = 12 << 20


def squeeze(*arrays) -> bytes:
    """Arrays as one compressed buffer; 32-bit ones are split into two planes of bytes."""
    import zstandard

    out = []
    for a in arrays:
        if isinstance(a, bytes):
            raw = a
        else:
            a = np.ascontiguousarray(a, dtype="<u4").view("u1").reshape(-1, 4)
            raw = np.ascontiguousarray(a.T).tobytes()
        out += [np.array([len(raw)], "<u8").tobytes(), raw]
    return zstandard.ZstdCompressor(level=9).compress(b"".join(out))


def unsqueeze(blob: bytes) -> list:
    """The buffers of ``squeeze`` as bytes; ``numbers`` turns one into an array."""
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    out, at = [], 0
    while at < len(raw):
        n = int.from_bytes(raw[at:at + 8], "little")
        out.append(raw[at + 8:at + 8 + n])
        at += 8 + n
    return out


def numbers(raw: bytes):
    planes = np.frombuffer(raw, "u1").reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


ESCAPE = 192


def short(codes):
    """Codes as bytes: one for those under ``ESCAPE``; for the others an escape byte
    that holds the bits from 16 up, the two bytes below in planes of their own, and
    in a last buffer the upper bits that the escape byte cannot hold."""
    wide = codes >= ESCAPE
    rest = codes[wide] - ESCAPE
    top = np.minimum(rest >> 16, 255 - ESCAPE)
    one = codes.copy()
    one[wide] = ESCAPE + top
    return [x.astype("u1").tobytes() for x in (one, (rest >> 8) & 255, rest & 255)] + [
        (rest >> 16)[top == 255 - ESCAPE].astype("<u4").tobytes()]


def long(buffers):
    """The codes of ``short``."""
    codes = np.frombuffer(buffers[0], "u1").astype(np.int64)
    wide = codes >= ESCAPE
    top = codes[wide] - ESCAPE
    top[top == 255 - ESCAPE] = np.frombuffer(buffers[3], "<u4")
    codes[wide] = ESCAPE + (top << 16) + (
        np.frombuffer(buffers[1], "u1").astype(np.int64) << 8) + np.frombuffer(buffers[2], "u1")
    return codes


def to_batch(kind, block, seq, doc_ids=None, flags=None, counts=None, payload=None):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([
        pa.array([kind], pa.int32()), pa.array([block], pa.int64()), pa.array([seq], pa.int64()),
        pa.array([doc_ids], pa.list_(pa.int64())), pa.array([flags], pa.binary()),
        pa.array([counts], pa.binary()), pa.array([payload], pa.binary())],
        ["kind", "block", "seq", "doc_ids", "flags", "counts", "payload"])


class Block:
    """The word list of a block while its documents are read."""

    def __init__(self, number: int, buckets: int):
        self.number, self.buckets = number, buckets
        self.places = defaultdict(itertools.count().__next__)   # next place for a new word
        self.bytes, self.seq = 0, 0
        self.counted = []        # positions in documents whose words count

    def texts(self, doc_ids, flags, split_texts):
        size, counts, at = len(self.places), [], []
        for words in split_texts:
            at.append(np.fromiter(map(self.places.__getitem__, words), np.int64, len(words)))
            counts.append(len(words))
        at = np.concatenate(at)
        seen = np.maximum.accumulate(np.concatenate([[size - 1], at]))[:-1]
        if flags is not None:
            self.counted.append(at[np.repeat(np.asarray(flags, bool), counts)])
        self.seq += 1
        return to_batch(TEXTS, self.number, self.seq, doc_ids,
                        None if flags is None else bytes(flags),
                        np.array(counts, "<u4").tobytes(),
                        squeeze(*short(np.where(at > seen, 0, at + 1))))

    def pages(self):
        """One batch per bucket: places, lengths and bytes of the words, and how
        often each occurs in the documents that count."""
        words = [w if isinstance(w, bytes) else w.encode() for w in self.places]
        bucket = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % self.buckets
        often = None
        if self.counted:
            often = np.bincount(np.concatenate(self.counted), minlength=len(words))
        order = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        for b, (lo, hi) in enumerate(zip(cut, cut[1:])):
            if lo < hi:
                at = order[lo:hi]
                own = [words[i] for i in at.tolist()]
                arrays = [np.diff(at, prepend=0), np.fromiter(map(len, own), "<u4", len(own)),
                          b"".join(own)]
                yield to_batch(PAGE, self.number, b, payload=squeeze(
                    *arrays, *([] if often is None else [often[at]])))


def code(documents: DataFrame, split, buckets: int, flagged: bool = False,
         block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Block rows of ``documents`` (doc_id, text and, if ``flagged``, flag).

    ``split`` turns a text into its list of words (str or bytes).
    """
    def run(batches):
        number = TaskContext.get().partitionId() << 33
        block = Block(number, buckets)
        for batch in batches:
            for part in slices(batch, limit=1 << 20):
                texts = [t or "" for t in part.column("text").to_pylist()]
                flags = part.column("flag").to_pylist() if flagged else None
                yield block.texts(part.column("doc_id").to_pylist(), flags, map(split, texts))
                block.bytes += sum(map(len, texts))
                if block.bytes >= block_bytes:
                    yield from block.pages()
                    number += 1
                    block = Block(number, buckets)
        yield from block.pages()
    return documents.select("doc_id", "text", *(["flag"] if flagged else [])) \
        .mapInArrow(run, SCHEMA)


class Page:
    """A decoded page: block, places, words and counts."""

    def __init__(self, block: int, payload: bytes):
        self.block = block
        arrays = unsqueeze(payload)
        self.places = np.cumsum(numbers(arrays[0]).astype(np.int64))
        ends = np.cumsum(numbers(arrays[1]).astype(np.int64))
        starts, raw = ends - numbers(arrays[1]), arrays[2]
        self.words = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        self.often = numbers(arrays[3]) if len(arrays) > 3 else None


def answer(coded: DataFrame, work) -> DataFrame:
    """Pages dealt to their buckets and replaced by answers; other rows pass.

    ``work(bucket, pages)`` gets all (block, payload) of one bucket and yields
    (kind, block, payload) rows.
    """
    def run(batches):
        bucket, pages = None, []

        def replies():
            for kind, block, payload in work(bucket, pages):
                yield to_batch(kind, block, bucket, payload=payload)

        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            n = int(np.searchsorted(kinds, PAGE))       # rows are sorted by kind
            if n:
                yield batch.slice(0, n)
            rest = batch.slice(n)
            payloads = rest.column("payload")       # taken row by row: a batch may be large
            for k, (b, block) in enumerate(zip(rest.column("seq").to_pylist(),
                                               rest.column("block").to_pylist())):
                if b != bucket and pages:
                    yield from replies()
                    pages = []
                bucket = b
                pages.append((block, payloads[k].as_py()))
        if pages:
            yield from replies()
    key = F.when(F.col("kind") == PAGE, F.xxhash64("seq", F.lit(PAGE))).otherwise(
        F.xxhash64("block"))
    return coded.repartition(key).sortWithinPartitions("kind", "seq", "block") \
        .mapInArrow(run, SCHEMA)


def rejoin(answered: DataFrame, finish, schema: str, summary=None) -> DataFrame:
    """``finish(replies)`` gets the reply payloads of a block and returns a function
    from (doc ids, flags, counts, places) of some documents to Arrow batches;
    ``summary(payload)`` turns a summary row into batches."""
    def run(batches):
        block, replies, use, known = None, [], None, 0
        for batch in batches:
            columns = [batch.column(k) for k in (
                "block", "kind", "doc_ids", "flags", "counts", "payload")]
            for k in range(batch.num_rows):
                r = [c[k].as_py() for c in columns]
                if r[1] == SUMMARY:
                    yield from summary(r[5])
                    continue
                if r[0] != block:
                    block, replies, use, known = r[0], [], None, 0
                if r[1] == ANSWER:
                    replies.append(r[5])
                    continue
                if use is None:
                    use = finish(replies)
                at = long(unsqueeze(r[5]))
                new = at == 0
                at = np.where(new, known + np.cumsum(new) - 1, at - 1)
                known += int(new.sum())
                yield from use(r[2], r[3], np.frombuffer(r[4], "<u4").astype(np.int64), at)
    return answered.repartition("block").sortWithinPartitions(
        "block", F.desc("kind"), "seq").mapInArrow(run, schema)
