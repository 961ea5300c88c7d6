"""Operator 13: importance resampling towards the distribution of target texts.

A text is lower-cased (A-Z only) and its words, runs of ASCII letters and digits
and of code points beyond ASCII, form features: all runs of 1 to ``n_max`` words
joined by one space, repeats counted.  A feature's bucket is the crc32 of its
bytes modulo the number of buckets; a bucket's gain is a thousand times the log
ratio of its smoothed share among the target's features to that among the
documents'.

Per slice of texts the features are interned in an open-addressed NumPy table:
the slot is found from the xxhash64 of the bytes by linear probing, all
occurrences in step, and an occurrence stays only at a slot whose own bytes equal
its own; so equal hashes of different features do no harm.  A slot stores its
count and its bucket (crc32 is taken once per distinct feature).  Counts per
bucket are summed per task and then by Spark; in the second pass the occurrences'
slot ids gather the gains and are summed per document.

A document's score is its weight, the sum of the gains, plus Gumbel noise from the
sha256 of seed and doc id, so that the highest scores are a weighted draw without
replacement.  Of the N documents with ``min_words`` words or more, the share
``percent`` of 100 is drawn; ranks come from a range partitioning on the order.

The driver sees one row per bucket, tasks get one gain per bucket; nothing else
is gathered.

Edge cases.  Null and empty texts have no feature and weight 0.  A null doc id has no
noise: its score and rank are null, it is not drawn and not part of N, but its text is
in the statistics.  Repeated rows count each and are ranked next to each other.  Ties
in the score go to the smaller doc id.  Without documents there is no row, without
target texts T and all t are 0.  Other columns are never read.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewgate.llm import arrays as A
from crewgate.llm.common import slices, stored
from crewgate.operators.keys import assign_ids

BUCKETS, N_MAX, MIN_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
SCORED = "doc_id long, n_words long, n_features long, weight long, score long"

# xxhash64 (public specification): its five primes, in order.
PRIMES = [np.uint64(p) for p in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63,
    0x27D4EB2F165667C5)]

WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def turn(x, n: int):
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


class Text:
    """Normalised bytes (words with one separator after each) and their lanes: the
    eight bytes from any position on as one little-endian number."""

    def __init__(self, data):
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        self.bytes = padded.tobytes()
        self.lanes = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))

    def hashes(self, start, size):
        """xxhash64 (seed 0) of every range; ranges of one length go in step."""
        p1, p2, p3, p4, p5 = PRIMES
        out = np.empty(len(start), np.uint64)
        order = np.argsort(size, kind="stable")
        lengths, first = np.unique(size[order], return_index=True)
        for length, at in zip(lengths.tolist(), np.split(order, first[1:])):
            if length >= 32:
                import xxhash

                out[at] = [xxhash.xxh64_intdigest(self.bytes[s:s + length])
                           for s in start[at].tolist()]
                continue
            s = start[at]
            h = np.full(len(at), p5 + np.uint64(length), np.uint64)
            k = 0
            while k + 8 <= length:
                h ^= turn(self.lanes[s + k] * p2, 31) * p1
                h = turn(h, 27) * p1 + p4
                k += 8
            if k + 4 <= length:
                h ^= (self.lanes[s + k] & np.uint64(0xFFFFFFFF)) * p1
                h = turn(h, 23) * p2 + p3
                k += 4
            while k < length:
                h ^= (self.lanes[s + k] & np.uint64(255)) * p5
                h = turn(h, 11) * p1
                k += 1
            h ^= h >> np.uint64(33)
            h *= p2
            h ^= h >> np.uint64(29)
            h *= p3
            out[at] = h ^ (h >> np.uint64(32))
        return out

    def equal(self, a, b, size):
        """Whether the ranges of ``size`` bytes from ``a`` and from ``b`` hold the same."""
        ok, rest, k = np.ones(len(a), bool), np.arange(len(a)), 0
        while len(rest):
            if k == 64:         # long ones, few: compared as bytes
                for i in rest.tolist():
                    ok[i] = self.bytes[a[i]:a[i] + size[i]] == self.bytes[b[i]:b[i] + size[i]]
                break
            differ = self.lanes[a[rest] + k] ^ self.lanes[b[rest] + k]
            left = size[rest] - k
            short = left < 8
            differ[short] &= (np.uint64(1) << (8 * left[short]).astype(np.uint64)) - np.uint64(1)
            ok[rest[differ != 0]] = False
            rest = rest[(differ == 0) & (left > 8)]
            k += 8
        return ok


class Features:
    """The features of a slice of texts, interned."""

    def __init__(self, column, n_max: int, buckets: int):
        data, offsets = A.text_bytes(column)
        data = LOWER[data]
        solid = WORD[data]
        begin, stop = solid.copy(), solid.copy()
        begin[1:] &= ~solid[:-1]
        stop[:-1] &= ~solid[1:]
        edge = offsets[1:-1]
        edge = edge[(edge > 0) & (edge < len(data))]
        begin[edge], stop[edge - 1] = solid[edge], solid[edge - 1]
        start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        self.n_docs = len(offsets) - 1
        doc = np.searchsorted(offsets, start, side="right") - 1
        self.n_words = np.bincount(doc, minlength=self.n_docs)
        # every word followed by one blank, wherever it stood
        place = np.concatenate([[0], np.cumsum(end - start + 1)])
        flat = np.full(int(place[-1]), 32, np.uint8)
        flat[np.flatnonzero(solid) + np.repeat(place[:-1] - start, end - start)] = data[solid]
        first, last, of = [], [], []
        for n in range(1, n_max + 1):
            m = max(len(start) - n + 1, 0)
            at = np.flatnonzero(doc[:m] == doc[len(doc) - m:])
            first.append(place[at])
            last.append(place[at + n] - 1)
            of.append(doc[at])
        self.doc = np.concatenate(of)
        self.text = Text(flat)
        self.start = np.concatenate(first)
        self.size = np.concatenate(last) - self.start
        self.intern(buckets)

    def intern(self, buckets: int):
        """Slot of every occurrence; count and bucket of every slot."""
        n = len(self.start)
        capacity = 1 << max(2 * n - 1, 1).bit_length()
        owner = np.full(capacity, -1, np.int64)        # the occurrence that a slot belongs to
        key = self.text.hashes(self.start, self.size)
        self.slot = (key & np.uint64(capacity - 1)).astype(np.int64)
        waiting = np.arange(n)
        while len(waiting):
            slot = self.slot[waiting]
            free = owner[slot] < 0
            owner[slot[free][::-1]] = waiting[free][::-1]      # the first occurrence takes it
            mine = owner[slot]
            same = (key[mine] == key[waiting]) & (self.size[mine] == self.size[waiting])
            k = np.flatnonzero(same)
            same[k] = self.text.equal(self.start[mine[k]], self.start[waiting[k]],
                                      self.size[waiting[k]])
            waiting = waiting[~same]
            self.slot[waiting] = (self.slot[waiting] + 1) & (capacity - 1)
        used = np.flatnonzero(owner >= 0)
        self.count = np.bincount(self.slot, minlength=capacity)
        self.bucket = np.zeros(capacity, np.int64)
        whole, who = self.text.bytes, owner[used]
        self.bucket[used] = [zlib.crc32(whole[a:a + s]) % buckets for a, s in zip(
            self.start[who].tolist(), self.size[who].tolist())]

    def per_bucket(self, buckets: int):
        return np.bincount(self.bucket, self.count, minlength=buckets).astype(np.int64)

    def weights(self, gains):
        """Sum of gains over every document's features."""
        got = gains[self.bucket][self.slot]
        return np.bincount(self.doc, got, minlength=self.n_docs).astype(np.int64)


def bucket_counts(texts: DataFrame, n_max: int, buckets: int):
    """Features per bucket over all of ``texts`` (text), summed by Spark."""
    def run(batches):
        import pyarrow as pa

        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for rows in slices(batch):
                total += Features(rows.column("text"), n_max, buckets).per_bucket(buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int32()),
                                          "n": pa.array(total[at])})

    out = np.zeros(buckets, np.int64)
    got = texts.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(
        F.sum("n").alias("n"))
    for r in got.collect():             # one row per bucket
        out[r["bucket"]] = r["n"]
    return out


def gains_of(documents, target):
    """Gain of every bucket from its counts in the documents and in the target."""
    total, aim, buckets = float(documents.sum()), float(target.sum()), len(documents)
    return np.array([
        math.floor(1000 * math.log((t + 1.0) * (total + buckets) / ((s + 1.0) * (aim + buckets))))
        for s, t in zip(documents.tolist(), target.tolist())], np.int64)


def noise(doc_id: int, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def score(documents: DataFrame, gains, n_max: int = N_MAX, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) per document."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for rows in slices(batch):
                f = Features(rows.column("text"), n_max, len(gains))
                ids, weight = rows.column("doc_id").to_pylist(), f.weights(gains)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": rows.column("doc_id"), "n_words": pa.array(f.n_words),
                    "n_features": pa.array(np.bincount(f.doc, minlength=f.n_docs)),
                    "weight": pa.array(weight),
                    "score": pa.array([None if i is None else w + noise(i, seed)
                                       for i, w in zip(ids, weight.tolist())], pa.int64())})
    return documents.select("doc_id", "text").mapInArrow(run, SCORED)


def resample(documents: DataFrame, target: DataFrame, n_max: int = N_MAX, buckets: int = BUCKETS,
             min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; rank 1, 2, ... of the
    drawn ones, null for the others."""
    gains = gains_of(bucket_counts(documents, n_max, buckets), bucket_counts(target, n_max, buckets))
    scored, _ = stored(score(documents, gains, n_max, seed), "importance-scored")
    able = F.coalesce((F.col("n_words") >= min_words) & F.col("doc_id").isNotNull(), F.lit(False))
    eligible = scored.where(able)
    drawn = percent * eligible.count() // 100
    ranked = assign_ids(eligible, [F.desc("score"), "doc_id", "weight", "n_features"], 1, "rank")
    every = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).unionByName(
        scored.where(~able).withColumn("rank", F.lit(None).cast("long")))
    return every.select("doc_id", "n_features", "weight", "score", "rank")
