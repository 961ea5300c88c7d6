"""Operator 5: Lempel-Ziv phrase fingerprints.

A text's UTF-8 bytes are parsed into dictionary phrases (each the shortest
piece not in the dictionary yet; Lempel and Ziv 1978).  The hashes of the phrase
set give a minimum-hash signature, the ``SLOTS`` smallest, and two signatures
estimate the Jaccard similarity of the phrase sets, which behaves like a
compression distance (LZJD; Raff and Nicholas, KDD 2017).  Equal texts have
equal fingerprints.

``compare_edited`` fingerprints every document and its edited text: the last
quarter of its code points replaced by the first as many (or all) of the next
document.  The parse of the edited text goes on from the phrases of the part
that both share, so no text is parsed twice.

Scale.  Texts move once: ids are cut into blocks at quantiles, rows are dealt by
block and sorted, so nearly every document meets its successor in its own task.
The last document of a block needs the first of the next one: those first
documents (one id per block, found from the id column alone) are sent to the
block before as well.  Rows that share one id go to one block, which is read as
a sorted stream, never held.

Edge cases.  Null texts are empty.  An empty text has no phrase; two empty sets
are alike (1), an empty and a non-empty one are not (0).  Documents are ordered
by (doc id, hash, text), null ids first, so repeated rows follow each other.
The successor of the last document is the first; a single document follows
itself.  An empty table gives no row.  Other columns are never read.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from itertools import islice

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crewgate.llm import arrays as A
from crewgate.llm.common import slices

SLOTS = 128
SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
          "edited_fingerprint string, near_edited double, near_next double")


def phrases(data: bytes, trie: dict, ends: list) -> None:
    """Add the phrases of ``data`` to ``trie`` and the place where each ends to ``ends``.

    ``trie`` maps node * 256 + byte to the child node * 256; node 0 is the empty
    phrase and the k-th phrase added is node k, so insertion order is the order
    of the parse.  A known rest at the end of the data adds nothing.
    """
    node, new = 0, 256 * (len(trie) + 1)
    get, add = trie.get, ends.append
    for at, byte in enumerate(data, 1):
        key = node + byte
        node = get(key)
        if node is None:
            trie[key] = new
            new += 256
            node = 0
            add(at)


def phrase_hashes(parses):
    """Hashes of the phrases of many (bytes, ends): one pass over all bytes."""
    data = np.frombuffer(b"".join(d for d, _ in parses), np.uint8)
    at, starts, stops, cuts = 0, [], [], [0]
    for d, ends in parses:
        e = np.array(ends, np.int64) + at
        starts.append(np.concatenate([[at], e[:-1]])[:len(e)])
        stops.append(e)
        cuts.append(cuts[-1] + len(e))
        at += len(d)
    h = A.segment_hash(data, np.concatenate(starts), np.concatenate(stops))
    return [h[a:b] for a, b in zip(cuts, cuts[1:])]


def signature(h):
    """The ``SLOTS`` smallest distinct values of the hashes' upper 32 bits, ascending."""
    s = (h >> np.uint64(32)).astype("<u4")
    if len(s) > 2 * SLOTS:
        s = np.partition(s, 2 * SLOTS)[:2 * SLOTS]
    return np.unique(s)[:SLOTS]


def likeness(a, b) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]))
    same = both[1:] == both[:-1]
    rank = 1 + np.cumsum(~same)                       # place in the union of both
    return float((same & (rank <= SLOTS)).sum() / min(SLOTS, int(rank[-1])))


def show(sig) -> str:
    return base64.b64encode(sig.tobytes()).decode()


class Parsed:
    """A text's parse, kept until its successor is known."""

    def __init__(self, doc_id, text):
        self.doc_id, self.text, self.data = doc_id, text, text.encode()
        self.trie, self.ends = {}, []
        phrases(self.data, self.trie, self.ends)


def parse_all(items):
    """Parsed texts of (doc_id, text) pairs, with hashes and signatures."""
    out = [Parsed(i, t) for i, t in items]
    for p, h in zip(out, phrase_hashes([(p.data, p.ends) for p in out]) if out else ()):
        p.hashes, p.sig = h, signature(h)
    return out


def rows(pairs):
    """A result row for every (document, its successor)."""
    edits = []
    for p, following in pairs:
        n = len(p.text)
        kept = p.text[:n - n // 4].encode()
        edited = kept + following.text[:n // 4].encode()
        k = bisect_right(p.ends, len(kept))                  # phrases inside the kept part
        rest, ends = edited[p.ends[k - 1] if k else 0:], []
        phrases(rest, dict(islice(p.trie.items(), k)), ends)
        edits.append((edited, k, (rest, ends)))
    if not edits:
        return []
    out = []
    for (p, following), (edited, k, _), h in zip(pairs, edits,
                                                 phrase_hashes([e[2] for e in edits])):
        sig = signature(np.concatenate([p.hashes[:k], h]))
        out.append((p.doc_id, len(p.text), hashlib.sha256(edited).hexdigest(), show(p.sig),
                    show(sig), likeness(p.sig, sig), likeness(p.sig, following.sig)))
    return out


def to_batch(found):
    import pyarrow as pa

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(),
             pa.float64()]
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    columns = list(zip(*found)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def inside(batches):
    """Rows sorted by block, copies of the next block's first document last: every
    document with its successor."""
    before = None              # (block, parse) whose successor is still to come
    for batch in batches:
        for part in slices(batch, limit=1 << 20):
            pairs = []
            parses = parse_all(zip(part.column("doc_id").to_pylist(),
                                   part.column("text").to_pylist()))
            for block, copy, now in zip(part.column("block").to_pylist(),
                                        part.column("copy").to_pylist(), parses):
                if before is not None and before[0] == block:
                    pairs.append((before[1], now))
                if not copy:
                    before = (block, now)
                else:
                    before = None       # a copy ends its block; further ones are ties
            yield to_batch(rows(pairs))


def blocks_of(documents: DataFrame, blocks: int):
    """(documents with a column ``block`` that ascends with the id, nulls first)."""
    number = F.col("doc_id").cast("double")
    cuts = documents.select(number.alias("x")).approxQuantile(
        "x", [k / blocks for k in range(1, blocks)], 0.25 / blocks) if blocks > 1 else []
    of = F.lit(0)
    if cuts:
        splits = [-float("inf"), *sorted(set(cuts)), float("inf")]
        documents = Bucketizer(splits=splits, inputCol="x", outputCol="bucket",
                               handleInvalid="keep").transform(documents.withColumn("x", number))
        of = F.col("bucket").cast("int")
    return documents.withColumn("block", F.when(F.col("doc_id").isNull(), -1).otherwise(of)) \
        .drop("x", "bucket")


def compare_edited(documents: DataFrame, blocks: int | None = None) -> DataFrame:
    """One row (``SCHEMA``) per document."""
    n = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = blocks_of(documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")),
                     blocks or 4 * n)
    # one row per block: its first id and the block before it (of the first: the last)
    firsts = docs.groupBy("block").agg(F.min("doc_id").alias("first_id"))
    firsts = firsts.select("first_id", F.coalesce(
        F.lag("block").over(Window.orderBy("block")),
        F.max("block").over(Window.partitionBy())).alias("previous"))
    sent = docs.join(F.broadcast(firsts), F.col("doc_id").eqNullSafe(F.col("first_id")), "left")
    own = F.struct("block", F.lit(False).alias("copy"))
    copy = F.struct(F.col("previous").alias("block"), F.lit(True).alias("copy"))
    to = F.when(F.col("previous").isNull(), F.array(own)).otherwise(F.array(own, copy))
    dealt = sent.select("doc_id", "text", F.inline(to)).withColumn("h", F.xxhash64("text"))
    dealt = dealt.repartition("block").sortWithinPartitions("block", "copy", "doc_id", "h", "text")
    return dealt.mapInArrow(inside, SCHEMA)
