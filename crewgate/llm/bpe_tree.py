"""Operator 12: byte-level BPE by tree concatenation, and decoding.

A text goes through the vocabulary file of the ``tokenizers`` library: control
strings of the file (its added tokens) become their ids first, what lies between
is ordinary text.  Text of at most ``LEAF`` bytes is encoded where it is.  Longer
text is halved until its parts are that short; the parts are rows, so that many
tasks encode one text, and come back in order.  Neighbours are then joined in a
tree.  Around every join a window is encoded again, ``WINDOW`` tokens of either
side at first and twice as many each time, until both sides agree:

* the window starts and ends at a cut that holds in any context (below), and its
  first and last token are those that the sides have there; or
* it lies inside one run of ASCII letters or of ASCII digits, which is one
  pre-token or inside one, and merging the window's bytes gives the token that
  the left side has at its start and the one that the right side has at its end.
  A sequence of tokens is the byte-pair encoding of a pre-token exactly if all
  adjacent pairs are, so the tokens outside the window stay; or
* it holds both sides whole.

A cut that holds in any context lies between two ASCII characters that no match
of the pattern can hold in a row: a character of another kind than white space
before a white space one, a letter or digit before another kind, a character
that is neither (nor an apostrophe) before a letter, any such before a digit.

Merges are ``tiktoken``'s over the file's ids, whose order is that of the merges;
both libraries split at the same characters (``tests/llm/test_bpe_tree.py``).

Edge cases.  Null and empty texts have no ids.  Control strings in a text become
their ids, next to each other or at the end too.  Repeated rows and null ids give
a row each; other columns are never read.  An empty table gives no row.
"""

from __future__ import annotations

import json
import re

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewgate.llm import tokens
from crewgate.llm.common import slices

LEAF = 64 << 10      # bytes of text encoded in one piece
WINDOW = 16          # tokens of either side in the first window
SCHEMA = "doc_id long, n_tokens long, ids binary"
PART = "row long, doc_id long, segment long, part long, control long"


def kinds():
    """Kind of every byte: 0 not ASCII, 1 white space, 2 letter, 3 digit, 4 apostrophe,
    5 any other ASCII character."""
    k = np.zeros(256, np.int8)
    k[:128] = 5
    k[[9, 10, 11, 12, 13, 28, 29, 30, 31]] = 0      # libraries may differ on these: no cut there
    k[32] = 1
    k[65:91] = k[97:123] = 2
    k[48:58] = 3
    k[39] = 4
    return k


KIND = kinds()
# CUTS[a, b]: a character of kind a and one of kind b are never in one match, in this order
CUTS = np.zeros((6, 6), bool)
CUTS[2:, 1] = True                   # anything but white space, then a blank
CUTS[2, 3:] = True                   # letter, then another kind
CUTS[3, [2, 4, 5]] = True            # digit, then another kind
CUTS[5, [2, 3]] = True               # sign, then a letter or a digit
CUTS[4, 3] = True                    # apostrophe, then a digit


class Codec:
    """Ids and bytes of one vocabulary file."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            added = json.load(f).get("added_tokens", ())
        for t in added:
            if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]:
                raise ValueError("an added token that takes in its surroundings")
        ranks = tokens.json_ranks(path)
        self.control = {t["content"]: t["id"] for t in added}
        self.encoder = tokens.encoder(ranks, pattern)
        longest_first = sorted(self.control, key=len, reverse=True)
        self.controls = re.compile("|".join(map(re.escape, longest_first))) if added else None
        self.raw = [b""] * (max([*ranks.values(), *self.control.values()]) + 1)
        for raw, i in ranks.items():
            self.raw[i] = raw
        for text, i in self.control.items():
            self.raw[i] = text.encode()

    def segments(self, text: str):
        """(ordinary text, id of the control string after it or None) in order."""
        at = 0
        for m in self.controls.finditer(text) if self.controls else ():
            yield text[at:m.start()], self.control[m.group()]
            at = m.end()
        yield text[at:], None

    def ordinary(self, text: str):
        return np.array(self.encoder.encode_ordinary(text), dtype="<u4")

    def whole(self, text: str):
        """Ids of a text by halves, in one place."""
        out = []
        for part, control in self.segments(text):
            out.append(concatenated([self.ordinary(p) for p in halves(part)], self))
            if control is not None:
                out.append(np.array([control], "<u4"))
        return np.concatenate(out)

    def bytes_of(self, ids) -> bytes:
        return b"".join([self.raw[i] for i in ids.tolist()])

    def join(self, left, right):
        """Ids of the text of ``left`` and the text of ``right`` as one text."""
        if not len(left) or not len(right):
            return left if len(left) else right
        reach = WINDOW
        while True:
            a, b = max(len(left) - reach, 0), min(reach, len(right))
            got = self.window(left[a:], right[:b], a == 0, b == len(right))
            if got is not None:
                skip, ids, used = got
                return np.concatenate([left[:a + skip], ids, right[used:]])
            reach *= 2

    def window(self, tail, head, whole_left: bool, whole_right: bool):
        """(tokens of ``tail`` kept, new ids, tokens of ``head`` replaced), or None
        where the sides do not agree yet."""
        l, r = self.bytes_of(tail), self.bytes_of(head)
        size_l = np.cumsum([0] + [len(self.raw[i]) for i in tail.tolist()])
        size_r = np.cumsum([0] + [len(self.raw[i]) for i in head.tolist()])
        first = 0 if whole_left else first_cut(l, size_l)
        last = len(head) if whole_right else last_cut(r, size_r)
        if first is not None and last is not None:
            ids = self.ordinary((l[size_l[first]:] + r[:size_r[last]]).decode())
            agreed = (whole_left or ids[0] == tail[first]) and \
                (whole_right or ids[-1] == head[last - 1])
            return (first, ids, last) if agreed else None
        kind = KIND[np.frombuffer(l + r, np.uint8)]
        if kind[0] in (2, 3) and (kind == kind[0]).all():
            ids = np.array(self.encoder._encode_single_piece(l + r), "<u4")
            if ids[0] == tail[0] and ids[-1] == head[-1]:
                return 0, ids, len(head)
        return None


def cuts(raw: bytes, ends):
    """Tokens (by number) that start at a cut of ``raw``, whose tokens end at ``ends``."""
    kind = KIND[np.frombuffer(raw, np.uint8)]
    at = ends[1:-1]
    return 1 + np.flatnonzero(CUTS[kind[at - 1], kind[at]])


def first_cut(raw: bytes, ends):
    found = cuts(raw, ends)
    return int(found[0]) if len(found) else None


def last_cut(raw: bytes, ends):
    found = cuts(raw, ends)
    return int(found[-1]) if len(found) else None


def halves(text: str, leaf: int | None = None) -> list[str]:
    """``text`` halved until no part has more than ``leaf`` bytes of UTF-8 (4 a code point)."""
    leaf = LEAF if leaf is None else leaf
    if len(text) <= leaf // 4 or len(text) <= leaf and len(text.encode()) <= leaf:
        return [text]
    half = len(text) // 2
    return halves(text[:half], leaf) + halves(text[half:], leaf)


def concatenated(parts, codec):
    """Neighbours joined in a balanced tree."""
    while len(parts) > 1:
        joined = [codec.join(*parts[k:k + 2]) for k in range(0, len(parts) - 1, 2)]
        parts = joined + parts[len(joined) * 2:]
    return parts[0]


def encode_short(path: str, pattern: str):
    """Task side: ids of texts of at most ``LEAF`` bytes."""
    def run(batches):
        import pyarrow as pa

        codec = Codec(path, pattern)
        for batch in batches:
            for part in slices(batch):
                ids = [codec.whole(t or "") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"),
                    "n_tokens": pa.array(list(map(len, ids)), pa.int64()),
                    "ids": pa.array([i.tobytes() for i in ids], pa.binary())})
    return run


def cut_long(path: str, pattern: str):
    """Task side: the parts of long texts, in order, with the control id after each.

    ``row`` numbers the texts of an input partition, so a task run again gives the
    same numbers.
    """
    def run(batches):
        import pyarrow as pa

        codec, row = Codec(path, pattern), TaskContext.get().partitionId() << 33
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                for segment, (piece, control) in enumerate(codec.segments(text.as_py())):
                    parts = halves(piece)
                    n = len(parts)
                    for lo in range(0, n, 64):
                        few = parts[lo:lo + 64]
                        marks = [None] * len(few)
                        if lo + len(few) == n:
                            marks[-1] = control
                        yield pa.RecordBatch.from_pydict({
                            "row": pa.array([row] * len(few), pa.int64()),
                            "doc_id": pa.array([doc_id] * len(few), pa.int64()),
                            "segment": pa.array([segment] * len(few), pa.int64()),
                            "part": pa.array(range(lo, lo + len(few)), pa.int64()),
                            "control": pa.array(marks, pa.int64()),
                            "text": pa.array(few, pa.string())})
                row += 1
    return run


def encode_parts(path: str, pattern: str):
    """Task side: the text of every part replaced by its ids."""
    def run(batches):
        import pyarrow as pa

        codec = Codec(path, pattern)
        for batch in batches:
            for part in slices(batch):
                ids = [codec.ordinary(t).tobytes() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(k) for k in range(5)] + [pa.array(ids, pa.binary())],
                    ["row", "doc_id", "segment", "part", "control", "ids"])
    return run


def join_parts(path: str, pattern: str):
    """Task side: the parts of one text after the other -> its ids."""
    def run(batches):
        import pyarrow as pa

        codec, now, doc_id, done, parts = Codec(path, pattern), None, None, [], []

        def text():
            ids = np.concatenate(done)
            return pa.RecordBatch.from_pydict({
                "doc_id": pa.array([doc_id], pa.int64()), "n_tokens": pa.array([len(ids)]),
                "ids": pa.array([ids.tobytes()], pa.binary())})

        def close(control=None):
            if parts:
                done.append(concatenated(parts, codec))
                parts.clear()
            if control is not None:
                done.append(np.array([control], "<u4"))

        for batch in batches:
            columns = [batch.column(c) for c in ("row", "doc_id", "segment", "control", "ids")]
            for k in range(batch.num_rows):
                row, doc, segment, control, ids = (c[k].as_py() for c in columns)
                if now is not None and row != now[0]:
                    close()
                    yield text()
                    done.clear()
                elif now is not None and segment != now[1]:
                    close()
                now, doc_id = (row, segment), doc
                parts.append(np.frombuffer(ids, "<u4"))
                if control is not None:
                    close(control)
        if now is not None:
            close()
            yield text()
    return run


def encode(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids as little-endian 32-bit integers) per document.

    Long texts alone are shuffled, part by part.
    """
    docs = documents.select("doc_id", "text")
    is_long = F.coalesce(F.octet_length("text") > LEAF, F.lit(False))
    short = docs.where(~is_long).mapInArrow(encode_short(path, pattern), SCHEMA)
    parts = docs.where(is_long).mapInArrow(cut_long(path, pattern), PART + ", text string")
    coded = parts.repartition(F.xxhash64("row", "segment", "part")) \
        .mapInArrow(encode_parts(path, pattern), PART + ", ids binary")
    joined = coded.repartition("row").sortWithinPartitions("row", "segment", "part") \
        .mapInArrow(join_parts(path, pattern), SCHEMA)
    return short.unionByName(joined)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """The columns of ``encode`` and ``text``: every token's bytes, end to end, with
    U+FFFD for bytes that are no UTF-8."""
    def run(batches):
        import pyarrow as pa

        codec = Codec(path, pattern)
        for batch in batches:
            for part in slices(batch, "ids"):
                texts = [codec.bytes_of(np.frombuffer(i.as_buffer(), "<u4")).decode(
                    errors="replace") for i in part.column("ids")]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(texts, pa.string())],
                    [*part.schema.names, "text"])
    return encoded.mapInArrow(run, SCHEMA + ", text string")


def round_trip(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of ids and decoded text."""
    both = decode(encode(documents, path, pattern), path, pattern)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
