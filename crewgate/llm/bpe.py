"""Operator 4: byte-level BPE by a global distinct-word shuffle, and decoding.

Every text is split by the pattern into pre-tokens; their positions are kept
and the distinct ones exchanged (``dictionary``), so that each is merged into
ids once in the whole corpus by ``tiktoken``'s merge of a single piece.  The
ids return to the blocks and every text is reassembled by position.  Decoding
looks each id up in the token-byte table of the rank file (one row per id, so
bounded by the vocabulary) and concatenates.

Edge cases.  Null and empty texts have no ids.  Control strings inside a text
are ordinary text.  A pre-token or text of any length is encoded whole.
Repeated rows and null ids give a row each; other columns are never read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from crewgate.llm import dictionary, tokens

SCHEMA = "doc_id long, n_tokens long, ids binary"


def encode_bucket(path: str, pattern: str):
    """Ids of the distinct pre-tokens of a bucket, once each, for every page."""
    state = {}

    def work(bucket, pages):
        if not state:
            state["enc"] = tokens.encoder(tokens.rank_file(path), pattern)
        piece, ids = state["enc"]._encode_single_piece, {}
        for block, payload in pages:
            page = dictionary.Page(block, payload)
            found = []
            for w in page.words:
                got = ids.get(w)
                if got is None:
                    got = ids[w] = piece(w)
                found.append(got)
            yield dictionary.ANSWER, block, dictionary.squeeze(
                np.diff(page.places, prepend=0), np.fromiter(map(len, found), "<u4", len(found)),
                np.fromiter((i for f in found for i in f), "<u4"))
    return work


def place_ids(replies):
    """(ids of all words of a block end to end, first, count) by place in its list."""
    parts = [dictionary.unsqueeze(r) for r in replies]
    places = [np.cumsum(dictionary.numbers(p[0]).astype(np.int64)) for p in parts]
    sizes = [dictionary.numbers(p[1]).astype(np.int64) for p in parts]
    n = sum(map(len, places))
    count, first, at, flat = np.zeros(n, np.int64), np.zeros(n, np.int64), 0, []
    for where, size, p in zip(places, sizes, parts):
        count[where] = size
        first[where] = at + np.cumsum(size) - size
        flat.append(dictionary.numbers(p[2]))
        at += int(size.sum())
    return np.concatenate(flat) if flat else np.zeros(0, "<u4"), first, count


def gather(flat, first, count):
    """flat[first[k] : first[k] + count[k]] for all k, end to end."""
    ends = np.cumsum(count)
    at = np.arange(int(ends[-1]) if len(ends) else 0)
    return flat[at + np.repeat(first - (ends - count), count)]


def runs(counts):
    ends = np.cumsum(counts)
    return list(zip((ends - counts).tolist(), ends.tolist()))


def reassemble(finish_texts):
    """Word positions and replies -> ids of every text -> Arrow batches."""
    def finish(replies):
        flat, first, count = place_ids(replies)

        def use(doc_ids, flags, counts, places):
            ids = gather(flat, first[places], count[places])
            total = np.concatenate([[0], np.cumsum(count[places])])
            ends = np.cumsum(counts)
            yield from finish_texts(doc_ids, ids, total[ends] - total[ends - counts])
        return use
    return finish


def coded(documents: DataFrame, path: str, pattern: str, finish_texts, schema: str) -> DataFrame:
    state = {}

    def split(text):
        if not state:
            state["split"] = tokens.splitter(pattern)
        return state["split"](text)

    buckets = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    answered = dictionary.answer(dictionary.code(documents, split, buckets),
                                 encode_bucket(path, pattern))
    return dictionary.rejoin(answered, reassemble(finish_texts), schema)


def encode(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids as little-endian 32-bit integers) per document."""
    def finish_texts(doc_ids, ids, n):
        import pyarrow as pa

        yield pa.RecordBatch.from_pydict({
            "doc_id": pa.array(doc_ids, pa.int64()), "n_tokens": pa.array(n, pa.int64()),
            "ids": pa.array([ids[a:b].tobytes() for a, b in runs(n)], pa.binary())})
    return coded(documents, path, pattern, finish_texts, SCHEMA)


def token_bytes(path: str):
    """Token-byte table: (all bytes end to end, first, count) by id."""
    ranks = tokens.rank_file(path)
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    table = [b""] * len(size)
    for raw, i in ranks.items():
        table[i], size[i] = raw, len(raw)
    return np.frombuffer(b"".join(table), np.uint8), np.cumsum(size) - size, size


def decode_ids(ids, n, table):
    """Bytes of every text from its ids (``n`` per text)."""
    raw = gather(table[0], table[1][ids], table[2][ids]).tobytes()
    total = np.concatenate([[0], np.cumsum(table[2][ids])])
    return [raw[total[a]:total[b]] for a, b in runs(n)]


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of the rows of ``encode``."""
    def run(batches):
        import pyarrow as pa

        table = token_bytes(path)
        for batch in batches:
            ids = [np.frombuffer(b, "<u4") for b in batch.column("ids").to_pylist()]
            if ids:
                texts = decode_ids(np.concatenate(ids), np.array([len(i) for i in ids]), table)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id"),
                    "text": pa.array([t.decode() for t in texts], pa.string())})
    return encoded.mapInArrow(run, "doc_id long, text string")


def round_trip(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of ids and decoded bytes."""
    state = {}

    def finish_texts(doc_ids, ids, n):
        import pyarrow as pa

        if not state:
            state["table"] = token_bytes(path)
        raw = [ids[a:b].tobytes() for a, b in runs(n)]
        back = decode_ids(ids, n, state["table"])
        yield pa.RecordBatch.from_pydict({
            "doc_id": pa.array(doc_ids, pa.int64()), "n_tokens": pa.array(n, pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(r).hexdigest() for r in raw], pa.string()),
            "decoded_sha256": pa.array([hashlib.sha256(r).hexdigest() for r in back],
                                       pa.string())})
    return coded(documents, path, pattern, finish_texts,
                 "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
