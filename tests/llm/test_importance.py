import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash

from crewgate.llm import importance as I
from crewgate.llm.oracle import ORACLE_SQL
from crewgate.llm.queries import QUERIES
from tests.llm.conftest import SF, frame

NAME = "op13_importance_resampling"
CASES = ["", "a", "A B", "é日本 x_y", "one  two\tONE\n\none", "x" * 33 + " " + "x" * 200, "end",
         "ab cd", "0123456789abcdef" * 5, "\x00z\x7fq", "İK"]


def features(text, n_max):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return w, [" ".join(w[k:k + n]) for n in range(1, n_max + 1) for k in range(len(w) - n + 1)]


def brute(rows, aims, n_max, buckets, min_words, percent, seed):
    of = lambda f: zlib.crc32(f.encode()) % buckets
    have = Counter(of(f) for _, t in rows for f in features(t, n_max)[1])
    aim = Counter(of(f) for t in aims for f in features(t, n_max)[1])
    total, wanted = sum(have.values()), sum(aim.values())
    gain = {b: math.floor(1000 * math.log((aim[b] + 1) * (total + buckets)
                                          / ((have[b] + 1) * (wanted + buckets)))) for b in have}
    out, able = [], []
    for i, t in rows:
        w, f = features(t, n_max)
        weight, score = sum(gain[of(x)] for x in f), None
        if i is not None:
            h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            if len(w) >= min_words:
                able.append((-score, i, weight, len(f)))
        out.append((i, len(f), weight, score, len(w) >= min_words and i is not None))
    able.sort()
    rank = {}
    for k, key in enumerate(able, 1):
        rank.setdefault(key, []).append(k if k <= percent * len(able) // 100 else None)
    return Counter((i, n, w, s, rank[-s, i, w, n].pop(0) if ok else None) for i, n, w, s, ok in out)


@pytest.mark.parametrize("n_max,buckets,percent", [(1, 10_000, 10), (3, 97, 50), (2, 10_000, 100)])
def test_equal_to_brute_force(spark, rows, docs, n_max, buckets, percent):
    aims = [t for _, t in rows[-6:]] + [None, ""]
    target = spark.createDataFrame([(t, "x") for t in aims], "text string, bucket string")
    got = I.resample(docs, target, n_max, buckets, 20, percent, 7).collect()
    assert Counter(map(tuple, got)) == brute(rows, aims, n_max, buckets, 20, percent, 7)


def interned(texts, n_max=1):
    return I.Features(pa.array(texts), n_max, 1000)


@pytest.mark.parametrize("n_max", [1, 2, 4])
def test_slots_stand_for_distinct_features(n_max):
    rng = random.Random(2)
    texts = CASES + [" ".join(rng.choice("ab é c9 LONGERWORDTHANEIGHT".split())
                              for _ in range(rng.randint(0, 60))) for _ in range(30)] + [None]
    f = interned(texts, n_max)
    want = [[x for x in features(t, n_max)[1]] for t in texts]
    assert f.n_words.tolist() == [len(features(t, 1)[0]) for t in texts]
    got = [[] for _ in texts]
    names = {}
    for d, s, a, n in zip(f.doc.tolist(), f.slot.tolist(), f.start.tolist(), f.size.tolist()):
        name = f.text.bytes[a:a + n].decode()
        got[d].append(name)
        assert names.setdefault(s, name) == name        # one feature per slot ...
    assert len(set(names.values())) == len(names)       # ... and one slot per feature
    assert list(map(Counter, got)) == list(map(Counter, want))
    count = Counter(x for w in want for x in w)
    assert {names[s]: f.count[s] for s in names} == count
    assert all(f.bucket[s] == zlib.crc32(x.encode()) % 1000 for s, x in names.items())


def test_equal_hashes_are_told_apart(monkeypatch):
    """With a hash of two values, the bytes alone keep the features apart."""
    monkeypatch.setattr(I.Text, "hashes", lambda self, start, size: (size % 2).astype(np.uint64))
    test_slots_stand_for_distinct_features(1)


def test_hash_is_xxhash64():
    rng = random.Random(4)
    raw = bytes(rng.randrange(256) for _ in range(5000))
    text = I.Text(np.frombuffer(raw, np.uint8))
    start = np.array([rng.randrange(4900) for _ in range(2000)])
    size = np.array([rng.randrange(0, 70) for _ in range(2000)])
    assert text.hashes(start, size).tolist() == [
        xxhash.xxh64_intdigest(raw[a:a + n]) for a, n in zip(start, size)]


def test_nothing(spark, nothing, docs):
    empty = spark.createDataFrame([], "text string")
    assert I.resample(nothing, empty).count() == 0
    assert I.resample(docs, empty).count() == docs.count()
    only = frame(spark, [(1, None), (None, "w " * 30)])
    assert {(r.doc_id, r.n_features, r.rank) for r in I.resample(only, empty).collect()} == {
        (1, 0, None), (None, 30, None)}


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(ORACLE_SQL[NAME])
    got = QUERIES[NAME](spark, SF).select(*want.columns).collect()
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(map(tuple, got), key=key) == sorted(want.fetchall(), key=key)
