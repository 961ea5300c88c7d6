import random
import re

import pytest

from crewgate.llm import near_dedup
from crewgate.llm.common import stored
from tests.llm.conftest import frame, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(text or "")
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else (
        {tuple(w)} if w else set())


def brute_classes(rows):
    """Class per row: links of Jaccard >= 0.8 between texts, equal texts together."""
    texts = sorted({t or "" for _, t in rows})
    parent = {t: t for t in texts}

    def find(t):
        while parent[t] != t:
            t = parent[t]
        return t

    sets = {t: shingles(t) for t in texts}
    for k, a in enumerate(texts):
        for b in texts[:k]:
            x, y = sets[a], sets[b]
            if x and y and len(x & y) >= 0.8 * len(x | y):
                parent[find(a)] = find(b)
    ids = {}
    for i, t in rows:
        ids.setdefault(find(t or ""), set()).update([] if i is None else [i])
    return len(ids), sorted(((i is not None, i or 0), min(ids[find(t or "")] or [0]))
                            for i, t in rows)


def got_classes(frame_):
    return sorted(((r.doc_id is not None, r.doc_id or 0), r.class_id or 0)
                  for r in near_dedup.classes(frame_).collect())


def families(seed=7):
    """Originals, chains of copies (each near its neighbour only), exact copies."""
    rng = random.Random(seed)
    rows, k = [], 0
    for _ in range(12):
        text = words(rng, rng.randint(60, 200), 3000)
        for _ in range(rng.randint(1, 6)):
            rows.append((k, " ".join(text)))
            k += 1
            if rng.random() < .3:
                rows.append((k, " ".join(text)))
                k += 1
            text = list(text)
            for _ in range(rng.choice((1, 1, 2, 12))):
                text[rng.randrange(len(text))] = f"new{k}"
    rng.shuffle(rows)
    return rows


def test_classes_equal_brute_force(spark, docs, rows):
    assert got_classes(docs) == brute_classes(rows)[1]
    made = families()
    assert got_classes(frame(spark, made).repartition(4)) == brute_classes(made)[1]


def test_one_large_group_of_near_copies(spark):
    rng = random.Random(1)
    text = words(rng, 400, 5000)
    rows = [(0, " ".join(text))]
    for k in range(1, 300):
        own = list(text)
        own[rng.randrange(400)] = f"edit{k}"
        rows.append((k, " ".join(own)))
    got = near_dedup.classes(frame(spark, rows).repartition(4)).collect()
    assert {r.class_id for r in got} == {0} and sum(r.keeper for r in got) == 1


@pytest.mark.parametrize("times", [5, 20, 50])
def test_links_whose_differing_shingles_repeat(spark, times):
    """Copies that differ in a line repeated inside the text: set Jaccard 0.80 to 0.90."""
    rng = random.Random(times)
    rows, pairs = [], 60
    for k in range(pairs):
        own = [f"a{k}x{i}" for i in range(400)]
        n = rng.randint(21, 38)
        for side in range(2):
            line = [f"l{k}x{side}x{i}" for i in range(n)]
            rows.append((2 * k + side, " ".join(own + line * times)))
        x, y = shingles(rows[-1][1]), shingles(rows[-2][1])
        assert 0.8 <= len(x & y) / len(x | y) <= 0.9
    got = near_dedup.classes(frame(spark, rows).repartition(4)).collect()
    assert sum(r.class_id == r.doc_id - r.doc_id % 2 for r in got) == 2 * pairs


def test_part_comparer_tests_every_pair_that_the_sizes_allow():
    """A link whose signatures agree in little more than the band is found."""
    import numpy as np
    import pyarrow as pa

    base = [f"w{i}" for i in range(104)]
    texts = [" ".join(base), " ".join(base[:95] + [f"v{i}" for i in range(9)])]
    bands = [np.array([7, 1 + 10 * k, 2 + 10 * k], np.int64).tobytes() for k in range(2)]
    batch = pa.RecordBatch.from_pydict({
        "band": [7, 7], "lo": [0, 0], "hi": [0, 0], "part": [0, 0], "rid": [1, 2],
        "label": [1, 2], "size": [100, 100], "slots": [bytes(18), bytes(range(1, 19))],
        "bands": bands, "text": texts})
    out = pa.Table.from_batches(near_dedup.part_comparer(0.8)([batch])).to_pylist()
    assert out == [{"a": 1, "b": 2}]


def test_keep_one_hands_columns_through(spark, docs, rows, nothing):
    kept = near_dedup.keep_one(docs)
    assert kept.schema == docs.schema
    assert kept.count() == brute_classes(rows)[0]
    assert near_dedup.keep_one(nothing).count() == 0
    assert near_dedup.classes(nothing).count() == 0


@pytest.mark.parametrize("s", [0.5, 0.9])
def test_slots_agree_with_the_probability_jaccard(s):
    """Signatures of weighted sets agree in a slot with the probability Jaccard."""
    import numpy as np

    rng = np.random.default_rng(3)
    common, own = int(200 * s), 200 - int(200 * s)
    key = rng.integers(1, 1 << 63, common + 2 * own, dtype=np.int64).astype(np.uint64)
    w = 1 + np.log(rng.integers(1, 6, len(key)))
    a = np.arange(common + own)
    b = np.r_[np.arange(common), np.arange(common + own, len(key))]
    doc = np.r_[np.zeros(len(a), int), np.ones(len(b), int)]
    k = np.r_[key[a], key[b]]
    won = near_dedup.signatures(doc, k, np.r_[w[a], w[b]], 2, 4000)
    x, y = np.zeros(len(key)), np.zeros(len(key))
    x[a], y[b] = w[a], w[b]
    want = sum(1 / np.maximum(x / x[i], y / y[i]).sum() for i in range(common))
    assert abs((won[0] == won[1]).mean() - want) < 0.05


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(900, 901)], "a long, b long")
    got = {r.rid: r.label for r in near_dedup.components(edges).collect()}
    assert got == {k: 0 for k in range(201)} | {900: 900, 901: 900}


def test_no_join_is_broadcast(spark, docs, monkeypatch):
    """Small or compressed as the stored tables may be, none is built in the driver's memory."""
    plans = {}

    def planned(df, name):
        plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, name)
    monkeypatch.setattr(near_dedup, "stored", planned)
    kept = near_dedup.keep_one(stored(docs, "docs")[0])
    plans["kept"] = [kept._jdf.queryExecution().executedPlan().toString()]
    assert not {name for name, of in plans.items() if "BroadcastExchange" in "".join(of)}
    assert "SortMergeJoin" in plans["kept"][0] and len(plans["edges"]) == 3
