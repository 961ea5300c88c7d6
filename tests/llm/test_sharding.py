import random
import zlib
from collections import defaultdict

from crewgate.llm import sharding
from tests.llm.conftest import frame


def test_tree_equals_a_sorted_list():
    rng, tree, plain = random.Random(8), sharding.CapacityTree(), []
    for k in range(6000):
        if rng.random() < 0.6:
            e = (rng.randint(1, 3000), k)
            tree.add(*e)
            plain.append(e)
        else:
            size = rng.randint(1, 3500)
            fits = [e for e in plain if e[0] >= size]
            got = tree.take_tightest(size)
            assert got == (min(fits) if fits else None)
            if got:
                plain.remove(got)


def test_best_fit_decreasing_equals_brute_force():
    rng = random.Random(3)
    sizes = sorted((rng.randint(1, 100) for _ in range(500)), reverse=True)
    free, want = [], []
    for s in sizes:
        fits = [(f, b) for b, f in enumerate(free) if f >= s]
        b = min(fits)[1] if fits else len(free)
        if not fits:
            free.append(100)
        free[b] -= s
        want.append(b)
    assert sharding.best_fit(sizes, 100) == want


def check(got, rows, shards, even=None):
    assert len(got) == len(rows)
    texts, slots, sizes = defaultdict(set), defaultdict(list), [0] * shards
    want = sorted((i is not None, i or 0, len((t or "").encode()) + 8,
                   zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r["size"], r.text_crc32)
                  for r in got) == want
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        texts[r.text_crc32, r["size"]].add(r.shard)
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r["size"]
    assert all(len(s) == 1 for s in texts.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if even:
        assert max(sizes) <= even * sum(sizes) / shards
    return sizes


def test_shards(spark, docs, rows, nothing):
    check(sharding.shard(docs).collect(), rows, 24)
    assert sharding.shard(nothing).count() == 0
    rng = random.Random(5)
    many = [(k, "x" * rng.randint(0, 400) + str(rng.randint(0, 3))) for k in range(4000)]
    sizes = check(sharding.shard(frame(spark, many).repartition(5)).collect(), many, 24, 1.01)
    assert min(sizes) > 0.9 * sum(sizes) / 24


def test_a_group_with_a_third_of_all_rows(spark):
    rows = [(k, "copy" if k % 3 == 0 else f"text {k}") for k in range(900)]
    check(sharding.shard(frame(spark, rows).repartition(4), shards=3).collect(), rows, 3, 1.05)
