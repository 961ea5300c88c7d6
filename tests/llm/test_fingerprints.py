import hashlib
import random

from crewgate.llm import fingerprints as L
from tests.llm.conftest import frame


def brute(data):
    """Phrases of the sequential parse, one byte at a time."""
    seen, start = set(), 0
    for end in range(1, len(data) + 1):
        if data[start:end] not in seen:
            seen.add(data[start:end])
            start = end
    return seen


def test_parse_and_continued_parse():
    rng = random.Random(2)
    for _ in range(500):
        t, u = ("".join(rng.choice("abé ") for _ in range(rng.randint(0, 80))) for _ in range(2))
        p, q = L.parse_all([(1, t), (2, u)])
        data, cut = t.encode(), [0, *p.ends]
        assert {data[a:b] for a, b in zip(cut, p.ends)} == brute(data)
        assert len(p.ends) == len(p.trie) == len(brute(data))
        row, = L.rows([(p, q)])
        edited = t[:len(t) - len(t) // 4] + u[:len(t) // 4]
        assert row[4] == L.show(L.parse_all([(0, edited)])[0].sig)


def test_likeness_is_the_jaccard_of_small_sets():
    rng = random.Random(6)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(1, 60))).encode()
                for _ in range(2))
        p, q = L.parse_all([(0, a.decode()), (0, b.decode())])
        x, y = brute(a), brute(b)
        assert abs(L.likeness(p.sig, q.sig) - len(x & y) / len(x | y)) < 1e-12


def check(got, rows):
    order = sorted(((i is not None, i or 0), t or "") for i, t in rows)
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    unique = [i for i, _ in rows]
    for k, ((has, i), t) in enumerate(order):
        if not has or unique.count(i) > 1:
            continue
        following = order[(k + 1) % len(order)]
        r, = by_id[i]
        if following[0][0] and unique.count(following[0][1]) > 1:
            continue          # which of the repeated ids comes first is by hash
        edited = t[:len(t) - len(t) // 4] + following[1][:len(t) // 4]
        assert r.n_chars == len(t)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        p, e, f = L.parse_all([(0, t), (0, edited), (0, following[1])])
        assert (r.fingerprint, r.edited_fingerprint) == (L.show(p.sig), L.show(e.sig))
        assert r.near_edited == L.likeness(p.sig, e.sig)
        assert r.near_next == L.likeness(p.sig, f.sig)


def test_query_rows(spark, docs, rows, nothing):
    for n in (1, 3, 64):
        check(L.compare_edited(docs, n).collect(), rows)
    assert L.compare_edited(nothing).count() == 0
    check(L.compare_edited(docs).collect(), rows)


def test_one_document_follows_itself(spark):
    r, = L.compare_edited(frame(spark, [(5, "abcdefgh")]), 4).collect()
    assert r.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and r.near_next == 1.0
    got = L.compare_edited(frame(spark, [(1, None), (2, ""), (3, "x")]), 4).orderBy("doc_id").collect()
    assert [r.near_next for r in got] == [1.0, 0.0, 0.0]
