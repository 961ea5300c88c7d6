import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from crewgate.llm import arrays as A
from crewgate.llm import textstats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts():
    rng = random.Random(1)
    letters = ["a", "b", " ", "\n", "é", "#", "\t", "x y", "日"]
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 90)))
            for _ in range(400)] + ["", None, " ", "a"]


def test_words_lines_and_hashes():
    data, offsets = A.text_bytes(pa.array(texts()))
    start, end, doc = A.words(data, offsets)
    got = [bytes(data[a:b]).decode() for a, b in zip(start, end)]
    assert list(zip(doc.tolist(), got)) == [
        (i, w) for i, t in enumerate(texts()) for w in WORD.findall(t or "")]
    known = {}
    for w, h in zip(got, A.segment_hash(data, start, end).tolist()):
        assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)
    ls, le, ldoc = A.lines(data, offsets)
    assert [(i, bytes(data[a:b]).decode()) for i, a, b in zip(ldoc.tolist(), ls, le)] == [
        (i, x) for i, t in enumerate(texts()) for x in (t or "").split("\n") if x]


def brute(text):
    """Base counts of one text, by the words of the contract."""
    w = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    often = Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7))
    hit = np.zeros(len(w), bool)
    for k in range(len(w) - 7):
        if often[tuple(w[k:k + 8])] > 1:
            hit[k:k + 8] = True
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup,
            int(hit.sum()))


def test_counts_equal_brute_force():
    rng = random.Random(5)
    more = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    column = pa.array(texts() + more)
    c = textstats.counts(*A.text_bytes(column))
    got = list(zip(*(c[k].tolist() for k in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))))
    assert got == [brute(t) for t in texts() + more]


def test_sliced_and_empty_columns():
    column = pa.array(["x y", "z", None, "w w"]).slice(1, 3)
    data, offsets = A.text_bytes(column)
    assert bytes(data) == b"zw w" and offsets.tolist() == [0, 1, 1, 4]
    data, offsets = A.text_bytes(pa.array([], pa.string()))
    assert [len(x) for x in A.words(data, offsets)] == [0, 0, 0]
    assert [len(x) for x in A.lines(data, offsets)] == [0, 0, 0]
