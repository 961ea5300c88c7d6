import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from crewgate.llm import bpe_tree as B
from tests.llm.conftest import frame

PATH = P.path("byte_bpe_50k.json")
MORE = [(30, "<|endoftext|>"), (31, "a<|endoftext|><|endoftext|> b<|endoftext|"), (32, "x" * 3000),
        (33, "ab1'" * 900), (34, "꟎'s ok ࢏'t"), (35, "été" * 700 + "'s"), (36, " " * 2500 + "z")]


def library():
    return Tokenizer.from_file(PATH)


def want_of(rows):
    tok, out = library(), Counter()
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        out[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("leaf", [None, 40, 900])
def test_equal_to_the_library(spark, rows, leaf, monkeypatch):
    """Every leaf size gives the ids and the decoded text of the library."""
    if leaf:
        monkeypatch.setattr(B, "LEAF", leaf)
    every = rows + MORE
    got = B.round_trip(frame(spark, every).repartition(3), PATH, P.PATTERN).collect()
    assert Counter(map(tuple, got)) == want_of(every)


def test_decode_gives_the_texts_back(spark, rows):
    coded = B.encode(frame(spark, rows + MORE), PATH, P.PATTERN)
    got = B.decode(coded, PATH, P.PATTERN).select("doc_id", "text").collect()
    assert Counter(map(tuple, got)) == Counter((i, t or "") for i, t in rows + MORE)


def pieces(rng):
    """Texts that are hard to cut: runs, contractions, blanks, other scripts."""
    atoms = ["a", "the", "ing", "zq", "'", "'s", "'re", "l", " ", "  ", "\n", "\t", "1", "2024", "!",
             "--", "é", "日本", "🙂", " ", " ", "ꟓ", "ꟓ's", "X", "\x1c", "\x85"]
    few = rng.sample(atoms, rng.randint(1, 6))
    return "".join(rng.choice(few) for _ in range(rng.randint(1, 400)))


def test_joins_at_every_place(monkeypatch):
    """Halving down to a few bytes, with windows of one token at first."""
    rng, tok, codec = random.Random(5), library(), B.Codec(PATH, P.PATTERN)
    for _ in range(1500):
        text = pieces(rng)
        monkeypatch.setattr(B, "LEAF", rng.choice((4, 7, 16, 64)))
        monkeypatch.setattr(B, "WINDOW", rng.choice((1, 2, 16)))
        assert codec.whole(text).tolist() == tok.encode(text, add_special_tokens=False).ids, text


def test_unsplit_runs_keep_what_lies_outside_the_window(monkeypatch):
    """A long run of letters is joined by windows alone, not merged again as a whole."""
    rng, codec = random.Random(6), B.Codec(PATH, P.PATTERN)
    text = "".join(rng.choice("etaoinshr") for _ in range(20_000))
    whole = codec.encoder._encode_single_piece(text.encode())
    longest = 0
    single = codec.encoder._encode_single_piece

    class Watch:
        encode_ordinary = codec.encoder.encode_ordinary

        def _encode_single_piece(self, raw):
            nonlocal longest
            longest = max(longest, len(raw))
            return single(raw)

    parts = [codec.ordinary(p) for p in B.halves(text, 512)]
    codec.encoder = Watch()
    assert B.concatenated(parts, codec).tolist() == whole
    assert 0 < longest < 1000


def test_cuts_hold_in_any_context():
    """Encoding the two sides of a cut apart gives the ids of the whole."""
    rng, tok = random.Random(7), library()
    encode = lambda t: tok.encode(t, add_special_tokens=False).ids
    seen = 0
    for _ in range(800):
        text = pieces(rng)
        if not text.isascii():
            continue
        raw = text.encode()
        for k in B.cuts(raw, np.arange(len(raw) + 1)).tolist():
            if rng.random() < .1:
                assert encode(text[:k]) + encode(text[k:]) == encode(text)
                seen += 1
    assert seen > 200


def test_both_libraries_split_at_the_same_characters():
    tok, enc = library(), B.Codec(PATH, P.PATTERN).encoder
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for lo in range(0, len(points), 8192):
        text = "".join(f"a{chr(c)}b {chr(c)}'s{chr(c)}!" for c in points[lo:lo + 8192])
        assert enc.encode_ordinary(text) == tok.encode(text, add_special_tokens=False).ids, lo


def test_nothing_and_only_empty(spark, nothing):
    assert B.round_trip(nothing, PATH, P.PATTERN).count() == 0
    got = B.round_trip(frame(spark, [(1, None), (None, "")]), PATH, P.PATTERN).collect()
    assert {(r.doc_id, r.n_tokens) for r in got} == {(1, 0), (None, 0)}
