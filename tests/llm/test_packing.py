import math
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from crewgate.llm import packing


def test_best_fit_equals_brute_force():
    rng = random.Random(4)
    bins, free, closed = packing.OpenBins(100, 10 ** 6), [], 0
    for _ in range(3000):
        size = rng.randint(1, 100)
        b, offset = bins.place(size)
        fits = [f for f in free if f >= size]
        if fits:
            assert free[b] == min(fits) and offset == 100 - free[b]
        else:
            assert b == len(free) and offset == 0
            free.append(100)
        free[b] -= size


def test_the_fullest_closes_first():
    bins = packing.OpenBins(10, 2)
    assert [bins.place(s) for s in (6, 7, 9)] == [(0, 0), (1, 0), (2, 0)]   # 7 is fuller than 6
    assert bins.place(3) == (0, 6) and bins.place(3) == (3, 0)   # sequence 1 is closed


def test_cuts():
    assert packing.cuts(5, 10) == [0, 5] and packing.cuts(10, 10) == [0, 10]
    assert packing.cuts(25, 10) == [0, 5, 15, 25] and packing.cuts(20, 10) == [0, 10, 20]


def test_pack_all_rows(docs, rows):
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = packing.pack(docs, P.path("byte_bpe_50k.json"), P.PATTERN).collect()
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    want = defaultdict(list)
    total = 0
    for i, t in rows:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        total += len(ids)
        edge = packing.cuts(len(ids))
        want[i] += [(k, a, b - a, zlib.crc32(ids[a:b].tobytes()))
                    for k, (a, b) in enumerate(zip(edge, edge[1:]))]
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= math.ceil(total / 1024) + 8     # one open rest per task at most


def test_empty_table(nothing):
    assert packing.pack(nothing, P.path("byte_bpe_50k.json"), P.PATTERN).count() == 0


def test_full_pieces_close_no_open_sequence():
    bins = packing.OpenBins(limit=10, most=2)
    assert [bins.place(n) for n in (6, 7)] == [(0, 0), (1, 0)]
    assert [bins.place(10) for _ in range(3)] == [(2, 0), (3, 0), (4, 0)]
    assert bins.n_open == 2 and [bins.place(n) for n in (3, 4)] == [(1, 7), (0, 6)]
