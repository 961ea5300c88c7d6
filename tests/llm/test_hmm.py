import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from crewgate.llm import hmm
from crewgate.llm.common import table
from tests.llm.conftest import SF


def test_recursions_equal_the_sum_over_all_paths():
    rng = np.random.default_rng(0)
    k, m = 3, 5
    start, move = rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k)
    emit = rng.dirichlet(np.ones(m), k).T
    sequences = [rng.integers(0, m, n) for n in (1, 4, 6, 2, 5)]
    logs = hmm.log_probabilities(sequences, start, move, emit)
    want = [np.zeros(k), np.zeros((k, k)), np.zeros((k, m))]
    for s, lp in zip(sequences, logs):
        total, part = 0.0, [np.zeros_like(w) for w in want]
        for path in itertools.product(range(k), repeat=len(s)):
            p = start[path[0]] * emit[s[0], path[0]]
            for t in range(1, len(s)):
                p *= move[path[t - 1], path[t]] * emit[s[t], path[t]]
            total += p
            part[0][path[0]] += p
            for t in range(len(s)):
                part[2][path[t], s[t]] += p
                if t:
                    part[1][path[t - 1], path[t]] += p
        assert abs(math.log10(total) - lp) < 1e-9
        want = [w + x / total for w, x in zip(want, part)]
    for a, b in zip(want, hmm.expected_counts(sequences, start, move, emit)):
        assert np.allclose(a, b)


def test_every_round_reads_all_training_documents(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(k, True, (1 + rng.integers(0, 4, 6) + 4 * (k % 2)).astype("<u2").tobytes())
            for k in range(2500)]
    coded = spark.createDataFrame(
        rows, "doc_id long, train boolean, symbols binary").repartition(2).cache()
    seen, logs, one_round = [], [], hmm.one_round

    def watched(sequences, model, symbols):
        seen.append(sequences.count())
        got = one_round(sequences, model, symbols)
        logs.append(got[1])
        return got

    monkeypatch.setattr(hmm, "one_round", watched)
    symbols = np.r_[0.0, np.full(8, 1875.0), 2500.0]
    hmm.fit(coded, symbols)
    assert set(seen) == {2500} and len(seen) >= 9
    assert logs[-1] > logs[0] and logs[-1] - logs[-2] < hmm.GAIN * -logs[-2]


def test_counts_come_with_the_log_probability():
    rng = np.random.default_rng(2)
    model = rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(7), 3).T
    sequences = [rng.integers(0, 7, n) for n in (1, 9, 4)]
    assert np.isclose(hmm.expected_counts(sequences, *model)[3],
                      hmm.log_probabilities(sequences, *model).sum())


def test_cuts_change_no_count(monkeypatch):
    """Texts cut into short segments give the counts of whole ones."""
    rng = np.random.default_rng(3)
    model = rng.dirichlet(np.ones(4)), rng.dirichlet(np.ones(4), 4), rng.dirichlet(np.ones(9), 4).T
    sequences = [rng.integers(0, 9, n) for n in (1, 2000, 17, 5, 6, 640)]
    whole = hmm.expected_counts(sequences, *model)
    for segment in (5, 16, 1999):
        monkeypatch.setattr(hmm, "SEGMENT", segment)
        for a, b in zip(whole, hmm.expected_counts(sequences, *model)):
            assert np.allclose(a, b)


def test_half_precision_in_tasks_is_enough():
    """The rounds count in 32-bit numbers: nearly the counts of 64-bit ones."""
    rng = np.random.default_rng(4)
    model = rng.dirichlet(np.ones(8)), rng.dirichlet(np.ones(8), 8), rng.dirichlet(np.ones(50), 8).T
    sequences = [rng.integers(0, 50, n) for n in (3000, 10, 200)]
    small = tuple(x.astype(np.float32) for x in model)
    for a, b in zip(hmm.expected_counts(sequences, *model), hmm.expected_counts(sequences, *small)):
        assert np.allclose(a, b, rtol=1e-3, atol=1e-2)


def test_partitions_change_no_score(spark, docs, monkeypatch):
    """With rare words in classes, 8 and 60 shuffle partitions give the same scores."""
    monkeypatch.setattr(hmm, "SYMBOLS", 300)
    monkeypatch.setattr(hmm, "CLASSES", 50)
    monkeypatch.setattr(hmm, "ROUNDS", 2)
    monkeypatch.setattr(hmm, "GAIN", 1.0)
    scores = []
    for n in (8, 60):
        monkeypatch.setattr(hmm, "FLUSH", 10 ** 6 // n ** 2)
        spark.conf.set("spark.sql.shuffle.partitions", n)
        scores.append(sorted((r.doc_id or 0, r.n_tokens, r.score) for r in hmm.score(docs).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    for a, b in zip(*scores):
        assert a[:2] == b[:2] and math.isclose(a[2], b[2], rel_tol=1e-5)


def test_classes_share_out_their_mass(spark, docs, rows, monkeypatch):
    """Own words, classes and the end add up to all training tokens."""
    monkeypatch.setattr(hmm, "SYMBOLS", 100)
    monkeypatch.setattr(hmm, "CLASSES", 16)
    vocab = hmm.count_words(docs).cache()
    of = hmm.Vocabulary(vocab, docs.count())
    counts = Counter(w for _, t in rows for w in hmm.split((t or "").encode()))
    assert {bytes(r.word): r.n for r in vocab.collect()} == counts
    assert of.tokens == sum(counts.values()) + len(rows) and of.types == len(counts) + 1
    assert of.symbols.sum() == of.tokens and len(of.own) == 100
    assert [n for n in of.own_counts] == sorted(counts.values(), reverse=True)[:100]
    rest = Counter()
    for w, n in counts.items():
        if w not in of.own:
            rest[zlib.crc32(w) % 16] += n + hmm.ADD
    assert np.allclose(of.mass, [rest[k] + hmm.ADD for k in range(16)])


def base_rows(rows):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    lower = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    counts, out = Counter(), []
    toks = [(i, word.findall((t or "").translate(lower)) + [None]) for i, t in rows]
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    for i, w in toks:
        if not held(i):
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    for i, w in toks:
        out.append((i, held(i), len(w), sum(counts[x] > 0 for x in w), n,
                    sum(math.log10((counts[x] + .1) / (n + .1 * (v + 1))) for x in w)))
    return out


def compare(got, want):
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], r[5])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5] and abs(g[5] - w[5]) < 1e-6 and math.isfinite(g[6]) and g[6] < 0


def test_rows_on_messy_documents(docs, rows, nothing):
    compare(hmm.score(docs).collect(), base_rows(rows))
    assert hmm.score(nothing).count() == 0


def test_held_out_texts_score_above_the_base(spark):
    docs = table(spark, SF, "documents")
    got = hmm.score(docs).collect()
    compare(got, base_rows([(r.doc_id, r.text) for r in docs.collect()]))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_no_training_documents(spark, docs):
    from pyspark.sql import functions as F

    got = hmm.score(docs, F.lit(False)).collect()
    assert {r.train_tokens for r in got} == {0} and all(math.isfinite(r.score) for r in got)


def test_words_of_a_slice_are_those_of_split():
    import pyarrow as pa

    texts = [b"A b\xff \x80B", None, b"", b" \t\x0b\x0c\r\n", "É\x85À Z q\x1cQ\u3000x\0y".encode(), b"a"]
    part = pa.RecordBatch.from_pydict({"text": pa.array(texts).cast(pa.string(), safe=False)})
    for lo in range(len(texts)):
        n, words = hmm.words_of(part.slice(lo))
        want = [hmm.split(t or b"") for t in texts[lo:]]
        assert n.tolist() == list(map(len, want)) and words.to_pylist() == sum(want, [])


@pytest.mark.parametrize("known", [0, 700])
def test_known_words_stay_out_of_the_join(spark, docs, rows, monkeypatch, known):
    """However many words are known to all tasks, the others alone are joined and the
    sums over both are those of all counts."""
    monkeypatch.setattr(hmm, "SYMBOLS", 100)
    monkeypatch.setattr(hmm, "KNOWN", known)
    vocab = hmm.count_words(docs).cache()
    of = hmm.Vocabulary(vocab, docs.count())
    counts = Counter(w for _, t in rows for w in hmm.split((t or "").encode()))
    assert len({n for n in counts.values()}) > 3 and len(counts) > 1000
    assert bool(of.known) == (known > 0) and len(of.known) <= known
    far = {w: n for w, n in counts.items() if w not in of.own}
    assert of.known.keys() == {w for w in far if far[w] > of.known_above}
    got = hmm.code(docs, docs.doc_id.isNotNull(), of)
    rest = vocab.where(vocab.n <= of.known_above)
    sums = {r.rid: r for r in hmm.rare_sums(got, rest).collect()}
    coded = got.collect()
    want = sorted((sum(math.log10(counts[w] + hmm.ADD) for w in hmm.split((t or "").encode())
                       if w in far), len(hmm.split((t or "").encode()))) for _, t in rows)
    have = sorted((r.known_log + (sums[r.rid].rare_log if r.rid in sums else 0.0),
                   r.n_known + (sums[r.rid].rare_known if r.rid in sums else 0)) for r in coded)
    assert np.allclose(have, want)
    assert {bytes(w) for r in coded for w in r.rare} == far.keys() - of.known.keys()


def test_rare_transitions_stay_within_half_precision():
    """Transitions of 1e-12 at every step, scaled at every third: 32-bit counts are finite
    and those of 64-bit numbers, whatever place a text ends at."""
    start, move = np.array([1 - 1e-12, 1e-12]), np.eye(2) + 1e-12
    emit = np.array([[1.0, 1e-25], [1e-25, 1.0]])
    assert hmm.unscaled(start, move) == 3 and hmm.unscaled(move ** 2) == 1
    sequences = [np.arange(1, n + 1) % 2 for n in range(1, 12)]
    small = tuple(x.astype(np.float32) for x in (start, move, emit))
    got = hmm.expected_counts(sequences, *small)
    for a, b in zip(hmm.expected_counts(sequences, start, move, emit), got):
        assert np.all(np.isfinite(b)) and np.allclose(a, b, rtol=1e-4)
    assert np.isclose(got[3], hmm.log_probabilities(sequences, start, move, emit).sum())


def test_rounds_take_texts_of_like_length_together(monkeypatch):
    """A round over texts of mixed lengths takes the steps of the longest once, and its
    counts are those of the texts one by one."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    model = rng.dirichlet(np.ones(4)), rng.dirichlet(np.ones(4), 4), rng.dirichlet(np.ones(9), 4).T
    texts = [rng.integers(0, 8, n) for n in [10, 0, 400] * 8]
    batch = pa.RecordBatch.from_pydict({"symbols": [t.astype("<u2").tobytes() for t in texts]})
    want = [hmm.expected_counts([np.append(t, 8)], *model) for t in texts]
    packed, steps = hmm.Packed, []

    def watched(sequences):
        steps.append(max(map(len, sequences)))
        return packed(sequences)

    monkeypatch.setattr(hmm, "Packed", watched)
    monkeypatch.setattr(hmm, "CHUNK", 1600)
    got, = hmm.counter(model)([batch.slice(0, 7), batch.slice(7)])
    part = dict(zip(got.column("key").to_pylist(), map(np.frombuffer, got.column("numbers").to_pylist())))
    assert steps == [401, 401, 11]
    assert np.allclose(part[-1][:4], sum(w[0] for w in want), rtol=1e-4)
    assert np.allclose(part[-1][4:20].reshape(4, 4), sum(w[1] for w in want), rtol=1e-3)
    assert np.isclose(part[-1][-1], sum(w[3] for w in want), rtol=1e-5)
    emitted = [np.concatenate([part[k * hmm.SLICES + i] for i in range(hmm.SLICES)]) for k in range(4)]
    assert np.allclose(emitted, sum(w[2] for w in want), rtol=1e-3)
