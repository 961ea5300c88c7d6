"""Operator 7: a hidden Markov language model, trained by Baum-Welch.

Vocabulary.  Words are counted over all training documents by a ``groupBy``.  The
``SYMBOLS`` most frequent words of the whole corpus are symbols of their own (ties by
the word's bytes), whatever the number of partitions.  Every other word belongs to
a class by the crc32 of its bytes, one class for ``CLASS_WORDS`` other words and at
most ``CLASSES``: the states emit the class, and
the word is a draw from the smoothed counts of the class, in which one share is kept
for words never seen.  The end of a text is a symbol too.  So the model is a proper
distribution over word sequences of any length, and every word takes part in the
latent states, its own or its class's; the model's size is fixed.

Training.  Parameters start from noise around the word frequencies and sticky
transitions.  Every round runs over all training documents: ``ROUNDS`` rounds at
least, then on until a round raises the log-likelihood by less than the share
``GAIN``.  A round sends the parameters (bounded: states x symbols) to all
partitions; each adds up the expected counts of its texts, and Spark sums them
by state and slice of symbols.  The recursions run over many segments of up to ``SEGMENT``
words in step, those of like length together.  A longer text is cut, and the messages over its cuts are found first,
from the product of the transition matrices of every segment; so the counts are
those of whole texts, cuts or not.

Scoring.  The scaled forward recursion runs over the whole text, all texts of
an Arrow batch in step; the logarithms of the scales add up to the exact
log10 probability.  The counts of up to ``KNOWN`` most frequent words go to all tasks
that code texts; those of the other words come from a join with the counted words, so
no frequent word takes part in it.

Scale.  Memory in a task is bounded by a slice of texts, ``WAIT`` symbols of two bytes,
``CHUNK`` symbols in the recursions and the model, or by one text; word counts are
flushed every ``FLUSH`` bytes of words.

Edge cases.  Null and empty texts are the end symbol alone.  A null doc id
counts as held out.  Without training documents all counts are 0 and the
recursion runs on the starting parameters.  Repeated rows are counted and
scored each; other columns are never read.  An empty table gives no row.

Building the result runs the training (Spark jobs); the scores are computed lazily.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewgate.llm.common import crc32_of_id, slices, stored

STATES, SYMBOLS, CLASSES, CLASS_WORDS = 8, 16384, 4096, 256
ROUNDS, GAIN = 9, 1e-4
SEGMENT, CHUNK, WAIT = 16384, 1 << 20, 1 << 22
FLUSH = 32 << 20
KNOWN = 1 << 18
EVERY = 3                    # steps from one scaling to the next, see ``unscaled``
SLICES, PRIOR = 16, 200.0
ADD = 0.1                    # smoothing of the contract's base score
CODED = ("doc_id long, train boolean, n_words long, n_known long, own_log double, "
         "known_log double, class_log double, symbols binary, rare array<binary>")
SCORED = ("rid long, doc_id long, held_out boolean, n_words long, n_known long, own_log double, "
          "known_log double, class_log double, log double")


def split(text: bytes) -> list[bytes]:
    return text.lower().split()      # of bytes: ASCII case and ASCII white space only


def words_of(part):
    """How many words every text of a slice of an Arrow batch has, and all of them in one
    array, as ``split`` finds them."""
    import pyarrow as pa
    import pyarrow.compute as pc

    text = part.column("text").cast(pa.binary()).cast(pa.string(), safe=False).fill_null("")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(text))
    words, ends = lists.values.cast(pa.binary()), lists.offsets.to_numpy()
    some = pc.greater(pc.binary_length(words), 0)
    upto = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
    return np.diff(upto[ends]), words.filter(some)


def count_words(documents: DataFrame) -> DataFrame:
    """(word, n) over all of ``documents`` (text)."""
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        waiting, size = [], 0

        def flush():
            counts = pc.value_counts(pa.chunked_array(waiting, pa.binary()))
            return pa.RecordBatch.from_arrays(
                [counts.field("values"), counts.field("counts")], ["word", "n"])

        for batch in batches:
            for part in slices(batch):
                waiting.append(words_of(part)[1])
                size += waiting[-1].nbytes
                if size >= FLUSH:
                    yield flush()
                    waiting, size = [], 0
        yield flush()
    return documents.select("text").mapInArrow(run, "word binary, n long") \
        .groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Own and known words, class masses and totals: SYMBOLS and KNOWN words and CLASSES
    numbers, whatever the corpus holds."""

    def __init__(self, vocab: DataFrame, ends: int):
        often = vocab.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(
            F.desc("n")).limit(max(SYMBOLS, KNOWN) + 1).collect()
        held = np.cumsum([r["words"] for r in often])
        least = lambda k: often[k]["n"] if k < len(often) else 0
        rows = vocab.where(F.col("n") >= least(int(np.searchsorted(held, SYMBOLS)))).orderBy(
            F.desc("n"), "word").limit(SYMBOLS).collect()
        # words with a higher count are known, KNOWN at most; none of the others
        self.known_above = least(int(np.searchsorted(held, KNOWN, side="right")))
        known = vocab.where(F.col("n") > self.known_above).collect()
        self.own = {bytes(r["word"]): k for k, r in enumerate(rows)}
        self.own_counts = np.array([r["n"] for r in rows], dtype=float)
        known = [r for r in known if bytes(r["word"]) not in self.own]
        self.known = {bytes(r["word"]): len(rows) + k for k, r in enumerate(known)}
        self.known_counts = np.array([r["n"] for r in known], dtype=float)
        least = rows[-1] if rows else None
        rare = vocab.where(F.lit(False)) if least is None else vocab.where(
            (F.col("n") < least["n"]) | (F.col("n") == least["n"]) & (F.col("word") > F.lit(
                bytes(least["word"]))))
        self.classes = min(max(rare.count() // CLASS_WORDS, 1), CLASSES)
        counts, types = np.zeros(self.classes), np.zeros(self.classes)
        for r in rare.groupBy((F.crc32("word") % self.classes).alias("class")).agg(
                F.sum("n").alias("n"), F.count(F.lit(1)).alias("types")).collect():
            counts[r["class"]], types[r["class"]] = r["n"], r["types"]
        self.mass = counts + ADD * (types + 1)
        self.ends = ends
        self.tokens = int(self.own_counts.sum() + counts.sum()) + ends
        self.types = len(rows) + int(types.sum()) + (ends > 0)
        self.symbols = np.concatenate([self.own_counts, counts, [ends]])


def code(documents: DataFrame, train, of: Vocabulary) -> DataFrame:
    """Documents as symbols, with the sums that the counts of own and known words give and
    the words that are neither."""
    places, classes, first = {**of.own, **of.known}, of.classes, len(of.own)
    logs = np.log10(np.concatenate([of.own_counts, of.known_counts]) + ADD)
    class_log = np.log10(of.mass)

    def run(batches):
        import pyarrow as pa

        unknown = len(places)
        for batch in batches:
            for part in slices(batch):
                n, flat = words_of(part)
                doc, flat = np.repeat(np.arange(len(n)), n), flat.dictionary_encode()
                words = flat.dictionary.to_numpy(zero_copy_only=False)   # each word once
                place = np.fromiter((places.get(w, unknown) for w in words), np.int64, len(words))
                symbol, far = place.copy(), place >= first
                symbol[far] = np.fromiter(map(zlib.crc32, words[far]), np.int64) % classes + first
                at = flat.indices.to_numpy()
                place, symbol = place[at], symbol[at]
                far, rare = symbol >= first, place == unknown
                total = lambda at, x=None: np.bincount(doc[at], x, len(n))  # noqa: E731, B023
                known, n_rare = far & ~rare, total(rare)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "train": part.column("train"),
                    "n_words": pa.array(n), "n_known": pa.array(n - n_rare),
                    "own_log": pa.array(total(~far, logs[place[~far]]), pa.float64()),
                    "known_log": pa.array(total(known, logs[place[known]]), pa.float64()),
                    "class_log": pa.array(total(far, class_log[symbol[far] - first]), pa.float64()),
                    "symbols": pa.Array.from_buffers(pa.binary(), len(n), [
                        None, pa.py_buffer(edges(2 * n)), pa.py_buffer(symbol.astype("<u2"))]),
                    "rare": pa.ListArray.from_arrays(
                        edges(n_rare), flat.dictionary.take(pa.array(at[rare])))})
    rows = documents.select("doc_id", "text", F.coalesce(train, F.lit(False)).alias("train"))
    return stored(rows.mapInArrow(run, CODED).withColumn(
        "rid", F.monotonically_increasing_id()), "hmm-symbols")[0]


def edges(sizes):
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)


def rare_sums(coded: DataFrame, vocab: DataFrame) -> DataFrame:
    """(rid, rare_log, rare_known): a text's words that are neither own nor known; ``vocab``
    has the counts of such words."""
    words = coded.select("rid", F.explode("rare").alias("word"))
    return words.join(vocab, "word", "left").groupBy("rid").agg(
        F.sum(F.log10(F.coalesce("n", F.lit(0)) + ADD)).alias("rare_log"),
        F.count("n").alias("rare_known"))


class Packed:
    """Sequences laid out by time, longest first: step t holds the first n[t] of them."""

    def __init__(self, sequences):
        size = np.array([len(s) for s in sequences], dtype=np.int64)
        self.order = np.argsort(-size, kind="stable")
        self.size = size = size[self.order]
        steps = int(size[0]) if len(size) else 0
        self.n = np.searchsorted(-size, -np.arange(steps), side="left")
        self.at = np.concatenate([[0], np.cumsum(self.n)])
        flat = np.concatenate([sequences[k] for k in self.order]) if steps else np.zeros(0, int)
        t = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        self.symbols = np.empty(len(flat), np.int64)
        self.symbols[self.at[t] + np.repeat(np.arange(len(size)), size)] = flat

    def last(self):
        """Where the last symbol of every sequence lies."""
        return self.at[self.size - 1] + np.arange(len(self.size))


def all_ones(move):
    """Times this, a row of states becomes its sum in every place: one matrix product in
    place of a sum and a division along rows of a few numbers, which NumPy does row by row."""
    return np.ones(move.shape, move.dtype)


def levelled(emit):
    """Emissions over the highest of their symbol, and the latter."""
    top = emit.max(axis=1)
    return emit / top[:, None], top


def unscaled(*probabilities):
    """Steps from one scaling to the next, ``EVERY`` at most.

    With ``levelled`` emissions a step leaves at least the least start or transition
    probability of a message's sum, and a message back grows by its inverse at most; so
    all numbers stay within 1e-36 and 1e36, as 32-bit ones must.
    """
    least = min(float(p.min()) for p in probabilities)
    return max(min(int(36 / -np.log10(min(least, 0.1))), EVERY), 1) if least > 0 else 1


def log_probabilities(sequences, start, move, emit):
    """log10 probability of every sequence by the scaled forward recursion.

    ``emit`` is (symbols x states).
    """
    p = Packed(sequences)
    emit, top = levelled(emit)
    logs = np.log10(top)
    out = np.array([logs[s].sum() for s in sequences], float)[p.order]
    a, ones, every = None, all_ones(move), unscaled(start, move)
    at, count = p.at.tolist(), [*p.n.tolist(), 0]
    for t, n in enumerate(count[:-1]):
        a = (start if a is None else a[:n] @ move) * emit.take(p.symbols[at[t]:at[t + 1]], axis=0)
        if t % every == 0:
            c = a @ ones
            a /= c
            out[:n] += np.log10(c[:, 0])
        if (k := count[t + 1]) < n:
            out[k:n] += np.log10(a[k:].sum(axis=1))
    result = np.empty(len(sequences))
    result[p.order] = out
    return result


def transfers(pieces, first, move, emit):
    """Scaled product of transitions and emissions over every piece, all in step; the
    first piece of a text starts without a transition."""
    p = Packed(pieces)
    states, every, (emit, _) = len(move), unscaled(move), levelled(emit)
    m = np.where(np.asarray(first)[p.order, None, None], np.eye(states, dtype=move.dtype), move)
    for t, n in enumerate(p.n.tolist()):
        e = emit.take(p.symbols[p.at[t]:p.at[t + 1]], axis=0)[:, None, :]
        now = ((m[:n].reshape(-1, states) @ move).reshape(n, states, states) if t else m[:n]) * e
        if t % every == 0:
            now /= now.reshape(n, -1).sum(axis=1)[:, None, None]
        m[:n] = now
    m /= m.reshape(len(m), -1).sum(axis=1)[:, None, None]
    out = np.empty_like(m)
    out[p.order] = m
    return out


def pieces_of(sequences, start, move, emit):
    """(symbols, message into the piece or None, message back into it) of all pieces.

    The message into a piece is the state distribution after the piece before it; the
    one back, what follows tells about its last state, scaled to the former.
    """
    out, long = [], []
    ones = np.ones(len(start), dtype=emit.dtype)
    for s in sequences:
        if len(s) > SEGMENT:
            long.append([s[lo:lo + SEGMENT] for lo in range(0, len(s), SEGMENT)])
        else:
            out.append((s, None, ones))
    if long:
        product = transfers([x for text in long for x in text],
                            [k == 0 for text in long for k in range(len(text))], move, emit)
        at = 0
        for text in long:
            own = product[at:at + len(text)]
            at += len(text)
            ends, a = [], start
            for t in own:
                a = a @ t
                a = a / a.sum()
                ends.append(a)
            back, v = [], ones
            for k in range(len(text) - 1, -1, -1):
                back.append(v / (ends[k] @ v))
                v = own[k] @ v
                v = v / v.sum()
            out += zip(text, [None, *ends[:-1]], back[::-1])
    return out


def expected_counts(sequences, start, move, emit):
    """Baum-Welch counts of whole sequences: (start, transitions, emissions by state),
    and their log10 probability."""
    return counts_of_pieces(pieces_of(sequences, start, move, emit), start, move, emit)


def counts_of_pieces(pieces, start, move, emit):
    p = Packed([s for s, _, _ in pieces])
    states = len(start)
    into = [pieces[k][1] for k in p.order]
    back = np.array([pieces[k][2] for k in p.order], emit.dtype).reshape(-1, states)
    fresh = np.array([m is None for m in into], bool)
    before = np.array([np.zeros(states) if m is None else m for m in into],
                      emit.dtype).reshape(-1, states)
    level, top = levelled(emit)
    e, every = level.take(p.symbols, axis=0), unscaled(start, move)
    alpha, scales = np.empty_like(e), []
    a, ones, at = np.where(fresh[:, None], start, before @ move), all_ones(move), p.at.tolist()
    for t, n in enumerate(p.n.tolist()):
        lo, hi = at[t], at[t + 1]
        now, own = alpha[lo:hi], e[lo:hi]
        if t:
            np.matmul(a[:n], move, out=now)
            now *= own
        else:
            np.multiply(a, own, out=now)
        if t % every == 0:
            c = now @ ones
            now /= c
            own /= c
            scales.append(c[:, 0].copy())
        a = now
    if len(p.n):
        c = alpha[p.last()] @ ones
        back /= c
        scales.append(c[:, 0])
    moved, undo = np.zeros((states, states)), np.ascontiguousarray(move.T)
    b, room = np.ones((0, states), emit.dtype), np.empty((len(pieces), states), emit.dtype)
    for t in range(len(p.n) - 1, -1, -1):
        lo, hi = at[t], at[t + 1]
        k, n = len(b), hi - lo
        now, own = room[:n], alpha[lo:hi]
        if k < n:
            now[k:] = back[k:n]
        if k:
            moved += own[:k].T @ b
            np.matmul(b, undo, out=now[:k])
        own *= now
        b = e[lo:hi]
        b *= now
    if len(p.n):
        moved += before.T @ b           # over the cuts; nothing comes into a first piece
        first = alpha[:p.n[0]][fresh].sum(axis=0, dtype=float)
    else:
        first = np.zeros(states)
    emitted = np.stack([np.bincount(p.symbols, alpha[:, s], minlength=len(emit))
                        for s in range(states)])
    logs = np.bincount(p.symbols, minlength=len(emit)) @ np.log10(top.astype(float))
    return first, moved * move, emitted, logs + sum(
        np.log(c).sum(dtype=float) for c in scales) / np.log(10)


def sequences_of(batch, end: int):
    """The symbols of every text of an Arrow batch, the end included."""
    raw = batch.column("symbols")
    bounds = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset:raw.offset + len(raw) + 1] // 2
    data = np.frombuffer(raw.buffers()[2] or b"", "<u2")[bounds[0]:bounds[-1]]
    bounds = bounds - bounds[0]
    data = np.insert(data, bounds[1:], end)
    return np.split(data, (bounds[1:] + np.arange(1, len(bounds)))[:-1]) if len(raw) else []


def counter(model):
    """Task side of a round: the counts of a partition as (key, numbers) rows."""
    model = tuple(x.astype(np.float32) for x in model)

    def run(batches):
        import pyarrow as pa

        states, total = len(model[0]), None

        def add(chunk):
            nonlocal total
            got = counts_of_pieces(chunk, *model)
            total = got if total is None else tuple(x + y for x, y in zip(total, got))

        def add_all(waiting):
            chunk, size = [], 0
            for piece in sorted(pieces_of(waiting, *model), key=lambda x: -len(x[0])):
                chunk.append(piece)
                size += len(piece[0])
                if size >= CHUNK:
                    add(chunk)
                    chunk, size = [], 0
            if chunk:
                add(chunk)

        waiting, size = [], 0
        for batch in batches:
            for s in sequences_of(batch, len(model[2]) - 1):
                waiting.append(s)
                size += len(s)
                if size >= WAIT:
                    add_all(waiting)
                    waiting, size = [], 0
        add_all(waiting)
        if total is None:
            return
        keys, values = [-1], [np.concatenate([total[0], total[1].ravel(), [total[3]]]).tobytes()]
        for k in range(states):
            for i, part in enumerate(np.array_split(total[2][k], SLICES)):
                keys.append(k * SLICES + i)
                values.append(part.tobytes())
        yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.int32()),
                                          "numbers": pa.array(values, pa.binary())})
    return run


def add_up(batches):
    import pyarrow as pa

    total = {}
    for batch in batches:
        for k, raw in zip(batch.column("key").to_pylist(), batch.column("numbers").to_pylist()):
            x = np.frombuffer(raw)
            total[k] = total[k] + x if k in total else x
    if total:
        yield pa.RecordBatch.from_pydict({
            "key": pa.array(list(total), pa.int32()),
            "numbers": pa.array([x.tobytes() for x in total.values()], pa.binary())})


def first_model(symbols, states: int):
    rng = np.random.default_rng(11)
    emit = (symbols + ADD)[:, None] * np.exp(0.5 * rng.standard_normal((len(symbols), states)))
    move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    return np.full(states, 1.0 / states), move, emit / emit.sum(axis=0)


def one_round(sequences: DataFrame, model, symbols):
    """New parameters from the expected counts of all ``sequences``, and the log10
    probability of these under the old ones (None without sequences)."""
    schema = "key int, numbers binary"
    got = sequences.select("symbols").mapInArrow(counter(model), schema) \
        .repartition("key").mapInArrow(add_up, schema).collect()   # states x symbols numbers
    if not got:
        return model, None
    part = {r["key"]: np.frombuffer(r["numbers"]) for r in got}
    states = len(model[0])
    start = part[-1][:states] + 1.0
    move = part[-1][states:-1].reshape(states, states) + 1.0
    unigram = (symbols + ADD) / (symbols + ADD).sum()
    emit = np.stack([np.concatenate([part[k * SLICES + i] for i in range(SLICES)])
                     for k in range(states)], axis=1) + PRIOR * unigram[:, None]
    return (start / start.sum(), move / move.sum(axis=1, keepdims=True),
            emit / emit.sum(axis=0)), float(part[-1][-1])


def fit(coded: DataFrame, symbols):
    train = coded.where("train").select("symbols")
    model, last, n = first_model(symbols, STATES), None, 0
    while True:
        model, logs = one_round(train, model, symbols)
        n += 1
        if logs is None or n >= ROUNDS and not logs - last >= GAIN * -last:
            return model
        last = logs


def score(documents: DataFrame, train=None) -> DataFrame:
    """Train on the rows where ``train`` holds, score all: doc_id, held_out, n_tokens,
    n_known, train_tokens, base_score, score."""
    train = crc32_of_id() % 10 != 0 if train is None else train
    learnt = documents.where(train)
    vocab, _ = stored(count_words(learnt), "hmm-words")
    of = Vocabulary(vocab, learnt.count())
    coded = code(documents, train, of)
    model = fit(coded, of.symbols)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            logs = log_probabilities(sequences_of(batch, len(model[2]) - 1), *model)
            yield pa.RecordBatch.from_pydict({
                "rid": batch.column("rid"), "doc_id": batch.column("doc_id"),
                "held_out": pa.array(~batch.column("train").to_numpy(zero_copy_only=False)),
                **{c: batch.column(c) for c in ("n_words", "n_known", "own_log", "known_log",
                                                "class_log")},
                "log": pa.array(logs)})
    scored = coded.drop("rare").mapInArrow(run, SCORED)
    per_token = float(np.log10(of.tokens + ADD * (of.types + 1)))
    end = float(np.log10(of.ends + ADD))
    n_tokens = F.col("n_words") + 1
    rare_log = F.col("known_log") + F.coalesce("rare_log", F.lit(0.0))
    rest = vocab.where(F.col("n") <= of.known_above)
    return scored.join(rare_sums(coded, rest), "rid", "left").select(
        "doc_id", "held_out", n_tokens.alias("n_tokens"),
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0)) + int(of.ends > 0)).alias("n_known"),
        F.lit(of.tokens).cast("long").alias("train_tokens"),
        (F.col("own_log") + rare_log + end - n_tokens * per_token).alias("base_score"),
        (F.col("log") + rare_log - F.col("class_log")).alias("score"))
