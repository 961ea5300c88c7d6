"""Operator 10: quality classifier, a generalised additive model with pairwise
interactions (GA2M; Lou, Caruana, Gehrke, Hooker, KDD 2013).

Every feature is cut into quantile bins.  Cyclic gradient boosting visits the
features in turn and adds a shallow tree over the bins of one feature, with a
small learning rate, to that feature's lookup table; then the strongest
feature pairs get two-dimensional tables the same way.  A document's score is
the sigmoid of a sum of table entries: one vectorised lookup per table.

The tables are fitted on a bounded sample of labelled rows (``MAX_ROWS``),
reduced on the executors to one small feature vector each before it reaches
the driver.  Inputs of a score are counts of the text alone.

Edge cases.  Null and empty texts have all-zero features and a score like any
other.  Without labels, or with one class only, the score is the smoothed
share of label 1 (0.5 with no label).  Repeated rows are scored each; other
columns, whatever their names, are never read (``filter_rows`` hands them on).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewgate.llm import arrays as A
from crewgate.llm import textstats
from crewgate.llm.common import crc32_of_id, slices
from crewgate.llm.labelled import labelled_sample

MAX_ROWS = 20000
BINS, PAIR_BINS, ROUNDS, PAIRS, PAIR_ROUNDS, RATE = 32, 8, 60, 6, 30, 0.15
THRESHOLD = 0.7           # fixed by the contract
N_FEATURES = 16
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def features(column):
    """(documents x N_FEATURES) surface features of a slice of texts."""
    data, offsets = A.text_bytes(column)
    n_docs = len(offsets) - 1
    c = textstats.counts(data, offsets)
    n, doc, h = c["n_words"], c["doc"], c["hash"]
    share = lambda a, b: a / np.maximum(b, 1)
    chars = A.per_doc(A.HEAD[data], offsets)
    of = lambda chars_: A.per_doc(A.byte_class(chars_)[data], offsets)
    upper = A.byte_class(bytes(range(65, 91)))[data]
    if len(data) > 1:       # capitals of the Latin-1 block: C3 80 .. C3 9E
        upper[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    heads = np.concatenate([[0], np.cumsum(A.HEAD[data], dtype=np.int64)])
    lengths = heads[c["end"]] - heads[c["start"]]
    same = np.zeros(len(doc), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    _, later = A.repeated(doc, h)
    per = lambda mask: np.bincount(doc[mask], minlength=n_docs)
    return np.stack([
        np.log1p(n), share(c["word_chars"], n), share(c["n_symbols"], n),
        share(A.per_doc(upper, offsets), chars), share(of(b"!"), n), share(of(b"|"), n),
        share(of(b"0123456789"), chars), share(c["n_dup_lines"], c["n_lines"]),
        share(c["n_repeat_words"], n), share(per(same), n), share(per(later), n),
        share(n, c["n_lines"]), share(of(b".,;:?"), n), share(chars, np.diff(offsets)),
        share(per(lengths <= 2), n), share(per(lengths >= 12), n)], axis=1)


def shallow_tree(g, h, leaves: int = 4, ridge: float = 1.0):
    """Step values over ordered bins of a greedy tree with at most ``leaves`` leaves."""
    parts = [(0, len(g))]
    value = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + ridge)
    while len(parts) < leaves:
        best = None
        for k, (a, b) in enumerate(parts):
            if b - a < 2:
                continue
            gl, hl = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            gr, hr = g[a:b].sum() - gl, h[a:b].sum() - hl
            gain = gl ** 2 / (hl + ridge) + gr ** 2 / (hr + ridge) - value(a, b)
            s = int(np.argmax(gain))
            if gain[s] > 1e-9 and (best is None or gain[s] > best[0]):
                best = (gain[s], k, a + s + 1)
        if best is None:
            break
        _, k, s = best
        a, b = parts[k]
        parts[k:k + 1] = [(a, s), (s, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def pair_tree(g, h, ridge: float = 1.0):
    """(gain, step values) over a 2-D bin grid: one cut of the first feature, then
    one cut of the second on either side."""
    best, out = 0.0, np.zeros(g.shape)
    for s in range(1, len(g)):
        gain, sides = 0.0, []
        for rows in (slice(0, s), slice(s, len(g))):
            gs, hs = g[rows].sum(axis=0), h[rows].sum(axis=0)
            step = shallow_tree(gs, hs, 2, ridge)
            gain += float((step * gs).sum())
            sides.append((rows, step))
        gain -= g.sum() ** 2 / (h.sum() + ridge)
        if gain > best:
            best, out = gain, np.zeros(g.shape)
            for rows, step in sides:
                out[rows] = step
    return best, out


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def cut_points(column, bins):
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))


def fit_tables(x, y) -> dict:
    """Boost the lookup tables on a feature matrix and 0/1 labels."""
    share = (y.sum() + 0.5) / (len(y) + 1.0) if len(y) else 0.5
    bias = float(np.log(share / (1 - share)))
    model = {"bias": bias, "edges": [], "tables": [], "coarse": [], "pairs": []}
    if not len(y) or y.min() == y.max():
        return model
    n, d = x.shape
    model["edges"] = [cut_points(x[:, j], BINS) for j in range(d)]
    bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model["edges"])]
    model["tables"] = [np.zeros(len(e) + 1) for e in model["edges"]]
    f = np.full(n, bias)
    for _ in range(ROUNDS):
        for j in range(d):
            p = sigmoid(f)
            k = len(model["tables"][j])
            step = RATE * shallow_tree(np.bincount(bins[j], y - p, k),
                                       np.bincount(bins[j], p * (1 - p), k))
            model["tables"][j] += step
            f += step[bins[j]]
    model["coarse"] = [cut_points(x[:, j], PAIR_BINS) for j in range(d)]
    coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model["coarse"])]

    def grid(i, j, p):
        shape = (len(model["coarse"][i]) + 1, len(model["coarse"][j]) + 1)
        key = coarse[i] * shape[1] + coarse[j]
        size = shape[0] * shape[1]
        return key, np.bincount(key, y - p, size).reshape(shape), \
            np.bincount(key, p * (1 - p), size).reshape(shape)

    p = sigmoid(f)
    gains = sorted(((pair_tree(*grid(i, j, p)[1:])[0], i, j)
                    for i in range(d) for j in range(i + 1, d)), reverse=True)[:PAIRS]
    model["pairs"] = [[i, j, np.zeros(grid(i, j, p)[1].shape)] for _, i, j in gains]
    for _ in range(PAIR_ROUNDS):
        for pair in model["pairs"]:
            key, g, h = grid(pair[0], pair[1], sigmoid(f))
            step = RATE * pair_tree(g, h)[1]
            pair[2] += step
            f += step.ravel()[key]
    return model


def predict(x, model: dict):
    z = np.full(len(x), model["bias"])
    for j, (edges, entries) in enumerate(zip(model["edges"], model["tables"])):
        z += entries[np.searchsorted(edges, x[:, j], side="right")]
    coarse = {}
    for i, j, entries in model["pairs"]:
        for k in (i, j):
            if k not in coarse:
                coarse[k] = np.searchsorted(model["coarse"][k], x[:, k], side="right")
        z += entries[coarse[i], coarse[j]]
    return sigmoid(z)


def vectorise(batches):
    import pyarrow as pa

    for batch in batches:
        for part in slices(batch):
            x = features(part.column("text"))
            yield pa.RecordBatch.from_pydict({
                "label": part.column("label").cast(pa.int32()),
                "x": pa.array([r.tobytes() for r in x], pa.binary())})


def fit(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> dict:
    """Fit on at most ``max_rows`` labelled rows that are not held out."""
    rows = labelled_sample(documents, labels, max_rows, crc32_of_id() % 4 != 2)
    got = rows.select("label", "text").mapInArrow(vectorise, "label int, x binary").collect()
    got.sort(key=lambda r: (r["x"], r["label"]))        # max_rows small vectors
    x = np.array([np.frombuffer(r["x"]) for r in got]).reshape(len(got), N_FEATURES)
    return fit_tables(x, np.array([r["label"] > 0 for r in got], dtype=np.float64))


def score(documents: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score, predicted, held_out) per row of ``documents``.

    A null doc id counts as not held out.
    """
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch):
                s = predict(features(part.column("text")), model)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id").cast(pa.int64()),
                    "held_out": part.column("held_out"), "score": pa.array(s),
                    "predicted": pa.array((s >= THRESHOLD).astype(np.int32))})
    held = F.coalesce(crc32_of_id() % 4 == 2, F.lit(False))
    return documents.select("doc_id", held.alias("held_out"), "text").mapInArrow(run, SCHEMA)


def filter_rows(documents: DataFrame, model: dict) -> DataFrame:
    """The rows of ``documents`` predicted to be good, all columns unchanged."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch):
                s = predict(features(part.column("text")), model)
                yield part.filter(pa.array(s >= THRESHOLD))
    return documents.mapInArrow(run, documents.schema)
