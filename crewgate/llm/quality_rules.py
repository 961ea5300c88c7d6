"""Operator 3: quality rules.

Base rules on surface counts, then a logistic regression over hashed word
1-/2-grams and character 3-grams, trained on labelled quality rows, with its
probability calibrated on rows that the fit never saw (Platt scaling), and
scored in Arrow batches against fixed thresholds.

Fit.  A bounded sample of labelled rows (``max_rows``) is turned into hashed
feature vectors once.  Each round sends the current weights to all partitions
of that table; every task takes AdaGrad steps over its own rows and returns
one weight vector; the driver averages the vectors (iterative parameter
mixing, McDonald et al. 2010).  One row in five is kept out for calibration.

Edge cases.  Null and empty texts have no word and fail the base rules.  With
no labelled row, or labels of one class only, there is no regression and the
base rules decide alone.  Repeated rows are judged each by itself.  Columns
other than ``doc_id`` and ``text`` never influence a verdict, whatever their
names; ``filter_rows`` hands them through.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewgate.llm import arrays as A
from crewgate.llm import textstats
from crewgate.llm.common import drop_stored, slices, stored
from crewgate.llm.labelled import labelled_sample

BITS = 16                 # 65,536 hashed features, 256 KB of weights
MAX_ROWS = 8192           # bound of the labelled sample
TASKS, ROUNDS, EPOCHS = 6, 4, 2
RATE, RIDGE = 0.05, 1e-4
KEEP_FROM = 0.5           # fixed threshold on the calibrated probability
SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
          "n_repeat_words long, base_failed boolean, quality double, kept boolean")


def char_points(data, offsets):
    """(code points, document of each) of a slice."""
    points = np.frombuffer(bytes(data).decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    heads = A.per_doc(A.HEAD[data], offsets)
    return points, np.repeat(np.arange(len(heads)), heads)


def features(data, offsets, c):
    """Three families of (feature index, document), one entry per n-gram."""
    shift = np.uint64(64 - BITS)
    one = (A.mix64(c["hash"] ^ np.uint64(1)) >> shift).astype(np.int64)
    at, two = A.windows(c["hash"], c["doc"], 2)
    points, pdoc = char_points(data, offsets)
    cat, three = A.windows(points.astype(np.uint64), pdoc, 3)
    return [(one, c["doc"]),
            ((A.mix64(two ^ np.uint64(2)) >> shift).astype(np.int64), c["doc"][at]),
            ((A.mix64(three ^ np.uint64(3)) >> shift).astype(np.int64), pdoc[cat])]


SCALE = 8.0


def margins(families, n_docs, weights, bias):
    """Bias plus, for each family, SCALE times the mean weight of its n-grams."""
    z = np.full(n_docs, bias, dtype=np.float64)
    for index, doc in families:
        n = np.bincount(doc, minlength=n_docs)
        z += SCALE * np.bincount(doc, weights[index], minlength=n_docs) / np.maximum(n, 1)
    return z


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def vectorise(batches):
    """Labelled texts -> (label, fold, sparse vector as two byte strings)."""
    import pyarrow as pa

    for batch in batches:
        for part in slices(batch):
            data, offsets = A.text_bytes(part.column("text"))
            n_docs = len(offsets) - 1
            c = textstats.counts(data, offsets)
            keys, values = [], []
            for index, doc in features(data, offsets, c):
                n = np.bincount(doc, minlength=n_docs)
                key, count = np.unique((doc << BITS) | index, return_counts=True)
                keys.append(key)
                values.append(SCALE * count / np.maximum(n, 1)[key >> BITS])
            key, value = np.concatenate(keys), np.concatenate(values)
            order = np.argsort(key >> BITS, kind="stable")
            key, value = key[order], value[order].astype(np.float32)
            cut = np.searchsorted(key >> BITS, np.arange(n_docs + 1))
            index = (key & ((1 << BITS) - 1)).astype(np.uint32)
            yield pa.RecordBatch.from_pydict({
                "label": part.column("label").cast(pa.int32()),
                "fold": part.column("fold").cast(pa.int32()),
                "index": pa.array([index[a:b].tobytes() for a, b in zip(cut, cut[1:])],
                                  pa.binary()),
                "value": pa.array([value[a:b].tobytes() for a, b in zip(cut, cut[1:])],
                                  pa.binary())})


def rows_of(batches):
    for batch in batches:
        for y, f, i, v in zip(*(batch.column(k).to_pylist()
                                for k in ("label", "fold", "index", "value"))):
            yield y, f, np.frombuffer(i, np.uint32), np.frombuffer(v, np.float32)


def trainer(weights, bias, epochs):
    def run(batches):
        import pyarrow as pa

        rows = [(y, i, v) for y, f, i, v in rows_of(batches) if f]
        if not rows:
            return
        w, b = weights.astype(np.float64), float(bias)
        seen, seen_b = np.full(len(w), 1e-6), 1e-6
        rng = np.random.default_rng(7)
        for _ in range(epochs):
            for k in rng.permutation(len(rows)):
                y, i, v = rows[k]
                g = sigmoid(b + float(v @ w[i])) - (y > 0)
                d = g * v + RIDGE * w[i]       # the indices of one row are distinct per
                np.add.at(seen, i, d * d)      # family, not across families
                np.add.at(w, i, -RATE * d / np.sqrt(seen[i]))
                seen_b += g * g
                b -= RATE * g / seen_b ** 0.5
        yield pa.RecordBatch.from_pydict({
            "n": pa.array([len(rows)], pa.int64()), "bias": pa.array([b], pa.float64()),
            "weights": pa.array([w.astype(np.float32).tobytes()], pa.binary())})
    return run


def platt(z, y, steps: int = 50):
    """(a, b) of P = sigmoid(a z + b), with Platt's smoothed targets; damped Newton."""
    n1, n0 = int((y > 0).sum()), int((y <= 0).sum())
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = max(float(np.abs(z).mean()), 1e-9)
    x = np.stack([z / scale, np.ones_like(z)], axis=1)
    ab = np.array([0.0, np.log((n1 + 1) / (n0 + 1))])
    for _ in range(steps):
        p = sigmoid(x @ ab)
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, x.T @ (p - t) + 1e-3 * ab * [1.0, 0.0])
        ab = ab - step / max(1.0, float(np.abs(step).max()))
    return float(max(ab[0] / scale, 1e-6)), float(ab[1])


def fit(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> dict | None:
    """The model as a dict of small arrays, or None if there is nothing to learn."""
    rows = labelled_sample(documents, labels, max_rows).withColumn(
        "fold", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)).cast("int"))
    vectors, path = stored(rows.repartition(TASKS).mapInArrow(
        vectorise, "label int, fold int, index binary, value binary"), "rule-vectors")
    classes = {(r["label"] > 0, r["fold"] > 0): r["n"] for r in
               vectors.groupBy("label", "fold").agg(F.count("*").alias("n")).collect()}
    if not (classes.get((True, True)) and classes.get((False, True))):
        drop_stored(documents.sparkSession, path)
        return None
    weights, bias = np.zeros(1 << BITS, np.float32), 0.0
    for _ in range(ROUNDS):
        got = vectors.mapInArrow(trainer(weights, bias, EPOCHS),
                                 "n long, bias double, weights binary").collect()
        total = sum(r["n"] for r in got)
        weights = sum(np.frombuffer(r["weights"], np.float32) * (r["n"] / total) for r in got)
        bias = sum(r["bias"] * r["n"] for r in got) / total

    def held(batches, w=weights, b=bias):
        import pyarrow as pa

        out = [(y, b + float(v @ w[i])) for y, f, i, v in rows_of(batches) if not f]
        yield pa.RecordBatch.from_pydict({"y": pa.array([o[0] for o in out], pa.int32()),
                                          "z": pa.array([o[1] for o in out], pa.float64())})

    got = vectors.mapInArrow(held, "y int, z double").collect()   # at most max_rows pairs
    drop_stored(documents.sparkSession, path)
    a, c = platt(np.array([r["z"] for r in got]), np.array([r["y"] for r in got])) \
        if got else (1.0, 0.0)
    return {"weights": weights.astype(np.float32), "bias": bias, "a": a, "c": c}


def judge(column, model: dict | None) -> dict:
    """Counts, base verdict, calibrated probability and verdict for a slice of texts."""
    data, offsets = A.text_bytes(column)
    c = textstats.counts(data, offsets)
    failed = textstats.base_failed(c)
    if model is None:
        quality = np.full(len(failed), np.nan)
        kept = ~failed
    else:
        z = margins(features(data, offsets, c), len(failed), model["weights"], model["bias"])
        quality = sigmoid(model["a"] * z + model["c"])
        kept = ~failed & (quality >= KEEP_FROM)
    return c | {"base_failed": failed, "quality": quality, "kept": kept}


def score(documents: DataFrame, model: dict | None) -> DataFrame:
    """One verdict row per row of ``documents`` (``SCHEMA``)."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch):
                got = judge(part.column("text"), model)
                quality = pa.array(got["quality"], mask=np.isnan(got["quality"]))
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": part.column("doc_id").cast(pa.int64())}
                    | {k: pa.array(got[k].astype(np.int64)) for k in (
                        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
                    | {"base_failed": pa.array(got["base_failed"]), "quality": quality,
                       "kept": pa.array(got["kept"])})
    return documents.select("doc_id", "text").mapInArrow(run, SCHEMA)


def filter_rows(documents: DataFrame, model: dict | None) -> DataFrame:
    """The rows of ``documents`` that are kept, all columns unchanged."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(judge(part.column("text"), model)["kept"]))
    return documents.mapInArrow(run, documents.schema)
