import random

import pytest
from pyspark.sql import types as T

# extra columns whose names the operators use inside
EXTRA = ("lang", "n_words", "kept", "score", "label", "fold", "rid", "band", "hub", "class_id",
         "digest", "row", "part", "key", "bytes", "at", "seq", "kind", "block", "flag", "d", "i",
         "h", "length", "documents", "held_out")
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]
                      + [T.StructField(c, T.StringType()) for c in EXTRA])


def words(rng, n, vocabulary=400):
    return [f"w{rng.randint(0, vocabulary)}é" if rng.random() < .1 else
            f"word{rng.randint(0, vocabulary)}" for _ in range(n)]


def messy_rows():
    """(doc_id, text): null and empty texts, null ids, repeated rows, ties, long texts,
    control strings, copies and near copies."""
    rng = random.Random(3)
    base = words(rng, 300)
    near = [" ".join(base[:k] + ["changed"] + base[k + 1:]) for k in (5, 50, 140, 299)]
    rows = [(1, None), (2, ""), (3, " \t\n\v\f\r "), (4, "one"), (5, "one two three"),
            (None, "a text without an id, said twice"), (None, "a text without an id, said twice"),
            (7, " ".join(base)), (8, " ".join(base)), (9, near[0]), (10, near[1]), (11, near[2]),
            (12, near[3]), (13, " ".join(words(rng, 30000, 5000))), (13, "the same id again"),
            (14, "<|endoftext|> <|im_end|>\nx<|im_start|>assistant ~0 ~1 <~1"),
            (15, "x" * 30000), (16, "line a b\nline a b\n\nline a b\n" * 3),
            (17, "be " * 200), (17, "be " * 200), (17, "be " * 200),
            (18, "日本語のテキスト 🙂🙂 été\x85nbsp end x\x1cy")]
    rows += [(100 + k, " ".join(words(rng, rng.randint(1, 400)))) for k in range(40)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, *(f"{c}!" for c in EXTRA)) for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def rows():
    return messy_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return frame(spark, rows).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, [])


SF = "/root/testdata/sf0.001"
