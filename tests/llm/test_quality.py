import zlib

import pytest
from pyspark.sql import functions as F

from crewgate.llm import gam, quality_rules
from crewgate.llm.common import table
from tests.llm.conftest import SF, frame
from tests.llm.test_arrays import brute

SF_LABELLED = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def tables(spark):
    return table(spark, SF_LABELLED, "documents"), table(spark, SF_LABELLED, "labels")


def test_rule_rows_equal_brute_force(docs, rows, nothing):
    got = quality_rules.score(docs, None).collect()
    want = sorted(((i is not None, i or 0), *brute(t)) for i, t in rows)
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.n_words, r.word_chars, r.n_symbols,
                   r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (not r.base_failed) and r.quality is None
    assert quality_rules.score(nothing, None).count() == 0


def test_regression_on_labelled_rows(spark, tables):
    documents, labels = tables
    model = quality_rules.fit(documents, labels)
    got = quality_rules.score(documents, model).join(
        labels.select("doc_id", F.col("quality").alias("label")), "doc_id").collect()
    sure = [r for r in got if not r.base_failed]
    assert all(0 <= r.quality <= 1 for r in got)
    assert sum(r.kept == (r.label == 1) for r in sure) >= 0.97 * len(sure)
    assert all(r.kept for r in sure if r.label == 1)
    kept = quality_rules.filter_rows(documents, model)
    assert kept.schema == documents.schema
    assert {r.doc_id for r in kept.collect()} == {
        r.doc_id for r in quality_rules.score(documents, model).where("kept").collect()}


def test_calibration_is_close_on_rows_of_the_fit(spark, tables):
    documents, labels = tables
    model = quality_rules.fit(documents, labels)
    got = quality_rules.score(documents, model).join(
        labels.select("doc_id", F.col("quality").alias("label")), "doc_id").collect()
    mean = sum(r.quality for r in got) / len(got)
    share = sum(r.label for r in got) / len(got)
    assert abs(mean - share) < 0.05


def odd_labels(spark):
    return spark.createDataFrame([(7, None, 0), (None, 1, 0), (13, 1, 0), (13, 0, 1), (13, 1, 0),
                                  (999, 1, 0)], LABELS)


def test_odd_labels(spark, docs, rows, nothing):
    none = spark.createDataFrame([], LABELS)
    for labels in (none, odd_labels(spark)):
        assert quality_rules.fit(docs, labels) is None       # nothing or one class
    assert quality_rules.fit(nothing, none) is None
    assert gam.fit(docs, none)["bias"] == 0.0
    assert gam.fit(docs, odd_labels(spark))["bias"] < 0
    assert {r.score for r in gam.score(docs, gam.fit(docs, none)).collect()} == {0.5}


def test_classifier_on_held_out_rows(spark, tables):
    documents, labels = tables
    got = gam.score(documents, gam.fit(documents, labels)).join(
        labels.select("doc_id", F.col("quality").alias("label")), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert {zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in held} == {True}
    assert not any(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in got if not r.held_out)
    assert sum(r.predicted == r.label for r in held) >= 0.97 * len(held)
    assert all((r.score >= 0.7) == (r.predicted == 1) for r in got)


def test_scores_use_the_text_alone(spark, docs, tables):
    model = gam.fit(*tables)
    got = {(r.doc_id, round(r.score, 12)) for r in gam.score(docs, model).collect()}
    other = docs.select("doc_id", "text", F.lit("zz").alias("lang"), F.lit(1).alias("label"))
    assert got == {(r.doc_id, round(r.score, 12)) for r in gam.score(other, model).collect()}
    twice = frame(spark, [(1, "same text of some words"), (2, "same text of some words")])
    assert len({r.score for r in gam.score(twice, model).collect()}) == 1


def test_filters_on_messy_rows(docs, nothing, tables):
    model = gam.fit(*tables)
    kept = gam.filter_rows(docs, model)
    assert kept.schema == docs.schema
    want = [r.doc_id for r in gam.score(docs, model).where("predicted = 1").collect()]
    assert sorted(map(str, want)) == sorted(str(r.doc_id) for r in kept.collect())
    for empty in (gam.score(nothing, model), gam.filter_rows(nothing, model),
                  quality_rules.filter_rows(nothing, None)):
        assert empty.count() == 0


def test_tables_are_shallow_trees():
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.random((800, gam.N_FEATURES))
    y = ((x[:, 0] > .5) ^ (x[:, 1] > .5)).astype(float)        # needs a pair
    model = gam.fit_tables(x, y)
    p = gam.predict(x, model)
    assert ((p > .5) == (y > 0)).mean() > 0.9
    assert {0, 1} in [{i, j} for i, j, _ in model["pairs"]]
