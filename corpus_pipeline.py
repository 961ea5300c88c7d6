"""Corpus pipeline: quality rules, quality classifier, near-dedup, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame that is written as Parquet and reread as the next
one's ``docs``.  The first three return the columns of ``docs``; the last one
returns the pieces of packed sequences (operator 1).

Every stage works on all rows it is given.  The two models are fitted on the
labelled rows of ``sf_dir`` (bounded samples, see the operators), whichever of
them earlier stages removed, since a label says as much about a removed text.
Null and empty texts go at the first stage; an empty input gives an empty
result; extra columns of ``docs`` are handed through up to packing.
"""

from __future__ import annotations

import public_tokenizers

from crewgate.llm import gam, near_dedup, packing, quality_rules
from crewgate.llm.common import table
from crewgate.session import scratch_path


def quality_rules_stage(spark, docs, sf_dir):
    """Operator 3: documents that it rejects go."""
    model = quality_rules.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_rules.filter_rows(docs, model)


def quality_classifier_stage(spark, docs, sf_dir):
    """Operator 10: documents that it rejects go."""
    model = gam.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return gam.filter_rows(docs, model)


def near_dedup_stage(spark, docs, sf_dir):
    """Operator 9: one document of each group stays."""
    return near_dedup.keep_one(docs)


def packing_stage(spark, docs, sf_dir):
    """Operator 1: the pieces of what is left, packed into sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"),
                        public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_rules_stage),
    ("quality classifier", quality_classifier_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("best-fit packing", packing_stage),
]

# The stages train models and tokenise: SQL cannot express them.  They are
# tested against brute force in tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages on ``documents``; each but the last is written and reread."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = scratch_path(spark, f"pipeline-{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
