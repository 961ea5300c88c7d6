"""Labelled rows joined with their texts: a bounded, documented sample.

The sample is the ``max_rows`` labelled documents with the smallest
``xxhash64(doc_id)``: the same rows on every run, whatever the partitioning.
Rows without a label or without an id are no candidates; a document with
several labels counts as low quality if any says so, and a doc id that occurs
in several rows is taken once (smallest text; null counts as empty).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(documents: DataFrame, labels: DataFrame, max_rows: int,
                    where: Column | None = None) -> DataFrame:
    """(doc_id, label, text) of at most ``max_rows`` labelled documents.

    ``where`` restricts the labels (a condition on ``doc_id``).
    """
    marks = labels.select("doc_id", F.col("quality").alias("label")).where(
        F.col("doc_id").isNotNull() & F.col("label").isNotNull())
    if where is not None:
        marks = marks.where(where)
    marks = marks.join(documents.select("doc_id"), "doc_id", "left_semi")
    marks = (marks.groupBy("doc_id").agg(F.min("label").alias("label"))
                  .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    # at most max_rows (id, label) pairs: the bound that makes the broadcast safe
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return (texts.join(F.broadcast(marks), "doc_id")
                 .groupBy("doc_id").agg(F.first("label").alias("label"),
                                        F.min("text").alias("text")))
