"""Operator 2: exact token-length histogram with suffix sums.

``histogram`` counts the documents of every encoded length.  ``suffix_sums``
adds, for every length L that occurs, how many documents and tokens lie at or
above L; these answer the total, any quantile and the total after truncation
at any context limit without reading the documents again.

Scale.  Encoding is a map; the count combines on the map side, so a length
that a third of all documents share is one row per task.  The suffix sums run
inside blocks of 1024 lengths, and across blocks over one row per block, so
no task gets all lengths.

Edge cases.  Null and empty texts have length 0.  An empty table has an empty
histogram.  Repeated rows count each; ids and other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crewgate.llm import tokens

BLOCK = 1024


def lengths(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """(length) of every text in tokens of a rank file, control strings as text."""
    def run(batches):
        import pyarrow as pa

        enc = tokens.encoder(tokens.rank_file(path), pattern)
        for batch in batches:
            n = [len(tokens.encode(enc, t.as_py() or "")) for t in batch.column("text")]
            yield pa.RecordBatch.from_pydict({"length": pa.array(n, pa.int64())})
    return documents.select("text").mapInArrow(run, "length long")


def histogram(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    return lengths(documents, path, pattern).groupBy("length").agg(
        F.count(F.lit(1)).alias("documents"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """Per length: ``documents``, ``documents_at_least``, ``tokens_at_least``,
    ``truncated_tokens`` (all tokens if every document were cut to that length),
    ``share_at_most`` (share of documents not longer) and the two totals."""
    block = F.floor(F.col("length") / BLOCK)
    rows = hist.withColumn("block", block).withColumn(
        "tokens", F.col("length") * F.col("documents"))
    whole = rows.groupBy("block").agg(F.sum("documents").alias("d"), F.sum("tokens").alias("t"))
    after = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    whole = whole.select(
        "block", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("t").over(after), F.lit(0)).alias("tokens_after"),
        F.sum("d").over(every).alias("total_documents"),
        F.sum("t").over(every).alias("total_tokens"))
    inside = Window.partitionBy("block").orderBy(F.col("length").desc()).rowsBetween(
        Window.unboundedPreceding, 0)
    out = rows.withColumn("d_in", F.sum("documents").over(inside)) \
              .withColumn("t_in", F.sum("tokens").over(inside)).join(whole, "block")
    docs, toks = F.col("d_in") + F.col("docs_after"), F.col("t_in") + F.col("tokens_after")
    return out.select(
        "length", "documents", docs.alias("documents_at_least"), toks.alias("tokens_at_least"),
        truncated(F.col("total_tokens"), toks, docs, F.col("length")).alias("truncated_tokens"),
        ((F.col("total_documents") - docs + F.col("documents"))
         / F.col("total_documents")).alias("share_at_most"),
        "total_documents", "total_tokens")


def truncated(total: Column, tokens_above: Column, docs_above: Column, limit) -> Column:
    """Tokens left when documents are cut to ``limit``: the part above it goes."""
    return total - (tokens_above - docs_above * limit)


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(limit, documents_longer, truncated_tokens) for given context limits, in one
    aggregate: the shortest length above a limit carries its suffix sums."""
    above = F.struct("length", "documents_at_least", "tokens_at_least")
    found = sums.agg(F.max("total_tokens").alias("total"), *[
        F.min(F.when(F.col("length") > x, above)).alias(f"s{k}") for k, x in enumerate(limits)])
    cells = []
    for k, x in enumerate(limits):
        docs = F.coalesce(F.col(f"s{k}.documents_at_least"), F.lit(0))
        toks = F.coalesce(F.col(f"s{k}.tokens_at_least"), F.lit(0))
        cells.append(F.struct(
            F.lit(int(x)).cast("long").alias("limit"), docs.alias("documents_longer"),
            truncated(F.coalesce("total", F.lit(0)), toks, docs, F.lit(int(x)))
            .alias("truncated_tokens")))
    return found.select(F.inline(F.array(*cells)))


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """One row: the smallest length that at least a share ``q`` of documents do not exceed."""
    return sums.where(F.col("share_at_most") >= q).agg(F.min("length").alias("length"))
