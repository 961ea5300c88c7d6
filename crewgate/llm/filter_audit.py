"""Operator 11: filter interaction audit over stored id tables.

Every filter has an id table: the ids and parts of the rows that fail it.  What a
prefix of filters does depends on the set of filters in it alone, so the survivors
of all 2^n sets (``survivors``: row id, part, set as a bit mask) stand for all n!
orders.  They are built filter by filter: each relation so far is taken twice,
without and with the filter, and the second copy loses its failing rows to a
left-anti join with the id table.  Every id table, dealt to the sets that lack its
filter, then meets the survivors twice: the left-semi join gives what the filter
removes after that set, the left-anti join what it finds removed already.
Removals that carry a label are a left-semi join with the label's id table.
Orders and steps only look up the counts of their sets.

Rows are narrow (an id, a part, a mask), and all joins but the one for equal texts
are on a row id, of which no value is frequent.  Equal texts meet by digest: the
texts held by more than a thousandth of all rows are under 1,000 and are broadcast,
so a text that a third of the rows hold is compared where the rows are.  Nothing else
is broadcast (``unbroadcast``), so the driver's memory does not grow with the rows.

Edge cases.  A null text is empty, a null source the part ''.  A null doc id is
smaller than none and has none smaller: its row never fails for an equal text and
makes none fail; it has no label.  Rows that share a doc id count each; equal rows
of one id do not fail each other.  A doc id that ``labels`` marks in any row has the
mark.  An empty table gives no row.  Other columns are never read.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce
from itertools import permutations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crewgate.llm import arrays as A
from crewgate.llm.common import drop_stored, slices, stored, unbroadcast

# Fixed values of the contract's filters: A words, B distinct share, C capitals, D signs.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, SIGNS = 50, 65, 5, b"#$%&*|"
TEXT_FILTERS, EQUAL_TEXT = "ABCD", "E"
FACTS = "doc_id long, part string, digest binary, failed int"
HOT_SHARE = 1000        # a text held by more than 1 / HOT_SHARE of the rows is hot


def failures(batch):
    """(bit mask of the failed filters A to D, digest) per text of a slice."""
    data, offsets = A.text_bytes(batch.column("text"))
    points = A.per_doc(A.HEAD[data], offsets)
    capitals = A.per_doc((data >= 65) & (data <= 90), offsets)
    signs = A.per_doc(A.byte_class(SIGNS)[data], offsets)
    raw, cut = data.tobytes(), offsets.tolist()
    texts = [raw[a:b] for a, b in zip(cut, cut[1:])]
    words = [t.split() for t in texts]          # bytes: ASCII white space only
    n = np.fromiter(map(len, words), np.int64, len(words))
    distinct = np.fromiter((len(set(w)) for w in words), np.int64, len(words))
    failed = (n < MIN_WORDS) + 2 * (100 * distinct < MIN_DISTINCT * n) \
        + 4 * (100 * capitals > MAX_CAPITALS * points) + 8 * (signs > 0)
    return failed, [hashlib.sha256(t).digest()[:16] for t in texts]


def facts(documents: DataFrame) -> DataFrame:
    """(doc_id, part, digest, failed) per document, in one pass over its text."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for rows in slices(batch):
                failed, digests = failures(rows)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": rows.column("doc_id"), "part": rows.column("part"),
                    "digest": pa.array(digests, pa.binary()),
                    "failed": pa.array(failed, pa.int32())})
    return documents.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), "text") \
        .mapInArrow(run, FACTS)


def later_copies(rows: DataFrame) -> DataFrame:
    """Rows of ``rows`` whose text has a smaller doc id somewhere in the table."""
    total = rows.count()
    groups, path = stored(rows.groupBy("digest").agg(
        F.min("doc_id").alias("first"), F.max("doc_id").alias("last"),
        F.count(F.lit(1)).alias("n")).where("first < last").drop("last"), "audit-equal-texts")
    hot = F.broadcast(groups.where(F.col("n") * HOT_SHARE > total))     # under HOT_SHARE rows
    cold = groups.where(F.col("n") * HOT_SHARE <= total)
    found = rows.join(hot, "digest").unionByName(
        rows.join(hot.select("digest"), "digest", "left_anti").join(
            unbroadcast(cold), "digest"))
    return found.where("doc_id > first").select("rid", "part"), path


def bits(letters: str) -> dict[str, int]:
    return {f: 1 << k for k, f in enumerate(letters)}


def survivors(rows: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """(rid, part, mask): the rows that pass all filters of every set ``mask``."""
    out = rows.select("rid", "part", F.lit(0).alias("mask"))
    for f, bit in bits("".join(tables)).items():
        twice = out.select("rid", "part", "mask", F.explode(F.array(F.lit(0), F.lit(bit))).alias(
            "bit"))
        failing = tables[f].select(F.col("rid").alias("failing"))
        on = (F.col("rid") == F.col("failing")) & (F.col("bit") != 0)
        out = twice.join(unbroadcast(failing), on, "left_anti").select(
            "rid", "part", F.col("mask").bitwiseOR(F.col("bit")).alias("mask"))
    return out


def before_sets(tables: dict[str, DataFrame]) -> DataFrame:
    """(rid, part, filter, mask): every failing row with all sets that lack its filter."""
    bit = bits("".join(tables))
    every = range(1 << len(bit))
    return reduce(DataFrame.unionByName, [
        t.select("rid", "part", F.lit(f).alias("filter"), F.explode(F.array(*[
            F.lit(m) for m in every if not m & bit[f]])).alias("mask"))
        for f, t in tables.items()])


def interactions(rows: DataFrame, tables: dict[str, DataFrame], marks: dict[str, DataFrame]):
    """Counts per part, order and step, and the scratch folders they are read from.

    ``rows``: rid, part; ``tables``: filter letter -> its failing rows (rid, part);
    ``marks``: name -> labelled rows (rid), counted as ``<name>_lost``.  All are
    stored tables.  Columns: part, filter_order, step, kept, removed, redundant,
    unique_fails, ``<name>_lost``, shapley.
    """
    letters = "".join(tables)
    bit, full = bits(letters), (1 << len(letters)) - 1
    alive, alive_path = stored(survivors(rows, tables), "audit-survivors")
    failing = before_sets(tables)
    alive_keys = unbroadcast(alive.select("rid", "mask"))
    removed, removed_path = stored(failing.join(alive_keys, ["rid", "mask"], "left_semi"),
                                   "audit-removed")
    redundant = failing.join(alive_keys, ["rid", "mask"], "left_anti")

    def counted(df, name):
        return df.groupBy("part", "mask", "filter").agg(F.count(F.lit(1)).alias("n")) \
            .withColumn("name", F.lit(name))

    lost = [f"{m}_lost" for m in marks]
    counts = reduce(DataFrame.unionByName, [
        counted(alive.withColumn("filter", F.lit("")), "kept"), counted(removed, "removed"),
        counted(redundant, "redundant"),
        *[counted(removed.join(unbroadcast(t), "rid", "left_semi"), f"{m}_lost")
          for m, t in marks.items()]])
    counts, counts_path = stored(counts, "audit-counts")

    def pick(*names):
        return [F.coalesce(F.sum(F.when(F.col("name") == n, F.col("n"))), F.lit(0)).alias(n)
                for n in names]

    size = len(letters)
    weight = F.element_at(F.array(*[
        F.lit(math.factorial(k) * math.factorial(size - 1 - k)) for k in range(size)]),
        F.bit_count("mask") + 1)        # orders in which just this set comes before the filter
    at_step = counts.where("filter != ''").groupBy(
        "part", F.col("filter").alias("letter"), F.col("mask").alias("before")).agg(
        *pick("removed", "redundant", *lost))
    after_step = counts.where("name = 'kept'").select("part", F.col("mask").alias("after"),
                                                      F.col("n").alias("kept"))
    alone = F.element_at(F.create_map(*[x for f in letters for x in (
        F.lit(f), F.lit(full - bit[f]))]), F.col("filter"))
    overall = counts.where("name = 'removed'").groupBy("part", F.col("filter").alias("letter")).agg(
        F.sum(F.when(F.col("mask") == alone, F.col("n"))).alias("unique_fails"),
        F.sum(F.col("n") * weight).alias("shapley"))

    def value(letter: Column) -> Column:
        return F.element_at(F.create_map(*[x for f in letters for x in (
            F.lit(f), F.lit(bit[f]))]), letter)

    orders = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    steps = rows.select("part").distinct() \
        .select("part", F.explode(orders).alias("filter_order")) \
        .select("part", "filter_order", F.posexplode(F.split("filter_order", "")).alias(
            "k", "letter")).where("letter != ''") \
        .withColumn("prefix", F.split(F.substring("filter_order", F.lit(1), F.col("k")), "")) \
        .withColumn("before", F.aggregate(
            F.filter("prefix", lambda c: c != ""), F.lit(0), lambda a, c: a + value(c))) \
        .withColumn("after", F.col("before") + value(F.col("letter")))
    out = steps.join(unbroadcast(at_step), ["part", "letter", "before"], "left") \
        .join(unbroadcast(after_step), ["part", "after"], "left") \
        .join(unbroadcast(overall), ["part", "letter"], "left")
    names = ["kept", "removed", "redundant", "unique_fails", *lost, "shapley"]
    result = out.select("part", "filter_order", (F.col("k") + 1).cast("int").alias("step"), *[
        F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names])
    return result, [alive_path, removed_path, counts_path]


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters over ``documents`` (doc_id, source, text) with the losses among
    ``labels`` (doc_id, quality, toxic): columns of ``interactions``."""
    spark = documents.sparkSession
    numbered = facts(documents).withColumn("rid", F.monotonically_increasing_id())
    rows, rows_path = stored(numbered, "audit-rows")
    tables, paths = {}, [rows_path]
    for k, f in enumerate(TEXT_FILTERS):
        failing = rows.where(F.col("failed").bitwiseAND(F.lit(1 << k)) != 0)
        tables[f], path = stored(failing.select("rid", "part"), f"audit-fails-{f}")
        paths.append(path)
    copies, path = later_copies(rows.select("rid", "part", "doc_id", "digest"))
    paths.append(path)
    tables[EQUAL_TEXT], path = stored(copies, "audit-fails-E")
    paths.append(path)
    marks = {}
    for name, column in (("good", "quality"), ("toxic", "toxic")):
        ids = unbroadcast(labels.where(F.col(column) == 1).select("doc_id"))
        marks[name], path = stored(
            rows.select("doc_id", "rid").join(ids, "doc_id", "left_semi").select("rid"),
            f"audit-{name}")
        paths.append(path)
    result, more = interactions(rows.select("rid", "part"), tables, marks)
    out, _ = stored(result, "audit")
    drop_stored(spark, *paths, *more)
    return out
