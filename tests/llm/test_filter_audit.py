import re
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
from pyspark.sql import functions as F

from crewgate.llm import filter_audit as A
from crewgate.llm.common import stored, table
from crewgate.llm.oracle import ORACLE_SQL
from crewgate.llm.queries import QUERIES
from tests.llm.conftest import SF, frame

MORE = [(40, "A B C D"), (41, "word " * 60), (42, "word " * 60), (43, "Word#1 " * 70),
        (41, "word " * 60), (44, None), (45, "#"), (None, "word " * 60)]
NAME = "op11_filter_interaction_audit"


def with_source(df):
    """A few sources, one row in eight without."""
    return df.withColumn("source", F.when(F.length("text") % 8 == 3, F.lit(None)).otherwise(
        F.concat(F.lit("s"), (F.coalesce(F.col("doc_id"), F.lit(0)) % 3).cast("string"))))


def brute(rows, labels):
    """The audit by applying every order to the list of rows."""
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t] = min(i, first.get(t, i))
    fails = []
    for i, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails.append({f for f, bad in zip("ABCDE", (
            len(w) < 50, 100 * len(set(w)) < 65 * len(w),
            100 * len(re.findall("[A-Z]", t)) > 5 * len(t), re.search(r"[#$%&*|]", t),
            i is not None and i > first[t])) if bad})
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, x in labels if x == 1}
    out, shapley = {}, Counter()
    for order in map("".join, permutations("ABCDE")):
        left = list(range(len(rows)))
        for step, f in enumerate(order, 1):
            cell = defaultdict(Counter)
            for k, (i, _, part) in enumerate(rows):
                cell[part]["unique"] += fails[k] == {f}
                cell[part]["redundant"] += f in fails[k] and k not in set(left)
            for k in left:
                i, _, part = rows[k]
                name = "removed" if f in fails[k] else "kept"
                cell[part][name] += 1
                if name == "removed":
                    cell[part]["good"] += i in good
                    cell[part]["toxic"] += i in toxic
                    shapley[part, f] += 1
            left = [k for k in left if f not in fails[k]]
            for part, c in cell.items():
                out[part, order, step] = [c[n] for n in (
                    "kept", "removed", "redundant", "unique", "good", "toxic")]
    return {(p, o, s): (*v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


def test_equal_to_every_order_applied(spark, rows):
    docs = with_source(frame(spark, rows[:30] + MORE)).repartition(3).cache()
    labels = spark.createDataFrame(
        [(40, 1, 0), (41, 1, 1), (42, None, 1), (43, 0, 1), (45, 1, None), (None, 1, 1), (41, 0, 0),
         (7, 1, 0), (8, 1, 1), (999, 1, 1)], "doc_id long, quality int, toxic int")
    got = A.audit(docs, labels).collect()
    plain = [(r.doc_id, r.text or "", r.source or "") for r in docs.collect()]
    want = brute(plain, [tuple(r) for r in labels.collect() if r.doc_id is not None])
    assert {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails,
            r.good_lost, r.toxic_lost, r.shapley) for r in got} == want
    assert len(got) == len(want)


def test_hot_and_cold_copies_are_found_alike(spark, monkeypatch):
    rows = [(i, f"text {i % 7 if i % 3 else 'hot'}") for i in range(300)]
    counts = []
    for share in (2, 1000):
        monkeypatch.setattr(A, "HOT_SHARE", share)
        facts = A.facts(with_source(frame(spark, rows))).withColumn(
            "rid", F.monotonically_increasing_id()).cache()
        found, _ = A.later_copies(facts.select("rid", "part", "doc_id", "digest"))
        counts.append(sorted(r.rid for r in found.collect()))
    assert counts[0] == counts[1] and len(counts[0]) == 300 - 8


def test_nothing(spark, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert A.audit(with_source(nothing), labels).count() == 0


def test_survivors_are_left_anti_joins_on_ids(spark, rows):
    docs = with_source(frame(spark, rows[:10]))
    keys = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("source").alias("part"))
    plan = A.survivors(keys, {f: keys for f in "AB"})._jdf.queryExecution().optimizedPlan()
    assert plan.toString().count("LeftAnti") == 2


def test_only_hot_texts_are_broadcast(spark, monkeypatch):
    """Stored tables are compressed, so their sizes say little about the rows a driver would get."""
    plans = {}

    def planned(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return stored(df, name)
    monkeypatch.setattr(A, "stored", planned)
    A.audit(table(spark, SF, "documents"), table(spark, SF, "labels"))
    sent = {name: plan.count("BroadcastExchange") for name, plan in plans.items()}
    assert {name for name, n in sent.items() if n} == {"audit-fails-E"}
    assert sent["audit-fails-E"] == 2       # the hot texts, for the join and the anti join
    assert "SortMergeJoin" in plans["audit-removed"]


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(ORACLE_SQL[NAME])
    got = QUERIES[NAME](spark, SF).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
