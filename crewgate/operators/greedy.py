"""First-come acceptance under several keys (the in-batch rule of D1).

A request is accepted when no *accepted* earlier request shares any of its
keys.  With one key this is "lowest seq per key"; with two keys (name OR VAT)
acceptance is not transitive, and the result is the greedy matching of the
requests taken in seq order (each request an edge between its key values).

Requests that share no key value with another one are accepted at once.  The
others go through rounds, each an aggregate and a join per key:

1. per key value, the lowest and highest seq and the number of the open requests
   (partial aggregation, so a key held by a third of all rows is reduced map-side);
2. a request that is the lowest at every one of its non-NULL keys is accepted
   — every earlier request sharing one of its keys was already removed for
   sharing a key with an accepted earlier request, so the sequential rule
   accepts it too;
3. a request with exactly one earlier open request on its keys is accepted if that
   one is rejected: such chains, of any length, are settled together by pointer
   doubling (``chains.settle``), log2(n) joins for n links;
4. of the rest, requests sharing a key with an accepted request are rejected
   (accepted requests never share a key, so these joins have a unique right side).

Rows with a NULL key are spread over the tasks of the join on it.  The lowest open
request is always accepted, so every round makes progress; on random arrival
orders the number of rounds is small (Blelloch, Fineman, Shun, SPAA 2012).
Each round is checkpointed to the shared checkpoint folder, so lineage
stays flat and a lost executor recomputes one round only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewgate.operators import chains
from crewgate.operators.sizing import join_spread
from crewgate.session import ensure_checkpoint_dir


def first_by_keys(df: DataFrame, keys: list[str], order: str,
                  stats: dict | None = None) -> DataFrame:
    """Rows of ``df`` (order, *keys) accepted by the sequential rule.

    ``order`` must be unique; NULL key values never conflict.  Returns the
    accepted rows with the same columns.  ``stats``, when given, receives
    the number of rounds and doubling steps run.
    """
    ensure_checkpoint_dir(df.sparkSession)
    stats = {} if stats is None else stats
    stats["rounds"] = 0
    cols = [order, *keys]
    shared = lambda k: F.col(f"_at_{k}").isNotNull()
    state = _with_holders(df.select(*cols), keys, order).checkpoint(eager=True)
    conflicting = reduce(lambda a, b: a | b, [shared(k) for k in keys])
    accepted = [state.where(~conflicting).select(*cols)]
    open_ = state.where(conflicting)
    while not open_.isEmpty():
        nodes = _nodes(open_, keys, order)
        verdicts = chains.settle(nodes, stats).withColumnRenamed("id", order)
        judged = open_.select(*cols).join(verdicts, order).checkpoint(eager=True)
        stats["rounds"] += 1
        accepted.append(judged.where("verdict").select(*cols))
        rest = judged.where("verdict IS NULL").select(*cols)
        if rest.isEmpty():
            break
        for k in keys:
            taken = accepted[-1].where(F.col(k).isNotNull()).select(k)
            rest = join_spread(rest, taken, k, order, "left_anti")
        open_ = _with_holders(rest, keys, order).checkpoint(eager=True)
    return reduce(DataFrame.unionByName, accepted)


def _with_holders(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``df`` with ``_at_<key>``: number, lowest and highest order of the rows that hold
    the key value; NULL where the row is alone or the key is NULL."""
    out = df
    for k in keys:
        at = df.where(F.col(k).isNotNull()).groupBy(k).agg(
            F.count(F.lit(1)).alias("n"), F.min(order).alias("low"), F.max(order).alias("high")) \
            .where("n > 1").select(k, F.struct("n", "low", "high").alias(f"_at_{k}"))
        out = join_spread(out, at, k, order, "left")
    return out


def _nodes(open_: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Open requests for ``chains.settle``: accepted ones, and pointers to the one
    earlier request that decides."""
    seq = F.col(order)
    at = [F.col(f"_at_{k}") for k in keys]
    first = reduce(lambda a, b: a & b, [a.isNull() | (a.low == seq) for a in at])
    one = [F.when((a.n == 2) & (a.high == seq), a.low) for a in at]
    many = reduce(lambda a, b: a | b, [
        a.isNotNull() & (a.low != seq) & o.isNull() for a, o in zip(at, one)])
    parent = F.coalesce(*one)
    same = reduce(lambda a, b: a & b, [o.isNull() | (o == parent) for o in one])
    return open_.select(
        seq.alias("id"), F.when(~F.coalesce(many, F.lit(False)) & same, parent).alias("ptr"),
        F.when(first, True).alias("verdict"), F.lit(False).alias("if_yes"),
        F.lit(True).alias("if_no"))
