"""Key changes of a parent table that the children follow.

Requests (seq, old_id, new_id) have the result of applying them one at a time in
seq order: a request is refused when no row holds its old id at that point
(``not_found``), when it names no new id (``missing_key``) or when another row holds
the new id (``key_taken``).  An earlier request may have freed or taken either id, so
swaps, chains and several requests to one id depend on one another.

Every request looks at two ids.  What it finds at one of them follows from the last
request before it that named the id, which an as-of join gives once for all
(``asof.last_before``: an id that a third of the requests name is spread over many
tasks).  That request leaves its new id held and its old one free if what it found
at its other id allowed it, whatever the state before; if not, the id stays as that
request found it.  So a finding is known, or equal to one other finding, or a
function of one other, or it waits for two.  Rounds settle all but the waiting ones
by pointer doubling (``chains.settle``), so chains of n dependent requests take
log2(n) steps, however they end; the lowest waiting request is settled in every
round.  Which row a request moved is again an as-of join, among accepted requests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewgate.operators import asof, chains
from crewgate.operators.sizing import join_spread, restrict_to
from crewgate.session import ensure_checkpoint_dir

# Outcome codes of key changes, in the order they are tested.
NOT_FOUND, MISSING_KEY, UNCHANGED, KEY_TAKEN, APPLIED = (
    "not_found", "missing_key", "unchanged", "key_taken", "applied")


def _touched(requests: DataFrame) -> DataFrame:
    """(key, seq, frees): every request at its old id and at its new one, in one pass."""
    return requests.select("seq", F.inline(F.array(
        F.struct(F.col("old_id").alias("key"), F.lit(True).alias("frees")),
        F.struct(F.col("new_id").alias("key"), F.lit(False).alias("frees")))))


def _findings(requests: DataFrame, ids: DataFrame) -> DataFrame:
    """(seq, frees, p, p_frees, held) per request and id: the last request p before it
    that names the id, or without one whether the id is held at the start."""
    probes = _touched(requests).where(F.col("key").isNotNull())
    events = _touched(requests.where(F.col("old_id") != F.col("new_id"))).select(
        "key", "seq", F.struct("seq", "frees").alias("p"))
    found = asof.last_before(probes, events, "key", "seq", "p")
    stored = restrict_to(ids, probes, ["key"]).select("key", F.lit(True).alias("_stored"))
    return found.join(stored, "key", "left").select(
        "seq", "frees", F.col("p.seq").alias("p"), F.col("p.frees").alias("p_frees"),
        F.when(F.col("p").isNull(), F.coalesce("_stored", F.lit(False))).alias("held"))


def _both(findings: DataFrame) -> DataFrame:
    """(seq, old_held, new_held): the two findings of a request in one row."""
    return findings.groupBy("seq").agg(
        F.max(F.when(F.col("frees"), F.col("held"))).alias("old_held"),
        F.max(F.when(~F.col("frees"), F.col("held"))).alias("new_held"))


def _nodes(findings: DataFrame) -> DataFrame:
    """The open ones of ``findings`` for ``chains.settle``, with what is known of the
    requests before.  A pointer goes to a finding not known, so never to another row."""
    before = _both(findings).select(F.col("seq").alias("p"), "old_held", "new_held")
    unknown = findings.where("held IS NULL")        # these have a request before
    frees = F.col("p_frees")
    same = F.when(frees, F.col("old_held")).otherwise(F.col("new_held"))     # found at this id
    other = F.when(frees, F.col("new_held")).otherwise(F.col("old_held"))    # and at its other
    allowed = F.when(frees, ~other).otherwise(other)
    leaves = ~frees                     # the state that an accepted request leaves
    here, there = F.struct("p", "p_frees"), F.struct("p", (~frees).alias("p_frees"))
    verdict = F.when(F.col("p").isNull(), F.col("held")) \
        .when(allowed | (same == leaves), leaves).when(~allowed, same)
    copies = ~allowed & same.isNull()
    decides = allowed.isNull() & same.isNotNull()
    ptr = F.when(verdict.isNotNull(), None).when(copies, here).when(decides, there)
    joined = unknown.join(before, "p", "left")
    return joined.select(
        "seq", "frees", "p", "p_frees", F.struct(F.col("seq").alias("p"), F.col("frees").alias(
            "p_frees")).alias("id"), verdict.alias("verdict"), ptr.alias("ptr"),
        F.when(copies, True).when(frees, same).otherwise(leaves).alias("if_yes"),
        F.when(copies, False).when(frees, leaves).otherwise(same).alias("if_no"))


def findings(requests: DataFrame, ids: DataFrame, stats: dict | None = None) -> DataFrame:
    """(seq, old_held, new_held): whether every request finds its ids held.

    ``stats`` gets the number of rounds and doubling steps.
    """
    known = _findings(requests, ids).checkpoint(eager=True)
    while not known.where("held IS NULL").isEmpty():
        nodes = _nodes(known).checkpoint(eager=True)
        told = nodes.where("ptr IS NOT NULL").drop("verdict").join(
            chains.followed(nodes, stats), "id")
        rows = ["seq", "frees", "p", "p_frees", F.col("verdict").alias("held")]
        known = known.where("held IS NOT NULL").unionByName(
            nodes.where("ptr IS NULL").select(*rows)).unionByName(told.select(*rows)) \
            .checkpoint(eager=True)
        if stats is not None:
            stats["rounds"] = stats.get("rounds", 0) + 1
    return _both(known)


def resolve(mapping: DataFrame, ids: DataFrame, stats: dict | None = None
            ) -> tuple[DataFrame, DataFrame]:
    """(moves, outcomes): (old_id, new_id) of every row whose id changes in the end, and
    seq, old_id, new_id, outcome of every request of ``mapping``.

    ``ids``: key, the ids of the parent table.
    """
    ensure_checkpoint_dir(mapping.sparkSession)
    requests = mapping.select("seq", F.col("old_id").cast("long"), F.col("new_id").cast("long")) \
        .checkpoint(eager=True)
    told = requests.join(findings(requests, ids, stats), "seq", "left").select(
        "seq", "old_id", "new_id",
        F.when(~F.coalesce("old_held", F.lit(False)), F.lit(NOT_FOUND))
         .when(F.col("new_id").isNull(), F.lit(MISSING_KEY))
         .when(F.col("old_id") == F.col("new_id"), F.lit(UNCHANGED))
         .when(F.col("new_held"), F.lit(KEY_TAKEN)).otherwise(F.lit(APPLIED)).alias("outcome")) \
        .checkpoint(eager=True)
    applied = told.where(F.col("outcome") == APPLIED)
    # the accepted request that brought the row to where this one finds it
    moves = asof.last_before(
        applied.select("seq", "new_id", F.col("old_id").alias("key")),
        applied.select("seq", F.col("new_id").alias("key"), F.col("seq").alias("by")),
        "key", "seq", "by").checkpoint(eager=True)
    origin = chains.roots(moves.select(F.col("seq").alias("id"), F.col("by").alias("ptr")))
    final = moves.join(moves.select(F.col("by").alias("seq")), "seq", "left_anti")
    net = final.select(F.col("seq").alias("id"), "new_id").join(origin, "id").join(
        moves.select(F.col("seq").alias("root"), F.col("key").alias("old_id")), "root") \
        .where(F.col("old_id") != F.col("new_id")).select("old_id", "new_id")
    return net, told


def remap_keys(mapping: DataFrame, parent: DataFrame, child: DataFrame, pk: str,
               fk: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Key changes of ``parent`` with its children following (ON UPDATE CASCADE).

    ``mapping``: seq (unique), old_id, new_id.  Returns the parent and child rows
    after all requests, with unique parent keys if they were so before, and the
    outcomes.  Children of no parent, and NULL keys, stay as they are.
    """
    net, outcomes = resolve(mapping, parent.select(F.col(pk).cast("long").alias("key")))
    net = net.select("old_id", F.col("new_id").alias("_new")).checkpoint(eager=True)

    def follow(df: DataFrame, key: str, spread: str) -> DataFrame:
        moved = join_spread(df, net.withColumnRenamed("old_id", key), key, spread, "left")
        return moved.withColumn(key, F.coalesce("_new", key)).select(df.columns)
    return follow(parent, pk, pk), follow(child, fk, child.columns[0]), outcomes
