"""Operator 9: near-duplicate classes by ProbMinHash, banding and verification.

Texts are sets of five-word shingles (a text of one to four words is one
shingle).  A ProbMinHash signature (Ertl 2020) draws for every shingle a Poisson
process; each arrival falls on a random slot, a slot keeps the shingle of its
earliest arrival, and a shingle stops as soon as its next arrival comes after
the latest slot of the text.  Two signatures are drawn.  In one a shingle's rate is 1
plus the logarithm of its count, so two texts agree in a slot with the probability
Jaccard similarity of their weighted shingles; in the other all rates are 1 and the
agreement is the Jaccard similarity of the shingle sets, the measure that links are
defined by (pairs whose differing shingles repeat are far apart under the first).
Slots of both are banded; texts that share a band of either are candidates, and a candidate pair is a link if that
similarity, computed from the whole texts, is at least the threshold.  Classes
are the connected components of the links.

Scale.  Exact copies are one text from the start (grouped by SHA-256), so
thousands of copies cost one signature row each and nothing after.  Inside a
bucket no pairs are made: each text is compared first with the most central
text of its buckets, the one whose buckets hold most others.  In a group of n
near copies of one text that is the text they were made from, and n - 1
comparisons join them.  Only buckets that still hold several classes afterwards
go on, again with one text per bucket and class.  What is left then is compared
across classes in full, so no candidate link is lost: a bucket is cut into
parts of ``PART`` texts, every two parts meet in one task, and only links come
out of it, no pairs.  There a pair is compared in full unless its shingle counts
alone rule the threshold out.  Comparisons of one text with many are salted into
groups of ``FAN`` rows.  Nothing but round counts comes to
the driver, and no join broadcasts (``unbroadcast``); intermediate tables are written to
the checkpoint folder.  The small side of a join on a band or hub is written first, since
Spark splits a hot key only where both sides of a join come straight from an exchange.

Edge cases.  Null and empty texts, and texts of white space alone, have no
shingle: equal ones are copies of each other and link to nothing else.  Repeated
rows are copies.  ``class_id`` is the smallest doc id of the class (null if it
has none).  An empty table gives no row.  Other columns are never read;
``keep_one`` hands them through, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewgate.llm import arrays as A
from crewgate.llm.common import drop_stored, slices, stored, unbroadcast

WORDS, THRESHOLD = 5, 0.8     # fixed by the task
BANDS, ROWS = 24, 6           # a pair at 0.8 shares a band with probability 0.9993
WEIGHTED = 8                  # further bands, over shingles weighted by their count
FAN, PART, SALTS = 256, 512, 16


def shingles(data, offsets, n: int = WORDS):
    """(document, hash) of every shingle occurrence."""
    start, end, doc = A.words(data, offsets)
    h = A.segment_hash(data, start, end)
    at, five = A.windows(h, doc, n)
    count = np.bincount(doc, minlength=len(offsets) - 1)
    small = np.flatnonzero((count > 0) & (count < n))
    if not len(small):
        return doc[at], five
    first = np.searchsorted(doc, small)
    p = A.powers(n)
    whole = count[small].astype(np.uint64)
    for i in range(n - 1):
        has = count[small] > i
        whole[has] += h[first[has] + i] * p[i]
    return np.concatenate([doc[at], small]), np.concatenate([five, A.mix64(~whole)])


def distinct(doc, key):
    """Distinct (document, hash) in that order, with their counts."""
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
    at = np.flatnonzero(first)
    return doc[at], key[at], np.diff(np.append(at, len(doc)))


def signatures(doc, key, weight, n_docs: int, m: int):
    """(n_docs x m) winning shingle of every slot; rows without shingles stay 0."""
    best = np.full((n_docs, m), np.inf)
    won = np.zeros((n_docs, m), np.uint64)
    flat, flat_won = best.ravel(), won.ravel()
    latest = np.full(n_docs, np.inf)
    t, step = np.zeros(len(doc)), np.zeros(1, np.uint64)
    while len(doc):
        step += np.uint64(1)
        r = A.mix64(key + step * A.BASE)
        t = t - np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0 ** 53) / weight
        alive = t < latest[doc]
        doc, key, weight, t, r = doc[alive], key[alive], weight[alive], t[alive], r[alive]
        slot = doc * m + (A.mix64(r) % np.uint64(m)).astype(np.int64)
        np.minimum.at(flat, slot, t)
        wins = flat[slot] == t
        flat_won[slot[wins]] = key[wins]
        touched = np.unique(doc)
        latest[touched] = best[touched].max(axis=1)
    return won


def band_keys(won, bands: int, rows: int, first: int = 0):
    """One 64-bit key per (document, band); bands are numbered from ``first``."""
    p = A.powers(rows)
    parts = won.reshape(len(won), bands, rows)
    h = (parts * p).sum(axis=2, dtype=np.uint64)
    number = np.arange(first + 1, first + bands + 1, dtype=np.uint64)
    return A.mix64(h + A.mix64(number)).view(np.int64)


def sketcher(bands: int, rows: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch):
                data, offsets = A.text_bytes(part.column("text"))
                n = len(offsets) - 1
                doc, key, count = distinct(*shingles(data, offsets))
                won = signatures(doc, key, np.ones(len(doc)), n, bands * rows)
                more = signatures(doc, key, 1 + np.log(count), n, WEIGHTED * rows)
                keys = np.hstack([band_keys(won, bands, rows),
                                  band_keys(more, WEIGHTED, rows, bands)])
                size = np.bincount(doc, minlength=n)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id").cast(pa.int64()),
                    "digest": part.column("digest"),
                    "size": pa.array(size, pa.int64()),
                    "bands": pa.array([k.tobytes() if m else None for k, m in zip(keys, size)],
                                      pa.binary())})
    return run


def unpack(batches):
    """(rid, size, bands) -> one (band, rid, size) row per band."""
    import pyarrow as pa

    for batch in batches:
        rid, size = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("rid", "size"))
        keys = [np.frombuffer(b.as_py(), np.int64) for b in batch.column("bands")]
        if keys:
            n = len(keys[0])
            for lo in range(0, len(keys), 2000):
                yield pa.RecordBatch.from_pydict({
                    "band": pa.array(np.concatenate(keys[lo:lo + 2000])),
                    "rid": pa.array(np.repeat(rid[lo:lo + 2000], n)),
                    "size": pa.array(np.repeat(size[lo:lo + 2000], n))})


def comparer(threshold: float):
    """Rows of a group (hub, salt) arrive with the hub first: emit the links to it."""
    def run(batches):
        import pyarrow as pa

        group, base = None, None
        for batch in batches:
            for part in slices(batch):
                data, offsets = A.text_bytes(part.column("text"))
                n = len(offsets) - 1
                doc, key, _ = distinct(*shingles(data, offsets))
                cut = np.searchsorted(doc, np.arange(n + 1))
                hubs, salts, rids = (part.column(k).to_pylist() for k in ("hub", "salt", "rid"))
                a, b = [], []
                for k in range(n):
                    own = key[cut[k]:cut[k + 1]]
                    if (hubs[k], salts[k]) != group:
                        if hubs[k] == rids[k]:
                            group, base = (hubs[k], salts[k]), own
                        continue
                    if rids[k] != hubs[k] and similar(base, own, threshold):
                        a.append(hubs[k])
                        b.append(rids[k])
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()),
                                                  "b": pa.array(b, pa.int64())})
    return run


def links(pairs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The (a, b) among distinct ``pairs`` (hub, rid) whose texts are similar."""
    groups, _ = stored(pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).select(
        "hub", F.ceil(F.col("n") / FAN).cast("int").alias("salts")), "hubs")
    members = pairs.join(unbroadcast(groups), "hub").select(
        "hub", F.pmod(F.xxhash64("rid"), F.col("salts")).cast("int").alias("salt"), "rid")
    hubs = groups.select("hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
                         F.col("hub").alias("rid"))
    rows = members.unionByName(hubs).join(unbroadcast(texts), "rid")
    rows = rows.select("hub", "salt", "rid", "text").repartition("hub", "salt") \
        .sortWithinPartitions("hub", "salt", F.col("hub") != F.col("rid"), "rid")
    return rows.mapInArrow(comparer(threshold), "a long, b long").distinct()


def similar(a, b, threshold: float) -> bool:
    """Whether two ascending arrays of distinct hashes reach the Jaccard threshold."""
    if not len(a) or not len(b):
        return False
    place = np.searchsorted(a, b)
    place[place == len(a)] = 0
    common = int((a[place] == b).sum())
    return common >= threshold * (len(a) + len(b) - common)


def common_counts(sets, a, b):
    """How many hashes ``sets[a]`` and ``sets[b]`` share, for every pair; ``a`` ascends."""
    size = np.array([len(x) for x in sets])
    start = np.cumsum(size) - size
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    code = code.astype(np.int32)
    held = np.zeros(int(code.max()) + 1, bool)
    out = np.empty(len(a), np.int64)
    edge = np.flatnonzero(np.diff(a, prepend=-1, append=-1))
    for lo, hi in zip(edge, edge[1:]):
        own = code[start[a[lo]]:start[a[lo]] + size[a[lo]]]
        held[own] = True
        for k in range(lo, hi):
            out[k] = np.count_nonzero(held[code[start[b[k]]:start[b[k]] + size[b[k]]]])
        held[own] = False
    return out


def part_comparer(threshold: float):
    """Rows of a group (band, lo, hi): texts of two parts of a bucket, or of one."""
    def links_of(band, lo, hi, group):
        import pyarrow as pa

        rid, label, size, part = (np.concatenate([g.column(k).to_numpy() for g in group])
                                  for k in ("rid", "label", "size", "part"))
        bands = np.frombuffer(b"".join(x for g in group for x in g.column("bands").to_pylist()),
                              np.int64).reshape(len(rid), -1)
        one = np.flatnonzero(part == lo)
        two = one if lo == hi else np.flatnonzero(part == hi)
        a, b = [], []
        for k in range(0, len(one), 64):
            x = one[k:k + 64]
            ok = (label[x][:, None] != label[two]) & (
                np.minimum(size[x][:, None], size[two])
                >= threshold * np.maximum(size[x][:, None], size[two]))
            if lo == hi:
                ok &= rid[x][:, None] < rid[two]
            i, j = np.nonzero(ok)
            i, j = x[i], two[j]
            first = bands[i, (bands[i] == bands[j]).argmax(axis=1)] == band
            a.append(i[first])                          # a pair counts in its first bucket
            b.append(j[first])
        a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))
        sets = []
        wanted = np.zeros(len(rid), bool)
        wanted[a] = wanted[b] = True
        at = 0
        for g in group:
            for s in slices(g):
                mine = np.flatnonzero(wanted[at:at + s.num_rows])
                if len(mine):
                    doc, key, _ = distinct(*shingles(*A.text_bytes(
                        s.column("text").take(pa.array(mine)))))
                    cut = np.searchsorted(doc, np.arange(len(mine) + 1))
                    sets += [key[x:y] for x, y in zip(cut, cut[1:])]
                at += s.num_rows
        if len(a):
            at = np.cumsum(wanted) - 1
            common = common_counts(sets, at[a], at[b])
            hit = common >= threshold * (size[a] + size[b] - common)
            a, b = a[hit], b[hit]
        return pa.RecordBatch.from_pydict({"a": pa.array(rid[a], pa.int64()),
                                           "b": pa.array(rid[b], pa.int64())})

    def run(batches):
        key, group = None, []
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in ("band", "lo", "hi"))))
            start = 0
            for k in range(len(keys) + 1):
                if k == len(keys) or keys[k] != keys[start]:
                    if keys and keys[start] != key:
                        if group:
                            yield links_of(*key, group)
                        key, group = keys[start], []
                    if k > start:
                        group.append(batch.slice(start, k - start))
                    start = k
        if group:
            yield links_of(*key, group)
    return run


def cross_links(left: DataFrame, sketches: DataFrame, texts: DataFrame,
                threshold: float = THRESHOLD) -> DataFrame:
    """All links (a, b) between different classes inside the open buckets ``left``."""
    # a bucket's rows meet its number of parts under a salt, not all in one task
    parts = left.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts")) \
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = left.select("band", "rid", "label", "size", F.pmod(F.xxhash64("rid"), F.lit(SALTS)).cast(
        "int").alias("salt")).join(unbroadcast(parts), ["band", "salt"]).withColumn(
        "part", F.pmod(F.xxhash64("rid", F.lit(1)), F.col("parts")).cast("int"))
    rows = rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("band", "rid", "label", "size", "part", F.least("part", "x").alias("lo"),
                       F.greatest("part", "x").alias("hi"))
    whole = sketches.join(unbroadcast(texts), "rid")
    rows = rows.join(unbroadcast(whole), "rid").repartition("band", "lo", "hi") \
        .sortWithinPartitions("band", "lo", "hi", "rid")
    return rows.select("band", "lo", "hi", "part", "rid", "label", "size", "bands", "text") \
        .mapInArrow(part_comparer(threshold), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(rid, label): the smallest node of the component of every node of ``edges``.

    Smallest label among neighbours, then pointer jumping, until nothing changes;
    the table of a round is written before the next one reads it, and deleted
    after that.
    """
    spark = edges.sparkSession
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"),
                                                           F.col("a").alias("b")))
    both, links_path = stored(both.distinct(), "links")
    label, path = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("rid"), F.least("a", "m").alias("label")), "labels")
    while True:
        of = label.select(F.col("rid").alias("b"), F.col("label").alias("l"))
        near = both.join(unbroadcast(of), "b").groupBy("a").agg(F.min("l").alias("l")).select(
            F.col("a").alias("rid"), "l")
        step = label.join(unbroadcast(near), "rid").select(
            "rid", F.col("label").alias("old"), F.least("label", "l").alias("label"))
        jump = label.select(F.col("rid").alias("label"), F.col("label").alias("l"))
        step = step.join(unbroadcast(jump), "label").select(
            "rid", F.least("label", "l").alias("label"), (F.col("old") != F.least(
                "label", "l")).alias("changed"))
        step, new_path = stored(step, "labels")
        drop_stored(spark, path)
        path, label = new_path, step.select("rid", "label")
        if not step.where("changed").limit(1).count():
            drop_stored(spark, links_path)
            return label


def digest():
    return F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))


def within(threshold: float, a: str, b: str):
    """Whether sets of sizes ``a`` and ``b`` can reach the threshold at all."""
    return F.least(a, b) >= threshold * F.greatest(a, b)


def top_of_bucket(members: DataFrame, *keys: str) -> DataFrame:
    """(keys, hub, hub_size, hub_rank): the most central text of every group."""
    return members.groupBy(*keys).agg(F.min(F.struct("rank", "rid", "size")).alias("t")).select(
        *keys, F.col("t.rid").alias("hub"), F.col("t.size").alias("hub_size"),
        F.col("t.rank").alias("hub_rank"))


def open_buckets(members: DataFrame, label: DataFrame) -> DataFrame:
    """Members with their class label, of the buckets that still hold several classes."""
    rows = members.join(unbroadcast(label), "rid", "left").withColumn(
        "label", F.coalesce("label", "rid"))
    mixed, _ = stored(rows.groupBy("band").agg(
        F.min("label").alias("lo"), F.max("label").alias("hi"))
        .where(F.col("lo") != F.col("hi")).select("band"), "mixed-buckets")
    return rows.join(unbroadcast(mixed), "band")


def classes(documents: DataFrame, bands: int = BANDS, rows: int = ROWS,
            threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, digest, rid, label, class_id, keeper): a row per row of ``documents``.

    ``rid`` numbers the distinct texts, ``label`` the class, ``keeper`` is true on
    the rows of the text and id that stand for the class.
    """
    spark = documents.sparkSession
    docs = documents.select("doc_id", "text", digest().alias("digest"))
    sketch, _ = stored(docs.mapInArrow(sketcher(bands, rows),
                                       "doc_id long, digest binary, size long, bands binary"),
                       "sketches")
    texts, _ = stored(sketch.groupBy("digest").agg(
        F.min("doc_id").alias("doc_id"), F.first("size").alias("size"),
        F.first("bands").alias("bands"))
        .withColumn("rid", F.monotonically_increasing_id()), "distinct-texts")
    banded = texts.where(F.col("bands").isNotNull()).select("rid", "size", "bands") \
        .mapInArrow(unpack, "band long, rid long, size long")
    shared, shared_path = stored(banded.groupBy("band").agg(
        F.count(F.lit(1)).alias("n")).where("n > 1"), "shared-bands")
    counted, path = stored(banded.join(unbroadcast(shared), "band"), "buckets")
    rank = counted.groupBy("rid").agg((-F.sum("n")).alias("rank"))    # most others first
    members, members_path = stored(counted.drop("n").join(unbroadcast(rank), "rid"),
                                   "buckets")
    drop_stored(spark, path, shared_path)

    wanted = unbroadcast(members.select("rid").distinct().join(
        unbroadcast(texts.select("rid", "digest", "doc_id")), "rid"))
    found = docs.select(F.col("digest").alias("d"), F.col("doc_id").alias("i"), "text")
    involved, texts_path = stored(found.join(
        wanted, (F.col("d") == F.col("digest")) & F.col("i").eqNullSafe(F.col("doc_id")))
        .select("rid", "text"), "candidate-texts")

    tops, tops_path = stored(top_of_bucket(members, "band"), "bucket-tops")
    first = members.join(unbroadcast(tops), "band").where(
        (F.col("hub") != F.col("rid")) & within(threshold, "size", "hub_size"))
    first = first.groupBy("rid").agg(F.min(F.struct("hub_rank", "hub")).alias("t"))
    tested, _ = stored(first.select("t.hub", "rid"), "pairs")
    drop_stored(spark, tops_path)
    edges, _ = stored(links(tested, involved, threshold), "edges")
    label = components(edges)

    # one text per bucket and class against the bucket's most central one
    left = open_buckets(members, label)
    heads = top_of_bucket(left, "band", "label").select(
        "band", "label", F.col("hub").alias("rid"), F.col("hub_size").alias("size"),
        F.col("hub_rank").alias("rank"))
    second = heads.join(unbroadcast(top_of_bucket(heads, "band")), "band").where(
        (F.col("hub") != F.col("rid")) & within(threshold, "size", "hub_size"))
    second = second.select("hub", "rid").distinct()
    second, _ = stored(second.join(unbroadcast(tested), ["hub", "rid"], "left_anti"), "pairs")
    more, _ = stored(links(second, involved, threshold), "edges")
    edges = edges.unionByName(more)
    label = components(edges)

    # the rest: all texts of different classes that share a bucket
    left, left_path = stored(open_buckets(members, label), "open-buckets")
    last, _ = stored(cross_links(left, texts.select("rid", "bands"), involved, threshold),
                     "edges")
    label = components(edges.unionByName(last))
    drop_stored(spark, members_path, texts_path, left_path)

    whole = texts.select("rid", "digest", F.col("doc_id").alias("first_id")).join(
        unbroadcast(label), "rid", "left").withColumn("label", F.coalesce("label", "rid"))
    heads = whole.groupBy("label").agg(
        F.min("first_id").alias("class_id"),
        F.min(F.struct(F.col("first_id").isNull(), "first_id", "rid")).alias("head"))
    whole = whole.join(unbroadcast(heads), "label").select(
        "digest", "rid", "label", "class_id", "first_id",
        (F.col("head.rid") == F.col("rid")).alias("is_head"))
    return sketch.select("doc_id", "digest").join(unbroadcast(whole), "digest").select(
        "doc_id", "digest", "rid", "label", "class_id",
        (F.col("is_head") & F.col("doc_id").eqNullSafe(F.col("first_id"))).alias("keeper"))


def keep_one(documents: DataFrame, **options) -> DataFrame:
    """One row of every class (its smallest doc id), all columns unchanged."""
    keepers = classes(documents, **options).where("keeper").select(
        F.col("digest").alias("d"), F.col("doc_id").alias("i")).distinct()
    rows = documents.select(F.struct("*").alias("row"), "doc_id", digest().alias("digest"))
    held = rows.join(unbroadcast(keepers), (F.col("digest") == F.col("d"))
                     & F.col("doc_id").eqNullSafe(F.col("i")))
    return held.dropDuplicates(["d", "i"]).select("row.*")
