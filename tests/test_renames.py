import random

from crewgate.operators import asof, chains, renames


def one_at_a_time(requests, ids):
    """Outcomes and the final place of every id, by applying the requests in order."""
    at = {i: i for i in ids}          # id held now -> id at the start
    out = {}
    for seq, old, new in sorted(requests):
        if old is None or old not in at:
            out[seq] = "not_found"
        elif new is None:
            out[seq] = "missing_key"
        elif old == new:
            out[seq] = "unchanged"
        elif new in at:
            out[seq] = "key_taken"
        else:
            out[seq] = "applied"
            at[new] = at.pop(old)
    return out, {start: now for now, start in at.items()}


def run(spark, requests, ids, stats=None):
    asked = spark.createDataFrame(requests, "seq long, old_id long, new_id long")
    held = spark.createDataFrame([(i,) for i in ids], "key long")
    moves, outcomes = renames.resolve(asked, held, stats)
    moved = {r.old_id: r.new_id for r in moves.collect()}
    return {r.seq: r.outcome for r in outcomes.collect()}, {i: moved.get(i, i) for i in ids}


def check(spark, requests, ids, stats=None):
    assert run(spark, requests, ids, stats) == one_at_a_time(requests, ids)


def check_worlds(spark, worlds, stats=None):
    """Independent batches (requests, ids) applied as one, each with ids of its own."""
    requests, ids = [], []
    for w, (asked, held) in enumerate(worlds):
        up = lambda i: None if i is None else i + 100_000 * w  # noqa: B023, E731
        requests += [(s * len(worlds) + w, up(o), up(n)) for s, o, n in asked]
        ids += [up(i) for i in held]
    check(spark, requests, ids, stats)


def test_swaps_chains_cycles_and_claims(spark):
    check_worlds(spark, [
        ([(1, 1, 2), (2, 2, 1)], [1, 2, 3]),                        # nothing is free
        ([(1, 1, 9), (2, 2, 1), (3, 9, 2)], [1, 2, 3]),             # swap through 9
        ([(1, 3, 4), (2, 2, 3), (3, 1, 2)], [1, 2, 3]),             # chain into a free id
        ([(1, 1, 2), (2, 2, 3), (3, 3, 4)], [1, 2, 3]),             # the wrong way round
        ([(1, 1, 5), (2, 2, 5), (3, 5, 6), (4, 2, 5)], [1, 2]),     # many to one, released
        ([(1, 7, 8), (2, 1, 1), (3, None, 2), (4, 1, None), (5, None, None)], [1, 2]),
        ([(1, 1, 2)], [])])


def test_nothing(spark):
    check(spark, [], [1, 2])


def test_random_batches_and_a_hot_id(spark):
    """Many small worlds where all ids are contended, and one where a third of the
    requests free one id and a third want it."""
    rnd = random.Random(3)
    worlds = []
    for _ in range(40):
        n, most = rnd.choice(((4, 4), (12, 8), (25, 30), (60, 90)))
        pick = lambda: None if rnd.random() < .04 else rnd.randrange(most)  # noqa: B023, E731
        worlds.append(([(s, pick(), pick()) for s in rnd.sample(range(1000), n)],
                       rnd.sample(range(most), most // 2)))
    worlds.append(([(s, *((0, rnd.randrange(1000)), (rnd.randrange(1000), 0),
                          (rnd.randrange(1000), rnd.randrange(1000)))[s % 3])
                    for s in range(150)], list(range(0, 1000, 2))))
    check_worlds(spark, worlds)


def test_long_chains_in_logarithmic_rounds(spark):
    n, stats = 3000, {}
    back = [(n - k, k, k + 1) for k in range(1, n + 1)]
    ids = list(range(1, n + 1))
    check_worlds(spark, [
        (back, ids),                                                # all move
        ([*back, (0, n + 1, n + 2)], [*ids, n + 1, n + 2]),         # the first is refused: none
        ([(k, k, k % n + 1) for k in ids], ids)], stats)            # a cycle that nothing opens
    assert stats["rounds"] <= 16


def test_parent_and_children_follow(spark):
    parent = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "pk long, v string")
    child = spark.createDataFrame([(10, 1), (11, 2), (12, 2), (13, None), (14, 99)],
                                  "id long, pk_ref long")
    asked = spark.createDataFrame([(1, 1, 2), (2, 2, 7), (3, 1, 2), (4, 3, 7)],
                                  "seq long, old_id long, new_id long")
    p, c, out = renames.remap_keys(asked, parent, child, "pk", "pk_ref")
    assert sorted(map(tuple, p.collect())) == [(2, "a"), (3, "c"), (7, "b")]
    assert sorted(map(tuple, c.collect())) == [(10, 2), (11, 7), (12, 7), (13, None), (14, 99)]
    assert [r.outcome for r in out.orderBy("seq").collect()] == [
        "key_taken", "applied", "applied", "key_taken"]


def test_settle_and_roots(spark):
    nodes = spark.createDataFrame(
        [(1, None, True, None, None), (2, 1, None, False, True), (3, 2, None, False, True),
         (4, 3, None, True, False), (5, None, None, None, None), (6, 5, None, False, True),
         (7, 3, None, True, True)],
        "id long, ptr long, verdict boolean, if_yes boolean, if_no boolean")
    got = {r.id: r.verdict for r in chains.settle(nodes).collect()}
    assert got == {1: True, 2: False, 3: True, 4: True, 5: None, 6: None, 7: True}
    ends = {r.id: r.root for r in chains.roots(nodes.select("id", "ptr")).collect()}
    assert ends == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 7: 1}


def test_as_of_join_against_brute_force(spark):
    rnd = random.Random(5)
    events = [(k, s, f"v{k}-{s}") for k in range(5) for s in rnd.sample(range(400), 60)]
    events += [(9, s, f"hot{s}") for s in range(0, 4000, 2)] + [(None, 1, "no key")]
    probes = [(rnd.choice((0, 1, 2, 3, 4, 7, 9, 9, 9, None)), rnd.randrange(4000), i)
              for i in range(1500)]
    e = spark.createDataFrame(events, "k long, s long, v string")
    p = spark.createDataFrame(probes, "k long, s long, i long")
    got = {r.i: r.v for r in asof.last_before(p, e, "k", "s", "v").collect()}
    for k, s, i in probes:
        before = [x for x in events if x[0] == k and k is not None and x[1] < s]
        assert got[i] == (max(before, key=lambda x: x[1])[2] if before else None)
    assert len(got) == len(probes)


def test_settled_rows_stay_out_of_the_steps(spark, monkeypatch):
    """Rows without a pointer that no chain ends at are not written again in every step."""
    links = [(k, k - 1 if k else None, True if k == 0 else None, k % 3 != 0, k % 2 == 0)
             for k in range(40)]
    idle = [(k, None, k % 5 == 0, True, False) for k in range(1000, 2000)]
    nodes = spark.createDataFrame(
        links + idle, "id long, ptr long, verdict boolean, if_yes boolean, if_no boolean")
    want, v = {k: verdict for k, _, verdict, _, _ in idle}, True
    for k, _, _, yes, no in links:
        v = want[k] = v if k == 0 else yes if v else no
    kind, written = type(nodes), []
    plain = kind.checkpoint

    def checkpoint(df, eager=True):
        out = plain(df, eager)
        written.append(out.count())
        return out
    monkeypatch.setattr(kind, "checkpoint", checkpoint)
    assert {r.id: r.verdict for r in chains.settle(nodes).collect()} == want
    assert len(written) > 5 and sorted(written)[-2] == len(links)
