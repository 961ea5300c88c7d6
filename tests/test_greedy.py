import random

from crewgate.operators.greedy import first_by_keys


def brute(rows):
    """Sequential rule: accept when no accepted earlier row shares a key."""
    used = [set(), set()]
    out = []
    for seq, a, b in sorted(rows):
        if (a is None or a not in used[0]) and (b is None or b not in used[1]):
            out.append(seq)
            if a is not None:
                used[0].add(a)
            if b is not None:
                used[1].add(b)
    return sorted(out)


def run(spark, rows):
    df = spark.createDataFrame(rows, "seq long, a string, b string")
    return sorted(r["seq"] for r in first_by_keys(df, ["a", "b"], "seq").collect())


def test_chain_is_not_transitive(spark):
    # A~B by name, B~C by VAT: A and C are accepted, B is not
    rows = [(1, "acme", "IT1"), (2, "acme", "IT2"), (3, "beta", "IT2")]
    assert run(spark, rows) == [1, 3] == brute(rows)


def test_null_keys_never_conflict(spark):
    rows = [(1, "x", None), (2, "y", None), (3, None, None), (4, None, "v"), (5, "x", "v")]
    assert run(spark, rows) == brute(rows) == [1, 2, 3, 4]


def test_random_against_brute_force(spark):
    rnd = random.Random(7)
    for trial in range(4):
        n = 300
        rows = []
        for s in rnd.sample(range(10 * n), n):
            a = None if rnd.random() < 0.1 else f"n{rnd.randrange(40)}"
            b = None if rnd.random() < 0.3 else f"v{rnd.randrange(60)}"
            rows.append((s, a, b))
        assert run(spark, rows) == brute(rows), trial


def test_hot_key_and_long_chain(spark):
    # one name held by a third of the rows, and an alternating chain whose
    # acceptance depends on every earlier decision
    rows = [(i, "hot", f"v{i}") for i in range(0, 300, 3)]
    rows += [(i, f"c{i // 2}", f"w{(i + 1) // 2}") for i in range(1, 300, 3)]
    rows += [(i, None, f"v{i - 2}") for i in range(2, 300, 3)]
    assert run(spark, rows) == brute(rows)


def test_property_against_brute_force(spark):
    from hypothesis import given, settings, HealthCheck
    from hypothesis import strategies as st

    keys = st.one_of(st.none(), st.sampled_from(["k1", "k2", "k3", "k4"]))
    batch = st.lists(st.tuples(keys, keys), min_size=0, max_size=25)

    @settings(max_examples=12, deadline=None,
              suppress_health_check=[HealthCheck.function_scoped_fixture])
    @given(batch, st.randoms(use_true_random=False))
    def check(pairs, rnd):
        seqs = rnd.sample(range(1000), len(pairs))
        rows = [(s, a, b) for s, (a, b) in zip(seqs, pairs)]
        assert run(spark, rows) == brute(rows)

    check()


def test_conflict_free_rows_need_no_round(spark):
    df = spark.createDataFrame([(i, f"n{i}", None if i % 2 else f"v{i}") for i in range(40)],
                               "seq long, a string, b string")
    stats = {}
    assert first_by_keys(df, ["a", "b"], "seq", stats).count() == 40 and stats["rounds"] == 0


def test_null_keys_do_not_meet_in_one_task(spark):
    import contextlib
    import io

    from crewgate.operators import greedy
    df = spark.createDataFrame([(1, "x", None)], "seq long, a string, b string")
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        greedy._with_holders(df, ["a", "b"], "seq").explain()
    joins = [x for x in buf.getvalue().splitlines() if "Join" in x]
    assert joins and all("_salt" in x for x in joins)


def test_long_chain_in_logarithmic_rounds(spark):
    # every request shares its name with one neighbour and its VAT with the other
    rows = [(i, f"n{i // 2}", f"v{(i + 1) // 2}") for i in range(10_000)]
    df = spark.createDataFrame(rows, "seq long, a string, b string")
    stats = {}
    got = sorted(r["seq"] for r in first_by_keys(df, ["a", "b"], "seq", stats).collect())
    assert got == brute(rows) and stats["rounds"] <= 16
