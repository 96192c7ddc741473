"""Ordered operators against plain Python, with narrow buckets and one hot group."""

import random
from bisect import bisect_right
from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from promptmill.operators import items as it
from promptmill.operators import ordered as od
from promptmill.operators import rules as rl
from promptmill.operators.pools import pool_intervals


def _rows(seed=1, n=400):
    """Two thirds of the rows in one group, positions with gaps."""
    rng = random.Random(seed)
    return [(("hot" if rng.random() < 0.66 else f"g{rng.randrange(5)}"), p, rng.randrange(9))
            for p in sorted(rng.sample(range(5000), n))]


@pytest.mark.parametrize("width", [1, 7, 100_000])
def test_ordinal(spark, width):
    rows, want, seen = _rows(), {}, defaultdict(int)
    for g, p, _ in rows:
        want[g, p] = seen[g]
        seen[g] += 1
    got = od.with_ordinal(spark.createDataFrame(rows, "g string, p long, v long"), ["g"], "p", width=width).collect()
    assert {(r.g, r.p): r.ordinal for r in got} == want and len(got) == len(rows)


@pytest.mark.parametrize("width", [3, 100_000])
def test_running_sums(spark, width):
    rows, want, total = _rows(2), {}, defaultdict(int)
    for g, p, v in rows:
        total[g] += v
        want[g, p] = total[g]
    df = spark.createDataFrame(rows, "g string, p long, v long")
    got = od.with_running_sums(df, ["g"], F.col("p"), ["p"], {"s": "v"}, width).collect()
    assert {(r.g, r.p): r.s for r in got} == want


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_running_usage_where_clocks_change(spark, zone, kind):
    from promptmill.operators.usage import running_usage
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        times = [f"{day} {h:02d}:{m:02d}:00" for day in ("2024-03-10", "2024-11-03") for h in range(5) for m in (0, 30)]
        usage = spark.createDataFrame([(t, i, 0, "scorer", 1, i) for i, t in enumerate(times)],
                                      "t string, call_id long, run_id long, role string, prompt_tokens long, "
                                      "completion_tokens long").withColumn("ts", F.col("t").cast(kind))
        total = 0
        for i, r in enumerate(sorted(running_usage(usage, 60).collect(), key=lambda r: (r.ts, r.call_id)), 1):
            total += r.completion_tokens
            assert (r.prompt_so_far, r.completion_so_far, r.total_so_far) == (i, total, i + total)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("width", [1, 50, 100_000])
def test_as_of(spark, width):
    rows, rng = _rows(3), random.Random(4)
    marks = [(g, m) for g in ("hot", "g0", "g1", "g2", "g3") for m in rng.sample(range(100, 5000), 25)]
    marks += marks[:5]
    by = defaultdict(list)
    for g, m in sorted(set(marks)):
        by[g].append(m)
    want = {(g, p): (by[g][bisect_right(by[g], p) - 1] if bisect_right(by[g], p) else None) for g, p, _ in rows}
    got = od.as_of(spark.createDataFrame(rows, "g string, p long, v long"),
                   spark.createDataFrame(marks, "g string, m long"), ["g"], "p", "m", width).collect()
    assert {(r.g, r.p): r.m for r in got} == want and len(got) == len(rows)


def _spread(kind, n=3000):
    """One group with two thirds of the rows, under ids that are dense, hashed, or follow one time stamp."""
    rng = random.Random(7)
    ids = {"dense": range(n), "hashed": [rng.randrange(-2**62, 2**62) for _ in range(n)], "one time": range(n)}[kind]
    return [("hot" if i % 3 else None if i % 2 else f"g{i % 5}", p, 5 if kind == "one time" and i % 9 else i % 11) for i, p in enumerate(ids)]


@pytest.mark.parametrize("kind", ["dense", "hashed", "one time"])
def test_no_range_holds_much_more_than_its_share(spark, kind):
    """Rows by range, and what is carried: for any spread of positions, both bounded by the number of ranges."""
    rows = _spread(kind)
    df, safe = od.keyed(spark.createDataFrame(rows, "g string, p long, t long"), ["g"])
    dealt = od.ranged(df, [*safe, "t", "p"], 4)
    sizes = [r["count"] for r in dealt.groupBy("_bucket").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * len(rows) / 4
    assert dealt.select(*safe, "_bucket").distinct().count() <= 4 + len({g for g, _, _ in rows})
    ends = dealt.groupBy("_bucket").agg(F.min(F.struct(*safe, "t", "p")).alias("low"), F.max(F.struct(*safe, "t", "p")).alias("high")).orderBy("_bucket").collect()
    assert all(a.high < b.low for a, b in zip(ends, ends[1:], strict=False))


@pytest.mark.parametrize("kind", ["dense", "hashed", "one time"])
@pytest.mark.parametrize("width", [100, 100_000])
def test_ordered_work_over_any_spread(spark, kind, width):
    rows = _spread(kind)
    df = spark.createDataFrame(rows, "g string, p long, t long")
    by = defaultdict(list)
    for g, p, t in rows:
        by[g].append((t, p))
    places = {(g, p): i for g, held in by.items() for i, (_, p) in enumerate(sorted(held, key=lambda r: r[1]))}
    got = od.with_ordinal(df, ["g"], "p", width=width).collect()
    assert {(r.g, r.p): r.ordinal for r in got} == places and len(got) == len(rows)
    sums = {}
    for g, held in by.items():
        total = 0
        for t, p in sorted(held):
            total += t
            sums[g, p] = total
    got = od.with_running_sums(df, ["g"], F.col("t"), ["p"], {"s": "t"}, width).collect()
    assert {(r.g, r.p): r.s for r in got} == sums
    marks = [(g, p) for g, p, _ in rows[::40]] + [("none of these", 3)]
    starts = defaultdict(list)
    for g, m in sorted(marks, key=str):
        starts[g].append(m)
    got = od.as_of(df, spark.createDataFrame(marks, "g string, m long"), ["g"], "p", "m", width).collect()
    assert {(r.g, r.p): r.m for r in got} == {(g, p): max((m for m in starts[g] if m <= p), default=None) for g, p, _ in rows}


def test_dense_rank(spark):
    df = spark.createDataFrame([("a", 5), ("b", 5), ("c", 2), ("d", 9)], "t string, n long")
    assert {r.t: r.rank for r in od.with_dense_rank(df, "n").collect()} == {"d": 1, "a": 2, "b": 2, "c": 3}


@pytest.mark.parametrize("threshold", ["-1", "10485760"])
def test_lookup_joins_alike_without_broadcast(spark, threshold):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        rows = spark.createDataFrame(_rows(), "g string, p long, v long")
        table = spark.createDataFrame([("hot", "x"), ("g1", "y")], "g string, name string")
        got = od.lookup(rows, table, ["g"]).collect()
        assert len(got) == 400 and {(r.g, r.name) for r in got if r.name} == {("hot", "x"), ("g1", "y")}
        assert od.lookup(rows, table, ["g"], "inner").count() == sum(r.name is not None for r in got)
        names = {r.g for r in got if r.name is None}
        assert names == {"g0", "g2", "g3", "g4"}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_item_index_counts_over_subsets_in_name_order(spark):
    rows = _rows(5)
    want = {(g, p): i for i, (g, p, _) in enumerate(sorted(rows))}
    got = it.with_item_index(spark.createDataFrame(rows, "subset string, pos long, v long"), width=64).collect()
    assert {(r.subset, r.pos): r.item_index for r in got} == want and {r.n_total for r in got} == {400}


@pytest.mark.parametrize("limit, offset", [(3, 0), (3, 2), (0, 0), (0, 4), (None, 1), (2000, 3), (-1, 0), (5, 999)])
def test_slices(spark, limit, offset):
    rows, by = _rows(6), defaultdict(list)
    for g, p, _ in rows:
        by[g].append(p)
    end = None if not limit or limit < 0 else offset + limit
    want = {(g, p) for g, ps in by.items() for p in ps[offset:end]}
    got = it.slice_subsets(spark.createDataFrame(rows, "subset string, pos long, v long"), limit, offset).collect()
    assert {(r.subset, r.pos) for r in got} == want and len(got) == len(want)


def test_slicing_does_not_move_the_items(spark):
    df = spark.createDataFrame(_rows(), "subset string, pos long, v long")
    for limit, offset in ((5, 2), (2000, 3), (0, 4)):
        plan = it.slice_subsets(df, limit, offset)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_both_ends(spark):
    rows = [(g, p) for g, n in (("a", 100), (None, 15), ("b", 5), ("c", 20), ("d", 21)) for p in random.Random(n).sample(range(10**6), n)]
    want = {}
    for g in {g for g, _ in rows}:
        held = sorted(p for k, p in rows if k == g)
        want |= {(g, p): i for i, p in enumerate(held) if i < 10 or i >= len(held) - 10}
    df = spark.createDataFrame(rows, "run string, p long")
    got = it.both_ends(df, ["run"], ["p"])
    assert {(r.run, r.p): r.item_index for r in got.collect()} == want and got.count() == len(want)
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()
    assert it.both_ends(df.limit(0), ["run"], ["p"]).count() == 0


def test_requested_subsets():
    assert it.requested_subsets(" a, b ,") == ["a", "b"]
    assert it.requested_subsets("a") == ["a"] and it.requested_subsets(["x", "all"]) is None
    assert it.requested_subsets("") == it.requested_subsets(None) == ["high_school_mathematics"]


def test_pool_intervals(spark):
    pools = spark.createDataFrame([(1, v, k, "p") for v in (0, 4, 9) for k in (0, 1)] + [(2, 0, 0, "p")],
                                  "run_id long, valid_from long, prompt_pos int, prompt string")
    got = {(r.run_id, r.valid_from, r.pool_no, r.valid_to) for r in pool_intervals(pools, 2).collect()}
    assert got == {(1, 0, 0, 4), (1, 4, 1, 9), (1, 9, 2, None), (2, 0, 0, None)}


def _merges(n: int, g: int):
    """Merges of ``n`` rules one by one: name -> names of its inputs."""
    made, waiting, held = {}, [], []
    counts = defaultdict(int)

    def merge(tier, inputs):
        counts[tier] += 1
        made[tier, counts[tier]] = list(inputs)
        return tier, counts[tier]
    for rule in range(n):
        waiting.append(rule)
        if len(waiting) == g:
            held.append(merge(rl.TIER1, waiting))
            waiting = []
        if len(held) == g:
            held = [merge(rl.FOLD, held)]
    if waiting:
        held.append(merge(rl.TAIL, waiting))
    if len(held) > 1:
        held = [merge(rl.CONVERGENCE, held)]
    return made, held


@pytest.mark.parametrize("g", [2, 3, 4])
def test_merge_tree_is_the_one_by_one_order(spark, g):
    sizes = list(range(0, 40)) + [97]
    rules = spark.createDataFrame(
        [(n, i, "r") for n in sizes for i in range(n)], "run_id long, item_id long, rule_text string")
    chunks = rl.tier1_chunks(rules, g, width=5)
    rows = rl.merge_tree(chunks, g).collect()
    for n in sizes:
        made, held = _merges(n, g)
        nodes = {(r.tier, r.seq): r for r in rows if r.run_id == n}
        assert set(nodes) == set(made), n
        for name, inputs in made.items():
            assert nodes[name].n_inputs == len(inputs)
            for place, child in enumerate(inputs, 1):
                if isinstance(child, tuple):
                    r = nodes[child]
                    assert (r.parent_tier, r.parent_seq, r.parent_place) == (*name, place), (n, name)
        assert [k for k, r in nodes.items() if r.parent_tier is None] == held


def test_single_rule_chunks_are_refused(spark):
    with pytest.raises(ValueError):
        rl.tier1_chunks(spark.createDataFrame([], "run_id long, item_id long, rule_text string"), 1)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 300)), unique=True, max_size=60), st.integers(2, 5),
       st.integers(1, 40))
def test_chunks_cover_each_rule_once(spark, placed, g, width):
    rules = spark.createDataFrame([(r, i, f"<{r}:{i}>") for r, i in placed],
                                  "run_id long, item_id long, rule_text string")
    got = rl.tier1_chunks(rules, g, width=width).collect()
    text = "".join(r.rules_block for r in sorted(got, key=lambda r: (r.run_id, r.chunk)))
    order = [f"<{r}:{i}>" for r, i in sorted(placed)]
    assert [t for t in text.replace(">", ">\n").split("\n") if t.startswith("<")] == order
    for r in got:
        assert r.n_rules == g or r.is_tail


def test_sections_and_consensus(spark):
    texts = [
        ("Sure!\n\n---\n**Template:**\n\n[Guiding Tone]\nCalm\n\n[Key Vocabulary]\nClear, Steps , clear\n\n"
         "[Do's]\n- a [b]\n\n[Don'ts]\n- c\n\n---\n\nThis template is done."),
        "[Key Vocabulary]\r\nclear\r\n[Thinking Steps]\n1. x\n2. y", "nothing here",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "rule_id long, rule_text string")
    got = {(r.rule_id, r.heading): r.body for r in rl.rule_sections(df, ["rule_id"]).collect()}
    assert got == {
        (0, "Guiding Tone"): "Calm", (0, "Key Vocabulary"): "Clear, Steps , clear", (0, "Do's"): "- a [b]",
        (0, "Don'ts"): "- c", (1, "Key Vocabulary"): "clear", (1, "Thinking Steps"): "1. x\n2. y"}
    ranked = {(r.term, r.n_rules, r.rank) for r in rl.rule_consensus(df, ["rule_id"]).collect()}
    assert ranked == {("clear", 2, 1), ("steps", 1, 2)}
