"""Named cases of the ledger analytics."""

import random

import pytest
from pyspark.sql import functions as F

from sealstone.operators import ledger

CP = "id long, signer long, scope string, shard_id string, ledger_root string, tree_size long, checkpoint_timestamp long, verified boolean"


def flags(spark, rows):
    return {r.id: r.equivocates for r in ledger.equivocations(spark.createDataFrame(rows, CP)).collect()}


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([(1, 1, "s", "a", "x", 5, 10, True), (2, 1, "s", "a", "y", 6, 10, True)], {1: True, 2: True}),  # one moment
        ([(1, 1, "s", "a", "x", 5, 10, True), (2, 1, "s", "a", "y", 5, 11, True)], {1: True, 2: True}),  # one height
        ([(1, 1, "s", "a", "x", 5, 10, True), (2, 1, "s", "a", "x", 5, 10, True)], {1: False, 2: False}),  # the same again
        ([(1, 1, "s", "a", "x", 5, 10, False), (2, 1, "s", "a", "y", 5, 10, True)], {1: False, 2: False}),  # unverified
        ([(1, 1, "s", "a", "x", 5, 10, True), (2, 2, "s", "a", "y", 5, 10, True)], {1: False, 2: False}),  # another signer
        ([(1, 1, "s", "a", "x", 5, 10, True), (2, 1, "s", "b", "y", 5, 10, True)], {1: False, 2: False}),  # another shard
        ([(1, 1, "s", "a", "x", 5, 10, True), (2, 1, "s", "a", "y", 6, 11, True), (3, 1, "s", "a", "z", 6, 12, True)], {1: False, 2: True, 3: True}),
    ],
)
def test_equivocation(spark, rows, want):
    assert flags(spark, rows) == want


def test_first_covering_across_ranges(spark):
    records = spark.createDataFrame([(1, "a", 0, 10), (2, "a", 0, 70000), (3, "a", 0, 200000), (4, "b", 0, 1)], "proof_id long, shard_id string, ts long, snapshot_size long")
    cps = spark.createDataFrame([(1, "a", 10, 500), (2, "a", 70001, 300), (3, "a", 150000, 300), (4, "a", 69999, 100)], "id long, shard_id string, tree_size long, checkpoint_timestamp long")
    got = {r.proof_id: (r.cp_ts, r.cp_id) for r in ledger.first_covering(records, cps).collect()}
    assert got == {1: (100, 4), 2: (300, 2), 3: (None, None), 4: (None, None)}


def test_merge_delay_bounds(spark):
    rows = [(1, 0, 100), (2, 0, 101), (3, 200, 100), (4, 0, None), (5, 950, None)]
    out = ledger.merge_delay(spark.createDataFrame(rows, "k long, ts long, cp_ts long"), 1000, 100).orderBy("k").collect()
    assert [r.status for r in out] == ["within", "breach", "within", "pending-breach", "pending"] and out[2].elapsed == 0
    assert ledger.merge_delay(spark.createDataFrame([(1, 0, 50)], "k long, ts long, cp_ts long"), 1000, 1).first().status == "within"


def test_quorum(spark):
    co = spark.createDataFrame([(1, 1, True), (1, 1, True), (1, 2, True), (1, 3, False), (1, 9, True), (2, 3, False)], "checkpoint_id long, signer long, valid boolean")
    ok = spark.createDataFrame([(1,), (2,), (3,)], "signer long")
    got = lambda n: {r.checkpoint_id: (r.n_signers, r.reached) for r in ledger.quorum(co, ok, n).collect()}
    assert got(2) == {1: (2, True), 2: (0, False)} and got(3)[1] == (2, False) and got(0) == {1: (2, False), 2: (0, False)}


def test_windows_differ_at_their_end(spark):
    rows = spark.createDataFrame([(1, "r", 9), (1, "r", 10), (1, "r", 20), (1, "q", 15), (2, "r", 99)], "signer long, role string, ts long")
    w = spark.createDataFrame([(1, "r", 10, 20), (2, "r", 50, None)], "signer long, role string, valid_from long, valid_until long")
    got = lambda **k: sorted((r.signer, r.role, r.ts, r.trusted) for r in ledger.trusted_at(rows, w, **k).collect())
    half = {(1, "q", 15): False, (1, "r", 9): False, (1, "r", 10): True, (1, "r", 20): False, (2, "r", 99): True}
    assert got() == sorted((*k, v) for k, v in half.items())
    assert got(closed=True) == sorted((*k, v) for k, v in (half | {(1, "r", 20): True}).items())


def test_scalars(spark):
    row = spark.range(1).select(
        ledger.uptime(F.lit(59)).alias("a"), ledger.uptime(F.lit(3600)).alias("b"), ledger.uptime(F.lit(200000)).alias("c"),
        ledger.tree_depth(F.lit(1)).alias("d"), ledger.tree_depth(F.lit(5)).alias("e"), ledger.tree_depth(F.lit(1 << 40)).alias("f"),
        ledger.backoff(F.lit(1), 60).alias("g"), ledger.backoff(F.lit(30), 60).alias("h"), ledger.backoff(F.lit(1), 300, first_is_zero=False).alias("i"),
        ledger.csv_safe(F.lit("=1+1")).alias("j"), ledger.clean_filename(F.lit("a\nb")).alias("k"),
    ).first()
    assert tuple(row) == ("59s", "1h", "2d", 0, 3, 40, 60, 21600, 600, "'=1+1", "ab")


def test_freshness_order(spark):
    rows = [(1, 2000, 5000), (2, 0, 1000), (3, -(10**7), 5000), (4, 900, 10**8), (5, 1200, 2000)]
    got = [r.freshness for r in ledger.freshness(spark.createDataFrame(rows, "k long, issued_at long, expires_at long"), 1000).orderBy("k").collect()]
    assert got == ["future-dated", "expired", "too-old", "lifetime-too-long", "fresh"]


def test_splice(spark):
    rows = [(1, 1, "a", 1), (2, 1, "a", 2), (3, 1, "a", 4), (4, 1, "b", 1)]
    out = ledger.splices(spark.createDataFrame(rows, "id long, signer long, shard_id string, tree_size long")).orderBy("id").collect()
    assert [(r.prev_size, r.contiguous) for r in out] == [(None, False), (1, True), (2, False), (None, False)]


def test_trust_by_sweep_like_all_pairs(spark):
    """Touching, nested, empty and inverted windows, ties of moments with both bounds, nulls, one key of 10,000 windows."""
    r = random.Random(12)
    pick = lambda n: r.choice([None, *range(n)])
    w = [(r.choice(("a", "b", None)), r.choice(("x", "y", None)), pick(60), pick(60)) for _ in range(150)] + [("hot", "x", 10 * i, 10 * i + r.choice((0, 3, 10, 25))) for i in range(10_000)]
    q = [(i, r.choice(("a", "b", "c", None)), r.choice(("x", "y", None)), pick(62)) for i in range(600)] + [(1000 + i, "hot", "x", r.randrange(100_050)) for i in range(3000)]
    rows, windows = spark.createDataFrame(q, "id long, signer string, role string, ts long"), spark.createDataFrame(w, "signer string, role string, valid_from long, valid_until long")
    by = {}
    for s, o, a, b in w:
        by.setdefault((s, o), []).append((a, b))
    for closed in (False, True):
        inside = lambda t, a, b: a is not None and a <= t and (b is None or t < b or closed and t == b)  # noqa: E731, B023
        want = {i: s is not None and o is not None and t is not None and any(inside(t, a, b) for a, b in by.get((s, o), ())) for i, s, o, t in q}
        for width in (7, 1000, 10**9):
            out = ledger.trusted_at(rows, windows, closed=closed, width=width)
            assert {x.id: x.trusted for x in out.collect()} == want and out.columns == [*rows.columns, "trusted"]
    # No row for a pair of a moment and a window: what joins is one row a range.
    plan = ledger.trusted_at(rows, windows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "own_" in plan.split("Join")[1]
