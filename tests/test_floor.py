"""Percentiles, neighbour floors and fullness."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from feefloor.operators import floor
from feefloor.policy import Policy

TXS = "block_number long, is_coinbase boolean, effective_fee_rate double, is_nonrelayable boolean"


def interpolated(values, q):
    return float(np.quantile(values, q)) if values else None


@pytest.fixture(scope="module")
def rates():
    """Blocks with ties, one value, none relayable, zeros, and a third of all rows."""
    rng = random.Random(3)
    rows = [(1, False, 2.0, False)] * 50 + [(2, False, 7.5, True), (3, False, 4.0, False)]
    rows += [(4, False, 0.0, False), (4, False, 0.0, True), (4, False, 1e-9, False),
             (4, False, 5e4, False), (4, True, 9.0, False), (4, False, None, False)]
    for block in range(5, 25):
        rows += [(block, False, rng.choice([rng.uniform(0, 3), rng.randrange(1, 90) / 7]),
                  rng.random() < 0.2) for _ in range(rng.randrange(1, 120))]
    rows += [(99, False, rng.randrange(1, 10**6) / 997, rng.random() < 0.1)
             for _ in range(1500)]
    return rows


def test_percentiles(spark, rates):
    df = spark.createDataFrame(rates, TXS)
    got = {r["block_number"]: r for r in
           floor.block_percentiles(df).collect()}
    want = {}
    for b in {r[0] for r in rates}:
        priced = [(r[2], r[3]) for r in rates if r[0] == b and not r[1] and r[2] is not None]
        rel = [v for v, bad in priced if not bad]
        every = [v for v, _ in priced]
        want[b] = (interpolated(rel, .05), interpolated(every, .05), interpolated(rel, .5),
                   len(every))
    assert set(got) == set(want)
    for b, (p05, p05_all, p50, n) in want.items():
        r = got[b]
        assert r["priced_tx_count"] == n
        for mine, theirs in ((r["p05_fee_rate"], p05), (r["p05_all"], p05_all),
                             (r["median_fee_rate"], p50)):
            assert mine == (None if theirs is None else pytest.approx(theirs, rel=1e-12))


def test_floor_needs_all_six_neighbours(spark):
    rows = [(n, float(n)) for n in range(1, 12) if n != 9] + [(20, None)]
    df = spark.createDataFrame(rows, "block_number long, p05_fee_rate double")
    got = {r[0]: r[1] for r in floor.neighbour_floor(df).collect()}
    # 4..5 have six neighbours; 6..12 miss 9, 1..3 miss the start.
    assert got == {n: (float(n) if n in (4, 5) else None) for n, _ in rows}


def test_a_neighbour_without_a_percentile_leaves_no_floor(spark):
    df = spark.createDataFrame([(n, None if n == 5 else 1.0) for n in range(1, 12)],
                               "block_number long, p05_fee_rate double")
    got = {r[0]: r[1] for r in floor.neighbour_floor(df).collect()}
    assert got[4] is None and got[5] == 1.0 and got[8] is None


def test_own_block_never_moves_its_floor(spark):
    df = spark.createDataFrame([(n, 1000.0 if n == 4 else float(n)) for n in range(1, 8)],
                               "block_number long, p05_fee_rate double")
    got = {r[0]: r[1] for r in floor.neighbour_floor(df).collect()}
    assert got[4] == 4.0  # median of 1 2 3 5 6 7


def test_fullness(spark):
    heavy = {1, 2, 3, 4, 5, 8}
    rows = [(n, 3_900_000 if n in heavy else 3_899_999) for n in range(1, 9)] + [(50, None)]
    df = spark.createDataFrame(rows, "block_number long, weight long")
    got = {r["block_number"]: r for r in floor.block_fullness(df).collect()}
    for n, weight in rows:
        if weight is None:
            assert got[n]["weight_full"] is None and got[n]["full_neighbours"] == 0
            continue
        near = sum(n + o in heavy for o in Policy.neighbour_offsets)
        assert got[n]["weight_full"] == (n in heavy)
        assert got[n]["full_neighbours"] == near
        assert got[n]["is_full"] == (n in heavy and near >= 4)


def test_update_keeps_blocks_without_percentiles(spark):
    blocks = spark.createDataFrame([(1,), (2,)], "block_number long")
    pct = spark.createDataFrame([(1, 1.5, 2.5)],
                                "block_number long, p05_fee_rate double, median_fee_rate double")
    got = {r["block_number"]: tuple(r)[1:] for r in floor.apply_block_floor(
        blocks, pct).select("block_number", "floor_fee_rate", "p05_fee_rate",
                            "median_fee_rate").collect()}
    assert got == {1: (None, 1.5, 2.5), 2: (None, None, None)}


def test_neighbour_join_keeps_gaps(spark):
    df = spark.createDataFrame([(1, "a"), (3, "b")], "block_number long, v string")
    got = {(r["block_number"], r["offset"]): r["v"]
           for r in floor.neighbour_join(df, df, (-2, 1, 2)).collect()}
    assert got == {(1, -2): None, (1, 1): None, (1, 2): "b",
                   (3, -2): "a", (3, 1): None, (3, 2): None}
    assert df.select(F.lit(1)).count() == 2
