"""Packages and ancestors: hand-computed cases, and both ways against brute force."""

import random

import numpy as np
import pytest

from feefloor.operators import packages as pk
from feefloor.operators.components import least_members

SCHEMA = "tx_hash string, block_number long, fee long, virtual_size long, parent_hashes array<string>"
# Own families, one to a block: (name, fee, size, parents) -> the rate all of it has.
FAMILIES = {
    7: ([("k0", 900, 300, ["gone"])], {"k0": 3.0}),
    8: ([("top", 0, 250, []), ("mid", 50, 150, ["top"]), ("low", 1150, 200, ["mid", "top"])],
        {"top": 2.0, "mid": 2.0, "low": 2.0}),
    9: ([("w", 60, 40, []), ("x", 45, 10, ["w"]), ("y", 45, 10, ["w"]), ("z", 10, 20, [])],
        {"w": 2.5, "x": 2.5, "y": 2.5, "z": 0.5}),
}
FIXTURE = [(name, block, fee, size, parents) for block, (rows, _) in FAMILIES.items()
           for name, fee, size, parents in rows]
RATES = {name: rate for _, rates in FAMILIES.values() for name, rate in rates.items()}


def run(spark, rows, **options):
    return {(r["block_number"], r["tx_hash"]): r for r in
            pk.packages(spark.createDataFrame(rows, SCHEMA), **options).collect()}


def brute(rows):
    """Closure by repeated union, one transaction at a time."""
    known = {(b, h): (f or 0, v or 0, set(p or [])) for h, b, f, v, p in rows}
    groups, up = {}, {}
    for key in known:
        groups[key] = {key}
    for (b, h), (_f, _v, parents) in known.items():
        for p in parents:
            if (b, p) in known:
                merged = groups[(b, h)] | groups[(b, p)]
                for m in merged:
                    groups[m] = merged

    def ancestors(key):
        found, todo = {key}, [key]
        while todo:
            b, h = todo.pop()
            for p in known[(b, h)][2]:
                if (b, p) in known and (b, p) not in found:
                    found.add((b, p))
                    todo.append((b, p))
        return found
    out = {}
    for key, members in groups.items():
        fee, size = sum(known[m][0] for m in members), sum(known[m][1] for m in members)
        up = ancestors(key)
        out[key] = (min(h for _b, h in members), len(members), fee, size,
                    fee / size if size else None, len(up), sum(known[m][1] for m in up))
    return out


def comparable(got):
    return {k: (r["package_id"], r["package_tx_count"], r["package_fee"], r["package_vsize"],
                r["effective_fee_rate"], r["ancestor_count"], r["ancestor_vsize"])
            for k, r in got.items()}


@pytest.mark.parametrize("limit", [pk.MAX_BLOCK_ROWS, 3, 1])
def test_fixture_rates(spark, limit):
    got = run(spark, FIXTURE, max_block_rows=limit)
    assert {h: r["effective_fee_rate"] for (_b, h), r in got.items()} == RATES
    assert got[(8, "top")]["package_id"] == "low" and got[(9, "y")]["package_id"] == "w"
    assert [got[(8, h)]["ancestor_vsize"] for h in ("top", "mid", "low")] == [250, 400, 600]


def test_missing_figures(spark):
    rows = [("a", 1, None, 0, None), ("b", 1, 5, None, ["a"]), ("c", 1, 5, 10, None)]
    got = run(spark, rows)
    assert got[(1, "a")]["effective_fee_rate"] is None
    assert got[(1, "a")]["package_fee"] == 5
    assert got[(1, "c")]["effective_fee_rate"] == 0.5


def random_block(rng, block, n, shape):
    names = [f"{rng.randrange(16**8):08x}{i}" for i in range(n)]
    rows = []
    for i, name in enumerate(names):
        if shape == "chain":
            parents = names[i - 1:i]
        elif shape == "star":
            parents = names[:1] if i else []
        elif shape == "many":
            parents = rng.sample(names[:i], min(i, rng.choice([0, 0, 1, 30])))
        else:
            parents = rng.sample(names[:i], min(i, rng.choice([0, 0, 1, 1, 2])))
        rows.append((name, block, rng.randrange(1000), rng.randrange(1, 500),
                     parents + (["elsewhere"] if rng.random() < 0.2 else [])))
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def random_rows():
    rng = random.Random(7)
    shapes = ["chain", "star", "many", "sparse"] * 3
    return [r for b, s in enumerate(shapes) for r in random_block(rng, b, 20 + 15 * b, s)]


def test_one_task_way_equals_brute_force(spark, random_rows):
    assert comparable(run(spark, random_rows)) == brute(random_rows)


def test_join_way_equals_brute_force(spark, random_rows):
    """Blocks of 60 rows and more take the join way, the rest the other."""
    assert comparable(run(spark, random_rows, max_block_rows=60)) == brute(random_rows)


def test_blocks_that_span_batches(spark, random_rows):
    """Tiny Arrow batches: a block ends in a later batch than it began in."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    try:
        assert comparable(run(spark, random_rows)) == brute(random_rows)
    finally:
        spark.conf.set(key, before)


def test_same_hash_in_two_blocks(spark):
    rows = [("a", 1, 10, 10, []), ("b", 1, 30, 10, ["a"]), ("a", 2, 50, 10, []),
            ("b", 2, 70, 10, ["a"])]
    for limit in (100, 1):
        got = run(spark, rows, max_block_rows=limit)
        assert got[(1, "a")]["effective_fee_rate"] == 2.0
        assert got[(2, "b")]["effective_fee_rate"] == 6.0


def test_long_chain_in_one_task():
    n = 5_000
    child, parent = np.arange(1, n), np.arange(n - 1)
    assert set(least_members(n, child, parent)) == {0}
    count, size = pk._ancestors(np.full(n, 10), np.zeros(n, int), child, parent)
    assert count.tolist() == list(range(1, n + 1)) and size[-1] == 10 * n


def test_a_malformed_cycle_ends():
    child, parent = np.array([0, 1, 2, 3]), np.array([1, 0, 1, 2])
    count, _size = pk._ancestors(np.full(4, 1), np.zeros(4, int), child, parent)
    assert count.tolist() == [2, 2, 3, 4]


def test_wide_family_counts():
    """One parent of 40 children, and one child of 40 parents."""
    child = np.concatenate([np.arange(1, 41), np.full(40, 41)])
    parent = np.concatenate([np.zeros(40, dtype=int), np.arange(1, 41)])
    count, _size = pk._ancestors(np.full(42, 1), np.zeros(42, int), child, parent)
    assert count[0] == 1 and set(count[1:41]) == {2} and count[41] == 42


@pytest.mark.parametrize("limit", [1000, 150, 20])
def test_large_families_are_counted_in_full(spark, limit):
    """Two random parents each: families far larger than any relay limit."""
    rng = random.Random(11)
    rows = [(f"{i:03d}", 5, 1, 1 + i, rng.sample([f"{j:03d}" for j in range(i)], min(i, 2)))
            for i in range(200)]
    rng.shuffle(rows)
    want = brute(rows)
    assert max(v[5] for v in want.values()) > 26
    assert comparable(run(spark, rows, max_block_rows=limit)) == want


def test_more_members_than_bit_columns(spark):
    rng = random.Random(12)
    rows = [r for b in range(6) for r in random_block(rng, b, 90, "many")]
    got = pk._ancestors.__globals__["BIT_COLUMNS"]
    try:
        pk.BIT_COLUMNS = 64
        n = 500
        child = np.array([i for i in range(1, n) for _ in range(2)])
        parent = np.array([rng.randrange(c) for c in child])
        unit = np.zeros(n, int)
        count, total = pk._ancestors(np.ones(n, int), unit, child, parent)
    finally:
        pk.BIT_COLUMNS = got
    known = [{0}]
    for i in range(1, n):
        known.append({i}.union(*(known[p] for p in parent[child == i])))
    assert count.tolist() == total.tolist() == [len(k) for k in known]
    assert comparable(run(spark, rows)) == brute(rows)


def test_a_chain_of_a_hundred_thousand(spark):
    """One package over the limit: exact, and no row for each of 5 thousand million pairs."""
    n = 100_000
    rows = spark.range(n).selectExpr(
        "format_string('%06d', id) AS tx_hash", "1L AS block_number", "2L AS fee",
        "id % 7 AS virtual_size",
        "IF(id = 0, array(), array(format_string('%06d', id - 1))) AS parent_hashes")
    got = pk.packages(rows, max_block_rows=20_000).selectExpr(
        "count(*) AS rows", "min(package_id) AS lo", "max(package_id) AS hi",
        "min(package_tx_count) AS members",
        "count_if(ancestor_count <> CAST(tx_hash AS LONG) + 1) AS wrong_counts",
        "count_if(ancestor_vsize <> 21 * (CAST(tx_hash AS LONG) DIV 7) + "
        "(CAST(tx_hash AS LONG) % 7) * (CAST(tx_hash AS LONG) % 7 + 1) DIV 2) AS wrong_sizes"
    ).first()
    assert tuple(got) == (n, "000000", "000000", n, 0, 0)


def test_ancestors_in_a_circle_end(spark):
    """Malformed rows: a circle of two with a tail, and one of single links."""
    members = [(1, h, 10) for h in "abcdefg"]
    edges = [(1, "a", "b"), (1, "b", "a"), (1, "c", "b"), (1, "d", "c"),
             (1, "e", "f"), (1, "f", "g"), (1, "g", "e")]
    got = {r["tx_hash"]: r["ancestor_count"] for r in pk.ancestor_sums(
        spark.createDataFrame(members, "block_number long, tx_hash string, virtual_size long"),
        spark.createDataFrame(edges, "block_number long, child string, parent string")).collect()}
    assert got == {"a": 2, "b": 2, "c": 3, "d": 4, "e": 3, "f": 3, "g": 3}
