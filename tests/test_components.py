"""Components against brute force: any slicing, any number of partitions."""

import random

import pytest

from feefloor.operators.components import component_roots

LINKS = "unit long, a long, b long"


def brute(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for unit, a, b in links:
        if a is not None and b is not None:
            a, b = find((unit, a)), find((unit, b))
            parent[max(a, b)] = min(a, b)
    return {x: find(x)[1] for x in list(parent)}


def chain(unit, n, rng):
    names = rng.sample(range(10 * n), n)
    return [(unit, a, b) for a, b in zip(names, names[1:])]


def some_links(seed=5):
    rng = random.Random(seed)
    links = chain(1, 60, rng) + [(2, 7, i) for i in range(50)] + [(3, 50, i) for i in range(50)]
    links += [(4, rng.randrange(90), rng.randrange(90)) for _ in range(70)]
    links += [(5, 1, 2), (5, 2, 1), (5, 3, 3), (2, 7, 7), (2, 99, 99), (2, 99, 99), (5, None, 4), (6, 9, 8)]
    links += [(7, i, i + 1) for i in range(40)] + [(7, 100 + i, 99 + i) for i in range(40, 1, -1)]
    return links


@pytest.fixture
def unmerged(spark):
    """Shuffles keep every partition they are given."""
    keys = ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")
    before = {k: spark.conf.get(k) for k in keys}
    spark.conf.set(keys[0], "false")
    yield lambda n: spark.conf.set(keys[1], str(n))
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("partitions,slice_links", [
    (1, 7), (2, 25), (8, 7), (8, 100_000), (211, 50)])
def test_any_partitions_and_slices(spark, unmerged, partitions, slice_links):
    unmerged(partitions)
    links = some_links()
    got = component_roots(spark.createDataFrame(links, LINKS), slice_links, 20)
    rows = [((r["unit"], r["v"]), r["root"]) for r in got.collect()]
    assert len(rows) == len(dict(rows)) and dict(rows) == brute(links)


def test_slices_of_one_link(spark):
    links = chain(1, 30, random.Random(9)) + [(2, 0, i) for i in range(1, 20)]
    got = component_roots(spark.createDataFrame(links, LINKS), 1, 20)
    assert {(r["unit"], r["v"]): r["root"] for r in got.collect()} == brute(links)


def test_a_bound_of_rounds_raises(spark):
    links = spark.createDataFrame(chain(1, 40, random.Random(3)), LINKS)
    with pytest.raises(RuntimeError, match="after 1 rounds"):
        component_roots(links, 2, 1)


def test_text_members_and_nothing(spark):
    links = spark.createDataFrame([(1, "é", "z"), (1, "z", "a"), (2, "z", "b")],
                                  "unit long, a string, b string")
    got = {(r["unit"], r["v"]): r["root"] for r in component_roots(links).collect()}
    assert got == {(1, "é"): "a", (1, "z"): "a", (1, "a"): "a", (2, "z"): "b", (2, "b"): "b"}
    assert component_roots(links.limit(0)).count() == 0


def test_work_tables_go(spark):
    import os

    from feefloor.session import shared_dir
    links = spark.createDataFrame(some_links(), LINKS)
    folder = shared_dir(spark)
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    component_roots(links, 20)
    assert len(set(os.listdir(folder)) - before) == 1  # the result
