"""Joins, repeats, leaks and the pipeline against brute force."""

import collections
import hashlib
import random

import numpy as np
import pytest

from feefloor.llm import decontaminate, jaccard_join, suffix_dedup
from tests.llm import brute

DOCS = "doc_id long, text string, sig string, key string, component_id string"


def corpus(seed=3, groups=12):
    """Texts with exact and near copies, shared passages, short and odd ones."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(vocabulary, k=70))
    texts = [None, "", " \n", "a", "A", "a b", "a b c d", "a b c d e", "a b c d e", "ünï cödé x"]
    for g in range(groups):
        base = rng.choices(vocabulary, k=rng.choice([6, 9, 14, 40, 120, 300]))
        for _ in range(rng.choice([1, 2, 5, 30])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w) + (" " + passage if g % 3 == 0 else ""))
    texts += ["spam " * 500, "x" * 3000, "x" * 2900]
    rng.shuffle(texts)
    return [(i, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "s", "k", "c") for r in rows], DOCS).repartition(3).cache()


@pytest.mark.parametrize("short", [24, 2])
def test_components(docs, rows, short):
    """Also with every list of more than two sets taken as a long one."""
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"])
           for r in jaccard_join.components(docs, short).collect()}
    assert got == brute.components(rows)


def test_components_over_unmerged_partitions(spark, monkeypatch):
    """A chain of near copies, each linked with the next alone, dealt over many tasks and
    joined in slices of a few links."""
    from feefloor.operators import components

    monkeypatch.setattr(components.component_roots, "__defaults__", (5, 20))
    rng = random.Random(8)
    words = [f"w{i}" for i in range(40)]
    rows = [(0, " ".join(words))]
    for i in range(1, 14):
        words[3 * i % 40] = f"new{i}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join(rng.choices("abcdefgh", k=9))) for i in range(12)]
    rng.shuffle(rows)
    keys = ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")
    before = {k: spark.conf.get(k) for k in keys}
    spark.conf.set(keys[0], "false")
    spark.conf.set(keys[1], "8")
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"])
               for r in jaccard_join.components(df).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == brute.components(rows)


def test_joins_of_nothing_and_of_repeated_rows(spark, docs):
    assert jaccard_join.components(docs.limit(0)).count() == 0
    twice = spark.createDataFrame(
        [(5, "a b c d e f"), (5, "a b c d e f"), (5, "other words entirely here now"),
         (None, "a b c d e f"), (9, ""), (9, "")], "doc_id long, text string")
    got = sorted(map(tuple, jaccard_join.components(twice).collect()), key=repr)
    assert got == sorted([(5, 2, 5), (5, 2, 5), (5, 1, 5), (None, 2, 5), (9, 0, 9), (9, 0, 9)],
                         key=repr)
    # One of the linked rows, the unlinked one, and both empty ones stay.
    kept = jaccard_join.one_of_each(twice).collect()
    assert collections.Counter(r["text"] for r in kept) == {
        "a b c d e f": 1, "other words entirely here now": 1, "": 2}


def test_one_of_each_component_stays(docs, rows):
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    want = {d for d, (n, c) in brute.components(rows).items() if d == c or not n}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want)


def test_light_sets_need_no_verification():
    for n in range(1, 17):
        for m in jaccard_join.partners(n, 16):
            t = jaccard_join.least_overlap(n, m)
            assert 4 * t >= 3 * (n + m - t) and 4 * (t - 1) < 3 * (n + m - t + 1)


def test_roots_of_chains(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(200)] + [
        (300 + rng.randrange(500), 300 + rng.randrange(500)) for _ in range(250)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["sig"]: r["root"] for r in jaccard_join.roots(
        spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(parent)}


# --- repeats -------------------------------------------------------------------

@pytest.mark.parametrize("keep_first,most", [(False, 4000), (True, 4000), (False, 2), (True, 2)])
def test_repeats(docs, rows, keep_first, most):
    got = {r["doc_id"]: r for r in suffix_dedup.suffix_dedup(
        docs, keep_first, most=most).collect()}
    for doc, (size, removed, runs, left) in brute.repeats(rows, keep_first=keep_first).items():
        r = got[doc]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (size, removed, runs), doc
        assert bytes(r["kept"]) == left
        assert r["kept_sha256"] == hashlib.sha256(left).hexdigest()


@pytest.mark.parametrize("keep_first,most", [(False, 4000), (True, 4000), (False, 2)])
def test_repeats_of_rows_without_id_and_with_huge_ids(spark, keep_first, most):
    """A null id beside ids that a float cannot hold: no row is taken for another."""
    text = " ".join(f"part{i}" for i in range(60))
    size = len(text)
    rows = [(None, "short"), (2**53 + 1, text), (2**53 + 2, "x " + text), (None, text),
            (None, text), (2**63 - 1, "y" + text), (None, "z" * 150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in
                  suffix_dedup.suffix_dedup(df, keep_first, most=most).collect()), key=repr)
    kept = 0 if keep_first else size  # rows without id come first and count as one
    assert got == sorted([(None, 5, 0), (None, 150, 0), (None, size, kept), (None, size, kept),
                          (2**53 + 1, size, size), (2**53 + 2, size + 2, size),
                          (2**63 - 1, size + 1, size)], key=repr)


def test_repeats_of_equal_rows_and_of_nothing(spark, docs):
    assert suffix_dedup.suffix_dedup(docs.limit(0)).count() == 0
    text = " ".join(f"word{i}" for i in range(60))
    df = spark.createDataFrame([(1, text), (1, text), (2, text), (3, None)],
                               "doc_id long, text string")
    for keep_first in (False, True):
        got = sorted((r["doc_id"], r["n_removed"]) for r in
                     suffix_dedup.suffix_dedup(df, keep_first).collect())
        kept = 0 if keep_first else len(text)
        assert got == [(1, kept), (1, kept), (2, len(text)), (3, 0)]


def test_longest_factors():
    """Lengths of longest earlier and later matches, for all places of small texts."""
    rng = np.random.default_rng(6)
    for size, letters in ((1, 2), (30, 2), (60, 3), (200, 2)):
        data = rng.integers(97, 97 + letters, size).astype(np.uint8)
        text = data.tobytes()

        def common(i, j):
            n = 0
            while n < 20 and max(i, j) + n < size and text[i + n] == text[j + n]:
                n += 1
            return n

        before, after = suffix_dedup.longest_factors(data, 20)
        for i in range(size - 20):  # beyond these the end of the text cuts suffixes short
            assert before[i] == max((common(i, j) for j in range(i)), default=0)
            assert after[i] == max((common(i, j) for j in range(i + 1, size)), default=0)


def test_no_window_runs_from_one_part_into_the_next():
    parts = [b"q" * 150 + b" ", b"spam " * 60]
    first, second = suffix_dedup.repeated_windows(parts, 200, True)
    assert not len(first) and list(second) == list(range(5, 101))


# --- leaks ---------------------------------------------------------------------------

@pytest.fixture(scope="module")
def exam():
    rng = random.Random(8)
    vocabulary = [f"q{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([20, 40, 41]))))
             for i in range(12)]
    items += [(50, "too short"), (51, None), (52, "")]
    docs = [(0, None), (1, ""), (2, "q1 q2")]
    for d in range(60):
        w = rng.choices([f"v{i}" for i in range(300)], k=rng.choice([0, 30, 200]))
        leak = items[d % 12][1].split()
        for _ in range(d % 4):
            leak[rng.randrange(len(leak))] = "changed"
        at = rng.randrange(len(w) + 1)
        docs.append((10 + d, " ".join(w[:at] + leak[:len(leak) - d % 7] + w[at:])))
    return docs, items


@pytest.mark.parametrize("portion", [20_000, 6])
def test_leaks(spark, exam, portion):
    docs, items = exam
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.decontaminate(df, benchmark, portion).collect()
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in found}
    want = brute.leaks(docs, items)
    assert len(found) == len(got) and got == pytest.approx(want) and len(want) > 10
    texts = dict(docs)
    for r in found:
        assert len(brute.words(texts[r["doc_id"]][r["start"]:r["end"]])) <= 41
    kept = decontaminate.without_matches(df, benchmark, portion)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_no_items_and_no_documents(spark, exam):
    docs, items = exam
    df = spark.createDataFrame(docs, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.decontaminate(df, benchmark.limit(0)).count() == 0
    assert decontaminate.decontaminate(df.limit(0), benchmark).count() == 0


def test_blocks_miss_no_fingerprint_within_the_radius():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 256, (2000, 8)).astype(np.uint8)
    b = a.copy()
    for row in b:
        for bit in rng.choice(64, decontaminate.RADIUS, replace=False):
            row[bit // 8] ^= 1 << (bit % 8)
    near = decontaminate._NEAR[a, b]
    assert near.any(axis=1).all()


def test_no_group_takes_all_stretches_or_a_common_gram(spark):
    """Copies within a batch are in no group; a common gram is met in many buckets."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(900)]
    middle = " ".join(rng.choices(words, k=40))
    texts = [" ".join([*rng.choices(words, k=40), middle, *rng.choices(words, k=40)])
             for _ in range(300)]
    texts += [" ".join(rng.choices(words, k=90))] * 50
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr(
        "doc_id", "text", "hash(text) AS key").coalesce(1)
    posted = suffix_dedup.entries(df, 8, False, 100).cache()
    assert posted.where("bucket < 0").count() == 0
    common = suffix_dedup.common_grams(posted, 100)
    assert len(common)
    filed = suffix_dedup.routed(posted, common, 8).collect()
    shares = [sum(np.isin(np.frombuffer(r["entries"], suffix_dedup._ENTRY)["gram"], common))
              for r in filed]
    assert sum(shares) >= 300 and max(shares) < sum(shares) / 3
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept"])
           for r in suffix_dedup.suffix_dedup(df, False, most=100).collect()}
    assert got == brute.repeats(list(enumerate(texts)), keep_first=False)


@pytest.mark.parametrize("keep_first", [False, True])
def test_windows_of_common_grams_are_counted_where_they_are_read(spark, keep_first):
    """Equal windows of a batch send one entry; results are those of each counted alone."""
    rng = random.Random(5)
    base = "".join(rng.choices("abcdefgh", k=330)).encode()
    rows = []
    for doc in range(400):
        data = bytearray(base)
        if doc % 4 == 1:
            data[rng.randrange(330)] = 122
        rows.append((doc, 7, 100 + doc, bytes(data)))
        if doc % 5 == 0:  # two surroundings of a text share windows
            rows.append((doc, 7, 110 + doc, bytes(data[10:])))
    wide = spark.createDataFrame(rows, "doc_id long, key int, begin int, bytes binary")
    held = suffix_dedup.windows_of([r.asDict() for r in wide.collect()])
    assert len(held) == 400 * 131 and len(np.unique(held[["doc", "key", "begin"]])) == len(held)
    order, first, _ = suffix_dedup._alike(held, keep_first)
    assert len(first) < len(held) / 4
    places = {}
    for doc, _, begin, data in rows:
        for at in range(len(data) - 199):
            places.setdefault(data[at:at + 200], set()).add((doc, begin + at))
    want = set()
    for at in places.values():
        if len(at) > 1:
            for doc, begin in at - ({min(at)} if keep_first else set()):
                want |= {(doc, begin + k) for k in range(200)}
    for parts in (1, 6):
        got = suffix_dedup.counted_windows(wide.repartition(parts), keep_first, 5).collect()
        assert {(r["doc_id"], k) for r in got for k in range(r["begin"], r["end"])} == want
        assert len(got) < len(rows) * 2 * parts  # not a row for each window
