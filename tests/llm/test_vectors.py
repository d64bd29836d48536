"""Hard negatives and nearest neighbours against plain versions."""

import math
import random

import numpy as np
import pytest

from feefloor.llm import hard_negatives as hn
from feefloor.llm import permutation_index as pi

ROWS = "vec_id long, embedding array<float>, label int, id string, at long"


def vectors(n=260, dims=9, seed=4):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(5)]
    out = []
    for i in range(n):
        c = rng.choice(centres)
        out.append((i, [float(np.float32(x + rng.gauss(0, 0.7))) for x in c], rng.randrange(4)))
    same = [0.5] * dims
    out += [(i, same, i % 3) for i in range(n, n + 60)]  # ties beyond every list
    out += [(1000, None, 1), (1050, [1.0, None, 2.0], 1), (1100, [float("nan")] * dims, 1),
            (1150, [float("inf")] * dims, 1), (None, same, 1), (1200, [0.0] * dims, None),
            (1250, [], 1), (1300, [1.5, -2.0], 2), (1350, [0.0] * dims, 2),
            (50, same, 0), (50, same, 0), (1400, [float(np.float32(1e30)), -float(np.float32(1e30))] + [0.0] * (dims - 2), 1)]
    rng.shuffle(out)
    return out


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(*r, "x", 7) for r in rows], ROWS).repartition(parts)


def usable(rows, label=True):
    out = []
    for i, v, l in rows:
        if i is None or v is None or (label and l is None) or any(
                x is None or not math.isfinite(x) for x in v):
            continue
        out.append((i, v, l))
    return out


def brute_negatives(rows):
    rows = [(i, [math.floor(256 * x) for x in v], (l + 1) % 10 if i % 7 == 0 else l)
            for i, v, l in usable(rows)]
    out = []
    for a, (i, v, l) in enumerate(rows):
        if i % 50:
            continue
        scored = sorted((-max(min(sum(x * y for x, y in zip(v, w)), 2**63 - 1), -2**63), j, m)
                        for b, (j, w, m) in enumerate(rows) if b != a)
        for ps, pid, _ in [s for s in scored if s[2] == l][:5]:
            ok = [(s, j) for s, j, m in scored if m != l and 50 * -ps <= 100 * -s <= 95 * -ps]
            out += [(i, pid, r, j, -ps, -s) for r, (s, j) in enumerate(ok[:3], 1)]
    return sorted(out)


@pytest.mark.parametrize("block,anchors", [(hn.BLOCK, hn.ANCHORS), (40, 3)])
def test_hard_negatives(spark, monkeypatch, block, anchors):
    """Also with many small blocks."""
    monkeypatch.setattr(hn, "BLOCK", block)
    monkeypatch.setattr(hn, "ANCHORS", anchors)
    rows = vectors()
    got = sorted(tuple(r) for r in hn.hard_negatives(frame(spark, rows)).collect())
    assert got == brute_negatives(rows) and len({g[0] for g in got}) > 5


def test_no_rows_and_no_anchors(spark):
    df = frame(spark, vectors())
    assert hn.hard_negatives(df.limit(0)).count() == 0
    assert hn.hard_negatives(df.where("vec_id % 50 <> 0")).count() == 0


def test_scores_are_exact():
    rng = np.random.default_rng(1)
    for top in (3, 200, 10**5, 2**40):
        a = rng.integers(-top, top + 1, (7, 130)).astype(float)
        b = rng.integers(-top, top + 1, (11, 97)).astype(float)
        want = [[max(min(sum(int(x) * int(y) for x, y in zip(r, s)), 2**63 - 1), -2**63)
                 for s in b] for r in a]
        assert hn.scores(a, b).tolist() == want
    assert len(hn.primes(5)) == 5 and hn.primes(2) == [1021, 1019]
    assert hn.CHUNK * 510**2 < 2**24


def test_residues_of_every_number():
    used = hn.primes_for(5000)
    x = np.arange(-5000, 5001)
    assert (hn.reconstruct([x % p for p in used], used) == x).all()


# --- nearest neighbours ------------------------------------------------------------

def brute_nearest(rows, k=10):
    """{query id: [(id, distance)]}; rows are told apart by their place."""
    rows = [(i, v) for i, v, _ in usable(rows, label=False) if any(v)]
    width = max(len(v) for _, v in rows)
    table = np.array([v + [0.0] * (width - len(v)) for _, v in rows])
    out = {}
    for a, (i, _) in enumerate(rows):
        if i % 100 == 0:
            d = np.sqrt(((table - table[a]) ** 2).sum(axis=1))
            near = sorted((d[b], j) for b, (j, _) in enumerate(rows) if b != a)[:k]
            out.setdefault(i, []).extend((j, x) for x, j in near)
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"], r["rank"]))
    return out


def test_small_tables_are_searched_whole(spark):
    """With no more pivots than a query visits, every list is; ties go by id."""
    rows = [r for r in vectors(n=101) if r[0] != 50]
    got, want = found(pi.nearest(frame(spark, rows), share=1.0)), brute_nearest(rows)
    assert set(got) == set(want)
    for q, near in want.items():
        assert [i for i, _, _ in got[q]] == [i for i, _ in near], q
        assert [r for _, _, r in got[q]] == list(range(1, len(near) + 1))
        assert np.allclose([s for _, s, _ in got[q]], [s for _, s in near], rtol=1e-12)


def test_fewer_rows_than_asked_for(spark):
    rows = [(100, [1.0, 0.0], 1), (7, [0.0, 1.0], 1), (8, [0.0, 1.0], 1), (9, [0.0, 0.0], 1),
            (10, [], 1), (11, None, 1), (200, [None], 1)]
    got = found(pi.nearest(frame(spark, rows)))
    assert {q: [i for i, _, _ in near] for q, near in got.items()} == {100: [7, 8]}
    assert got[100][0][1] == math.sqrt(2)
    assert pi.nearest(frame(spark, rows).limit(0)).count() == 0
    assert pi.nearest(frame(spark, [(100, [1.0], 0)])).count() == 0


def test_repeated_vectors_and_ids(spark):
    """A vector of many rows is one posting; a query finds its equals, least ids first."""
    rng = random.Random(1)
    rows = [(i, [1.0, 2.0, 3.0], 0) for i in range(0, 600, 2)]
    rows += [(i, [rng.gauss(0, 1) for _ in range(3)], 0) for i in range(1, 600, 2)]
    rows += [(300, [9.0, 9.0, 9.0], 0), (300, [9.0, 9.0, 9.5], 0)]
    got = found(pi.nearest(frame(spark, rows)))
    for q in (100, 200, 500):
        assert [i for i, s, _ in got[q] if s == 0] == [
            i for i in range(0, 24, 2) if i != q][:10]
    assert len(got[300]) == 30  # three rows of that id
    assert (300, 0.5, 1) in got[300]


@pytest.mark.parametrize("block,asked", [(pi.BLOCK, pi.ASKED), (300, 4)])
def test_recall(spark, monkeypatch, block, asked):
    """Random directions, where no index is at its best: 0.9 of the true neighbours."""
    monkeypatch.setattr(pi, "BLOCK", block)
    monkeypatch.setattr(pi, "ASKED", asked)
    rng = np.random.default_rng(5)
    table = rng.normal(size=(3000, 48))
    rows = [(i, (v / np.linalg.norm(v)).tolist(), 0) for i, v in enumerate(table)]
    rows = [(i, [float(np.float32(x)) for x in v], 0) for i, v, _ in rows]
    got, want = found(pi.nearest(frame(spark, rows))), brute_nearest(rows)
    hits = sum(len({i for i, _, _ in got[q]} & {i for i, _ in near}) for q, near in want.items())
    assert all(len(near) == 10 for near in got.values())
    assert hits >= 0.9 * 10 * len(want)


def test_footrule():
    """Positions of pivots beyond the prefix count as its length."""
    rng = np.random.default_rng(2)
    perm = np.array([rng.permutation(20) for _ in range(30)])
    q, prefix = perm[0], perm[:, :6].astype(np.int64)
    flat = prefix * 6 + np.arange(6)
    got = pi.footrule(flat, q, 6)

    def brute(x):
        x, y = list(x[:6]), list(q[:6])
        return sum(abs((x.index(p) if p in x else 6) - (y.index(p) if p in y else 6))
                   for p in {*x, *y})
    assert got.tolist() == [brute(x) for x in perm]
