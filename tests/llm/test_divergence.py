"""Source divergences against a plain version."""

import collections
import random
import re

import numpy as np
import pytest

from feefloor.llm import source_divergence as sd

DOCS = "text string, lang string, source string, term long, n string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs=3, top=200):
    docs, counts, groups = collections.Counter(), collections.Counter(), set()
    for text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = TERM.findall((text or "").translate(LOWER))
        docs.update((lang, w) for w in set(words))
        counts.update((lang, source, w) for w in words)
    out = set()
    for lang in {g for g, _ in groups}:
        kept = [w for (g, w), n in docs.items() if g == lang and n >= min_docs]
        names = sorted(s for g, s in groups if g == lang)
        total = {s: sum(counts[lang, s, w] for w in kept) for s in names}
        whole = sum(total.values())

        def p(n, of):
            return 1 + 10**9 * (n + 1) // (of + len(kept))

        share = {s: {w: p(counts[lang, s, w], total[s]) for w in kept} for s in names}
        own = {w: p(sum(counts[lang, s, w] for s in names), whole) for w in kept}
        for a in names:
            pairs = [(b, sum((share[a][w] - share[b][w])**2 // share[b][w] for w in kept))
                     for b in names if b != a]
            terms = [(w, (share[a][w] - own[w])**2 // own[w]) for w in kept
                     if counts[lang, a, w] and share[a][w] > own[w]]
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, a, part, item, value, i) for i, (item, value) in enumerate(items, 1)
                        if part == "pair" or i <= top}
    return out


def corpus(seed=2, n=160):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90)] + ["Éa", "été", "ÀB", "日本"]
    out = []
    for i in range(n):
        lang = rng.choice(["en", "en", "fr", None])
        source = rng.choice(["s1", "s1", "s1", "s2", "s10", None])
        text = " ".join(rng.choices(words, weights=range(1, len(words) + 1), k=rng.randrange(40)))
        out.append((rng.choice([text, text.upper(), text + " 9,x-y_Z"]), lang, source, i, "x"))
    out += [(None, "de", "only", 0, ""), ("", "de", "other", 0, ""), ("rare words", "it", "a", 0, "")]
    out += [("the Copy The copy", "en", "s2", 1, "x")] * 70
    return out


@pytest.mark.parametrize("spill,top", [(sd.SPILL, 200), (40, 7)])
def test_equals_the_plain_version(spark, spill, top):
    """Also with a spill every few documents."""
    rows = corpus()
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    got = [tuple(r) for r in sd.source_divergence(df, top=top, spill=spill).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, top=top)


def test_batches_that_cut_stripes(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "3")
    try:
        rows = corpus(n=40)
        got = sd.source_divergence(spark.createDataFrame(rows, DOCS).repartition(4), spill=30)
        assert {tuple(r) for r in got.collect()} == brute(rows)
    finally:
        spark.conf.set(key, before)


def test_empty_table_and_long_text(spark):
    df = spark.createDataFrame([("a", "en", "s", 1, "")], DOCS)
    assert sd.source_divergence(df.limit(0)).count() == 0
    assert sd.source_divergence(df).count() == 0  # a lone source without kept terms
    text = "word " * 300_000 + "x" * 2_000_000 + " end"
    pieces = list(sd._pieces(text))
    assert len(pieces) > 1 and sum(map(len, pieces)) == 300_002


def test_shares_are_exact_for_huge_counts():
    total = np.array([9 * 10**15 - 1, 7, 10**12 + 3])
    for n in (0, 1, 6, 10**9 + 7):
        n = np.minimum(n, total)
        assert sd.share(n, total).tolist() == [1 + 10**9 * int(a) // int(b)
                                               for a, b in zip(n, total)]
    assert sd.share(total, total).tolist() == [10**9 + 1] * 3
