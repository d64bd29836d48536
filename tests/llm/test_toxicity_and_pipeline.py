"""Toxicity by held-out labels and brute-force segments; the stages in order."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from feefloor.llm import common, toxicity as tox
from tests.llm import brute

DOCS = "doc_id long, text string, score string, passages string"


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(9)
    plain, bad = [f"n{i}" for i in range(300)], ["vile", "rotter", "grimling", "grimlock"]
    docs, labels = [], []
    for d in range(900):
        w = rng.choices(plain, k=rng.choice([5, 40, 150]))
        toxic = rng.random() < 0.15
        if toxic:
            for _ in range(rng.choice([2, 3, 6])):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        docs.append((d, " ".join(w), "s", "p"))
        if d % 10:
            labels.append((d, 1, int(toxic)))
    docs += [(2000, None, "s", "p"), (2001, "", "s", "p"), (5, docs[5][1], "s", "p")]
    labels += [(5, 1, labels[4][2]), (77777, 1, 1), (6, 1, None)]
    return (spark.createDataFrame(docs, DOCS).repartition(3).cache(),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_held_out_labels(tables):
    docs, labels = tables
    model = tox.fit(docs, labels)
    got = tox.score(docs, model)
    assert {"doc_id", "text", "score", "predicted", "passages"} <= set(got.columns)
    rows = {r["doc_id"]: r for r in got.collect()}
    assert got.count() == 903 and all(0 <= r["score"] <= 1 for r in rows.values())
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["doc_id"] in rows}
    out = [(truth[d], rows[d]["predicted"]) for d in truth
           if truth[d] is not None and zlib.crc32(str(d).encode()) % 3 == 1]
    assert sum(t == p for t, p in out) / len(out) > 0.97
    assert rows[2000]["predicted"] == rows[2001]["predicted"] == 0
    text = next(r for r in rows.values() if r["n_passages"])
    part = text["passages"][0]
    assert any(b in text["text"][part["start"]:part["end"]] for b in ("vile", "rotter", "griml"))


def test_no_labels_and_no_documents(spark, tables):
    docs, labels = tables
    for some in (labels.limit(0), labels.where("toxic = 0"), labels.where("toxic = 1")):
        scores = {r["score"] for r in tox.score(docs, tox.fit(docs, some)).collect()}
        assert len(scores) == 1
    model = tox.fit(docs.limit(0), labels)
    assert tox.score(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_maximal_segments(seed):
    """Best segment first, then the best of what lies left and right of it."""
    rng = random.Random(seed)
    scores = [rng.choice([-3, -2, -1, 1, 2, 3]) for _ in range(rng.randrange(1, 40))]

    def split(low, high):
        best = None
        for i in range(low, high):
            total = 0
            for j in range(i, high):
                total += scores[j]
                # of equal ones the shortest, as zero-sum ends add nothing
                if total > 0 and (best is None or total > best[0]
                                  or total == best[0] and j - i < best[2] - best[1]):
                    best = (total, i, j)
        if best is None:
            return []
        return split(low, best[1]) + [best] + split(best[2] + 1, high)

    values = np.array(scores, float)
    total = np.cumsum(values)
    own = np.flatnonzero(values > 0)
    got = tox.maximal_segments(total[own] - values[own], total[own])
    want = split(0, len(scores))
    assert sum(s for *_, s in got) == sum(s for s, *_ in want)
    assert [s for *_, s in got] == [s for s, *_ in want]


def known_words(*words, lam=1.0, k=1.0):
    """A model in which each of ``words`` scores 5."""
    hashes = np.sort(next(h for _, h in tox.tokens(*_words([" ".join(words)]))))
    return tox.Model(hashes, np.full(len(hashes), 5.0), np.full(len(hashes), 9.0), lam=lam,
                     passage_lam=lam, k=k, passage_k=k)


def test_a_word_counts_once_as_evidence():
    texts = pa.array(["bad bad bad", None, "bad"])
    found = list(tox.passages(texts, known_words("bad")))
    assert [n for n, *_ in found] == [3, 0, 1]
    assert found[0][2] == [pytest.approx(5 - tox.DRIFT)] == found[2][2]
    # but every time as a passage
    assert found[0][1] == [(0, 11, pytest.approx(3 * (5 - tox.PASSAGE_DRIFT)))]
    assert not found[1][1] and not found[1][2]


def plain_passages(text, bad, model):
    """(start, end) of the significant passages of an ASCII text, by trying all stretches."""
    words = text.split(" ")
    scores = [(5 if w in bad else 0) - tox.PASSAGE_DRIFT for w in words]
    starts = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])])

    def split(low, high):
        best = None
        for i in range(low, high):
            total = 0
            for j in range(i, high):
                total += scores[j]
                if total > 0 and (best is None or total > best[0] + 1e-9):
                    best = (total, i, j)
        if best is None:
            return []
        return split(low, best[1]) + [best] + split(best[2] + 1, high)

    return [(int(starts[i]), int(starts[j]) + len(words[j])) for s, i, j in split(0, len(words))
            if model.passage_k * len(words) * np.exp(-model.passage_lam * s) <= tox.MAX_E]


@pytest.mark.parametrize("seed", range(4))
def test_every_significant_passage(spark, seed):
    """Also one whose words the text has used up before, alone or in another passage."""
    rng = random.Random(seed)
    bad = ["vile", "rotter", "grim"]
    plain = [f"n{i}" for i in range(50)]

    def other(n):
        return " ".join(rng.choices(plain, k=n))

    twice = f"{' '.join(bad)} {other(400)} {' '.join(bad)} {other(400)} {' '.join(bad)}"
    late = f"vile {other(60)} rotter {other(60)} grim {other(60)} {' '.join(bad)}"
    mixed = " ".join(rng.choices(plain + bad * rng.choice([1, 4, 9]), k=150))
    model = known_words(*bad, lam=0.9)
    texts = [twice, late, mixed, None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_passages"], [(p["start"], p["end"]) for p in r["passages"]])
           for r in tox.score(df, model).collect()}
    for i, text in enumerate(texts):
        want = plain_passages(text, bad, model) if text else []
        assert got[i] == (len(want), want)
    assert got[0][0] == 3 and got[1][0] == 1


def _words(texts):
    from feefloor.llm.common import raw, word_spans

    data, offsets = raw(pa.array(texts))
    return (data, *word_spans(data, offsets, tox._LETTERS)[:2])


def test_stages(spark, tmp_path):
    """Every stage against brute force on what it was given."""
    rng = random.Random(10)
    plain = [f"n{i}" for i in range(500)]
    items = [(i, " ".join(rng.choices([f"q{j}" for j in range(200)], k=30))) for i in range(3)]
    docs, labels = [], []
    for d in range(300):
        w = rng.choices(plain, k=60)
        if d % 7 == 0:
            w[10:10] = ["vile", "grimlock", "rotter"]
        if d % 11 == 0:
            w[20:20] = items[d % 3][1].split()
        if d % 13 == 0:
            w += ["password=abcdefgh123"]
        docs.append((d, " ".join(w), "en", "src", 1))
        labels.append((d, 1, int(d % 7 == 0)))
    docs += [(1000 + d, docs[d][1] + " tail", "en", "src", 1) for d in range(1, 40)]
    docs += [(2000, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    folder = str(tmp_path)
    spark.createDataFrame(docs, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(
        f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(
        f"{folder}/benchmark.parquet")

    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "jaccard_join", "decontaminate", "secret_scan",
                            "bestfit_packing"]
    start = spark.read.parquet(f"{folder}/documents.parquet")
    clean = stages["toxicity"](spark, start, folder)
    assert clean.columns == start.columns
    kept = {r["doc_id"]: r["text"] for r in clean.collect()}
    toxic = {d for d, t, *_ in docs if t and "vile" in t}
    assert not toxic & set(kept) and set(kept) == {d for d, *_ in docs} - toxic

    one = stages["jaccard_join"](spark, clean, folder)
    groups = brute.components(sorted(kept.items()))
    want = {d for d, (n, c) in groups.items() if d == c or not n}
    assert {r["doc_id"] for r in one.collect()} == want and one.columns == start.columns

    exam = stages["decontaminate"](spark, one, folder)
    leaks = {d for d, _ in brute.leaks([(d, kept[d]) for d in want], items)}
    assert leaks and {r["doc_id"] for r in exam.collect()} == want - leaks

    masked = stages["secret_scan"](spark, exam, folder)
    assert masked.columns == start.columns
    for r in masked.collect():
        if r["text"] is not None:
            assert "abcdefgh123" not in r["text"]
            assert r["text"].replace("[assign]", "password=abcdefgh123") == kept[r["doc_id"]]

    packed = stages["bestfit_packing"](spark, masked, folder)
    assert {r["doc_id"] for r in packed.collect()} == want - leaks
    assert corpus_pipeline.run(spark, folder).count() == packed.count()


@pytest.mark.parametrize("stage", [run for _name, run in corpus_pipeline.STAGES],
                         ids=[name for name, _run in corpus_pipeline.STAGES])
def test_texts_reach_workers_in_small_batches(spark, tmp_path, stage):
    """40 MB of texts in one partition are no single batch, whichever stage reads them."""
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "bytes"])

    folder = str(tmp_path)
    schema = "doc_id long, text string"
    spark.createDataFrame([(1, "some words of one text")], schema).write.parquet(
        f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(
        f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "an item that no text holds")], "item_id long, text string"
                          ).write.parquet(f"{folder}/benchmark.parquet")
    before = {key: spark.conf.get(key) for key in corpus_pipeline.SMALL_BATCHES}
    try:
        stage(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
        long = spark.range(400, numPartitions=1).selectExpr("repeat('word ', 20000) AS text")
        found = long.mapInArrow(sizes, "n long, bytes long").collect()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert sum(row["n"] for row in found) == 400
    assert max(row["bytes"] for row in found) < 10 << 20


def test_a_released_worker_keeps_no_table_of_powers():
    data = np.frombuffer(b"word " * (1 << 20), np.uint8)
    before = common.prefix_hash(data)
    assert sum(x.nbytes for x in common._tables.values()) > 80_000_000
    common.release()
    assert not common._tables
    assert np.array_equal(common.prefix_hash(data), before)
    common.release()
