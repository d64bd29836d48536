"""Toxic passages as maximum-scoring segments of token log-odds.

Each word scores the log-odds of toxic against clean text under a Dirichlet
prior shaped like all labelled text, less a small drift, so that neutral text
scores below zero. A word's beginnings are tokens too: of the word and its
beginnings, the one with the surest log-odds speaks for it, which covers forms
of a word that were never labelled. A linear scan over all tokens finds every maximal
segment of a text, its passages. Chance alone makes longer texts reach higher scores: the best score of a clean text of
n words follows an extreme-value law with parameters lambda (from the scores'
distribution in clean text) and K (from clean texts' best segments). A segment's
expected number of rivals E = K n exp(-lambda S) says how significant it is. For
passages the drift is ``PASSAGE_DRIFT`` a token, so that two of them stay two with a few
neutral words between.

A document's evidence discounts what it says again: a second scan takes a word that
an earlier word of the text equals as neutral, so that a line repeated hundreds of
times weighs no more than once, and lets tokens drift by ``DRIFT`` only, since words
of one mind add up over a text. The sum of its segments' -log E is turned into a
probability by a logistic curve over the same labelled texts. Both scans have their
own lambda and K.

The classifier is fitted on at most ``LABELLED`` labelled rows, chosen by a hash of
the id; every document is scored over its whole text. Words are runs of letters
and digits in lower case. A null or empty text has no words and takes the score
of no evidence. Labelled ids without a document, documents without a label, null
labels and repeated rows are all allowed; each row gets a score. Without any labelled
toxic or clean text every score is the share of toxic labels, or 0.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feefloor.llm.common import (
    bounded_sample, lower_sums, mix, over_batches, raw, span_hash, steps, table, word_spans)
from feefloor.session import cut_lineage

#: Bounds of the fit: labelled rows read, and words kept by weight of evidence.
LABELLED = 200_000
MODEL_WORDS = 20_000
#: Beginnings of words that count as tokens, in bytes.
STEMS = (3, 4, 5, 6, 8, 10)
#: A word counts if its counts are so many standard deviations from no difference,
MIN_Z = 4.0
#: and its log-odds so far from 0: lesser leanings of common words only add up to noise.
MIN_ODDS = 2.0
#: Prior words for each class, as a share of all labelled ones, and what a word must
#: make up for by its log-odds.
PRIOR = 0.01
DRIFT = 0.02
PASSAGE_DRIFT = 0.5
#: A passage is significant if chance makes so few of its score in such a text.
MAX_E = 0.05
THRESHOLD = 0.7

_SALT = np.uint64(0x9E3779B97F4A7C15)
_LETTERS = np.ones(256, bool)
_LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


@dataclass(frozen=True)
class Model:
    words: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    scores: np.ndarray = field(default_factory=lambda: np.empty(0))
    sureness: np.ndarray = field(default_factory=lambda: np.empty(0))
    lam: float = 1.0
    k: float = 1.0
    passage_lam: float = 1.0
    passage_k: float = 1.0
    slope: float = 0.0
    intercept: float = -math.inf

    def of(self, data, starts, ends) -> np.ndarray:
        """Scores of words; those outside the model only pay the drift."""
        out = np.full(len(starts), -DRIFT)
        if len(self.words):
            surest = np.zeros(len(starts))
            for own, hashes in tokens(data, starts, ends):
                at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
                known = self.words[at] == hashes
                own, at = own[known], at[known]
                better = self.sureness[at] > surest[own]
                own, at = own[better], at[better]
                surest[own] = self.sureness[at]
                out[own] = self.scores[at] - DRIFT
        return out

    def evidence(self, score, n_words):
        """-log E of a segment in a text of n_words words."""
        return self.lam * score - np.log(self.k * np.maximum(n_words, 1))

    def significant(self, score, n_words) -> bool:
        """Whether a passage of a text of n_words words is one."""
        return (self.passage_lam * score - math.log(self.passage_k * max(n_words, 1))
                >= -math.log(MAX_E))

    def probability(self, evidence):
        return 1 / (1 + np.exp(-np.clip(self.intercept + self.slope * evidence, -50, 50)))


def repeats(data, starts, ends, first, among: np.ndarray) -> np.ndarray:
    """Numbers of the words in ``among`` that an earlier word of their text equals."""
    own = np.flatnonzero(among)
    text = np.searchsorted(first, own, "right").astype(np.uint64)
    hashes = span_hash(lower_sums(data), starts[own], ends[own]) if len(own) else text
    _, new = np.unique(mix(hashes) + text * _SALT, return_index=True)
    return np.delete(own, new)


def tokens(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(word numbers, token hashes) of whole words, then of each length of beginning."""
    sums = lower_sums(data)
    yield np.arange(len(starts)), mix(span_hash(sums, starts, ends))
    for size in STEMS:
        own = np.flatnonzero(ends - starts > size)
        yield own, mix(span_hash(sums, starts[own], starts[own] + size) + np.uint64(size))


def maximal_segments(before: np.ndarray, after: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal segments, as (first, last, score), of one text.

    ``before`` and ``after`` are the running totals around each token that scores
    above zero. Linear time: each kept segment links to the nearest one on its
    left that starts lower, and merged ones are dropped for good.
    """
    kept: list[tuple[float, float, int, int, int]] = []
    for k, (low, high) in enumerate(zip(before.tolist(), after.tolist())):
        first, j = k, len(kept) - 1
        while True:
            while j >= 0 and kept[j][0] >= low:
                j = kept[j][4]
            if j < 0 or kept[j][1] >= high:
                kept.append((low, high, first, k, j))
                break
            low, first = kept[j][0], kept[j][2]
            j_next = kept[j][4]
            del kept[j:]
            j = j_next
    return [(first, last, high - low) for low, high, first, last, _ in kept]


def passages(texts: pa.Array, model: Model):
    """For each text: its number of words, its passages as (start, end, score) bytes,
    and the scores of its segments with words said again as neutral."""
    for begin, end in steps(texts):
        data, offsets = raw(texts[begin:end])
        starts, ends, first = word_spans(data, offsets, _LETTERS)
        scores = model.of(data, starts, ends)
        every = scores - (PASSAGE_DRIFT - DRIFT)
        scores[repeats(data, starts, ends, first, scores > 0)] = -DRIFT
        found = [list(_segments(x, first)) for x in (every, scores)]
        for i in range(end - begin):
            yield (int(first[i + 1] - first[i]),
                   [(int(starts[a] - offsets[i]), int(ends[b] - offsets[i]), s)
                    for a, b, s in found[0][i]], [s for *_, s in found[1][i]])


def _segments(scores: np.ndarray, first: np.ndarray):
    """The maximal segments of each text, as (first token, last token, score)."""
    total = np.cumsum(scores)
    hits = np.flatnonzero(scores > 0)
    bounds = np.searchsorted(hits, first)
    for a, b in zip(bounds[:-1], bounds[1:]):
        own = hits[a:b]
        if not len(own):
            yield []
            continue
        after = total[own] - total[own[0]]
        yield [(int(own[i]), int(own[j]), s)
               for i, j, s in maximal_segments(after - scores[own], after)]


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 3 == 1


def labelled(docs: DataFrame, labels: DataFrame, rows: int = LABELLED) -> DataFrame:
    """(toxic, text) of a bounded set of labelled documents outside the held-out third."""
    chosen = bounded_sample(
        labels.where(F.col("toxic").isNotNull() & ~F.coalesce(held_out(), F.lit(True)))
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")), rows, "doc_id")
    # At most ``rows`` pairs of numbers.
    return (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
            .select("toxic", "text"))


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n_toxic, n_clean, whole): texts of each class that have a token."""

    def run(batch):
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
        column = batch.column("text")
        for begin, end in steps(column, 4 << 20):
            data, offsets = raw(column[begin:end])
            starts, ends, first = word_spans(data, offsets, _LETTERS)
            bad = np.repeat(toxic[begin:end] == 1, np.diff(first))
            text = np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first))
            for kind, (own, hashes) in enumerate(tokens(data, starts, ends)):
                # Each token once per text, as it is scored.
                new = np.unique(mix(hashes) + text[own] * _SALT, return_index=True)[1]
                own, hashes = own[new], hashes[new]
                words, inverse = np.unique(hashes, return_inverse=True)
                n_bad = np.bincount(inverse[bad[own]], minlength=len(words))
                n_all = np.bincount(inverse, minlength=len(words))
                yield {"word": pa.array(words.view(np.int64)),
                       "n_toxic": pa.array(n_bad, pa.int64()),
                       "n_clean": pa.array(n_all - n_bad, pa.int64()),
                       "whole": pa.array(np.full(len(words), kind == 0))}

    return (over_batches(texts, run, "word long, n_toxic long, n_clean long, whole boolean")
            .groupBy("word").agg(F.sum("n_toxic").alias("n_toxic"),
                                 F.sum("n_clean").alias("n_clean"),
                                 F.max("whole").alias("whole")))


def score_counts(texts: DataFrame, model: Model) -> DataFrame:
    """(score, n): how often each word score occurs; as many rows as the model has scores."""

    def run(batch):
        for begin, end in steps(batch.column("text")):
            data, offsets = raw(batch.column("text")[begin:end])
            scores, n = np.unique(model.of(data, *word_spans(data, offsets, _LETTERS)[:2]),
                                  return_counts=True)
            yield {"score": pa.array(scores, pa.float64()), "n": pa.array(n, pa.int64())}

    return (over_batches(texts, run, "score double, n long")
            .groupBy("score").agg(F.sum("n").alias("n")))


def log_odds(n_toxic, n_clean, all_toxic: float, all_clean: float,
             prior_share: float = PRIOR):
    """(log-odds under the prior, root of the likelihood ratio of a difference) as Columns.

    The ratio and not the prior's variance tells how sure a difference is, since
    the latter never trusts a word that clean text lacks.
    """
    prior = prior_share * (all_toxic + all_clean)
    share = (n_toxic + n_clean) / F.lit(all_toxic + all_clean)
    a, b = n_toxic + share * prior, n_clean + share * prior
    delta = F.log(a / (all_toxic + prior - a)) - F.log(b / (all_clean + prior - b))

    def part(n, expected):
        return F.when(n > 0, n * F.log(n / expected)).otherwise(F.lit(0.0))

    ratio = 2 * (part(n_toxic, share * all_toxic) + part(n_clean, share * all_clean))
    return delta, F.sqrt(F.greatest(ratio, F.lit(0.0)))


def karlin_lambda(scores: np.ndarray, shares: np.ndarray) -> float:
    """The positive root of sum(share * exp(lambda * score)) = 1; 1 if there is none."""
    if not (scores > 0).any() or (scores * shares).sum() >= 0:
        return 1.0
    low, high = 0.0, 1.0
    value = lambda x: float((shares * np.exp(np.minimum(x * scores, 700))).sum()) - 1
    while value(high) < 0 and high < 1e3:
        low, high = high, high * 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return high


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton steps, with a weak pull of the slope to 0."""
    w = np.zeros(2)
    design = np.column_stack([x, np.ones(len(x))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -50, 50)))
        gradient = design.T @ (y - p) - np.array([1e-3, 0]) * w
        hessian = (design * (p * (1 - p))[:, None]).T @ design + np.diag([1e-3, 1e-9])
        step = np.linalg.solve(hessian, gradient)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, rows: int = LABELLED) -> Model:
    texts = labelled(docs, labels, rows)
    counts = word_counts(texts)
    counts = cut_lineage(counts, "toxic-words")
    sums = counts.where("whole").agg(F.sum("n_toxic").alias("t"),
                                     F.sum("n_clean").alias("c")).first()
    all_toxic, all_clean = float(sums["t"] or 0), float(sums["c"] or 0)
    if not all_toxic or not all_clean:
        share = texts.agg(F.avg("toxic").alias("p")).first()["p"]
        return Model(intercept=-50.0 if not share else 50.0 if share == 1
                     else math.log(share / (1 - share)))
    delta, z = log_odds(F.col("n_toxic"), F.col("n_clean"), all_toxic, all_clean)
    kept = (counts.withColumns({"delta": delta, "z": z})
            .where((F.col("z") >= MIN_Z) & (F.abs("delta") >= MIN_ODDS))
            .orderBy(F.desc("z"), "word").limit(MODEL_WORDS).collect())
    words = np.array([r["word"] for r in kept], np.int64).view(np.uint64)
    order = np.argsort(words)
    model = Model(words[order], np.array([r["delta"] for r in kept], float)[order],
                  np.array([r["z"] for r in kept], float)[order])
    null = score_counts(texts.where("toxic = 0"), model).collect()
    n = np.array([r["n"] for r in null], float)
    clean = np.array([r["score"] for r in null], float)
    lam, passage_lam = (karlin_lambda(clean - d, n / max(n.sum(), 1))
                        for d in (0, PASSAGE_DRIFT - DRIFT))
    model = replace(model, lam=lam, passage_lam=passage_lam)
    rows_ = best_segments(texts, model).collect()  # at most ``rows`` rows of numbers
    toxic = np.array([r["toxic"] for r in rows_], float)
    n_words = np.array([r["n_words"] for r in rows_], float)
    null = (toxic == 0) & (n_words > 0)
    k, passage_k = (max(null.sum() / max(float((n_words * np.exp(-x * np.array(
        [r[best] for r in rows_], float)))[null].sum()), 1e-300), 1e-12)
        for x, best in ((lam, "best"), (passage_lam, "best_passage")))
    model = replace(model, k=k, passage_k=passage_k)
    x = np.array([document_evidence(model, r["n_words"], r["scores"]) for r in rows_])
    slope, intercept = logistic(x, toxic)
    return replace(model, slope=max(slope, 0.0), intercept=intercept)


def document_evidence(model: Model, n_words: int, scores: list[float]) -> float:
    """Sum of the significant segments' evidence, or the best one's; log of 1 + x
    keeps long lists of passages on one scale with single ones."""
    if not scores:
        return 0.0
    parts = model.evidence(np.asarray(scores), n_words)
    return math.log1p(float(parts[parts > 0].sum()))


def best_segments(texts: DataFrame, model: Model) -> DataFrame:
    def run(batch):
        found = list(passages(batch.column("text"), model))
        yield {"toxic": batch.column("toxic"),
               "n_words": pa.array([n for n, *_ in found], pa.int64()),
               "best": pa.array([max(s, default=0.0) for *_, s in found], pa.float64()),
               "best_passage": pa.array([max((x for *_, x in p), default=0.0)
                                         for _, p, _ in found], pa.float64()),
               "scores": pa.array([s for *_, s in found], pa.list_(pa.float64()))}

    return over_batches(texts, run, "toxic int,n_words long,best double,best_passage double,"
                                    "scores array<double>")


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score, predicted, n_passages and passages (start, end, score).

    Passages are the significant segments in text order, in code points.
    """
    kept = [c for c in docs.columns if c not in ("score", "predicted", "n_passages", "passages")]
    passage = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batch):
        texts = batch.column("text")
        points, spans = [], []
        for i, (n_words, found, scores) in enumerate(passages(texts, model)):
            points.append(document_evidence(model, n_words, scores))
            sure = [x for x in found if model.significant(x[2], n_words)]
            if sure:
                data = texts[i].as_py().encode()
                sure = [{"start": len(data[:a].decode()), "end": len(data[:b].decode()),
                         "score": s} for a, b, s in sure]
            spans.append(sure)
        values = model.probability(np.array(points, float))
        yield {c: batch.column(c) for c in kept} | {
            "score": pa.array(values, pa.float64()),
            "predicted": pa.array((values >= threshold).astype(np.int32)),
            "n_passages": pa.array([len(s) for s in spans], pa.int32()),
            "passages": pa.array(spans, pa.list_(passage))}

    fields = ",".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema
                      if f.name in kept)
    return over_batches(docs.select(*kept), run,
                        f"{fields},score double,predicted int,n_passages int,"
                        "passages array<struct<start:bigint,end:bigint,score:double>>")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted",
        "n_passages")
