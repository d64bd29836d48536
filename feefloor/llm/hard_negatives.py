"""Hard negatives of anchors, by exact scores from a residue number system.

A row's components are whole numbers, floor(256 x). Its score with an anchor is
their inner product, taken by float32 matrix products of the components modulo
several small primes: with ``CHUNK`` components at a time and residues no larger than
half a prime below 1024, every sum stays under 2^24, where float32 is exact. As many
primes are used as the largest possible score needs, and the Chinese remainder
theorem gives back the exact signed score from its residues.

Anchors are a stated query set that meets all rows, in blocks: rows are dealt
evenly into blocks of about ``BLOCK``, anchors into sets of about ``ANCHORS``, and
each task takes one block with one set, so its memory is bounded whatever labels,
vectors or ids repeat. It returns its first rows of each anchor, and a window
selects from those. Two passes: the first finds an anchor's positives, its first
rows of the same label; the second, with their scores known, the first rows of other
labels that score within ``LOW`` to ``HIGH`` hundredths of a positive.

Rows take no part with a null id, label or vector, or a null or non-finite
component. Rows are told apart by their place in the table, so rows that repeat an id
or a vector each take part, and an anchor is left out only of its own rows. Equal
scores go by the smaller id. A shorter vector counts as zero beyond its end, and an
empty one scores 0. A score beyond 64 bits is held at the nearest 64-bit number.
Columns other than the three are not read; an empty table, or one without anchors,
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feefloor.llm.common import blocks_met, map_arrow, table
from feefloor.session import cut_lineage

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
#: A negative's score lies within these hundredths of the positive's.
LOW, HIGH = 50, 95
#: Rows of a block, and anchors that meet it in one task.
BLOCK = 8192
ANCHORS = 4096
#: Scores that a task holds at once.
CELLS = 1 << 20
#: Components whose products of residues float32 sums exactly: 64 * 510^2 < 2^24.
CHUNK = 64
#: Components are held within this; no 32-bit float comes near it.
LARGEST = 2.0**700
_LEAST, _MOST = -2**63, 2**63 - 1


def primes(count: int) -> list[int]:
    """The ``count`` largest primes below 1024."""
    odd = (n for n in range(1023, 2, -2))
    found = (n for n in odd if all(n % d for d in range(3, int(n**0.5) + 1, 2)))
    return [p for p, _ in zip(found, range(count))]


def primes_for(bound: int) -> list[int]:
    """Enough primes to tell every whole number within +-``bound`` apart."""
    count, product = 0, 1
    while product <= 2 * bound:
        count += 1
        product = int(np.prod([int(p) for p in primes(count)], dtype=object))
        if count > 160:
            raise ValueError("components too large for a score")
    return primes(count)


def residues(components: np.ndarray, p: int) -> np.ndarray:
    """Components modulo p as float32, from -(p - 1)/2 to (p - 1)/2."""
    rest = np.mod(components, p)
    return np.where(rest > p // 2, rest - p, rest).astype(np.float32)


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products, anchors by rows, as 64-bit numbers."""
    width = max(anchors.shape[1], rows.shape[1], 1)
    anchors, rows = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (anchors, rows))
    top = [int(np.abs(x).max()) if x.size else 0 for x in (anchors, rows)]
    used = primes_for(max(width * top[0] * top[1], 1))
    out = np.empty((len(anchors), len(rows)), np.int64)
    tables = [(p, residues(anchors, p), residues(rows, p)) for p in used]
    step = max(1, CELLS // max(len(rows), 1))
    for i in range(0, len(anchors), step):
        parts = []
        for p, a, b in tables:
            total = 0
            for k in range(0, width, CHUNK):
                product = a[i:i + step, k:k + CHUNK] @ b[:, k:k + CHUNK].T
                total = total + product.astype(np.int32) % p
            parts.append(total % p)
        out[i:i + step] = reconstruct(parts, used)
    return out


def reconstruct(parts: list[np.ndarray], used: list[int]) -> np.ndarray:
    """The signed numbers of given residues, digit by digit of a mixed radix."""
    product = 1
    for p in used:
        product *= p
    kind = np.int64 if product < 2**62 else object  # Python's numbers for huge scores
    value, radix = parts[0].astype(kind), used[0]
    for rest, p in zip(parts[1:], used[1:]):
        digit = (rest - (value % p).astype(np.int64)) % p * pow(radix % p, -1, p) % p
        value = value + digit.astype(kind) * radix
        radix *= p
    value = np.where(value > product // 2, value - product, value)
    if kind is object:
        value = np.clip(value, _LEAST, _MOST)
    return value.astype(np.int64)


# --- rows and anchors ---------------------------------------------------------------

def usable(vectors: DataFrame) -> DataFrame:
    """(id, label, vector, at): rows that take part, and their place in the table."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)
                      & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite).select(
        F.col("vec_id").cast("long").alias("id"),
        F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
        .cast("long").alias("label"),
        F.col("embedding").cast("array<double>").alias("vector"),
        F.monotonically_increasing_id().alias("at"))


_ROW = "at long,id long,label long,vector binary"


def scaled(rows: DataFrame) -> DataFrame:
    """The rows with their components, floor(256 x), as bytes."""

    def run(batches):
        for batch in batches:
            lists = batch.column("vector")
            ends = lists.offsets.to_numpy()
            values = np.clip(np.floor(SCALE * lists.values.to_numpy()), -LARGEST, LARGEST)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("at", "id", "label")),
                 pa.array([values[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])],
                          pa.binary())], ["at", "id", "label", "vector"])

    return map_arrow(rows, run, _ROW)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    rows = [np.frombuffer(b, np.float64) for b in column.to_pylist()]
    width = max((len(r) for r in rows), default=0)
    if all(len(r) == width for r in rows):
        return np.array(rows, np.float64).reshape(len(rows), width)
    out = np.zeros((len(rows), width))
    for own, r in zip(out, rows):
        own[:len(r)] = r
    return out


def _first(score: np.ndarray, ids: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Places of the n highest scores; equal ones by id, then by place in the table."""
    own = np.arange(len(score))
    if len(score) > n:
        own = np.flatnonzero(score >= np.partition(score, len(score) - n)[len(score) - n])
    return own[np.lexsort((at[own], ids[own], ~score[own]))][:n]


def _positives(rows: pa.Table, anchors: pa.Table) -> pa.Table:
    """(anchor, id, at, score): the first rows of each anchor's label in a block."""
    found = [[], [], [], []]
    if rows.num_rows and anchors.num_rows:
        label, ids, at = (rows[c].to_numpy() for c in ("label", "id", "at"))
        own_label, own_at = (anchors[c].to_numpy() for c in ("label", "at"))
        vectors, own_vectors = _matrix(rows["vector"]), _matrix(anchors["vector"])
        for l in np.unique(own_label):
            inside, asked = np.flatnonzero(label == l), np.flatnonzero(own_label == l)
            if not len(inside):
                continue
            for a, score in zip(asked, scores(own_vectors[asked], vectors[inside])):
                others = at[inside] != own_at[a]
                best = np.flatnonzero(others)[_first(
                    score[others], ids[inside][others], at[inside][others], POSITIVES)]
                found[0] += [own_at[a]] * len(best)
                for out, values in zip(found[1:], (ids[inside], at[inside], score)):
                    out.extend(values[best].tolist())
    return pa.table([pa.array(c, pa.int64()) for c in found], ["anchor", "id", "place", "score"])


def _negatives(rows: pa.Table, anchors: pa.Table) -> pa.Table:
    """(anchor, positive, id, place, score): the first rows of other labels in a block
    that score within the bounds of each positive, told by its rank."""
    found = [[], [], [], [], []]
    if rows.num_rows and anchors.num_rows:
        label, ids, at = (rows[c].to_numpy() for c in ("label", "id", "at"))
        own_label, own_at = (anchors[c].to_numpy() for c in ("label", "at"))
        positives = anchors["positives"].to_pylist()
        vectors, own_vectors = _matrix(rows["vector"]), _matrix(anchors["vector"])
        step = max(1, CELLS // len(label))
        for i in range(0, len(own_at), step):
            for a, score in enumerate(scores(own_vectors[i:i + step], vectors), i):
                bounds = [(p["rank"], -(-LOW * p["score"] // 100), HIGH * p["score"] // 100)
                          for p in positives[a]]
                near = np.flatnonzero(
                    (label != own_label[a]) & (score >= min(b[1] for b in bounds))
                    & (score <= max(b[2] for b in bounds)))
                for rank, low, high in bounds:
                    own = near[(score[near] >= low) & (score[near] <= high)]
                    best = own[_first(score[own], ids[own], at[own], NEGATIVES)]
                    found[0] += [own_at[a]] * len(best)
                    found[1] += [rank] * len(best)
                    for out, values in zip(found[2:], (ids, at, score)):
                        out.extend(values[best].tolist())
    return pa.table([pa.array(c, pa.int64()) for c in found],
                    ["anchor", "positive", "id", "place", "score"])


def _selected(found: DataFrame, n: int, *key: str) -> DataFrame:
    """The first n of each key's rows, with their rank."""
    order = W.partitionBy(*key).orderBy(F.desc("score"), "id", "place")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def hard_negatives(vectors: DataFrame, every: int = 50) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id is divisible by ``every``.
    """
    rows = cut_lineage(scaled(usable(vectors)), "scaled-rows")
    anchors = rows.where(F.col("id") % every == 0)
    sizes = rows.agg(F.count("*").alias("n"), F.count_if(F.col("id") % every == 0).alias("a"))
    n_rows, n_anchors = sizes.first()
    near = blocks_met(rows, anchors, 1 + n_rows // BLOCK, 1 + n_anchors // ANCHORS, _positives,
                      "anchor long,id long,place long,score long")
    positives = cut_lineage(_selected(near, POSITIVES, "anchor"), "positives")
    lists = positives.groupBy("anchor").agg(
        F.collect_list(F.struct("rank", "score")).alias("positives"))
    asked = cut_lineage(anchors.join(lists, anchors["at"] == lists["anchor"]).drop("anchor"),
                        "asked")
    found = blocks_met(rows, asked, 1 + n_rows // BLOCK, 1 + n_anchors // ANCHORS, _negatives,
                       "anchor long,positive long,id long,place long,score long")
    chosen = _selected(found, NEGATIVES, "anchor", "positive").select(
        "anchor", "positive", "rank", F.col("id").alias("negative_id"),
        F.col("score").alias("negative_score"))
    named = positives.join(anchors.select(F.col("at").alias("anchor"),
                                          F.col("id").alias("anchor_id")), "anchor").select(
        "anchor", F.col("rank").cast("long").alias("positive"), "anchor_id",
        F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return chosen.join(named, ["anchor", "positive"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))


OP13_SQL = """
WITH r AS (SELECT vec_id AS id,
    CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same,
    CAST(coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])), 0) AS BIGINT)
      AS score
  FROM r a JOIN r b ON a.id <> b.id WHERE a.id % 50 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id
    ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score,
  score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score
  AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 3
"""
