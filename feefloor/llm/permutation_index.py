"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order in which it meets the pivots: the ``PREFIX``
nearest of them, nearest first. It is posted in the inverted files of its ``POSTED``
nearest pivots. A query visits the files of its ``VISITED`` nearest pivots, ranks
what it finds by the footrule distance of the two orders, the sum over the pivots of
how far apart they stand, and takes the best ``SHARE`` of it to the exact distance of
the original vectors.

The index is partitioned by rows: they are dealt evenly into blocks, each with
inverted files of its own, and every set of queries visits every block. A task holds
one block and one set and returns the nearest few of each query. Equal vectors are
one posting that keeps its first ids, one more than a result holds, whatever number
of rows repeat it; so every row is indexed and none in a result is missed.

Pivots are the ``PIVOTS`` vectors with the least hashes, a bounded sample. With few
rows every file is visited; where a query's files hold fewer rows of a block than a
result does, the block is ranked whole, so results are never short.

Distances are Euclidean, in double precision. A shorter vector counts as zero beyond
its end. Null vectors, ids and components, non-finite components and vectors without
a component other than zero take no part. Rows are told apart by their place, so a
query finds other rows of its id and each row of a repeated query id has its result.
Equal distances go by the smaller id. An empty table, or one without queries, gives
no rows. Columns other than the two are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feefloor.llm.common import blocks_met, map_arrow, table
from feefloor.session import cut_lineage

NEIGHBOURS = 10
PIVOTS = 256
#: Pivots in a vector's order, of these the files it is posted in, and files a query visits.
PREFIX = 64
POSTED = 2
VISITED = 144
#: Part of the rows found that is ranked by exact distance, and how many at least.
SHARE = 0.35
LEAST = 64
#: Rows of a block, and queries that visit it in one task.
BLOCK = 8192
ASKED = 2048


def usable(vectors: DataFrame) -> DataFrame:
    """(id, vector, at): rows that take part, and their place in the table."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)
                      & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(F.col("vec_id").isNotNull() & finite
                         & F.exists("embedding", lambda x: x != 0)).select(
        F.col("vec_id").cast("long").alias("id"),
        F.col("embedding").cast("array<double>").alias("vector"),
        F.monotonically_increasing_id().alias("at"))


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """(at, vector, rows): each vector once, with its first ``keep`` rows by id.

    Rows beyond those are left out before they move, so a vector that many rows
    repeat is gathered nowhere.
    """
    order = W.partitionBy(F.xxhash64("vector"), "vector").orderBy("id", "at")
    first = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep)
    return first.groupBy("vector").agg(
        F.min("at").alias("at"), F.sort_array(F.collect_list(F.struct("id", "at"))).alias("rows"))


def _matrix(lists: pa.Array) -> np.ndarray:
    """Lists of numbers as rows of one table, padded with zeros."""
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    ends = lists.offsets.to_numpy()
    lengths, values = np.diff(ends), lists.values.to_numpy()[ends[0]:ends[-1]]
    out = np.zeros((len(lists), int(lengths.max(initial=0))))
    out[np.arange(out.shape[1]) < lengths[:, None]] = values
    return out


def _same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))


def orders(vectors: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """The ``length`` nearest pivots of each vector, nearest first."""
    vectors, pivots = _same_width(vectors, pivots)
    far = (pivots**2).sum(axis=1) - 2 * vectors @ pivots.T
    return np.argsort(far, axis=1, kind="stable")[:, :length]


def indexed(vectors: DataFrame, pivots: np.ndarray, length: int) -> DataFrame:
    """``vectors`` with the order of their nearest pivots, two bytes each."""

    def run(batches):
        for batch in batches:
            near = orders(_matrix(batch.column("vector")), pivots, length).astype("<u2")
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([x.tobytes() for x in near], pa.binary())],
                [*batch.schema.names, "near"])

    types = ",".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema.fields)
    return map_arrow(vectors, run, f"{types},near binary")


def footrule(flat: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Distance of each row's order from a query's, both cut after ``length`` pivots.

    ``flat``: pivot * length + position, row by row. A pivot that one order lacks
    stands at ``length`` in it.
    """
    place = np.full(len(order), length)
    place[order[:length]] = np.arange(length)
    # What the query's pivots add if a row lacks them all, less those it has.
    apart = np.abs(place[:, None] - np.arange(length)) - (length - place)[:, None]
    return apart.ravel()[flat].sum(axis=1) + length * (length + 1) // 2


def _searcher(n_pivots: int, length: int, visited: int, share: float, keep: int):
    """Function of a block's rows and a set of queries: (asked, at, distance)."""

    def search(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out = [[], [], []]
        if rows.num_rows and asked.num_rows:
            table, queries = _same_width(_matrix(rows["vector"]), _matrix(asked["vector"]))
            near = np.frombuffer(b"".join(rows["near"].to_pylist()), "<u2").reshape(
                len(table), -1).astype(np.int64)
            length_here = near.shape[1]
            flat = near * length_here + np.arange(length_here)
            posted = near[:, :POSTED]
            by_pivot = np.argsort(posted.ravel(), kind="stable")
            starts = np.searchsorted(posted.ravel()[by_pivot], np.arange(n_pivots + 1))
            files = by_pivot // posted.shape[1]
            at, asked_at = rows["at"].to_numpy(), asked["at"].to_numpy()
            ways = np.frombuffer(b"".join(asked["near"].to_pylist()), "<u2").reshape(
                len(queries), -1)
            for query, way, name in zip(queries, ways, asked_at):
                seen = np.zeros(len(table), bool)
                for p in way[:visited]:
                    seen[files[starts[p]:starts[p + 1]]] = True
                found = np.flatnonzero(seen)
                if len(found) < keep:
                    found = np.arange(len(table))
                best = max(LEAST, int(share * len(found)))
                if len(found) > best:
                    apart = footrule(flat[found], way, length_here)
                    found = found[np.argpartition(apart, best)[:best]]
                distance = np.sqrt(((table[found] - query) ** 2).sum(axis=1))
                if len(found) > keep:  # equal distances all stay, for the ids to decide
                    bound = np.partition(distance, keep)[keep]
                    found, distance = found[distance <= bound], distance[distance <= bound]
                out[0].append(np.full(len(found), name))
                out[1].append(at[found])
                out[2].append(distance)
        return pa.table([pa.array(np.concatenate(c) if c else [], t) for c, t in zip(
            out, (pa.int64(), pa.int64(), pa.float64()))], ["asked", "found", "score"])

    return search


def nearest(vectors: DataFrame, neighbours: int = NEIGHBOURS, every: int = 100,
            share: float = SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score): queries are the rows whose id ``every`` divides."""
    keep = neighbours + 1
    rows = usable(vectors)
    distinct = cut_lineage(distinct_vectors(rows, keep), "vectors")
    sample = distinct.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(PIVOTS)
    pivots = _matrix(sample.toArrow()["vector"].combine_chunks())
    asking = (rows.where(F.col("id") % every == 0)
              .join(distinct.select("vector", F.col("at").alias("key")), "vector")
              .select("id", "at", "key"))
    asking = cut_lineage(asking, "queries")
    length = min(PREFIX, len(pivots))
    index = cut_lineage(indexed(distinct.select("at", "vector"), pivots, length), "index")
    asked = cut_lineage(indexed(distinct.join(
        asking.select(F.col("key").alias("at")).distinct(), "at", "left_semi")
        .select("at", "vector"), pivots, len(pivots)), "asked")
    n_rows, n_asked = index.count(), asked.count()
    search = _searcher(len(pivots), length, VISITED, share, keep)
    found = blocks_met(index, asked, 1 + n_rows // BLOCK, 1 + n_asked // ASKED, search,
                       "asked long,found long,score double")

    # The first rows of what a query vector found, one more than a result holds, since
    # each of its own rows leaves itself out.
    members = distinct.select(F.col("at").alias("found"), F.explode("rows").alias("r"))
    near = W.partitionBy("asked").orderBy("score", "id", "row")
    first = (found.join(members, "found")
             .select("asked", "score", F.col("r.id").alias("id"), F.col("r.at").alias("row"))
             .withColumn("place", F.row_number().over(near)).where(F.col("place") <= keep))
    lists = cut_lineage(first.drop("place"), "nearest")
    mine = W.partitionBy("query_row").orderBy("score", "vec_id", "row")
    return (asking.select(F.col("id").alias("query_id"), F.col("at").alias("query_row"),
                          F.col("key").alias("asked"))
            .join(lists.withColumnRenamed("id", "vec_id"), "asked")
            .where("row <> query_row")
            .withColumn("rank", F.row_number().over(mine)).where(F.col("rank") <= neighbours)
            .select("query_id", "rank", "vec_id", "score"))


def op12_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
