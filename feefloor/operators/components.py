"""Connected components of links, each named by its least member.

Links are first dealt in slices of bounded size, and a task joins what its slice
holds to stars: every member points at the least one it knows. A unit (a block, or
the whole table) of one slice is done by that. The stars of a larger unit are
drawn together by rounds of two steps, each a join that the engine can split where
a member is hot: every pointer moves on to where its target points (large star),
then all that a member points at, and the member, point at the least of these
(small star). A member learns of its links from both ends of them. A star whose
members have no other link is settled and kept out of later rounds, and what is
left goes through the slices again.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feefloor.session import WorkTables

# The batch function travels with its job, so workers need no copy of this
# package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Links of one unit that a single task joins.
SLICE_LINKS = 100_000
#: A round halves the longest way to a least member, so no input comes near this.
MAX_ROUNDS = 64

KEY = ["unit", "v"]


def component_roots(links: DataFrame, slice_links: int = SLICE_LINKS,
                    max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(unit, v, root) of every member of ``links`` (unit long, a, b).

    Members of different units are different; they are of any one ordered type. A link
    of a member with itself names it and joins nothing; one with a null end is none.
    """
    with WorkTables(links.sparkSession) as work:
        return work.keep(roots_in(work, links, slice_links, max_rounds))


def roots_in(work: WorkTables, links: DataFrame, slice_links: int = SLICE_LINKS,
             max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """``component_roots`` as a table of ``work``."""
    rows = links.select("unit", F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u"),
                        (F.col("a") != F.col("b")).alias("two")).where("two IS NOT NULL")
    lone = rows.where("NOT two").select("unit", "v", F.col("u").alias("root"))
    rows, done = rows.drop("two"), []
    for _ in range(max_rounds):
        stars, torn = _sliced(rows, slice_links, work)
        done.append(stars.where("whole").drop("whole"))
        if not torn:
            if len(done) == 1:
                return work.cut(done[0], "roots")
            found = work.cut(_all(done), "roots")
            return work.cut(found.unionByName(lone.join(
                found, KEY, "left_anti").distinct()), "roots")
        settled, rows = _round(stars.where("NOT whole").select(
            "unit", "v", F.col("root").alias("u")), work)
        done.append(settled)
    raise RuntimeError(f"components are not done after {max_rounds} rounds")


def _all(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _sliced(rows: DataFrame, limit: int, work: WorkTables) -> tuple[DataFrame, bool]:
    """(unit, v, root, whole) of every slice, and whether a unit has several.

    A whole unit names its roots too; of others only what points at another member
    is kept.
    """
    large = work.cut(rows.groupBy("unit").count().where(f"count > {limit}")
                     .select("unit", F.ceil(F.col("count") / limit).alias("slices")), "large-units")
    torn = not large.isEmpty()
    dealt = rows.withColumn("slices", F.lit(1).cast("long"))
    if torn:
        dealt = rows.join(large, "unit", "left").withColumn(
            "slices", F.coalesce("slices", F.lit(1)))
    kind = rows.schema["v"].dataType.simpleString()
    return work.cut(
        dealt.select("unit", "v", "u", F.pmod(F.xxhash64("v"), "slices").alias("slice"),
                     (F.col("slices") == 1).alias("whole"))
        .repartition("unit", "slice").sortWithinPartitions("unit")
        .mapInArrow(_stars, f"unit long,v {kind},root {kind},whole boolean"), "stars"), torn


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units as they arrive; the last of a batch waits for the next batch."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        units = table["unit"].to_numpy()
        start = int(np.searchsorted(units, units[-1])) if len(units) else 0
        if start:
            yield _star_rows(table.slice(0, start))
        held = table.slice(start)
    if held is not None and held.num_rows:
        yield _star_rows(held)


def _star_rows(table: pa.Table) -> pa.RecordBatch:
    rows = table.num_rows
    units, unit = np.unique(np.tile(table["unit"].to_numpy(), 2), return_inverse=True)
    names = pa.concat_arrays([one_array(table["v"]), one_array(table["u"])]).dictionary_encode()
    rank = np.argsort(np.argsort(names.dictionary.to_numpy(zero_copy_only=False)))
    code = unit * len(rank) + rank[names.indices.to_numpy()]
    ids, at, place = np.unique(code, return_index=True, return_inverse=True)
    least = least_members(len(ids), place[:rows], place[rows:])
    whole = np.tile(table["whole"].to_numpy(zero_copy_only=False), 2)[at]
    kept = np.flatnonzero(whole | (least != np.arange(len(ids))))
    named = names.dictionary_decode()
    return pa.RecordBatch.from_pydict({
        "unit": units[unit[at[kept]]], "v": named.take(pa.array(at[kept])),
        "root": named.take(pa.array(at[least[kept]])), "whole": whole[kept]})


def one_array(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)


def least_members(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member position per component: hook roots, then halve paths."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, before[a], low)
        np.minimum.at(label, before[b], low)
        label = label[label]
        if np.array_equal(label, before):
            return label


def _round(pointers: DataFrame, work: WorkTables) -> tuple[DataFrame, DataFrame]:
    """(members of settled stars with their root, pointers that are left).

    ``pointers`` (unit, v, u) lead from a member to a smaller one.
    """
    pointers = work.cut(pointers.distinct(), "pointers")
    ends = pointers.select("unit", F.inline(F.array(
        F.struct(F.col("v"), F.col("u").alias("other")),
        F.struct(F.col("u").alias("v"), F.col("v").alias("other")))))
    members = work.cut(ends.groupBy(*KEY).agg(
        F.min("other").alias("low"), F.count("*").alias("n")), "members")
    leaves = (members.where("n = 1 AND low < v").groupBy("unit", F.col("low").alias("v"))
              .agg(F.count("*").alias("leaves")))
    targets = members.join(leaves, KEY, "left").select(
        "unit", F.col("v").alias("u"), F.least("v", "low").alias("low"),
        (F.col("low") > F.col("v")).alias("is_root"),
        F.coalesce(F.col("leaves") == F.col("n"), F.lit(False)).alias("all_leaves")).withColumn(
        "settled", F.col("is_root") & F.col("all_leaves"))
    moved = work.cut(pointers.join(targets, ["unit", "u"])
                     .select("unit", "v", "u", "low", "settled"), "moved")
    stars = moved.where("settled")
    settled = stars.select("unit", "v", F.col("u").alias("root")).unionByName(
        stars.select("unit", F.col("u").alias("v"), F.col("u").alias("root")).distinct())
    torn = moved.where("NOT settled")
    least = torn.groupBy(*KEY).agg(F.min("low").alias("least"))
    left = torn.join(least, KEY).select(
        "unit", F.when(F.col("low") == F.col("least"), F.col("v")).otherwise(F.col("low"))
        .alias("v"), F.col("least").alias("u"))
    return settled, left
