"""Packages: connected transactions of one block, priced together.

Blocks of ordinary size are brought together by one shuffle, sorted by block,
and grouped many at a time by a small numpy routine over Arrow batches. A block
with more linked transactions than ``max_block_rows`` is first cut into its
packages by joins, and these go through the same routine; only for a package that
is itself over the limit are ancestors counted by joins too, as bits. All ways give the same
packages and the same, complete, ancestor figures.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feefloor.functions.hashes import packed, unpacked
from feefloor.functions.measures import ratio
from feefloor.operators.components import SLICE_LINKS, least_members, one_array, roots_in
from feefloor.session import WorkTables, split_by_group_size

# The batch function travels with its job, so workers need no copy of this
# package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Ancestors whose bits are carried together, per member of their blocks.
BIT_COLUMNS = 4096
# Rows of one block a single task may hold. A 4,000,000-unit block has room
# for about 16,000 transactions.
MAX_BLOCK_ROWS = 50_000

PACKAGE_SCHEMA = """tx_hash string, block_number long, package_id string,
 package_tx_count long, package_fee long, package_vsize long, effective_fee_rate double,
 ancestor_count long, ancestor_vsize long"""


def packages(working_set: DataFrame, max_block_rows: int = MAX_BLOCK_ROWS) -> DataFrame:
    """Package and ancestor figures for every row of the working set."""
    rows = working_set.select(
        "tx_hash", "block_number",
        F.coalesce(F.col("fee").cast("long"), F.lit(0).cast("long")).alias("fee"),
        F.coalesce(F.col("virtual_size").cast("long"), F.lit(0).cast("long"))
        .alias("virtual_size"),
        F.coalesce("parent_hashes", F.array().cast("array<string>")).alias("parent_hashes"))
    normal, oversized = split_by_group_size(rows, "block_number", max_block_rows)
    grouped = _by_unit(normal.withColumn("unit", F.col("block_number")))
    if oversized is None:
        return grouped
    return grouped.unionByName(packages_by_joins(oversized, max_block_rows))


def _by_unit(rows: DataFrame) -> DataFrame:
    """Rows of a ``unit`` come together: a block, or a package of a large block."""
    return (unpacked(packed(rows).repartition("unit")).sortWithinPartitions("unit", "tx_hash")
            .select("unit", "tx_hash", "block_number", "fee", "virtual_size", "parent_hashes")
            .mapInArrow(_whole_blocks, PACKAGE_SCHEMA))


# --- whole blocks in one task ----------------------------------------------

def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Group complete units as they arrive; the last, perhaps unfinished, one of a
    batch waits for the next batch."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        units = table["unit"].to_numpy()
        start = int(np.searchsorted(units, units[-1])) if len(units) else 0
        if start:
            yield _package_rows(table.slice(0, start))
        held = table.slice(start)
    if held is not None and held.num_rows:
        yield _package_rows(held)


def _package_rows(table: pa.Table) -> pa.RecordBatch:
    """Rows sorted by unit and hash: a smaller position is a smaller hash, so
    the first position of a component names its package."""
    table = table.combine_chunks()
    n = table.num_rows
    hashes, lists = (one_array(table[c]) for c in ("tx_hash", "parent_hashes"))
    _, unit = np.unique(table["unit"].to_numpy(), return_inverse=True)
    child = np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    named = pa.concat_arrays([hashes, lists.flatten()]).dictionary_encode()
    code = named.indices.to_numpy(zero_copy_only=False)
    width = len(named.dictionary)
    own = unit * width + code[:n]
    wanted = unit[child] * width + code[n:]
    order = np.argsort(own)
    place = np.searchsorted(own, wanted, sorter=order)
    parent = order[np.minimum(place, n - 1)]
    known = own[parent] == wanted  # a parent outside the working set joins nothing
    child, parent = child[known], parent[known]

    label = least_members(n, child, parent)
    fee, vsize = (table[c].to_numpy() for c in ("fee", "virtual_size"))
    total_fee, total_vsize = np.zeros(n, np.int64), np.zeros(n, np.int64)
    np.add.at(total_fee, label, fee)
    np.add.at(total_vsize, label, vsize)
    total_fee, total_vsize = total_fee[label], total_vsize[label]
    count, ancestor_vsize = _ancestors(vsize, unit, child, parent)
    empty = total_vsize == 0
    rate = total_fee / np.where(empty, 1, total_vsize)
    return pa.RecordBatch.from_pydict({
        "tx_hash": hashes, "block_number": one_array(table["block_number"]),
        "package_id": hashes.take(pa.array(label)),
        "package_tx_count": np.bincount(label, minlength=n)[label],
        "package_fee": total_fee, "package_vsize": total_vsize,
        "effective_fee_rate": pa.array(rate, mask=empty),
        "ancestor_count": count, "ancestor_vsize": ancestor_vsize})


def _ancestors(vsize: np.ndarray, unit: np.ndarray, child: np.ndarray, parent: np.ndarray
               ) -> tuple[np.ndarray, np.ndarray]:
    """Number and size of all distinct ancestors, the member itself included.

    A bit for each possible ancestor is handed down from parents to children, a
    few thousand ancestors at a time and only within the units these belong to.
    """
    n = len(vsize)
    keep = child != parent
    child, parent = child[keep], parent[keep]
    count, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
    steps = _generations(n, child, parent)
    begins = np.searchsorted(unit, np.arange(unit[-1] + 1 if n else 0))
    ends = np.append(begins[1:], n)
    for start in range(0, n, BIT_COLUMNS):
        stop = min(start + BIT_COLUMNS, n)
        low, high = int(begins[unit[start]]), int(ends[unit[stop - 1]])
        bits = np.zeros((high - low, -(-(stop - start) // 8)), np.uint8)
        own = np.arange(start, stop)
        bits[own - low, (own - start) // 8] |= (128 >> ((own - start) % 8)).astype(np.uint8)
        for edges, again in steps:
            inside = edges[(child[edges] >= low) & (child[edges] < high)]
            while len(inside):
                before = bits[child[inside] - low].copy() if again else None
                np.bitwise_or.at(bits, child[inside] - low, bits[parent[inside] - low])
                if not again or np.array_equal(before, bits[child[inside] - low]):
                    break
        for row in range(0, high - low, 1024):
            part = np.unpackbits(bits[row:row + 1024], axis=1)[:, :stop - start]
            at = slice(low + row, low + row + len(part))
            count[at] += part.sum(axis=1, dtype=np.int64)
            total[at] += part @ vsize[start:stop].astype(np.int64)
    return count, total


def _generations(n: int, child: np.ndarray, parent: np.ndarray) -> list[tuple[np.ndarray, bool]]:
    """Edges in the order they can be handed down, a generation at a time.

    Edges of a cycle, which only malformed input has, come last, to be repeated
    until nothing changes.
    """
    order = np.argsort(parent, kind="stable")
    first = np.searchsorted(parent[order], np.arange(n + 1))
    waiting = np.bincount(child, minlength=n)
    ready = np.flatnonzero(waiting == 0)
    rank = np.full(n, -1)
    generation = 0
    while len(ready):
        rank[ready] = generation
        generation += 1
        width = first[ready + 1] - first[ready]
        step = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
        reached = child[order[np.repeat(first[ready], width) + step]]
        np.subtract.at(waiting, reached, 1)
        ready = np.unique(reached)
        ready = ready[waiting[ready] == 0]
    by_rank = np.argsort(rank[child], kind="stable")
    cuts = np.searchsorted(rank[child][by_rank], np.arange(generation + 1))
    looped = by_rank[:cuts[0]]
    steps = [(by_rank[a:b], False) for a, b in zip(cuts[:-1], cuts[1:]) if b > a]
    return steps + ([(looped, True)] if len(looped) else [])


# --- a block too large for one task ---------------------------------------

def packages_by_joins(rows: DataFrame, max_rows: int = MAX_BLOCK_ROWS,
                      slice_links: int = SLICE_LINKS) -> DataFrame:
    """The same result with no more than ``max_rows`` rows in any task's group.

    Packages come from the links alone, ``slice_links`` of them to a task at most.
    """
    with WorkTables(rows.sparkSession) as work:
        rows = work.cut(rows, "oversized-rows")
        members = rows.select("block_number", "tx_hash", "virtual_size")
        edges = work.cut(
            rows.select("block_number", F.col("tx_hash").alias("child"),
                        F.explode("parent_hashes").alias("parent"))
            .join(members.select("block_number", F.col("tx_hash").alias("parent")),
                  ["block_number", "parent"])
            .where("child <> parent").distinct(), "oversized-edges")
        roots = roots_in(work, edges.select(
            F.col("block_number").alias("unit"), F.col("child").alias("a"),
            F.col("parent").alias("b")), slice_links)
        labelled = work.keep(work.cut(
            rows.join(roots.select(F.col("unit").alias("block_number"),
                                   F.col("v").alias("tx_hash"), "root"),
                      ["block_number", "tx_hash"], "left")
            .withColumn("package_id", F.coalesce("root", "tx_hash"))
            .withColumn("unit", F.xxhash64("block_number", "package_id")), "labelled"))
        normal, oversized = split_by_group_size(labelled, "unit", max_rows)
        grouped = _by_unit(normal)
        if oversized is None:
            return grouped
        totals = oversized.groupBy("unit", "block_number", "package_id").agg(
            F.count("*").alias("package_tx_count"), F.sum("fee").alias("package_fee"),
            F.sum("virtual_size").alias("package_vsize"))
        inside = work.cut(edges.join(
            oversized.select("block_number", F.col("tx_hash").alias("child")),
            ["block_number", "child"], "left_semi"), "oversized-edges")
        above = ancestor_sums(oversized.select(*members.columns), inside)
    return grouped.unionByName(
        oversized.join(totals, ["unit", "block_number", "package_id"])
        .join(above, ["block_number", "tx_hash"])
        .select("tx_hash", "block_number", "package_id", "package_tx_count",
                "package_fee", "package_vsize",
                ratio(F.col("package_fee"), F.col("package_vsize"))
                .alias("effective_fee_rate"),
                "ancestor_count", "ancestor_vsize"))


def ancestor_sums(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Number and size of all ancestors, the member itself included.

    Members in a row, each the only child of its only parent, are one chain. Chains
    are nodes of a smaller graph: links between them leave from a last member and
    enter a first one. A node's ancestors are bits, 64 nodes to a row, and each
    round hands the bits found last on to the children, so no pair has a row of its
    own. Rounds go by the longest way between nodes, and by the logarithm of the
    longest chain. A cycle, which only malformed input has, ends like all else.
    """
    spark = members.sparkSession
    with WorkTables(spark) as work:
        places = _chain_places(members, edges, work)
        nodes, links = _chain_graph(places, edges, work)
        found = _ancestor_bits(nodes, links, work)
        sums = _sums_of_bits(found, nodes)
        own = F.col("position") + 1
        return work.keep(work.cut(
            places.join(nodes.select("block_number", F.col("tx_hash").alias("head"), "node"),
                        ["block_number", "head"])
            .join(sums, "node", "left")
            .select("block_number", "tx_hash",
                    (F.coalesce("above", F.lit(0))
                     + F.when(F.coalesce("looped", F.lit(False)), 0).otherwise(own))
                    .alias("ancestor_count"),
                    (F.coalesce("above_vsize", F.lit(0)) + F.when(
                        F.coalesce("looped", F.lit(False)), 0).otherwise(F.col("upto")))
                    .alias("ancestor_vsize")), "ancestor-sums"))


def _chain_places(members: DataFrame, edges: DataFrame, work: WorkTables) -> DataFrame:
    """(block_number, tx_hash, virtual_size, head, position, upto) of every member.

    ``upto`` is the size of the chain from its head to the member. Pointers to the
    member before double their reach each round.
    """
    block = "block_number"
    lone = edges.groupBy(block, F.col("child").alias("tx_hash")).agg(
        F.count("*").alias("n"), F.min("parent").alias("up")).where("n = 1").drop("n")
    single = edges.groupBy(block, F.col("parent").alias("up")).agg(
        F.count("*").alias("n")).where("n = 1").drop("n")
    sizes = members.select(block, F.col("tx_hash").alias("up"),
                           F.col("virtual_size").alias("size"))
    jumps = work.cut(lone.join(single, [block, "up"]).join(sizes, [block, "up"])
                     .select(block, "tx_hash", "up", F.lit(1).cast("long").alias("steps"), "size"),
                     "chains")
    for _ in range(jumps.count().bit_length() + 1):
        farther = jumps.select(block, F.col("tx_hash").alias("up"), F.col("up").alias("next"),
                               F.col("steps").alias("more"), F.col("size").alias("more_size"))
        jumped = work.cut(jumps.join(farther, [block, "up"], "left").select(
            block, "tx_hash", F.coalesce("next", "up").alias("up"),
            (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"),
            (F.col("size") + F.coalesce("more_size", F.lit(0))).alias("size"),
            F.col("next").isNotNull().alias("moved")), "chains")
        jumps = jumped.drop("moved")
        if jumped.where("moved").isEmpty():
            break
    # What still points inside a chain goes round in a circle: nodes of their own.
    heads = jumps.join(jumps.select(block, F.col("tx_hash").alias("up")), [block, "up"],
                       "left_anti")
    return work.cut(members.join(heads, [block, "tx_hash"], "left").select(
        block, "tx_hash", "virtual_size", F.coalesce("up", "tx_hash").alias("head"),
        F.coalesce("steps", F.lit(0)).alias("position"),
        (F.coalesce("size", F.lit(0)) + F.col("virtual_size")).alias("upto")), "places")


def _chain_graph(places: DataFrame, edges: DataFrame, work: WorkTables
                 ) -> tuple[DataFrame, DataFrame]:
    """Chains as numbered nodes with their length and size, and (node, child) links."""
    block = "block_number"
    nodes = work.cut(
        places.groupBy(block, F.col("head").alias("tx_hash")).agg(
            F.count("*").alias("length"), F.sum("virtual_size").alias("size"))
        .repartitionByRange(block, "tx_hash").sortWithinPartitions(block, "tx_hash")
        .withColumn("node", F.monotonically_increasing_id()), "nodes")
    numbered = places.join(nodes.select(block, F.col("tx_hash").alias("head"), "node"),
                           [block, "head"])
    ends = edges.join(numbered.select(block, F.col("tx_hash").alias("parent"), "node"),
                      [block, "parent"])
    links = ends.join(nodes.select(block, F.col("tx_hash").alias("child"),
                                   F.col("node").alias("child_node")), [block, "child"])
    # A link along a chain has no head at its lower end, so it found no node above.
    return nodes, work.cut(links.select("node", "child_node").distinct(), "node-links")


def _ancestor_bits(nodes: DataFrame, links: DataFrame, work: WorkTables) -> DataFrame:
    """(node, part, bits): the nodes above each, those numbered 64 part + bit."""
    part, bit = F.shiftright("node", 6), F.col("node").bitwiseAND(F.lit(63)).cast("int")
    fresh = nodes.select("node", part.alias("part"),
                         F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bits"))
    found = None
    while True:
        handed = (fresh.join(links, "node").groupBy(F.col("child_node").alias("node"), "part")
                  .agg(F.bit_or("bits").alias("bits")))
        if found is not None:
            before = found.withColumnRenamed("bits", "had")
            handed = (handed.join(before, ["node", "part"], "left")
                      .withColumn("bits", F.col("bits").bitwiseAND(
                          F.bitwise_not(F.coalesce("had", F.lit(0)))))
                      .where("bits <> 0").drop("had"))
        fresh = work.cut(handed, "new-bits")
        if fresh.isEmpty():
            return fresh if found is None else found
        found = fresh if found is None else work.cut(
            found.unionByName(fresh).groupBy("node", "part").agg(F.bit_or("bits").alias("bits")),
            "bits")


def _sums_of_bits(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, above, above_vsize, looped): totals of the nodes whose bits are set."""
    packed = nodes.groupBy(F.shiftright("node", 6).alias("part")).agg(F.collect_list(F.struct(
        F.col("node").bitwiseAND(F.lit(63)).cast("int").alias("bit"), "length", "size"))
        .alias("packed"))  # 64 at most
    total = F.expr("""aggregate(packed, struct(0L AS n, 0L AS size), (t, x) ->
        IF(getbit(bits, x.bit) = 1, struct(t.n + x.length AS n, t.size + x.size AS size), t))""")
    itself = (F.col("part") == F.shiftright("node", 6)) & (
        F.expr("getbit(bits, CAST(node & 63 AS INT))") == 1)
    return (found.join(packed, "part").select("node", total.alias("t"), itself.alias("itself"))
            .groupBy("node").agg(F.sum("t.n").alias("above"), F.sum("t.size").alias("above_vsize"),
                                 F.bool_or("itself").alias("looped")))
