"""Parent/child links between transactions confirmed in the same block.

All joins and groupings are keyed on (block_number, tx_hash), never on the
block alone, so one huge block still spreads over every task. A parent spent
by very many children makes one hot key on the child side of the edge join
only; that join is a plain equi-join the engine can split at run time. Hashes
are moved packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feefloor.functions.hashes import pack, packed, unpack, unpacked

KEY = ["block_number", "tx_hash"]


def in_block_edges(txs: DataFrame, truc_version: int = 3) -> DataFrame:
    """child -> parent rows; needs raw_fee_rate and min_relay_rate on ``txs``."""
    return _edges(txs, truc_version).withColumns(
        {c: unpack(F.col(c)) for c in ("child_hash", "parent_hash")}).drop("pays")


def _edges(txs: DataFrame, truc_version: int) -> DataFrame:
    """``in_block_edges`` with packed hashes, and whether the child pays its own way."""
    truc = F.col("version") == truc_version
    spends = (txs.where(~F.col("is_coinbase"))
              .select("block_number", pack(F.col("tx_hash")).alias("child_hash"),
                      F.col("raw_fee_rate").alias("child_rate"),
                      F.col("min_relay_rate").alias("child_min_relay"),
                      (F.col("raw_fee_rate") >= F.col("min_relay_rate")).alias("pays"),
                      truc.alias("child_truc"),
                      F.explode("input_hashes").alias("parent_hash"))
              .withColumn("parent_hash", pack(F.col("parent_hash"))))
    parents = txs.select("block_number", pack(F.col("tx_hash")).alias("parent_hash"),
                         truc.alias("parent_truc"))
    return (spends.join(parents, ["block_number", "parent_hash"])
            .select("block_number", "child_hash", "parent_hash", "child_rate",
                    "child_min_relay",
                    (F.col("child_truc") != F.col("parent_truc")).alias("truc_version_clash"),
                    "pays"))


def parent_agg(edges: DataFrame) -> DataFrame:
    """Per child: its distinct parents, and whether any clashes in version."""
    return (edges.groupBy("block_number", F.col("child_hash").alias("tx_hash"))
            .agg(F.array_sort(F.collect_set("parent_hash")).alias("parent_hashes"),
                 F.bool_or("truc_version_clash").alias("has_truc_version_clash")))


def child_agg(edges: DataFrame) -> DataFrame:
    """Per parent: its number of children, and whether any pays its own way."""
    return (edges.groupBy("block_number", F.col("parent_hash").alias("tx_hash"))
            .agg(F.count("*").alias("child_count"),
                 F.bool_or(F.col("child_rate") >= F.col("child_min_relay"))
                 .alias("has_paying_child")))


def relatives(edges: DataFrame) -> DataFrame:
    """Both views of an edge in one grouping: one shuffle where the two
    aggregates above would take two, and one join to the facts, not two."""
    pays = F.col("child_rate") >= F.col("child_min_relay")
    return _readable(_relatives(edges.withColumns({"pays": pays} | {
        c: pack(F.col(c)) for c in ("child_hash", "parent_hash")})))


def _relatives(edges: DataFrame) -> DataFrame:
    """``relatives`` with packed hashes, from edges of ``_edges``."""
    none = F.lit(None)
    messages = F.array(
        F.struct(F.col("child_hash").alias("tx_hash"), F.col("parent_hash").alias("parent"),
                 F.col("truc_version_clash").alias("clash"),
                 none.cast("boolean").alias("pays"), F.lit(0).alias("child")),
        F.struct(F.col("parent_hash").alias("tx_hash"), none.cast("binary").alias("parent"),
                 none.cast("boolean").alias("clash"),
                 "pays", F.lit(1).alias("child")))
    return (edges.select("block_number", F.inline(messages))
            .groupBy(*KEY)
            .agg(F.collect_set("parent").alias("parent_hashes"),
                 F.bool_or("clash").alias("has_truc_version_clash"),
                 F.sum("child").alias("child_count"),
                 F.bool_or("pays").alias("has_paying_child")))


def _readable(links: DataFrame) -> DataFrame:
    return unpacked(links).withColumn("parent_hashes", F.array_sort("parent_hashes"))


def linked(rated: DataFrame, truc_version: int = 3) -> DataFrame:
    """``with_relatives`` of the transactions' own links; hashes are unpacked at the end."""
    links = _relatives(_edges(rated, truc_version))
    return _with_defaults(_readable(packed(rated.drop("input_hashes")).join(links, KEY, "left")))


def with_relatives(txs: DataFrame, links: DataFrame) -> DataFrame:
    """Attach the link aggregates; transactions without relatives are kept."""
    return _with_defaults(txs.join(links, KEY, "left"))


def _with_defaults(joined: DataFrame) -> DataFrame:
    no_parents = F.array().cast("array<string>")
    return joined.withColumns({
        "parent_hashes": F.coalesce("parent_hashes", no_parents),
        "child_count": F.coalesce("child_count", F.lit(0).cast("long")),
        "has_paying_child": F.coalesce("has_paying_child", F.lit(False)),
        "has_truc_version_clash": F.coalesce("has_truc_version_clash", F.lit(False)),
    }).withColumns({
        "has_in_block_parent": F.size("parent_hashes") > 0,
        "in_package": (F.size("parent_hashes") > 0) | (F.col("child_count") > 0),
    })
