"""Which pool mined a block: by coinbase tag first, then by payout address."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feefloor.functions.measures import block_date, block_month, coinbase_text


#: Characters of a tag that it is filed under.
PIECE = 4


def tag_lookup(pools: DataFrame) -> DataFrame:
    """Lower-cased tag -> pool; the first pool by name keeps a shared tag."""
    return (pools.select("pool_name", F.explode("tags").alias("t"))
            .groupBy(F.lower("t").alias("tag")).agg(F.min("pool_name").alias("pool_name")))


def address_lookup(pools: DataFrame) -> DataFrame:
    """Payout address -> its only owner. Empty and spaced texts are
    placeholders, and an address of several pools attributes nothing."""
    return (pools.select("pool_name", F.explode("addresses").alias("address"))
            .where(~F.contains("address", F.lit(" ")) & (F.col("address") != ""))
            .groupBy("address")
            .agg(F.min("pool_name").alias("pool_name"), F.max("pool_name").alias("other"))
            .where("pool_name = other").drop("other"))


def pool_id_lookup(pools: DataFrame) -> DataFrame:
    """Id -> pool of the pool table. Pools are stored by name, so of those that share
    an id the last by name has it; ``sources.pools.parse_pool_ids`` reads a list as it
    is published, where the last in the list has it."""
    return (pools.where("pool_id IS NOT NULL")
            .groupBy("pool_id").agg(F.max("pool_name").alias("pool_name")))


def block_rows(headers: DataFrame) -> DataFrame:
    """Header columns under the names of the block table."""
    return headers.select(
        F.col("number").alias("block_number"), F.col("hash").alias("block_hash"),
        F.col("timestamp").alias("block_timestamp"),
        block_date(F.col("timestamp")).alias("block_date"),
        block_month(F.col("timestamp")).alias("block_month"),
        "weight", F.col("size").alias("block_size"), "transaction_count",
        coinbase_text(F.col("coinbase_param")).alias("coinbase_text"))


def coinbase_of_block(base: DataFrame) -> DataFrame:
    """One payout address array per block that has a coinbase."""
    return (base.where("is_coinbase").groupBy("block_number")
            .agg(F.min_by("coinbase_addresses", "tx_hash").alias("coinbase_addresses")))


def tag_matches(blocks: DataFrame, tags: DataFrame) -> DataFrame:
    """(block_number, pool_name, tag) for every tag inside the coinbase text.

    A substring test would pair every block with every tag. Instead each text is
    cut into its pieces of 1 to ``PIECE`` characters, the same for any list of tags.
    A tag is filed under its first ``PIECE`` characters, or all of a shorter one,
    and met by an equi-join on these; the rest of it is looked for in the text.
    """
    filed = tags.where("tag <> ''").select(
        "pool_name", "tag", F.substring("tag", 1, PIECE).alias("piece"))
    starts = F.sequence(F.lit(1), F.length("text"))
    cut = F.flatten(F.transform(starts, lambda p: F.transform(
        F.sequence(F.lit(1), F.least(F.lit(PIECE), F.length("text") - p + 1)),
        lambda n: F.substring(F.col("text"), p, n))))
    texts = (blocks.select("block_number", F.lower("coinbase_text").alias("text"))
             .where("text <> ''"))
    return (texts.select("block_number", "text", F.explode(F.array_distinct(cut)).alias("piece"))
            .join(filed, "piece").where(F.contains("text", "tag"))
            .select("block_number", "pool_name", "tag"))


def attribute_by_tag(blocks: DataFrame, tags: DataFrame) -> DataFrame:
    """Best tag per block: the longest, then the first pool by name."""
    best = F.min(F.struct((-F.length("tag")).alias("shortness"), "pool_name"))
    return (tag_matches(blocks, tags).groupBy("block_number")
            .agg(best.alias("b")).select("block_number", "b.pool_name"))


def attribute_by_address(coinbase: DataFrame, addresses: DataFrame) -> DataFrame:
    """First pool by name owning one of the block's payout addresses."""
    paid = coinbase.select("block_number", F.explode("coinbase_addresses").alias("address"))
    return (paid.join(addresses, "address").groupBy("block_number")
            .agg(F.min("pool_name").alias("pool_name")))


def attribute_pools(headers: DataFrame, base: DataFrame, pools: DataFrame) -> DataFrame:
    """The block table: header facts, pool name, and where the name came from."""
    blocks = block_rows(headers)
    by_tag = attribute_by_tag(blocks, tag_lookup(pools)).withColumnRenamed(
        "pool_name", "tag_pool")
    by_address = attribute_by_address(
        coinbase_of_block(base), address_lookup(pools)).withColumnRenamed(
        "pool_name", "address_pool")
    return (blocks.drop("coinbase_text")
            .join(by_tag, "block_number", "left")
            .join(by_address, "block_number", "left")
            .withColumn("pool_name",
                        F.coalesce("tag_pool", "address_pool", F.lit("Unknown")))
            .withColumn("pool_source",
                        F.when(F.col("tag_pool").isNotNull(), "coinbase_tag")
                        .when(F.col("address_pool").isNotNull(), "payout_address")
                        .otherwise("unattributed"))
            .drop("tag_pool", "address_pool"))


def pool_list_diff(current: DataFrame, fresh: DataFrame) -> DataFrame:
    """(pool_name, change, has_id): what becomes of every pool of either list.

    'new' and 'not upstream' are in one list only; of pools in both, 'tags', 'addresses'
    or 'tags and addresses' says what differs, whatever the order, and 'same' nothing.
    ``has_id`` tells whether the fresh list gives an id.
    """
    def side(pools: DataFrame, name: str) -> DataFrame:
        return pools.groupBy("pool_name").agg(F.max(F.struct(
            F.array_sort(F.array_distinct("tags")).alias("tags"),
            F.array_sort(F.array_distinct("addresses")).alias("addresses"),
            F.col("pool_id").isNotNull().alias("has_id"))).alias(name))

    both = side(current, "old").join(side(fresh, "new"), "pool_name", "full_outer")
    tags = ~F.col("old.tags").eqNullSafe(F.col("new.tags"))
    addresses = ~F.col("old.addresses").eqNullSafe(F.col("new.addresses"))
    change = (F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "not upstream")
              .when(tags & addresses, "tags and addresses").when(tags, "tags")
              .when(addresses, "addresses").otherwise("same"))
    return both.select("pool_name", change.alias("change"),
                       F.coalesce("new.has_id", F.lit(False)).alias("has_id"))


def pool_list_counts(diff: DataFrame) -> DataFrame:
    """One row: pools upstream, in use and with an id, and how many changed how."""
    change = F.col("change")
    return diff.agg(
        F.count_if(change != "not upstream").alias("upstream"),
        F.count_if(change != "new").alias("in_use"), F.count_if("has_id").alias("with_id"),
        F.count_if(change == "new").alias("new"),
        F.count_if(change == "not upstream").alias("not_upstream"),
        F.count_if(change.contains("tags")).alias("tags_changed"),
        F.count_if(change.contains("addresses")).alias("addresses_changed"))
