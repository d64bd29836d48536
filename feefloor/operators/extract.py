"""One pass over raw transactions, and the monthly on-chain fee."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feefloor.functions import scripts
from feefloor.functions.measures import ratio, version_or_default
from feefloor.policy import Policy


def tx_base(raw: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Everything later steps need, as one projection over one scan."""
    outs = raw.select(
        F.col("hash").alias("tx_hash"),
        "block_number",
        "block_timestamp",
        F.col("block_timestamp_month").alias("block_month"),
        "is_coinbase",
        F.col("fee").cast("long").alias("fee"),
        F.col("virtual_size").cast("long").alias("virtual_size"),
        F.col("size").cast("long").alias("serialized_size"),
        version_or_default(F.col("version"), policy.version_min).cast("long").alias("version"),
        scripts.input_hashes(F.col("inputs")).alias("input_hashes"),
        scripts.coinbase_addresses(F.col("is_coinbase"), F.col("outputs"))
        .alias("coinbase_addresses"),
        scripts.output_stats(F.col("outputs"), policy).alias("outs"),
        scripts.input_stats(F.col("inputs")).alias("ins"))
    return outs.select(
        "tx_hash", "block_number", "block_timestamp", "block_month", "is_coinbase", "fee",
        "virtual_size", "serialized_size", "version", "input_hashes", "coinbase_addresses",
        "outs.*", "ins.*")


def onchain_monthly_fee(base: DataFrame) -> DataFrame:
    """Transactions, blocks, fees and rate per month, coinbases left out.

    Sums are taken per block first, so the distinct count of blocks is a plain
    count and rows shrink before the first shuffle.
    """
    per_block = (base.where(~F.col("is_coinbase"))
                 .groupBy("block_month", "block_number")
                 .agg(F.count("*").alias("txs"), F.sum("fee").alias("fee_sats"),
                      F.sum("virtual_size").alias("vbytes")))
    return (per_block.groupBy("block_month")
            .agg(F.sum("txs").alias("txs"), F.count("block_number").alias("blocks"),
                 F.sum("fee_sats").alias("fee_sats"), F.sum("vbytes").alias("vbytes"))
            .withColumn("fee_rate_sat_vb", ratio(F.col("fee_sats"), F.col("vbytes"))))
