"""Space sold below the going rate in full blocks, and what it was worth.

Facts meet blocks once, in ``apply_low_fee``, by an unhinted equi-join on the
block number: small block tables are broadcast by the planner, large ones
shuffled, with skewed blocks split at run time. From then on every transaction
carries its block's columns, which equal values in a row make almost free to
store, and nothing that follows joins or shuffles facts again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feefloor.functions.measures import lower_band_sats, upper_band_sats
from feefloor.policy import Policy, headline_label, labels, sensitivity_label

BLOCK_COLUMNS = ("pool_name", "pool_source", "floor_fee_rate", "median_fee_rate",
                 "weight", "is_full")
#: Block column -> its name among the columns of a transaction.
CARRIED = {c: "block_weight" if c == "weight" else c for c in BLOCK_COLUMNS}


def tx_with_block(txs: DataFrame, blocks: DataFrame, how: str = "inner",
                  columns: tuple[str, ...] = BLOCK_COLUMNS) -> DataFrame:
    return txs.join(blocks.select("block_number", *columns), "block_number", how)


def low_fee_tests(policy: Policy = Policy()) -> dict[str, Column]:
    """low_fee_30/50/70 over joined facts: strictly below s x floor."""
    c = F.col
    open_to_all = c("is_full") & ~c("is_nonrelayable") & ~c("is_coinbase")
    return {f"low_fee_{sensitivity_label(s)}": F.coalesce(
        open_to_all & (c("effective_fee_rate") < F.lit(float(s)) * c("floor_fee_rate")),
        F.lit(False)) for s in policy.sensitivities}


def apply_low_fee(txs: DataFrame, blocks: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Set the flags and carry the block's columns.

    Both stay NULL for a transaction without a block row.
    """
    carried = blocks.select("block_number", F.lit(True).alias("_block"),
                            *[F.col(c).alias(name) for c, name in CARRIED.items()])
    return (txs.drop(*CARRIED.values()).join(carried, "block_number", "left")
            .withColumns({name: F.when(F.col("_block"), test)
                          for name, test in low_fee_tests(policy).items()})
            .drop("_block"))


def bands() -> dict[str, Column]:
    c = F.col
    return {
        "lower_band_sats": lower_band_sats(
            c("floor_fee_rate"), c("effective_fee_rate"), c("virtual_size")),
        "upper_band_sats": upper_band_sats(c("median_fee_rate"), c("virtual_size")),
    }


def low_fee_txs(txs: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Low-fee transactions at the widest threshold, with block and bands."""
    names = labels(policy)
    return (txs.where(F.col(f"low_fee_{names[-1]}")).withColumns(bands()).select(
        "tx_hash", "block_number", "block_timestamp", "block_month", "pool_name",
        "pool_source", "fee", "virtual_size", "raw_fee_rate", "effective_fee_rate",
        "package_id", "package_tx_count", "floor_fee_rate", "median_fee_rate",
        "block_weight", *[f"low_fee_{s}" for s in names],
        "lower_band_sats", "upper_band_sats"))


def top_low_fee(low_fee: DataFrame, k: int = 5_000, policy: Policy = Policy()) -> DataFrame:
    """The k most valuable low-fee transactions at the headline threshold; ties by hash."""
    return (low_fee.where(F.col(f"low_fee_{headline_label(policy)}"))
            .orderBy(F.desc("upper_band_sats"), "tx_hash").limit(k))
