"""The relay verdict: which default-node rules a transaction breaks on its day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feefloor.functions.measures import any_of, max_nonwitness_size, raw_fee_rate
from feefloor.operators.linkage import linked
from feefloor.policy import Policy, before, policy_as_of

# Rules one transaction and its direct relatives decide. The ancestor rule is
# added once packages exist.
DIRECT_REASONS = (
    "nonrelay_nonstandard_script", "nonrelay_bare_multisig", "nonrelay_op_return",
    "nonrelay_multi_op_return", "nonrelay_dust", "nonrelay_version", "nonrelay_truc",
    "nonrelay_oversized", "nonrelay_undersized", "nonrelay_scriptsig_size",
    "nonrelay_scriptsig_nonpush", "nonrelay_sub_minrelay")
ANCESTOR_REASON = "nonrelay_ancestor_limit"
REASONS = DIRECT_REASONS + (ANCESTOR_REASON,)


def reason_columns(policy: Policy = Policy()) -> dict[str, Column]:
    """One boolean per direct rule; a NULL test counts as not broken."""
    c = F.col
    ts = c("block_timestamp")
    version, vsize = c("version"), c("virtual_size")

    ephemeral = (F.coalesce(c("fee"), F.lit(0)) == 0) & (c("child_count") > 0)
    dust = F.when(
        before(ts, policy.dust_change),
        c("dust_outputs_excl_multisig") > c("max_dust_outputs"),
    ).otherwise(
        (c("dust_outputs") > c("max_dust_outputs")) | ((c("dust_outputs") > 0) & ~ephemeral))
    is_truc = version == policy.truc_version
    truc = ~before(ts, policy.truc_change) & (
        (is_truc & (vsize > policy.truc_max_vsize))
        | (is_truc & c("has_in_block_parent") & (vsize > policy.truc_child_max_vsize))
        | c("has_truc_version_clash"))
    tests = {
        "nonrelay_nonstandard_script": c("nonstandard_outputs") > 0,
        "nonrelay_bare_multisig": c("bare_multisig_max_n") > policy.multisig_max_n,
        "nonrelay_op_return": c("datacarrier_bytes") > c("datacarrier_limit"),
        "nonrelay_multi_op_return":
            before(ts, policy.datacarrier_change) & (c("op_return_count") > 1),
        "nonrelay_dust": dust,
        "nonrelay_version":
            (version < policy.version_min) | (version > c("max_standard_version")),
        "nonrelay_truc": truc,
        "nonrelay_oversized": vsize > policy.max_standard_vsize,
        "nonrelay_undersized": c("max_nonwitness_size") < policy.min_nonwitness_size,
        "nonrelay_scriptsig_size": c("max_scriptsig_bytes") > policy.max_scriptsig_size,
        "nonrelay_scriptsig_nonpush": c("opens_with_nonpush_opcode"),
        "nonrelay_sub_minrelay":
            (c("raw_fee_rate") < c("min_relay_rate")) & ~c("has_paying_child"),
    }
    return {name: F.coalesce(~c("is_coinbase") & test, F.lit(False))
            for name, test in tests.items()}


def with_rates(base: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Own fee rate, non-witness size bound, and the limits of the day."""
    return policy_as_of(base, policy).withColumns({
        "raw_fee_rate": raw_fee_rate(F.col("fee"), F.col("virtual_size")),
        "max_nonwitness_size": max_nonwitness_size(
            F.col("virtual_size"), F.col("serialized_size"), policy.min_nonwitness_size),
    })


TX_COLUMNS = (
    "tx_hash", "block_number", "block_timestamp", "block_month", "is_coinbase", "fee",
    "virtual_size", "serialized_size", "version", "raw_fee_rate", "min_relay_rate",
    "bare_multisig_max_n", "op_return_count", "op_return_max_bytes",
    "op_return_total_bytes", "nonstandard_outputs", "dust_outputs", "max_scriptsig_bytes",
    "coinbase_addresses", "parent_hashes", "child_count", "has_paying_child",
    "has_in_block_parent")


def relay_reasons(base: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """The transaction table: facts, links, reasons, and single-transaction
    packages priced at their own rate.

    ``base`` may be a projection of the raw table: links read a few of its columns
    again, and only the facts its outputs and scripts.
    """
    judged = linked(with_rates(base, policy), policy.truc_version).withColumns(
        reason_columns(policy))
    alone = ~F.col("in_package") & ~F.col("is_coinbase")
    return judged.select(
        *TX_COLUMNS, *DIRECT_REASONS,
        F.lit(False).alias(ANCESTOR_REASON),
        any_of([F.col(r) for r in DIRECT_REASONS]).alias("is_nonrelayable"),
        "in_package",
        F.when(alone, F.col("raw_fee_rate")).alias("effective_fee_rate"),
        F.when(alone, F.col("tx_hash")).alias("package_id"),
        F.when(alone, F.lit(1).cast("long")).alias("package_tx_count"))


def in_package_set(txs: DataFrame) -> DataFrame:
    """The rows grouping can re-price: they have a relative in their block."""
    return (txs.where(F.col("in_package") & ~F.col("is_coinbase"))
            .select("tx_hash", "block_number", "block_month", "fee", "virtual_size",
                    "parent_hashes"))


def block_range(working_set: DataFrame) -> tuple[int, int] | None:
    """First and last block of the working set; None when it is empty."""
    row = working_set.agg(F.min("block_number"), F.max("block_number")).first()
    return None if row[0] is None else (row[0], row[1])


def read_in_package(working_set: DataFrame, low: int, high: int) -> DataFrame:
    """Working set of a block range; the range reaches the file scan."""
    return working_set.where(F.col("block_number").between(low, high))
