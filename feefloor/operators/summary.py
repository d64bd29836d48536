"""Monthly, per-pool and threshold-grid summaries, and their roll-ups.

All three read one small table of partial sums, made in a single pass over the
facts: a few rows for each block, additive, and finer than any of them needs.
Sums combine inside every map task before the shuffle, so a month or pool with a
third of all rows costs the reducers no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feefloor.functions.measures import (full_and_priced, ratio, sum_if, sats_to_btc,
                                         vbytes_to_gvb)
from feefloor.operators.floor import fullness_at
from feefloor.operators.lowfee import bands
from feefloor.operators.relay import REASONS
from feefloor.policy import Policy, headline_label, labels

PARTIAL_KEYS = ("block_month", "block_number", "pool_name", "has_block", "is_full", "priced",
                "is_nonrelayable", "price_step")


def _short(reason: str) -> str:
    return f"{reason.removeprefix('nonrelay_')}_txs"


def block_partials(txs: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Additive sums of all but the coinbases, per block and kind of transaction.

    ``price_step`` counts the sensitivities at which a relayable, priced transaction
    is not low-fee: it is so at the k-th, from the strictest, if the step is k at most.
    """
    rate, floor = F.col("effective_fee_rate"), F.col("floor_fee_rate")
    steps = [(rate >= F.lit(float(s)) * floor).cast("int") for s in sorted(policy.sensitivities)]
    step = F.when(~F.col("is_nonrelayable"), sum(steps[1:], steps[0]))
    facts = txs.where(~F.col("is_coinbase")).withColumns({
        **bands(), "price_step": step, "priced": floor.isNotNull(),
        "has_block": F.col(f"low_fee_{labels(policy)[-1]}").isNotNull()})
    return facts.groupBy(*PARTIAL_KEYS).agg(
        F.count("*").alias("txs"), F.sum("virtual_size").alias("vbytes"),
        F.sum("lower_band_sats").alias("lower_band_sats"),
        F.sum("upper_band_sats").alias("upper_band_sats"),
        *[F.count_if(r).alias(_short(r)) for r in REASONS])


def _low(k: int) -> Column:
    """Rows of ``block_partials`` that are low-fee at the k-th sensitivity."""
    return F.coalesce(F.col("is_full") & (F.col("price_step") <= k), F.lit(False))


def _counted() -> Column:
    return F.col("is_full") & F.col("priced") & ~F.col("is_nonrelayable")


def _sats(flag: Column, band: str) -> Column:
    return F.sum(F.when(flag, F.coalesce(f"{band}_band_sats", F.lit(0.0))).otherwise(0.0))


def monthly_summary(partials: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """All, full-block, low-fee and non-relayable space per month.

    Counts and sums default to 0; a share is NULL when its month has no full
    priced space or no low-fee row at the widest threshold.
    """
    names = labels(policy)
    nonrelay = F.col("is_nonrelayable")
    aggs = [F.sum("txs").alias("all_txs"), F.sum("vbytes").alias("all_vbytes"),
            F.sum(F.when(_counted(), F.col("vbytes"))).alias("full")]
    for k, s in enumerate(names):
        aggs += [sum_if(_low(k), F.col("txs")).alias(f"low_fee_txs_{s}"),
                 sum_if(_low(k), F.col("vbytes")).alias(f"low_fee_vbytes_{s}"),
                 *[_sats(_low(k), band).alias(f"{band}_band_sats_{s}")
                   for band in ("lower", "upper")]]
    aggs += [sum_if(nonrelay, F.col("txs")).alias("nonrelayable_txs"),
             sum_if(nonrelay, F.col("vbytes")).alias("nonrelayable_vbytes")]
    aggs += [F.sum(_short(r)).alias(_short(r)) for r in REASONS]
    months = partials.groupBy("block_month").agg(*aggs)

    any_low = F.col(f"low_fee_txs_{names[-1]}") > 0
    return months.select(
        "block_month", "all_txs", "all_vbytes",
        F.coalesce("full", F.lit(0).cast("long")).alias("full_block_vbytes"),
        *[f"low_fee_txs_{s}" for s in names], *[f"low_fee_vbytes_{s}" for s in names],
        *[F.when(any_low, ratio(F.col(f"low_fee_vbytes_{s}"), F.col("full")))
          .alias(f"private_vbytes_share_{s}") for s in names],
        *[f"{band}_band_sats_{s}" for s in names for band in ("lower", "upper")],
        "nonrelayable_txs", "nonrelayable_vbytes",
        ratio(F.col("nonrelayable_vbytes"), F.col("all_vbytes"))
        .alias("nonrelayable_vbytes_share"),
        *[_short(r) for r in REASONS])


def pool_summary(partials: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Low-fee space and value per pool and month.

    Grouped by block first, so that the distinct count of blocks is a plain count.
    """
    names, head = labels(policy), headline_label(policy)
    at = names.index(head)
    parts = {
        "vbytes": F.sum("vbytes"),
        "full_block_vbytes": sum_if(_counted(), F.col("vbytes")),
        f"low_fee_txs_{head}": sum_if(_low(at), F.col("txs")),
        **{f"low_fee_vbytes_{s}": sum_if(_low(k), F.col("vbytes")) for k, s in enumerate(names)},
        **{f"{band}_band_sats_{head}": _sats(_low(at), band) for band in ("lower", "upper")},
    }
    per_block = partials.where("has_block").groupBy(
        "pool_name", "block_month", "block_number").agg(
        *[agg.alias(name) for name, agg in parts.items()])
    pools = per_block.groupBy("pool_name", "block_month").agg(
        F.count("*").alias("blocks"), *[F.sum(name).alias(name) for name in parts])
    return pools.select(
        "pool_name", "block_month", "blocks", "vbytes", "full_block_vbytes",
        f"low_fee_txs_{head}", *[f"low_fee_vbytes_{s}" for s in names],
        ratio(F.col(f"low_fee_vbytes_{head}"), F.col("full_block_vbytes"))
        .alias(f"low_fee_share_of_full_{head}"),
        f"lower_band_sats_{head}", f"upper_band_sats_{head}")


def grid_blocks(blocks: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Thresholds x blocks: one row per cell and block, with its own fullness.

    The grid is a constant of the policy, so it is exploded, not joined.
    """
    full = fullness_at(blocks, policy.fullness_grid, policy)
    cells = F.array(*[
        F.struct(F.lit(float(s)).alias("sensitivity"), F.lit(w).cast("long").alias("full_weight"),
                 F.col(f"is_full_{w}").alias("is_full"))
        for s in policy.sensitivities for w in policy.fullness_grid])
    return (full.select("block_number", F.inline(cells))
            .join(blocks.select("block_number", "floor_fee_rate", "median_fee_rate"),
                  "block_number"))


def low_fee_sensitivity(partials: DataFrame, blocks: DataFrame, policy: Policy = Policy()
                        ) -> DataFrame:
    """Low-fee space per month over sensitivities x fullness weights.

    A block counts as full at a run of weights from the lightest, a transaction as
    low-fee at a run of sensitivities up to the widest. So each partial sum needs two
    numbers, and is handed to the cells of the grid after all sums are made.
    """
    weights, sensitivities = sorted(policy.fullness_grid), sorted(policy.sensitivities)
    full = fullness_at(blocks, tuple(weights), policy)
    reached = [F.coalesce(F.col(f"is_full_{w}"), F.lit(False)).cast("int") for w in weights]
    full = full.select("block_number", sum(reached[1:], reached[0]).alias("full_steps"))
    measures = ("txs", "vbytes", "lower_band_sats", "upper_band_sats")
    sums = (partials.where("has_block AND priced AND NOT is_nonrelayable")
            .join(full.where("full_steps > 0"), "block_number")
            .groupBy("block_month", "full_steps", "price_step")
            .agg(*[F.sum(m).alias(m) for m in measures]))
    cells = F.array(*[F.struct(
        F.lit(float(s)).alias("sensitivity"), F.lit(w).cast("long").alias("full_weight"),
        F.lit(j).alias("k"), F.lit(i).alias("at"))
        for i, w in enumerate(weights) for j, s in enumerate(sensitivities)])
    low = F.coalesce(F.col("price_step") <= F.col("k"), F.lit(False))
    grid = (sums.select("*", F.inline(cells)).where("at < full_steps")
            .groupBy("block_month", "sensitivity", "full_weight").agg(
                sum_if(low, F.col("txs")).alias("low_fee_txs"),
                sum_if(low, F.col("vbytes")).alias("low_fee_vbytes"),
                F.sum("vbytes").alias("full_block_vbytes"),
                *[_sats(low, band).alias(f"{band}_band_sats") for band in ("lower", "upper")]))
    return grid.select(
        "block_month", "sensitivity", "full_weight", "low_fee_txs", "low_fee_vbytes",
        "full_block_vbytes",
        ratio(F.col("low_fee_vbytes"), F.col("full_block_vbytes")).alias("low_fee_share"),
        "lower_band_sats", "upper_band_sats")


def headline(monthly: DataFrame, sensitivity: str = headline_label(Policy())) -> DataFrame:
    """Totals over all months at one sensitivity; the share from the sums."""
    s = sensitivity
    total = monthly.agg(
        F.min("block_month").alias("window_start"), F.max("block_month").alias("window_end"),
        F.countDistinct("block_month").alias("months"),
        *[F.sum(c).alias(c) for c in (
            f"low_fee_txs_{s}", f"low_fee_vbytes_{s}", "full_block_vbytes",
            f"lower_band_sats_{s}", f"upper_band_sats_{s}", "nonrelayable_txs",
            "nonrelayable_vbytes")])
    return total.select(
        "window_start", "window_end", "months", F.lit(f"0.{s}").alias("sensitivity"),
        F.col(f"low_fee_txs_{s}").alias("low_fee_txs"),
        F.col(f"low_fee_vbytes_{s}").alias("low_fee_vbytes"),
        vbytes_to_gvb(F.col(f"low_fee_vbytes_{s}")).alias("low_fee_gvb"),
        "full_block_vbytes",
        F.round(ratio(F.col(f"low_fee_vbytes_{s}"), F.col("full_block_vbytes")), 6)
        .alias("share_of_full_block_space"),
        sats_to_btc(F.col(f"lower_band_sats_{s}"), 4).alias("lower_band_btc"),
        sats_to_btc(F.col(f"upper_band_sats_{s}"), 4).alias("upper_band_btc"),
        "nonrelayable_txs", "nonrelayable_vbytes")


def sensitivity_totals(grid: DataFrame) -> DataFrame:
    """The grid over all months; shares are recomputed, never summed."""
    sums = ("low_fee_txs", "low_fee_vbytes", "full_block_vbytes", "lower_band_sats",
            "upper_band_sats")
    return (grid.groupBy("sensitivity", "full_weight")
            .agg(*[F.sum(c).alias(c) for c in sums])
            .withColumn("low_fee_share",
                        ratio(F.col("low_fee_vbytes"), F.col("full_block_vbytes"))))


def top_pools(pools: DataFrame, n: int = 12, policy: Policy = Policy()) -> DataFrame:
    """Pools with most low-fee space; the share is of all their own space."""
    low = f"low_fee_vbytes_{headline_label(policy)}"
    return (pools.groupBy("pool_name")
            .agg(F.sum(low).alias(low), F.sum("vbytes").alias("vbytes"))
            .withColumn("share_of_own_space", F.coalesce(
                ratio(F.col(low), F.col("vbytes")), F.lit(0.0)))
            .orderBy(F.desc(low), "pool_name").limit(n))


def monthly_pool_shares(blocks: DataFrame, months: int | None = 12, top: int = 12
                        ) -> DataFrame:
    """Share of blocks per pool in each of the latest months."""
    counts = blocks.groupBy("block_month", "pool_name").agg(F.count("*").alias("blocks"))
    month = Window.partitionBy("block_month")
    # One row per month and pool by now, so the month ranking is over few rows.
    ranked = counts.withColumns({
        "share": ratio(F.col("blocks"), F.sum("blocks").over(month)),
        "place": F.row_number().over(month.orderBy(F.desc("blocks"), "pool_name")),
    })
    if months:
        latest = counts.select("block_month").distinct().orderBy(
            F.desc("block_month")).limit(months)
        ranked = ranked.join(latest, "block_month", "left_semi")
    return ranked.where(F.col("place") <= top).select(
        "block_month", "pool_name", "blocks", "share")


def attribution_quality(blocks: DataFrame) -> DataFrame:
    """Blocks and share per source of the pool name (three rows at most)."""
    return (blocks.groupBy("pool_source").agg(F.count("*").alias("blocks"))
            .withColumn("share", ratio(F.col("blocks"),
                                       F.sum("blocks").over(Window.partitionBy()))))


def full_priced_blocks(blocks: DataFrame) -> DataFrame:
    return blocks.where(full_and_priced(F.col("is_full"), F.col("floor_fee_rate")))
