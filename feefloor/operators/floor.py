"""Fee percentiles of a block, the floor from its neighbours, and fullness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feefloor.operators.updates import apply_update
from feefloor.policy import Policy


def block_percentiles(txs: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Exact interpolated percentiles of the effective rate per block."""
    priced = (txs.where(~F.col("is_coinbase") & F.col("effective_fee_rate").isNotNull())
              .select("block_number", F.col("effective_fee_rate").alias("rate"),
                      (~F.col("is_nonrelayable")).alias("relayable")))
    return percentiles_by_rank(priced, policy.floor_percentile)


def percentiles_by_rank(priced: DataFrame, low: float) -> DataFrame:
    """Percentiles without sorting a block, alike for small and huge ones.

    Equal rates are counted first: one table, whose counts add up in every task
    before they move. A histogram on a logarithmic scale tells which few buckets hold
    the wanted ranks; only those are ranked exactly.
    """
    counted = priced.groupBy("block_number", "rate").agg(
        F.count("*").alias("n"), F.count_if("relayable").alias("n_rel"))
    # Monotone in the rate; all rates at or below zero share the first bucket.
    bucket = F.when(F.col("rate") > 0, F.floor(F.ln("rate") * 1024)).otherwise(-(1 << 40))
    # The join below drops what has no block or bucket. Dropped here, both its sides
    # read one and the same table, which is moved once.
    counted = counted.withColumn("bucket", bucket).where(
        "block_number IS NOT NULL AND bucket IS NOT NULL")
    per_bucket = counted.groupBy("block_number", "bucket").agg(
        F.sum("n").alias("bn"), F.sum("n_rel").alias("bn_rel"))
    block = Window.partitionBy("block_number")
    upto = block.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    placed = per_bucket.select(
        "block_number", "bucket",
        (F.sum("bn").over(upto) - F.col("bn")).alias("start"),
        (F.sum("bn_rel").over(upto) - F.col("bn_rel")).alias("start_rel"),
        "bn", "bn_rel",
        F.sum("bn").over(block).alias("total"), F.sum("bn_rel").over(block).alias("total_rel"))

    wanted = {"p05_fee_rate": ("_rel", low), "p05_all": ("", low),
              "median_fee_rate": ("_rel", 0.5)}

    def position(name: str) -> Column:
        suffix, q = wanted[name]
        return F.lit(q) * (F.col(f"total{suffix}") - 1)

    def holds(rank: Column, start: Column, size: Column) -> Column:
        return (rank >= start) & (rank < start + size) & (size > 0)

    def ranks(name: str) -> tuple[Column, Column]:
        return F.floor(position(name)), F.ceil(position(name))

    wanted_bucket = F.lit(False)
    for name, (suffix, _q) in wanted.items():
        for rank in ranks(name):
            wanted_bucket = wanted_bucket | holds(
                rank, F.col(f"start{suffix}"), F.col(f"bn{suffix}"))
    inside = Window.partitionBy("block_number", "bucket").orderBy("rate").rowsBetween(
        Window.unboundedPreceding, 0)
    values = counted.join(placed.where(wanted_bucket), ["block_number", "bucket"]).select(
        "block_number", "rate", "n", "n_rel", "total", "total_rel",
        (F.col("start") + F.sum("n").over(inside) - F.col("n")).alias("at"),
        (F.col("start_rel") + F.sum("n_rel").over(inside) - F.col("n_rel")).alias("at_rel"))

    picks = [F.max("total").alias("priced_tx_count")]
    for name, (suffix, _q) in wanted.items():
        for side, rank in zip(("lo", "hi"), ranks(name)):
            picks.append(F.max(F.when(
                holds(rank, F.col(f"at{suffix}"), F.col(f"n{suffix}")), F.col("rate")))
                .alias(f"{name}_{side}"))
        picks.append(F.max(position(name) - F.floor(position(name))).alias(f"{name}_frac"))
    picked = values.groupBy("block_number").agg(*picks)

    def blend(name: str) -> Column:
        lo, hi, frac = (F.col(f"{name}_{part}") for part in ("lo", "hi", "frac"))
        return F.when(lo == hi, lo).otherwise((1 - frac) * lo + frac * hi).alias(name)

    return picked.select("block_number", *[blend(n) for n in wanted], "priced_tx_count")


def to_neighbours(series: DataFrame, offsets: tuple[int, ...], *columns: str) -> DataFrame:
    """Send each block's values to the blocks it neighbours.

    Block n is the neighbour at offset o of block n - o. Offset 0 carries the
    block's own values, so a single grouping by block number replaces a join
    with an exploded copy. Neighbours go by number, so gaps stay gaps.
    """
    return series.select(
        F.explode(F.array(*[F.lit(o) for o in (0, *offsets)])).alias("offset"),
        "block_number", *columns).withColumn(
        "block_number", F.col("block_number") - F.col("offset"))


def neighbour_join(centre: DataFrame, series: DataFrame, offsets: tuple[int, ...]
                   ) -> DataFrame:
    """(block_number, offset, neighbour columns or NULL) for every centre block."""
    steps = centre.select("block_number",
                          F.explode(F.array(*[F.lit(o) for o in offsets])).alias("offset"))
    others = series.select(F.col("block_number").alias("neighbour"),
                           *[c for c in series.columns if c != "block_number"])
    return (steps.withColumn("neighbour", F.col("block_number") + F.col("offset"))
            .join(others, "neighbour", "left").drop("neighbour"))


def neighbour_floor(percentiles: DataFrame, offsets: tuple[int, ...] = Policy.neighbour_offsets
                    ) -> DataFrame:
    """Median p05 of the neighbours; NULL unless every one has a p05."""
    own = F.col("offset") == 0
    need = len(offsets)
    gathered = (to_neighbours(percentiles, offsets, "p05_fee_rate")
                .groupBy("block_number")
                .agg(F.count_if(own).alias("here"),
                     F.array_sort(F.collect_list(F.when(~own, F.col("p05_fee_rate"))))
                     .alias("sorted"))
                .where("here > 0"))
    middle = (F.get("sorted", F.lit((need - 1) // 2)) + F.get("sorted", F.lit(need // 2))) / 2
    return gathered.select("block_number", F.when(F.size("sorted") == need, middle)
                           .alias("floor_fee_rate"))


def apply_block_floor(blocks: DataFrame, percentiles: DataFrame,
                      policy: Policy = Policy()) -> DataFrame:
    floors = neighbour_floor(percentiles, policy.neighbour_offsets).join(
        percentiles.select("block_number", "p05_fee_rate", "median_fee_rate"),
        "block_number", "left")
    return apply_update(blocks, floors, ["block_number"],
                        ["floor_fee_rate", "p05_fee_rate", "median_fee_rate"])


def fullness_at(blocks: DataFrame, weights: tuple[int, ...], policy: Policy = Policy()
                ) -> DataFrame:
    """Per block and each weight w: weight_full_w, full_neighbours_w, is_full_w."""
    own = F.col("offset") == 0
    aggs = [F.count_if(own).alias("here")]
    for w in weights:
        heavy = F.col("weight") >= w
        aggs += [F.bool_or(F.when(own, heavy)).alias(f"weight_full_{w}"),
                 F.count_if(~own & heavy).alias(f"full_neighbours_{w}")]
    counted = (to_neighbours(blocks, policy.neighbour_offsets, "weight")
               .groupBy("block_number").agg(*aggs).where("here > 0").drop("here"))
    return counted.withColumns({
        f"is_full_{w}": F.col(f"weight_full_{w}")
        & (F.col(f"full_neighbours_{w}") >= policy.full_neighbours_required)
        for w in weights})


def block_fullness(blocks: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Heavy enough, and so are enough of the neighbours."""
    w = policy.full_weight
    return fullness_at(blocks, (w,), policy).select(
        "block_number", F.col(f"weight_full_{w}").alias("weight_full"),
        F.col(f"full_neighbours_{w}").alias("full_neighbours"),
        F.col(f"is_full_{w}").alias("is_full"))


def apply_block_fullness(blocks: DataFrame, policy: Policy = Policy()) -> DataFrame:
    return apply_update(blocks, block_fullness(blocks, policy), ["block_number"],
                        ["weight_full", "full_neighbours", "is_full"])
