"""Off-chain acceleration payments by month and pool."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feefloor.functions.measures import completed_only


def pool_by_id(records: DataFrame, ids: DataFrame) -> DataFrame:
    """Name the pool of each record; unknown and missing ids are dropped."""
    return records.join(
        ids.select(F.col("pool_id").alias("minedByPoolUniqueId"), "pool_name"),
        "minedByPoolUniqueId")


def pool_fees_by_month(records: DataFrame, ids: DataFrame, months: DataFrame) -> DataFrame:
    """Completed fee payments summed by month and pool name.

    Summed by pool id before the name join, so the join sees few rows. A month
    without payments keeps one row with a NULL pool; ``month_sum`` repeats the
    month's total on each of its rows.
    """
    per_id = (records.where(completed_only(F.col("status")))
              .where("minedByPoolUniqueId IS NOT NULL")
              .groupBy("month", "minedByPoolUniqueId")
              .agg(F.sum(F.coalesce("feeDelta", F.lit(0).cast("long"))).alias("fee")))
    named = (pool_by_id(per_id, ids).groupBy("month", "pool_name")
             .agg(F.sum("fee").alias("fee_sats")))
    return (months.select("month").distinct().join(named, "month", "left")
            .withColumn("month_sum", F.coalesce(
                F.sum("fee_sats").over(Window.partitionBy("month")),
                F.lit(0).cast("long"))))


def fees_by_month_nested(fees: DataFrame) -> DataFrame:
    """One row per month: pools as [{pool_name, fee}] by falling fee, and the sum."""
    entry = F.struct((-F.col("fee_sats")).alias("order"), "pool_name",
                     F.col("fee_sats").alias("fee"))
    listed = F.array_sort(F.collect_list(F.when(F.col("pool_name").isNotNull(), entry)))
    return (fees.groupBy("month")
            .agg(listed.alias("p"), F.max("month_sum").alias("sum"))
            .select("month", F.transform("p", lambda e: F.struct(
                e["pool_name"].alias("pool_name"), e["fee"].alias("fee"))).alias("pools"),
                "sum"))
