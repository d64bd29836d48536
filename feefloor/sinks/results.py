"""Small result tables as JSON, and the published monthly payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feefloor.functions.measures import month_label, sats_to_btc


def json_safe(df: DataFrame) -> DataFrame:
    """Dates as ISO text, decimals as doubles, NaN as NULL."""
    def clean(field: T.StructField):
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DateType):
            return F.date_format(col, "yyyy-MM-dd")
        if isinstance(field.dataType, T.TimestampType):
            return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss")
        if isinstance(field.dataType, T.DecimalType):
            return col.cast("double")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            return F.when(~F.isnan(col), col)
        return col
    return df.select(*[clean(f).alias(f.name) for f in df.schema.fields])


def write_result_json(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """One JSON-lines file. For result tables only, which are a few rows per
    month; NULLs are written, so every row has every field."""
    rows = json_safe(df).repartition(1)
    if order:
        rows = rows.sortWithinPartitions(*order)
    (rows.write.mode("overwrite").option("ignoreNullFields", False).json(path))


def onchain_fee_rows(monthly_fee: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    return monthly_fee.select(
        month_label(F.col("block_month")).alias("month"), "txs", "blocks",
        F.coalesce("fee_sats", zero).alias("fee_sats"),
        sats_to_btc(F.coalesce("fee_sats", zero)).alias("fee_btc"),
        F.coalesce("vbytes", zero).alias("vbytes"),
        F.round("fee_rate_sat_vb", 3).alias("fee_rate_sat_vb"))


def merge_onchain_fees(existing: DataFrame | None, fresh: DataFrame) -> DataFrame:
    """A fresh month replaces the stored one."""
    if existing is None:
        return fresh
    return existing.join(fresh.select("month"), "month", "left_anti").select(
        *fresh.columns).unionByName(fresh)


def onchain_fee_payload(monthly_fee: DataFrame, existing: DataFrame | None = None
                        ) -> DataFrame:
    """First and last month and the total, for the merged months."""
    months = merge_onchain_fees(existing, onchain_fee_rows(monthly_fee))
    return months.agg(F.count("*").alias("months"), F.min("month").alias("first_month"),
                      F.max("month").alias("last_month"),
                      sats_to_btc(F.sum("fee_sats")).alias("total_fee_btc"))


def onchain_fee_document(months: DataFrame) -> DataFrame:
    """One row: all months in order, with the first, the last and the total."""
    fields = [c for c in months.columns if c != "month"]
    return months.agg(
        F.array_sort(F.collect_list(F.struct("month", *fields))).alias("months"),
        F.min("month").alias("first_month"), F.max("month").alias("last_month"),
        sats_to_btc(F.sum("fee_sats")).alias("total_fee_btc"))


def fees_by_month_json(nested: DataFrame) -> DataFrame:
    """month -> {"pools": {name: fee}, "sum": n} with pools by falling fee."""
    pools = F.map_from_entries(F.transform(
        "pools", lambda p: F.struct(p["pool_name"].alias("k"), p["fee"].alias("v"))))
    return nested.select("month", F.to_json(F.struct(pools.alias("pools"), "sum"))
                         .alias("value"))
