"""Stage tables and month-wise merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feefloor.functions.hashes import packed, unpacked

MONTH = "block_month"
COMPRESSION = "zstd"


def write_stage(df: DataFrame, path: str, partition: str | None = None,
                cluster: str | None = None, ordered: bool = False) -> DataFrame:
    """Replace a stage table and read it back.

    The rebalance hint brings the rows of a partition value together, lets the
    engine pick file sizes and split a hot value over several tasks. Rows are
    sorted by the cluster column inside each file, so its min/max statistics stay
    tight. ``ordered`` rows arrive by partition value and sorted: they are neither
    moved nor sorted again. Hashes are spelled in hex, half of which is air to zstd.
    """
    if partition:
        keys = [k for k in (partition, cluster) if k]
        rows = df if ordered else unpacked(
            packed(df).hint("rebalance", partition).sortWithinPartitions(*keys))
        rows.write.mode("overwrite").option("compression", COMPRESSION).partitionBy(
            partition).parquet(path)
    else:
        df.write.mode("overwrite").option("compression", COMPRESSION).parquet(path)
    return read_stage(df.sparkSession, path, df)


def read_stage(spark: SparkSession, path: str, like: DataFrame | None = None) -> DataFrame:
    reader = spark.read
    if like is not None:
        return reader.schema(like.schema).parquet(path).select(*like.columns)
    return reader.parquet(path)


def months_covered(monthly: DataFrame, column: str = MONTH) -> DataFrame:
    return monthly.select(column).distinct()


def merge_months(existing: DataFrame | None, fresh: DataFrame, months: DataFrame,
                 column: str = MONTH) -> DataFrame:
    """Existing rows of other months, and all fresh rows."""
    if existing is None:
        return fresh
    return existing.join(months.select(column), column, "left_anti").select(
        *existing.columns).unionByName(fresh)


def top_rows(sample: DataFrame, k: int = 5_000) -> DataFrame:
    """The k most valuable rows over all months."""
    return sample.orderBy(F.desc("upper_band_sats"), "tx_hash").limit(k)


def top_by_month(rows: DataFrame, k: int = 5_000, column: str = MONTH) -> DataFrame:
    """The k most valuable rows of each month: the top k of any set of months is among
    them, whichever months are replaced later.

    Rows are ranked in slices first, so no task sorts a whole month.
    """
    order = (F.desc("upper_band_sats"), "tx_hash")
    part = F.pmod(F.xxhash64("tx_hash"), F.lit(64))
    by_slice = Window.partitionBy(column, part).orderBy(*order)
    by_month = Window.partitionBy(column).orderBy(*order)
    return (rows.withColumn("place", F.row_number().over(by_slice)).where(F.col("place") <= k)
            .withColumn("place", F.row_number().over(by_month)).where(F.col("place") <= k)
            .drop("place"))


def merge_sample(existing: DataFrame | None, fresh: DataFrame, months: DataFrame,
                 k: int = 5_000) -> DataFrame:
    """Months merged, each with its own top k; ``top_rows`` of it is the sample."""
    return top_by_month(merge_months(existing, fresh, months), k)


def write_months(df: DataFrame, path: str, column: str = MONTH) -> None:
    """The same merge on disk: replace only the month folders ``df`` holds.

    Folders are exchanged when all their files are written, so a failed job
    leaves what was there.
    """
    (unpacked(packed(df).hint("rebalance", column)).write.mode("overwrite")
     .option("compression", COMPRESSION)
     .option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path))
