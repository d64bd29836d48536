"""Monthly acceleration files, named ``YYYY-MM.json``, one JSON array each."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ACCELERATION_SCHEMA = """txid string, status string, added long, lastUpdated long,
 effectiveFee long, effectiveVsize long, feeDelta long, blockHash string, blockHeight long,
 bidBoost long, boostVersion string, pools array<long>, minedByPoolUniqueId long,
 canceled long"""


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)\.json$", 1)


def read_accelerations(spark: SparkSession, folder: str, multi_line: bool = True
                       ) -> DataFrame:
    """Every record of every monthly file, with the month its file is named for.

    A file holding one JSON array is one document, so one task reads it. Pass
    ``multi_line=False`` for JSON lines, which split over many tasks. A file, or
    a line, that is no whole JSON stops the read with its name.
    """
    rows = (spark.read.schema(f"{ACCELERATION_SCHEMA}, broken string")
            .option("multiLine", multi_line).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "broken")
            .option("pathGlobFilter", "*.json").json(folder)
            .select("*", F.col("_metadata.file_name").alias("file")))
    stop = F.raise_error(F.concat(F.lit("broken acceleration file "), "file")).cast("boolean")
    return (rows.where(F.when(F.col("broken").isNotNull(), stop).otherwise(F.lit(True)))
            .withColumn("month", file_stem(F.col("file"))).drop("broken", "file"))


def list_months(spark: SparkSession, folder: str) -> DataFrame:
    """Every month that has a file, empty files included.

    Scans skip files without bytes, so names come from the file listing: one
    short string per month, and no contents.
    """
    files = (spark.read.format("text").option("pathGlobFilter", "*.json").load(folder)
             .inputFiles())
    names = spark.createDataFrame([(f,) for f in files], "path string")
    return names.select(file_stem(F.col("path")).alias("month")).distinct()


def months_to_load(loaded: DataFrame, as_of: dt.date) -> DataFrame:
    """Months after the newest loaded one, up to the last complete month.

    Names that are not ``YYYY-MM`` are ignored; no loaded month is an error.
    """
    first_day = F.try_to_timestamp(F.concat("month", F.lit("-01")), F.lit("yyyy-MM-dd"))
    newest = loaded.agg(F.max(F.to_date(first_day)).alias("newest"))
    start = F.add_months("newest", 1)
    stop = F.add_months(F.trunc(F.lit(as_of), "MM"), -1)
    missing = F.when(start <= stop, F.sequence(start, stop, F.expr("interval 1 month")))
    checked = newest.withColumn("newest", F.when(
        F.col("newest").isNull(), F.raise_error(F.lit("no monthly files")).cast("date"))
        .otherwise(F.col("newest")))
    return checked.select(F.explode(missing).alias("m")).select(
        F.date_format("m", "yyyy-MM").alias("month"))
