"""Raw transactions and block headers, read by month window."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Window:
    """Half-open time window [start, end)."""

    start: dt.date
    end: dt.date

    def covers(self, ts: Column, month: Column) -> Column:
        """Month test first so that partitions are pruned, then the exact one.

        The engine does not derive the partition month from the timestamp, so
        both are stated.
        """
        return (month.between(F.lit(self.start.replace(day=1)),
                              F.lit(self.end.replace(day=1)))
                & (ts >= F.lit(self.start).cast("timestamp"))
                & (ts < F.lit(self.end).cast("timestamp")))


def month_window(month: str) -> Window:
    """'2024-03' -> the window of that calendar month."""
    start = dt.datetime.strptime(month, "%Y-%m").date()
    end = (start + dt.timedelta(days=32)).replace(day=1)
    return Window(start, end)


def in_window_transactions(raw: DataFrame, window: Window | None) -> DataFrame:
    if window is None:
        return raw
    return raw.where(window.covers(F.col("block_timestamp"), F.col("block_timestamp_month")))


def in_window_blocks(raw: DataFrame, window: Window | None) -> DataFrame:
    if window is None:
        return raw
    return raw.where(window.covers(F.col("timestamp"), F.col("timestamp_month")))


def read_transactions(spark: SparkSession, path: str,
                      window: Window | None = None) -> DataFrame:
    """Nested transactions; only columns later selected are read from disk."""
    return in_window_transactions(spark.read.parquet(path), window)


def read_blocks(spark: SparkSession, path: str, window: Window | None = None) -> DataFrame:
    return in_window_blocks(spark.read.parquet(path), window)
