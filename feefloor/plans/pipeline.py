"""The block-space pipeline as named steps over stage tables.

A step reads the stage tables before it and writes its own, so any run can
start at a later step. A table the next steps change is written under a new
name; nothing is edited in place.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from feefloor.operators.attribution import attribute_pools
from feefloor.operators.extract import onchain_monthly_fee, tx_base
from feefloor.operators.floor import (apply_block_floor, apply_block_fullness,
                                      block_percentiles)
from feefloor.operators.lowfee import apply_low_fee, low_fee_txs
from feefloor.operators.packages import packages
from feefloor.operators.quality import invariants
from feefloor.operators.relay import in_package_set, relay_reasons
from feefloor.operators.summary import (block_partials, low_fee_sensitivity, monthly_summary,
                                        pool_summary)
from feefloor.operators.updates import price_packages
from feefloor.policy import Policy
from feefloor.sinks.tables import read_stage, write_stage
from feefloor.sources.chain import Window, in_window_blocks, in_window_transactions


@dataclass(frozen=True)
class Source:
    """Raw inputs: nested transactions, block headers, and the pool list."""

    transactions: DataFrame
    blocks: DataFrame
    pools: DataFrame


class Stages:
    """Stage tables under one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._open: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        # A table is opened once: its files are listed once per run.
        if name not in self._open:
            self._open[name] = read_stage(self.spark, f"{self.folder}/{name}")
        return self._open[name]

    def write(self, name: str, df: DataFrame, layout: Layout | None = None) -> DataFrame:
        path = f"{self.folder}/{name}"
        layout = layout or LAYOUTS.get(name, WHOLE)
        if layout.month:
            self._open[name] = write_stage(df, path, layout.month, "block_number",
                                           layout.ordered)
        else:
            self._open[name] = write_stage(df, path)
        return self._open[name]


@dataclass(frozen=True)
class Layout:
    """Split by a month column, if any; rows that come in its order already are not moved."""

    month: str | None = "block_month"
    ordered: bool = False


#: No split.
WHOLE = Layout(None)

# Two tables hold a row for every transaction: what is read off it and its relatives,
# and the finished one, which is brought back to the month split of its source. What
# packages change is stored beside the first and merged when read; one row per block
# or fewer needs no layout.
LAYOUTS = {"txs": Layout()}

Step = Callable[[Source, Stages, Policy], DataFrame]


def priced(t: Stages, policy: Policy) -> DataFrame:
    """Transactions with package prices and the ancestor rule.

    Merged when read: the linked transactions, and beside them the few columns that
    packages change. The percentiles read three of its columns, so no copy is stored.
    """
    return price_packages(t["txs_linked"], t["tx_packages"], policy)


# name of the table written -> how it is built, in running order
STEPS: dict[str, Step] = {
    "txs_linked": lambda src, t, p: relay_reasons(tx_base(src.transactions, p), p),
    "onchain_monthly_fee": lambda src, t, p: onchain_monthly_fee(t["txs_linked"]),
    "blocks_attributed": lambda src, t, p: attribute_pools(
        src.blocks, t["txs_linked"], src.pools),
    "tx_in_package": lambda src, t, p: in_package_set(t["txs_linked"]),
    "tx_packages": lambda src, t, p: packages(t["tx_in_package"]),
    "block_percentiles": lambda src, t, p: block_percentiles(priced(t, p), p),
    "blocks": lambda src, t, p: apply_block_fullness(
        apply_block_floor(t["blocks_attributed"], t["block_percentiles"], p), p),
    "txs": lambda src, t, p: apply_low_fee(
        priced(t, p).drop("coinbase_addresses"), t["blocks"], p),
    "low_fee_txs": lambda src, t, p: low_fee_txs(t["txs"], p),
    "block_partials": lambda src, t, p: block_partials(t["txs"], p),
    "monthly_summary": lambda src, t, p: monthly_summary(t["block_partials"], p),
    "pool_summary": lambda src, t, p: pool_summary(t["block_partials"], p),
    "low_fee_sensitivity": lambda src, t, p: low_fee_sensitivity(
        t["block_partials"], t["blocks"], p),
}


def select_steps(only: str | None = None, from_step: str | None = None) -> list[str]:
    """Names to run, in order; an unknown name is an error."""
    names = list(STEPS)
    asked = only.split(",") if only else ([from_step] if from_step else [])
    unknown = sorted(set(asked) - set(names))
    if unknown:
        raise ValueError(f"unknown step(s): {', '.join(unknown)}")
    if only:
        return [n for n in names if n in asked]
    return names[names.index(from_step):] if from_step else names


def run_pipeline(spark: SparkSession, source: Source, folder: str,
                 window: Window | None = None, policy: Policy = Policy(),
                 only: str | None = None, from_step: str | None = None) -> Stages:
    """Run the chosen steps for a window; results stay in ``folder``."""
    steps = select_steps(only, from_step)
    source = Source(in_window_transactions(source.transactions, window),
                    in_window_blocks(source.blocks, window), source.pools)
    tables = Stages(spark, folder)
    for name in steps:
        tables.write(name, STEPS[name](source, tables, policy))
    return tables


def check(tables: Stages, strict: bool = False) -> DataFrame:
    """The invariants of a finished run; ``strict`` raises when one fails."""
    result = invariants(tables["txs"], tables["blocks"], tables["block_percentiles"])
    if strict:
        failed = result.where("violations > 0").collect()
        if failed:
            raise ValueError("; ".join(f"{r['check']}: {r['violations']}" for r in failed))
    return result
