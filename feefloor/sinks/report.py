"""The written summary: sections of a title and a small table, one formatter for all.

Every table is a Spark aggregate of a few rows; only its formatting happens here.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feefloor.operators.summary import headline, sensitivity_totals, top_pools
from feefloor.policy import Policy, headline_label, labels

#: Column of a table -> heading and how its values are shown.
Columns = dict[str, tuple[str, Callable[[object], str]]]


def headline_table(monthly: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """The headline at each sensitivity, a row for each."""
    first, *others = (headline(monthly, s) for s in labels(policy))
    for other in others:
        first = first.unionByName(other)
    return first


def number(digits: int = 0, unit: float = 1) -> Callable[[object], str]:
    return lambda x: "-" if x is None else f"{x / unit:,.{digits}f}"


def share(digits: int) -> Callable[[object], str]:
    return lambda x: "-" if x is None else f"{x:.{digits}%}"


HEADLINE: Columns = {
    "sensitivity": ("price bound", str),
    "low_fee_txs": ("sales", number()),
    "low_fee_gvb": ("GvB", number(2)),
    "share_of_full_block_space": ("of full blocks", share(2)),
    "lower_band_btc": ("BTC, at least", number(2)),
    "upper_band_btc": ("BTC, at most", number(2)),
}
GRID: Columns = {
    "sensitivity": ("price bound", str),
    "full_weight": ("full from weight", number()),
    "low_fee_vbytes": ("GvB", number(2, 1e9)),
    "low_fee_share": ("of full blocks", share(2)),
    "lower_band_sats": ("BTC, at least", number(2, 1e8)),
    "upper_band_sats": ("BTC, at most", number(2, 1e8)),
}


def pool_columns(policy: Policy) -> Columns:
    return {
        "pool_name": ("pool", str),
        f"low_fee_vbytes_{headline_label(policy)}": (
            f"GvB at {policy.headline_sensitivity}", number(2, 1e9)),
        "share_of_own_space": ("of its own space", share(3)),
    }


def section(title: str, columns: Columns, rows: list) -> list[str]:
    """A heading and the rows as a table; nothing for no rows."""
    if not rows:
        return []
    cells = [[head for head, _ in columns.values()], ["---"] * len(columns),
             *([show(row[name]) for name, (_, show) in columns.items()] for row in rows)]
    return ["", f"## {title}", "", *(f"| {' | '.join(line)} |" for line in cells)]


def summary_report(monthly: DataFrame, grid: DataFrame, pools: DataFrame,
                   policy: Policy = Policy()) -> tuple[str, dict]:
    """(markdown, headline per sensitivity)."""
    heads = headline_table(monthly, policy).orderBy("sensitivity").collect()
    first = heads[0]
    lines = [f"# Block space sold under its floor: {first['window_start']} - "
             f"{first['window_end']}", "",
             f"Months counted: {first['months']}. A sale counts if its price is under the "
             "given part of the block's floor and default nodes would have relayed it."]
    lines += section("Sales under the floor", HEADLINE, heads)
    lines += section("If blocks counted as full earlier or later", GRID,
                     sensitivity_totals(grid).orderBy("full_weight", "sensitivity").collect())
    lines += section("Pools with most of it", pool_columns(policy),
                     top_pools(pools, policy=policy).collect())
    lines += ["", "At least: what is missing to the floor. At most: the space at the block's "
              "median price. Pools are named after coinbase texts and payout addresses."]
    return "\n".join(lines) + "\n", {h["sensitivity"][2:]: h.asDict() for h in heads}


def write_summary(spark: SparkSession, folder: str, monthly: DataFrame, grid: DataFrame,
                  pools: DataFrame, policy: Policy = Policy()) -> None:
    """``summary`` (markdown) and ``headline`` (JSON) text folders."""
    text, heads = summary_report(monthly, grid, pools, policy)
    for name, body in (("summary", text.rstrip("\n")),
                       ("headline", json.dumps(heads, default=str, indent=1))):
        one = spark.range(1).select(F.lit(body).alias("value"))
        one.coalesce(1).write.mode("overwrite").text(f"{folder}/{name}")
