"""Jobs users run: exports, accelerations, pool refresh, checks, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from feefloor.operators.accelerations import fees_by_month_nested, pool_fees_by_month
from feefloor.operators.attribution import pool_list_diff
from feefloor.operators.quality import (audit_overlap, audit_overlap_by_block, flagged_txs,
                                        sampled_txs, unattributed_texts)
from feefloor.operators.summary import attribution_quality, monthly_pool_shares
from feefloor.plans.pipeline import Stages
from feefloor.policy import Policy, headline_label
from feefloor.session import cut_lineage
from feefloor.sinks.published import Published
from feefloor.sinks.report import write_summary
from feefloor.sinks.results import (fees_by_month_json, onchain_fee_document, onchain_fee_rows,
                                    write_result_json)
from feefloor.sinks.tables import MONTH, months_covered, top_by_month, top_rows
from feefloor.sources.accelerations import list_months, read_accelerations
from feefloor.sources.pools import parse_pool_ids, read_pools

# First block public audits cover, and rows kept in the sample.
MIN_AUDITED_HEIGHT = 790_000
SAMPLE_SIZE = 5_000

RESULTS = {
    "monthly_summary": ["block_month"],
    "pool_summary": ["block_month", "pool_name"],
    "low_fee_sensitivity": ["block_month", "sensitivity", "full_weight"],
}


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored table, or None where nothing was ever stored.

    A folder without a readable table is an error and not an empty table, since
    what follows would overwrite it.
    """
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def export_results(tables: Stages, out: str, replace: bool = False,
                   policy: Policy = Policy()) -> bool:
    """Merge a run's months into the published results; JSON and report follow.

    Returns False, and changes nothing, when the run holds no month. ``replace``
    drops all other months. All tables and documents change at once, when the new
    version is committed; an export that ends before that has changed nothing.
    """
    fresh = {name: tables[name] for name in RESULTS}
    months = months_covered(fresh["monthly_summary"])
    if months.isEmpty():
        return False
    draft = Published(tables.spark, out).draft()
    merged = {name: draft.put(name, df, months, MONTH, replace) for name, df in fresh.items()}
    name = "low_fee_txs_sample"
    head = f"low_fee_{headline_label(policy)}"
    sample = top_by_month(tables["low_fee_txs"].where(head), SAMPLE_SIZE)
    merged[name] = top_rows(draft.put(name, sample, months, MONTH, replace), SAMPLE_SIZE)
    for name, df in merged.items():
        order = RESULTS.get(name) or [F.desc("upper_band_sats"), "tx_hash"]
        write_result_json(df, draft.path(f"{name}.json"), order)
    write_summary(tables.spark, draft.path("").rstrip("/"), merged["monthly_summary"],
                  merged["low_fee_sensitivity"], merged["pool_summary"], policy)
    draft.commit()
    return True


def export_onchain_fee(tables: Stages, out: str) -> bool:
    """Publish the monthly on-chain fee as one document, earlier months kept.

    Returns False when the run holds no month. A run that changes no stored month
    leaves the published version as it is.
    """
    fresh = tables["onchain_monthly_fee"]
    if fresh.isEmpty():
        return False
    rows = cut_lineage(onchain_fee_rows(fresh), "onchain-fee")
    published = Published(tables.spark, f"{out}/onchain")
    stored = published.table("onchain_fee", rows.schema, "month")
    if rows.exceptAll(stored.select(*rows.columns)).isEmpty():
        return True
    draft = published.draft()
    months = draft.put("onchain_fee", rows, rows.select("month"), "month")
    write_result_json(onchain_fee_document(months), draft.path("onchain_monthly_fee.json"))
    draft.commit()
    return True


def run_accelerations(spark: SparkSession, folder: str, pool_list: str, out: str,
                      multi_line: bool = True) -> DataFrame:
    """Off-chain payments by month and pool from the monthly files."""
    ids = parse_pool_ids(spark.read.text(pool_list, wholetext=True))
    fees = pool_fees_by_month(read_accelerations(spark, folder, multi_line), ids,
                              list_months(spark, folder))
    nested = fees_by_month_nested(fees)
    (fees_by_month_json(nested).repartition(1).sortWithinPartitions("month")
     .write.mode("overwrite").json(f"{out}/accelerations_by_month.json"))
    return nested


def refresh_pools(spark: SparkSession, fresh_list: str, table: str,
                  print_only: bool = False) -> DataFrame:
    """Replace the pool table by a downloaded list, and say what became of each pool.

    ``pool_list_counts`` sums the answer up. A list without a usable pool is refused and the table kept.
    """
    fresh = cut_lineage(read_pools(spark, fresh_list), "pools")
    if fresh.isEmpty():
        raise ValueError("the list holds no usable pool; the table is kept")
    stored = _existing(spark, table)
    current = fresh.limit(0) if stored is None else stored
    diff = cut_lineage(pool_list_diff(current, fresh), "pool-diff")
    if not print_only:
        fresh.write.mode("overwrite").parquet(table)
    return diff


def sanity_check(headers: DataFrame, tables: Stages, months: int = 12, top: int = 12
                 ) -> dict[str, DataFrame]:
    blocks = tables["blocks"]
    return {"monthly_pool_shares": monthly_pool_shares(blocks, months, top),
            "attribution_quality": attribution_quality(blocks),
            "unattributed_texts": unattributed_texts(headers, blocks)}


def validate(tables: Stages, audits: DataFrame, sample: int,
             sensitivity: str = headline_label(Policy()),
             min_height: int = MIN_AUDITED_HEIGHT, by_block: bool = False) -> DataFrame:
    """Compare a fixed sample of flagged blocks with public audits.

    Totals in one row, or with ``by_block`` a row for each block.
    """
    flagged = sampled_txs(flagged_txs(tables["txs"], tables["blocks"],
                                      f"low_fee_{sensitivity}", min_height), sample)
    return (audit_overlap_by_block if by_block else audit_overlap)(flagged, audits)
