"""Relay-policy limits, the day each of them changed, and study thresholds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Policy:
    """Public node-software release dates and default limits."""

    # 2025-10-08: data-carrier limit raised, summed per transaction, and the
    # one-OP_RETURN rule dropped.
    datacarrier_change: str = "2025-10-08"
    datacarrier_limit_before: int = 83
    datacarrier_limit_after: int = 100_000

    # 2025-09-04: default minimum relay fee lowered (sat/vB).
    min_relay_change: str = "2025-09-04"
    min_relay_before: float = 1.0
    min_relay_after: float = 0.1

    # 2024-10-04: version 3 (TRUC) transactions become standard.
    truc_change: str = "2024-10-04"
    version_min: int = 1
    version_max_before: int = 2
    version_max_after: int = 3
    truc_version: int = 3
    truc_max_vsize: int = 10_000
    truc_child_max_vsize: int = 1_000
    truc_ancestor_limit: int = 2

    # 2025-04-15: one ephemeral dust output allowed.
    dust_change: str = "2025-04-15"
    max_dust_before: int = 0
    max_dust_after: int = 1
    dust_fee_per_kvb: int = 3_000
    dust_spend_legacy: int = 148
    dust_spend_witness: int = 67
    max_script_size: int = 10_000

    # 2026-04-20: ancestor limits replaced by cluster limits.
    cluster_change: str = "2026-04-20"
    ancestor_limit: int = 25
    ancestor_vsize_limit: int = 101_000

    max_standard_vsize: int = 100_000
    min_nonwitness_size: int = 65
    multisig_max_n: int = 3
    max_scriptsig_size: int = 1_650

    # Floor, fullness and low-fee thresholds of the study.
    neighbour_offsets: tuple[int, ...] = (-3, -2, -1, 1, 2, 3)
    floor_percentile: float = 0.05
    full_weight: int = 3_900_000
    full_neighbours_required: int = 4
    sensitivities: tuple[float, ...] = (0.3, 0.5, 0.7)
    # The one of them that pools, samples and validation go by.
    headline_sensitivity: float = 0.5
    fullness_grid: tuple[int, ...] = (3_850_000, 3_900_000, 3_950_000)


def labels(policy: Policy) -> list[str]:
    """Suffixes of the policy's sensitivities, the strictest first."""
    return [sensitivity_label(s) for s in sorted(policy.sensitivities)]


def headline_label(policy: Policy) -> str:
    return sensitivity_label(policy.headline_sensitivity)


def sensitivity_label(sensitivity: float) -> str:
    """0.3 -> '30': the suffix result columns carry."""
    return f"{round(sensitivity * 100):02d}"


def before(ts: Column, day: str) -> Column:
    """True strictly before the release day; the day itself counts as after."""
    return ts < F.lit(day).cast("timestamp")


def policy_as_of(df: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Add the limits in force on each row's ``block_timestamp``."""
    ts = F.col("block_timestamp")

    def gate(day, old, new):
        return F.when(before(ts, day), old).otherwise(new)

    return df.withColumns({
        "min_relay_rate": gate(policy.min_relay_change,
                               F.lit(float(policy.min_relay_before)),
                               F.lit(float(policy.min_relay_after))),
        "datacarrier_bytes": gate(policy.datacarrier_change,
                                  F.col("op_return_max_bytes"),
                                  F.col("op_return_total_bytes")),
        "datacarrier_limit": gate(policy.datacarrier_change,
                                  F.lit(policy.datacarrier_limit_before),
                                  F.lit(policy.datacarrier_limit_after)),
        "max_standard_version": gate(policy.truc_change,
                                     F.lit(policy.version_max_before),
                                     F.lit(policy.version_max_after)),
        "max_dust_outputs": gate(policy.dust_change,
                                 F.lit(policy.max_dust_before),
                                 F.lit(policy.max_dust_after)),
    })
