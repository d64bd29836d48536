"""Next version of a table from a keyed source; tables are never edited in place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feefloor.functions.hashes import packed, unpacked
from feefloor.functions.measures import any_of
from feefloor.operators.linkage import KEY
from feefloor.operators.relay import ANCESTOR_REASON
from feefloor.policy import Policy, before


def _apply_packed(target: DataFrame, source: DataFrame, columns: list[str]) -> DataFrame:
    """``apply_update`` by transaction, with hashes packed while they are moved."""
    return unpacked(apply_update(packed(target), packed(source), KEY, columns))


def apply_update(target: DataFrame, source: DataFrame, keys: list[str],
                 columns: list[str]) -> DataFrame:
    """Take ``columns`` from ``source`` where its key matches, NULLs included;
    rows without a match keep their values. ``source`` keys must be unique."""
    fresh = source.select(*keys, F.lit(True).alias("_hit"),
                          *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = target.join(fresh, keys, "left")
    hit = F.col("_hit").isNotNull()
    return joined.select(*[
        F.when(hit, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
        if c in columns and c in target.columns else F.col(c)
        for c in target.columns],
        *[F.col(f"_new_{c}").alias(c) for c in columns if c not in target.columns])


def ancestor_limit(policy: Policy = Policy()):
    """Too many in-block ancestors for the day; needs the package columns."""
    c = F.col
    ts = c("block_timestamp")
    return F.coalesce(~c("is_coinbase") & any_of([
        before(ts, policy.cluster_change)
        & ((c("ancestor_count") > policy.ancestor_limit)
           | (c("ancestor_vsize") > policy.ancestor_vsize_limit)),
        ~before(ts, policy.truc_change) & (c("version") == policy.truc_version)
        & (c("ancestor_count") > policy.truc_ancestor_limit)]), F.lit(False))


def apply_package_rates(txs: DataFrame, packages: DataFrame) -> DataFrame:
    return _apply_packed(txs, packages,
                         ["effective_fee_rate", "package_id", "package_tx_count"])


def apply_ancestor_limit(txs: DataFrame, packages: DataFrame,
                         policy: Policy = Policy()) -> DataFrame:
    facts = txs.select(*KEY, "block_timestamp", "is_coinbase", "version",
                       "is_nonrelayable")
    source = packages.join(facts, KEY).select(
        *KEY, ancestor_limit(policy).alias(ANCESTOR_REASON),
        (F.col("is_nonrelayable") | ancestor_limit(policy)).alias("is_nonrelayable"))
    return _apply_packed(txs, source, [ANCESTOR_REASON, "is_nonrelayable"])


def price_packages(txs: DataFrame, packages: DataFrame,
                   policy: Policy = Policy()) -> DataFrame:
    """Both updates above in one join.

    Only rows with an in-block relative can have a package row, so the rest is
    passed through without a shuffle. The others meet with packed hashes.
    """
    member = F.col("in_package") & ~F.col("is_coinbase")
    rest = txs.where(~member)
    source = packed(packages).select(
        *KEY, "ancestor_count", "ancestor_vsize",
        *[F.col(c).alias(f"_new_{c}") for c in
          ("effective_fee_rate", "package_id", "package_tx_count")])
    joined = packed(txs.where(member)).join(source, KEY, "left")
    hit = F.col("ancestor_count").isNotNull()
    over = ancestor_limit(policy)
    priced = joined.withColumns({
        **{c: F.when(hit, F.col(f"_new_{c}")).otherwise(F.col(c))
           for c in ("effective_fee_rate", "package_id", "package_tx_count")},
        ANCESTOR_REASON: F.when(hit, over).otherwise(F.col(ANCESTOR_REASON)),
        "is_nonrelayable": F.col("is_nonrelayable") | F.when(hit, over).otherwise(False),
    }).select(*txs.columns)
    return rest.unionByName(unpacked(priced))
