"""Data-quality invariants, attribution checks and comparison with audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feefloor.functions.hashes import packed
from feefloor.functions.measures import any_of, coinbase_text, printable_prefix, ratio
from feefloor.operators.relay import REASONS
from feefloor.policy import Policy, labels

SAMPLE_SEED = "feefloor"


def unattributed_texts(headers: DataFrame, blocks: DataFrame, n: int = 15) -> DataFrame:
    """Commonest printable coinbase texts among blocks of unknown pool."""
    unknown = blocks.where("pool_name = 'Unknown'").select("block_number")
    text = F.when(F.col("coinbase_param").isNotNull(),
                  printable_prefix(coinbase_text(F.col("coinbase_param"))))
    return (headers.select(F.col("number").alias("block_number"), text.alias("coinbase_text"))
            .join(unknown, "block_number", "left_semi")
            .groupBy("coinbase_text").agg(F.count("*").alias("blocks"))
            .orderBy(F.desc("blocks"), "coinbase_text").limit(n))


def flagged_txs(txs: DataFrame, blocks: DataFrame, column: str, min_height: int) -> DataFrame:
    """(block_number, block_hash, pool_name, tx_hash) of every flagged transaction."""
    return (txs.where(F.col(column) & (F.col("block_number") >= min_height))
            .select("block_number", "tx_hash")
            .join(blocks.select("block_number", "block_hash", "pool_name"), "block_number"))


def flagged_blocks(flagged: DataFrame) -> DataFrame:
    """Per block: how many flagged transactions it has."""
    return flagged.groupBy("block_number", "block_hash", "pool_name").agg(
        F.count("*").alias("low_fee_txs"))


def fixed_sample(blocks: DataFrame, n: int, seed: str = SAMPLE_SEED) -> DataFrame:
    """The same at most ``n`` blocks on every run and engine."""
    return blocks.orderBy(F.sha2(F.concat(F.lit(seed), "block_hash"), 256)).limit(n)


def sampled_txs(flagged: DataFrame, n: int, seed: str = SAMPLE_SEED) -> DataFrame:
    """Flagged transactions of a fixed sample of blocks; others are not gathered."""
    chosen = fixed_sample(flagged_blocks(flagged), n, seed)
    return flagged.join(chosen.select("block_number"), "block_number", "left_semi")


def audit_overlap_by_block(flagged: DataFrame, audits: DataFrame) -> DataFrame:
    """Per flagged block: hashes also in its audit's added and accelerated
    lists. Blocks without an audit keep NULL counts.

    Hashes are compared as rows, block and hash together, so neither a block nor
    an audit is ever held as one list.
    """
    key = ["block_hash", "tx_hash"]
    ours = packed(flagged.select("block_number", "pool_name", *key)).distinct()
    listed = [packed(audits.select("block_hash", F.explode(name).alias("tx_hash"),
                                   F.lit(name).alias("list"))) for name in ("added", "accelerated")]
    seen = listed[0].unionByName(listed[1]).groupBy(*key).agg(
        F.count_if(F.col("list") == "added").alias("a"),
        F.count_if(F.col("list") == "accelerated").alias("c"))
    counts = ours.join(seen, key, "left").groupBy("block_number", "block_hash", "pool_name").agg(
        F.count("*").alias("low_fee"), F.count_if(F.col("a") > 0).alias("in_added"),
        F.count_if(F.col("c") > 0).alias("in_accelerated"))
    audited = packed(audits.select("block_hash")).select("block_hash", F.lit(True).alias("audited")).distinct()
    with_audit = counts.join(audited, "block_hash", "left")
    return with_audit.select(
        "block_number", "pool_name", F.coalesce("audited", F.lit(False)).alias("audited"),
        *[F.when(F.col("audited"), F.col(n)).alias(n)
          for n in ("low_fee", "in_added", "in_accelerated")])


def audit_overlap(flagged: DataFrame, audits: DataFrame) -> DataFrame:
    """Totals of the comparison, one row."""
    zero = F.lit(0).cast("long")

    def total(name):
        return F.coalesce(F.sum(name), zero).alias(name)

    hit = (F.col("in_added") > 0) | (F.col("in_accelerated") > 0)
    return (audit_overlap_by_block(flagged, audits).agg(
        F.count("*").alias("blocks"), F.count_if("audited").alias("audited"),
        F.count_if(~F.col("audited")).alias("without_audit"),
        F.count_if(hit).alias("blocks_with_overlap"),
        total("low_fee"), total("in_added"), total("in_accelerated"))
        .withColumn("added_share", ratio(F.col("in_added"), F.col("low_fee")))
        .withColumn("accelerated_share", ratio(F.col("in_accelerated"), F.col("low_fee"))))


def invariants(txs: DataFrame, blocks: DataFrame, percentiles: DataFrame,
               policy: Policy = Policy()) -> DataFrame:
    """(check, violations): six counts that must be zero.

    Four come from one pass over the transactions; package agreement compares
    the smallest with the largest price, which combines before the shuffle.
    """
    c = F.col
    reasons = any_of([c(r) for r in REASONS])
    one_pass = txs.agg(
        F.count_if(~c("is_coinbase") & c("effective_fee_rate").isNull()).alias("a"),
        F.count_if(c(f"low_fee_{labels(policy)[-1]}") & c("is_nonrelayable")).alias("b"),
        F.count_if(c("is_nonrelayable") != reasons).alias("c"),
        F.count_if(c("is_coinbase") & c("is_nonrelayable")).alias("d"))
    names = ("missing_rate", "low_fee_nonrelayable", "verdict_mismatch",
             "nonrelayable_coinbase")
    simple = one_pass.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("check"), c(k).alias("violations"))
        for n, k in zip(names, "abcd")])))
    packages = (packed(txs.where("package_id IS NOT NULL AND effective_fee_rate IS NOT NULL")
                       .select("package_id", "block_number", "effective_fee_rate"))
                .groupBy("package_id", "block_number")
                .agg(F.min("effective_fee_rate").alias("lo"),
                     F.max("effective_fee_rate").alias("hi"))
                .agg(F.count_if(c("lo") < c("hi")).alias("violations"))
                .select(F.lit("package_price_mismatch").alias("check"),
                        "violations"))
    floors = (blocks.where("floor_fee_rate IS NOT NULL")
              .join(percentiles.select("block_number"), "block_number", "left_anti")
              .agg(F.count("*").alias("violations"))
              .select(F.lit("floor_without_percentiles").alias("check"),
                      "violations"))
    return simple.unionByName(packages).unionByName(floors)
