"""What is moved and stored: keys before hashes, hashes packed, and nothing unread."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from feefloor.functions.hashes import HASHES, pack, packed, unpack, unpacked
from feefloor.operators.floor import block_percentiles
from feefloor.operators.packages import packages
from feefloor.operators.quality import audit_overlap_by_block, invariants
from feefloor.operators.relay import in_package_set, relay_reasons
from feefloor.operators.updates import price_packages
from feefloor.sinks.tables import write_months, write_stage
from testbed.chain_view import ChainTables, flat, raw_transactions, transaction_keys
from tests.test_plans import base_rows, no_broadcast, plan  # noqa: F401

TEXTS = ["", "00", "0", "ab", "AB", "aB", "abc", "01ab", "a\u0000", "\u0001", "é", "zz", " ab",
         "ab" * 32, "AB" * 32, "ab" * 31 + "g0", None]


def test_packed_texts_come_back_and_stay_apart(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string").select(
        "t", pack(F.col("t")).alias("p"))
    out = rows.select("t", "p", unpack(F.col("p")).alias("back")).collect()
    assert all(r["t"] == r["back"] for r in out)
    assert len({r["p"] for r in out}) == len(TEXTS)
    assert len(next(r["p"] for r in out if r["t"] == "ab" * 32)) == 33


def test_packed_columns_and_lists_come_back(spark):
    rows = spark.createDataFrame(
        [("ab", None, ["cd", None, "X"], 1), (None, "x", None, 2)],
        "tx_hash string, package_id string, parent_hashes array<string>, n int")
    assert [t for c, t in packed(rows).dtypes if c in HASHES] == [
        "binary", "binary", "array<binary>"]
    assert unpacked(packed(rows)).collect() == rows.collect()


def moved_types(df) -> list[str]:
    """Types of the hash columns that exchanges of the plan move."""
    found = []

    def walk(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if "Exchange" in name:
            output = node.output()
            for i in range(output.size()):
                column = output.apply(i)
                if column.name().removeprefix("_new_") in (*HASHES, "child_hash", "parent_hash"):
                    found.append(column.dataType().simpleString())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return found


def test_hashes_move_packed(spark, no_broadcast):  # noqa: F811
    linked = relay_reasons(base_rows(spark))
    packs = packages(in_package_set(linked))
    blocks = spark.createDataFrame([(1, 1.0)], "block_number long, floor_fee_rate double")
    flagged = linked.select("block_number", F.col("tx_hash").alias("block_hash"), "tx_hash",
                            F.lit("p").alias("pool_name"))
    audits = linked.select(F.col("tx_hash").alias("block_hash"), F.array("tx_hash").alias("added"),
                           F.array("tx_hash").alias("accelerated"))
    priced = price_packages(linked, packs)
    judged = priced.withColumn("low_fee_70", F.lit(False))
    for df in (linked, packs, priced, invariants(judged, blocks, blocks),
               audit_overlap_by_block(flagged, audits)):
        types = moved_types(df)
        assert types and all("string" not in t for t in types), types


@pytest.mark.parametrize("write", [
    lambda df, path: write_stage(df, path, "block_month", "n"), write_months])
def test_months_are_written_as_given(spark, tmp_path, write):
    rows = spark.createDataFrame(
        [("ab" * 32, ["AB", None], dt.date(2024, 1, 1), 2), (None, None, dt.date(2024, 1, 1), 1),
         ("no hex", [], None, 3)],
        "tx_hash string, parent_hashes array<string>, block_month date, n long")
    write(rows, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t")).select(*rows.columns)
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))
    files = [f for _, _, names in os.walk(tmp_path / "t") for f in names if f.startswith("part-")]
    assert files and all("zstd" in f for f in files)


def test_rates_are_moved_once(spark, no_broadcast):  # noqa: F811
    df = block_percentiles(spark.range(100).select(
        F.lit(False).alias("is_coinbase"), F.lit(False).alias("is_nonrelayable"),
        (F.col("id") % 3).alias("block_number"), (F.col("id") * 1.5).alias("effective_fee_rate")))
    assert len(df.collect()) == 3
    assert "ReusedExchange" in plan(df)


# --- the test tables seen as a chain ------------------------------------------

ORDERS = [(k, k % 7, 100.0 + k) for k in range(200)] + [(48, 3, 5.0), (48, 3, 5.0), (None, 1, 2.0),
                                                     (15, None, None)]
LINES = [(k, (k * 7 + j) % 91, float(1 + j), 50.0 * j) for k in range(0, 220, 2)
         for j in range(4)] + [(48, 5, 1.0, 9.0), (None, 3, 1.0, 2.0), (10, None, None, None)]


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame(ORDERS, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(
        str(tmp_path / "orders.parquet"))
    spark.createDataFrame(
        LINES, "l_orderkey long, l_partkey long, l_quantity double, l_extendedprice double"
    ).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(1, "Brand#11")], "p_partkey long, p_brand string").write.parquet(
        str(tmp_path / "part.parquet"))
    spark.createDataFrame([(0,)], "n_nationkey long").write.parquet(str(tmp_path / "nation.parquet"))
    spark.createDataFrame([(1, 1, "click", 1.0)],
                          "event_id long, user_id long, event_type string, value double"
                          ).write.parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path)


def listed(rows):
    return F.sort_array(F.transform(rows, lambda x: F.to_json(x)))


def test_transactions_are_the_flat_relations_joined(spark, folder):
    """Repeated and missing keys too: every copy of an order has the inputs of all."""
    ins = flat(spark, folder, "ins").groupBy("k").agg(F.collect_list(F.struct(
        F.col("spent").alias("spent_transaction_hash"),
        F.col("script").alias("script_hex"))).alias("inputs"))
    outs = flat(spark, folder, "outs").groupBy("k").agg(F.collect_list(F.struct(
        "value", F.col("script").alias("script_hex"),
        F.when(F.col("address").isNotNull(), F.array("address")).alias("addresses")))
        .alias("outputs"))
    names = ["tx_hash", "block_number", "block_timestamp", "is_coinbase", "fee", "virtual_size",
             "serialized_size", "version"]
    wanted = flat(spark, folder, "tx").join(ins, "k", "left").join(outs, "k", "left").select(
        *names, listed("inputs").alias("i"), F.coalesce(listed("outputs"), F.array()).alias("o"))
    found = raw_transactions(spark, folder).select(
        F.col("hash").alias("tx_hash"), *names[1:6], F.col("size").alias("serialized_size"),
        "version", listed("inputs").alias("i"), listed("outputs").alias("o"))
    assert sorted(map(str, found.collect())) == sorted(map(str, wanted.collect()))


def test_keys_are_moved_and_not_scripts(spark, folder):
    """Line items and orders move once, as numbers."""
    df = transaction_keys(spark, folder)
    text = plan(df)
    assert "sha2" not in text and "76a914" not in text
    assert text.count("Exchange hashpartitioning(place") == 1 and "Join" not in text


def test_pools_are_read_without_the_transactions(spark, folder, tmp_path):
    tables = ChainTables(spark, folder, str(tmp_path / "stages"))
    assert tables.source.pools.count() == 1
    assert os.listdir(tmp_path / "stages") == ["pools"]
