"""The low-fee test, its bands, and the summaries over them."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from feefloor.operators import lowfee, quality, summary
from feefloor.operators.relay import REASONS

M1, M2 = dt.date(2024, 1, 1), dt.date(2024, 2, 1)
TX = """tx_hash string, block_number long, block_timestamp timestamp, block_month date,
 is_coinbase boolean, fee long, virtual_size long, raw_fee_rate double,
 effective_fee_rate double, package_id string, package_tx_count long,
 is_nonrelayable boolean, """ + ", ".join(f"{r} boolean" for r in REASONS)
BLOCK = """block_number long, block_hash string, block_month date, pool_name string,
 pool_source string, weight long, floor_fee_rate double, median_fee_rate double,
 is_full boolean"""


def tx(name, block, rate, month=M1, vsize=100, coinbase=False, bad=False):
    return (name, block, dt.datetime(2024, 1, 2), month, coinbase, 1, vsize, rate, rate, name, 1,
            bad, *[bad and r == "nonrelay_dust" for r in REASONS])


@pytest.fixture(scope="module")
def tables(spark):
    rows = [
        tx("tie30", 10, 3.0), tx("under30", 10, 2.999), tx("tie50", 10, 5.0),
        tx("under70", 10, 6.9), tx("fair", 10, 10.0), tx("bad", 10, 0.5, bad=True),
        tx("unpriced", 10, None), tx("cb", 10, None, coinbase=True),
        tx("nofloor", 11, 0.1), tx("notfull", 12, 0.1), tx("noblock", 99, 0.1),
        tx("m2", 20, 20.0, M2), tx("empty", 13, 1.0, dt.date(2024, 3, 1))]
    blocks = [(10, "h10", M1, "A", "coinbase_tag", 3_950_000, 10.0, 12.0, True),
              (11, "h11", M1, "A", "coinbase_tag", 3_950_000, None, 12.0, True),
              (12, "h12", M1, "B", "unattributed", 3_000_000, 10.0, 12.0, False),
              (13, "h13", dt.date(2024, 3, 1), "B", "unattributed", 100, None, 1.0, False),
              (20, "h20", M2, "B", "unattributed", 3_950_000, 10.0, 12.0, True)]
    b = spark.createDataFrame(blocks, BLOCK)
    t = lowfee.apply_low_fee(spark.createDataFrame(rows, TX), b)
    return t.cache(), b.cache()


@pytest.fixture(scope="module")
def partials(tables):
    return summary.block_partials(tables[0])


def test_flags_are_strict_and_nested(tables):
    got = {r["tx_hash"]: (r["low_fee_30"], r["low_fee_50"], r["low_fee_70"])
           for r in tables[0].collect()}
    assert got["under30"] == (True, True, True)
    assert got["tie30"] == (False, True, True)
    assert got["tie50"] == (False, False, True)
    assert got["under70"] == (False, False, True)
    for name in ("fair", "bad", "unpriced", "cb", "nofloor", "notfull", "m2"):
        assert got[name] == (False, False, False)
    assert got["noblock"] == (None, None, None)


def test_low_fee_rows_and_bands(tables):
    got = {r["tx_hash"]: (round(r["lower_band_sats"], 6), r["upper_band_sats"])
           for r in lowfee.low_fee_txs(tables[0]).collect()}
    assert got == {"under30": (700.1, 1200.0), "tie30": (700.0, 1200.0),
                   "tie50": (500.0, 1200.0), "under70": (310.0, 1200.0)}
    top = [r["tx_hash"] for r in lowfee.top_low_fee(lowfee.low_fee_txs(tables[0]), 1).collect()]
    assert top == ["tie30"]  # equal values: by hash


def test_band_is_null_without_a_floor(spark):
    df = spark.createDataFrame([(None, 1.0, 5), (2.0, None, 5), (2.0, 3.0, 5)],
                               "floor_fee_rate double, effective_fee_rate double, "
                               "virtual_size long").withColumn("median_fee_rate", F.lit(1.0))
    got = [r[0] for r in df.select(lowfee.bands()["lower_band_sats"]).collect()]
    assert got == [None, None, 0.0]


def test_monthly_summary(partials):
    got = {r["block_month"]: r for r in summary.monthly_summary(partials).collect()}
    jan, feb, mar = got[M1], got[M2], got[dt.date(2024, 3, 1)]
    assert (jan["all_txs"], jan["all_vbytes"], jan["full_block_vbytes"]) == (10, 1000, 600)
    assert (jan["low_fee_txs_30"], jan["low_fee_txs_50"], jan["low_fee_txs_70"]) == (1, 2, 4)
    assert jan["private_vbytes_share_50"] == pytest.approx(200 / 600)
    assert (jan["nonrelayable_txs"], jan["dust_txs"], jan["truc_txs"]) == (1, 1, 0)
    # full priced space but no low-fee row: zero counts, no share
    assert (feb["full_block_vbytes"], feb["low_fee_txs_70"]) == (100, 0)
    assert feb["private_vbytes_share_70"] is None and feb["lower_band_sats_70"] == 0
    # no full block at all
    assert mar["full_block_vbytes"] == 0 and mar["private_vbytes_share_30"] is None


def test_pool_summary_counts_only_rows_with_a_block(partials):
    got = {(r["pool_name"], r["block_month"]): r for r in summary.pool_summary(partials).collect()}
    a = got[("A", M1)]
    assert (a["blocks"], a["vbytes"], a["full_block_vbytes"], a["low_fee_txs_50"]) == (
        2, 800, 600, 2)
    b = got[("B", M1)]
    assert b["full_block_vbytes"] == 0 and b["low_fee_share_of_full_50"] is None


def test_sensitivity_grid_and_totals(spark):
    """Seven equal blocks: the middle one is full at the weights it reaches."""
    blocks = spark.createDataFrame(
        [(n, f"h{n}", M1, "A", "x", 3_900_000, 10.0, 12.0, None) for n in range(1, 8)], BLOCK)
    txs = spark.createDataFrame(
        [tx("low", 4, 4.0), tx("ok", 4, 9.0), tx("bad", 4, 1.0, bad=True), tx("feb", 4, 1.0, M2),
         tx("edge", 1, 1.0)], TX)
    partials = summary.block_partials(lowfee.apply_low_fee(txs, blocks))
    grid = summary.low_fee_sensitivity(partials, blocks)
    got = {(r["block_month"], r["sensitivity"], r["full_weight"]):
           (r["low_fee_txs"], r["low_fee_vbytes"], r["full_block_vbytes"]) for r in grid.collect()}
    assert set(k[2] for k in got) == {3_850_000, 3_900_000}  # no row where none is full
    assert got[(M1, 0.3, 3_900_000)] == (0, 0, 200)
    assert got[(M1, 0.5, 3_900_000)] == (1, 100, 200)
    assert got[(M2, 0.3, 3_850_000)] == (1, 100, 100)
    totals = {(r["sensitivity"], r["full_weight"]): r
              for r in summary.sensitivity_totals(grid).collect()}
    cell = totals[(0.5, 3_900_000)]
    assert (cell["low_fee_vbytes"], cell["full_block_vbytes"]) == (200, 300)
    assert cell["low_fee_share"] == pytest.approx(2 / 3)  # from the sums, not a sum


def test_grid_blocks_agree_with_the_grid(spark):
    blocks = spark.createDataFrame(
        [(n, f"h{n}", M1, "A", "x", 3_800_000 + 25_000 * n, 1.0, 1.0, None)
         for n in range(1, 9)], BLOCK)
    rows = summary.grid_blocks(blocks).collect()
    assert len(rows) == 9 * 8
    for r in rows:
        w, n = r["full_weight"], r["block_number"]
        near = sum(1 <= n + o <= 8 and 3_800_000 + 25_000 * (n + o) >= w
                   for o in (-3, -2, -1, 1, 2, 3))
        assert r["is_full"] == (3_800_000 + 25_000 * n >= w and near >= 4)


def test_invariants_catch_each_fault(spark, tables):
    txs, blocks = tables
    pct = blocks.select("block_number").where("block_number <> 20")
    got = {r["check"]: r["violations"]
           for r in quality.invariants(txs, blocks, pct).collect()}
    assert got["missing_rate"] == 1
    assert got["floor_without_percentiles"] == 1
    broken = (txs.withColumn("is_nonrelayable", F.lit(True))
              .withColumn("package_id", F.lit("same")).withColumn("low_fee_70", F.lit(True)))
    got = {r["check"]: r["violations"]
           for r in quality.invariants(broken, blocks, pct).collect()}
    assert got["nonrelayable_coinbase"] == 1
    assert got["low_fee_nonrelayable"] == 13
    assert got["verdict_mismatch"] == 12
    assert got["package_price_mismatch"] == 1


def test_every_flagged_transaction_counts(spark, tables):
    """3,000 in one block, all of them in its audit."""
    rows = [tx(f"{i:04d}", 10, 1.0) for i in range(3000)]
    txs = lowfee.apply_low_fee(spark.createDataFrame(rows, TX), tables[1])
    flagged = quality.flagged_txs(txs, tables[1], "low_fee_50", 5)
    block = quality.flagged_blocks(flagged).first()
    assert block["low_fee_txs"] == 3000
    audits = spark.createDataFrame([(block["block_hash"], [r[0] for r in flagged.select(
        "tx_hash").collect()], [])], "block_hash string, added array<string>, "
        "accelerated array<string>")
    got = quality.audit_overlap(flagged, audits).first()
    assert (got["low_fee"], got["in_added"], got["in_accelerated"]) == (3000, 3000, 0)
    assert quality.flagged_txs(txs, tables[1], "low_fee_50", 11).isEmpty()


def test_audit_overlap(spark):
    flagged = spark.createDataFrame(
        [(7, "x7", "Elm", h) for h in ("p", "q", "r", "s")] + [(8, "x8", "Elm", "t")]
        + [(9, "x9", "Oak", h) for h in ("u", "v")],
        "block_number long, block_hash string, pool_name string, tx_hash string")
    audits = spark.createDataFrame(
        [("x7", ["q", "other"], ["p", "q", "r"]), ("x9", None, None), ("far", ["t"], ["u"])],
        "block_hash string, added array<string>, accelerated array<string>")
    by_block = {r["block_number"]: tuple(r)[2:] for r in
                quality.audit_overlap_by_block(flagged, audits).collect()}
    assert by_block == {7: (True, 4, 1, 3), 8: (False, None, None, None), 9: (True, 2, 0, 0)}
    got = quality.audit_overlap(flagged, audits).first()
    assert (got["blocks"], got["audited"], got["without_audit"], got["blocks_with_overlap"],
            got["low_fee"], got["in_added"], got["in_accelerated"]) == (3, 2, 1, 1, 6, 1, 3)
    assert got["accelerated_share"] == 0.5
    for n in (1, 2):
        picks = [{r["block_hash"] for r in quality.sampled_txs(flagged, n).collect()}
                 for _ in range(2)]
        assert picks[0] == picks[1] and len(picks[0]) == n
    assert quality.audit_overlap(flagged.limit(0), audits).first()["added_share"] is None
