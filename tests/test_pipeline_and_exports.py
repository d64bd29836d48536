"""The pipeline over a small chain, its exports, merges and checks."""

import datetime as dt
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from feefloor.functions.scripts import int_div
from feefloor.plans import jobs
from feefloor.plans.pipeline import STEPS, Source, Stages, check, run_pipeline, select_steps
from feefloor.sinks import report, results, tables
from feefloor.sinks.published import Draft, Published
from feefloor.sources.chain import month_window, read_blocks, read_transactions

TX = """hash string, block_number long, block_timestamp timestamp, block_timestamp_month date,
 is_coinbase boolean, fee decimal(38,9), virtual_size long, size long, version long,
 inputs array<struct<spent_transaction_hash:string,script_hex:string>>,
 outputs array<struct<value:decimal(38,9),script_hex:string,addresses:array<string>>>"""
BLOCK = """number long, hash string, timestamp timestamp, timestamp_month date, weight long,
 size long, transaction_count long, coinbase_param string"""
P2WPKH = "0014" + "11" * 20


def small_chain():
    """Twenty full blocks in March, four in April; each has one cheap sale."""
    txs, blocks = [], []
    for b in range(24):
        stamp = dt.datetime(2024, 3 if b < 20 else 4, 1 + b % 20, tzinfo=dt.timezone.utc)
        month = stamp.date().replace(day=1)
        blocks.append((b, f"h{b}", stamp, month, 3_990_000, 1, 12, b"/Ant/".hex()))
        txs.append((f"{b}-cb", b, stamp, month, True, Decimal(0), 100, 100, 2, [(None, "03aa")],
                    [(Decimal(1), P2WPKH, ["payout"])]))
        for i in range(10):
            fee = 100 if i == 0 else 2_000 + 10 * i
            spent = f"{b}-8" if i == 9 else "old"
            txs.append((f"{b}-{i}", b, stamp, month, False, Decimal(fee), 100, 100, 2, [(spent, "")],
                        [(Decimal(100_000), P2WPKH, [])]))
    return txs, blocks


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("raw"))
    txs, blocks = small_chain()
    spark.createDataFrame(txs, TX).write.partitionBy("block_timestamp_month").parquet(f"{path}/t")
    spark.createDataFrame(blocks, BLOCK).write.parquet(f"{path}/b")
    return path


@pytest.fixture(scope="module")
def source(spark, raw):
    pools = spark.createDataFrame([("Ant", 1, ["/ant/"], [])], "pool_name string, pool_id long, "
                                  "tags array<string>, addresses array<string>")
    return Source(read_transactions(spark, f"{raw}/t"), read_blocks(spark, f"{raw}/b"), pools)


@pytest.fixture(scope="module")
def march(spark, source, tmp_path_factory):
    return run_pipeline(spark, source, str(tmp_path_factory.mktemp("march")),
                        month_window("2024-03"))


def test_the_window_prunes_partitions(spark, raw):
    df = read_transactions(spark, f"{raw}/t", month_window("2024-03"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(block_timestamp_month" in plan
    assert df.count() == 220


def test_pipeline_end_to_end(march):
    assert march["txs"].count() == 220
    row = march["monthly_summary"].first()
    assert row["block_month"] == dt.date(2024, 3, 1)
    assert (row["all_txs"], row["nonrelayable_txs"]) == (200, 0)
    # the first and last three blocks have no floor
    assert row["full_block_vbytes"] == 14 * 1000
    assert row["low_fee_txs_30"] == 14 and row["low_fee_vbytes_50"] == 1400
    pair = march["txs"].where("tx_hash IN ('5-8', '5-9')").collect()
    assert {r["effective_fee_rate"] for r in pair} == {20.85}
    assert {r["package_id"] for r in pair} == {"5-8"}
    pools = march["pool_summary"].collect()
    assert [(p["pool_name"], p["blocks"], p["low_fee_txs_50"]) for p in pools] == [("Ant", 20, 14)]
    assert march["low_fee_sensitivity"].count() == 9


def test_checks_pass(march):
    assert all(r["violations"] == 0 for r in check(march, strict=True).collect())


def test_checks_can_raise(spark, march, tmp_path):
    copy = Stages(spark, str(tmp_path))
    for name in ("blocks", "block_percentiles"):
        copy.write(name, march[name])
    copy.write("txs", march["txs"].withColumn("effective_fee_rate", F.lit(None).cast("double")))
    with pytest.raises(ValueError, match="missing_rate: 200"):
        check(copy, strict=True)


def test_step_selection():
    assert select_steps() == list(STEPS)
    assert select_steps(only="txs,blocks") == ["blocks", "txs"]
    assert select_steps(from_step="pool_summary") == ["pool_summary", "low_fee_sensitivity"]
    for kwargs in ({"only": "nope"}, {"from_step": "nope"}):
        with pytest.raises(ValueError, match="nope"):
            select_steps(**kwargs)


def test_late_steps_run_from_stored_tables(spark, source, march, tmp_path):
    copy = Stages(spark, str(tmp_path))
    for name in ("txs", "blocks"):
        copy.write(name, march[name])
    again = run_pipeline(spark, source, str(tmp_path), from_step="low_fee_txs")
    assert again["pool_summary"].collect() == march["pool_summary"].collect()
    assert again["block_partials"].count() == march["block_partials"].count()
    assert again["low_fee_txs"].count() == march["low_fee_txs"].count()


def test_tx_base_reads_only_needed_nested_fields(spark, raw):
    from feefloor.operators.extract import tx_base
    plan = tx_base(read_transactions(spark, f"{raw}/t")).select(
        "tx_hash", "max_scriptsig_bytes")._jdf.queryExecution().executedPlan().toString()
    read = plan[plan.index("ReadSchema"):]
    assert "outputs" not in read and "version" not in read


# --- exports ---------------------------------------------------------------

def read_json(spark, path):
    return [json.loads(r[0]) for r in spark.read.text(path).collect()]


def with_month(spark, stages, folder, month, factor=1):
    """Result tables of a run, moved to another month and scaled."""
    out = Stages(spark, folder)
    for name in (*jobs.RESULTS, "low_fee_txs", "onchain_monthly_fee"):
        df = stages[name].withColumn("block_month", F.lit(month))
        for c in ("low_fee_vbytes_50", "low_fee_vbytes", "full_block_vbytes", "fee_sats"):
            if c in df.columns:
                df = df.withColumn(c, F.col(c) * factor)
        if name == "low_fee_txs":
            df = df.withColumn("tx_hash", F.concat("tx_hash", F.lit(f"@{month}x{factor}")))
        out.write(name, df)
    return out


def test_months_merge_and_rerun_replaces(spark, march, tmp_path):
    out, april = str(tmp_path / "out"), dt.date(2024, 4, 1)
    assert jobs.export_results(march, out)
    for factor in (2, 3):  # the second run of April replaces the first
        run = with_month(spark, march, str(tmp_path / f"run{factor}"), april, factor)
        assert jobs.export_results(run, out)
    now = Published(spark, out)
    assert now.version == 3
    rows = read_json(spark, now.path("monthly_summary.json"))
    assert [(r["block_month"], r["low_fee_vbytes_50"]) for r in rows] == [
        ("2024-03-01", 1400), ("2024-04-01", 4200)]
    assert rows[0]["private_vbytes_share_50"] == pytest.approx(0.1)
    assert len(read_json(spark, now.path("low_fee_sensitivity.json"))) == 18
    sample = read_json(spark, now.path("low_fee_txs_sample.json"))
    assert len(sample) == 28 and not any("x2" in r["tx_hash"] for r in sample)
    text = "\n".join(r[0] for r in spark.read.text(now.path("summary")).collect())
    assert "2024-03-01 - 2024-04-01" in text and "| Ant |" in text
    heads = json.loads("\n".join(r[0] for r in spark.read.text(now.path("headline"), wholetext=True)
                                 .collect()))
    assert heads["50"]["low_fee_vbytes"] == 5600 and heads["50"]["months"] == 2

    empty = Stages(spark, str(tmp_path / "empty"))
    for name in (*jobs.RESULTS, "low_fee_txs"):
        empty.write(name, march[name].limit(0))
    assert not jobs.export_results(empty, out)
    assert Published(spark, out).version == 3

    may = with_month(spark, march, str(tmp_path / "may"), dt.date(2024, 5, 1))
    assert jobs.export_results(may, out, replace=True)
    now = Published(spark, out)
    assert [r["block_month"] for r in read_json(spark, now.path("monthly_summary.json"))] == [
        "2024-05-01"]


def test_onchain_fee_export(spark, march, tmp_path):
    out = str(tmp_path)
    assert jobs.export_onchain_fee(march, out)
    run = with_month(spark, march, str(tmp_path / "run"), dt.date(2024, 2, 1), 2)
    assert jobs.export_onchain_fee(run, out)
    now = Published(spark, f"{out}/onchain")
    document, = read_json(spark, now.path("onchain_monthly_fee.json"))
    fee = march["onchain_monthly_fee"].first()["fee_sats"]
    assert [(r["month"], r["fee_sats"]) for r in document["months"]] == [
        ("2024-02", 2 * fee), ("2024-03", fee)]
    assert (document["first_month"], document["last_month"]) == ("2024-02", "2024-03")
    assert document["total_fee_btc"] == pytest.approx(3 * fee / 1e8)
    assert set(document["months"][0]) == {"month", "txs", "blocks", "fee_sats", "fee_btc", "vbytes",
                                          "fee_rate_sat_vb"}
    # the same months again: nothing is written
    assert jobs.export_onchain_fee(march, out) and jobs.export_onchain_fee(run, out)
    assert Published(spark, f"{out}/onchain").version == now.version == 2


@pytest.mark.parametrize("stop", ["write_result_json", "write_summary", "commit"])
def test_an_export_that_stops_loses_no_month(spark, march, tmp_path, monkeypatch, stop):
    """Ended while documents are written, or just before the new version is in place."""
    out = str(tmp_path / "out")
    assert jobs.export_results(march, out)
    before = read_json(spark, Published(spark, out).path("monthly_summary.json"))

    def killed(*_args):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(*((Draft, stop) if stop == "commit" else (jobs, stop)), killed)
        for month in (dt.date(2024, 3, 1), dt.date(2024, 4, 1)):
            run = with_month(spark, march, str(tmp_path / f"{month}"), month, 5)
            with pytest.raises(KeyboardInterrupt):
                jobs.export_results(run, out, replace=month.month == 4)
    now = Published(spark, out)
    assert now.version == 1
    assert read_json(spark, now.path("monthly_summary.json")) == before
    assert jobs.export_results(run, out)  # and the next one goes on from there
    now = Published(spark, out)
    assert [r["block_month"] for r in read_json(spark, now.path("monthly_summary.json"))] == [
        "2024-03-01", "2024-04-01"]


def test_merge_is_idempotent(spark):
    old = spark.createDataFrame([("2024-01", 1), ("2024-02", 2)], "block_month string, v long")
    fresh = spark.createDataFrame([("2024-02", 5), ("2024-03", 6)], "block_month string, v long")
    once = tables.merge_months(old, fresh, tables.months_covered(fresh))
    twice = tables.merge_months(once, fresh, tables.months_covered(fresh))
    want = [("2024-01", 1), ("2024-02", 5), ("2024-03", 6)]
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == want
    assert tables.merge_months(None, fresh, tables.months_covered(fresh)) is fresh


def test_the_sample_keeps_the_largest(spark):
    schema = "tx_hash string, block_month string, upper_band_sats double"
    old = spark.createDataFrame([("big", "1", 900.0), ("small", "1", 1.0), ("gone", "2", 999.0)],
                                schema)
    fresh = spark.createDataFrame([("mid", "2", 500.0)], schema)
    kept = tables.merge_sample(old, fresh, tables.months_covered(fresh), 2)
    assert [r["tx_hash"] for r in tables.top_rows(kept, 2).collect()] == ["big", "mid"]


def test_a_replaced_month_brings_rows_back(spark):
    """Rows that a rich month kept out of the sample return when it is replaced."""
    schema = "tx_hash string, block_month string, upper_band_sats double"
    first = spark.createDataFrame([(f"r{i}", "1", 900.0 + i) for i in range(3)]
                                  + [("x", "2", 5.0), ("y", "2", 4.0)], schema)
    stored = tables.merge_sample(None, first, tables.months_covered(first), 3)
    assert {r[0] for r in tables.top_rows(stored, 3).collect()} == {"r0", "r1", "r2"}
    poor = spark.createDataFrame([("z", "1", 1.0)], schema)
    again = tables.merge_sample(stored, poor, tables.months_covered(poor), 3)
    assert [r[0] for r in tables.top_rows(again, 3).collect()] == ["x", "y", "z"]


def test_a_broken_part_or_manifest_stops_the_export(spark, march, tmp_path):
    out = tmp_path / "out"
    assert jobs.export_results(march, str(out))
    april = with_month(spark, march, str(tmp_path / "april"), dt.date(2024, 4, 1))
    for part in out.glob("part-*/pool_summary/*/*.parquet"):
        part.write_bytes(b"no table")
    with pytest.raises(Exception):
        jobs.export_results(april, str(out))
    assert Published(spark, str(out)).version == 1
    for file in out.glob("manifest/*.json"):
        file.write_text("{broken")
    with pytest.raises(Exception):
        jobs.export_results(april, str(out))
    with pytest.raises(FileNotFoundError):
        Published(spark, str(tmp_path / "nowhere")).path("summary")


def test_json_values(spark, tmp_path):
    df = spark.sql("SELECT DATE '2023-04-01' AS d, CAST(1.5 AS DECIMAL(5,2)) AS n, "
                   "CAST('NaN' AS DOUBLE) AS x, CAST(NULL AS STRING) AS s, true AS b")
    results.write_result_json(df, str(tmp_path / "t"))
    assert read_json(spark, str(tmp_path / "t")) == [
        {"d": "2023-04-01", "n": 1.5, "x": None, "s": None, "b": True}]


def test_report_without_full_blocks(spark, march):
    monthly = march["monthly_summary"].withColumn("full_block_vbytes", F.lit(0).cast("long"))
    text, heads = report.summary_report(monthly, march["low_fee_sensitivity"],
                                        march["pool_summary"].limit(0))
    assert "| - |" in text and heads["30"]["share_of_full_block_space"] is None
    assert "## Pools" not in text


def test_month_folders_are_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "m")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "v long, block_month string")
    tables.write_months(df, path)
    tables.write_months(df.where("v = 2").withColumn("v", F.lit(7).cast("long")), path)
    assert sorted((r["v"], r["block_month"]) for r in spark.read.parquet(path).collect()) == [
        (1, "a"), (7, "b")]


def test_sanity_check_and_validate(spark, source, march):
    tables_ = jobs.sanity_check(source.blocks, march)
    assert tables_["attribution_quality"].first()["share"] == 1.0
    assert [(r["blocks"], r["share"]) for r in tables_["monthly_pool_shares"].collect()] == [
        (20, 1.0)]
    assert tables_["unattributed_texts"].isEmpty()
    audits = march["blocks"].select("block_hash", F.array(F.concat(
        F.col("block_number").cast("string"), F.lit("-0"))).alias("added"),
        F.array().cast("array<string>").alias("accelerated"))
    got = jobs.validate(march, audits, sample=5, min_height=0).first()
    assert (got["blocks"], got["in_added"], got["in_accelerated"]) == (5, 5, 0)


def test_integer_division_truncates(spark):
    got = spark.range(1).select(int_div(F.lit(-7), 2), int_div(F.lit(7), 2)).first()
    assert tuple(got) == (-3, 3)


def test_shared_folder_setting_is_used(spark):
    from feefloor.session import cut_lineage, shared_dir
    assert shared_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
    df = cut_lineage(spark.range(3), "x")
    assert df.count() == 3 and df.inputFiles()[0].startswith("file:")
