"""Plans at scale: what may and may not appear in them, and skewed inputs."""

import pytest
from pyspark.sql import functions as F

from feefloor.__main__ import main, parse
from feefloor.operators import lowfee, summary
from feefloor.operators.linkage import in_block_edges, relatives
from feefloor.operators.relay import relay_reasons, with_rates
from feefloor.policy import Policy
from tests.test_oracles import QUERIES, SF
from tests.test_relay_rules import SCHEMA, tx

# Decided per block or per pool source: three rows, so one task is no limit.
# Names of files, which only a listing tells.
FROM_THE_DRIVER = {"list_months": {"ExistingRDD"}}
ONE_TASK_WINDOWS = {"attribution_quality", "sanity_check"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_pairwise_join_and_no_row_python(spark, name):
    text = plan(QUERIES[name](spark, SF))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython",
                "ArrowEvalPython", "FlatMapGroupsInPandas", "ExistingRDD"):
        assert bad not in text or bad in FROM_THE_DRIVER.get(name, ()), f"{bad} in {name}"
    if name not in ONE_TASK_WINDOWS:
        for line in text.splitlines():
            assert "Window" not in line or "Limit" in line or "], [" in line, line


@pytest.fixture
def no_broadcast(spark):
    """Plans as they are when no side is small."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def base_rows(spark):
    return spark.createDataFrame([tx("a", "2024-01-01")], SCHEMA)


def test_links_shuffle_on_block_and_hash(spark, no_broadcast):
    text = plan(relay_reasons(base_rows(spark)))
    exchanges = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
    # spends, parents, link messages, facts: and never the block alone
    assert len(exchanges) == 4
    assert all(line.split("hashpartitioning(")[1].count("#") == 2 for line in exchanges)


def test_facts_are_joined_once(spark, no_broadcast):
    """After the low-fee flags nothing joins or moves facts: the partial sums move as
    sums, and the summaries read those alone."""
    from testbed.chain_view import chain_tables
    tables = chain_tables(spark, SF)
    assert tables["low_fee_sensitivity"].count() > 0  # builds the tables
    text = plan(summary.block_partials(tables["txs"]))
    assert "Join" not in text and text.count("Exchange hashpartitioning(") == 1
    before = text.split("Exchange hashpartitioning(")[1]
    assert "partial_sum(virtual_size" in before or "partial_count" in before
    assert "Join" not in plan(lowfee.low_fee_txs(tables["txs"]))
    assert "Exchange" not in plan(lowfee.low_fee_txs(tables["txs"]))
    partials = tables["block_partials"]
    for result in (summary.monthly_summary(partials), summary.pool_summary(partials)):
        assert "Join" not in plan(result)
    grid = plan(summary.low_fee_sensitivity(partials, tables["blocks"]))
    wide = Policy(sensitivities=tuple(n / 10 for n in range(1, 10)),
                  fullness_grid=tuple(range(3_800_000, 3_980_000, 20_000)))
    nine = plan(summary.low_fee_sensitivity(partials, tables["blocks"], wide))
    for part in ("Exchange hashpartitioning", "Scan", "FileScan"):
        assert grid.count(part) == nine.count(part)


def test_small_block_tables_are_broadcast(spark):
    from testbed.chain_view import chain_tables
    tables = chain_tables(spark, SF)
    text = plan(lowfee.apply_low_fee(tables["txs"], tables["blocks"]))
    assert "BroadcastHashJoin" in text and "hashpartitioning" not in text


def test_a_parent_of_a_third_of_all_rows(spark, no_broadcast):
    """One parent, thousands of children, one block: counted right, and the
    children's shuffle combines before it moves them."""
    n = 6_000
    plain = base_rows(spark).drop("tx_hash", "input_hashes")
    rows = plain.crossJoin(spark.range(n)).select(
        F.format_string("%05d", "id").alias("tx_hash"),
        F.when(F.col("id") % 3 == 1, F.array(F.lit("00000")))
        .otherwise(F.array().cast("array<string>")).alias("input_hashes"),
        *plain.columns)
    out = relatives(in_block_edges(with_rates(rows)))
    hot = out.where("tx_hash = '00000'").first()
    assert hot["child_count"] == n // 3 and hot["parent_hashes"] == []
    assert hot["has_paying_child"] is True
    assert out.count() == n // 3 + 1
    assert "partial_sum(child" in plan(out)


def test_command_line(spark, tmp_path, capsys):
    args = parse(["run-pipeline", "--transactions", "t", "--blocks", "b", "--pools", "p",
                  "--run", "r", "--month", "2024-03", "--from", "txs"])
    assert (args.month, args.from_step, args.only) == ("2024-03", "txs", None)
    with pytest.raises(SystemExit):
        parse(["validate", "--run", "r"])
    (tmp_path / "2024-01.json").write_text("[]")
    main(["missing-months", "--data", str(tmp_path)])
    assert "2024-02" in capsys.readouterr().out
