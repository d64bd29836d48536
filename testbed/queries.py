"""Every operator as a query over the test tables, with its DuckDB statement.

Each entry is (Spark function of the chain tables, oracle SELECT or None).
Doubles that come from sums or interpolation are rounded on both sides, since
the order of additions is free; plain quotients are compared as they are.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feefloor.functions import measures as M
from feefloor.functions import scripts as S
from feefloor.operators import accelerations as acc
from feefloor.operators import attribution as att
from feefloor.operators import extract, floor, linkage, lowfee, packages, quality, relay
from feefloor.operators import summary, updates
from feefloor.plans import jobs, pipeline
from feefloor.policy import Policy, policy_as_of
from feefloor.plans.pipeline import Stages
from feefloor.sinks import report, results, tables
from feefloor.sinks.published import Published
from feefloor.sources import accelerations as src_acc
from feefloor.sources import chain, pools as src_pools
from testbed.chain_view import ChainTables, accelerations
from testbed.oracle import OFFSETS, REASONS, SENS

P = Policy()
WINDOW = chain.month_window("2024-03")
MONTH = "DATE '2024-03-01'"
# Months that stand for a re-run in the merge queries.
RERUN = dt.date(2024, 1, 1)


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


def select_rounded(select: str, digits: dict[str, int]) -> str:
    swaps = ", ".join(f"round({c}, {d}) AS {c}" for c, d in digits.items())
    return f"SELECT * REPLACE ({swaps}) FROM ({select})"


def both(fn, select: str, digits: dict[str, int] | None = None):
    if not digits:
        return fn, select
    return (lambda t: rounded(fn(t), digits)), select_rounded(select, digits)


# --- inputs ----------------------------------------------------------------

def outputs(t: ChainTables) -> DataFrame:
    return t.source.transactions.select(
        F.col("hash").alias("tx_hash"), F.inline("outputs")).withColumnRenamed(
        "script_hex", "script")


def per_output(**columns):
    """A query over every output: its value, script, and functions of these."""
    def run(t: ChainTables) -> DataFrame:
        value, script = F.col("value"), F.col("script")
        return outputs(t).select("tx_hash", "value", "script",
                                 *[c(value, script).alias(n) for n, c in columns.items()])
    return run


def out_sql(columns: str) -> str:
    return f"SELECT t.tx_hash, o.value, o.script, {columns} FROM out_class o JOIN tx t USING (k)"


def rated(t: ChainTables) -> DataFrame:
    return relay.with_rates(t["tx_base"], P)


def pool_docs(t: ChainTables) -> DataFrame:
    """The pool list as JSON documents, one per pool in list form."""
    entry = F.struct(F.col("pool_id").alias("id"), F.col("pool_name").alias("name"),
                     "tags", "addresses")
    return t.source.pools.select(F.to_json(F.array(entry)).alias("value"))


def refreshed(t: ChainTables) -> DataFrame:
    """A fresh list of all pools against a table that holds the tagged ones, some of
    them with other tags or addresses, and one that is gone."""
    entry = F.struct(F.col("pool_id").alias("id"), F.col("pool_name").alias("name"),
                     "tags", "addresses")
    listing, table = roundtrip(t, "list"), roundtrip(t, "pools")
    # One document of at most 25 entries, as the list is published.
    t.source.pools.agg(F.to_json(F.collect_list(entry)).alias("value")).write.text(listing)
    number = F.regexp_extract("pool_name", "([0-9]+)$", 1).cast("long")
    old = t.source.pools.where("size(tags) > 0").withColumns({
        "tags": F.when(number % 4 == 0, F.array_append("tags", F.lit("old"))).otherwise(
            F.reverse("tags")),
        "addresses": F.when(number % 6 == 0, F.array(F.lit("moved"))).otherwise(
            F.col("addresses")),
        "pool_name": F.when(number == 3, "Pool gone").otherwise(F.col("pool_name"))})
    old.write.parquet(table)
    return jobs.refresh_pools(t.spark, listing, table)


REFRESHED_SQL = """(SELECT coalesce(n.pool_name, o.pool_name) AS pool_name,
  CASE WHEN o.pool_name IS NULL THEN 'new' WHEN n.pool_name IS NULL THEN 'not upstream'
    WHEN o.num % 4 = 0 AND o.num % 6 = 0 THEN 'tags and addresses' WHEN o.num % 4 = 0 THEN 'tags'
    WHEN o.num % 6 = 0 THEN 'addresses' ELSE 'same' END AS change,
  coalesce(n.pool_id IS NOT NULL, FALSE) AS has_id
  FROM (SELECT DISTINCT pool_name, pool_id FROM pool_ids WHERE pool_name IN (SELECT pool_name
      FROM pool_tags UNION SELECT pool_name FROM pool_addresses)) n
  FULL JOIN (SELECT DISTINCT CAST(substr(pool_name, 6) AS BIGINT) AS num,
      CASE WHEN pool_name = 'Pool 3' THEN 'Pool gone' ELSE pool_name END AS pool_name
    FROM pool_tags) o ON n.pool_name = o.pool_name)"""


def exported(t: ChainTables, replace: bool = False) -> Published:
    """A run's results published; with ``replace`` once more, for the later months alone."""
    names = (*jobs.RESULTS, "low_fee_txs")
    out = roundtrip(t, "export")
    jobs.export_results(_with(t, *names), out)
    if replace:
        later = Stages(t.spark, roundtrip(t, "later"))
        for name in names:
            later.write(name, t[name].where(F.col("block_month") >= RERUN))
        jobs.export_results(later, out, replace=True)
    return Published(t.spark, out)


def exported_json(t: ChainTables, name: str, replace: bool = False) -> DataFrame:
    schema = results.json_safe(t[name.removesuffix("_sample")]).schema
    return t.spark.read.schema(schema).json(exported(t, replace).path(f"{name}.json"))


def report_heads(t: ChainTables) -> DataFrame:
    """The report written, and its headline document read back."""
    out = roundtrip(t, "report")
    report.write_summary(t.spark, out, t["monthly_summary"], t["low_fee_sensitivity"],
                         t["pool_summary"])
    fields = results.json_safe(report.headline_table(t["monthly_summary"])).schema
    text = t.spark.read.text(f"{out}/headline", wholetext=True)
    heads = F.from_json("value", f"map<string,struct<{','.join(
        f'{f.name}:{f.dataType.simpleString()}' for f in fields)}>>")
    return text.select(F.explode(F.map_values(heads)).alias("h")).select("h.*")


def exported_onchain(t: ChainTables) -> DataFrame:
    """Months published twice, the second time only some; the document read back."""
    out = roundtrip(t, "onchain")
    early = Stages(t.spark, roundtrip(t, "early"))
    df = onchain(t)
    early.write("onchain_monthly_fee", df.withColumn("fee_sats", F.col("fee_sats") + F.when(
        F.col("block_month") >= RERUN, 1).otherwise(0)))
    jobs.export_onchain_fee(early, out)
    late = Stages(t.spark, roundtrip(t, "late"))
    late.write("onchain_monthly_fee", df.where(F.col("block_month") >= RERUN))
    jobs.export_onchain_fee(late, out)
    path = Published(t.spark, f"{out}/onchain").path("onchain_monthly_fee.json")
    month = "struct<month:string,txs:bigint,blocks:bigint,fee_sats:bigint,fee_btc:double," \
            "vbytes:bigint,fee_rate_sat_vb:double>"
    return (t.spark.read.schema(f"months array<{month}>, first_month string, last_month string, "
                                "total_fee_btc double").json(path)
            .select(F.inline("months"), "first_month", "last_month", "total_fee_btc"))


def acceleration_files(t: ChainTables) -> str:
    """Records as monthly files of JSON lines, and an empty file of an earlier month."""
    parts, folder = roundtrip(t, "acc-parts"), roundtrip(t, "acc")
    (accelerations(t.spark, t.sf_dir).repartition("month").write.partitionBy("month").json(parts))
    jvm = t.spark._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(parts).getFileSystem(t.spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(folder))
    for month in fs.globStatus(path(f"{parts}/month=*")):
        name = month.getPath().getName().removeprefix("month=")
        file, = fs.globStatus(path(f"{parts}/month={name}/part-*"))
        fs.rename(file.getPath(), path(f"{folder}/{name}.json"))
    fs.create(path(f"{folder}/2023-12.json")).close()
    return folder


def ran_accelerations(t: ChainTables) -> DataFrame:
    """The job over monthly files; what it wrote, as pool:fee lists."""
    listing, out = roundtrip(t, "list"), roundtrip(t, "acc-out")
    entry = F.struct(F.col("pool_id").alias("id"), F.col("pool_name").alias("name"))
    t.source.pools.agg(F.to_json(F.collect_list(entry)).alias("value")).write.text(listing)
    jobs.run_accelerations(t.spark, acceleration_files(t), listing, out, multi_line=False)
    rows = t.spark.read.schema("month string, value string").json(
        f"{out}/accelerations_by_month.json")
    parsed = F.from_json("value", "pools map<string,bigint>, sum bigint")
    return rows.select("month", parsed.alias("v")).select("month", F.array_join(F.array_sort(
        F.transform(F.map_entries("v.pools"), lambda e: F.concat_ws(
            ":", e["key"], e["value"].cast("string")))), ",").alias("pools"), "v.sum")


def ran_pipeline(t: ChainTables) -> Stages:
    """All steps by the job itself, in a folder of its own."""
    return pipeline.run_pipeline(t.spark, t.source, roundtrip(t, "run"))


def ran_late_steps(t: ChainTables) -> DataFrame:
    """Steps from a named one on, over tables stored before."""
    copy = Stages(t.spark, roundtrip(t, "late-run"))
    for name in ("txs", "blocks"):
        copy.write(name, t[name])
    return pipeline.run_pipeline(t.spark, t.source, copy.folder, from_step="low_fee_txs")[
        "pool_summary"]


def sanity(t: ChainTables) -> DataFrame:
    parts = jobs.sanity_check(t.source.blocks, _with(t, "blocks"))
    month = F.date_format("block_month", "yyyy-MM-dd")
    none = F.lit(None)
    return (parts["monthly_pool_shares"].select(
        F.concat_ws(" ", month, "pool_name").alias("what"), "blocks", "share")
        .unionByName(parts["attribution_quality"].select(
            F.col("pool_source").alias("what"), "blocks", "share"))
        .unionByName(parts["unattributed_texts"].select(
            F.concat(F.lit("text "), "coinbase_text").alias("what"), "blocks",
            none.cast("double").alias("share"))))


def damaged(t: ChainTables) -> DataFrame:
    """The invariants over rows with every kind of damage, each in a part of the rows."""
    k = F.conv(F.substring("tx_hash", 64, 1), 16, 10).cast("int")
    txs = t["txs"].withColumns({
        "effective_fee_rate": F.when(k == 1, None).when(k == 2, F.col("block_number") + 0.5)
        .otherwise(F.col("effective_fee_rate")),
        "low_fee_70": F.col("low_fee_70") | (k == 3),
        "is_nonrelayable": F.col("is_nonrelayable") != (k == 4)})
    lacking = t["block_percentiles"].where("block_number % 3 <> 0")
    return quality.invariants(txs, t["blocks"], lacking)


def audits(t: ChainTables) -> DataFrame:
    """Audit lists derived from the transactions: blocks with an even number
    have one; it lists some of the block's hashes (a block has 49 at most)."""
    last = F.conv(F.substring("tx_hash", 64, 1), 16, 10).cast("int")
    lists = t["txs"].where("block_number % 2 = 0").groupBy("block_number").agg(
        F.collect_list(F.when(last % 3 == 0, F.col("tx_hash"))).alias("added"),
        F.collect_list(F.when(last % 5 == 0, F.col("tx_hash"))).alias("accelerated"))
    return t["blocks"].select("block_number", "block_hash").join(lists, "block_number").drop(
        "block_number")


def flagged(t: ChainTables) -> DataFrame:
    return quality.flagged_txs(t["txs"], t["blocks"], "low_fee_70", 790_000)


def roundtrip(t: ChainTables, name: str) -> str:
    return f"{t.stages.folder}/io-{name}-{uuid.uuid4().hex}"


AUDIT_SQL = """
  (SELECT b.block_hash, list(v.tx_hash) FILTER (WHERE (instr('0123456789abcdef',
      substr(v.tx_hash, 64, 1)) - 1) % 3 = 0) AS added,
    list(v.tx_hash) FILTER (WHERE (instr('0123456789abcdef',
      substr(v.tx_hash, 64, 1)) - 1) % 5 = 0) AS accelerated
  FROM verdicts v JOIN blocks b USING (block_number) WHERE block_number % 2 = 0
  GROUP BY b.block_hash)"""
BASE_COLUMNS = """tx_hash, block_number, block_month, is_coinbase, fee, virtual_size,
  serialized_size, version, bare_multisig_max_n, op_return_count, op_return_max_bytes,
  op_return_total_bytes, nonstandard_outputs, dust_outputs, dust_outputs_excl_multisig,
  max_scriptsig_bytes, opens_with_nonpush_opcode"""
STAT_COLUMNS = S.OUTPUT_STATS
SPENDS = "(SELECT DISTINCT k, spent FROM ins WHERE spent IS NOT NULL)"
BAND = {f"{b}_band_sats_{s}": 2 for s, _ in SENS for b in ("lower", "upper")}
LOW_FLAGS = ", ".join(f"low_fee_{s}" for s, _ in SENS)


def joined(df: DataFrame, *columns: str) -> DataFrame:
    """Array columns as sorted text, which every engine compares alike."""
    return df.withColumns({c: F.array_join(F.array_sort(c), ",") for c in columns})


def io_stage(t: ChainTables) -> DataFrame:
    df = t["txs"].select("tx_hash", "block_number", "block_month", "fee")
    return tables.write_stage(df, roundtrip(t, "stage"), "block_month", "block_number")


def io_months(t: ChainTables) -> DataFrame:
    """Two writes to one table; the second replaces one month only."""
    df = t["txs"].select("tx_hash", "block_month", "fee")
    path = roundtrip(t, "months")
    tables.write_months(df, path)
    tables.write_months(df.where(F.col("block_month") == RERUN)
                        .withColumn("fee", F.col("fee") + 1), path)
    return t.spark.read.schema(df.schema).parquet(path).select(*df.columns)


def io_json(t: ChainTables) -> DataFrame:
    df = t["pool_summary"]
    path = roundtrip(t, "json")
    results.write_result_json(df, path, ["block_month", "pool_name"])
    return t.spark.read.schema(results.json_safe(df).schema).json(path).select(
        "block_month", "pool_name", "blocks", "vbytes", "low_fee_vbytes_50")


def io_accelerations(t: ChainTables) -> DataFrame:
    """Records read back from monthly files, with the month of their file."""
    return src_acc.read_accelerations(t.spark, acceleration_files(t), multi_line=False).select(
        "txid", "status", "feeDelta", "minedByPoolUniqueId", "month")


def pool_update(t: ChainTables) -> DataFrame:
    """Unit-free check of the update rule: even blocks get a new value."""
    target = t["blocks"].select("block_number", "weight", "pool_name")
    source = target.where("block_number % 2 = 0").select(
        "block_number", (F.col("weight") + 1).alias("weight"))
    return updates.apply_update(target, source, ["block_number"], ["weight"])


def acc_months(t: ChainTables) -> DataFrame:
    records = accelerations(t.spark, t.sf_dir).select("month").distinct()
    return records.unionByName(records.select(F.lit("2023-12").alias("month")).distinct())


def acc_fees(t: ChainTables) -> DataFrame:
    return acc.pool_fees_by_month(accelerations(t.spark, t.sf_dir),
                                  src_pools.parse_pool_ids(pool_docs(t)), acc_months(t))


def stale(df: DataFrame) -> DataFrame:
    """An earlier export: other values for the re-run month, and older months."""
    return df.withColumn("low_fee_vbytes_50", F.lit(-1).cast("long"))


def merged_months(t: ChainTables) -> DataFrame:
    small = t["pool_summary"].select("pool_name", "block_month", "low_fee_vbytes_50")
    fresh = small.where(F.col("block_month") >= RERUN)
    return tables.merge_months(stale(small), fresh, tables.months_covered(fresh))


def merged_sample(t: ChainTables) -> DataFrame:
    low = lowfee.low_fee_txs(t["txs"]).select(
        "tx_hash", "block_month", F.round("upper_band_sats", 5).alias("upper_band_sats"))
    fresh = low.where(F.col("block_month") >= RERUN)
    old = low.withColumn("upper_band_sats", F.col("upper_band_sats") + 1)
    return tables.top_rows(tables.merge_sample(old, fresh, tables.months_covered(fresh), 25), 25)


def onchain(t: ChainTables) -> DataFrame:
    return extract.onchain_monthly_fee(t["tx_base"])


def onchain_payload(t: ChainTables) -> DataFrame:
    """Stored months are the same months, plus one sat each; fresh ones win."""
    df = onchain(t)
    stored = results.onchain_fee_rows(df).withColumn("fee_sats", F.col("fee_sats") + 1)
    return results.onchain_fee_payload(df.where(F.col("block_month") >= RERUN), stored)


def nested_fees(t: ChainTables) -> DataFrame:
    return acc.fees_by_month_nested(acc_fees(t)).select(
        "month", F.transform("pools", lambda p: F.concat_ws(
            ":", p["pool_name"], p["fee"].cast("string"))).alias("pools"), "sum").select(
        "month", F.array_join("pools", ",").alias("pools"), "sum")


def pct(t: ChainTables) -> DataFrame:
    return floor.block_percentiles(t["txs_priced"])


def pct_ranked(t: ChainTables) -> DataFrame:
    """The path for blocks too large for one task, over all blocks."""
    priced = (t["txs_priced"].where("NOT is_coinbase AND effective_fee_rate IS NOT NULL")
              .select("block_number", F.col("effective_fee_rate").alias("rate"),
                      (~F.col("is_nonrelayable")).alias("relayable")))
    return floor.percentiles_by_rank(priced, P.floor_percentile)


def reason_query(name: str):
    column = f"nonrelay_{name}"
    source = "txs_priced" if name == "ancestor_limit" else "txs_linked"
    relation = "priced" if name == "ancestor_limit" else "judged"
    return (lambda t: t[source].select("tx_hash", "block_number", column),
            f"SELECT tx_hash, block_number, coalesce({column}, FALSE) AS {column} "
            f"FROM {relation}")


def audit_sql(pick: str) -> str:
    """Overlap totals of the flagged blocks that ``pick`` keeps."""
    return (
        "SELECT count(*) AS blocks, count(a.block_hash) AS audited, "
        "count(*) - count(a.block_hash) AS without_audit, "
        "count(*) FILTER (WHERE x.hit_added + x.hit_acc > 0) AS blocks_with_overlap, "
        "CAST(coalesce(sum(x.mine), 0) AS BIGINT) AS low_fee, "
        "CAST(coalesce(sum(x.hit_added), 0) AS BIGINT) AS in_added, "
        "CAST(coalesce(sum(x.hit_acc), 0) AS BIGINT) AS in_accelerated, "
        "CAST(sum(x.hit_added) AS DOUBLE) / NULLIF(sum(x.mine), 0) AS added_share, "
        "CAST(sum(x.hit_acc) AS DOUBLE) / NULLIF(sum(x.mine), 0) AS accelerated_share "
        "FROM (SELECT block_hash, list(tx_hash) AS h FROM low GROUP BY block_hash "
        f"{pick}) f "
        f"LEFT JOIN {AUDIT_SQL} a USING (block_hash) LEFT JOIN LATERAL (SELECT "
        "CASE WHEN a.block_hash IS NOT NULL THEN len(f.h) END AS mine, "
        "CASE WHEN a.block_hash IS NOT NULL THEN coalesce(len(list_intersect(f.h, a.added)), 0)"
        " END AS hit_added, CASE WHEN a.block_hash IS NOT NULL THEN "
        "coalesce(len(list_intersect(f.h, a.accelerated)), 0) END AS hit_acc) x ON TRUE")


def build() -> dict[str, tuple]:
    q: dict[str, tuple] = {}

    # sources
    q["read_transactions"] = (
        lambda t: chain.in_window_transactions(t.source.transactions, WINDOW).select(
            F.col("hash").alias("tx_hash"), "block_number", "fee",
            F.size("outputs").alias("outputs")),
        "SELECT tx_hash, block_number, fee, coalesce(n, 0) AS outputs FROM tx LEFT JOIN "
        "(SELECT k, CAST(count(*) AS INTEGER) AS n FROM outs GROUP BY k) USING (k) "
        "WHERE block_timestamp >= TIMESTAMP '2024-03-01' "
        "AND block_timestamp < TIMESTAMP '2024-04-01'")
    q["read_blocks"] = (
        lambda t: chain.in_window_blocks(t.source.blocks, WINDOW).select(
            "number", "hash", "weight"),
        "SELECT number, hash, weight FROM heads WHERE ts >= TIMESTAMP '2024-03-01' "
        "AND ts < TIMESTAMP '2024-04-01'")
    q["month_window"] = (
        lambda t: t.source.blocks.groupBy("timestamp_month").agg(F.count_if(WINDOW.covers(
            F.col("timestamp"), F.col("timestamp_month"))).alias("inside")),
        f"SELECT CAST(date_trunc('month', ts) AS DATE) AS timestamp_month, count(*) FILTER "
        f"(WHERE date_trunc('month', ts) = {MONTH}) AS inside FROM heads GROUP BY 1")
    q["read_pools"] = (
        lambda t: joined(src_pools.parse_pools(pool_docs(t)), "tags", "addresses"),
        "SELECT pool_name, pool_id, coalesce(t.l, '') AS tags, coalesce(a.l, '') AS addresses "
        "FROM pool_ids LEFT JOIN (SELECT pool_name, string_agg(tag, ',' ORDER BY tag) AS l "
        "FROM pool_tags GROUP BY pool_name) t USING (pool_name) LEFT JOIN (SELECT pool_name, "
        "string_agg(address, ',' ORDER BY address) AS l FROM pool_addresses GROUP BY pool_name)"
        " a USING (pool_name) WHERE t.l IS NOT NULL OR a.l IS NOT NULL")
    q["read_accelerations"] = (
        io_accelerations,
        'SELECT txid, status, fee_delta AS "feeDelta", pool_id AS "minedByPoolUniqueId", month '
        "FROM acc")
    q["months_to_load"] = (
        lambda t: src_acc.months_to_load(
            accelerations(t.spark, t.sf_dir).select("month"), dt.date(2025, 4, 15)),
        "SELECT strftime(m, '%Y-%m') AS month FROM (SELECT unnest(generate_series("
        "(SELECT max(CAST(month || '-01' AS DATE)) FROM acc) + INTERVAL 1 MONTH, "
        "DATE '2025-03-01', INTERVAL 1 MONTH)) AS m)")
    q["list_months"] = (lambda t: src_acc.list_months(t.spark, acceleration_files(t)),
                        "SELECT month FROM acc_months")
    q["read_in_package"] = (
        lambda t: relay.read_in_package(
            t["tx_in_package"], *relay.block_range(t["tx_in_package"])).select(
            "tx_hash", "block_number", "fee", "virtual_size"),
        "SELECT tx_hash, block_number, j.fee, virtual_size FROM judged j WHERE in_package "
        "AND NOT is_coinbase")

    # scalar functions, over every output, input or row
    for name, column, sql in (
            ("script_bytes", S.script_bytes, "CAST(nbytes AS BIGINT)"),
            ("is_op_return", S.is_op_return, "op_ret"),
            ("is_p2pkh", S.is_p2pkh, "p2pkh"),
            ("is_p2sh", S.is_p2sh, "p2sh"),
            ("is_p2pk", S.is_p2pk, "p2pk"),
            ("is_bare_multisig", S.is_bare_multisig, "multi"),
            ("is_witness_program", S.is_witness_program, "witness"),
            ("is_standard_script", S.is_standard_script, "standard"),
            ("dust_threshold", S.dust_threshold, "CAST(threshold AS BIGINT)")):
        kind = "bigint" if "BIGINT" in sql else "boolean"
        q[name] = (per_output(**{name: lambda _v, s, c=column, k=kind: c(s).cast(k)}),
                   out_sql(f"{sql} AS {name}"))
    q["multisig_m_n"] = (
        per_output(m=lambda _v, s: F.when(S.is_bare_multisig(s), S.multisig_m(s)).cast("int"),
                   n=lambda _v, s: F.when(S.is_bare_multisig(s), S.multisig_n(s)).cast("int")),
        out_sql("CASE WHEN multi THEN CAST(m AS INTEGER) END AS m, "
                "CASE WHEN multi THEN CAST(n AS INTEGER) END AS n"))
    q["witness_version"] = (
        per_output(witness_version=lambda _v, s: S.witness_version(s),
                   witness_program_bytes=lambda _v, s: S.witness_program_bytes(s)),
        out_sql("CAST(wver AS INTEGER) AS witness_version, "
                "CAST(wbytes AS INTEGER) AS witness_program_bytes"))
    q["is_dust"] = (per_output(is_dust=lambda v, s: S.is_dust(v, s)),
                    out_sql("value < threshold AS is_dust"))
    q["input_hashes"] = (
        lambda t: joined(t.source.transactions.select(
            F.col("hash").alias("tx_hash"),
            S.input_hashes(F.col("inputs")).alias("input_hashes")), "input_hashes"),
        "SELECT tx_hash, coalesce(l, '') AS input_hashes FROM tx LEFT JOIN (SELECT k, "
        f"string_agg(spent, ',' ORDER BY spent) AS l FROM {SPENDS} GROUP BY k) USING (k)")
    q["coinbase_addresses"] = (
        lambda t: joined(t.source.transactions.select(
            F.col("hash").alias("tx_hash"), S.coinbase_addresses(
                F.col("is_coinbase"), F.col("outputs")).alias("a")), "a"),
        "SELECT tx_hash, coalesce(l, '') AS a FROM tx LEFT JOIN (SELECT k, "
        "string_agg(DISTINCT address, ',') AS l FROM outs WHERE k < 0 AND address IS NOT NULL "
        "GROUP BY k) USING (k)")
    q["output_stats"] = (
        lambda t: t.source.transactions.select(
            F.col("hash").alias("tx_hash"), S.output_stats(F.col("outputs")).alias("s"))
        .select("tx_hash", "s.*"),
        "SELECT tx_hash, " + ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in STAT_COLUMNS)
        + " FROM base")
    q["input_stats"] = (
        lambda t: t.source.transactions.select(
            F.col("hash").alias("tx_hash"), S.input_stats(F.col("inputs")).alias("s"))
        .select("tx_hash", "s.*"),
        "SELECT tx_hash, CAST(max_scriptsig_bytes AS BIGINT) AS max_scriptsig_bytes, "
        "opens_with_nonpush_opcode FROM base")
    q["version_default"] = (
        lambda t: t.source.transactions.groupBy(
            M.version_or_default(F.col("version"), 1).alias("version")).count(),
        'SELECT coalesce(version, 1) AS version, count(*) AS "count" FROM tx GROUP BY 1')
    q["raw_fee_rate"] = (
        lambda t: t["tx_base"].select("tx_hash", M.raw_fee_rate(
            F.col("fee"), F.col("virtual_size")).alias("raw_fee_rate")),
        "SELECT tx_hash, raw_fee_rate FROM rated")
    q["policy_as_of"] = (
        lambda t: policy_as_of(t["tx_base"]).select(
            "tx_hash", "min_relay_rate", "datacarrier_bytes", "datacarrier_limit",
            "max_standard_version", "max_dust_outputs"),
        "SELECT tx_hash, min_relay_rate, datacarrier_bytes, datacarrier_limit, "
        "max_standard_version, max_dust_outputs FROM rated")
    q["max_nonwitness_size"] = (
        lambda t: rated(t).select("tx_hash", "max_nonwitness_size"),
        "SELECT tx_hash, max_nonwitness_size FROM rated")
    q["coinbase_text"] = (
        lambda t: att.block_rows(t.source.blocks).select(
            "block_number", "coinbase_text",
            M.printable_prefix(F.col("coinbase_text"), 12).alias("prefix")),
        "SELECT number AS block_number, coinbase_text, substr(coinbase_text, 1, 12) AS prefix "
        "FROM texts")
    q["printable_prefix"] = (
        lambda t: t.source.transactions.select(F.col("hash").alias("tx_hash"), M.printable_prefix(
            F.concat(F.lit("\té"), F.col("hash"))).alias("text")),
        "SELECT tx_hash, substr('..' || tx_hash, 1, 48) AS text FROM tx")
    q["block_date_month"] = (
        lambda t: t.source.blocks.select(
            "number", M.block_date(F.col("timestamp")).alias("block_date"),
            M.block_month(F.col("timestamp")).alias("block_month"),
            M.month_label(F.col("timestamp")).alias("label")),
        "SELECT number, CAST(ts AS DATE) AS block_date, CAST(date_trunc('month', ts) AS DATE) "
        "AS block_month, strftime(ts, '%Y-%m') AS label FROM heads")
    q["bands"] = both(
        lambda t: t["txs"].withColumns(lowfee.bands()).select("tx_hash", "lower_band_sats", "upper_band_sats"),
        "SELECT tx_hash, lower_band_sats, upper_band_sats FROM flagged",
        {"lower_band_sats": 5, "upper_band_sats": 5})
    q["tag_lookup"] = (lambda t: att.tag_lookup(t.source.pools), "SELECT * FROM tag_of")
    q["address_lookup"] = (lambda t: att.address_lookup(t.source.pools),
                           "SELECT * FROM address_of")
    q["pool_id_lookup"] = (lambda t: att.pool_id_lookup(t.source.pools),
                           "SELECT pool_id, pool_name FROM pool_ids WHERE pool_id IS NOT NULL")

    # predicates and relay rules
    q["full_and_priced"] = (
        lambda t: summary.full_priced_blocks(t["blocks"]).select("block_number"),
        "SELECT block_number FROM blocks WHERE is_full AND floor_fee_rate IS NOT NULL")
    q["low_fee_denominator"] = (
        lambda t: t["txs"].where(
            M.low_fee_denominator(F.col("is_full"), F.col("floor_fee_rate"),
                                  F.col("is_nonrelayable"))).select("tx_hash"),
        "SELECT tx_hash FROM flagged WHERE is_full AND floor_fee_rate IS NOT NULL "
        "AND NOT is_nonrelayable")
    q["completed_only"] = (
        lambda t: accelerations(t.spark, t.sf_dir).where(
            M.completed_only(F.col("status"))).groupBy("status").count(),
        "SELECT status, count(*) AS \"count\" FROM acc WHERE status LIKE '%completed%' "
        "GROUP BY status")
    q["in_package_set"] = (
        lambda t: joined(relay.in_package_set(t["txs_linked"]), "parent_hashes"),
        "SELECT tx_hash, block_number, block_month, j.fee, virtual_size, "
        "coalesce(parents, '') AS parent_hashes FROM judged j "
        "WHERE in_package AND NOT is_coinbase")
    for name in (*REASONS, "ancestor_limit"):
        q[f"nonrelay_{name}"] = reason_query(name)
    q["is_nonrelayable"] = (
        lambda t: t["txs_priced"].select("tx_hash", "is_nonrelayable"),
        "SELECT tx_hash, is_nonrelayable FROM verdicts")

    # links, joins, packages
    q["in_block_edges"] = (
        lambda t: linkage.in_block_edges(rated(t)),
        "SELECT block_number, child_hash, parent_hash, child_rate, child_min_relay, "
        "truc_version_clash FROM edges")
    q["parent_agg"] = (
        lambda t: joined(linkage.parent_agg(linkage.in_block_edges(rated(t))), "parent_hashes")
        .drop("block_number"),
        "SELECT tx_hash, parents AS parent_hashes, has_truc_version_clash FROM by_child")
    q["child_agg"] = (
        lambda t: linkage.child_agg(linkage.in_block_edges(rated(t))).drop("block_number"),
        "SELECT tx_hash, child_count, has_paying_child FROM by_parent")
    q["relay_reasons"] = (
        lambda t: t["txs_linked"].select(
            "tx_hash", "block_number", "child_count", "has_paying_child",
            "has_in_block_parent", "in_package", *relay.DIRECT_REASONS, "is_nonrelayable",
            "effective_fee_rate", "package_id", "package_tx_count"),
        "SELECT tx_hash, block_number, child_count, has_paying_child, has_in_block_parent, "
        "in_package, " + ", ".join(f"coalesce(nonrelay_{r}, FALSE) AS nonrelay_{r}"
                                   for r in REASONS)
        + ", " + " OR ".join(f"nonrelay_{r}" for r in REASONS) + " AS is_nonrelayable, "
        "CASE WHEN NOT in_package AND NOT is_coinbase THEN raw_fee_rate END "
        "AS effective_fee_rate, CASE WHEN NOT in_package AND NOT is_coinbase THEN tx_hash END "
        "AS package_id, CAST(CASE WHEN NOT in_package AND NOT is_coinbase THEN 1 END AS BIGINT)"
        " AS package_tx_count FROM judged")
    q["attribute_by_tag"] = (
        lambda t: att.attribute_by_tag(att.block_rows(t.source.blocks),
                                       att.tag_lookup(t.source.pools)),
        "SELECT number AS block_number, pool_name FROM by_tag")
    q["tag_matches"] = (
        lambda t: att.tag_matches(att.block_rows(t.source.blocks),
                                  att.tag_lookup(t.source.pools)),
        "SELECT t.number AS block_number, g.pool_name, g.tag FROM texts t JOIN tag_of g "
        "ON contains(lower(t.coinbase_text), g.tag)")
    q["attribute_by_address"] = (
        lambda t: att.attribute_by_address(att.coinbase_of_block(t["tx_base"]),
                                           att.address_lookup(t.source.pools)),
        "SELECT number AS block_number, pool_name FROM by_address")
    q["attribute_pools"] = (
        lambda t: att.attribute_pools(t.source.blocks, t["tx_base"], t.source.pools),
        "SELECT * FROM attributed")
    q["coinbase_of_block"] = (
        lambda t: joined(att.coinbase_of_block(t["tx_base"]), "coinbase_addresses"),
        "SELECT block_number, string_agg(address, ',') AS coinbase_addresses FROM tx "
        "JOIN outs USING (k) WHERE is_coinbase GROUP BY block_number")
    q["neighbour_join"] = (
        lambda t: floor.neighbour_join(
            t["blocks"], t["blocks"].select("block_number", "weight"), P.neighbour_offsets),
        f"SELECT c.block_number, CAST(o AS INTEGER) AS \"offset\", n.weight FROM attributed c "
        f"CROSS JOIN {OFFSETS} LEFT JOIN attributed n ON n.block_number = c.block_number + o")
    q["tx_with_block"] = (
        lambda t: lowfee.tx_with_block(t["txs_linked"], t["blocks"]).select(
            "tx_hash", "pool_name", "pool_source", "weight", "is_full"),
        "SELECT tx_hash, pool_name, pool_source, block_weight AS weight, is_full FROM flagged")
    q["grid_blocks"] = both(
        lambda t: summary.grid_blocks(t["blocks"]),
        "SELECT block_number, sensitivity, full_weight, is_full, floor_fee_rate, "
        "median_fee_rate FROM grid_blocks", {"floor_fee_rate": 9, "median_fee_rate": 9})
    q["month_spine"] = (
        lambda t: t["monthly_summary"].select("block_month", "all_txs", "full_block_vbytes",
                                              "low_fee_txs_70"),
        "SELECT block_month, all_txs, full_block_vbytes, low_fee_txs_70 FROM monthly")
    q["pool_by_id"] = (
        lambda t: acc.pool_by_id(accelerations(t.spark, t.sf_dir),
                                 att.pool_id_lookup(t.source.pools)).select(
            "txid", "pool_name"),
        "SELECT txid, pool_name FROM acc JOIN pool_ids USING (pool_id)")
    q["pool_list_diff"] = (refreshed, f"SELECT * FROM {REFRESHED_SQL}")
    q["pool_list_counts"] = (
        lambda t: att.pool_list_counts(refreshed(t)),
        "SELECT count(*) FILTER (WHERE change <> 'not upstream') AS upstream, "
        "count(*) FILTER (WHERE change <> 'new') AS in_use, "
        "count(*) FILTER (WHERE has_id) AS with_id, "
        "count(*) FILTER (WHERE change = 'new') AS \"new\", "
        "count(*) FILTER (WHERE change = 'not upstream') AS not_upstream, "
        "count(*) FILTER (WHERE change LIKE '%tags%') AS tags_changed, "
        f"count(*) FILTER (WHERE change LIKE '%addresses%') AS addresses_changed FROM {REFRESHED_SQL}")
    q["audit_overlap"] = (
        lambda t: quality.audit_overlap(flagged(t), audits(t)), audit_sql(""))
    q["audit_overlap_by_block"] = (
        lambda t: jobs.validate(_with(t, "txs", "blocks"), audits(t), 10**6, "70", by_block=True),
        "SELECT f.block_number, f.pool_name, a.block_hash IS NOT NULL AS audited, "
        "CASE WHEN a.block_hash IS NOT NULL THEN len(f.h) END AS low_fee, "
        "CASE WHEN a.block_hash IS NOT NULL THEN coalesce(len(list_intersect(f.h, a.added)), 0)"
        " END AS in_added, CASE WHEN a.block_hash IS NOT NULL THEN "
        "coalesce(len(list_intersect(f.h, a.accelerated)), 0) END AS in_accelerated "
        "FROM (SELECT block_number, block_hash, pool_name, list(tx_hash) AS h FROM low "
        f"WHERE block_number >= 790000 GROUP BY ALL) f LEFT JOIN {AUDIT_SQL} a USING (block_hash)")
    q["validate"] = (
        lambda t: jobs.validate(_with(t, "txs", "blocks"), audits(t), 20, "70"),
        audit_sql("ORDER BY sha256(concat('feefloor', block_hash)) LIMIT 20"))
    q["packages"] = (
        lambda t: packages.packages(t["tx_in_package"]), "SELECT * FROM packed")
    q["packages_by_joins"] = (
        lambda t: packages.packages_by_joins(t["tx_in_package"].select(
            "tx_hash", "block_number", F.coalesce("fee", F.lit(0)).alias("fee"),
            "virtual_size", "parent_hashes")), "SELECT * FROM packed")
    q["packages_by_pairs"] = (
        lambda t: packages.packages_by_joins(t["tx_in_package"].select(
            "tx_hash", "block_number", F.coalesce("fee", F.lit(0)).alias("fee"),
            "virtual_size", "parent_hashes"), max_rows=2), "SELECT * FROM packed")
    q["ancestor_stats"] = (
        lambda t: t["tx_packages"].select("tx_hash", "ancestor_count", "ancestor_vsize"),
        "SELECT tx_hash, ancestor_count, ancestor_vsize FROM packed")

    # versioned updates
    q["apply_update"] = (
        pool_update,
        "SELECT block_number, CASE WHEN block_number % 2 = 0 THEN weight + 1 ELSE weight END "
        "AS weight, pool_name FROM attributed")
    q["apply_package_rates"] = (
        lambda t: updates.apply_package_rates(t["txs_linked"], t["tx_packages"]).select(
            "tx_hash", "effective_fee_rate", "package_id", "package_tx_count"),
        "SELECT tx_hash, effective_fee_rate, package_id, package_tx_count FROM priced")
    q["apply_ancestor_limit"] = (
        lambda t: updates.apply_ancestor_limit(t["txs_linked"], t["tx_packages"]).select(
            "tx_hash", "nonrelay_ancestor_limit", "is_nonrelayable"),
        "SELECT tx_hash, nonrelay_ancestor_limit, is_nonrelayable FROM verdicts")
    q["price_packages"] = (
        lambda t: updates.price_packages(t["txs_linked"], t["tx_packages"]).select(
            "tx_hash", "effective_fee_rate", "package_id", "package_tx_count",
            "nonrelay_ancestor_limit", "is_nonrelayable"),
        "SELECT tx_hash, effective_fee_rate, package_id, package_tx_count, "
        "nonrelay_ancestor_limit, is_nonrelayable FROM verdicts")
    q["apply_block_floor"] = both(
        lambda t: floor.apply_block_floor(t["blocks_attributed"], t["block_percentiles"])
        .select("block_number", "floor_fee_rate", "p05_fee_rate", "median_fee_rate"),
        "SELECT block_number, floor_fee_rate, p05_fee_rate, median_fee_rate FROM blocks",
        {"floor_fee_rate": 9, "p05_fee_rate": 9, "median_fee_rate": 9})
    q["apply_block_fullness"] = (
        lambda t: floor.apply_block_fullness(t["blocks_attributed"]).select(
            "block_number", "weight_full", "full_neighbours", "is_full"),
        "SELECT block_number, weight_full, full_neighbours, is_full FROM blocks")
    q["apply_low_fee"] = (
        lambda t: lowfee.apply_low_fee(t["txs_priced"], t["blocks"]).select(
            "tx_hash", *[f"low_fee_{s}" for s, _ in SENS]),
        f"SELECT tx_hash, {LOW_FLAGS} FROM flagged")

    # aggregations
    q["tx_base"] = (
        lambda t: extract.tx_base(t.source.transactions).select(
            *[c.strip() for c in BASE_COLUMNS.split(",")]),
        f"SELECT {BASE_COLUMNS} FROM base")
    q["onchain_monthly_fee"] = (onchain, "SELECT * FROM onchain")
    q["monthly_summary"] = both(
        lambda t: summary.monthly_summary(t["block_partials"]),
        "SELECT * FROM monthly", BAND)
    q["pool_summary"] = both(
        lambda t: summary.pool_summary(t["block_partials"]),
        "SELECT *, CAST(low_fee_vbytes_50 AS DOUBLE) / NULLIF(full_block_vbytes, 0) "
        "AS low_fee_share_of_full_50 FROM pools",
        {"lower_band_sats_50": 2, "upper_band_sats_50": 2})
    q["low_fee_sensitivity"] = both(
        lambda t: summary.low_fee_sensitivity(t["block_partials"], t["blocks"]),
        "SELECT * FROM sensitivity", {"lower_band_sats": 2, "upper_band_sats": 2})
    digits = {"p05_fee_rate": 9, "p05_all": 9, "median_fee_rate": 9}
    q["block_percentiles"] = both(pct, "SELECT * FROM percentiles", digits)
    q["block_percentiles_by_rank"] = both(pct_ranked, "SELECT * FROM percentiles", digits)
    q["neighbour_floor"] = both(
        lambda t: floor.neighbour_floor(t["block_percentiles"]), "SELECT * FROM floors",
        {"floor_fee_rate": 9})
    q["block_fullness"] = (
        lambda t: floor.block_fullness(t["blocks_attributed"]),
        "SELECT *, weight_full AND full_neighbours >= 4 AS is_full FROM fullness")
    for s, _ in SENS:
        q[f"headline_{s}"] = (
            lambda t, s=s: summary.headline(t["monthly_summary"], s),
            "SELECT min(block_month) AS window_start, max(block_month) AS window_end, "
            f"count(*) AS months, '0.{s}' AS sensitivity, "
            f"CAST(sum(low_fee_txs_{s}) AS BIGINT) AS low_fee_txs, "
            f"CAST(sum(low_fee_vbytes_{s}) AS BIGINT) AS low_fee_vbytes, "
            f"round(CAST(sum(low_fee_vbytes_{s}) AS DOUBLE) / 1e9, 3) AS low_fee_gvb, "
            "CAST(sum(full_block_vbytes) AS BIGINT) AS full_block_vbytes, "
            f"round(CAST(sum(low_fee_vbytes_{s}) AS DOUBLE) / NULLIF(sum(full_block_vbytes), 0)"
            ", 6) AS share_of_full_block_space, "
            f"round(sum(lower_band_sats_{s}) / 1e8, 4) AS lower_band_btc, "
            f"round(sum(upper_band_sats_{s}) / 1e8, 4) AS upper_band_btc, "
            "CAST(sum(nonrelayable_txs) AS BIGINT) AS nonrelayable_txs, "
            "CAST(sum(nonrelayable_vbytes) AS BIGINT) AS nonrelayable_vbytes FROM monthly")
    q["summary_report"] = (
        report_heads, " UNION ALL ".join(
            f"SELECT * REPLACE (CAST(window_start AS VARCHAR) AS window_start, "
            f"CAST(window_end AS VARCHAR) AS window_end) FROM ({q[f'headline_{s}'][1]})"
            for s, _ in SENS))
    q["sensitivity_totals"] = both(
        lambda t: summary.sensitivity_totals(t["low_fee_sensitivity"]),
        "SELECT sensitivity, full_weight, CAST(sum(low_fee_txs) AS BIGINT) AS low_fee_txs, "
        "CAST(sum(low_fee_vbytes) AS BIGINT) AS low_fee_vbytes, "
        "CAST(sum(full_block_vbytes) AS BIGINT) AS full_block_vbytes, "
        "sum(lower_band_sats) AS lower_band_sats, sum(upper_band_sats) AS upper_band_sats, "
        "CAST(sum(low_fee_vbytes) AS DOUBLE) / NULLIF(sum(full_block_vbytes), 0) "
        "AS low_fee_share FROM sensitivity GROUP BY sensitivity, full_weight",
        {"lower_band_sats": 2, "upper_band_sats": 2})
    q["top_pools"] = (
        lambda t: summary.top_pools(t["pool_summary"]),
        "SELECT pool_name, CAST(sum(low_fee_vbytes_50) AS BIGINT) AS low_fee_vbytes_50, "
        "CAST(sum(vbytes) AS BIGINT) AS vbytes, CAST(sum(low_fee_vbytes_50) AS DOUBLE) "
        "/ NULLIF(sum(vbytes), 0) AS share_of_own_space FROM pools GROUP BY pool_name "
        "ORDER BY low_fee_vbytes_50 DESC, pool_name LIMIT 12")
    q["pool_fees_by_month"] = (acc_fees, "SELECT * FROM acc_spine")
    q["monthly_pool_shares"] = (
        lambda t: summary.monthly_pool_shares(t["blocks"]),
        "SELECT block_month, pool_name, blocks, share FROM (SELECT *, "
        "CAST(blocks AS DOUBLE) / sum(blocks) OVER (PARTITION BY block_month) AS share, "
        "row_number() OVER (PARTITION BY block_month ORDER BY blocks DESC, pool_name) AS place, "
        "dense_rank() OVER (ORDER BY block_month DESC) AS age FROM (SELECT block_month, "
        "pool_name, count(*) AS blocks FROM attributed GROUP BY block_month, pool_name)) "
        "WHERE place <= 12 AND age <= 12")
    q["attribution_quality"] = (
        lambda t: summary.attribution_quality(t["blocks"]),
        "SELECT pool_source, count(*) AS blocks, CAST(count(*) AS DOUBLE) "
        "/ (SELECT count(*) FROM attributed) AS share FROM attributed GROUP BY pool_source")
    q["unattributed_texts"] = (
        lambda t: quality.unattributed_texts(t.source.blocks, t["blocks"]),
        "SELECT substr(decode(unhex(coinbase_param)), 1, 48) AS coinbase_text, "
        "count(*) AS blocks FROM heads JOIN attributed ON block_number = number "
        "WHERE pool_name = 'Unknown' GROUP BY 1 ORDER BY blocks DESC, coinbase_text NULLS FIRST "
        "LIMIT 15")
    q["flagged_blocks"] = (
        lambda t: quality.flagged_blocks(flagged(t)),
        "SELECT block_number, block_hash, pool_name, count(*) AS low_fee_txs FROM low "
        "WHERE block_number >= 790000 GROUP BY block_number, block_hash, pool_name")
    q["invariants"] = (
        lambda t: quality.invariants(t["txs"], t["blocks"], t["block_percentiles"]),
        "SELECT 'missing_rate' AS \"check\", (SELECT count(*) FROM "
        "verdicts WHERE NOT is_coinbase AND effective_fee_rate IS NULL) AS violations "
        "UNION ALL SELECT 'low_fee_nonrelayable', (SELECT count(*) FROM "
        "flagged WHERE low_fee_70 AND is_nonrelayable) "
        "UNION ALL SELECT 'verdict_mismatch', (SELECT count(*) FROM verdicts WHERE "
        f"is_nonrelayable <> coalesce({' OR '.join('nonrelay_' + r for r in (*REASONS, 'ancestor_limit'))}, "
        "FALSE)) "
        "UNION ALL SELECT 'nonrelayable_coinbase', (SELECT count(*) FROM verdicts "
        "WHERE is_coinbase AND is_nonrelayable) "
        "UNION ALL SELECT 'package_price_mismatch', (SELECT count(*) FROM "
        "(SELECT package_id FROM verdicts WHERE package_id IS NOT NULL GROUP BY package_id, "
        "block_number HAVING count(DISTINCT effective_fee_rate) > 1)) "
        "UNION ALL SELECT 'floor_without_percentiles', (SELECT count(*) FROM "
        "blocks ANTI JOIN percentiles USING (block_number) WHERE floor_fee_rate IS NOT NULL)")
    reasons = " OR ".join(f"nonrelay_{r}" for r in (*REASONS, "ancestor_limit"))
    broken = (
        "(SELECT block_number, package_id, is_coinbase, CASE WHEN h = 1 THEN NULL WHEN h = 2 "
        "THEN block_number + 0.5 ELSE effective_fee_rate END AS rate, low_fee_70 OR h = 3 AS low, "
        f"is_nonrelayable <> (h = 4) AS bad, coalesce({reasons}, FALSE) AS reason FROM (SELECT *, "
        "instr('0123456789abcdef', substr(tx_hash, 64, 1)) - 1 AS h FROM flagged))")
    counted = {"missing_rate": "NOT is_coinbase AND rate IS NULL",
               "low_fee_nonrelayable": "low AND bad", "verdict_mismatch": "bad <> reason",
               "nonrelayable_coinbase": "is_coinbase AND bad"}
    q["invariants_of_damaged_rows"] = (
        damaged, " UNION ALL ".join(
            f"SELECT '{name}' AS \"check\", count(*) FILTER (WHERE {test}) AS violations "
            f"FROM {broken}" for name, test in counted.items())
        + " UNION ALL SELECT 'package_price_mismatch', count(*) FROM (SELECT 1 FROM "
        f"{broken} WHERE package_id IS NOT NULL GROUP BY package_id, block_number "
        "HAVING count(DISTINCT rate) > 1) UNION ALL SELECT 'floor_without_percentiles', count(*) "
        "FROM blocks WHERE floor_fee_rate IS NOT NULL AND block_number NOT IN (SELECT block_number "
        "FROM percentiles WHERE block_number % 3 <> 0)")

    # sort, top-k, sampling
    q["top_low_fee"] = both(
        lambda t: lowfee.top_low_fee(lowfee.low_fee_txs(t["txs"])).select(
            "tx_hash", "block_month", "pool_name", "upper_band_sats"),
        "SELECT tx_hash, block_month, pool_name, upper_band_sats FROM low WHERE low_fee_50 "
        "ORDER BY upper_band_sats DESC, tx_hash LIMIT 5000", {"upper_band_sats": 5})
    q["fixed_sample"] = (
        lambda t: quality.fixed_sample(quality.flagged_blocks(flagged(t)), 10).select(
            "block_number", "low_fee_txs"),
        "SELECT block_number, count(*) AS low_fee_txs FROM low GROUP BY block_number, "
        "block_hash ORDER BY sha256(concat('feefloor', block_hash)) LIMIT 10")
    q["low_fee_txs"] = both(
        lambda t: lowfee.low_fee_txs(t["txs"]),
        "SELECT tx_hash, block_number, block_timestamp, block_month, pool_name, pool_source, "
        "fee, virtual_size, raw_fee_rate, effective_fee_rate, package_id, package_tx_count, "
        f"floor_fee_rate, median_fee_rate, block_weight, {LOW_FLAGS}, lower_band_sats, "
        "upper_band_sats FROM low",
        {"floor_fee_rate": 9, "median_fee_rate": 9, "lower_band_sats": 5,
         "upper_band_sats": 5})

    # sinks
    q["write_stage"] = (io_stage, "SELECT tx_hash, block_number, block_month, fee FROM base")
    q["write_months"] = (
        io_months, "SELECT tx_hash, block_month, fee + CASE WHEN block_month = "
        f"DATE '{RERUN}' THEN 1 ELSE 0 END AS fee FROM base")
    q["merge_months"] = (
        merged_months,
        f"SELECT pool_name, block_month, CASE WHEN block_month < DATE '{RERUN}' THEN -1 "
        "ELSE low_fee_vbytes_50 END AS low_fee_vbytes_50 FROM pools")
    q["merge_sample"] = (
        merged_sample,
        "SELECT tx_hash, block_month, round(upper_band_sats, 5) + CASE WHEN block_month < "
        f"DATE '{RERUN}' AND (SELECT max(block_month) FROM low) >= DATE '{RERUN}' "
        "THEN 1 ELSE CASE WHEN block_month NOT IN (SELECT block_month FROM low WHERE "
        f"block_month >= DATE '{RERUN}') THEN 1 ELSE 0 END END AS upper_band_sats FROM low "
        "ORDER BY upper_band_sats DESC, tx_hash LIMIT 25")
    q["write_result_json"] = (
        io_json, "SELECT CAST(block_month AS VARCHAR) AS block_month, pool_name, blocks, "
        "vbytes, low_fee_vbytes_50 FROM pools")
    q["onchain_fee_rows"] = (
        lambda t: results.onchain_fee_rows(onchain(t)).drop("fee_rate_sat_vb"),
        "SELECT strftime(block_month, '%Y-%m') AS month, txs, blocks, "
        "coalesce(fee_sats, 0) AS fee_sats, round(coalesce(fee_sats, 0) / 1e8, 8) AS fee_btc, "
        "vbytes FROM onchain")
    q["onchain_fee_payload"] = (
        onchain_payload,
        "SELECT count(*) AS months, min(strftime(block_month, '%Y-%m')) AS first_month, "
        "max(strftime(block_month, '%Y-%m')) AS last_month, round(CAST(sum(fee_sats + "
        f"CASE WHEN block_month < DATE '{RERUN}' THEN 1 ELSE 0 END) AS DOUBLE) / 1e8, 8) "
        "AS total_fee_btc FROM onchain")
    q["fees_by_month_nested"] = (
        nested_fees,
        "SELECT month, coalesce(string_agg(pool_name || ':' || fee_sats, ',' ORDER BY "
        "fee_sats DESC, pool_name) FILTER (WHERE pool_name IS NOT NULL), '') AS pools, "
        'max(month_sum) AS "sum" FROM acc_spine GROUP BY month')
    q["refresh_pools"] = (
        lambda t: refreshed(t).where("change = 'new' OR change = 'not upstream'"),
        f"SELECT * FROM {REFRESHED_SQL} WHERE change IN ('new', 'not upstream')")
    month_text = "CAST(block_month AS VARCHAR) AS block_month"
    for name, relation, digits in (
            ("low_fee_sensitivity", "sensitivity",
             {"lower_band_sats": 2, "upper_band_sats": 2}),
            ("monthly_summary", "monthly", BAND),
            ("pool_summary", "(SELECT *, CAST(low_fee_vbytes_50 AS DOUBLE) "
             "/ NULLIF(full_block_vbytes, 0) AS low_fee_share_of_full_50 FROM pools)",
             {"lower_band_sats_50": 2, "upper_band_sats_50": 2})):
        q["export_results" if name == "low_fee_sensitivity" else f"export_{name}"] = both(
            lambda t, n=name: exported_json(t, n),
            f"SELECT * REPLACE ({month_text}) FROM {relation}", digits)
    q["export_sample"] = both(
        lambda t: exported_json(t, "low_fee_txs_sample").select(
            "tx_hash", "block_month", "pool_name", "upper_band_sats"),
        f"SELECT tx_hash, {month_text}, pool_name, upper_band_sats FROM low WHERE low_fee_50 "
        "ORDER BY low.upper_band_sats DESC, tx_hash LIMIT 5000", {"upper_band_sats": 5})
    q["replace_export"] = both(
        lambda t: exported_json(t, "pool_summary", replace=True).drop("low_fee_share_of_full_50"),
        f"SELECT * REPLACE ({month_text}) FROM pools WHERE block_month >= DATE '{RERUN}' OR "
        f"NOT EXISTS (SELECT 1 FROM pools WHERE block_month >= DATE '{RERUN}')",
        {"lower_band_sats_50": 2, "upper_band_sats_50": 2})
    q["export_onchain_fee"] = both(
        exported_onchain,
        "SELECT strftime(block_month, '%Y-%m') AS month, txs, blocks, fee_sats, "
        "round(fee_sats / 1e8, 8) AS fee_btc, vbytes, fee_rate_sat_vb, "
        "strftime(min(block_month) OVER (), '%Y-%m') AS first_month, "
        "strftime(max(block_month) OVER (), '%Y-%m') AS last_month, "
        "round(CAST(sum(fee_sats) OVER () AS DOUBLE) / 1e8, 8) AS total_fee_btc FROM onchain",
        {"fee_rate_sat_vb": 2})
    q["run_accelerations"] = (
        ran_accelerations,
        "SELECT month, coalesce(string_agg(pool_name || ':' || fee_sats, ',' ORDER BY "
        "pool_name || ':' || fee_sats) FILTER (WHERE pool_name IS NOT NULL), '') AS pools, "
        'max(month_sum) AS "sum" FROM acc_spine GROUP BY month')
    q["run_pipeline"] = (
        lambda t: ran_pipeline(t)["txs"].select(
            "tx_hash", "block_number", "is_nonrelayable", "effective_fee_rate",
            *[f"low_fee_{s}" for s, _ in SENS]),
        f"SELECT tx_hash, block_number, is_nonrelayable, effective_fee_rate, {LOW_FLAGS} "
        "FROM flagged")
    q["select_steps"] = both(
        ran_late_steps,
        "SELECT *, CAST(low_fee_vbytes_50 AS DOUBLE) / NULLIF(full_block_vbytes, 0) "
        "AS low_fee_share_of_full_50 FROM pools",
        {"lower_band_sats_50": 2, "upper_band_sats_50": 2})
    q["sanity_check"] = (
        sanity,
        f"SELECT CAST(block_month AS VARCHAR) || ' ' || pool_name AS what, blocks, share "
        f"FROM ({q['monthly_pool_shares'][1]}) UNION ALL SELECT pool_source, blocks, share FROM "
        f"({q['attribution_quality'][1]}) UNION ALL SELECT 'text ' || coinbase_text, blocks, NULL "
        f"FROM ({q['unattributed_texts'][1]})")
    q["check"] = (
        lambda t: pipeline.check(_with(t, "txs", "blocks", "block_percentiles"))
        .where("violations > 0"),
        "SELECT 'missing_rate' AS \"check\", count(*) AS violations "
        "FROM verdicts WHERE NOT is_coinbase AND effective_fee_rate IS NULL "
        "HAVING count(*) > 0")
    return q


def _with(t: ChainTables, *names: str):
    for n in names:
        t[n]
    return t.stages
