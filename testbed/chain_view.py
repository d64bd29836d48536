"""The star-schema tables seen as a chain.

An order is a transaction, 48 consecutive order keys are a block, a line item
is an output, part brands and nations are pools, events are acceleration
records. One SQL text defines the flat relations for Spark and for DuckDB;
only function names differ. Blocks grow in number with the data, not in size,
and no relation needs a window or a cross join.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feefloor.operators.extract import tx_base
from feefloor.plans.pipeline import STEPS, WHOLE, Layout, Stages, priced
from feefloor.policy import Policy
from feefloor.session import shared_dir

TABLES = ("nation", "part", "orders", "lineitem", "events")

_SPARK = dict(
    sha=lambda x: f"sha2({x}, 256)", text="STRING", hex="hex",
    days=lambda n: f"TIMESTAMP '2020-01-01 00:00:00' + make_dt_interval(CAST({n} AS INT))",
    month=lambda t: f"trunc(CAST({t} AS DATE), 'MM')")
_DUCKDB = dict(
    sha=lambda x: f"sha256({x})", text="VARCHAR", hex="hex",
    days=lambda n: f"TIMESTAMP '2020-01-01 00:00:00' + to_days(CAST({n} AS INTEGER))",
    month=lambda t: f"CAST(date_trunc('month', {t}) AS DATE)")


def _pieces(dialect: str) -> dict[str, str]:
    """Expressions of the flat relations that the nested form computes too."""
    d = _SPARK if dialect == "spark" else _DUCKDB
    text, sha = d["text"], d["sha"]

    def s(x):
        return f"CAST({x} AS {text})"

    def tx(n):
        return sha(f"concat('tx', {s(n)})")

    return {
        "number": "CAST(800000 + b + floor(b / 90) AS BIGINT)",   # every 91st number is a gap
        "stamp": d["days"]("(b * 11) % 2401"),
        "tx": tx("k"), "tx_1": tx("k - 1"), "tx_2": tx("k - 2"),
        "coinbase": sha(f"concat('cb', {s('b')})"),
        "fee": """CAST(CASE WHEN k % 997 = 5 THEN NULL WHEN k % 17 = 0 THEN 0 WHEN k % 71 = 0 THEN vs
              WHEN k % 73 = 0 THEN 2 * vs WHEN k % 79 = 0 THEN 3 * vs
              ELSE 5 * vs + floor(price / 100) END AS BIGINT)""",
        "size": """CAST(CASE WHEN vs = 60 OR vs = 100001 THEN vs ELSE vs + 10 END AS BIGINT)""",
        "version": """CAST(CASE WHEN k % 50 = 0 THEN 4 WHEN k % 20 = 0 THEN 3 WHEN k % 61 = 0 THEN NULL
              ELSE 2 END AS BIGINT)""",
        "spent": f"""CASE WHEN b % 10 = 0 OR k % 3 = 0 THEN {tx('k - 1')}
              ELSE {sha(f"concat('ext', {s('k')})")} END""",
        "in_script": f"""CASE k % 40 WHEN 0 THEN 'ac' WHEN 1 THEN repeat('00', 1651)
              WHEN 2 THEN CAST(NULL AS {text}) WHEN 3 THEN ''
              ELSE concat('47', repeat('aa', 71)) END""",
        "cb_in": "'03abcdef'", "cb_paid": "concat('0014', repeat('11', 20))",
        "cb_commits": "concat('6a24aa21a9ed', repeat('22', 32))",
        "address": "concat('a', substr(h, 1, 8))",
        "cb_address": f"""CASE WHEN b % 5 = 0 THEN concat('addr', {s('b % 31')})
              ELSE concat('miner', {s('b % 7')}) END""",
        "value": """CAST(floor(CASE WHEN l_quantity < 4 THEN l_quantity * 100
              ELSE l_extendedprice END) AS BIGINT)""",
        "script": f"""CASE l_partkey % 13
              WHEN 0 THEN concat('76a914', substr(h, 1, 40), '88ac')
              WHEN 1 THEN concat('a914', substr(h, 1, 40), '87')
              WHEN 2 THEN concat('0014', substr(h, 1, 40))
              WHEN 3 THEN concat('5120', h)
              WHEN 4 THEN concat('6a20', h)
              WHEN 5 THEN concat('512102', h, '2103', h, '52ae')
              WHEN 6 THEN concat('2102', h, 'ac')
              WHEN 7 THEN CASE WHEN l_partkey % 5 = 0 THEN 'deadbeef' ELSE concat('0020', h) END
              WHEN 8 THEN CASE WHEN l_partkey % 7 = 0 THEN CAST(NULL AS {text})
                WHEN l_partkey % 7 = 1 THEN '' WHEN l_partkey % 7 = 2 THEN '51024e73'
                ELSE concat('0014', substr(h, 1, 40)) END
              WHEN 9 THEN CASE WHEN l_partkey % 3 = 0
                THEN concat('5121', repeat(concat('02', h, '21'), 3), '03', h, '54ae')
                WHEN l_partkey % 3 = 1 THEN concat('532102', h, '2103', h, '52ae')
                ELSE concat('5120', h) END
              WHEN 10 THEN CASE WHEN l_partkey % 3 = 0
                THEN concat('6a4c50', h, h, substr(h, 1, 40))
                WHEN l_partkey % 3 = 1 THEN concat('4104', h, h, 'ac')
                ELSE concat('2100', h, 'ac') END
              ELSE concat('0014', substr(h, 1, 40)) END""",
    }


def flat_relations(dialect: str) -> dict[str, str]:
    """name -> SELECT text, each reading only base tables or earlier names."""
    d = _SPARK if dialect == "spark" else _DUCKDB
    text, sha, p = d["text"], d["sha"], _pieces(dialect)
    number, stamp = p["number"], p["stamp"]

    def s(x):
        return f"CAST({x} AS {text})"

    return {
        "keyed": """
          SELECT o_orderkey AS k, CAST(floor(o_orderkey / 48) AS BIGINT) AS b,
            o_custkey AS cust, o_totalprice AS price,
            CAST(CASE WHEN o_orderkey % 211 = 0 THEN 60 WHEN o_orderkey % 499 = 0 THEN 100001
              ELSE 100 + o_custkey % 900 END AS BIGINT) AS vs
          FROM orders""",
        "tx": f"""
          SELECT k, {p['tx']} AS tx_hash, {number} AS block_number, {stamp} AS block_timestamp,
            FALSE AS is_coinbase,
            {p['fee']} AS fee,
            vs AS virtual_size,
            {p['size']}
              AS serialized_size,
            {p['version']} AS version
          FROM keyed
          UNION ALL
          SELECT DISTINCT -1 - b, {p['coinbase']}, {number}, {stamp}, TRUE,
            CAST(0 AS BIGINT), CAST(120 AS BIGINT), CAST(140 AS BIGINT), CAST(2 AS BIGINT)
          FROM keyed""",
        "ins": f"""
          SELECT k, {p['spent']} AS spent,
            {p['in_script']} AS script FROM keyed
          UNION ALL
          SELECT k, {p['tx_2']}, '00' FROM keyed WHERE k % 7 = 0
          UNION ALL
          SELECT k, {p['tx_1']}, '4730' FROM keyed WHERE k % 15 = 0
          UNION ALL
          SELECT DISTINCT -1 - b, CAST(NULL AS {text}), {p['cb_in']} FROM keyed""",
        "outs": f"""
          SELECT l_orderkey AS k,
            {p['value']} AS value,
            {p['script']} AS script,
            {p['address']} AS address
          FROM (SELECT *, {sha(s('l_partkey'))} AS h FROM lineitem) x
          UNION ALL
          SELECT DISTINCT -1 - b, CAST(312500000 AS BIGINT), {p['cb_paid']},
            {p['cb_address']} FROM keyed
          UNION ALL
          SELECT DISTINCT -1 - b, CAST(0 AS BIGINT), {p['cb_commits']},
            CAST(NULL AS {text}) FROM keyed""",
        "heads": f"""
          SELECT {number} AS number, {sha(f"concat('blk', {s('b')})")} AS hash,
            {stamp} AS ts, CAST(3840000 + abs(b % 40 - 20) * 7500 AS BIGINT) AS weight,
            CAST(1500000 + b % 1000 AS BIGINT) AS size, txs AS transaction_count,
            CASE WHEN b % 13 = 0 THEN CAST(NULL AS {text})
              WHEN b % 11 = 0 THEN {d['hex']}(concat('/anonymous-', {s('b % 3')}, '/'))
              ELSE {d['hex']}(concat('/Mined by Brand#', {s('1 + (b * 7 + txs) % 25')}, '/'))
              END AS coinbase_param
          FROM (SELECT b, CAST(count(*) + 1 AS BIGINT) AS txs FROM keyed GROUP BY b) g""",
        "brands": """
          SELECT DISTINCT CAST(replace(p_brand, 'Brand#', '') AS BIGINT) AS n FROM part""",
        "pool_ids": f"""
          SELECT concat('Pool ', {s('n')}) AS pool_name,
            CASE WHEN n % 6 <> 0 THEN n END AS pool_id FROM brands""",
        "pool_tags": f"""
          SELECT concat('Pool ', {s('n')}) AS pool_name, concat('Brand#', {s('n')}) AS tag
          FROM brands WHERE n <= 20
          UNION ALL
          SELECT concat('Pool ', {s('n')}), concat('BRAND#', {s('n - 4')})
          FROM brands WHERE n % 7 = 0""",
        "pool_addresses": f"""
          SELECT concat('Pool ', {s('1 + n_nationkey % 25')}) AS pool_name,
            concat('addr', {s('n_nationkey')}) AS address FROM nation
          UNION ALL
          SELECT concat('Pool ', {s('1 + (n_nationkey + 3) % 25')}),
            concat('addr', {s('n_nationkey')}) FROM nation WHERE n_nationkey % 5 = 0
          UNION ALL
          SELECT concat('Pool ', {s('n')}), 'no address yet' FROM brands WHERE n % 8 = 0""",
        "acc": f"""
          SELECT {sha(f"concat('acc', {s('event_id')})")} AS txid,
            CASE WHEN event_id % 101 = 0 THEN NULL WHEN event_type = 'purchase' THEN 'completed'
              WHEN event_type = 'click' THEN 'completed_provisional'
              WHEN event_type = 'view' THEN 'provisionally_completed' ELSE 'failed' END AS status,
            CASE WHEN event_id % 17 <> 0 THEN CAST(floor(value * 100) AS BIGINT) END AS fee_delta,
            CASE WHEN user_id % 9 <> 0 THEN user_id % 30 END AS pool_id,
            concat('2024-', lpad({s('1 + user_id % 12')}, 2, '0')) AS month FROM events""",
    }


def with_clause(dialect: str, names: tuple[str, ...] | None = None) -> str:
    parts = flat_relations(dialect)
    return ",\n".join(f"{n} AS ({q})" for n, q in parts.items()
                      if names is None or n in names)


_NEEDS = {"tx": ("keyed",), "ins": ("keyed",), "outs": ("keyed",), "heads": ("keyed",),
          "pool_ids": ("brands",), "pool_tags": ("brands",), "pool_addresses": ("brands",)}


def flat(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One flat relation over the parquet tables."""
    body = flat_relations("spark")
    names = (*_NEEDS.get(name, ()), name)
    clause = ",\n".join(f"{n} AS ({body[n]})" for n in names)
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    clause = re.sub(rf"\b(FROM|JOIN) ({'|'.join(TABLES)})\b", r"\1 {\2}", clause)
    used = {t: df for t, df in frames.items() if f"{{{t}}}" in clause}
    return spark.sql(f"WITH {clause} SELECT * FROM {name}", **used)


#: Orders of one month that a task brings together, on average.
SLOT_ORDERS = 100_000
#: Months of the 2401 days that stamps of blocks fall in.
MONTHS = 79
#: What a keyed row is.
ORDER, COINBASE, LINE = 0, 1, 2


def raw_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested transactions, as a chain export would hold them.

    The rows are those of ``tx``, each with its ``ins`` and ``outs``.
    """
    return spelled(transaction_keys(spark, sf_dir))


def transaction_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and numbers of the transactions in order of month; ``spelled`` does the rest.

    Hashes and scripts are functions of keys, so only keys and numbers are moved and
    stored: an order and its line items meet where their month, or a slot of it, is written.
    """
    p = _pieces("spark")
    orders = flat(spark, sf_dir, "keyed")
    slots = 1 + orders.count() // (MONTHS * SLOT_ORDERS)
    # k, b, kind and two numbers: fee and size, or value and part.
    keyed = orders.selectExpr("k", "b", f"{ORDER} AS kind", f"{p['fee']} AS x", "vs AS y").union(
        orders.select("b").distinct().selectExpr(
            "-1 - b", "b", f"{COINBASE}", "0L", "120L")).union(
        spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_orderkey IS NOT NULL").selectExpr(
            "l_orderkey", "CAST(floor(l_orderkey / 48) AS BIGINT)", f"{LINE}", p["value"],
            "l_partkey"))
    stamp = F.expr(p["stamp"])
    place = (F.year(stamp) * 12 + F.month(stamp)) * slots + F.pmod("b", F.lit(slots))
    moved = keyed.select(place.alias("place"), "k", "kind", "x", "y").repartition("place")
    chain = F.struct("kind", "x", "y")
    return (moved.groupBy("place", "k").agg(
        F.collect_list(F.when(F.col("kind") != LINE, chain)).alias("txs"),
        F.collect_list(F.when(F.col("kind") == LINE, F.struct("x", "y"))).alias("lines"))
        .where("size(txs) > 0")
        .withColumn("b", F.when(F.col("txs")[0]["kind"] == COINBASE, -1 - F.col("k")).otherwise(
            F.expr("CAST(floor(k / 48) AS BIGINT)")))
        .select(F.expr(_SPARK["month"](p["stamp"])).alias("month"), "b", "k", "txs", "lines")
        .sortWithinPartitions("month", "b", "k"))


def spelled(keys: DataFrame) -> DataFrame:
    """A row for each of ``txs``, with its hash, inputs and outputs in full."""
    p = _pieces("spark")

    def spend(spent, script):
        return f"struct({spent} AS spent_transaction_hash, {script} AS script_hex)"

    def paid(value, script, address):
        return (f"struct(CAST({value} AS BIGINT) AS value, {script} AS script_hex, "
                f"IF({address} IS NOT NULL, array({address}), NULL) AS addresses)")

    def of_part(text):
        return re.sub(r"\bh\b", "o.h", re.sub(r"\bl_partkey\b", "o.y", text))

    spends = (f"concat(array({spend(p['spent'], p['in_script'])}), "
              f"IF(k % 7 = 0, array({spend(p['tx_2'], "'00'")}), array()), "
              f"IF(k % 15 = 0, array({spend(p['tx_1'], "'4730'")}), array()))")
    part = _SPARK["sha"]("CAST(o.y AS STRING)")
    coin = "kind = 1 AND k IS NOT NULL"
    rows = keys.selectExpr("month", "b", "k", "lines", "size(txs) AS copies", "inline(txs)")
    return rows.selectExpr(
        f"IF(kind = 1, {p['coinbase']}, {p['tx']}) AS hash", f"{p['number']} AS block_number",
        f"{p['stamp']} AS block_timestamp", "month AS block_timestamp_month",
        "kind = 1 AS is_coinbase", "x AS fee", "y AS virtual_size",
        f"IF(kind = 1, 140L, {p['size'].replace('vs', 'y')}) AS size",
        f"IF(kind = 1, 2L, {p['version']}) AS version",
        # An order that comes several times has its inputs as often.
        f"CASE WHEN k IS NULL THEN NULL WHEN kind = 1 THEN array({spend('CAST(NULL AS STRING)', p['cb_in'])}) "
        f"ELSE flatten(array_repeat({spends}, copies)) END AS inputs",
        f"CASE WHEN {coin} THEN array({paid(312500000, p['cb_paid'], p['cb_address'])}, "
        f"{paid(0, p['cb_commits'], 'CAST(NULL AS STRING)')}) "
        f"ELSE transform(transform(lines, o -> struct(o.x, o.y, {part} AS h)), "
        f"o -> {paid('o.x', of_part(p['script']), of_part(p['address']))}) END AS outputs")


def raw_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(spark, sf_dir, "heads").select(
        "number", "hash", F.col("ts").alias("timestamp"),
        F.trunc(F.to_date("ts"), "MM").alias("timestamp_month"), "weight", "size",
        "transaction_count", "coinbase_param")


def pool_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per brand: at most 25, whatever the scale."""
    ids, tags, addresses = (flat(spark, sf_dir, n)
                            for n in ("pool_ids", "pool_tags", "pool_addresses"))
    none = F.array().cast("array<string>")
    return (ids.join(tags.groupBy("pool_name").agg(F.collect_list("tag").alias("tags")),
                     "pool_name", "left")
            .join(addresses.groupBy("pool_name").agg(
                F.collect_list("address").alias("addresses")), "pool_name", "left")
            .withColumns({"tags": F.coalesce("tags", none),
                          "addresses": F.coalesce("addresses", none)}))


def accelerations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(spark, sf_dir, "acc").select(
        "txid", "status", F.col("fee_delta").alias("feeDelta"),
        F.col("pool_id").alias("minedByPoolUniqueId"), "month")


class ChainTables:
    """Stage tables over one scale-factor folder, each built on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str, folder: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.stages = Stages(spark, folder)
        self._built: set[str] = set()

    def _stage(self, name: str, build) -> DataFrame:
        if name not in self._built:
            if name == "transaction_keys":  # split by month, as public exports are
                self.stages.write(name, build(), Layout("month", ordered=True))
            else:  # queries read whole tables, so none is brought back to months
                self.stages.write(name, build(), WHOLE)
            self._built.add(name)
        return self.stages[name]

    @property
    def source(self) -> ChainTables:
        """Stands for a ``Source``: a raw input is built when it is first read."""
        return self

    @property
    def transactions(self) -> DataFrame:
        return spelled(self._stage(
            "transaction_keys", lambda: transaction_keys(self.spark, self.sf_dir)))

    @property
    def blocks(self) -> DataFrame:
        return self._stage("raw_blocks", lambda: raw_blocks(self.spark, self.sf_dir))

    @property
    def pools(self) -> DataFrame:
        return self._stage("pools", lambda: pool_table(self.spark, self.sf_dir))

    def __getitem__(self, name: str) -> DataFrame:
        needs = {
            "onchain_monthly_fee": ["txs_linked"], "blocks_attributed": ["txs_linked"],
            "tx_in_package": ["txs_linked"],
            "tx_packages": ["tx_in_package"], "txs_priced": ["txs_linked", "tx_packages"],
            "block_percentiles": ["txs_linked", "tx_packages"],
            "blocks": ["blocks_attributed", "block_percentiles"],
            "txs": ["txs_linked", "tx_packages", "blocks"], "low_fee_txs": ["txs"],
            "block_partials": ["txs"], "monthly_summary": ["block_partials"],
            "pool_summary": ["block_partials"],
            "low_fee_sensitivity": ["block_partials", "blocks"]}
        if name in self._built:
            return self.stages[name]
        source = self.source
        if name == "tx_base":  # a projection of the raw table
            return tx_base(source.transactions, Policy())
        for need in needs.get(name, []):
            self[need]
        if name == "txs_priced":  # merged when read
            return priced(self.stages, Policy())
        return self._stage(name, lambda: STEPS[name](source, self.stages, Policy()))


_tables: dict[tuple[str, str], ChainTables] = {}


def chain_tables(spark: SparkSession, sf_dir: str) -> ChainTables:
    """Tables for one folder, shared by the queries of one application."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _tables:
        _tables[key] = ChainTables(
            spark, sf_dir.rstrip("/"), f"{shared_dir(spark)}/chain-{uuid.uuid4().hex}")
    return _tables[key]
