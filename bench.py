"""Seconds per pipeline step and headline query; prints one JSON line.

Each step reads stage tables and writes its own, so its time includes all its
reading, work and writing. The two ways of grouping packages and of taking
percentiles are timed side by side.
"""

import json
import os
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from feefloor.operators import packages, quality  # noqa: E402
from feefloor.plans.pipeline import STEPS  # noqa: E402
from feefloor.session import build_session  # noqa: E402
from testbed import chain_view, queries  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def main() -> None:
    work = tempfile.mkdtemp(prefix="feefloor-bench-")
    spark = build_session("bench", f"local[{CPUS}]", **{
        "spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "10g",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        # Stage files sized for the test data, so that writes use every core.
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4m",
        "spark.checkpoint.dir": work, "spark.sql.warehouse.dir": f"{work}/warehouse"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the engine

    times: dict[str, float] = {}

    def timed(name, run):
        start = time.perf_counter()
        run()
        times[name] = round(time.perf_counter() - start, 3)

    t = chain_view.ChainTables(spark, SF_DIR, f"{work}/chain")
    timed("source_tables", lambda: (t.transactions, t.blocks, t.pools))
    for name in STEPS:
        timed(name, lambda: t[name])

    def drain(df):
        df.write.format("noop").mode("overwrite").save()

    timed("packages_by_joins", lambda: drain(packages.packages_by_joins(
        t["tx_in_package"].selectExpr("tx_hash", "block_number", "coalesce(fee, 0) AS fee",
                                      "virtual_size", "parent_hashes"))))
    timed("block_percentiles_by_rank", lambda: drain(queries.pct_ranked(t)))
    timed("invariants", lambda: quality.invariants(
        t["txs"], t["blocks"], t["block_percentiles"]).collect())
    timed("pool_fees_by_month", lambda: queries.acc_fees(t).collect())

    pipeline = round(sum(times[n] for n in STEPS), 3)
    print(json.dumps({"metric": "pipeline_seconds", "value": pipeline, "unit": "sec",
                      "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/")),
                      "cpus": int(CPUS)}))
    spark.stop()


if __name__ == "__main__":
    main()
