"""Command line: ``python -m feefloor COMMAND``.

Every command reads and writes paths any executor can reach.
"""

from __future__ import annotations

import argparse
import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from feefloor.plans import jobs, pipeline
from feefloor.operators.attribution import pool_list_counts
from feefloor.policy import Policy, headline_label, labels
from feefloor.session import build_session
from feefloor.sources.accelerations import list_months, months_to_load
from feefloor.sinks.report import headline_table
from feefloor.sources.chain import Window, month_window


def source(spark: SparkSession, args) -> pipeline.Source:
    return pipeline.Source(spark.read.parquet(args.transactions),
                           spark.read.parquet(args.blocks), spark.read.parquet(args.pools))


def study_window(args) -> Window | None:
    """One month, or the days from --start up to but not including --end."""
    if args.month:
        return month_window(args.month)
    if args.start or args.end:
        tomorrow = dt.datetime.now(dt.timezone.utc).date() + dt.timedelta(days=1)
        return Window(args.start or dt.date(2009, 1, 1), args.end or tomorrow)
    return None


def show_all(df: DataFrame, vertical: bool = False) -> None:
    """Every row of a result; results are a few rows per month or pool."""
    rows = df.collect()
    for row in rows if vertical else ():
        print("\n".join(f"{name}: {value}" for name, value in row.asDict().items()), "\n")
    if not vertical:
        print("\n".join(["\t".join(df.columns), *("\t".join(map(str, r)) for r in rows)]))


def run_pipeline(spark, args):
    window = study_window(args)
    tables = pipeline.run_pipeline(spark, source(spark, args), args.run, window,
                                   only=args.only, from_step=args.from_step)
    if not args.skip_checks:
        show_all(pipeline.check(tables, strict=args.strict))
    if not args.only:
        show_all(headline_table(tables["monthly_summary"]), vertical=True)
    if window and args.out and not args.only:
        jobs.export_results(tables, args.out)


def export_results(spark, args):
    if not jobs.export_results(pipeline.Stages(spark, args.run), args.out, args.replace):
        print("the run holds no month; nothing to merge")


def export_onchain_fee(spark, args):
    if not jobs.export_onchain_fee(pipeline.Stages(spark, args.run), args.out):
        print("the run holds no month; nothing to publish")


def effective_fee(spark, args):
    tables = pipeline.Stages(spark, args.run)
    tables.write("tx_packages", pipeline.STEPS["tx_packages"](None, tables, None))


def accelerations(spark, args):
    jobs.run_accelerations(spark, args.data, args.pool_list, args.out)


def missing_months(spark, args):
    as_of = dt.datetime.now(dt.timezone.utc).date()
    show_all(months_to_load(list_months(spark, args.data), as_of).orderBy("month"))


def refresh_pools(spark, args):
    diff = jobs.refresh_pools(spark, args.pool_list, args.pools, args.print_only)
    show_all(pool_list_counts(diff))
    show_all(diff.where("change <> 'same'").select("pool_name", "change"))


def sanity_check(spark, args):
    tables = pipeline.Stages(spark, args.run)
    for name, df in jobs.sanity_check(spark.read.parquet(args.blocks), tables,
                                      args.months, args.top).items():
        print(name)
        show_all(df)


def validate(spark, args):
    tables = pipeline.Stages(spark, args.run)
    show_all(jobs.validate(tables, spark.read.parquet(args.audits), args.sample,
                           args.sensitivity, by_block=args.by_block), not args.by_block)


# command -> (function, required paths, optional flags)
COMMANDS = {
    "run-pipeline": (run_pipeline, ("transactions", "blocks", "pools", "run"), (
        ("--month", {}), ("--start", {"type": dt.date.fromisoformat}),
        ("--end", {"type": dt.date.fromisoformat}),
        ("--strict", {"action": "store_true"}), ("--from", {"dest": "from_step"}), ("--only", {}), ("--out", {}),
        ("--skip-checks", {"action": "store_true"}))),
    "effective-fee": (effective_fee, ("run",), ()),
    "export-results": (export_results, ("run", "out"),
                       (("--replace", {"action": "store_true"}),)),
    "export-onchain-fee": (export_onchain_fee, ("run", "out"), ()),
    "run-accelerations": (accelerations, ("data", "pool-list", "out"), ()),
    "missing-months": (missing_months, ("data",), ()),
    "refresh-pools": (refresh_pools, ("pool-list", "pools"), (
        ("--print", {"action": "store_true", "dest": "print_only"}),)),
    "sanity-check": (sanity_check, ("blocks", "run"), (
        ("--months", {"type": int, "default": 12}), ("--top", {"type": int, "default": 12}))),
    "validate": (validate, ("run", "audits"), (
        ("--sample", {"type": int, "default": 100}),
        ("--by-block", {"action": "store_true"}),
        ("--sensitivity", {"choices": labels(Policy()), "default": headline_label(Policy())}))),
}


def parse(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="feefloor", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (_run, paths, flags) in COMMANDS.items():
        sub = commands.add_parser(name)
        for path in paths:
            sub.add_argument(f"--{path}", required=True, metavar="PATH")
        for flag, options in flags:
            sub.add_argument(flag, **options)
    return parser.parse_args(argv)


def main(argv: list[str] | None = None) -> None:
    args = parse(argv)
    COMMANDS[args.command][0](build_session(), args)


if __name__ == "__main__":
    main()
