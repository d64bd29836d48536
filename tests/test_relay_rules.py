"""Each relay rule before and after the day it changed."""

import datetime as dt

import pytest

from feefloor.operators.extract import onchain_monthly_fee
from feefloor.operators.relay import DIRECT_REASONS, relay_reasons
from feefloor.operators.updates import price_packages
from feefloor.operators.packages import packages
from feefloor.operators.relay import in_package_set
from feefloor.policy import Policy

SCHEMA = """tx_hash string, block_number long, block_timestamp timestamp, block_month date,
 is_coinbase boolean, fee long, virtual_size long, serialized_size long, version long,
 input_hashes array<string>, coinbase_addresses array<string>, bare_multisig_max_n long,
 op_return_count long, op_return_max_bytes long, op_return_total_bytes long,
 nonstandard_outputs long, dust_outputs long, dust_outputs_excl_multisig long,
 max_scriptsig_bytes long, opens_with_nonpush_opcode boolean"""
DEFAULTS = dict(
    block_number=800_000, is_coinbase=False, fee=10_000, virtual_size=1_000,
    serialized_size=1_000, version=2, input_hashes=[], coinbase_addresses=[],
    bare_multisig_max_n=0, op_return_count=0, op_return_max_bytes=0, op_return_total_bytes=0,
    nonstandard_outputs=0, dust_outputs=0, dust_outputs_excl_multisig=0,
    max_scriptsig_bytes=100, opens_with_nonpush_opcode=False)


def tx(name, day, **values):
    stamp = dt.datetime.fromisoformat(day).replace(tzinfo=dt.timezone.utc)
    row = {**DEFAULTS, "tx_hash": name, "block_timestamp": stamp,
           "block_month": stamp.date().replace(day=1), **values}
    # One block per case, unless the case places several transactions together.
    return row


def dust(n, **values):
    return dict(dust_outputs=n, dust_outputs_excl_multisig=n, **values)


def carrier(count, largest, total):
    return dict(op_return_count=count, op_return_max_bytes=largest,
                op_return_total_bytes=total)


P = Policy()
WEEK = dt.timedelta(days=7)


def at(day, weeks=0):
    return (dt.date.fromisoformat(day) + weeks * WEEK).isoformat()


#: Rules whose answer changes with a release: (rule, its day, the transaction, broken
#: before that day, broken from it on). Tried the day before, on the day, and a week on.
DATED = [
    ("sub_minrelay", P.min_relay_change, dict(fee=int(700 * P.min_relay_before) // 2,
                                              virtual_size=700), True, False),
    ("sub_minrelay", P.min_relay_change, dict(fee=int(800 * P.min_relay_after) - 1,
                                              virtual_size=800), True, True),
    ("op_return", P.datacarrier_change, carrier(1, P.datacarrier_limit_before + 7,
                                                P.datacarrier_limit_before + 7), True, False),
    ("op_return", P.datacarrier_change, carrier(
        2, P.datacarrier_limit_before, P.datacarrier_limit_after + 1), False, True),
    ("multi_op_return", P.datacarrier_change, carrier(5, 11, 55), True, False),
    ("version", P.truc_change, dict(version=P.version_max_after), True, False),
    ("version", P.truc_change, dict(version=P.version_max_after + 3), True, True),
    ("version", P.truc_change, dict(version=P.version_min - 1), True, True),
    ("truc", P.truc_change, dict(version=P.truc_version, virtual_size=P.truc_max_vsize + 600),
     False, True),
    ("truc", P.truc_change, dict(version=2, virtual_size=3 * P.truc_max_vsize), False, False),
    ("dust", P.dust_change, dust(P.max_dust_before + 1), True, True),
    ("dust", P.dust_change, dict(dust_outputs=4, dust_outputs_excl_multisig=0), False, True),
    ("dust", P.dust_change, dust(P.max_dust_after + 2, fee=0), True, True),
]
#: Rules with one limit on every day: (rule, column, the last value allowed, one beyond).
LIMITS = [
    ("oversized", "virtual_size", P.max_standard_vsize, P.max_standard_vsize + 1),
    ("bare_multisig", "bare_multisig_max_n", P.multisig_max_n, P.multisig_max_n + 1),
    ("scriptsig_size", "max_scriptsig_bytes", P.max_scriptsig_size, P.max_scriptsig_size + 1),
    ("nonstandard_script", "nonstandard_outputs", 0, 2),
    ("scriptsig_nonpush", "opens_with_nonpush_opcode", False, True),
]
DAYS = ("2023-02-14", "2025-07-20", "2026-06-30")


def bare(size):
    """A transaction without witness: both its sizes are the same."""
    return dict(virtual_size=size, serialized_size=size)


def with_child(rule, want, day, parent, child):
    return (rule, want, tx("p", day, **parent), [tx("c", day, input_hashes=["p"], **child)])


# (rule, expected, transaction under test, others of its block)
CASES = {}
for rule, day, values, before_it, from_it in DATED:
    eve = (dt.date.fromisoformat(day) - dt.timedelta(days=1)).isoformat()
    for when, want in ((eve, before_it), (day, from_it), (at(day, 1), from_it)):
        CASES[f"{rule} {when} {len(CASES)}"] = (rule, want, tx("p", when, **values), [])
for rule, column, allowed, beyond in LIMITS:
    for day in DAYS:
        for value in (allowed, beyond):
            CASES[f"{rule} {value} {day}"] = (rule, value == beyond,
                                              tx("p", day, **{column: value}), [])
LATE = at(P.dust_change, 9)
TRUC = dict(version=P.truc_version)
CASES |= {
    "smallest": ("undersized", False, tx("p", DAYS[0], **bare(P.min_nonwitness_size)), []),
    "too small": ("undersized", True, tx("p", DAYS[0], **bare(P.min_nonwitness_size - 1)), []),
    "small but for its witness": ("undersized", False, tx(
        "p", DAYS[1], virtual_size=160, serialized_size=430), []),
    "size unknown": ("undersized", False, tx("p", DAYS[1], serialized_size=None), []),
    "fee unknown": ("sub_minrelay", False, tx("p", DAYS[0], fee=None), []),
    "dust spent at once": with_child("dust", False, LATE, dust(1, fee=0), dict(fee=7_300)),
    "dust of unknown fee spent": with_child("dust", False, LATE, dust(1, fee=None),
                                            dict(fee=7_300)),
    "dust left behind": ("dust", True, tx("p", LATE, **dust(1, fee=0)), []),
    "free with a generous child": with_child("sub_minrelay", False, DAYS[0], dict(fee=0),
                                             dict(fee=4_400)),
    "free with a mean child": with_child("sub_minrelay", True, DAYS[0], dict(fee=0),
                                         dict(fee=13)),
    "free, its child a block on": with_child("sub_minrelay", True, DAYS[0], dict(fee=0),
                                             dict(fee=4_400, block_number=3)),
    "child of its kind too large": ("truc", True, tx(
        "c", LATE, input_hashes=["p"], virtual_size=P.truc_child_max_vsize + 90, **TRUC),
        [tx("p", LATE, **TRUC)]),
    "parent of its kind may be": with_child("truc", False, LATE, TRUC, dict(
        virtual_size=P.truc_child_max_vsize + 90, **TRUC)),
    "child of another kind": ("truc", True, tx("c", LATE, input_hashes=["p"], **TRUC),
                              [tx("p", LATE, version=1)]),
    "the same before it was a kind": ("truc", False, tx(
        "c", at(P.truc_change, -1), input_hashes=["p"], **TRUC),
        [tx("p", at(P.truc_change, -1), version=1)]),
}


@pytest.fixture(scope="module")
def verdicts(spark):
    rows = []
    for i, (_rule, _want, subject, others) in enumerate(CASES.values()):
        for row in (subject, *others):
            rows.append({**row, "tx_hash": f"{i}{row['tx_hash']}",
                         "input_hashes": [f"{i}{h}" for h in row["input_hashes"]],
                         "block_number": row["block_number"] + 10 * i})
    rows.append(tx("plain", "2024-06-01"))
    rows.append(tx("cb", "2024-01-01", is_coinbase=True, fee=0, nonstandard_outputs=3,
                   dust_outputs=2, version=9, virtual_size=30, serialized_size=30))
    df = spark.createDataFrame(rows, SCHEMA)
    return {r["tx_hash"]: r for r in relay_reasons(df).collect()}


@pytest.mark.parametrize("case", list(CASES))
def test_rule(verdicts, case):
    rule, want, subject, _others = CASES[case]
    got = verdicts[f"{list(CASES).index(case)}{subject['tx_hash']}"]
    assert got[f"nonrelay_{rule}"] is want
    assert got["is_nonrelayable"] is any(got[r] for r in DIRECT_REASONS)


@pytest.mark.parametrize("name", ["plain", "cb"])
def test_no_reason_at_all(verdicts, name):
    assert not any(verdicts[name][r] for r in DIRECT_REASONS)
    assert verdicts[name]["is_nonrelayable"] is False


def test_single_transaction_packages(verdicts):
    assert verdicts["plain"]["effective_fee_rate"] == 10.0
    assert verdicts["plain"]["package_id"] == "plain"
    assert verdicts["cb"]["effective_fee_rate"] is None
    child = verdicts[f"{list(CASES).index('free with a generous child')}c"]
    assert child["in_package"] and child["effective_fee_rate"] is None


def test_ancestor_limit_dates(spark):
    """A chain of 26 breaks the limit at its end, until cluster limits came."""
    def chain(day, block, n, **values):
        return [tx(f"{block}-{i:02d}", day, block_number=block,
                   input_hashes=[f"{block}-{i - 1:02d}"] if i else [], **values)
                for i in range(n)]
    rows = (chain("2024-01-01", 1, 26) + chain("2024-01-01", 2, 25)
            + chain("2026-04-21", 3, 26) + chain("2025-01-01", 4, 3, version=3)
            + chain("2026-05-01", 5, 3, version=3)
            + chain("2024-01-01", 6, 3, virtual_size=40_000, serialized_size=40_000, fee=10**6))
    txs = relay_reasons(spark.createDataFrame(rows, SCHEMA))
    priced = price_packages(txs, packages(in_package_set(txs)))
    over = {r["tx_hash"] for r in priced.where("nonrelay_ancestor_limit").collect()}
    assert over == {"1-25", "4-02", "5-02", "6-02"}
    assert priced.where("nonrelay_ancestor_limit AND NOT is_nonrelayable").isEmpty()
    assert priced.count() == len(rows)


def test_monthly_fee_leaves_coinbases_out(spark):
    rows = [tx("a", "2024-01-05"), tx("b", "2024-01-06", block_number=2, fee=None),
            tx("cb", "2024-01-07", block_number=3, is_coinbase=True, fee=0)]
    got = onchain_monthly_fee(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r["txs"], r["blocks"], r["fee_sats"], r["vbytes"], r["fee_rate_sat_vb"])
            for r in got] == [(2, 2, 10_000, 2_000, 5.0)]
