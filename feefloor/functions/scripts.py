"""Output and input script classification as Spark column expressions.

Every function takes the hex text of one script. NULL scripts stay NULL
through the template tests, so three-valued logic decides what they count as.
Cheap length tests run before the regular expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feefloor.policy import Policy

# Script templates in lower-case hex.
P2PKH = r"^76a914[0-9a-f]{40}88ac\z"
P2SH = r"^a914[0-9a-f]{40}87\z"
_KEY = r"(21(02|03)[0-9a-f]{64}|41(04|06|07)[0-9a-f]{128})"
P2PK = rf"^{_KEY}ac\z"
MULTISIG = rf"^(5[1-9a-f]|60){_KEY}+(5[1-9a-f]|60)ae\z"
OP_1, OP_16 = 81, 96
SMALL_INT_BASE = 80


def int_div(a: Column, b) -> Column:
    """Integer division that truncates toward zero."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def hex_byte(script: Column, position: int) -> Column:
    """Value of the byte whose hex text starts at ``position``; NULL if absent."""
    return F.conv(F.substring(script, position, 2), 16, 10).cast("int")


def script_bytes(script: Column) -> Column:
    return int_div(F.coalesce(F.length(script), F.lit(0)), 2)


def is_op_return(script: Column) -> Column:
    return F.coalesce(F.startswith(script, F.lit("6a")), F.lit(False))


def is_p2pkh(script: Column) -> Column:
    return (F.length(script) == 50) & script.rlike(P2PKH)


def is_p2sh(script: Column) -> Column:
    return (F.length(script) == 46) & script.rlike(P2SH)


def is_p2pk(script: Column) -> Column:
    return F.length(script).isin(70, 134) & script.rlike(P2PK)


def is_bare_multisig(script: Column) -> Column:
    return F.endswith(script, F.lit("ae")) & script.rlike(MULTISIG)


def multisig_m(script: Column) -> Column:
    return F.coalesce(hex_byte(script, 1) - SMALL_INT_BASE, F.lit(0))


def multisig_n(script: Column) -> Column:
    return F.coalesce(hex_byte(script, -4) - SMALL_INT_BASE, F.lit(0))


def lead_byte(script: Column) -> Column:
    """First byte as lower-case hex text, which sorts as the byte does."""
    return F.lower(F.substring(script, 1, 2))


def is_witness_program(script: Column) -> Column:
    size = int_div(F.length(script), 2)
    lead = lead_byte(script)
    return F.coalesce(
        size.between(4, 42)
        & ((lead == "00") | lead.between(f"{OP_1:02x}", f"{OP_16:02x}"))
        & (hex_byte(script, 3) + 2 == size),
        F.lit(False))


def witness_version(script: Column) -> Column:
    return F.greatest(F.coalesce(hex_byte(script, 1) - SMALL_INT_BASE, F.lit(0)), F.lit(0))


def witness_program_bytes(script: Column) -> Column:
    return F.coalesce(hex_byte(script, 3), F.lit(0))


def _standard(script: Column, op_return: Column, multisig: Column, witness: Column) -> Column:
    """Matches a standard template; the commonest ones are tested first."""
    versioned = lead_byte(script) > f"{SMALL_INT_BASE:02x}"
    sized = F.substring(script, 3, 2).isin(f"{20:02x}", f"{32:02x}")
    return ((witness & (versioned | sized))
            | is_p2pkh(script) | is_p2sh(script) | op_return | is_p2pk(script)
            | (multisig & (multisig_m(script) <= multisig_n(script))))


def is_standard_script(script: Column) -> Column:
    return _standard(script, is_op_return(script), is_bare_multisig(script),
                     is_witness_program(script))


def _threshold(size: Column, op_return: Column, witness: Column, policy: Policy) -> Column:
    prefix = F.when(size < 253, 1).when(size < 65536, 3).otherwise(5)
    spend = F.when(witness, policy.dust_spend_witness).otherwise(policy.dust_spend_legacy)
    priced = int_div(F.lit(policy.dust_fee_per_kvb) * (F.lit(8) + prefix + size + spend), 1000)
    return F.when(op_return | (size > policy.max_script_size), F.lit(0)).otherwise(priced)


def _dust(value: Column, size: Column, op_return: Column, witness: Column,
          policy: Policy) -> Column:
    # No threshold exceeds that of the longest spendable script, so most values
    # need one comparison.
    most = policy.dust_fee_per_kvb * (
        13 + policy.max_script_size + policy.dust_spend_legacy) // 1000
    return (value < most) & (value < _threshold(size, op_return, witness, policy))


def dust_threshold(script: Column, policy: Policy = Policy()) -> Column:
    return _threshold(script_bytes(script), is_op_return(script),
                      is_witness_program(script), policy)


def is_dust(value: Column, script: Column, policy: Policy = Policy()) -> Column:
    return _dust(value, script_bytes(script), is_op_return(script),
                 is_witness_program(script), policy)


def output_stats(outputs: Column, policy: Policy = Policy()) -> Column:
    """Struct of the seven counts the relay rules read; zeros for no outputs.

    Array passes read, classify and fold the outputs in place: no explode, so no
    shuffle. What several tests share is read once per output.
    """
    facts = F.transform(outputs, lambda o: F.struct(
        o["value"].cast("long").alias("value"),
        o["script_hex"].alias("script"),
        script_bytes(o["script_hex"]).alias("size"),
        is_op_return(o["script_hex"]).alias("op_return"),
        is_bare_multisig(o["script_hex"]).alias("multisig"),
        is_witness_program(o["script_hex"]).alias("witness")))
    classes = F.transform(facts, lambda f: F.struct(
        F.when(f["multisig"], multisig_n(f["script"])).otherwise(0).alias("n"),
        f["multisig"].alias("multisig"),
        F.when(f["op_return"], f["size"]).otherwise(F.lit(0)).alias("carrier"),
        f["op_return"].alias("op_return"),
        _standard(f["script"], f["op_return"], f["multisig"], f["witness"]).alias("standard"),
        _dust(f["value"], f["size"], f["op_return"], f["witness"], policy).alias("dust")))

    def tally(flag: Column) -> Column:
        return F.when(flag, F.lit(1)).otherwise(F.lit(0)).cast("long")

    zero = F.lit(0).cast("long")
    start = F.struct(*[zero.alias(n) for n in OUTPUT_STATS])

    def fold(acc: Column, c: Column) -> Column:
        return F.struct(
            F.greatest(acc["bare_multisig_max_n"], c["n"].cast("long"))
            .alias("bare_multisig_max_n"),
            (acc["op_return_count"] + tally(c["op_return"])).alias("op_return_count"),
            F.greatest(acc["op_return_max_bytes"], c["carrier"]).alias("op_return_max_bytes"),
            (acc["op_return_total_bytes"] + c["carrier"]).alias("op_return_total_bytes"),
            (acc["nonstandard_outputs"] + tally(~c["standard"])).alias("nonstandard_outputs"),
            (acc["dust_outputs"] + tally(c["dust"])).alias("dust_outputs"),
            (acc["dust_outputs_excl_multisig"] + tally(c["dust"] & ~c["multisig"]))
            .alias("dust_outputs_excl_multisig"))

    return F.coalesce(F.aggregate(classes, start, fold), start)


OUTPUT_STATS = ("bare_multisig_max_n", "op_return_count", "op_return_max_bytes",
                "op_return_total_bytes", "nonstandard_outputs", "dust_outputs",
                "dust_outputs_excl_multisig")


def input_stats(inputs: Column) -> Column:
    """Largest scriptSig, and whether any opens with an opcode above OP_16."""
    largest = F.array_max(F.transform(inputs, lambda i: script_bytes(i["script_hex"])))
    nonpush = F.exists(inputs, lambda i: F.coalesce(
        hex_byte(i["script_hex"], 1) > OP_16, F.lit(False)))
    return F.struct(
        F.coalesce(largest, F.lit(0).cast("long")).alias("max_scriptsig_bytes"),
        F.coalesce(nonpush, F.lit(False)).alias("opens_with_nonpush_opcode"))


def input_hashes(inputs: Column) -> Column:
    """Distinct non-null hashes of the transactions spent."""
    hashes = F.transform(inputs, lambda i: i["spent_transaction_hash"])
    return F.coalesce(F.array_distinct(F.filter(hashes, lambda h: h.isNotNull())),
                      F.array().cast("array<string>"))


def coinbase_addresses(is_coinbase: Column, outputs: Column) -> Column:
    """Distinct payout addresses of a coinbase; an empty array otherwise."""
    empty = F.array().cast("array<string>")
    paid = F.array_distinct(F.flatten(F.transform(
        outputs, lambda o: F.coalesce(o["addresses"], empty))))
    return F.when(is_coinbase, F.coalesce(paid, empty)).otherwise(empty)
