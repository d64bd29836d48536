"""Small shared formulas: rates, bands, predicates, text and date helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from feefloor.functions.scripts import int_div


def ratio(a: Column, b: Column) -> Column:
    """a / b in doubles; NULL when b is 0 or either side is NULL."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def raw_fee_rate(fee: Column, vsize: Column) -> Column:
    return ratio(fee, vsize)


def max_nonwitness_size(vsize: Column, size: Column, default: int) -> Column:
    """Upper bound of the non-witness bytes; ``default`` when unknown."""
    return F.coalesce(int_div(F.lit(4) * vsize - size, 3), F.lit(default))


def version_or_default(version: Column, default: int) -> Column:
    return F.coalesce(version, F.lit(default))


def lower_band_sats(floor: Column, rate: Column, vsize: Column) -> Column:
    """What the buyer paid less than the floor; NULL when a side is NULL."""
    gap = F.when(floor.isNotNull() & rate.isNotNull(),
                 F.greatest(floor - rate, F.lit(0.0)))
    return gap * vsize


def upper_band_sats(median: Column, vsize: Column) -> Column:
    return median * vsize


def full_and_priced(is_full: Column, floor: Column) -> Column:
    return is_full & floor.isNotNull()


def low_fee_denominator(is_full: Column, floor: Column, nonrelayable: Column) -> Column:
    return full_and_priced(is_full, floor) & ~nonrelayable


def completed_only(status: Column) -> Column:
    return F.coalesce(F.contains(status, F.lit("completed")), F.lit(False))


def any_of(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, flags)


def coinbase_text(param_hex: Column) -> Column:
    """Coinbase bytes as text; bad UTF-8 replaced, NULL as the empty string."""
    return F.coalesce(F.make_valid_utf8(F.unhex(param_hex).cast("string")), F.lit(""))


def printable_prefix(text: Column, size: int = 48) -> Column:
    return F.substring(F.regexp_replace(text, r"[^ -~]", "."), 1, size)


def block_date(ts: Column) -> Column:
    return F.to_date(ts)


def block_month(ts: Column) -> Column:
    return F.trunc(F.to_date(ts), "MM")


def month_label(month: Column) -> Column:
    return F.date_format(month, "yyyy-MM")


def sats_to_btc(sats: Column, digits: int = 8) -> Column:
    return F.round(sats.cast("double") / F.lit(1e8), digits)


def vbytes_to_gvb(vbytes: Column) -> Column:
    return F.round(vbytes.cast("double") / F.lit(1e9), 3)


def sum_if(flag: Column, value: Column) -> Column:
    """SUM over the rows where ``flag`` holds; 0 when there are none."""
    zero = F.lit(0).cast("long")
    return F.sum(F.when(flag, value).otherwise(zero))
