"""Hashes as bytes while they are moved.

A hash is 64 hex digits of text, and two such digits are a byte. Shuffles compress by
repeats, of which hashes have none, so a packed hash is half as much to move. Any text
can be packed: one that is not lower-case hex keeps its own bytes behind a mark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns that hold hashes, one or a list, wherever they occur.
HASHES = ("tx_hash", "package_id", "parent_hashes", "block_hash")

# First byte of a packed text: its own bytes follow, or those its digits stand for.
_TEXT, _HEX = b"\x00", b"\x01"


def pack(text: Column) -> Column:
    """Bytes that stand for ``text``, different for different texts; NULL stays NULL."""
    digits = F.unhex(text)
    return F.when(F.lower(F.hex(digits)) == text, F.concat(F.lit(_HEX), digits)).otherwise(
        F.concat(F.lit(_TEXT), text.cast("binary")))


def unpack(packed: Column) -> Column:
    rest = F.substring(packed, 2, 2**31 - 1)
    return F.when(F.substring(packed, 1, 1) == F.lit(_HEX), F.lower(F.hex(rest))).otherwise(
        rest.cast("string"))


def _each(df: DataFrame, kind: str, change) -> DataFrame:
    """``change`` on those columns of ``df`` among ``HASHES`` that are of a kind, or lists of it."""
    kinds = {c: t for c, t in df.dtypes if c in HASHES}
    changed = {c: change(F.col(c)) for c, t in kinds.items() if t == kind}
    changed |= {c: F.transform(c, change) for c, t in kinds.items() if t == f"array<{kind}>"}
    return df.withColumns(changed) if changed else df


def packed(df: DataFrame) -> DataFrame:
    return _each(df, "string", pack)


def unpacked(df: DataFrame) -> DataFrame:
    return _each(df, "binary", unpack)
