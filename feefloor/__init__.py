"""Spark-native analysis of how block space in a proof-of-work chain is priced."""

from feefloor.policy import Policy

__all__ = ["Policy"]
