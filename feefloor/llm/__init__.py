"""Operators for preparing training text: filters, deduplication, packing, archives."""
