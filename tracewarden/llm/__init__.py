"""Operators for preparing training text: deduplication, filters, mixing, formatting and token encoding."""
