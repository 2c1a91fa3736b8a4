"""Small helpers for expressions written as SQL text.

Long lists of values or cases are one SQL expression instead of a tree of Column
calls, which keeps building a plan cheap.
"""

from __future__ import annotations


def quoted(value: str) -> str:
    """A string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def one_of(values) -> str:
    return "(" + ", ".join(map(quoted, values)) + ")"
