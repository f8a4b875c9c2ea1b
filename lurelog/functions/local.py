"""Small helpers for SQL expression text.

The scalar functions of this package take and return SQL text.  One long
expression is then parsed in a single call, where building it from hundreds of
Python column objects would cost seconds per plan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is evaluated once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def quoted(text: str) -> str:
    """A SQL string literal."""
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def columns(**expressions: str) -> dict[str, Column]:
    """Named SQL texts as the argument of ``withColumns``."""
    return {name: F.expr(text) for name, text in expressions.items()}
