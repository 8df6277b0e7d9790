"""Evaluating a sub-expression once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also inside a conditional branch.

    Keeps generated code small where ``body`` uses the value many times.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
