"""Evaluate an expression once per row and use it several times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` as a variable.

    Written inline, a costly expression is evaluated at each mention, and in a
    lambda once more per element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
