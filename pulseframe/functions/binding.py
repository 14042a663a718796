"""Naming an intermediate value inside a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` evaluated, and present in the plan, only once.

    Intermediate columns do not give that: the planner merges stacked projections, so an
    expression used k times at each of n levels is written out k^n times.
    """
    return F.get(F.transform(F.array(value), f), F.lit(0))
