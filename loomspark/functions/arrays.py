"""Helpers for expressions over arrays.

Inside a lambda a column's name may also mean an earlier alias of the same select, so nothing but variables of lambdas is named
there: what a lambda needs from outside is bound by ``let`` first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), value being worked out once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def let_all(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """body(struct of the values)."""
    return let(F.struct(*[v.alias(k) for k, v in values.items()]), body)


def running_sum(values: Column) -> Column:
    """Array of each number plus all before it, in n log n: the sums of ever longer stretches."""
    steps = F.array(*[F.lit(1 << k) for k in range(31)])
    doubled = lambda a, step: F.transform(a, lambda x, i: x + F.coalesce(F.get(a, i - step), F.lit(0)))
    return let(values, lambda v: F.aggregate(F.filter(steps, lambda s: s < F.size(v)), v, doubled))
