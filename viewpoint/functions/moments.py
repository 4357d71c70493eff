"""Sums, means and spreads of doubles that do not depend on the order of the rows.

A double is split into its whole part and its fraction in units of 2 ** -59, both
whole numbers, which are summed as decimals without any rounding: every
partitioning and every order of merges gives the same sum. A fraction's bits
below 2 ** -59 are rounded once per value. Values of 2 ** 59 and more, infinite ones and
NaN have no such parts; they are summed as doubles and added at the end.

Spreads are states (n, mean, M2) with M2 the sum of the squared distances from
the state's mean. States are merged by Chan's rule, so nothing cancels.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 59
UNIT = float(1 << BITS)
#: Suffixes of the columns of an exact sum: whole part, fraction, the rest.
PARTS = ("w", "p", "x")


def _parts(value: Column) -> tuple[Column, Column, Column]:
    x = value.cast("double")
    fits = F.abs(x) < UNIT
    # x - whole is exact: both have the sign of x and the fraction has no bit that x lacks.
    whole = F.when(fits, x).cast("bigint")
    part = F.rint((F.when(fits, x) - whole.cast("double")) * UNIT).cast("bigint")
    return whole, part, F.when(~fits, x)


def sum_columns(value: Column, name: str) -> list[Column]:
    """The aggregates of an exact sum, named ``name`` + '_w', '_p' and '_x'."""
    whole, part, rest = _parts(value)
    decimals = [F.sum(c.cast("decimal(28,0)")).alias(f"{name}_{s}") for c, s in ((whole, "w"), (part, "p"))]
    return [*decimals, F.sum(rest).alias(f"{name}_x")]


def merge_columns(name: str) -> list[Column]:
    """The aggregates that add up columns of :func:`sum_columns`."""
    return [F.sum(f"{name}_{s}").alias(f"{name}_{s}") for s in PARTS]


def total(name: str) -> Column:
    """The sum as a double, from the columns of :func:`sum_columns`; NULL without values."""
    return _total(*[F.col(f"{name}_{s}") for s in PARTS])


def _total(whole: Column, part: Column, rest: Column) -> Column:
    exact = whole.cast("double") + part.cast("double") / UNIT
    return F.when(rest.isNull(), exact).otherwise(F.coalesce(exact, F.lit(0.0)) + rest)


def exact_sum(value: Column) -> Column:
    """Aggregate: the sum of the values that are not NULL; NULL without any."""
    whole, part, rest = _parts(value)
    return _total(F.sum(whole.cast("decimal(28,0)")), F.sum(part.cast("decimal(28,0)")), F.sum(rest))


def mean(value) -> Column:
    """Aggregate: the mean of the values that are not NULL; NULL without any."""
    value = F.col(value) if isinstance(value, str) else value
    return F.try_divide(exact_sum(value), F.count(value))


def spread_column(value: Column) -> Column:
    """Aggregate: M2 of the values that are not NULL (0 for one, NULL without any)."""
    x = value.cast("double")
    return F.var_pop(x) * F.count(x)


def merged_spread(n: Column, mean: Column, m2: Column, whole_mean: Column) -> Column:
    """Aggregate: M2 of the union of states (n, mean, m2) whose common mean is ``whole_mean``."""
    return F.sum(F.when(n > 0, m2 + n * (mean - whole_mean) * (mean - whole_mean)))
