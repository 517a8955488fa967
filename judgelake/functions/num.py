"""Numeric column functions; every ratio of nothing is 0 unless its name says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b as double, 0 where b is 0 or null."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f1(precision: Column, recall: Column) -> Column:
    return ratio(2 * precision * recall, precision + recall)


def mcc(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    """Matthews correlation; counts become doubles before they are multiplied."""
    a, b, c, d = (x.cast("double") for x in (tp, fp, fn, tn))
    return ratio(a * d - b * c, F.sqrt((a + b) * (a + c) * (d + b) * (d + c)))


def pearson(x: Column, y: Column) -> Column:
    """Aggregate: correlation of two columns; 0 for fewer than two rows or no variance."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.coalesce(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)), F.lit(0.0))


def pearson_or_null(x: Column, y: Column) -> Column:
    """Aggregate: correlation of two columns; null for fewer than two rows or no variance."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.when(F.count_if(both) > 1, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def back_off(attempt: int, base: float = 1.0, most: float = 30.0) -> float:
    """Seconds to wait before another attempt (1, 2, ...): doubled each time, bounded."""
    return min(most, base * 2 ** max(0, attempt - 1))


def batch_size(free_bytes: int, row_bytes: int, most: int = 256) -> int:
    """Rows that fit into free memory, at least 1 and at most so many."""
    return max(1, min(most, free_bytes // max(1, row_bytes)))


def sigmoid(z: Column) -> Column:
    """1 / (1 + exp(-z)) without overflow on either side."""
    small = F.exp(-F.abs(z))
    return F.when(z >= 0, 1 / (1 + small)).otherwise(small / (1 + small))


def softplus(z: Column) -> Column:
    """log(1 + exp(z)) without overflow."""
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def pairs(n: Column) -> Column:
    """Unordered pairs of n things."""
    return F.expr("bigint(0)") + F.floor(n * (n - 1) / 2).cast("bigint")


def logit(p: Column, least: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(least)), F.lit(1 - least))
    return F.log(q / (1 - q))


def six(x: Column) -> Column:
    """Six decimals, the precision in which reports state doubles; no negative zero."""
    return F.round(x, 6) + F.lit(0.0)
