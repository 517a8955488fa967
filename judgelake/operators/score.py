"""Weighted scores and log sums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from judgelake.functions.num import ratio


def weighted_score(values: Column, weights: Column) -> Column:
    """Sum of value times |weight| over the sum of |weight|; a null weight is 1, values beyond the shorter array don't count."""
    n = F.least(F.size(values), F.size(weights))
    pair = F.slice(F.arrays_zip(values.alias("v"), weights.alias("w")), 1, F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)))
    w = lambda x: F.abs(F.coalesce(x["w"], F.lit(1.0)))
    top = F.aggregate(pair, F.lit(0.0), lambda s, x: s + F.coalesce(x["v"], F.lit(0.0)).cast("double") * w(x))
    low = F.aggregate(pair, F.lit(0.0), lambda s, x: s + w(x))
    return ratio(top, low)


def rubric_weights(rubric: Column) -> Column:
    return F.transform(rubric, lambda r: F.coalesce(r["weight"], F.lit(1.0)))


def fallback_verdicts(rubric: Column, threshold: float = 5.0) -> Column:
    """Verdicts where no judge could be read: 1 for criteria whose weight reaches the threshold."""
    return F.transform(rubric, lambda r: F.when(F.coalesce(r["weight"], F.lit(0.0)) >= threshold, 1).otherwise(0))


def log_sum_exp(xs: Column) -> Column:
    """log of the sum of exponentials of an array; negative infinity for an empty one."""
    top = F.array_max(xs)
    total = F.aggregate(xs, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return F.when(F.size(xs) > 0, top + F.log(total)).otherwise(F.lit(float("-inf")))
