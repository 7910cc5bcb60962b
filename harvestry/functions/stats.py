"""Statistics of counts, as columns."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def min_abs_sup(a: int, b: int, n: int, e: float = 0.999) -> int:
    """Smallest number of common transactions whose hypergeometric distribution function exceeds e; min(a, b) if none does."""
    low, high = max(0, a + b - n), min(a, b)
    if n <= 0 or low >= high:
        return high
    mean = a * b / n
    sd = math.sqrt(max(1e-12, mean * (1 - a / n) * (1 - b / n) * n / max(1, n - 1)))
    x = max(low, math.floor(mean - 12 * sd - 12))  # what lies below adds under 1e-20
    g = math.lgamma
    log = g(b + 1) + g(n - b + 1) + g(a + 1) + g(n - a + 1) - g(x + 1) - g(b - x + 1) - g(a - x + 1) - g(n - a - b + x + 1) - g(n + 1)
    total, p = 0.0, math.exp(log)
    while x < high:
        total += p
        if total > e:
            return x
        p *= (a - x) * (b - x) / ((x + 1) * (n - a - b + x + 1))
        x += 1
    return high


def _min_abs_sups(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    known: dict[tuple, int] = {}
    for columns in batches:
        out = []
        for key in zip(*columns, strict=True):
            if key not in known:
                if len(known) > 100_000:
                    known.clear()
                known[key] = min_abs_sup(int(key[0]), int(key[1]), int(key[2]), float(key[3]))
            out.append(known[key])
        yield pd.Series(out, dtype="int64")


def min_abs_sup_udf(a, b, n, e) -> Column:
    """min_abs_sup of columns: a sum of a data-dependent number of terms, which no built-in function has."""
    return F.pandas_udf(_min_abs_sups, "long")(a, b, n, e)


def support(count: Column, n: Column) -> Column:
    return count.cast("double") / n


def confidence(both: Column, antecedent: Column, n: Column) -> Column:
    """0 where the antecedent does not occur."""
    return F.when(antecedent == 0, 0.0).otherwise(support(both, n) / support(antecedent, n))


def lift(both: Column, antecedent: Column, consequent: Column, n: Column) -> Column:
    return confidence(both, antecedent, n) / support(consequent, n)


def bernoulli_variance(count: Column, n: Column) -> Column:
    s = support(count, n)
    return (count * (1 - s) * (1 - s) + (n - count) * s * s) / n


def hoeffding_two(n0: Column, n1: Column, delta: float) -> Column:
    """Bound of the difference of two counts' means over n0 and n1 transactions; m is their harmonic mean."""
    m = 1.0 / (1.0 / n0 + 1.0 / n1)
    return F.sqrt(m / 2 * F.log(4 * (n0 + n1) / F.lit(float(delta))))


def hoeffding_one(n: Column, delta: float) -> Column:
    return F.sqrt(F.lit(math.log(1 / delta)) / (2 * n))


def cut_epsilon(n_left: Column, n_right: Column, variance: Column, delta: float) -> Column:
    """How far two sides' supports may differ by chance. Sides need more than 4 transactions; null otherwise."""
    n = n_left + n_right
    dd = F.log(2 * F.log(n) / F.lit(float(delta)))
    m = 1.0 / (n_right - 4) + 1.0 / (n_left - 4)
    return F.when((n_left > 4) & (n_right > 4), F.sqrt(2 * m * variance * dd) + 2.0 / 3.0 * dd * m)


def auto_threshold(items: Column, paths: Column) -> Column:
    rho = F.lit(2.24) / F.sqrt(items - 1)
    return F.abs((1 - rho) * (items * items - 1) / (6 * items * paths))


def linear_forecast(initial: Column, previous: Column, now: Column, block: int, delta: float = 0.001) -> Column:
    """Next block's share of an item, from its counts at the block's start, middle and end."""
    first, second = previous - initial, now - previous
    bound = math.sqrt(math.log(1 / delta) / (2 * block))
    return F.when(F.lit(bound) < 2 * (second - first) / float(block), (2 * now - initial) / float(block)).otherwise((now + 2 * second - first) / float(block))


def kernel_forecast(sum_x2y: Column, sum_x4: Column, block: int) -> Column:
    """Least squares of y = w * x * x, which online regression with a squared polynomial kernel on one number is, at 2 * block."""
    return 4.0 * block * block * sum_x2y / sum_x4


def popcount(x: Column) -> Column:
    return F.bit_count(x)
