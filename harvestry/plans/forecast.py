"""Forecasts of item frequencies at the end of a block, for ordering trees before the next one comes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestry.functions import stats
from harvestry.operators import counting


def half_counts(tx: DataFrame, block: int, middle: int | None = None) -> DataFrame:
    """(block, item, initial, previous, now): counts in a block at its start, its middle (after so many transactions; half
    of them if not given) and its end; whole blocks only."""
    e = counting.exploded(tx).withColumn("block", F.floor(F.col("tid") / block))
    full = tx.groupBy(F.floor(F.col("tid") / block).alias("block")).count().where(F.col("count") == block).select("block")
    half = F.pmod("tid", F.lit(block)) < (block // 2 if middle is None else middle)
    return e.join(full, "block", "left_semi").groupBy("block", "item").agg(F.lit(0).cast("long").alias("initial"), F.sum(half.cast("long")).alias("previous"), F.count("*").alias("now"))


def linear(tx: DataFrame, block: int, middle: int | None = None) -> DataFrame:
    return half_counts(tx, block, middle).select("block", "item", stats.linear_forecast(F.col("initial"), F.col("previous"), F.col("now"), block).alias("forecast"))


def kernel(tx: DataFrame, block: int, points: int) -> DataFrame:
    """From the counts at `points` evenly spaced positions of a block.

    An occurrence at position p of the block counts at every point from p + 1 on, so the sums over points need no
    running count: each occurrence adds the sum of x * x over the points after it, known from how many there are.
    """
    step = block // points
    full = tx.groupBy(F.floor(F.col("tid") / block).alias("block")).count().where(F.col("count") == block).select("block")
    e = counting.exploded(tx).withColumn("block", F.floor(F.col("tid") / block)).join(full, "block", "left_semi")
    before = F.floor(F.pmod("tid", F.lit(block)) / step).cast("double")  # whole points up to the occurrence
    squares = lambda n: n * (n + 1) * (2 * n + 1) / 6.0
    rest = (squares(F.lit(float(points))) - squares(F.least(before, F.lit(float(points))))) * float(step * step)
    x4 = float(sum((step * i) ** 4 for i in range(1, points + 1)))
    return e.groupBy("block", "item").agg(stats.kernel_forecast(F.sum(rest), F.lit(x4), block).alias("forecast"))
