"""Problem 2: percentiles of very large numeric columns from mergeable logarithmic buckets.

A sketch is an ordinary table ``keys..., side, bucket, n``: values of one sign whose magnitude lies in
``(gamma^(b-1), gamma^b]`` share bucket ``b``, where ``gamma`` is a little less than ``(1 + a) / (1 - a)``. The middle
of a bucket is within the relative error ``a`` of every value in it, so each percentile is within ``a`` of the exact
value of that rank, however small or large. Counts add up, so sketches of days, files or partitions combine by one
aggregation.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Relative error of every reported percentile.
ACCURACY = 0.01
#: Share of the error that the buckets use; the rest covers the rounding of logarithms and powers.
USED = 0.9999
#: Largest finite double.
LARGEST = 1.7976931348623157e308


def gamma_of(accuracy: float) -> float:
    """Ratio of the ends of a bucket."""
    if not 0 < accuracy < 1:
        raise ValueError("accuracy must lie between 0 and 1")
    return (1 + accuracy * USED) / (1 - accuracy * USED)


def sketch(df: DataFrame, value: Column, keys: dict[str, Column], accuracy: float = ACCURACY) -> DataFrame:
    """Bucket counts of ``value`` per group: ``keys..., side, bucket, n``.

    ``side`` is -1, 0 or 1; only 0 itself has side 0. Null, NaN and infinite values are left out; null keys form a
    group of their own. The aggregation combines on the map side, so a hot group sends at most one row per bucket
    and task: a 64-bit integer has at most about 4,400 buckets at an accuracy of 0.01, any double some 145,000.
    """
    v = value.cast("double")
    size = F.abs(v)
    rows = (
        df.select(*[c.alias(k) for k, c in keys.items()], v.alias("__v"), size.alias("__size"))
        .where(F.col("__v").isNotNull() & ~F.isnan("__v") & (F.col("__size") < F.lit(float("inf"))))
        .withColumn("side", F.signum("__v").cast("int"))
        .withColumn(
            "bucket",
            F.when(F.col("side") == 0, F.lit(0)).otherwise(F.ceil(F.log("__size") / math.log(gamma_of(accuracy)))).cast("long"),
        )
    )
    return rows.groupBy(*keys, "side", "bucket").agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """The sketch of all values behind ``sketches``; ``keys`` may be fewer than theirs, which rolls up."""
    together = reduce(DataFrame.unionByName, [s.select(*keys, "side", "bucket", "n") for s in sketches])
    return together.groupBy(*keys, "side", "bucket").agg(F.sum("n").alias("n"))


def percentiles(
    counts: DataFrame, keys: Sequence[str], wanted: dict[str, float], accuracy: float = ACCURACY
) -> DataFrame:
    """``keys..., n`` and one column per entry of ``wanted`` (name to share between 0 and 1).

    The value of rank ``floor(q * (n - 1))`` is estimated by the middle of its bucket, unrounded: rounding to
    decimals would cost small values their relative error. Below 2.2e-308, where doubles lose digits, the error is
    what they allow. A window holds one group's buckets, never its values. An empty sketch yields no row.
    """
    gamma = gamma_of(accuracy)
    order = F.col("side") * (F.col("bucket") + F.lit(1 << 40))
    group = Window.partitionBy(*keys)
    upto = group.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = F.col("side") * F.least(F.pow(F.lit(gamma), F.col("bucket") - 1) * (2 * gamma / (gamma + 1)), F.lit(LARGEST))
    ranked = counts.select(
        *keys, "n", F.sum("n").over(upto).alias("__upto"), F.sum("n").over(group).alias("__all"), middle.alias("__middle")
    )
    return ranked.groupBy(*keys).agg(
        F.max("__all").alias("n"),
        *[
            F.min(F.when(F.col("__upto") > F.floor(F.lit(q) * (F.col("__all") - 1)), F.col("__middle"))).alias(name)
            for name, q in wanted.items()
        ],
    )
