"""Fusing ranked lists and limiting rows per file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Constant of reciprocal ranks, and the weight of the vector list when its embedder is the hashing one.
CONSTANT = 40
HASHING_WEIGHT = 0.45


def fuse(lists: dict[str, tuple[DataFrame, float]], query: Sequence[str], document: str, constant: int = CONSTANT) -> DataFrame:
    """``query..., document, score`` and a column ``<name>_rank`` per list; the score sums weight / (constant + rank).

    Each list has ``query..., document, rank``. One union and one aggregation. Equal scores keep the order of the
    first list, then of the second, which ``fused_order`` gives.
    """
    parts = [df.select(*query, document, F.lit(name).alias("list"), "rank", F.lit(float(weight)).alias("weight")) for name, (df, weight) in lists.items()]
    together = parts[0]
    for part in parts[1:]:
        together = together.unionByName(part)
    return together.groupBy(*query, document).agg(
        F.sum(F.col("weight") / (constant + F.col("rank"))).alias("score"),
        *[F.min(F.when(F.col("list") == name, F.col("rank"))).alias(f"{name}_rank") for name in lists],
    )


def fused_order(lists: Sequence[str]) -> list:
    return [F.col(f"{name}_rank").asc_nulls_last() for name in lists]


def diversified(ranked: DataFrame, query: Sequence[str], file: str, per_file: int, most: int) -> DataFrame:
    """Of rows with a ``rank`` per query the first ``per_file`` of each file, then the first ``most``; ranks are renewed."""
    by_file = Window.partitionBy(*query, file).orderBy("rank")
    kept = ranked.withColumn("__nth", F.row_number().over(by_file)).where(F.col("__nth") <= per_file).drop("__nth")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(*query).orderBy("rank"))).where(F.col("rank") <= most)
