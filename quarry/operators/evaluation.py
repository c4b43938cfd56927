"""Metrics of retrieval and answers, and exact nearest-rank percentiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.answers import UNKNOWN


def _list(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<string>"))


def hit_at(k: int, retrieved: str = "retrieved_files", expected: str = "expected_files") -> Column:
    """Whether one of the first ``k`` retrieved files is expected. Null lists are empty."""
    return F.size(F.array_intersect(F.slice(_list(retrieved), 1, k), _list(expected))) > 0


def reciprocal_rank(retrieved: str = "retrieved_files", expected: str = "expected_files") -> Column:
    """1 / position of the first expected file, else 0."""
    places = F.filter(F.transform(_list(retrieved), lambda x, i: F.when(F.array_contains(_list(expected), x), i + 1)), lambda x: x.isNotNull())
    return F.coalesce(1 / F.array_min(places), F.lit(0.0))


def groundedness(answer: str = "answer", citations: str = "citations", retrieved: str = "retrieved_files") -> Column:
    """1 for the unknown sentence, 0 without citations, else the share of citations whose file was retrieved."""
    cited = F.coalesce(F.transform(citations, lambda c: c["file_path"]), F.array().cast("array<string>"))
    good = F.size(F.filter(cited, lambda f: F.array_contains(_list(retrieved), f)))
    return F.when(F.col(answer) == UNKNOWN, 1.0).when(F.size(cited) == 0, 0.0).otherwise(good / F.size(cited))


def answer_match(answer: str, expected: str) -> Column:
    """Share of expected terms that the answer contains in any case; 1 when nothing is expected."""
    text, terms = F.lower(F.coalesce(F.col(answer), F.lit(""))), _list(expected)
    return F.when(F.size(terms) == 0, 1.0).otherwise(F.size(F.filter(terms, lambda t: F.contains(text, F.lower(t)))) / F.size(terms))


def flags(answer: str = "answer", citations: str = "citations", retrieved: str = "retrieved_files", forbidden: str | None = None) -> Column:
    """Signs of unsupported answers: forbidden terms, missing citations, and each citation that wasn't retrieved."""
    text = F.lower(F.coalesce(F.col(answer), F.lit("")))
    cited = F.coalesce(F.transform(citations, lambda c: c["file_path"]), F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    said = F.transform(F.filter(_list(forbidden), lambda t: F.contains(text, F.lower(t))), lambda t: F.concat(F.lit("must_not_contain:"), t)) if forbidden else none
    missing = F.when((F.size(cited) == 0) & (F.coalesce(F.col(answer), F.lit("")) != UNKNOWN), F.array(F.lit("missing_citations"))).otherwise(none)
    wrong = F.transform(F.filter(cited, lambda f: ~F.array_contains(_list(retrieved), f)), lambda f: F.concat(F.lit("citation_not_retrieved:"), f))
    return F.concat(said, missing, wrong)


def _failed() -> Column:
    expects, flagged = F.size(_list("expected_files")) > 0, F.size(_list("hallucination_flags")) > 0
    return (expects & ~F.coalesce("retrieval_hit_at_5", F.lit(False))) | flagged | (
        (F.coalesce("answer_contains_score", F.lit(0.0)) == 0) & (F.trim(F.coalesce("answer", F.lit(""))) != "")
    )


def failures(items: DataFrame) -> DataFrame:
    """The failed rows of ``items``: see ``summary``."""
    return items.where(_failed())


def summary(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per run with the aggregate metrics of its items.

    Recall and reciprocal rank average over items with expected files only, 0 if there are none; null costs,
    latencies and scores count as 0. An item failed if its expected file is missing among five, if it has flags,
    or if its answer, not blank, matches nothing. Means have six digits; halves of the last one go up on any engine.
    """
    expects, flagged, failed = F.size(_list("expected_files")) > 0, F.size(_list("hallucination_flags")) > 0, _failed()

    def mean(c: Column, where: Column | None = None) -> Column:
        return F.round(F.coalesce(F.avg(F.when(where, c) if where is not None else c), F.lit(0.0)) + 1e-10, 6)

    def zero(name: str) -> Column:
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0))

    return items.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_queries"),
        mean(F.coalesce("retrieval_hit_at_3", F.lit(False)).cast("double"), expects).alias("recall_at_3"),
        mean(F.coalesce("retrieval_hit_at_5", F.lit(False)).cast("double"), expects).alias("recall_at_5"),
        mean(zero("reciprocal_rank"), expects).alias("mrr"),
        mean(zero("answer_contains_score")).alias("answer_match"),
        mean(zero("groundedness_score")).alias("groundedness"),
        F.sum(F.size(_list("hallucination_flags"))).cast("long").alias("flags"),
        mean(flagged.cast("double")).alias("hallucination_rate"),
        mean(zero("latency_ms")).alias("average_latency_ms"),
        mean(zero("estimated_cost_usd")).alias("average_cost"),
        mean(failed.cast("double")).alias("failure_rate"),
    )


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, percents: Sequence[int]) -> DataFrame:
    """``keys..., n`` and a column ``p<percent>`` each: the exact value at index round(percent / 100 * (n - 1)), half to even.

    Equal values are counted first, with map-side combining, so that a hot key is never collected; the window
    runs over its distinct values. Null values are left out.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    group = Window.partitionBy(*keys)
    upto = F.sum("c").over(group.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.select(*keys, value, upto.alias("__upto"), F.sum("c").over(group).alias("__n"))

    def at(p: int) -> Column:
        index = F.bround(F.lit(p / 100.0) * (F.col("__n") - 1)).cast("long")
        return F.min(F.when(F.col("__upto") > index, F.col(value))).alias(f"p{p}")

    return placed.groupBy(*keys).agg(F.max("__n").alias("n"), *[at(p) for p in percents])
