"""Problem 7: sources mixed to target shares of the total size.

Poisson replication: each text occurs N times, N drawn from a Poisson distribution by inverting it at a number
that a hash of the seed and the document gives, cut off at the source's maximum. As that number is fixed, the
tokens a source really gives are a step function of its Poisson mean that only rises. It is known from the tokens
per value of the number, of which there are ``LEVELS``, so the mean is solved for the target itself, not for an
expectation. Where one text is too large a step, other turns of the numbers are tried.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values of the hashed number, and turns of it that are tried for a source.
LEVELS = 1 << 16
TURNS = 64


def chances(rate: float, most: int) -> np.ndarray:
    """The chances that a Poisson number of mean ``rate`` is at most 0, 1, ... ``most - 1``."""
    if most <= 0:
        return np.zeros(0)
    if rate <= 0:
        return np.ones(most)
    k = np.arange(most, dtype="float64")
    factorials = np.concatenate([[0.0], np.cumsum(np.log(k[1:]))])
    return np.minimum(1.0, np.cumsum(np.exp(k * math.log(rate) - rate - factorials)))


def solved(levels: np.ndarray, tokens: np.ndarray, wanted: float, most: int, turns: int = TURNS) -> tuple[int, list[float]]:
    """Turn and chances that give as nearly ``wanted`` tokens as can be, from the ``tokens`` at each of ``levels``.

    ``wanted`` of 0 or less gives no occurrence, of ``most`` times all tokens or more always ``most``.
    """
    if most <= 0 or wanted <= 0 or not len(levels):
        return 0, [1.0] * max(most, 0)
    if wanted >= most * tokens.sum():
        return 0, [0.0] * most
    best: tuple[float, int, list[float]] | None = None
    for turn in range(turns):
        order = np.argsort(turned := (levels + turn * (LEVELS // turns)) % LEVELS)
        numbers, above = (turned[order] + 0.5) / LEVELS, np.concatenate([np.cumsum(tokens[order][::-1])[::-1], [0]])

        def given(rate: float) -> float:
            return float(above[np.searchsorted(numbers, chances(rate, most), side="right")].sum())

        low, high = 0.0, 1.0
        while given(high) < wanted:
            low, high = high, high * 2
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (middle, high) if given(middle) < wanted else (low, middle)
        for rate in (low, high):
            off = abs(given(rate) - wanted)
            if best is None or off < best[0]:
                best = (off, turn, chances(rate, most).tolist())
        if best[0] <= wanted * 1e-3:
            break
    return best[1], best[2]


def unique_texts(docs: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Of ``doc_id, source, text, n_tokens`` the row of smallest ``doc_id`` per text, without the text.

    A text under several ids counts once, in the source of its smallest id, so that no text can exceed its
    maximum through another id. With ``targets`` only rows of sources with a positive share count, so that a copy
    elsewhere takes no text from the mixture. Null and empty texts and texts of 0 tokens don't come out. Equal texts meet as
    a 128-bit hash and a length; the aggregation combines before the shuffle.
    """
    if targets is not None:
        docs = docs.join(targets.groupBy("source").agg(F.sum("target_share").alias("__share")).where(F.col("__share") > 0), "source", "left_semi")
    return (
        docs.where(F.col("n_tokens") > 0)
        .groupBy(F.md5(F.col("text")).alias("__hash"), F.char_length("text").alias("__length"))
        .agg(F.min(F.struct("doc_id", "source", "n_tokens")).alias("__first"))
        .select("__first.*")
    )


def level(seed: int, document: str = "doc_id") -> Column:
    """The hashed number of a document, in ``LEVELS``."""
    return F.xxhash64(F.lit(seed), document).bitwiseAND(F.lit(LEVELS - 1))


def plan(docs: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 42) -> DataFrame:
    """``source, target_share, max_repeats, available, wanted, turn, steps`` per source with a target.

    ``total`` tokens are wanted in all; by default as many as the source that runs out first allows, so that
    every share can be met. Targets of null source or share, or without any text, count as 0 available. The mean
    of a source is solved over its tokens per level: at most ``LEVELS`` rows, however many texts it has.
    """
    per_level = docs.groupBy("source", level(seed).alias("level")).agg(F.sum("n_tokens").alias("tokens"))
    have = per_level.groupBy("source").agg(F.sum("tokens").alias("available"))
    goal = (
        targets.where(F.col("source").isNotNull())
        .groupBy("source")
        .agg(F.sum(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
        .join(have, "source", "left")
        .withColumn("available", F.coalesce("available", F.lit(0)))
    )
    if total is None:
        reachable = F.when((F.col("target_share") > 0) & (F.col("available") > 0), F.col("available") * F.col("max_repeats") / F.col("target_share"))
        goal = goal.withColumn("__total", goal.agg(F.coalesce(F.min(reachable), F.lit(0.0))).scalar())
    else:
        goal = goal.withColumn("__total", F.lit(float(total)))
    goal = goal.withColumn("wanted", F.col("target_share") * F.col("__total")).drop("__total")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        first, known = pdf.iloc[0], pdf[pdf["level"].notna()]
        turn, steps = solved(known["level"].to_numpy("int64"), known["tokens"].to_numpy("float64"), float(first["wanted"]), int(first["max_repeats"]))
        return pd.DataFrame([[*first[names], turn, steps]], columns=[*names, "turn", "steps"])

    names = ["source", "target_share", "max_repeats", "available", "wanted"]
    return goal.join(per_level, "source", "left").groupBy("source").applyInPandas(
        solve, "source string, target_share double, max_repeats int, available bigint, wanted double, turn int, steps array<double>"
    )


def mix(docs: DataFrame, planned: DataFrame, seed: int = 42) -> DataFrame:
    """``doc_id, copy_no, source, n_tokens, position_key`` of every occurrence in the mixture.

    ``seed`` is that of the plan. Sorting by ``position_key``, a hash of seed, document and copy number, shuffles the
    mixture globally; its range partitions can't be skewed by a hot source. Documents of sources without a target
    don't occur.
    """
    turned = F.pmod(level(seed) + F.col("turn") * F.lit(LEVELS // TURNS), F.lit(LEVELS))
    return (
        docs.join(planned.select("source", "turn", "steps"), "source")
        .withColumn("__number", (turned + 0.5) / LEVELS)
        .withColumn("__times", F.size(F.filter("steps", lambda s: s < F.col("__number"))))
        .where(F.col("__times") > 0)
        .select("doc_id", F.explode(F.sequence(F.lit(1), F.col("__times"))).alias("copy_no"), "source", "n_tokens")
        .withColumn("position_key", F.xxhash64(F.lit(seed + 1), "doc_id", "copy_no"))
    )


def shuffled(mixed: DataFrame, docs: DataFrame) -> DataFrame:
    """The records of the mixture with their text, globally ordered by ``position_key``."""
    return mixed.join(docs.select("doc_id", "text"), "doc_id").orderBy("position_key", "doc_id", "copy_no")


def shares(mixed: DataFrame, planned: DataFrame) -> DataFrame:
    """What the mixture holds of each targeted source, beside what was asked: one row per source."""
    held = mixed.groupBy("source").agg(
        F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"), F.countDistinct("doc_id").alias("texts"), F.max("copy_no").alias("most_repeats")
    )
    zero = F.lit(0)
    rows = planned.select("source", "target_share", "max_repeats").join(held, "source", "left").select(
        "source", "target_share", "max_repeats", *[F.coalesce(c, zero).alias(c) for c in ("tokens", "rows", "texts", "most_repeats")]
    )
    whole = rows.agg(F.sum("tokens")).scalar()
    return rows.withColumn("actual_share", F.coalesce(F.round(F.try_divide(F.col("tokens").cast("double"), whole), 6), F.lit(0.0)))
