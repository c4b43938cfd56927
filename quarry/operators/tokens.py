"""Token frequencies and lexical ranking."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import RAW_TOKEN

#: Constants of BM25, and how often the tokens of each field count.
K1, B = 1.5, 0.75
FIELD_WEIGHTS = {"file_path": 3, "symbol_name": 5, "symbol_type": 2, "chunk_text": 1}


_RAW = re.compile(RAW_TOKEN)


@lru_cache(1 << 17)
def _apart(raw: str) -> tuple[str, tuple[str, ...]]:
    """A raw token in lower case and, where it has parts other than itself, these."""
    low = raw.lower()
    parts = tuple(dict.fromkeys(p for p in re.split("[./_-]+", re.sub("(?<=[a-z0-9])(?=[A-Z])", ".", raw).lower()) if p))
    return low, () if parts == (low,) else parts


def _count(text: str, weight: int, into: dict[str, int]) -> None:
    seen: dict[str, int] = {}
    for raw, n in Counter(_RAW.findall(text)).items():  # in the order of their first places
        low, parts = _apart(raw)
        seen[low] = seen.get(low, 0) + n
        for part in parts:
            seen.setdefault(part, 1)
    for token, n in seen.items():
        into[token] = into.get(token, 0) + weight * n


def terms(fields: dict[str, int]) -> Column:
    """The arrays ``token`` and ``tf`` of a row: how often its tokens occur, summed over ``fields`` by weight.

    A raw token counts every time. A part of identifiers counts once per field, unless the same token came
    first as a raw one. Null fields hold no token. Counted in Arrow batches: the same in array functions or in
    aggregations of single tokens takes seven times the CPU. Not marked as deterministic, so that the optimizer
    doesn't count once more for a test of emptiness.
    """
    weights = list(fields.values())

    @F.pandas_udf("token array<string>, tf array<bigint>")
    def count(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for columns in batches:
            out: list[dict[str, int]] = []
            for texts in zip(*(columns if isinstance(columns, tuple) else (columns,))):
                found: dict[str, int] = {}
                for text, weight in zip(texts, weights):
                    if text:
                        _count(text, weight, found)
                out.append(found)
            yield pd.DataFrame({"token": [list(f) for f in out], "tf": [list(f.values()) for f in out]})

    return count.asNondeterministic()(*fields)


def token_counts(df: DataFrame, keys: Sequence[str], fields: dict[str, int]) -> DataFrame:
    """``keys..., token, tf``: the ``terms`` of each row, which ``keys`` identify. Rows without a token have no counts."""
    counted = df.select(*keys, terms(fields).alias("__terms"))
    return counted.select(*keys, F.inline(F.arrays_zip("__terms.token", "__terms.tf")))


def lengths(counts: DataFrame, corpus: str, document: str) -> DataFrame:
    """``corpus, document, dl``."""
    return counts.groupBy(corpus, document).agg(F.sum("tf").alias("dl"))


def corpus_stats(documents: DataFrame, counts: DataFrame, corpus: str, document: str) -> DataFrame:
    """``corpus, n_docs, avgdl`` over all ``documents``, those without tokens included; avgdl is at least 1."""
    sized = documents.select(corpus, document).join(lengths(counts, corpus, document), [corpus, document], "left")
    return sized.groupBy(corpus).agg(F.count(F.lit(1)).alias("n_docs"), F.greatest(F.avg(F.coalesce("dl", F.lit(0))), F.lit(1.0)).alias("avgdl"))


def document_frequency(counts: DataFrame, corpus: str) -> DataFrame:
    return counts.groupBy(corpus, "token").agg(F.count(F.lit(1)).alias("df"))


def _idf(variant: str) -> Column:
    n, df = F.col("n_docs"), F.col("df")
    if variant == "simple":
        return F.ln(1 + (n - df + 0.5) / (df + 0.5))
    if variant == "okapi":
        return F.ln(n - df + 0.5) - F.ln(df + 0.5)
    raise ValueError(f"unknown variant {variant!r}")


def weighted(frequencies: DataFrame, stats: DataFrame, corpus: str, variant: str = "simple", all_frequencies: DataFrame | None = None) -> DataFrame:
    """``corpus, token, idf`` from document frequencies ``corpus, token, df`` of some tokens.

    ``simple`` has positive weights only; ``okapi`` replaces negative ones by a quarter of the mean weight of all
    tokens of the corpus, for which it needs ``all_frequencies``.
    """
    weights = frequencies.join(stats, corpus).withColumn("idf", _idf(variant))
    if variant == "okapi":
        floor = all_frequencies.join(stats, corpus).withColumn("idf", _idf(variant)).groupBy(corpus).agg((0.25 * F.avg("idf")).alias("floor"))
        weights = weights.join(floor, corpus).withColumn("idf", F.when(F.col("idf") < 0, F.col("floor")).otherwise(F.col("idf")))
    return weights.select(corpus, "token", "idf")


def saturated(tf: Column, dl: Column, avgdl: Column) -> Column:
    """What a token's occurrences in a document of length ``dl`` are worth, before its weight."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.greatest(dl, F.lit(1)) / avgdl))


def summed_scores(postings: pd.DataFrame, queries: pd.DataFrame, most: int) -> pd.DataFrame:
    """``q, seq, score``: the ``most`` best documents of each query, of positive score; ties go to the smaller ``seq``.

    ``postings`` has ``seq, token, part``, ``queries`` has ``q, token, weight``, both of one block. Scores are summed
    token by token into one row of numbers per query, so that pairs of query and document are never spelt out.
    """
    out: list[tuple[np.ndarray, str, np.ndarray]] = []
    codes, names = pd.factorize(postings["token"], sort=False)
    order = np.argsort(codes, kind="stable")
    ends = np.cumsum(np.bincount(codes, minlength=len(names)))
    seqs, parts = postings["seq"].to_numpy()[order], postings["part"].to_numpy("float64")[order]
    known = {name: i for i, name in enumerate(names)}
    width = int(seqs.max()) + 1 if len(seqs) else 0
    for q, asked in queries.groupby("q", sort=False):
        scores = np.zeros(width)
        for token, weight in zip(asked["token"], asked["weight"]):
            if (i := known.get(token)) is not None:
                at = slice(ends[i - 1] if i else 0, ends[i])
                scores[seqs[at]] += weight * parts[at]  # a document holds a token once
        found = best_places(scores, most)
        found = found[scores[found] > 0]
        out.append((found, q, scores[found]))
    if not out:
        return pd.DataFrame({"q": [], "seq": [], "score": []})
    return pd.DataFrame({"q": np.repeat([q for _, q, _ in out], [len(f) for f, _, _ in out]), "seq": np.concatenate([f for f, _, _ in out]), "score": np.concatenate([s for _, _, s in out])})


def best_places(scores: np.ndarray, most: int, digits: int = 9) -> np.ndarray:
    """Places of the ``most`` greatest scores, rounded; of equal ones the first."""
    down = -np.round(scores, digits)
    if len(down) > most:
        places = np.flatnonzero(down <= np.partition(down, most - 1)[most - 1])
        return places[np.argsort(down[places], kind="stable")][:most]
    return np.argsort(down, kind="stable")


def ranked(scored: DataFrame, query: Sequence[str], ties: Sequence[str], most: int, digits: int = 9) -> DataFrame:
    """The ``most`` best rows per query with their ``rank`` from 1; equal scores, to ``digits``, by ``ties``."""
    order = Window.partitionBy(*query).orderBy(F.round("score", digits).desc(), *ties)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
