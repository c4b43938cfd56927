"""Hybrid retrieval of chunks for a set of questions, each within its repository, as one lazy plan."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators import fusion, tokens, vectors
from quarry.operators.relevance import analyzed, assessed, chunk_features
from quarry.plans.lineage import cut_lineage, written
from quarry.session import spread

QUERY = ["repo_id", "question"]
PLACE = ["file_path", "start_line", "id"]
#: Candidates of each leg: a multiple of the wanted rows, at least so many.
MULTIPLIER, LEAST = 6, 60
#: Chunks of a shard and questions of a block: their product bounds what one task scores at once.
SHARD, BLOCK = 4096, 1024


def pool(top_k: int) -> int:
    return max(top_k, top_k * MULTIPLIER, LEAST)


def matching(chunks: DataFrame, filters: dict[str, str]) -> DataFrame:
    """The chunks whose metadata equal every value of ``filters``; a null value equals none. An unknown name is an error."""
    if unknown := set(filters) - set(chunks.columns):
        raise ValueError(f"chunks have no {sorted(unknown)}")
    for name, value in filters.items():
        chunks = chunks.where(F.col(f"`{name}`") == F.lit(value))
    return chunks


def documents(chunks: DataFrame, *more: str) -> DataFrame:
    """One row per chunk id with repository and text, and columns ``more``; repeated and late rows of an id count once."""
    kept = chunks.select("id", "repo_id", "file_path", "start_line", "end_line", "symbol_name", "symbol_type", "chunk_text", *more)
    return kept.where(F.col("id").isNotNull() & F.col("chunk_text").isNotNull()).dropDuplicates(["id"])


def profiled(rows: DataFrame) -> DataFrame:
    """What the legs need of each chunk, without its text: ``repo_id, shard, seq, PLACE, dl, token, tf, ix, v``.

    ``rows`` has the columns of ``documents``; repeated ids count once, rows of null id, text or repository not at
    all. Texts are taken apart where they are read and never move. A repository is spread over shards of about
    ``SHARD`` chunks; ``seq`` numbers the chunks of a shard in the order that breaks ties. Written once, as it is read several times, each time a few columns.
    """
    usable = rows.where(F.col("id").isNotNull() & F.col("chunk_text").isNotNull() & F.col("repo_id").isNotNull())
    sizes = usable.groupBy("repo_id").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / F.lit(SHARD))).alias("shards"))
    apart = spread(usable.select("repo_id", *PLACE, "symbol_name", "symbol_type", "chunk_text")).select(
        "repo_id", *PLACE, tokens.terms(tokens.FIELD_WEIGHTS).alias("terms"), vectors.embedding(F.col("chunk_text")).alias("vector")
    )
    placed = apart.join(sizes, "repo_id").withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards"))).repartition("repo_id", "shard").dropDuplicates(["repo_id", "shard", "id"])
    numbered = placed.withColumn("seq", F.row_number().over(Window.partitionBy("repo_id", "shard").orderBy(*PLACE)) - 1)
    length = F.aggregate("terms.tf", F.lit(0).cast("long"), lambda sum_, n: sum_ + n)
    return written(
        numbered.select("repo_id", "shard", "shards", "seq", *PLACE, length.alias("dl"), "terms.token", "terms.tf", F.col("vector.ix").alias("ix"), F.col("vector.v").alias("v"))
    )


def _asked(questions: DataFrame, profiles: DataFrame) -> DataFrame:
    """``questions`` with ``q``, a 128-bit hash of the text, ``block``, about ``BLOCK`` of a repository's questions, and the ``blocks`` and ``shards`` of it."""
    named = questions.select(*QUERY, F.md5("question").alias("q"))
    blocks = named.groupBy("repo_id").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).alias("blocks"))
    shards = profiles.groupBy("repo_id").agg(F.max("shards").alias("shards"))
    return named.join(blocks, "repo_id").join(shards, "repo_id").withColumn("block", F.pmod(F.xxhash64("q"), F.col("blocks")))


def _best_of_blocks(left: DataFrame, right: DataFrame, profiles: DataFrame, questions: DataFrame, most: int, score) -> DataFrame:
    """The ranked best chunks per question: ``score`` meets each shard of a repository with each block of its questions, the best of which meet in a window."""

    def best(documents: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = score(documents, asked, most)
        given = documents if len(documents) else asked
        return found.assign(repo_id=given["repo_id"].iloc[0], shard=given["shard"].iloc[0])[["repo_id", "shard", "q", "seq", "score"]]

    group = ["repo_id", "shard", "block"]
    spread_right = right.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
    left = left.select(*[F.col(c).alias(c) for c in left.columns])  # names of its own: both sides come from the questions
    found = left.groupBy(*group).cogroup(spread_right.groupBy(*group)).applyInPandas(best, "repo_id string, shard long, q string, seq int, score double")
    placed = found.join(profiles.select("repo_id", "shard", "seq", *PLACE), ["repo_id", "shard", "seq"]).join(questions.select(*QUERY, F.md5("question").alias("q")), ["repo_id", "q"])
    return tokens.ranked(placed, QUERY, PLACE, most).select(*QUERY, "id", "score", "rank")


def bm25_leg(docs: DataFrame, questions: DataFrame, most: int, variant: str = "simple", profiles: DataFrame | None = None) -> DataFrame:
    """``repo_id, question, id, score, rank`` of the best chunks by field-weighted BM25, of positive score.

    Only postings of tokens that a block of questions names leave the shards' profiles.
    """
    profiles = profiled(docs) if profiles is None else profiles
    asked = _asked(questions, profiles)
    wanted = written(tokens.token_counts(asked, ["repo_id", "q", "block", "shards"], {"question": 1}))
    stats = profiles.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_docs"), F.greatest(F.avg("dl"), F.lit(1.0)).alias("avgdl"))
    postings = profiles.select("repo_id", "shard", "seq", "dl", F.inline(F.arrays_zip("token", "tf")))
    frequencies = postings.join(wanted.select("repo_id", "token").distinct(), ["repo_id", "token"], "left_semi").groupBy("repo_id", "token").agg(F.count(F.lit(1)).alias("df"))
    every = tokens.document_frequency(postings, "repo_id") if variant == "okapi" else None
    weights = tokens.weighted(frequencies, stats, "repo_id", variant, every)
    left = postings.join(wanted.select("repo_id", "block", "token").distinct(), ["repo_id", "token"]).join(stats, "repo_id")
    left = left.select("repo_id", "shard", "block", "seq", "token", tokens.saturated(F.col("tf"), F.col("dl"), F.col("avgdl")).alias("part"))
    right = wanted.join(weights, ["repo_id", "token"]).select("repo_id", "block", "shards", "q", "token", (F.col("tf") * F.col("idf")).alias("weight"))
    return _best_of_blocks(left, right, profiles, asked, most, tokens.summed_scores)


def vector_leg(docs: DataFrame, questions: DataFrame, most: int, profiles: DataFrame | None = None) -> DataFrame:
    """``repo_id, question, id, score, rank`` of the best chunks by cosine of hashing embeddings.

    All chunks of the repository are ranked: those that share no bucket with the question, or have no tokens, have
    score 0 and stand before negative ones.
    """
    profiles = profiled(docs) if profiles is None else profiles
    asked = written(_asked(questions, profiles).withColumn("vector", vectors.embedding(F.col("question"))))
    blocks = asked.select("repo_id", "block").distinct()
    left = profiles.select("repo_id", "shard", "seq", "ix", "v").join(blocks, "repo_id")
    right = asked.select("repo_id", "block", "shards", "q", F.col("vector.ix").alias("ix"), F.col("vector.v").alias("v"))
    return _best_of_blocks(left, right, profiles, asked, most, vectors.cosines)


def retrieve(chunks: DataFrame, questions: DataFrame, mode: str = "hybrid", top_k: int = 5, rerank: bool = True, per_file: int = 2, variant: str = "simple") -> DataFrame:
    """``repo_id, question, rank, score, source`` and the chunk, at most ``top_k`` per question.

    ``mode`` is vector, bm25 or hybrid. Questions of null text or repository, and those whose repository has no
    chunks, have no rows. Repeated questions count once.
    """
    if mode not in ("vector", "bm25", "hybrid"):
        raise ValueError(f"unknown mode {mode!r}")
    profiles = profiled(chunks)
    asked = written(questions.select(*QUERY).where(F.col("repo_id").isNotNull() & F.col("question").isNotNull()).distinct())
    most = pool(top_k)
    legs = {}
    if mode in ("vector", "hybrid"):
        legs["vector"] = (vector_leg(chunks, asked, most, profiles), fusion.HASHING_WEIGHT)
    if mode in ("bm25", "hybrid"):
        legs["bm25"] = (bm25_leg(chunks, asked, most, variant, profiles), 1.0)
    if mode == "hybrid":
        order = Window.partitionBy(*QUERY).orderBy(F.round("score", 9).desc(), *fusion.fused_order(list(legs)))
        found = fusion.fuse(legs, QUERY, "id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    else:
        found = legs[mode][0]
    found = cut_lineage(found.select(*QUERY, "id", "score", "rank"))
    source = f"{mode}+heuristic" if rerank else mode
    if rerank:
        # questions are analyzed once each, before they meet chunks; a chunk's tokens are those of its profile; only scores leave the pairs
        pooled = chunk_features(_texts_of(chunks, found).join(profiles.select("id", F.col("token").alias("said_tokens")), "id"))
        scored = assessed(found.join(pooled, "id").join(written(analyzed(asked)), QUERY)).select(*QUERY, "id", "file_path", "rank", F.col("assessment").alias("score"))
        again = Window.partitionBy(*QUERY).orderBy(F.col("score").desc(), "rank")
        found = scored.withColumn("rank", F.row_number().over(again))
    else:
        found = found.join(profiles.select("id", "file_path"), "id")
    best = cut_lineage(fusion.diversified(found, QUERY, "file_path", per_file, top_k).drop("file_path"))
    return best.join(_texts_of(chunks, best), "id").withColumn("source", F.lit(source))


def _texts_of(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """The documents of ``found`` without their repository: the semi join comes before the rows of an id are made one."""
    return documents(chunks.join(found.select("id").distinct(), "id", "left_semi")).drop("repo_id")
