"""Models and services behind factories: scoring of pairs, answers to prompts, and the reading of their payloads."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.answers import UNKNOWN, prompt_blocks


def rescored(pairs: DataFrame, query: Sequence[str], question: str, text: str, make_scorer, most: int) -> DataFrame:
    """``pairs`` with ``score`` by a pair scorer, made once per task, and the ``most`` best ranks per query.

    ``make_scorer()`` returns a function from a list of (question, text) to a list of numbers. Nulls count as empty.
    """

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        scorer = make_scorer()
        for questions, texts in batches:
            yield pd.Series([float(x) for x in scorer(list(zip(questions.fillna(""), texts.fillna(""))))], dtype="float64")

    scored = pairs.withColumn("score", score(F.col(question), F.col(text))).withColumnRenamed("rank", "__before")
    order = Window.partitionBy(*query).orderBy(F.col("score").desc(), "__before")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).drop("__before")


def generated(prompts: DataFrame, prompt: str, make_client) -> DataFrame:
    """``prompts`` with ``payload``, the response text of a client made once per task: a function of one prompt."""

    @F.pandas_udf("string")
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        client = make_client()
        for texts in batches:
            yield pd.Series([client(t) if t is not None else None for t in texts], dtype=object)

    return prompts.withColumn("payload", call(F.col(prompt)))


def payload_text(payload: Column) -> Column:
    """The parts of the first candidate of a response, joined by line feeds; empty where there are none."""
    shape = "struct<candidates:array<struct<content:struct<parts:array<struct<text:string>>>>>>"
    parts = F.get(F.from_json(payload, shape)["candidates"], F.lit(0))["content"]["parts"]
    return F.coalesce(F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "\n"), F.lit(""))


def embedding_values(item: Column) -> Column:
    """The vector of one item of an embedding response, in any of its three shapes; an error at run time if there is none."""
    inner = "struct<values:array<float>>"
    read = F.from_json(item, f"struct<values:array<float>,embedding:{inner},embeddings:{inner}>")
    return F.coalesce(read["values"], read["embedding"]["values"], read["embeddings"]["values"], F.raise_error(F.lit("an embedding response has no vector")).cast("array<float>"))


def answered_by_model(retrieved: DataFrame, query: Sequence[str], make_client) -> DataFrame:
    """``query..., answer, citations, usage`` from a model's responses to the prompt blocks of each question.

    ``retrieved`` has the chunk and its ``rank``; citations are the labelled blocks that the response names and the
    prompt holds. One row per question with retrieved chunks.
    """
    place = F.struct("file_path", "start_line", "end_line")
    lookup = F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("C"), F.col("rank").cast("string")), place)))
    prompts = prompt_blocks(retrieved, query).join(retrieved.groupBy(*query).agg(lookup.alias("lookup")), list(query))
    question = F.concat(F.lit("Question: "), F.col("question"), F.lit("\n\nContext:\n"), F.col("blocks")) if "question" in query else F.col("blocks")
    said = generated(prompts.withColumn("prompt", question), "prompt", make_client)
    parsed = said.withColumn("__said", structured_answer(payload_text(F.col("payload"))))
    return parsed.select(
        *query, F.col("__said.answer").alias("answer"), known_citations(F.col("__said.citations"), F.col("lookup")).alias("citations"), payload_usage(F.col("payload")).alias("usage")
    )


def payload_usage(payload: Column) -> Column:
    """Token counts of a response, in camel or snake case; zeros count as missing."""
    names = {"input_tokens": ("promptTokenCount", "prompt_token_count"), "output_tokens": ("candidatesTokenCount", "candidates_token_count"), "total_tokens": ("totalTokenCount", "total_token_count")}
    inner = ",".join(f"{n}:bigint" for pair in names.values() for n in pair)
    read = F.from_json(payload, f"struct<usageMetadata:struct<{inner}>,usage_metadata:struct<{inner}>>")
    return F.struct(
        *[F.coalesce(*[F.nullif(read[outer][n], F.lit(0)) for outer in ("usageMetadata", "usage_metadata") for n in pair]).alias(name) for name, pair in names.items()]
    )


def structured_answer(text: Column) -> Column:
    """``answer`` and ``citations`` from JSON text, bare or in a fenced block; else the fixed unknown sentence and none."""
    shape = "struct<answer:string,citations:array<string>>"
    bare = F.from_json(text, shape)
    fenced = F.from_json(F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), shape)
    found = F.when(bare["answer"].isNotNull(), bare).when(fenced["answer"].isNotNull(), fenced)
    none = F.array().cast("array<string>")
    return F.struct(F.coalesce(found["answer"], F.lit(UNKNOWN)).alias("answer"), F.coalesce(found["citations"], none).alias("citations"))


def known_citations(labels: Column, lookup: Column) -> Column:
    """Citations of the labels that a map of the prompt's labels holds, in their order."""
    return F.transform(F.filter(labels, lambda x: F.map_contains_key(lookup, x)), lambda x: F.element_at(lookup, x))
