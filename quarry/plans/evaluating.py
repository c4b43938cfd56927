"""Evaluation: questions retrieved, answered and measured against what was expected of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import answers, evaluation
from quarry.operators.relevance import analyzed
from quarry.plans.retrieval import QUERY, retrieve


def evaluated(chunks: DataFrame, samples: DataFrame, keys: Sequence[str], mode: str = "hybrid", top_k: int = 5) -> DataFrame:
    """One result per row of ``samples``: its keys, the retrieved files, answer, citations, scores and flags.

    ``samples`` has ``keys, repo_id, question, expected_files, expected_answer_contains, must_not_contain``. Each
    question is retrieved and answered once, however many samples ask it. One that nothing is retrieved for has the
    fixed unknown sentence as its answer. Latency and cost of single questions don't exist in a batch: they are null.
    """
    found = retrieve(chunks, samples.select(*QUERY), mode, top_k)
    files = found.groupBy(*QUERY).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "file_path"))), lambda x: x["file_path"]).alias("retrieved_files"))
    said = answers.answered(analyzed(found), QUERY)
    none, uncited = F.array().cast("array<string>"), F.array().cast("array<struct<file_path:string,start_line:int,end_line:int>>")
    asked = samples.select(*keys, *QUERY, "expected_files", "expected_answer_contains", "must_not_contain")
    told = asked.join(files.join(said, QUERY), QUERY, "left").withColumns(
        {"retrieved_files": F.coalesce("retrieved_files", none), "answer": F.coalesce("answer", F.lit(answers.UNKNOWN)), "citations": F.coalesce("citations", uncited)}
    )
    return told.select(
        *keys, *QUERY, "expected_files", "retrieved_files",
        evaluation.hit_at(3).alias("retrieval_hit_at_3"), evaluation.hit_at(5).alias("retrieval_hit_at_5"), evaluation.reciprocal_rank().alias("reciprocal_rank"),
        evaluation.answer_match("answer", "expected_answer_contains").alias("answer_contains_score"), evaluation.groundedness().alias("groundedness_score"),
        evaluation.flags(forbidden="must_not_contain").alias("hallucination_flags"),
        F.lit(None).cast("bigint").alias("latency_ms"), F.lit(None).cast("double").alias("estimated_cost_usd"), "answer", "citations",
    )


def summarized(results: DataFrame, run: Sequence[str], item: str) -> DataFrame:
    """``evaluation.summary`` of each run with ``failed_items``, the sorted numbers of its failed results."""
    failed = evaluation.failures(results).groupBy(*run).agg(F.array_sort(F.collect_list(item)).alias("failed_items"))
    numbers = F.coalesce("failed_items", F.array().cast(f"array<{results.schema[item].dataType.simpleString()}>"))
    return evaluation.summary(results, run).join(failed, list(run), "left").withColumn("failed_items", numbers)
