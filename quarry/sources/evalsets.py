"""Evaluation sets from JSON and CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LISTS = ("expected_files", "expected_answer_contains", "must_not_contain")


def read_eval_set(spark: SparkSession, path: str) -> DataFrame:
    """``question`` and three lists, from an array of JSON objects or a CSV whose lists are joined by a pipe.

    Missing lists are empty; another ending of the path is an error.
    """
    none = F.array().cast("array<string>")
    if path.endswith(".json"):
        schema = "question string, " + ", ".join(f"{c} array<string>" for c in LISTS)
        rows = spark.read.schema(schema).option("multiLine", True).json(path)
        return rows.select("question", *[F.coalesce(F.col(c), none).alias(c) for c in LISTS])
    if path.endswith(".csv"):
        rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
        listed = {c: F.when(F.coalesce(F.col(c), F.lit("")) == "", none).otherwise(F.split(F.col(c), r"\|")) if c in rows.columns else none for c in LISTS}
        return rows.select("question", *[v.alias(c) for c, v in listed.items()])
    raise ValueError(f"an evaluation set is .json or .csv, not {path}")
