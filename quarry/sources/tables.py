"""Writing and replacing tables that are partitioned by repository."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.chunking import latest_by_key


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table has been written at ``path``."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def replace_repos(rows: DataFrame, path: str, key: str = "repo_id") -> None:
    """Write ``rows`` so that the partitions of their repositories, and no others, are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def delete_repo(spark: SparkSession, path: str, repo: str, key: str = "repo_id") -> None:
    """Remove one repository's partition; that of an unknown one is no error."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{key}={repo}")
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def upserted(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``old`` with each row of ``new`` added or put in place of the row with its key."""
    return old.join(new, list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def current(rows: DataFrame, keys: Sequence[str], newest: str) -> DataFrame:
    """The newest row per key of an append-only table."""
    return latest_by_key(rows, list(keys), [newest])


def cached(spark: SparkSession, path: str, provider: str, batch: str | None = None) -> DataFrame:
    """``chunk_hash, vector`` of one provider; none where no cache has been written. Rows of ``batch`` are left out."""
    schema = "chunk_hash string, vector array<float>, provider string, batch string"
    rows = spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)
    rows = rows.where(F.col("provider") == provider)
    return (rows.where(F.col("batch") != batch) if batch is not None else rows).select("chunk_hash", "vector")


def append_new(cache: DataFrame | None, new: DataFrame, path: str, batch: str, key: str = "chunk_hash", provider: str = "provider") -> None:
    """Add vectors whose hash the cache doesn't hold; keys are hashes of content, so nothing is ever updated.

    The rows replace those of an earlier attempt at the same ``batch``, so that repeating it adds nothing twice;
    ``cache`` must not contain that attempt.
    """
    fresh = new.dropDuplicates([provider, key])
    if cache is not None:
        fresh = fresh.join(cache.select(provider, key), [provider, key], "left_anti")
    fresh.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(provider, "batch").parquet(path)


def with_known_repo(questions: DataFrame, repos: DataFrame, repo: str = "repo_id") -> DataFrame:
    """``questions`` with ``error``: null where the repository is indexed, else that it isn't. A null one isn't.

    Repeated rows of ``repos`` count once, so no question is multiplied.
    """
    known = repos.where(F.col(repo).isNotNull()).select(repo, F.lit(True).alias("__known")).distinct()
    error = F.when(F.col("__known").isNull(), F.concat(F.lit("repository "), F.coalesce(F.col(repo), F.lit("null")), F.lit(" is not indexed")))
    return questions.join(known, repo, "left").withColumn("error", error).drop("__known")


def save_evaluations(summaries: DataFrame, path: str) -> None:
    """Write summaries of runs, ``repo_id, eval_id, ...``; a run that is saved again replaces itself."""
    summaries.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo_id", "eval_id").parquet(path)


def checked_vectors(rows: DataFrame, vector: str = "vector") -> DataFrame:
    """``rows``, with an error at run time for a null vector."""
    return rows.where(F.when(F.col(vector).isNull(), F.raise_error(F.lit("a row has no vector"))).otherwise(True).cast("boolean"))
