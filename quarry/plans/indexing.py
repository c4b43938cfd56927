"""Indexing: files to chunks with symbols, identities and vectors, written by repository."""

from __future__ import annotations

import ast
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import ids
from quarry.functions.text import lines_of
from quarry.operators.chunking import REGION, SCRIPT_LANGUAGES, line_windows, with_script_regions
from quarry.operators.vectors import embed_with, missing_from_cache
from quarry.plans.lineage import cut_lineage
from quarry.sources import tables, trees

def _python_regions(text: str | None) -> list[dict] | None:
    """The symbols of a Python file; None if it doesn't parse."""
    if text is None:
        return None
    try:
        nodes = [n for n in ast.walk(ast.parse(text)) if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef)]
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    found = [("class" if isinstance(n, ast.ClassDef) else "function", n.name, n.lineno, n.end_lineno) for n in nodes]
    return [dict(zip(("symbol_type", "symbol_name", "first", "last"), r)) for r in sorted(found, key=lambda r: r[2:])]


def regions(files: DataFrame) -> DataFrame:
    """Rows of ``language, text`` with ``__lines`` and the array ``__regions``: symbols, then the runs of lines outside of all.

    A file whose language has no symbols here, a script without any, and Python that doesn't parse, is one region
    without a type. Texts without lines have no regions. Only the text of Python files goes to a Python worker.
    """

    @F.pandas_udf(f"array<{REGION}>")
    def parsed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([_python_regions(t) for t in texts], dtype=object)

    is_python = F.coalesce(F.col("language") == "python", F.lit(False))
    is_script = F.coalesce(F.col("language").isin(*SCRIPT_LANGUAGES), F.lit(False))
    cut = files.where(F.col("text").isNotNull()).withColumn("__lines", lines_of(F.col("text"))).where(F.size("__lines") > 0)
    read = with_script_regions(cut.withColumn("__script", F.when(is_script, F.col("__lines"))), "__script", "__found").drop("__script")
    read = read.withColumn("__parsed", parsed.asNondeterministic()(F.when(is_python, F.col("text"))))
    found = F.when(is_python, F.col("__parsed")).when(F.size("__found") > 0, F.col("__found"))

    def region(kind: Column, first: Column, last: Column) -> Column:
        return F.struct(kind.cast("string").alias("symbol_type"), F.lit(None).cast("string").alias("symbol_name"), first.cast("int").alias("first"), last.cast("int").alias("last"))

    n = F.size("__lines")
    zero = F.struct(F.lit(1).alias("at"), F.array().cast(f"array<{REGION}>").alias("gaps"))

    def step(s: Column, r: Column) -> Column:
        gaps = F.when(r["first"] > s["at"], F.array_append(s["gaps"], region(F.lit("context"), s["at"], r["first"] - 1))).otherwise(s["gaps"])
        return F.struct(F.greatest(s["at"], r["last"] + 1).alias("at"), gaps.alias("gaps"))

    def tail(s: Column) -> Column:
        return F.when(s["at"] <= n, F.array_append(s["gaps"], region(F.lit("context"), s["at"], n))).otherwise(s["gaps"])

    whole = F.array(region(F.lit(None), F.lit(1), n))
    symbols = read.withColumn("__symbols", found).drop("__found", "__parsed")
    return symbols.withColumn("__regions", F.when(F.col("__symbols").isNull(), whole).otherwise(F.concat("__symbols", F.aggregate("__symbols", zero, step, tail)))).drop("__symbols")


def chunked(files: DataFrame, repo: str, url: str, sha: str | None = None, size: int = 80, overlap: int = 20) -> DataFrame:
    """Chunk rows of ``file_path, language, text``: windows of every region, with id and hash; blank ones don't come out.

    Rows of null text have no chunks; of windows of a file with equal lines and text the last one is kept.
    """
    each = (
        regions(files)
        .select("file_path", "language", "__lines", F.posexplode_outer("__regions").alias("__nth", "__region"))
        .where(F.col("__region").isNotNull())
        .select(
            "file_path", "language", "__nth", "__region.symbol_type", "__region.symbol_name", F.col("__region.first").alias("first"),
            F.array_join(F.slice("__lines", F.col("__region.first"), F.col("__region.last") - F.col("__region.first") + 1), "\n").alias("region_text"),
        )
    )
    windows = line_windows(each, "region_text", size, overlap, "first").drop("first").withColumn("chunk_hash", ids.chunk_hash(F.col("window_text")))
    kept = F.max_by(F.struct("language", "symbol_type", "symbol_name", F.col("window_text").alias("chunk_text")), "__nth")
    rows = windows.groupBy("file_path", "start_line", "end_line", "chunk_hash").agg(kept.alias("k")).select("file_path", "start_line", "end_line", "chunk_hash", "k.*")
    hashed = rows.select(F.lit(repo).alias("repo_id"), F.lit(url).alias("repo_url"), F.lit(sha).cast("string").alias("commit_sha"), "*")
    named = hashed.withColumn("id", ids.chunk_id(F.col("repo_id"), F.col("file_path"), F.col("start_line"), F.col("end_line"), F.col("chunk_hash")))
    return named.withColumn("created_at", F.current_timestamp())


CHUNKS = (
    "repo_id string, repo_url string, commit_sha string, file_path string, start_line int, end_line int, chunk_hash string, language string, symbol_type string, "
    "symbol_name string, chunk_text string, id string, created_at timestamp"
)


def index(
    spark: SparkSession, url: str, chunks_path: str, cache_path: str, make_provider, provider: str,
    branch: str | None = None, sha: str | None = None, repos_path: str | None = None, run: str | None = None,
) -> str:
    """Index a local tree: its chunks replace those of its repository, and vectors of unseen hashes are added.

    Returns the repository's id. ``make_provider`` makes an object with ``embed_documents`` in each task. At
    ``repos_path`` the repository's row, with its numbers of files and chunks and of hashes that had a vector, is
    replaced. ``run`` names the attempt: repeating one adds no vector twice. A tree without chunks leaves none.
    """
    repo = spark.range(1).select(ids.repo_id(F.lit(url), F.lit(branch).cast("string"))).first()[0]
    run = run or uuid.uuid4().hex
    files = trees.scan_tree(spark, url)
    tables.delete_repo(spark, chunks_path, repo)
    tables.replace_repos(chunked(files, repo, url, sha), chunks_path)
    mine = spark.read.schema(CHUNKS).parquet(chunks_path).where(F.col("repo_id") == repo)
    cache = tables.cached(spark, cache_path, provider, run)
    unseen = cut_lineage(missing_from_cache(mine.select("chunk_hash", "chunk_text"), cache.select("chunk_hash")))
    tables.append_new(None, embed_with(unseen, "chunk_hash", "chunk_text", make_provider).withColumn("provider", F.lit(provider)), cache_path, run)
    if repos_path:
        counts = mine.agg(F.count(F.lit(1)).alias("chunks_indexed"), F.countDistinct("chunk_hash").alias("hashes"))
        row = counts.crossJoin(files.agg(F.count(F.lit(1)).alias("files_indexed"))).crossJoin(unseen.agg(F.count(F.lit(1)).alias("new")))  # three single rows
        hits = F.create_map(F.lit("embedding_cache_hits"), (F.col("hashes") - F.col("new")).cast("string"))
        tables.replace_repos(
            row.select(
                F.lit(repo).alias("repo_id"), F.lit(url).alias("repo_url"), F.lit(branch).cast("string").alias("branch"), F.lit(sha).cast("string").alias("commit_sha"),
                F.current_timestamp().alias("indexed_at"), "files_indexed", "chunks_indexed", hits.alias("metadata"),
            ),
            repos_path,
        )
    return repo


def embed_stream(chunks: DataFrame, cache_path: str, checkpoint: str, make_provider, provider: str):
    """A started stream that adds vectors of the hashes each micro-batch brings and the cache lacks.

    A batch that is tried again replaces what it had added.
    """

    def write(batch: DataFrame, number: int) -> None:
        name = f"stream-{number}"
        unseen = missing_from_cache(batch.select("chunk_hash", "chunk_text"), tables.cached(batch.sparkSession, cache_path, provider, name).select("chunk_hash"))
        tables.append_new(None, embed_with(unseen, "chunk_hash", "chunk_text", make_provider).withColumn("provider", F.lit(provider)), cache_path, name)

    return chunks.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(write).start()


def replace_stream(chunks: DataFrame, path: str, checkpoint: str):
    """A started stream of chunk rows, of whole repositories at a time: each micro-batch replaces the partitions of its repositories.

    Rows of one id count once. A batch that is tried again replaces the same partitions.
    """

    def write(batch: DataFrame, number: int) -> None:
        tables.replace_repos(batch.dropDuplicates(["id"]), path)

    return chunks.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(write).start()
