"""The registered queries of the core; their SQL is in ``quarry.sql``."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry import sql
from quarry.functions import ids, text
from quarry.operators import answers, chunking, evaluation, guard, relevance, tokens, vectors
from quarry.plans import evaluating, indexing, retrieval
from quarry.plans.lineage import cut_lineage, shared_folder
from quarry.session import spread, table
from quarry.sources import tables, trees
from quarry.streaming import requests as streams

FLAGSHIP = "pip4_hybrid_retrieval"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
QUERY = ["repo_id", "question"]
#: Limits tight enough for the request table: three requests an hour.
TIGHT = tuple((name, path, 3, 3600) for name, path, _, _ in guard.POLICIES)


def registered(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct eval item; repeated rows are exact copies."""
    return table(spark, sf_dir, "eval_items").dropDuplicates(["eval_id", "item_no"])


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "evals").dropDuplicates(["eval_id"])


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: the questions of eval items whose number is divisible by 20, each within its repository."""
    items = table(spark, sf_dir, "eval_items").where(F.col("item_no") % 20 == 0).select("eval_id", "question")
    runs = table(spark, sf_dir, "evals").select("eval_id", "repo_id")
    return items.join(runs, "eval_id").where(F.col("repo_id").isNotNull() & F.col("question").isNotNull()).select(*QUERY).distinct()


def _md5(c: Column) -> Column:
    return F.md5(c)


# --- text primitives


@registered
def str1_raw_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _chunks(spark, sf_dir).select("id", F.explode_outer(text.raw_tokens(F.col("chunk_text"))).alias("token")).where(F.col("token").isNotNull())
    return each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("n_chunks"))


@registered
def str2_code_token_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tokens.token_counts(retrieval.documents(spread(_chunks(spark, sf_dir))), ["repo_id", "id"], {"chunk_text": 1})
    return counts.groupBy("repo_id", "token").agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("df"))


@registered
def str3_identifier_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _chunks(spark, sf_dir).where(F.col("symbol_name").isNotNull()).select("symbol_name").distinct()
    return names.select("symbol_name", F.array_join(F.array_sort(text.identifier_parts(F.col("symbol_name"))), " ").alias("parts"))


@registered
def str4_normalized_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _chunks(spark, sf_dir).where(F.col("symbol_name").isNotNull())
    return named.groupBy(text.normalized_identifier(F.col("symbol_name")).alias("identifier")).agg(F.countDistinct("symbol_name").alias("spellings"), F.count(F.lit(1)).alias("n"))


@registered
def str8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = text.lines_of(F.col("chunk_text"))
    longest = F.coalesce(F.array_max(F.transform(rows, lambda x: F.char_length(x))), F.lit(0))
    return _chunks(spark, sf_dir).select("id", F.size(rows).alias("n_lines"), longest.alias("longest")).distinct()


@registered
def str10_chunk_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("id", text.summary(F.col("chunk_text")).alias("summary")).distinct()


@registered
def str9_markdown_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _chunks(spark, sf_dir).where(F.col("language") == "markdown").select("repo_id", "file_path", F.explode_outer(text.filled_lines(F.col("chunk_text"))).alias("line"))
    return lines.where(F.col("line").startswith("#")).select("repo_id", "file_path", text.without_markdown(F.col("line")).alias("heading")).distinct()


# --- sources and filters


@registered
def prj5_file_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _chunks(spark, sf_dir).select("repo_id", "file_path", "language").distinct()
    return files.select("repo_id", "file_path", trees.language(F.col("file_path")).alias("by_suffix"), "language")


@registered
def flt1_supported_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = retrieval.documents(_chunks(spark, sf_dir)).groupBy("repo_id", "file_path").agg(F.sum(F.char_length("chunk_text")).alias("size"))
    path = F.col("file_path")
    return sizes.select("repo_id", "file_path", trees.pruned(path).alias("pruned"), text.suffix(path).alias("suffix"), trees.supported(path, F.col("size"), 20_000, 5_000).alias("supported"))


@registered
def flt6_printable_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.encode("chunk_text", "UTF-8")
    return _chunks(spark, sf_dir).select("id", F.round(trees.printable_share(content), 6).alias("printable"), trees.is_binary(content).alias("binary")).distinct()


@registered
def prj4_repo_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "repos").select("repo_url", "branch", ids.repo_id(F.col("repo_url"), F.col("branch")).alias("built_id")).distinct()


@registered
def prj3_chunk_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = ids.chunk_hash(F.col("chunk_text"))
    built = ids.chunk_id(F.col("repo_id"), F.col("file_path"), F.col("start_line"), F.col("end_line"), digest)
    return _chunks(spark, sf_dir).select("id", (digest == F.col("chunk_hash")).alias("hash_fits"), (built == F.col("id")).alias("id_fits")).distinct()


@registered
def src7_chunks_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk rows numbered by path and line within each file, as they are listed."""
    docs = retrieval.documents(_chunks(spark, sf_dir)).select("repo_id", "file_path", "start_line", "end_line", "id")
    return docs.withColumn("seq", F.row_number().over(Window.partitionBy("repo_id", "file_path").orderBy("start_line", "end_line", "id")))


@registered
def src10_latest_evals(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = tables.current(_runs(spark, sf_dir).select("eval_id", "repo_id", "created_at", "mrr"), ["repo_id"], "created_at")
    return latest.select("repo_id", "eval_id", "mrr")


@registered
def snk1_current_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repository table as upserts of its rows in order of time leave it."""
    rows = table(spark, sf_dir, "repos").select("repo_id", "repo_url", "branch", "commit_sha", "indexed_at", "files_indexed", "chunks_indexed")
    return tables.current(rows, ["repo_id"], "indexed_at").drop("indexed_at")


@registered
def agg12_index_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).groupBy("repo_id").agg(F.countDistinct("file_path").alias("files"), F.countDistinct("id").alias("chunks"))


# --- chunking


@registered
def win4_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = chunking.line_windows(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", 8, 2)
    return windows.select("doc_id", "start_line", "end_line", _md5(F.col("window_text")).alias("digest"))


@registered
def agg10_deduplicated_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _chunks(spark, sf_dir).select("id", "created_at", "commit_sha", "symbol_type")
    return chunking.latest_by_key(rows, ["id"], ["created_at"]).drop("created_at")


@registered
def win6_uncovered_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines outside of all symbols, to the last line that any chunk of the file shows."""
    named = F.col("symbol_name").isNotNull()
    first, last = F.when(named, F.col("start_line")).alias("start_line"), F.when(named, F.col("end_line")).alias("end_line")
    rows = _chunks(spark, sf_dir).select("repo_id", "file_path", first, last, F.col("end_line").alias("shown")).distinct()
    return chunking.uncovered(rows, ["repo_id", "file_path"], "start_line", "end_line", "shown")


@registered
def win5_block_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = retrieval.documents(_chunks(spark, sf_dir).where(F.col("language").isin("typescript", "java", "go", "cpp", "javascript")))
    return chunking.block_ends(rows, ["id"], "chunk_text")


@registered
def sym2_script_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = retrieval.documents(_chunks(spark, sf_dir).where(F.col("language").isin(*chunking.SCRIPT_LANGUAGES)))
    return chunking.script_symbols(rows, ["id"], "chunk_text")


@registered
def sym5_chunked_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text that isn't Python as a file: windows of its symbols and of the lines outside them.

    Python's symbols come from its own parser, which no SQL can restate: see ``sym1_python_symbols``.
    """
    rows = retrieval.documents(_chunks(spark, sf_dir), "language").where(F.coalesce("language", F.lit("")) != "python")
    files = rows.select(F.col("id").alias("file_path"), "language", F.col("chunk_text").alias("text"))
    cut = indexing.chunked(files, "r", "u", size=16, overlap=4)
    return cut.select(F.col("file_path").alias("chunk"), "language", "symbol_type", "symbol_name", "start_line", "end_line", "chunk_hash")


@registered
def sym1_python_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = retrieval.documents(_chunks(spark, sf_dir).where(F.col("language") == "python"))
    return chunking.python_symbols(rows, ["id"], "chunk_text")


# --- embeddings


@registered
def agg8_hash_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    distinct = _chunks(spark, sf_dir).select("chunk_hash", "chunk_text").dropDuplicates(["chunk_hash"])
    sparse = vectors.hash_embedding(distinct, ["chunk_hash"], "chunk_text")
    return sparse.groupBy("chunk_hash").agg(F.count(F.lit(1)).alias("buckets"), F.sum(F.col("v") * F.col("v")).alias("sumsq"), F.sum(F.col("ix") * F.col("v")).alias("moment"))


@registered
def jn2_missing_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir)
    cache = chunks.where(F.col("embedding").isNotNull()).select("chunk_hash").distinct()
    return vectors.missing_from_cache(chunks.select("chunk_hash"), cache).select("chunk_hash")


@registered
def agg25_cache_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per repository: distinct hashes, those with a cached vector, and those to embed."""
    chunks = _chunks(spark, sf_dir)
    cache = chunks.where(F.col("embedding").isNotNull()).groupBy("chunk_hash").agg(F.lit(True).alias("cached"))
    hashes = chunks.select("repo_id", "chunk_hash").distinct().join(cache, "chunk_hash", "left")
    return hashes.groupBy("repo_id").agg(F.count(F.lit(1)).alias("hashes"), F.count("cached").alias("hits"), F.count_if(F.col("cached").isNull()).alias("embedded"))


@registered
def srt4_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = vectors.nearest(rows, rows.where(F.col("vec_id") % 20 == 0), 10)
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"))


# --- retrieval


@registered
def agg1_corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = retrieval.documents(_chunks(spark, sf_dir))
    counts = tokens.token_counts(docs, ["repo_id", "id"], tokens.FIELD_WEIGHTS)
    return tokens.corpus_stats(docs, counts, "repo_id", "id").select("repo_id", "n_docs", F.round("avgdl", 6).alias("avgdl"))


def _leg(found: DataFrame) -> DataFrame:
    return found.select("repo_id", _md5(F.col("question")).alias("question_hash"), "id", F.round("score", 6).alias("score"), "rank")


@registered
def pip5_bm25_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leg(retrieval.bm25_leg(_chunks(spark, sf_dir), questions(spark, sf_dir), 10))


@registered
def pip5_bm25_okapi_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leg(retrieval.bm25_leg(_chunks(spark, sf_dir), questions(spark, sf_dir), 10, "okapi"))


@registered
def jn5_hash_cosine_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leg(retrieval.vector_leg(_chunks(spark, sf_dir), questions(spark, sf_dir), 10))


@registered
def agg5_fused_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both legs fused and limited to two chunks a file, without reranking."""
    return _leg(retrieval.retrieve(_chunks(spark, sf_dir), questions(spark, sf_dir), "hybrid", 5, rerank=False))


@registered
def flt8_filtered_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector leg over chunks whose metadata match, beside those of the repository."""
    chunks = retrieval.matching(_chunks(spark, sf_dir), {"language": "typescript", "symbol_type": "function"})
    return _leg(retrieval.vector_leg(chunks, questions(spark, sf_dir), 10))


@registered
def jn15_question_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each question can be answered at all: its repository is indexed, or the error says that it isn't."""
    asked = _items(spark, sf_dir).join(_runs(spark, sf_dir).select("eval_id", "repo_id"), "eval_id", "left").groupBy("repo_id").agg(F.count(F.lit(1)).alias("questions"))
    return tables.with_known_repo(asked, _chunks(spark, sf_dir).select("repo_id"))


@registered
def nlp1_question_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _items(spark, sf_dir).where(F.col("question").isNotNull()).select("question").distinct()
    flags = [f"asks_{x}" for x in ("readme", "license", "support", "features", "definition", "configuration", "schema", "class", "function", "method", "documentation")]
    return relevance.analyzed(asked).select(_md5(F.col("question")).alias("question_hash"), *flags)


@registered
def nlp2_question_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = relevance.analyzed(_items(spark, sf_dir).where(F.col("question").isNotNull()).select("question").distinct())
    return asked.select(_md5(F.col("question")).alias("question_hash"), *[F.array_join(F.array_sort(c), " ").alias(c) for c in ("tokens", "important_terms", "identifier_terms")])


@registered
def nlp3_assessed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heuristic score of each question's ten best chunks by BM25, upon their score."""
    found = cut_lineage(retrieval.bm25_leg(_chunks(spark, sf_dir), questions(spark, sf_dir), 10))
    docs = retrieval.documents(_chunks(spark, sf_dir).join(found.select("id").distinct(), "id", "left_semi"))
    found = found.withColumn("score", F.round("score", 6)).join(docs.drop("repo_id"), "id")
    scored = relevance.assessed(relevance.analyzed(found))
    return scored.select("repo_id", _md5(F.col("question")).alias("question_hash"), "id", "symbol_exact", "symbol_partial", "declares", "path_match", "preferred_file",
                         F.array_join("support_terms", " ").alias("support_terms"), "assessment")


@registered
def pip4_hybrid_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.retrieve(_chunks(spark, sf_dir), questions(spark, sf_dir), "hybrid", 5)
    return found.select(*QUERY, "rank", "id", "file_path", "start_line", "end_line", F.round("score", 6).alias("score"), "source")


@registered
def pip7_extractive_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = relevance.analyzed(retrieval.retrieve(_chunks(spark, sf_dir), questions(spark, sf_dir), "hybrid", 5))
    cited = F.transform("citations", lambda c: answers.label(c["file_path"], c["start_line"], c["end_line"]))
    return answers.answered(found, QUERY).select(*QUERY, "answer", F.array_join(cited, ";").alias("citations"))


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eval items whose number is divisible by 20; expected terms are the names of the expected files, forbidden ones those of other files."""
    items = _items(spark, sf_dir).where((F.col("item_no") % 20 == 0) & F.col("question").isNotNull())
    none = F.array().cast("array<string>")
    expected, seen = F.coalesce("expected_files", none), F.coalesce("retrieved_files", none)
    named = lambda files: F.array_distinct(F.transform(files, text.base_name))
    return items.join(_runs(spark, sf_dir).select("eval_id", "repo_id"), "eval_id").where(F.col("repo_id").isNotNull()).select(
        "eval_id", "item_no", *QUERY, "expected_files", named(expected).alias("expected_answer_contains"), F.array_except(named(seen), named(expected)).alias("must_not_contain")
    )


@registered
def pip8_evaluated_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions retrieved, answered and measured."""
    found = evaluating.evaluated(_chunks(spark, sf_dir), _samples(spark, sf_dir), ["eval_id", "item_no"])
    return found.select(
        "eval_id", "item_no", F.array_join("retrieved_files", ";").alias("retrieved"), "retrieval_hit_at_3", "retrieval_hit_at_5", F.round("reciprocal_rank", 6).alias("reciprocal_rank"),
        F.round("answer_contains_score", 6).alias("answer_match"), F.round("groundedness_score", 6).alias("groundedness"), F.array_join("hallucination_flags", ";").alias("flags"),
        _md5(F.col("answer")).alias("answer_hash"),
    )


@registered
def pip8_evaluation_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of each run over its evaluated questions, with the numbers of those that failed."""
    found = evaluating.evaluated(_chunks(spark, sf_dir), _samples(spark, sf_dir), ["eval_id", "item_no"])
    summary = evaluating.summarized(cut_lineage(found), ["eval_id"], "item_no")
    return summary.drop("average_latency_ms", "average_cost").withColumn("failed_items", F.array_join(F.col("failed_items").cast("array<string>"), ";"))


@registered
def prj11_prompt_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cut_lineage(retrieval.bm25_leg(_chunks(spark, sf_dir), questions(spark, sf_dir), 4))
    docs = retrieval.documents(_chunks(spark, sf_dir).join(found.select("id").distinct(), "id", "left_semi"))
    found = found.join(docs.drop("repo_id"), "id")
    blocks = answers.prompt_blocks(found, QUERY)
    return blocks.select("repo_id", _md5(F.col("question")).alias("question_hash"), F.char_length("blocks").alias("length"), _md5(F.col("blocks")).alias("digest"))


# --- evaluation


@registered
def win7_hits_and_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir).select(
        "eval_id", "item_no", evaluation.hit_at(3).alias("hit_at_3"), evaluation.hit_at(5).alias("hit_at_5"), F.round(evaluation.reciprocal_rank(), 6).alias("reciprocal_rank")
    )


@registered
def agg27_groundedness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir).select("eval_id", "item_no", F.round(evaluation.groundedness(), 6).alias("groundedness"), F.array_join(evaluation.flags(), ";").alias("flags"))


@registered
def agg13_eval_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.summary(_items(spark, sf_dir), ["eval_id"])


@registered
def agg18_latency_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir).join(_runs(spark, sf_dir).select("eval_id", "repo_id"), "eval_id")
    return evaluation.nearest_rank(items, ["repo_id"], "latency_ms", [50, 95, 99])


# --- requests


@registered
def jn16_matched_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guard.matched(table(spark, sf_dir, "requests")).select("request_id", "policy", "client", "at")


@registered
def stm1_limited_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions under limits tight enough for this table: three requests an hour."""
    return guard.limited(table(spark, sf_dir, "requests"), TIGHT)


@registered
def pip9_request_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of the request pipeline under the same limits."""
    return guard.request_counters(table(spark, sf_dir, "requests"), TIGHT)


@registered
def agg19_request_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guard.counters(table(spark, sf_dir, "requests").dropDuplicates(["request_id"]), ["method", "path"], "requests_total")


@registered
def snk11_exposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guard.exposition(agg19_request_counters(spark, sf_dir))


@registered
def snk11_histogram_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir).join(_runs(spark, sf_dir).select("eval_id", "repo_id"), "eval_id")
    return guard.exposition(guard.histograms(items, ["repo_id"], "latency_ms", "eval_latency_ms").withColumn("value", F.round("value", 3)))


@registered
def agg20_latency_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir).join(_runs(spark, sf_dir).select("eval_id", "repo_id"), "eval_id").where(F.col("latency_ms").isNotNull())
    sums = items.groupBy("repo_id").agg(F.count(F.lit(1)).alias("count"), F.sum("latency_ms").alias("sum"), F.round(F.avg("latency_ms"), 6).alias("avg"))
    return sums.join(evaluation.nearest_rank(items, ["repo_id"], "latency_ms", [95]).drop("n"), "repo_id")


@registered
def jsn1_event_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "map<string,string>").alias("p"))
    return rows.select("event_type", F.explode("p").alias("key", "value")).groupBy("event_type", "key").agg(F.count("value").alias("n"), F.countDistinct("value").alias("n_values"))


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{os.urandom(8).hex()}"


@registered
def stm1_limited_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decisions of the batch query, made by a stream over the same files."""
    return streams.collected(streams.limited_stream(streams.read_requests(spark, sf_dir), TIGHT), _folder(spark))


@registered
def stm2_counted_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.collected(streams.counted_stream(streams.read_requests(spark, sf_dir)), _folder(spark), "complete")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(sql.SQL)
