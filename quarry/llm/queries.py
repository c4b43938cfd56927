"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import canon, docpairs, handwritten
from quarry.llm import mix as mixing
from quarry.llm import pack as packing
from quarry.llm import pii, quantiles, split, tokens
from quarry.plans.lineage import cut_lineage
from quarry.session import spread, table

PERCENTILES = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
#: A latency of a million ms (a quarter of an hour) or more is one in nanoseconds.
NANOSECONDS_FROM = 1_000_000


def _documented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docpairs.documented_functions(table(spark, sf_dir, "chunks"), *split.limit_of(table(spark, sf_dir, "size_limits"), "chunk_lines"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documented(spark, sf_dir).select("repo_id", "file_path", "symbol_name", "start_line").distinct()


def p1_code_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = split.limit_of(table(spark, sf_dir, "size_limits"), "chunk_lines")
    return docpairs.code_pairs(table(spark, sf_dir, "chunks"), _documented(spark, sf_dir), *windows)


def _latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``repo_id, day, latency_ms`` of every distinct eval item; impossible values are null, nanoseconds converted."""
    items = table(spark, sf_dir, "eval_items").select("eval_id", "item_no", "latency_ms").dropDuplicates(["eval_id", "item_no"])
    runs = table(spark, sf_dir, "evals").select("eval_id", "repo_id", "created_at").dropDuplicates(["eval_id"])
    ms = F.col("latency_ms")
    day = F.date_from_unix_date(F.floor(F.unix_micros("created_at") / 86_400_000_000).cast("int"))
    return (
        items.join(runs, "eval_id", "left")
        .select("repo_id", day.alias("day"), F.when(ms < 0, None).when(ms >= NANOSECONDS_FROM, ms / 1e6).otherwise(ms.cast("double")).alias("latency_ms"))
    )


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantiles.sketch(_latencies(spark, sf_dir), F.col("latency_ms"), {"repo_id": F.col("repo_id"), "day": F.col("day")})


def _shown(found: DataFrame) -> DataFrame:
    """Percentiles with six decimals: latencies are 0 or at least 1 ms, so these stay within the bound."""
    return found.withColumns({name: F.round(name, 6) for name in PERCENTILES})


def p2_latency_percentiles_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(quantiles.percentiles(_daily(spark, sf_dir), ["repo_id", "day"], PERCENTILES))


def p2_latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(quantiles.percentiles(quantiles.merge([_daily(spark, sf_dir)], ["repo_id"]), ["repo_id"], PERCENTILES))


def p2_error_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per repository: whether each percentile of the merged daily sketches is within the stated error of the exact one."""
    counts = _latencies(spark, sf_dir).where(F.col("latency_ms").isNotNull()).groupBy("repo_id", "latency_ms").agg(F.count(F.lit(1)).alias("c"))
    group = Window.partitionBy("repo_id")
    upto = F.sum("c").over(group.orderBy("latency_ms").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = counts.select("repo_id", "latency_ms", upto.alias("upto"), F.sum("c").over(group).alias("whole"))
    exact = placed.groupBy(F.col("repo_id").alias("repo")).agg(
        F.max("whole").alias("rows"), *[F.min(F.when(F.col("upto") > F.floor(q * (F.col("whole") - 1)), F.col("latency_ms"))).alias(f"exact_{name}") for name, q in PERCENTILES.items()]
    )
    found = p2_latency_percentiles(spark, sf_dir).join(exact, F.col("repo_id").eqNullSafe(F.col("repo")), "full")
    within = [(F.abs(F.col(name) - F.col(f"exact_{name}")) <= quantiles.ACCURACY * F.col(f"exact_{name}")).alias(f"{name}_within") for name in PERCENTILES]
    return found.select("repo_id", "n", F.col("rows").alias("n_exact"), *within)


def _p2_sql(keys: str) -> str:
    gamma = repr(quantiles.gamma_of(quantiles.ACCURACY))
    wanted = ", ".join(f"round(min(CASE WHEN upto > floor({q} * (whole - 1)) THEN middle END), 6) AS {name}" for name, q in PERCENTILES.items())
    return f"""
    WITH items AS (SELECT DISTINCT ON (eval_id, item_no) eval_id, item_no, latency_ms FROM eval_items),
    runs AS (SELECT DISTINCT ON (eval_id) eval_id, repo_id, created_at FROM evals),
    clean AS (
      SELECT repo_id, DATE '1970-01-01' + CAST(floor(epoch_us(created_at) / 86400000000) AS INTEGER) AS day,
        CASE WHEN latency_ms < 0 THEN NULL WHEN latency_ms >= {NANOSECONDS_FROM} THEN latency_ms / 1e6 ELSE latency_ms::DOUBLE END AS v
      FROM items LEFT JOIN runs USING (eval_id)),
    counts AS (
      SELECT {keys}, CASE WHEN v = 0 THEN 0 ELSE 1 END AS side,
        CASE WHEN v = 0 THEN 0 ELSE ceil(ln(v) / ln({gamma})) END AS bucket, count(*) AS n
      FROM clean WHERE v IS NOT NULL GROUP BY ALL),
    ranked AS (
      SELECT {keys}, sum(n) OVER (PARTITION BY {keys} ORDER BY side * (bucket + 4194304)) AS upto,
        sum(n) OVER (PARTITION BY {keys}) AS whole, side * 2 * pow({gamma}, bucket) / ({gamma} + 1) AS middle
      FROM counts)
    SELECT {keys}, CAST(max(whole) AS BIGINT) AS n, {wanted} FROM ranked GROUP BY {keys}"""


P2_WITHIN_SQL = f"""
    WITH items AS (SELECT DISTINCT ON (eval_id, item_no) eval_id, latency_ms FROM eval_items), runs AS (SELECT DISTINCT ON (eval_id) eval_id, repo_id FROM evals)
    SELECT repo_id, count(*) AS n, count(*) AS n_exact, {', '.join(f'true AS {name}_within' for name in PERCENTILES)}
    FROM items LEFT JOIN runs USING (eval_id) WHERE latency_ms >= 0 GROUP BY repo_id"""

CHUNK_COLUMNS = ("id", "repo_id", "file_path", "start_line", "end_line", "chunk_text")


def _pieces(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    return split.split_oversized(chunks, "chunk_text", "start_line", "end_line", *split.limit_of(limits, "chunk_chars"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = _pieces(table(spark, sf_dir, "chunks").select(*CHUNK_COLUMNS), table(spark, sf_dir, "size_limits"))
    return pieces.where(F.col("piece_no") == 1).select("id").distinct()


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = table(spark, sf_dir, "size_limits")
    chunks = table(spark, sf_dir, "chunks").select(*CHUNK_COLUMNS)
    placed = split.aligned(chunks, *split.limit_of(limits, "chunk_lines"), split.limit_of(limits, "chunk_chars")[0])
    return _pieces(placed, limits).dropDuplicates(["id", "piece_no"])


P3_SQL = "SELECT DISTINCT id FROM chunks WHERE length(chunk_text) > (SELECT max_size FROM size_limits WHERE limit_name = 'chunk_chars')"


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canon.copies(canon.content_keys(table(spark, sf_dir, "chunks")))


def p4_code_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The copies among chunks that aren't compared by field."""
    plain = table(spark, sf_dir, "chunks").where(~F.coalesce(F.col("language").isin(*canon.FIELD_LANGUAGES), F.lit(False)))
    return canon.copies(canon.content_keys(plain))


P4_SQL = """
    WITH plain AS (SELECT DISTINCT id, regexp_replace(lower(replace(upper(nfc_normalize(chunk_text)), 'ß', 'SS')), '[^\\p{L}\\p{N}]+', '', 'g') AS said FROM chunks
      WHERE id IS NOT NULL AND chunk_text IS NOT NULL AND coalesce(language, '') NOT IN ('json', 'yaml')),
    sets AS (SELECT said, min(id) AS id_a FROM plain WHERE length(said) >= 40 GROUP BY said HAVING count(*) > 1)
    SELECT id_a, id AS id_b FROM plain JOIN sets USING (said) WHERE id <> id_a"""


def p4_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canon.contents(canon.content_keys(table(spark, sf_dir, "chunks"))).select(F.hex("content_hash").alias("content_hash"), "id", "n_copies", "n_rows")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return handwritten.classified_files(table(spark, sf_dir, "chunks")).where(F.col("origin").isNotNull()).select("repo_id", "file_path")


def p5_file_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return handwritten.classified_files(table(spark, sf_dir, "chunks")).select(
        "repo_id", "file_path", "language", F.coalesce("origin", F.lit("hand-written")).alias("origin"), "evidence", "lines", "max_line", "n_shapes",
        *[F.round(c, 6).alias(c) for c in ("mean_line", "space_share", "alnum_share", "number_share", "encoded_share")],
    )


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return docs.withColumn("n_tokens", tokens.n_tokens(F.col("text")))


def p6_packed_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = table(spark, sf_dir, "size_limits").where(F.col("limit_name").startswith("pack_") & (F.col("unit") == "tokens"))
    named = [(r[0], int(r[1]), int(r[2] or 0)) for r in limits.select("limit_name", "max_size", "overlap").orderBy("limit_name").collect()]
    return packing.pack(_sized(spark, sf_dir), named)


def p6_packing_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per limit: texts that are packed, contexts over their capacity, texts split though they fit, and texts that aren't whole."""
    sized = _sized(spark, sf_dir).where(F.col("n_tokens") > 0).select("doc_id", "n_tokens")
    packed = cut_lineage(p6_packed_contexts(spark, sf_dir))
    used = packed.groupBy("limit_name", "capacity", "context_id").agg(F.sum("size").alias("n")).groupBy("limit_name", "capacity").agg(F.count_if(F.col("n") > F.col("capacity")).alias("overfull"))
    ends = packed.groupBy("limit_name", "capacity", "doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.max(F.col("start_token") + F.col("size")).alias("end"), F.min("start_token").alias("begin"))
    texts = ends.join(sized, "doc_id").groupBy("limit_name").agg(
        F.count(F.lit(1)).alias("texts"), F.count_if((F.col("pieces") > 1) & (F.col("n_tokens") <= F.col("capacity"))).alias("split_needlessly"),
        F.count_if((F.col("begin") > 0) | (F.col("end") != F.col("n_tokens"))).alias("cut_short"),
    )
    return used.join(texts, "limit_name").select("limit_name", "capacity", "texts", "overfull", "split_needlessly", "cut_short")


def p6_fill_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per limit: contexts, tokens, share of the capacity that is used, and the least number of contexts that could do."""
    contexts = p6_packed_contexts(spark, sf_dir).groupBy("limit_name", "capacity", "context_id").agg(F.sum("size").alias("used"))
    return contexts.groupBy("limit_name", "capacity").agg(
        F.count(F.lit(1)).alias("contexts"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"),
        F.round(F.sum("used") / (F.count(F.lit(1)) * F.first("capacity")), 4).alias("fill"),
        F.ceil(F.sum("used") / F.first("capacity")).alias("least_contexts"),
    )


def _mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, sf_dir, "mix_targets")
    unique = cut_lineage(mixing.unique_texts(_sized(spark, sf_dir), targets))  # tokens are counted once
    planned = mixing.plan(unique, targets)
    return mixing.mix(unique, planned), planned


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, _ = _mixture(spark, sf_dir)
    return mixing.shuffled(mixed, table(spark, sf_dir, "documents"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(*_mixture(spark, sf_dir))


def p7_share_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: whether its share is met within 2 % or all that it may give is used, and whether its maximum is kept."""
    mixed, planned = _mixture(spark, sf_dir)
    found = mixing.shares(mixed, planned).join(planned.select("source", "available"), "source")
    near = F.abs(F.col("actual_share") - F.col("target_share")) <= 0.02 * F.col("target_share")
    return found.select("source", "target_share", (near | (F.col("tokens") == F.col("available") * F.col("max_repeats"))).alias("share_met"), (F.col("most_repeats") <= F.col("max_repeats")).alias("cap_kept"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents")).select("doc_id", "pii_type", "value").distinct()


def p8_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.redacted(docs, pii.personal_data(docs))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_code_descriptions, p2_latency_percentiles_daily, p2_latency_percentiles, p2_error_bounds, p3_found, p3_pieces,
        p4_found, p4_code_copies, p4_contents, p5_found, p5_file_origins,
        p6_packed_contexts, p6_packing_check, p6_fill_report, p7_mixture, p7_shares, p7_share_check, p8_found, p8_redacted,
    )
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {
        "p2_latency_percentiles_daily": _p2_sql("repo_id, day"),
        "p2_latency_percentiles": _p2_sql("repo_id"),
        "p2_error_bounds": P2_WITHIN_SQL,
        "p3_found": P3_SQL,
        "p4_code_copies": P4_SQL,
        "p6_packing_check": """SELECT limit_name, max_size AS capacity, (SELECT count(*) FROM documents WHERE text <> '') AS texts, CAST(0 AS BIGINT) AS overfull, CAST(0 AS BIGINT) AS split_needlessly,
          CAST(0 AS BIGINT) AS cut_short FROM size_limits WHERE limit_name LIKE 'pack_%' AND unit = 'tokens'""",
        "p7_share_check": "SELECT source, target_share, true AS share_met, true AS cap_kept FROM mix_targets",
    }
