"""Question analysis and the heuristic score of a chunk for a question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import base_name, code_tokens, filled_lines, normalized_identifier, raw_tokens

#: Term sets of the analysis.
DEFINITION = ["define", "defined", "defines", "declare", "declared", "declares", "implement", "implemented", "implements"]
CONFIGURATION = ["settings", "configuration", "config", "properties", "commands", "command", "activation"]
SCHEMA = ["database", "migration", "migrations", "postgres", "postgresql", "prisma", "schema", "sql"]
STOPWORDS = [
    "a", "about", "all", "an", "and", "any", "are", "as", "at", "by", "code", "defined", "defines", "file", "files", "for", "from", "how",
    "implemented", "in", "is", "it", "main", "of", "on", "or", "repo", "repository", "spa", "the", "this", "to", "what", "where", "which",
]
LOW_SIGNAL = ["class", "function", "method", "integration", "implementation"]
README = ["readme.md"]
DOC_FILES = ["readme.md", "changelog.md", "contributing.md"]


def _lit_array(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def analyzed(questions: DataFrame, question: str = "question") -> DataFrame:
    """``questions`` with tokens, important_terms, identifier_terms and a boolean per intent.

    Null questions have empty arrays and no intent.
    """
    text = F.coalesce(F.col(question), F.lit(""))
    raw = raw_tokens(text)
    # order matters only for identifier terms of the fallback, which keep the first occurrence
    tokens = code_tokens(text)
    stop, low, schema = _lit_array(STOPWORDS), _lit_array(LOW_SIGNAL), _lit_array(SCHEMA)
    df = questions.withColumn("tokens", tokens)
    strong = F.filter("tokens", lambda t: ~F.array_contains(stop, t) & ~F.array_contains(low, t) & (F.length(t) > 2))
    weak = F.filter("tokens", lambda t: ~F.array_contains(stop, t))
    written = F.filter(
        F.transform(F.filter(raw, lambda t: t.rlike("[A-Z.]")), normalized_identifier), lambda t: (t != "") & ~F.array_contains(stop, t)
    )
    fallback = F.filter("tokens", lambda t: F.array_contains(schema, t) | (~F.array_contains(stop, t) & (F.length(t) > 4)))

    def has(*words: str) -> Column:
        return F.arrays_overlap("tokens", _lit_array(list(words)))

    return df.withColumns(
        {
            "important_terms": F.when(F.size(strong) > 0, strong).otherwise(weak),
            "identifier_terms": F.array_distinct(F.when(F.size(written) > 0, written).otherwise(fallback)),
            "asks_readme": has("readme"),
            "asks_license": has("license"),
            "asks_support": (has("report") & has("issues")) | (has("feature") & has("requests")),
            "asks_features": has("feature", "features"),
            "asks_definition": has(*DEFINITION) | (has("where", "which") & has("file", "files")),
            "asks_configuration": has(*CONFIGURATION),
            "asks_schema": has(*SCHEMA),
            "asks_class": has("class"),
            "asks_function": has("function"),
            "asks_method": has("method"),
        }
    ).withColumn("asks_documentation", F.col("asks_readme") | F.col("asks_license") | F.col("asks_support"))


def _documentation(path_lower: Column) -> Column:
    return base_name(path_lower).isin(*DOC_FILES) | path_lower.startswith("docs/")


def _declares(text_lower: Column) -> Column:
    """Whether a declaration of an identifier term occurs, by the first intent that holds."""

    def shape(pattern: str) -> Column:
        before, after = pattern.split("ID")
        # most terms don't occur at all, which a plain search tells before a pattern is made
        return F.exists("identifier_terms", lambda t: F.contains(text_lower, t) & F.rlike(text_lower, F.concat(F.lit(before), t, F.lit(after))))

    klass = shape(r"\b(?:export\s+)?class\s+ID\b")
    function = shape(r"\b(?:export\s+)?(?:async\s+)?function\s+ID\b")
    member = shape(r"\b(?:public|private|protected)?\s*(?:static\s+)?(?:async\s+)?ID\s*\(") | shape(r"\b(?:export\s+)?(?:const|let|var)\s+ID\s*=") | klass
    return (
        F.when(F.size("identifier_terms") == 0, F.lit(False))
        .when(F.col("asks_class"), klass)
        .when(F.col("asks_function"), function)
        .when(F.col("asks_method") | F.col("asks_definition"), member)
        .otherwise(False)
    )


def _import_only(text: Column) -> Column:
    head = F.slice(filled_lines(text), 1, 6)
    imports = F.size(F.filter(head, lambda x: x.startswith("import ") | x.startswith("from ")))
    return (F.size(head) > 0) & (imports >= F.greatest(F.lit(2), F.size(head) - 1))


def chunk_features(chunks: DataFrame) -> DataFrame:
    """``chunks`` with what the score needs of a chunk alone: ``said_tokens``, unless they are there, and ``import_only``, made once per chunk."""
    said = F.concat_ws(" ", "file_path", F.coalesce("symbol_name", F.lit("")), F.coalesce("symbol_type", F.lit("")), F.coalesce("chunk_text", F.lit("")))
    made = chunks if "said_tokens" in chunks.columns else chunks.withColumn("said_tokens", code_tokens(said))
    return made.withColumn("import_only", _import_only(F.coalesce(F.col("chunk_text"), F.lit(""))))


def assessed(pairs: DataFrame, base: str = "score") -> DataFrame:
    """``pairs`` of analyzed question and chunk with the parts of the heuristic score and ``assessment``.

    Needs the columns of ``analyzed``, ``file_path, symbol_name, symbol_type, chunk_text, start_line`` and ``base``;
    the columns of ``chunk_features`` are made here only where they are missing.
    Null names and types count as empty. The score is rounded to six digits.
    """
    path = F.lower("file_path")
    name, text = base_name(path), F.coalesce(F.col("chunk_text"), F.lit(""))
    lower_text, symbol = F.lower(text), normalized_identifier(F.coalesce(F.col("symbol_name"), F.lit("")))
    df = (pairs if "import_only" in pairs.columns else chunk_features(pairs)).withColumns(
        {
            "important_overlap_terms": F.array_sort(F.array_intersect("important_terms", "said_tokens")),
            "identifier_overlap_terms": F.array_sort(F.array_intersect("identifier_terms", "said_tokens")),
            "symbol_exact": (symbol != "") & F.array_contains("identifier_terms", symbol),
            "symbol_partial": (symbol != "") & F.exists("identifier_terms", lambda t: (F.length(t) > 3) & F.contains(symbol, t)),
            "declares": _declares(lower_text),
            "path_match": F.exists(F.concat("identifier_terms", "important_terms"), lambda t: F.contains(path, t)),
            "schema_in_path": F.exists(_lit_array(SCHEMA), lambda t: F.contains(path, t)),
        }
    )
    readme = name.isin(*README)
    licensed = F.contains(path, F.lit("license")) | readme | (name == "package.json")
    preferred = (
        F.when(F.col("asks_readme"), readme)
        .when(F.col("asks_license"), licensed)
        .when(F.col("asks_configuration"), (name == "package.json") | path.startswith("config/") | name.startswith("config.") | name.isin("default.yml", "default.yaml"))
        .when(F.col("asks_schema"), F.col("schema_in_path"))
        .when(F.col("asks_support") | F.col("asks_features"), readme)
        .otherwise(False)
    )
    df = df.withColumn("preferred_file", preferred)
    documentation = _documentation(path) & ~F.col("asks_documentation")
    hits = F.size(F.filter(_lit_array(SCHEMA), lambda t: F.contains(path, t) | F.contains(lower_text, t)))

    def if_(condition: Column, worth: float) -> Column:
        return F.when(condition, F.lit(worth)).otherwise(0.0)

    def share(found: str, of: str) -> Column:
        return F.size(found) / F.greatest(F.lit(1), F.size(F.array_distinct(of)))

    definition, configuration = F.col("asks_definition"), F.col("asks_configuration")
    score = (  # fixed values: the weights
        0.2 * F.col(base)
        + 0.35 * share("important_overlap_terms", "important_terms")
        + 0.15 * share("identifier_overlap_terms", "identifier_terms")
        + F.when(F.col("symbol_exact"), 0.45).when(F.col("symbol_partial"), 0.08).otherwise(0.0)
        + if_(F.col("declares"), 0.35)
        + if_(F.col("path_match"), 0.12)
        + if_(F.col("preferred_file"), 0.35)
        + if_(documentation, -0.08)
        + if_(definition & (F.col("start_line") <= 40), 0.05)
        + if_(definition & (name == "package.json") & ~configuration, -0.15)
        + if_(definition & documentation, -0.18)
        + if_(definition & F.col("import_only") & ~F.col("declares"), -0.12)
        + if_(configuration & (name == "package.json"), 0.45)
        + if_(configuration & (F.contains(text, F.lit('"configuration"')) | F.contains(text, F.lit("contributes"))), 0.18)
        + if_(configuration & F.contains(lower_text, F.lit("codespa.")), 0.12)
        + if_(F.col("asks_readme") & readme, 0.45)
        + if_(F.col("asks_license") & licensed, 0.25)
        + if_(F.col("asks_support") & readme, 0.30)
        + if_(F.col("asks_features") & readme, 0.25)
        + F.when(~F.col("asks_schema"), 0.0).when(hits > 0, F.least(F.lit(0.6), hits * 0.18)).otherwise(-0.24)
    )
    support = F.when(F.size("important_overlap_terms") > 0, F.col("important_overlap_terms")).otherwise(F.col("identifier_overlap_terms"))
    return df.withColumns({"assessment": F.round(score, 6), "support_terms": support}).drop("said_tokens", "import_only")
