"""Extractive answers with citations, from the best assessed chunks of each question."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import WHITE, base_name, filled_lines, normalized_identifier, summary, without_markdown
from quarry.operators.relevance import DOC_FILES, assessed

#: Fixed value: the answer without evidence.
UNKNOWN = "I don't know from the indexed repo."


def label(path: Column, start: Column, end: Column) -> Column:
    return F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def relevant_lines(text: Column) -> Column:
    """The up to four lines of a chunk that share most terms with the question, without markdown marks.

    Headings of the third level and list items count one more; equal lines keep their order.
    """

    def worth(line: Column) -> Column:
        ids = F.array_distinct(F.transform(F.regexp_extract_all(line, F.lit("[A-Za-z0-9_.-]+"), F.lit(0)), normalized_identifier))
        words = F.array_distinct(F.split(F.lower(line), f"[{WHITE}]+"))
        marked = line.startswith("### ") | line.startswith("- ") | line.startswith("* ")
        return F.size(F.array_intersect(ids, "identifier_terms")) + F.size(F.array_intersect(words, "important_terms")) + marked.cast("int")

    scored = F.transform(filled_lines(text), lambda x, i: F.struct((-worth(x)).alias("w"), i.alias("i"), without_markdown(x).alias("line")))
    return F.transform(F.slice(F.array_sort(F.filter(scored, lambda s: s["w"] < 0)), 1, 4), lambda s: s["line"])


def enough_evidence() -> Column:
    """The gate of the best chunk, by the first intent that holds."""
    some, score = F.size("support_terms") > 0, F.col("assessment")
    return (
        F.when(F.col("asks_schema"), F.col("preferred_file") | some)
        .when(
            F.col("asks_configuration"),
            F.col("preferred_file") | ((score >= 0.45) & (F.contains(F.lower("chunk_text"), F.lit("configuration")) | F.contains(F.lower("file_path"), F.lit("config")))),
        )
        .when(
            F.col("asks_definition"),
            F.col("symbol_exact") | F.col("symbol_partial") | F.col("declares") | (F.col("path_match") & (score >= 0.65)) | ((score >= 0.4) & (F.size("support_terms") >= 2)),
        )
        .when(F.col("asks_documentation"), F.col("preferred_file") | some)
        .otherwise((score >= 0.3) & some)
    )


def answered(retrieved: DataFrame, query: Sequence[str]) -> DataFrame:
    """``query..., answer, citations``: one row per question with retrieved chunks.

    The sentences are fixed values. ``retrieved`` has the columns of ``relevance.analyzed``, the chunk, its ``score`` and ``rank``. Chunks are assessed
    again upon their score. A question without enough evidence gets the fixed unknown sentence and no citation.
    """
    scored = assessed(retrieved)
    best_first = Window.partitionBy(*query).orderBy(F.col("assessment").desc(), "rank")
    ordered = scored.withColumn("__nth", F.row_number().over(best_first))
    path = F.lower("file_path")
    documentation = base_name(path).isin(*DOC_FILES) | path.startswith("docs/")
    bears = (
        F.col("symbol_exact") | F.col("symbol_partial") | F.col("declares") | F.col("preferred_file") | F.col("path_match")
        | ((F.col("assessment") >= 0.45) & (F.size("support_terms") > 0))
    ) & (F.col("asks_documentation") | ~documentation)
    cited = F.struct("file_path", "start_line", "end_line")
    first_of_file = Window.partitionBy(*query, "file_path", "__bears").orderBy("__nth")
    marked = ordered.withColumn("__bears", bears).withColumn("__in_file", F.row_number().over(first_of_file))
    related = F.slice(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("__bears") & (F.col("__in_file") == 1), F.struct("__nth", cited.alias("c"))))), lambda s: s["c"]), 1, 2
    )
    one = marked.groupBy(*query).agg(related.alias("__related"), F.min_by(F.struct(*[c for c in ordered.columns if c not in query]), "__nth").alias("__best"))
    best = one.select(*query, "__related", "__best.*").withColumn("__cited", F.when(F.size("__related") > 0, F.col("__related")).otherwise(F.array(cited)))
    here = label(F.col("file_path"), F.col("start_line"), F.col("end_line"))
    lines, rows, brief = relevant_lines(F.col("chunk_text")), filled_lines(F.col("chunk_text")), summary(F.col("chunk_text"))
    detail = F.when(F.size(lines) > 0, F.concat(F.lit("The retrieved chunk mentions "), F.array_join(F.slice(lines, 1, 2), " "))).otherwise(brief)
    subject = F.concat(F.lit("`"), F.coalesce(F.when(F.col("symbol_name") != "", F.col("symbol_name")), F.col("file_path")), F.lit("`"))
    descriptor = (
        F.when(F.col("asks_class"), F.concat(subject, F.lit(" class"))).when(F.col("asks_method"), F.concat(subject, F.lit(" method")))
        .when(F.col("asks_function"), F.concat(subject, F.lit(" function"))).when(F.col("asks_configuration"), F.lit("configuration"))
        .otherwise(F.lit("relevant implementation"))
    )
    joined = F.array_contains("tokens", "integration") & (F.size("__cited") > 1)
    first, second = (label(c["file_path"], c["start_line"], c["end_line"]) for c in (F.element_at("__cited", 1), F.try_element_at("__cited", F.lit(2))))
    tick = F.lit("`")
    definition = F.when(
        joined, F.concat(F.lit("The strongest implementation for "), descriptor, F.lit(" appears in `"), first, F.lit("` and `"), second, F.lit("`. "), detail)
    ).otherwise(F.concat(F.lit("The "), descriptor, F.lit(" is defined in `"), here, F.lit("`. "), detail))
    prop = F.regexp_extract("chunk_text", r'"(codeSpa\.[^"]+)"\s*:', 1)
    configuration = F.when(
        (prop != "") | F.contains("chunk_text", F.lit("contributes")),
        F.concat(
            F.lit("Settings are declared in `"), here, F.lit("` under `contributes.configuration.properties`"),
            F.when(prop != "", F.concat(F.lit(", including `"), prop, tick)).otherwise(F.lit("")), F.lit(". "), brief,
        ),
    ).otherwise(F.concat(F.lit("The relevant configuration is in `"), here, F.lit("`. "), brief))
    generic = F.concat(F.lit("The strongest grounded match is in `"), here, F.lit("`: "), brief)
    licence = F.get(
        F.filter(
            F.transform(
                rows,
                lambda x, i: F.when(F.contains(F.lower(x), F.lit("rights reserved")), without_markdown(x)).when(
                    F.contains(F.lower(x), F.lit("license")) & (i + 1 < F.size(rows)), without_markdown(F.get(rows, i + 1))
                ),
            ),
            lambda x: x.isNotNull(),
        ),
        F.lit(0),
    )
    support = F.transform(F.filter(rows, lambda x: F.lower(x).rlike("report issues|feature requests|contact support")), without_markdown)
    headings = F.transform(F.filter(rows, lambda x: x.startswith("### ")), without_markdown)
    documentation_answer = (
        F.when(F.col("asks_license") & (licence != ""), F.concat(F.lit("The repo lists `"), licence, F.lit("` in `"), here, F.lit("`.")))
        .when(F.col("asks_support") & (F.size(support) > 0), F.concat(F.lit("Users can use `"), F.array_join(F.slice(support, 1, 2), "` and `"), F.lit("`.")))
        .when(F.col("asks_features") & (F.size(headings) >= 2), F.concat(F.lit("The README highlights `"), F.get(headings, F.lit(0)), F.lit("` and `"), F.get(headings, F.lit(1)), F.lit("`.")))
        .when(F.size(lines) > 0, F.concat(F.lit("Based on `"), here, F.lit("`, "), F.array_join(F.slice(lines, 1, 3), " ")))
        .otherwise(generic)
    )
    text = F.when(F.col("asks_configuration"), configuration).when(F.col("asks_documentation"), documentation_answer).when(F.col("asks_definition"), definition).otherwise(generic)
    is_definition = F.col("asks_definition") & ~F.col("asks_configuration") & ~F.col("asks_documentation")
    citations = F.when(is_definition, F.slice("__cited", 1, F.when(joined, 2).otherwise(1))).otherwise(F.array(cited))
    ok = enough_evidence()
    return best.select(
        *query, F.when(ok, text).otherwise(UNKNOWN).alias("answer"), F.when(ok, citations).otherwise(F.slice(citations, 1, 0)).alias("citations")
    )


def prompt_blocks(retrieved: DataFrame, query: Sequence[str]) -> DataFrame:
    """``query..., blocks``: the ranked chunks as numbered, labelled blocks of one text. Up to the retrieved number per question."""
    place = label(F.col("file_path"), F.col("start_line"), F.col("end_line"))
    block = F.concat(F.lit("[C"), F.col("rank").cast("string"), F.lit("] "), place, F.lit("\n"), F.col("chunk_text"))
    parts = F.array_sort(F.collect_list(F.struct("rank", block.alias("b"))))
    return retrieved.groupBy(*query).agg(F.array_join(F.transform(parts, lambda p: p["b"]), "\n---\n").alias("blocks"))
