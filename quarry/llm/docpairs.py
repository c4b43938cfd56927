"""Problem 1: functions paired with their documentation.

Each chunk is parsed into a syntax tree once, inside Arrow batches (``syntax``), and its function nodes are visited:
a node gives the comment right above it, the string that opens its body and its range of lines. Only descriptions and
keys leave that pass. A function then meets the comment above it by the line it starts on (a comment that ends a
neighbouring chunk) or by its declaration and the lines where it can be (a node with a comment inside an enclosing
chunk, whose text was stripped).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.doctext import declaration_key, describe, nearest
from quarry.llm.syntax import Function, Tree, parse
from quarry.session import spread

#: The symbol types of functions and methods.
FUNCTION_TYPES = ("function", "method", "function_declaration", "method_declaration", "method_definition", "function_definition")
#: Words that say nothing beyond a name.
FILLERS = ("a", "an", "the", "this", "that", "is", "of", "for", "to", "and", "or", "it", "function", "method", "routine", "helper", "implements", "implementation", "does", "with")

_EVENT = (
    "repo_id string, file_path string, key string, kind string, symbol_name string, symbol_type string, "
    "start_line int, end_line int, low int, high int, description string"
)


def _own(tree: Tree, text: str) -> Function | None:
    """The function node that a chunk of one function begins with: nothing but comments stands before it."""
    if not tree.functions:
        return None
    node = tree.functions[0]
    before = text.split("\n", node.first)[: node.first]
    return node if node.first == 0 or all(not x.strip() or x.lstrip()[:1] in "/*#-=@[" for x in before) else None


def _events(batches: Iterator[pd.DataFrame], window: int, step: int) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in _EVENT.split(", ")]
    for pdf in batches:
        out = []
        for repo, path, language, start, end, text, name, kind in zip(*(pdf[c] for c in pdf.columns)):
            start = 1 if pd.isna(start) else int(start)
            end = start if pd.isna(end) else int(end)
            slack = max(0, end - start - text.count("\n"))  # blank lines that were stripped, on whichever side
            tree, lines = parse(text, language or ""), text.split("\n")
            if kind in FUNCTION_TYPES:
                node = _own(tree, text)
                if node is not None:
                    inside = describe(node.literal.split("\n"), marked=False) if node.literal else None
                    at = start + node.line
                    last = end if node.last + 1 >= len(lines) else start + node.last
                    shared = (name, kind, start, last, at, at, inside)
                    out.append((repo, path, f"L{start}", "F", *shared))
                    out.append((repo, path, "D" + declaration_key(lines[node.line]), "F", *shared))
                if end - start + 1 >= window:
                    out.append((repo, path, f"L{start + step}", "S", name, kind, start, end, None, None, None))
            for node in tree.functions:
                if node.above and (said := nearest(node.above)):
                    at = start + node.line
                    out.append((repo, path, "D" + declaration_key(lines[node.line]), "C", None, None, None, None, at, at + slack, said))
            if tree.tail and (said := nearest(tree.tail)):
                out.append((repo, path, f"L{end + 1}", "C", None, None, None, None, 0, 1 << 30, said))
        yield pd.DataFrame(out, columns=names)


def documented_functions(chunks: DataFrame, window: int = 80, overlap: int = 20) -> DataFrame:
    """``repo_id, file_path, symbol_name, symbol_type, start_line, end_line, description`` of documented functions.

    One row per function or method with real documentation, above it or opening its body (the latter wins);
    ``start_line, end_line`` are those of its first row. A row that continues another one of the same symbol,
    ``window - overlap`` lines later, is no function of its own. Rows of null or empty text, null repo, path or
    symbol name, and rows that begin with no function node, are passed over; repeated rows count once; texts of null
    language are read as ones of braces.
    """
    needed = ["repo_id", "file_path", "language", "start_line", "end_line", "chunk_text", "symbol_name", "symbol_type"]
    source = chunks.select(*needed).where((F.col("chunk_text") != "") & F.col("repo_id").isNotNull() & F.col("file_path").isNotNull())

    def events(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _events(batches, window, window - overlap)

    def of(kind: str, *columns: str):
        return F.when(F.col("kind") == kind, F.struct(*columns))

    met = (
        spread(source).mapInPandas(events, _EVENT)
        .groupBy("repo_id", "file_path", "key")
        .agg(
            F.collect_set(of("F", "symbol_name", "symbol_type", "start_line", "end_line", "low", "description")).alias("functions"),
            F.collect_set(of("S", "symbol_name", "symbol_type")).alias("continued"),
            F.collect_set(of("C", "low", "high", "description")).alias("comments"),
        )
        .where(F.size("functions") > 0)
        .select("repo_id", "file_path", "key", F.explode("functions").alias("f"), "continued", "comments")
    )
    continues = F.exists("continued", lambda s: (s["symbol_name"] == F.col("f.symbol_name")) & (s["symbol_type"] == F.col("f.symbol_type")))
    above = F.filter("comments", lambda c: F.col("f.low").between(c["low"], c["high"]))
    longest = F.array_max(F.transform(above, lambda c: F.struct(F.char_length(c["description"]).alias("n"), c["description"].alias("d"))))["d"]
    functions = (
        met.select("repo_id", "file_path", "f.*", continues.alias("continues"), longest.alias("above"))
        .where(F.col("symbol_name").isNotNull())
        .groupBy("repo_id", "file_path", "symbol_name", "symbol_type", "start_line")
        .agg(
            F.max("end_line").alias("end_line"), F.bool_or("continues").alias("continues"),
            F.max("description").alias("inside"), F.max_by("above", F.char_length("above")).alias("above"),
        )
    )
    spaced = F.regexp_replace("symbol_name", r"(?<=[\p{Ll}\d])(?=\p{Lu})|[^\p{L}]+", " ")
    said = F.split(F.lower(F.regexp_replace(F.col("description"), r"[^\p{L}]+", " ")), " ")
    name_words = F.concat(F.split(F.lower(spaced), " "), F.array(F.lower("symbol_name"), F.lit("")), F.array(*map(F.lit, FILLERS)))
    says_more = F.size(F.array_except(said, F.concat(name_words, F.transform(name_words, lambda w: F.concat(w, F.lit("s")))))) >= 2
    return (
        functions.where(~F.col("continues"))
        .withColumn("description", F.coalesce("inside", "above"))
        .where(F.col("description").isNotNull() & says_more)
        .select("repo_id", "file_path", "symbol_name", "symbol_type", "start_line", "end_line", "description")
    )


def code_pairs(chunks: DataFrame, documented: DataFrame, window: int = 80, overlap: int = 20) -> DataFrame:
    """``documented`` with ``code``, the whole function, and its ``end_line``, joined from all windows of it."""
    step = window - overlap
    rows = chunks.where(F.col("symbol_type").isin(*FUNCTION_TYPES)).select(
        "repo_id", "file_path", "symbol_name", "symbol_type", F.col("start_line").alias("w_start"), F.col("end_line").alias("w_end"), "chunk_text"
    )
    keys = ["repo_id", "file_path", "symbol_name", "symbol_type"]
    behind = F.col("w_start") - F.col("start_line")
    joined = documented.drop("end_line").join(rows, keys).where((behind >= 0) & (behind % step == 0))
    # a window belongs to the last function of its name that starts at or before it; repeated rows meet here
    owned = joined.groupBy(*keys, "w_start").agg(F.max(F.struct("start_line", "description", "w_end", "chunk_text")).alias("o"))
    whole = owned.select(*keys, "w_start", "o.*").groupBy(*keys, "start_line").agg(
        F.first("description").alias("description"), F.max("w_end").alias("end_line"), F.array_sort(F.collect_list(F.struct("w_start", "chunk_text"))).alias("parts")
    )
    lines = F.transform(
        "parts", lambda p, i: F.when(i == 0, p["chunk_text"]).otherwise(F.array_join(F.slice(F.split(p["chunk_text"], "\n"), overlap + 1, window), "\n"))
    )
    return whole.select(*keys, "start_line", "end_line", F.array_join(lines, "\n").alias("code"), "description")
