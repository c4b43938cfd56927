"""Line windows, uncovered regions, blocks and symbols of source texts."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import lines_of, stripped

#: The languages whose symbols are found by line patterns, the shapes of declarations in them, and names
#: that are no methods.
SCRIPT_LANGUAGES = ("javascript", "jsx", "typescript", "tsx")
SCRIPT_SYMBOLS = {
    "class": r"^\s*(?:export\s+default\s+|export\s+)?class\s+([A-Za-z_][A-Za-z0-9_]*)\b",
    "function": r"^\s*(?:export\s+)?(?:async\s+)?function\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(",
    "arrow": r"^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(?:async\s+)?(?:\([^)]*\)|[A-Za-z_][A-Za-z0-9_]*)\s*=>",
    "method": r"^\s*(?:public|private|protected)?\s*(?:static\s+)?(?:async\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*\(",
}
NO_METHODS = ("catch", "constructor", "for", "if", "switch", "while")
#: Fixed value: white space in these shapes, as Unicode has it.
SCRIPT_SPACE = r"[\s\x0B\x1C-\x1F\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
REGION = "struct<symbol_type:string,symbol_name:string,first:int,last:int>"


def line_windows(df: DataFrame, text: str, size: int, overlap: int, first_line: str | None = None) -> DataFrame:
    """``df`` without ``text``, once per window: ``start_line, end_line, window_text``.

    Windows of ``size`` lines begin every ``size - overlap`` lines; the last one ends with the text. The text of a
    window is stripped, its line numbers aren't moved; blank windows, and null or empty texts, don't come out.
    """
    if size < 1 or overlap < 0:
        raise ValueError("size must be positive and overlap not negative")
    step = max(1, size - overlap)
    kept = [F.col(f"`{c}`") for c in df.columns if c != text]
    base = (F.col(first_line) if first_line else F.lit(1)) - 1
    n = F.size("__lines")
    last = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(float(step))).cast("int"))
    # the outer form keeps the optimizer from cutting texts into lines once more for a test of emptiness
    cut = df.select(*kept, base.alias("__base"), lines_of(F.col(text)).alias("__lines")).where(F.col(text) != "").withColumn("__k", F.explode_outer(F.sequence(F.lit(0), last)))
    begin = F.col("__k") * step
    return cut.select(
        *kept,
        (F.col("__base") + begin + 1).cast("int").alias("start_line"),
        (F.col("__base") + F.least(n, begin + size)).cast("int").alias("end_line"),
        stripped(F.array_join(F.slice("__lines", begin + 1, F.lit(size)), "\n")).alias("window_text"),
    ).where(F.col("window_text") != "")


def uncovered(regions: DataFrame, keys: Sequence[str], start: str, end: str, last_line: str | None = None) -> DataFrame:
    """``keys..., start_line, end_line`` of the maximal runs of lines that no region of a file covers.

    ``regions`` has the line ranges of a file; the gaps come from a running maximum, no line is spelt out. The run
    after the last region ends at the greatest ``last_line`` of the file's rows, those without a range included;
    without that column there is no such run. Files without any range have no runs.
    """
    ranges = regions.where(F.col(start).isNotNull() & F.col(end).isNotNull()).select(*keys, F.col(start).alias("__from"), F.col(end).alias("__to"))
    if last_line:  # a region of no line behind the last one closes the run
        known = F.count_if(F.col(start).isNotNull() & F.col(end).isNotNull()) > 0
        closed = regions.groupBy(*keys).agg(known.alias("__known"), F.max(last_line).alias("__last")).where(F.col("__known") & F.col("__last").isNotNull())
        ranges = ranges.unionByName(closed.select(*keys, (F.col("__last") + 1).alias("__from"), F.col("__last").alias("__to")))
    before = Window.partitionBy(*keys).orderBy("__from", "__to").rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranges.withColumn("__reach", F.coalesce(F.max("__to").over(before), F.lit(0)))
        .where(F.col("__from") > F.col("__reach") + 1)
        .select(*keys, (F.col("__reach") + 1).alias("start_line"), (F.col("__from") - 1).alias("end_line"))
    )


def _braces(lines: Column) -> Column:
    """Per line how many more braces open than close in it, and whether one opens."""

    def counted(x: Column, brace: str) -> Column:
        return F.length(x) - F.length(F.replace(x, F.lit(brace), F.lit("")))

    return F.transform(lines, lambda x: F.struct((counted(x, "{") - counted(x, "}")).alias("d"), F.contains(x, F.lit("{")).alias("o")))


def _block_end(braces: Column, first: Column) -> Column:
    """The first line from ``first`` on which all braces opened since are closed, else the last line."""
    zero = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("opened"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(s: Column, x: Column) -> Column:
        depth, opened, at = s["depth"] + x["d"], s["opened"] | x["o"], s["at"] + 1
        return F.struct(depth.alias("depth"), opened.alias("opened"), at.alias("at"), F.when((s["end"] == 0) & opened & (depth <= 0), at).otherwise(s["end"]).alias("end"))

    end = F.aggregate(F.slice(braces, first, F.size(braces)), zero, step)["end"]
    return F.when(end == 0, F.size(braces)).otherwise(first + end - 1)


def block_ends(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """``keys..., n_lines, block_end``: the first line on which all braces opened so far are closed, else the last line.

    Braces are counted by lines, in comments and strings too. Folded inside the row: a text is never spelt out.
    """
    found = df.select(*keys, _braces(lines_of(F.col(text))).alias("__braces")).where(F.size("__braces") > 0)
    return found.select(*keys, F.size("__braces").alias("n_lines"), _block_end(F.col("__braces"), F.lit(1)).alias("block_end"))


def with_script_regions(df: DataFrame, lines: str, regions: str) -> DataFrame:
    """``df`` with the array ``regions`` of script symbols, ``symbol_type, symbol_name, first, last``, in order of lines.

    Inside the block of a class lines count as methods, outside as functions; classes count anywhere. Nothing leaves
    the row. Null lines have no regions.
    """

    def named(line: Column, shape: str) -> Column:
        return F.regexp_extract(line, SCRIPT_SYMBOLS[shape].replace(r"\s", SCRIPT_SPACE), 1)

    def mark(line: Column, i: Column) -> Column:
        method = named(line, "method")
        function = F.coalesce(F.nullif(named(line, "function"), F.lit("")), named(line, "arrow"))
        return F.struct((i + 1).alias("first"), named(line, "class").alias("class"), function.alias("function"), F.when(method.isin(*NO_METHODS), "").otherwise(method).alias("method"))

    def region(kind: str, name: str):
        def make(m: Column) -> Column:
            return F.struct(F.lit(kind).alias("symbol_type"), m[name].alias("symbol_name"), m["first"].alias("first"), _block_end(F.col("__braces"), m["first"]).alias("last"))

        return make

    def within(m: Column) -> Column:
        return F.exists("__classes", lambda c: m["first"].between(c["first"], c["last"]))

    marked = df.withColumns({"__braces": _braces(F.col(lines)), "__marks": F.transform(lines, mark)})
    classes = marked.withColumn("__classes", F.transform(F.filter("__marks", lambda m: m["class"] != ""), region("class", "class")))
    methods = F.transform(F.filter("__marks", lambda m: (m["method"] != "") & within(m)), region("method", "method"))
    functions = F.transform(F.filter("__marks", lambda m: (m["function"] != "") & ~within(m)), region("function", "function"))
    keyed = F.transform(F.concat("__classes", methods, functions), lambda r: F.struct(r["first"].alias("a"), r["last"].alias("b"), r.alias("r")))
    return classes.withColumn(regions, F.transform(F.array_sort(keyed), lambda k: k["r"])).drop("__braces", "__marks", "__classes")


def script_symbols(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """``keys..., symbol_type, symbol_name, start_line, end_line`` of the classes, methods and functions of script texts."""
    found = with_script_regions(df.select(*keys, lines_of(F.col(text)).alias("__lines")), "__lines", "__regions")
    # the outer form keeps the optimizer from making all regions once more for a test of emptiness
    return found.select(*keys, F.inline_outer("__regions")).where(F.col("first").isNotNull()).withColumnsRenamed({"first": "start_line", "last": "end_line"})


_PYTHON_HEAD = re.compile(r"(?:async[ \t]+def|def|class)[ \t]+\w")


def _parsed(text: str) -> ast.Module | None:
    try:
        return ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def _cut_symbols(text: str) -> list[tuple[str, str, int, int]]:
    """Symbols of a text that doesn't parse as a whole: every header that parses, its block by indentation."""
    lines = re.split(r"\r\n|\r|\n", text)
    shown = text
    for quotes in ('"""', "'''"):
        if text.count(quotes) % 2 == 0:  # else it isn't known which side of them is a string
            shown = re.sub(f"{quotes}.*?{quotes}", lambda m: "0" + re.sub(r"[^\r\n]", "", m.group()), shown, flags=re.S)
    heads = [bool(_PYTHON_HEAD.match(x.lstrip())) for x in re.split(r"\r\n|\r|\n", shown)]
    out = []
    for i in (i for i, head in enumerate(heads) if head):
        for j in range(i, len(lines)):
            if j > i and heads[j]:
                break
            header = "\n".join([lines[i].lstrip(), *lines[i + 1 : j + 1]])
            whole = _parsed(header)
            tree = whole or _parsed(header + "\n pass")
            if tree is None:
                continue
            end, inner = j, None
            # a block ends before the first line that stands left of its body: a stripped first line has lost its own place
            for k in range(j + 1, len(lines)) if whole is None else ():
                indent = len(lines[k]) - len(lines[k].lstrip())
                if not lines[k].strip():
                    continue
                inner = indent if inner is None else inner
                if indent < inner or inner == 0 or i and indent <= len(lines[i]) - len(lines[i].lstrip()):
                    break
                end = k
            node = tree.body[0]
            out.append(("class" if isinstance(node, ast.ClassDef) else "function", node.name, i + 1, end + 1))
            break
    return out


def python_symbols(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """``keys..., symbol_type, symbol_name, start_line, end_line`` of all functions and classes of Python texts.

    Decorators don't belong to a symbol. A text that doesn't parse, such as a window that begins or ends inside a
    block, gives the symbols whose headers parse, as far as their blocks go in it. Null texts have no symbols.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                tree = _parsed(row[-1])
                if tree is None:
                    out += [(*row[:-1], *symbol) for symbol in _cut_symbols(row[-1])]
                    continue
                for node in ast.walk(tree):
                    if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                        out.append((*row[:-1], "class" if isinstance(node, ast.ClassDef) else "function", node.name, node.lineno, node.end_lineno))
            yield pd.DataFrame(out, columns=[*keys, "symbol_type", "symbol_name", "start_line", "end_line"])

    head = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, text).where(F.col(text).isNotNull()).mapInPandas(parse, f"{head}, symbol_type string, symbol_name string, start_line int, end_line int")


def latest_by_key(df: DataFrame, keys: Sequence[str], newest: Sequence[str]) -> DataFrame:
    """One row per key: that of the greatest ``newest`` columns, nulls first. An aggregation, so a hot key is combined early."""
    rest = [c for c in df.columns if c not in keys]
    order = [*newest, *[c for c in rest if c not in newest and not df.schema[c].dataType.simpleString().startswith("map")]]
    tail = [c for c in rest if c not in order]
    packed = F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(*[F.col(f"`{c}`") for c in order])) if order else F.first(F.struct(*tail))
    return df.groupBy(*keys).agg(packed.alias("__row")).select(*keys, *[F.col("__row").getField(c).alias(c) for c in rest])
