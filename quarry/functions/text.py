"""Text primitives as Spark columns. Null gives null, or an empty array where the result is an array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A raw token, the separators of identifiers, line ends, and what leads a markdown line.
RAW_TOKEN = r"[A-Za-z_][A-Za-z0-9_./-]*"
LINE_END = r"\r\n|[\n\r\u000B\f\u001C-\u001E\u0085\u2028\u2029]"
#: Fixed value: white space as Unicode has it, with the separators of files, groups, records and units.
WHITE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
MARKDOWN_LEAD = r"^[#*\-\s`>]+"


def _empty() -> Column:
    return F.array().cast("array<string>")


def raw_tokens(text: Column) -> Column:
    """Identifiers, words and paths of a text, in order, as written."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(RAW_TOKEN), F.lit(0)), _empty())


def identifier_parts(identifier: Column) -> Column:
    """Lower-case parts of an identifier, split at separators and camel-case humps, each once, in order."""
    humps = F.regexp_replace(identifier, "(?<=[a-z0-9])(?=[A-Z])", " ")
    return F.coalesce(F.array_distinct(F.filter(F.split(F.lower(humps), "[./_ -]+"), lambda p: p != "")), _empty())


def is_compound(token: Column) -> Column:
    """Whether a token has parts other than itself; the rest, most tokens of a text, needn't be taken apart."""
    return token.rlike("[./_-]|[a-z0-9][A-Z]")


def normalized_identifier(identifier: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(identifier), "[^a-z0-9]+", "")


def _with_parts(token: Column) -> Column:
    whole = F.array(F.lower(token))
    return F.when(is_compound(token), F.concat(whole, identifier_parts(token))).otherwise(whole)


def code_tokens(text: Column) -> Column:
    """The distinct lower-case tokens of a text together with the parts of each."""
    return F.array_distinct(F.flatten(F.transform(raw_tokens(text), _with_parts)))


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends, in one pass over the text."""
    return F.trim(text, F.lit(WHITE))


def lines_of(text: Column) -> Column:
    """Lines without their ends; a final line end begins no further line."""
    return F.filter(F.split(F.regexp_replace(text, f"(?:{LINE_END})\\z", ""), LINE_END), lambda x: text != "")


def filled_lines(text: Column) -> Column:
    """Stripped lines that aren't blank."""
    return F.filter(F.transform(F.coalesce(lines_of(text), _empty()), stripped), lambda x: x != "")


def without_markdown(line: Column) -> Column:
    """A line without leading heading, list, quote and code marks."""
    return stripped(F.regexp_replace(line, MARKDOWN_LEAD, ""))


def summary(text: Column, most: int = 220) -> Column:
    """All filled lines on one line if there are at most eight, else the first four; cut at ``most`` characters."""
    rows = filled_lines(text)
    said = F.array_join(F.when(F.size(rows) <= 8, rows).otherwise(F.slice(rows, 1, 4)), " ")
    return F.substring(F.when(said == "", F.lit("Relevant code chunk")).otherwise(said), 1, most)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """Lower-case ending of a file name with its dot; empty for names that only begin with one."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1))
