"""Problem 4: duplicates hidden by formatting, collapsed and counted.

A text is reduced to its letters and digits, compatibility characters composed and case folded; a JSON or YAML file to its fields in a canonical order.
The reduced text is hashed to 128 bits. A second, independent 64-bit hash and the length are part of the key, so
that two different texts count as one only if all of them collide. Counts combine on the map side.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.session import spread

#: Letters and digits that a text needs to be compared by them alone; shorter ones must be equal as they are.
LEAST = 40
#: Languages whose whole files are compared field by field.
FIELD_LANGUAGES = ("json", "yaml")

KEY = ["content_hash", "content_check", "content_length"]


def fold(text: str) -> str:
    """The letters and digits of ``text`` in their order, in compatibility composition and case folded.

    Composed and decomposed accents, full-width forms and ligatures are so the same.
    """
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return "".join(filter(str.isalnum, text.casefold()))


class _Pairs(list):
    """The fields of a mapping."""


def _render(node: object) -> str:
    if isinstance(node, _Pairs):
        return "{" + ",".join(sorted(f"{fold(str(k))}:{_render(v)}" for k, v in node)) + "}"
    if isinstance(node, list):
        return "[" + ",".join(map(_render, node)) + "]"
    return fold("null" if node is None else str(node))


_QUOTED = re.compile(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'", re.S)
_KEYED = re.compile(r"((?:\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'|[^\s#\[\]{},\"'&*!|>-][^#\n]*?|-[^\s#][^#\n]*?))\s*:(?:\s+|$)(.*)$", re.S)


def _no_comment(line: str) -> str:
    if "#" not in line:
        return line
    masked = _QUOTED.sub(lambda m: "x" * len(m.group()), line)
    found = re.search(r"(?:^|\s)#", masked)
    return line[: found.start()] if found else line


def _flow(text: str, at: int) -> tuple[object, int]:
    """A flow collection or scalar of YAML from ``at``, and where it ends."""
    while at < len(text) and text[at].isspace():
        at += 1
    if at < len(text) and text[at] in "[{":
        closing, node = {"[": "]", "{": "}"}[text[at]], _Pairs() if text[at] == "{" else []
        at += 1
        while True:
            while at < len(text) and (text[at].isspace() or text[at] == ","):
                at += 1
            if at >= len(text):
                raise ValueError("flow collection isn't closed")
            if text[at] == closing:
                return node, at + 1
            value, at = _flow(text, at)
            if closing == "}":
                while at < len(text) and text[at].isspace():
                    at += 1
                if at < len(text) and text[at] == ":":
                    key = value
                    value, at = _flow(text, at + 1)
                    node.append((key, value))
                else:
                    node.append((value, None))
            else:
                node.append(value)
    quoted = _QUOTED.match(text, at)
    if quoted:
        return quoted.group()[1:-1], quoted.end()
    plain = re.compile(r"(?:[^,\[\]{}:]|:(?!\s|$))*").match(text, at)
    return plain.group().strip() or None, plain.end()


def _scalar(first: str, lines: list[tuple[int, str]], i: int, indent: int) -> tuple[object, int]:
    """The value that begins with ``first`` and may go on in the lines from ``i``, indented deeper than ``indent``."""
    more = []
    if first[:1] in "[{" or first[:1] in "\"'" and not _QUOTED.match(first):
        while first[:1] in "[{" and _open(" ".join([first, *more])) or first[:1] in "\"'" and not _QUOTED.match("\n".join([first, *more])):
            if i >= len(lines):
                raise ValueError("value isn't closed")
            more.append(lines[i][1])
            i += 1
        if first[0] in "[{":
            return _flow(" ".join([first, *more]), 0)[0], i
        return "\n".join([first, *more])[1:-1], i
    while i < len(lines) and lines[i][0] > indent:
        more.append(lines[i][1])
        i += 1
    quoted = _QUOTED.fullmatch(first.strip())
    if first[:1] in "|>" and re.fullmatch(r"[|>][+-]?\d?[+-]?", first.strip()):
        first = ""
    return (first.strip()[1:-1] if quoted and not more else "\n".join([first, *more])), i


def _open(text: str) -> bool:
    bare = _QUOTED.sub("", text)
    return bare.count("[") + bare.count("{") > bare.count("]") + bare.count("}")


def _block(lines: list[tuple[int, str]], i: int, indent: int) -> tuple[object, int]:
    """The block node whose lines start at ``indent``."""
    if re.match(r"-(?:\s|$)", lines[i][1]):
        items: list[object] = []
        while i < len(lines) and lines[i][0] == indent and re.match(r"-(?:\s|$)", lines[i][1]):
            rest = lines[i][1][1:].lstrip()
            if not rest:
                i += 1
                if i < len(lines) and lines[i][0] > indent:
                    node, i = _block(lines, i, lines[i][0])
                else:
                    node = None
            elif _KEYED.match(rest) or re.match(r"-\s", rest):
                inner = indent + len(lines[i][1]) - len(rest)
                lines[i] = (inner, rest)
                node, i = _block(lines, i, inner)
            else:
                node, i = _scalar(rest, lines, i + 1, indent)
            items.append(node)
        return items, i
    pairs = _Pairs()
    while i < len(lines) and lines[i][0] == indent:
        keyed = _KEYED.match(lines[i][1])
        if not keyed:
            raise ValueError("neither field nor item")
        key, value = keyed.group(1), keyed.group(2).strip()
        i += 1
        if not value:
            if i < len(lines) and (lines[i][0] > indent or lines[i][0] == indent and re.match(r"-(?:\s|$)", lines[i][1])):
                node, i = _block(lines, i, lines[i][0]) if _KEYED.match(lines[i][1]) or lines[i][1][0] == "-" else _scalar("", lines, i, indent)
            else:
                node = None
        else:
            node, i = _scalar(value, lines, i, indent)
        pairs.append((key, node))
    if i < len(lines) and lines[i][0] > indent:
        raise ValueError("indentation doesn't fit")
    return pairs, i


def _yaml(text: str) -> object:
    lines: list[tuple[int, str]] = []
    for raw in re.split(r"\r\n|\n|\r", text):
        line = _no_comment(raw).rstrip()
        if not line.strip() or line.startswith(("---", "...", "%")) and len(line.strip("-. ")) == 0:
            continue
        body = line.lstrip(" \t ")
        lines.append((len(line) - len(body), body))
    if not lines:
        raise ValueError("empty")
    if lines[0][1][0] in "[{":
        return _flow(" ".join(x for _, x in lines), 0)[0]
    node, i = _block(lines, 0, lines[0][0])
    if i < len(lines):
        raise ValueError("lines are left")
    return node


def fields(text: str | None, language: str) -> str | None:
    """The canonical form of a JSON or YAML file, or None if it can't be read as one."""
    if not text:
        return None
    try:
        if language == "json":
            return _render(json.loads(text, object_pairs_hook=_Pairs, parse_int=str, parse_float=str, parse_constant=str))
        try:
            return _render(_yaml(text))
        except ValueError:  # a chunk's text is stripped, so its first line may have lost its indentation
            first, _, rest = text.partition("\n")
            depth = min((len(x) - len(x.lstrip()) for x in rest.split("\n") if x.strip()), default=0)
            return _render(_yaml(" " * depth + first + "\n" + rest))
    except (ValueError, RecursionError, IndexError):
        return None


def content_keys(chunks: DataFrame) -> DataFrame:
    """``id, content_hash, content_check, content_length, short`` of every row of ``chunks`` with id and text.

    Texts with fewer than ``LEAST`` letters and digits are keyed by the text as it is. A JSON or YAML chunk that
    starts at line 1 and is its file's only one is keyed by its fields, if it can be read, together with its
    language. Rows of null id or text don't come out. Texts are read once and don't move: both keys are made where
    a text is read, and which one counts is settled on keys. Only texts beyond ASCII and JSON and YAML go to Python.
    """
    text, named = F.col("chunk_text"), F.col("repo_id").isNotNull() & F.col("file_path").isNotNull()
    by_field = F.coalesce(F.col("language").isin(*FIELD_LANGUAGES), F.lit(False))
    rows = spread(chunks.select("id", "repo_id", "file_path", "language", "start_line", "chunk_text").where(F.col("id").isNotNull() & text.isNotNull()))

    @F.pandas_udf("plain string, fields string")
    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, languages in batches:
            plain = [fold(t) if t is not None else None for t in texts]
            yield pd.DataFrame({"plain": plain, "fields": [fields(t, x) if x is not None else None for t, x in zip(texts, languages)]}, dtype=object)

    at_first = by_field & named & (F.col("start_line") == 1)
    beyond = text.rlike(r"[^\x00-\x7F]")
    given = rows.withColumn("__read", read.asNondeterministic()(F.when(beyond | at_first, text), F.when(at_first, F.col("language"))))
    plain = F.coalesce("__read.plain", F.regexp_replace(F.lower(text), "[^a-z0-9]+", ""))
    folded = given.select("id", "repo_id", "file_path", "language", text, plain.alias("__plain"), F.col("__read.fields").alias("__fields"))

    def key(said: Column, short: Column) -> Column:
        return F.struct(F.unhex(F.md5(said)).alias("content_hash"), F.xxhash64(said).alias("content_check"), F.char_length(said).alias("content_length"), short.alias("short"))

    short = F.char_length("__plain") < LEAST
    said = F.when(short, F.concat(F.lit("="), text)).otherwise(F.col("__plain"))
    whole = F.when(F.col("__fields").isNotNull() & ~short, key(F.concat("language", F.lit("\n"), "__fields"), F.lit(False)))
    keyed = folded.select("id", "repo_id", "file_path", key(said, short).alias("by_text"), whole.alias("by_fields"))
    longer = chunks.where(by_field & (F.col("start_line") > 1)).select("repo_id", "file_path", F.lit(True).alias("__longer")).distinct()
    settled = keyed.join(longer, ["repo_id", "file_path"], "left").withColumn("k", F.when(F.col("__longer").isNull(), F.coalesce("by_fields", "by_text")).otherwise(F.col("by_text")))
    return settled.select("id", "k.*")


def contents(keys: DataFrame) -> DataFrame:
    """One row per content: its key, ``short``, ``id`` (smallest), ``n_copies`` distinct ids and ``n_rows`` rows.

    Ids are counted after an aggregation by content and id, which spreads a hot content over all tasks, and then
    by content, combined on the map side.
    """
    ids = keys.groupBy(*KEY, "short", "id").agg(F.count(F.lit(1)).alias("n"))
    return ids.groupBy(*KEY, "short").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n_copies"), F.sum("n").alias("n_rows"))


def copies(keys: DataFrame) -> DataFrame:
    """``id_a, id_b``: the smallest id of each content of several ids, with each other id of it.

    Contents of fewer than ``LEAST`` letters and digits are left out. The classes have one row each, so adaptive
    execution splits the other side of the join where one class holds a large share of all rows.
    """
    ids = keys.where(~F.col("short")).select(*KEY, "id").distinct()
    classes = ids.groupBy(*KEY).agg(F.min("id").alias("id_a"), F.count(F.lit(1)).alias("__n")).where(F.col("__n") > 1).drop("__n")
    return ids.join(classes, KEY).where(F.col("id") != F.col("id_a")).select("id_a", F.col("id").alias("id_b"))
