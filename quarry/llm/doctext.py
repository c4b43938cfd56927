"""Reading documentation comments: their words, and whether they document anything."""

from __future__ import annotations

import re
from hashlib import md5

#: Words of description that real documentation has at least.
LEAST_WORDS = 4

_MARKERS = re.compile(r"^\s*(?:/\*+[!<]?|\*+/|\*(?!/)+|//[/!]*<?|#+!?|--+\[*|<!--|=begin|=end|;+|%+)?[ \t]*")
_ENDING = re.compile(r"\s*(?:\*+/|-->|\]\]|=end)\s*$")
_TAG = re.compile(r"^\s*(?:[@\\](?!brief|summary|description|desc\b|details|short)\w+|:\w+[^:]*:|#\s*@\w+)", re.I)
_KEPT_TAG = re.compile(r"^\s*[@\\](?:brief|summary|description|desc|details|short)\b[ \t]*", re.I)
_SECTION = re.compile(
    r"^\s*(?:args|arguments|params|parameters|returns?|raises|throws|yields?|examples?|attributes|keyword args|"
    r"parameter|rückgabe|paramètres|retourne|parámetros|devuelve)\s*:?\s*$|^\s*(?:returns?|raises|throws|yields)\s*:",
    re.I,
)
_DIRECTIVE = re.compile(
    r"^\s*(?:eslint\b|@ts-|ts-(?:ignore|expect|nocheck)|prettier-|nolint\b|noqa\b|pylint\b|flake8\b|mypy\b|pyright\b|type:\s*ignore|rubocop\b|"
    r"clang-|go:\w+|\+build\b|istanbul\b|c8\b|v8\b|noinspection\b|nosec\b|nosonar\b|pragma\b|codecov|coverage:|jshint\b|jslint\b|tslint\b|"
    r"biome-ignore|deno-|@formatter|checkstyle|spotless|swiftlint|ktlint|lint:|cspell|spell-?checker|region\b|endregion\b|-\*-|vim:|"
    r"frozen_string_literal|sourcemappingurl|fmt:|isort:|yapf:|black:|steep:|sorbet\b|typed:|ignore-)",
    re.I,
)
_NOTICE = re.compile(
    r"copyright\b|\(c\)\s|©|spdx-|licen[sc]ed under|licen[sc]e (?:file|terms)|all (?:other )?rights (?:are )?reserved|permissive licen[sc]e|"
    r"(?:^|[.:;,!>-]\s*)(?:please )?do not (?:edit|modify|change)|nicht (?:bearbeiten|ändern)|ne pas modifier|no (?:lo )?(?:modifi|edit)|"
    r"auto(?:matically)?[- ]?generated|code generated by|machine[- ]written|changes will be lost|@generated|"
    r"(?:automatisch .{0,60}?(?:erzeugt|generiert))|(?:produit|généré) automatiquement|generado automáticamente",
    re.I,
)
_UNFINISHED = re.compile(r"\b(?:todo|fixme|xxx|tbd|hack|wip)\b\s*[:(-]?[^.!?\n]*(?:[.!?]|$)", re.I)
_STUB = re.compile(
    r"^\W*(?:(?:please )?(?:describe|document) (?:me|this|it|here)|add (?:a |the |some )?(?:description|documentation|docs?|comment)|"
    r"(?:no|missing) (?:description|documentation|docs)|(?:description|documentation) (?:goes |to be |of (?:the|this) (?:function|method))|"
    r"write (?:the )?doc|auto-?generated method stub|insert (?:a )?description|lorem ipsum|n/?a\b|tbd\b|placeholder)",
    re.I,
)
_CODE = re.compile(
    r"[;{}]\s*$|^\s*(?:return|if|elif|else|for|while|switch|case|try|catch|except|throw|raise|import|from|const|let|var|def|func|function|"
    r"class|public|private|protected|static|end|break|continue|await|async|yield|print|package|using|require)\b(?=.*[(){}\[\]=:;'\"])|"
    r"^\s*[\w.$@\[\]<>*&:, ]*[\w\]>]\s*(?:[-+*/|&%]|:)?=(?!=)\s*\S|^\s*[\w.$:>-]+\(.*\)\s*[;,]?\s*$|^\s*(?:return|end|else|break|continue)\s*[\w.]*\s*$|=>\s*\S|^\s*[)\]}]"
)
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")


def describe(lines: list[str], marked: bool = True) -> str | None:
    """The description in a comment's lines, on one line, or None if it isn't real documentation.

    Markers, parameter and return parts, tool directives, separators, commented-out code and unfinished notes
    are left out; licences and do-not-edit notices make the whole comment none.
    """
    kept: list[str] = []
    for raw in lines:
        line = _ENDING.sub("", raw)
        line = (_MARKERS.sub("", line, count=1) if marked else line).strip()
        line = _KEPT_TAG.sub("", line)
        if _TAG.match(line) or _SECTION.match(line):
            break
        if not line or _DIRECTIVE.match(line) or not _WORD.search(line) or _CODE.search(line):
            continue
        if re.match(r"^[=~*#_+-]{3,}.*[=~*#_+-]{3,}$", line):
            continue
        kept.append(line)
    text = " ".join(kept)
    if _NOTICE.search(text) or _STUB.match(text):
        return None
    text = re.sub(r"\s+", " ", _UNFINISHED.sub(" ", text)).strip()
    return text if len(_WORD.findall(text)) >= LEAST_WORDS else None


def is_directive(lines: list[str]) -> bool:
    """Whether a comment consists of tool directives only."""
    bare = [_MARKERS.sub("", _ENDING.sub("", x), count=1).strip() for x in lines]
    bare = [x for x in bare if x]
    return bool(bare) and all(_DIRECTIVE.match(x) for x in bare)


def nearest(units: list[list[str]]) -> str | None:
    """The description in the comment nearest to the declaration; directives in between don't count."""
    for unit in reversed(units):
        if not is_directive(unit):
            return describe(unit)
    return None


def declaration_key(line: str) -> str:
    """The whole of a declaration's first line, without white space, as a short key."""
    return md5(re.sub(r"\s+", "", line).encode("utf-8", "surrogatepass")).hexdigest()
