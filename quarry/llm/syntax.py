"""Syntax trees of source texts, as far as functions, their comments and their bodies need them.

Python texts are parsed by ``ast``; a window that ends inside a block is completed first, and one that still doesn't
parse gives the functions whose headers do. Languages of braces and Ruby are read token by token into a tree of
blocks: a statement that a block or its end follows is a node, and one whose head has the shape of a function is a
function. Comments belong to the node they stand right above, with only blank lines and decorations between.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from dataclasses import dataclass, field


@dataclass(slots=True)
class Function:
    """Lines count from 0: the first of its decorations, that of its declaration, its last one within the text."""

    name: str
    first: int
    line: int
    last: int
    above: list[list[str]] = field(default_factory=list)
    literal: str | None = None


@dataclass(slots=True)
class Tree:
    """Functions in order of lines, comments that end the text, and how it was read: whole, completed or headers."""

    functions: list[Function]
    tail: list[list[str]]
    how: str


_STRINGS = r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\''
_BRACE_TOKENS = {
    "go": re.compile(rf"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|{_STRINGS}|`[^`]*(?:`|\Z)|[{{}}()\[\];\n]"),
    "script": re.compile(rf"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|{_STRINGS}|`(?:\\.|[^`\\])*(?:`|\Z)|(?<=[=(,:!&|?\[])[ ]?/(?![*/])(?:\\.|\[(?:\\.|[^\]\n])*\]|[^/\\\n\[])+/|[{{}}()\[\];\n]"),
    "c": re.compile(rf"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|{_STRINGS}|(?m:^)[ \t]*#[^\n]*|[{{}}()\[\];\n]"),
}
#: Languages without functions.
NO_FUNCTIONS = ("json", "markdown", "text", "yaml")
#: Languages whose statements end with their line.
_BY_LINE = {"go": "go", "javascript": "script", "jsx": "script", "typescript": "script", "tsx": "script"}
_DECORATIONS = re.compile(r"(?:\s*(?:@[\w.]+(?:\s*\((?:[^()]|\([^()]*\))*\))?|\[\[[^\]]*\]\]|\[[A-Z]\w*[^\]]*\]|template\s*<[^{};]*?>(?=\s*(?:\n|$|[\w:])))(?=\s|$))+")
#: Words that begin statements that are no declarations of functions.
_NO_FUNCTION = re.compile(r"(?:if|for|while|switch|catch|else|do|try|return|throw|case|with|import|package|print|del|assert|select|defer|using|new|await|yield|finally|synchronized)\b")
_TYPE = re.compile(r"^[^(=]*\b(?:class|interface|enum|struct|namespace|union|module|trait)\s+[\w$:]+")
_ARROW = re.compile(r"([\w$#]+)\s*(?::[^=]*)?=\s*(?:async\b\s*)?(?:function\b|<[^()]*>\s*\(|\(|[\w$]+\s*=>)")
_CALLED = re.compile(r"([\w$#~]+)\s*(?:<[^<>()]*>)?\s*\(")
_BODILESS = re.compile(r"(?:[\w<>\[\],.?@&*:]+\s+)+[*&]?[\w$]+\s*(?:<[^<>()]*>)?\s*\([^=]*\)\s*(?:const|noexcept|override|throws [\w., ]+|:\s*[^=]+)?\s*")
_COMMENT = re.compile(r"//[^\n]*|/\*[\s\S]*?\*/")


def _function_name(head: str, language: str, body: bool) -> str | None:
    """The name of the function that a statement's head declares, or None."""
    text = head.strip()
    if not text or _NO_FUNCTION.match(text) or _TYPE.match(text):
        return None
    if language == "go":
        found = re.match(r"func\s*(?:\([^)]*\)\s*)?(\w+)", text)
        return found.group(1) if found else None
    if "=>" in text or re.search(r"=\s*(?:async\s+)?function\b", text):
        found = _ARROW.search(text)
        return found.group(1) if found else None
    if found := re.search(r"\bfunction\b\s*\*?\s*([\w$]+)", text):
        return found.group(1)
    called = _CALLED.search(text)
    if not called or "=" in text[: called.start()].replace("operator=", "").replace("==", ""):
        return None
    return called.group(1) if body or _BODILESS.fullmatch(text) else None


def _ends_statement(head: str, rest: str) -> bool:
    """Whether a line end between ``head`` and ``rest`` ends a statement."""
    return bool(head) and head[-1] not in ",=(+-*/&|<?:.\\" and not re.match(r"\s*(?:[{.)=?:&|+*,]|=>)", rest)


class _Lines:
    def __init__(self, text: str) -> None:
        self.text, self.starts = text, [0, *(m.end() for m in re.finditer("\n", text))]

    def of(self, at: int) -> int:
        return bisect_right(self.starts, at) - 1

    def begins(self, at: int) -> bool:
        """Whether only white space stands before ``at`` on its line."""
        return not self.text[self.starts[self.of(at)] : at].strip()


class _Units:
    """Comments that wait for a declaration; line comments without a line between them are one."""

    def __init__(self) -> None:
        self.all: list[list[str]] = []
        self.last = -2

    def add(self, text: str, line: int, single: bool) -> None:
        if single and self.last == line - 1:
            self.all[-1].append(text)
        else:
            self.all.append(text.split("\n"))
        self.last = line if single else -2

    def taken(self) -> list[list[str]]:
        out, self.all, self.last = self.all, [], -2
        return out


def _brace_tree(text: str, language: str) -> Tree:
    lines, units, found = _Lines(text), _Units(), []
    by_line = language in _BY_LINE
    stack: list[tuple[Function | None, int, int | None, list[list[str]]]] = []
    start, paren, opened = 0, 0, None
    close, begin = text.find("*/"), text.find("/*")
    if close >= 0 and (begin < 0 or close < begin):  # the text begins inside a comment
        units.add(text[: close + 2], 0, False)
        start = close + 2

    def declared(at: int, body: bool) -> Function | None:
        head = _COMMENT.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text[start:at])
        decorated = _DECORATIONS.match(head)
        skip = decorated.end() if decorated else 0
        name = _function_name(head[skip:], language, body)
        if name is None:
            return None
        first = start + len(head) - len(head.lstrip())
        line = start + skip + len(head[skip:]) - len(head[skip:].lstrip())
        function = Function(name, lines.of(first), lines.of(line), lines.of(max(at - 1, line)), units.taken())
        found.append(function)
        return function

    for m in _BRACE_TOKENS[_BY_LINE.get(language, "c")].finditer(text, start):
        token, at = m.group(), m.start()
        c = token[0]
        if c == "\n":
            if paren or start > at:
                continue
            if start == at or not (head := text[start:at].strip()):
                start = at + 1
            elif by_line and _ends_statement(head, text[at + 1 : at + 81]) and not _DECORATIONS.fullmatch(head):
                declared(at, "=>" in head)
                units.taken()
                start, opened = at + 1, None
        elif c == "(" or c == "[":
            paren += 1
        elif c == ")" or c == "]":
            paren = max(0, paren - 1)
        elif token.startswith(("//", "/*")):
            head = text[start:at]
            if paren == 0 and lines.begins(at) and head.strip() and not _DECORATIONS.fullmatch(head.rstrip()) and _ends_statement(head.rstrip(), text[m.end() : m.end() + 80]):
                declared(at, False)
                units.taken()
                start, opened, head = at, None, ""
            if paren == 0 and lines.begins(at) and (not head.strip() or _DECORATIONS.fullmatch(head.rstrip())):
                units.add(text[lines.starts[lines.of(at)] : m.end()], lines.of(at), token[1] == "/")
                if not head.strip():
                    start = m.end()
        elif c in "\"'`":
            if opened is not None and not _COMMENT.sub("", text[start:at]).strip() and re.match(r"[ \t]*;?[ \t]*(?:\n|$)", text[m.end() : m.end() + 40]):
                opened.literal = token[1:-1]
            opened = None
        elif c == ";":
            if paren == 0:
                if head := text[start:at].strip():
                    # a call, an assignment or a jump declares nothing
                    if "=>" in head or "(" in head and (units.all or not found) or "function" in head:
                        declared(at, "=>" in head)
                    units.taken()
                start, opened = at + 1, None
        elif c == "{":
            head = text[start:at].rstrip()
            if paren or head.endswith((":", "<", "|", "&")) and by_line:  # within arguments or a type: the statement goes on
                stack.append((None, paren, start, units.taken()))
                opened = None
            else:
                opened = declared(at, True)
                stack.append((opened, 0, None, []))
                if opened is None and head:
                    units.taken()
            paren, start = 0, m.end()
        elif c == "}":
            units.taken()
            function, paren, back, waiting = stack.pop() if stack else (None, 0, None, [])
            if function is not None:
                function.last = lines.of(at)
            start, opened = (back, None) if back is not None else (m.end(), None)
            units.all = waiting
        else:  # a line of the preprocessor, or a pattern
            if c in "# \t" and token.lstrip().startswith("#"):
                units.taken()
                start = m.end()
    rest = _COMMENT.sub("", text[start:])
    if rest.strip() and not _DECORATIONS.fullmatch(rest.rstrip()):
        declared(len(text), True)  # the window ends inside the head
        units.taken()
    last = len(lines.starts) - 1
    for function, *_ in stack:
        if function is not None:
            function.last = last
    return Tree(sorted(found, key=lambda f: f.line), units.all, "whole")


_RUBY = re.compile(
    r"(?m:^)=begin\b[\s\S]*?(?:(?m:^)=end\b[^\n]*|\Z)|\#[^\n]*|" + _STRINGS + r"|(?<![\w.:@$])(?:def|class|module|begin|case|if|unless|while|until|for|do|end)\b(?![?!:=]|\s*=[^=~>])|\n|[^\s\w]|\w+"
)
_RUBY_DEF = re.compile(r"def\s+(?:\w+\.)?([\w]+[?!=]?|[^\w\s(]+)[ \t]*(\((?:[^()]|\([^()]*\))*\))?([^\n;]*)")


def _ruby_tree(text: str) -> Tree:
    lines, units, found = _Lines(text), _Units(), []
    stack: list[Function | None] = []
    opened: Function | None = None
    loops = -1  # the line of a loop, whose "do" opens nothing more
    fresh = True  # at the start of a statement
    for m in _RUBY.finditer(text):
        token, at = m.group(), m.start()
        line = lines.of(at)
        if token == "\n":
            fresh = True
            continue
        if token[0] == "#" or token.startswith("=begin"):
            if lines.begins(at):
                units.add(text[lines.starts[line] : m.end()], line, token[0] == "#")
            continue
        if token[0] in "\"'" and opened is not None and lines.begins(at) and re.match(r"[ \t]*(?:\n|$)", text[m.end() : m.end() + 40]):
            opened.literal = token[1:-1]
        waiting = units.taken()
        inside, opened = opened, None
        if token == "def":
            head = _RUBY_DEF.match(text, at)
            function = Function(head.group(1) if head else "", line, line, line, waiting)
            found.append(function)
            if not (head and re.match(r"\s*=[^=~]", head.group(3))):  # else a body on one line
                stack.append(function)
                opened = function
        elif token in ("class", "module", "begin", "case", "for") or token in ("if", "unless", "while", "until") and (fresh or re.search(r"[=(]\s*$", text[lines.starts[line] : at])):
            stack.append(None)
            loops = line if token in ("while", "until", "for") else loops
        elif token == "do" and loops != line:
            stack.append(None)
        elif token == "end" and stack:
            function = stack.pop()
            if function is not None:
                function.last = line
        elif inside is not None and line == inside.line:
            opened = inside  # still in the head
        fresh = token in (";", "then", "else")
    for function in stack:
        if function is not None:
            function.last = len(lines.starts) - 1
    return Tree(found, units.all, "whole")


_PYTHON = re.compile(r"[rRbBuUfF]{0,2}(?:\"\"\"[\s\S]*?(?:\"\"\"|\Z)|'''[\s\S]*?(?:'''|\Z))|" + _STRINGS + r"|\#[^\n]*|[()\[\]{}]|\n")
_PYTHON_COMMENT = re.compile(r"\"\"\"[\s\S]*?(?:\"\"\"|\Z)|'''[\s\S]*?(?:'''|\Z)|" + _STRINGS + r"|\#[^\n]*")
_DECORATION = re.compile(r"[ \t]*@[\w.]+(?:\((?:[^()]|\([^()]*\))*\))?[ \t]*(?:#[^\n]*)?\s*")
_FUNCTION = ast.FunctionDef | ast.AsyncFunctionDef


def _parsed(text: str) -> ast.Module | None:
    try:
        return ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def _completed(lines: list[str], whole: list[int]) -> str | None:
    """The text up to its last whole statement, with the blocks that are open there closed; ``whole`` are ends of statements."""
    kept = whole[-1] + 1 if whole else 0
    while kept and not lines[kept - 1].split("#")[0].strip():
        kept -= 1
    if not kept:
        return None
    out = lines[:kept]
    last = out[-1]
    indent = len(last) - len(last.lstrip())
    closing = [" " * (indent + 1) + "pass"] if last.split("#")[0].rstrip().endswith(":") else []
    depth = indent + 1 if closing else indent
    handled = set()
    for line in reversed(out):
        at, bare = len(line) - len(line.lstrip()), line.strip()
        if not bare or at > depth or at == depth and not bare.startswith("try:"):
            if re.match(r"(?:except|finally)\b", bare) and at == depth:
                handled.add(at)
            continue
        depth = at
        if re.match(r"(?:except|finally)\b", bare):
            handled.add(at)
        elif bare.startswith("try:") and at not in handled:
            closing.append(" " * at + "finally: pass")
    return "\n".join([*out, *closing])


def _headers(lines: list[str], hidden: set[int]) -> list[tuple[ast.AST, int]]:
    """Every function whose header, with the string below it, parses by itself; with its line."""
    out = []
    for i, line in enumerate(lines):
        if i in hidden or not re.match(r"\s*(?:async\s+)?def\s", line):
            continue
        head, tree = [line.lstrip()], None
        for j in range(i, len(lines)):
            if j > i:
                head.append(lines[j])
            if "\n".join(head).count(":") and (tree := _parsed("\n".join(head)) or _parsed("\n".join(head) + "\n  pass")):
                break
            if j > i and re.match(r"\s*(?:async\s+def|def|class)\s", lines[j]):
                break
        if tree is None or not isinstance(tree.body[0], _FUNCTION):
            continue
        opening = re.match(r"(?:\s*(?:#[^\n]*)?\n)*\s*[rRuUbBfF]{0,2}(\"\"\"|'''|\"|')", "\n" + "\n".join(lines[j + 1 :]))
        if opening and len(tree.body[0].body) == 1:
            rest = "\n".join(lines[j + 1 :])
            ends = [k for k in (m.end() for m in re.finditer(re.escape(opening.group(1)), rest)) if k >= opening.end() - 1]
            for k in ends[1:4] if len(ends) > 1 else ends:
                with_text = _parsed("\n".join(head) + "\n" + rest[:k])
                if with_text is not None and isinstance(with_text.body[0], _FUNCTION):
                    tree = with_text
                    break
        out.append((tree.body[0], i))
    return out


def _statement_ends(text: str) -> tuple[list[int], set[int]]:
    """Lines that end a statement, and lines that begin inside a string."""
    ends: list[int] = []
    hidden: set[int] = set()
    line, depth = 0, 0
    for m in _PYTHON.finditer(text):
        token = m.group()
        if token == "\n":
            if depth == 0:
                ends.append(line)
            line += 1
        elif token in "([{":
            depth += 1
        elif token in ")]}":
            depth = max(0, depth - 1)
        elif n := token.count("\n"):
            hidden.update(range(line + 1, line + n + 1))
            line += n
            if not token.endswith(('"""', "'''")):
                depth = 1 << 30  # a string that isn't closed
    return ([*ends, line] if depth == 0 and text else ends), hidden


def _comment_lines(text: str) -> dict[int, str]:
    """Lines that hold a comment only."""
    found: dict[int, str] = {}
    line, counted = 0, 0
    for m in _PYTHON_COMMENT.finditer(text) if "#" in text else ():
        if m.group()[0] == "#":
            line, counted = line + text.count("\n", counted, m.start()), m.start()
            begun = text.rfind("\n", 0, m.start()) + 1
            if not text[begun : m.start()].strip():
                found[line] = text[begun : m.end()]
    return found


def _python_tree(text: str) -> Tree:
    text = re.sub(r"\r\n?|\f", "\n", text)
    lines = text.split("\n")
    tree, how, nodes = _parsed(text) if "def" in text else ast.Module([], []), "whole", None
    if tree is None:
        ends, hidden = _statement_ends(text)
        if done := _completed(lines, ends):
            tree, how = _parsed(done), "completed"
        if tree is None:
            nodes, how = _headers(lines, hidden), "headers"
    comments = _comment_lines(text)
    if tree is not None:
        nodes = [(n, n.lineno - 1) for n in ast.walk(tree) if isinstance(n, _FUNCTION)]
    found = []
    for node, at in sorted(nodes, key=lambda n: n[1]):
        first = min([at, *(d.lineno - 1 for d in node.decorator_list)]) if how != "headers" else at
        while how == "headers" and first and re.match(r"\s*@", lines[first - 1]):
            first -= 1
        units, i = _Units(), first
        while i and (i - 1 in comments or not lines[i - 1].strip()):
            i -= 1
        for k in [*range(i, first), *range(first + 1, at)]:
            if k in comments:
                units.add(comments[k], k, True)
        last = (node.end_lineno or 1) - 1 if how != "headers" else at + (node.end_lineno or 1) - 1
        found.append(Function(node.name, first, at, min(last, len(lines) - 1), units.all, ast.get_docstring(node)))
    tail, i, moved = _Units(), len(lines), True
    while moved:  # comments and decorations of a declaration in another window
        moved = False
        while i and (i - 1 in comments or not lines[i - 1].strip()):
            i -= 1
        k = i - 1
        while k > 0 and lines[k].strip() and not lines[k].lstrip().startswith("@"):
            k -= 1
        if k >= 0 and _DECORATION.fullmatch("\n".join(lines[k:i])):
            i, moved = k, True
    for k in range(i, len(lines)):
        if k in comments:
            tail.add(comments[k], k, True)
    return Tree(found, tail.all, how)


def parse(text: str, language: str) -> Tree:
    """The tree of a text in ``language``; unknown languages are read as ones of braces."""
    if language in NO_FUNCTIONS:
        return Tree([], [], "whole")
    if language == "python":
        return _python_tree(text)
    return _ruby_tree(text) if language == "ruby" else _brace_tree(text, language)
