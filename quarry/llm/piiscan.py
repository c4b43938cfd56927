"""Candidate mentions of personal data in a text, with the contexts they stand in.

Nothing here decides on names, numbers or streets; see ``pii``. Only e-mail addresses are complete in themselves.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

_OPEN, _CLOSE = r"\s?[\[({<]\s?", r"\s?[\])}>]\s?"
_AT = rf"{_OPEN}(?:at|AT|At|a|arroba|ät){_CLOSE}"
_DOT = rf"(?:{_OPEN}(?:dot|DOT|Dot|punto|punkt|point){_CLOSE}|\s(?:dot|DOT|punto|punkt)\s)"
_LOCAL = r"(?<![\w@.+%-])[^\W_](?:[\w.+%'’-]*[\w+-])?"
_LABEL = r"[^\W_](?:[\w-]*[^\W_])?"
_END = r"[^\W\d_]{2,}(?![\w@-])"
#: Plain addresses, addresses with a bracketed at, and addresses spelt in words.
EMAILS = (
    (re.compile("@").search, re.compile(rf"{_LOCAL}@{_LABEL}(?:\.{_LABEL})*\.{_END}")),
    (re.compile(r"[\[({<]\s?(?:at|AT|At|a|arroba|ät)\s?[\])}>]").search, re.compile(rf"{_LOCAL}{_AT}{_LABEL}(?:(?:\.|{_DOT}){_LABEL})*(?:\.|{_DOT}){_END}")),
    (lambda text: "dot" in text or "DOT" in text or "punto" in text or "punkt" in text, re.compile(rf"{_LOCAL}\s(?:at|AT|arroba)\s{_LABEL}(?:(?:\.|{_DOT}){_LABEL})*{_DOT}{_END}")),
)

#: Words between a given and a family name.
PARTICLES = frozenset("van von de del della der den di da dos das do du la le las los ter ten zu zum zur af av bin ibn al el y e".split())
_UPPER = "".join(c for c in map(chr, range(0x250)) if c.isupper())
_PARTICLE = "|".join(sorted(PARTICLES | {p.upper() for p in PARTICLES} | {p.title() for p in PARTICLES}))
_NAMED = rf"[{_UPPER}](?:\.|[^\W\d_]*(?:['’‑-][^\W\d_]+)*)"
_SEQUENCE = re.compile(rf"(?<![\w@/#$.'’-]){_NAMED}(?:(?:[ \u00a0](?:{'|'.join(sorted(PARTICLES))}))*[ \u00a0]{_NAMED})+(?![\w@])")
_WORD = rf"[{_UPPER}][^\W\d_]+(?:['’‑-][^\W\d_]+)*|[{_UPPER}]['’][^\W\d_]+(?:['’‑-][^\W\d_]+)*"
_REVERSED = re.compile(
    rf"(?<![\w@/#$.'’-])((?:(?:{_PARTICLE})[ ]){{0,3}}(?:{_WORD})),[ ]((?:{_WORD})(?:[ ][{_UPPER}]\.|[ ](?:{_WORD})(?=[ ]*(?:\n|$|[\"|;<])))?)(?![\w@])(?![ ](?:(?:{_PARTICLE})[ ])*[{_UPPER}])"
)

#: A number-like run: groups of digits, with up to two capitals beside them, and the separators of phone and identity numbers.
_GROUP = r"(?:\(\d{1,5}\)|[A-Z]{0,2}\d+[A-Z]?)"
_NUMBER = re.compile(rf"(?<![\w@.,/:#+-])(?:[A-Z]{{1,2}}[ ])?\+?{_GROUP}(?:(?:[ ]?[/-][ ]?|[ .]|(?<=\))|(?=\()){_GROUP})*(?:-?[A-Z])?(?![\w@]|[.:/-]\w|-\d)")
#: What may follow a run that begins with letters: one more letter, set apart.
_LETTER = re.compile(r"[ ][A-Z](?![\w@'’-])")

_COMMA = re.compile(rf",[ ][{_UPPER}]")

_HOUSE = r"\d+"
#: Public street words by language; the last word, the first word or the ending of a street name.
_EN = "Lane Road Rd Street St Avenue Ave Close Way Crescent Drive Court Place Square Terrace Boulevard Blvd Gardens Grove Row Mews Hill Walk Parade Ln Ct Cres Sq Ter".split()
_FR = "rue avenue av. boulevard bd place allée allées chemin quai impasse passage cours route square sentier ruelle esplanade faubourg".split()
_ES = "Calle C/ Avenida Avda. Av. Plaza Pza. Camino Paseo Ronda Travesía Carretera Glorieta Callejón Vía".split()
_DE = "straße strasse str. gasse weg platz allee ring ufer damm stieg steig pfad markt chaussee hof".split()
_CAP = r"[A-ZÀ-ÖØ-Þ][\w'’-]*"
_SMALL = r"(?:de la|de los|de las|del|de|du|des|d['’]|la|le|les|l['’])"
ADDRESS_EN = re.compile(rf"(?<![\w.,/:#-])(?P<n>{_HOUSE}[ ]?(?:[A-Za-z](?=[ ]))?)[ ](?P<s>(?:{_CAP}[ ]){{1,3}}(?:{'|'.join(_EN)})\b\.?)(?![\w-])")
ADDRESS_FR = re.compile(
    rf"(?<![\w.,/:#-])(?P<n>{_HOUSE}(?:[ ]?(?:bis|ter|quater|[A-Z])\b)?),?[ ](?P<s>(?i:{'|'.join(map(re.escape, _FR))})[ ](?:(?:{_SMALL}[ ]?)+{_CAP}|{_CAP}(?:[ ]{_CAP})?))"
)
_HOUSE_AFTER = rf"\d+(?:[ ]?[a-z](?![\w'’]))?(?![\d]|[./:-]\d|[ ]?/|[ ][\d(]|\w)"
ADDRESS_AFTER = re.compile(
    rf"(?<![\w@/#-])(?P<s>(?:C/[ ]?)?{_CAP}\.?(?:[ ](?:{_SMALL}|an der|an den|auf der|in der|zum|zur|am|im|der|den|dem)){{0,2}}(?:[ ]{_CAP}\.?){{0,3}}),?[ ](?:n\.?º|nº|n°|núm\.|Nr\.|No\.)?[ ]?(?P<n>{_HOUSE_AFTER})"
)
_WORDS = re.compile(r"[^\W\d_]+|\d+|\n|[^\w\s]")


@lru_cache(1 << 16)
def fold(text: str) -> str:
    """Lower-case ASCII letters of ``text``, without accents and anything else."""
    plain = text.lower().replace("ø", "o").replace("ł", "l").replace("ß", "ss").replace("æ", "ae").replace("œ", "oe").replace("đ", "d").replace("þ", "th")
    return re.sub(r"[^a-z]", "", unicodedata.normalize("NFKD", plain))


def shape(value: str) -> str:
    """Digits as 9, capitals as A, the rest as it is."""
    return re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", value.replace(" ", " ")))


def _words(text: str) -> list[str]:
    return ["⏎" if w == "\n" else "9" if w.isdigit() else w.lower() for w in _WORDS.findall(text)]


def contexts(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns around ``text[start:end]``: two words on the left, one on each side, two on the right."""
    left, right = ["⊢", "⊢", *_words(text[max(0, start - 28) : start])], [*_words(text[end : end + 28]), "⊣", "⊣"]
    return [f"{left[-2]} {left[-1]} _", f"{left[-1]} _ {right[0]}", f"_ {right[0]} {right[1]}"]


def _is_capital(token: str) -> bool:
    return token[0].isupper()


class _Spelt:
    """The names that the addresses of a document spell, wherever they stand in it."""

    def __init__(self, locals_: Iterable[str]) -> None:
        self.whole: set[str] = set()
        self.tagged: set[str] = set()
        for local in locals_:
            base = fold(re.sub(r"\+.*", "", local))
            self.whole.add(base)
            if "+" in local:
                self.tagged.add(base)

    def says(self, given: str, family: str) -> bool:
        """Whether the local part of an address is made of this name."""
        return len(family) >= 4 and (given + family in self.whole or given[:1] + family in self.whole) or len(family) >= 5 and family in self.tagged


def _name_rows(text: str, emails: list[tuple[int, int, str]]) -> list[tuple]:
    rows: list[tuple] = []
    spelt = _Spelt(local for _, _, local in emails)

    def add(group: int, given: str, family: str, start: int, end: int, middle: str | None, long_end: int | None, long_family: str | None) -> None:
        g = fold(given.split("-")[0])
        initial = given.endswith(".")
        by_long = long_family is not None and spelt.says(fold(given), fold(long_family))
        seen = by_long or spelt.says(fold(given), fold(family))
        at = contexts(text, start, long_end if by_long and long_end else end)
        rows.append(("name", group, start, end, long_end, g + "." if initial else g, fold(middle.split("-")[0]) + ("." if middle.endswith(".") else "") if middle else None, fold(family), fold(long_family) if long_family else None, by_long, at, "name" if seen else None))

    for m in _SEQUENCE.finditer(text):
        words = [(w.start() + m.start(), w.group()) for w in re.finditer(r"[^  ]+", m.group())]
        words = list(itertools.takewhile(lambda w: not any(s < w[0] + len(w[1]) and w[0] < e for s, e, _ in emails), words))
        for k in range(len(words) - 1):
            at, given = words[k]
            if not _is_capital(given) or fold(given) in PARTICLES and not given.endswith("."):
                continue

            def family_from(i: int) -> int | None:
                while i < len(words) and fold(words[i][1]) in PARTICLES and not words[i][1].endswith("."):
                    i += 1
                return i if i < len(words) and _is_capital(words[i][1]) else None

            first = family_from(k + 1)
            if first is None:
                continue
            second = family_from(first + 1) if first == k + 1 else None
            name = words[first][1]
            if name.endswith("."):  # an initial can't end a name
                if second is None:
                    continue
                full = text[words[first + 1][0] : words[second][0] + len(words[second][1])]
                add(m.start(), given, full, at, words[second][0] + len(words[second][1]), None, None, None)
                continue
            full = text[words[k + 1][0] : words[first][0] + len(name)]
            if second is not None and not words[second][1].endswith("."):
                long_end = words[second][0] + len(words[second][1])
                add(m.start(), given, full, at, words[first][0] + len(name), name, long_end, text[words[first + 1][0] : long_end])
            else:
                add(m.start(), given, full, at, words[first][0] + len(name), None, None, None)
    for m in _REVERSED.finditer(text) if _COMMA.search(text) else ():
        family, given = m.group(1), m.group(2)
        if fold(family) not in PARTICLES:
            add(m.start(), given.split(" ")[0], family, m.start(1), m.end(2), None, None, None)
    return rows


_SEED_SHAPES = re.compile(r"999-99-9999|AA ?99 ?99 ?99 ?A|99999999-?A|A{1,2}9{7}|9{6}-9{4}")


def scan(text: str) -> list[tuple]:
    """Rows ``(family, group, start, end, long_end, instance, middle, tail, long_tail, take_long, contexts, seed)``."""
    rows: list[tuple] = []
    emails: list[tuple[int, int, str]] = []
    for hint, pattern in EMAILS:
        if not hint(text):
            continue
        for m in pattern.finditer(text):
            before, after = text[max(0, m.start() - 3) : m.start()], text[m.end() : m.end() + 2]
            if before.endswith("/") or re.match(r":[\w~/]", after) or after[:1] == "/":
                continue  # a remote
            emails.append((m.start(), m.end(), re.split(r"@|\s?[\[({<]\s?|\s", m.group(), maxsplit=1)[0]))
            rows.append(("email", m.start(), m.start(), m.end(), None, "email", None, None, None, False, [], "email"))
    rows += _name_rows(text, emails)
    for m in _NUMBER.finditer(text):
        stop = m.end()
        if text[m.start() : m.start() + 2].isalpha() and (more := _LETTER.match(text, stop)):
            stop = more.end()
        value = text[m.start() : stop]
        digits = sum(map(str.isdigit, value))
        if not 7 - (value[:2].isalpha()) <= digits <= 15 or re.fullmatch(r"\d{7}|\d+[.]\d+|\d{4}[-./]\d\d?[-./]\d\d?", value):
            continue
        kind = shape(value)
        seed = "phone" if value[0] == "+" and digits >= 9 else "id_number" if _SEED_SHAPES.fullmatch(kind) else None
        rows.append(("number", m.start(), m.start(), stop, None, kind, None, None, None, False, contexts(text, m.start(), stop), seed))
    for pattern in (ADDRESS_EN, ADDRESS_FR):
        for m in pattern.finditer(text):
            end = m.end()
            if pattern is ADDRESS_EN and text[end - 1] == "." and not m.group().endswith("St."):
                end -= 1
            rows.append(("address", m.start(), m.start(), end, None, fold(m.group("s")), None, None, None, False, contexts(text, m.start(), end), "address"))
    for m in ADDRESS_AFTER.finditer(text):
        street = m.group("s")
        first = street.split(" ")[0]
        typed = first in _ES or street.startswith("C/") or any(fold(street.split(" ")[-1]).endswith(fold(e)) and len(fold(street.split(" ")[-1])) > len(fold(e)) + 1 for e in _DE)
        rows.append(("address", m.start(), m.start(), m.end(), None, fold(street), None, None, None, False, contexts(text, m.start(), m.end()), "address" if typed else None))
    return rows
