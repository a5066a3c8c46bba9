"""Tables and columns that SQL definitions and Prisma schemas declare.

Both are read as tokens: a definition's items are cut at its own commas (SQL) or lines (Prisma), the first tokens of an
item are name and type, and the words after them are clauses.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

_TOKEN = re.compile(r"""--[^\n]*|/\*.*?\*/|(?P<text>'(?:''|[^'])*')|(?P<name>"(?:""|[^"])*"|`[^`]*`|\[\w+\]|[\w$.]+)|(?P<mark>\S)""", re.S)
_CLAUSES = {"NOT", "NULL", "DEFAULT", "PRIMARY", "UNIQUE", "REFERENCES", "CHECK", "CONSTRAINT", "COLLATE", "GENERATED", "AUTO_INCREMENT", "AUTOINCREMENT", "COMMENT", "ON", "KEY", "IDENTITY", "AS"}
_OF_TABLE = {"PRIMARY", "UNIQUE", "FOREIGN", "CONSTRAINT", "CHECK", "INDEX", "KEY", "EXCLUDE", "LIKE"}


def _bare(name: str) -> str:
    """A name without its schema and quotes."""
    return name.rpartition(".")[2].strip("\"`[]'")


def _items(tokens: list[str], at: int) -> tuple[list[list[str]], int]:
    """The lists of tokens between commas within the bracket that opens at `at`, and the place behind it."""
    items, depth = [[]], 0
    for k in range(at, len(tokens)):
        t = tokens[k]
        depth += (t == "(") - (t == ")")
        if not depth:
            return [x for x in items if x], k + 1
        if t == "," and depth == 1:
            items.append([])
        elif depth > 1 or t != "(":
            items[-1].append(t)
    return [], len(tokens)  # never closed


def _joined(tokens: list[str]) -> str:
    out = ""
    for t in tokens:
        out += t if not out or t in "(),." or out[-1] in "(." else f" {t}"
    return out


def _clause(words: list[str], tokens: list[str], *wanted: str) -> list[str] | None:
    """Tokens after the words `wanted`, outside brackets."""
    depth = 0
    for k, w in enumerate(words):
        if not depth and words[k : k + len(wanted)] == list(wanted):
            return tokens[k + len(wanted) :]
        depth += (w == "(") - (w == ")")
    return None


def _until_clause(tokens: list[str]) -> list[str]:
    depth = 0
    for k, t in enumerate(tokens):
        if k and not depth and t.upper() in _CLAUSES:
            return tokens[:k]
        depth += (t == "(") - (t == ")")
    return tokens


def sql_columns(text: str) -> Iterator[tuple]:
    """(table, column, type, nullable, primary, unique, default, references); constraints of a table count for their columns."""
    tokens = [m[0] for m in _TOKEN.finditer(text) if m.lastgroup]
    upper = [t.upper() for t in tokens]
    at = 0
    while at < len(tokens):
        if upper[at] != "CREATE":
            at += 1
            continue
        k = at + 1
        while k < len(tokens) and upper[k] in ("TEMP", "TEMPORARY", "UNLOGGED", "GLOBAL", "LOCAL", "OR", "REPLACE", "EXTERNAL"):
            k += 1
        if k >= len(tokens) or upper[k] != "TABLE":
            at += 1
            continue
        k += 4 if upper[k + 1 : k + 4] == ["IF", "NOT", "EXISTS"] else 1
        while tokens[k + 1 : k + 2] == ["."]:
            k += 2
        if k + 1 >= len(tokens) or tokens[k + 1] != "(":
            at = k
            continue
        table = _bare(tokens[k])
        items, at = _items(tokens, k + 1)
        primary, unique, points, columns = set(), set(), {}, []
        for item in items:
            words = [t.upper() for t in item]
            if words[0] in _OF_TABLE:
                named = lambda rest: [_bare(x[0]) for x in _items(rest, 0)[0]] if rest and rest[0] == "(" else []
                primary |= set(named(_clause(words, item, "PRIMARY", "KEY")))
                only = named(_clause(words, item, "UNIQUE"))
                unique |= set(only if len(only) == 1 else ())
                to = _clause(words, item, "REFERENCES")
                points |= dict.fromkeys(named(_clause(words, item, "FOREIGN", "KEY")), _bare(to[0])) if to else {}
            elif len(item) > 1:
                columns.append(item)
        for item in columns:
            name, words, rest = _bare(item[0]), [t.upper() for t in item[1:]], item[1:]
            key = name in primary or _clause(words, rest, "PRIMARY", "KEY") is not None
            default, to = _clause(words, rest, "DEFAULT"), _clause(words, rest, "REFERENCES")
            yield table, name, _joined(_until_clause(rest)), not key and _clause(words, rest, "NOT", "NULL") is None, key, name in unique or _clause(words, rest, "UNIQUE") is not None, _joined(_until_clause(default)) if default else None, _bare(to[0]) if to else points.get(name)


_MODEL = re.compile(r"""(?P<note>//[^\n]*)|(?P<open>\bmodel\s+(?P<model>\w+)\s*\{)|(?P<close>\})|(?P<field>^[ \t]*(?P<name>\w+)[ \t]+(?P<type>\w+)(?P<many>\?|\[\])?)|(?P<at>(?<![@\w])@(?P<word>[\w.]+))""", re.M)


def _bracket(text: str, at: int) -> str:
    """What stands within the bracket that opens at `at`, if one does."""
    depth = 0
    for k in range(at, len(text)) if text[at : at + 1] == "(" else ():
        depth += (text[k] == "(") - (text[k] == ")")
        if not depth:
            return text[at + 1 : k]
    return ""


def prisma_columns(text: str) -> Iterator[tuple]:
    """As sql_columns(). A field's attributes are gathered until the next field or the model's end."""
    model, field, marks = None, None, {}

    def done() -> Iterator[tuple]:
        if field:
            yield model, field["name"], field["type"] + (field["many"] or ""), field["many"] == "?", "id" in marks, "unique" in marks, marks.get("default"), field["type"] if "references" in marks.get("relation", "") else None

    for m in _MODEL.finditer(text):
        if m["open"]:
            model, field = m["model"], None
        elif model and m["close"]:
            yield from done()
            model = field = None
        elif model and m["field"]:
            yield from done()
            field, marks = m.groupdict(), {}
        elif field and m["at"]:
            marks[m["word"]] = _bracket(text, m.end())
