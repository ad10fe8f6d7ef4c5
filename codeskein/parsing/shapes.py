"""Python texts of one shape, which differ in names, numbers, strings and comments only, are parsed once.

A syntax tree depends on keywords, operators, layout and the kinds of the other tokens. Of a shape that is met again, a text
with a mark for each of these tokens is read; its rows, marks filled in, are the rows of every text of the shape. What the
tokens could decide otherwise (prefixed strings, backslashes, other than printable ASCII) is always parsed.
"""

from __future__ import annotations

import keyword
import re
from collections.abc import Callable

_ODD = re.compile(r"[^\n\t -\[\]-~]")
_TOKENS = re.compile(
    r'([A-Za-z_]\w*+|[0-9][\w.]*+|#[^\n]*+|"""[^\0]*?"""|\'\'\'[^\0]*?\'\'\'|"(?!"")[^"\n]*"|\'(?!\'\')[^\'\n]*\')', re.ASCII
)
_KEYWORDS = {*keyword.kwlist, *keyword.softkwlist}
_PLAIN_NUMBER = re.compile(r"[1-9][0-9]{0,17}")
_NAME, _NUMBER, _STRING, _COMMENT, _END = "\x01", "\x02", "\x03", "\x04", "\x05"
#: A name or number right before a string.
_PREFIXED = re.compile(rf"[{_NAME}{_NUMBER}\w]{_STRING}", re.ASCII)
_MARK = re.compile(r"z([0-9]{6})z|7([0-9]{6})7|y([0-9]{6})y\n*Y")
#: Texts after which shapes are given up if fewer than half of them were known, and tokens or shapes kept at a time.
TRIED, KEPT = 1000, 50_000
_ONCE, _ERROR = "met once", "an error"


class _Kinds(dict):
    """What stands for a token in its text's shape; a token that decides the tree stands for itself."""

    def __missing__(self, token: str) -> str:
        first = token[0]
        if first == "#":
            kind = _COMMENT
        elif first in "\"'":
            kind = _STRING + _quote(token) + "\n" * token.count("\n") + _END
        elif first.isdigit():
            kind = _NUMBER if _PLAIN_NUMBER.fullmatch(token) else token
        else:
            kind = token if token in _KEYWORDS or token.startswith("__") else _NAME
        if len(self) >= KEPT:
            self.clear()
        self[token] = kind
        return kind


def _quote(token: str) -> str:
    return token[:3] if token[:3] in ('"""', "'''") else token[0]


def _mark(i: int, kind: str) -> str:
    if kind == _NAME:
        return f"z{i:06d}z"
    if kind == _NUMBER:
        return f"7{i:06d}7"
    if kind == _COMMENT:
        return f"#z{i:06d}z"
    if kind[0] == _STRING:
        quote = _quote(kind[1:])
        return f"{quote}y{i:06d}y{kind[1 + len(quote):-1]}Y{quote}"
    return kind


def _filled(value, tokens: list[str]):
    """A function from the tokens of a text to its value in place of one with marks; None if there are no marks."""
    if isinstance(value, list):
        parts = [(_filled(v, tokens), v) for v in value]
        if all(f is None for f, _ in parts):
            return None
        return lambda own: [f(own) if f else v for f, v in parts]
    if not isinstance(value, str) or not (found := list(_MARK.finditer(value))):
        return None
    places = []
    for m in found:
        i = int(m[1] or m[2] or m[3])
        cut = len(_quote(tokens[i])) if m[3] else int(tokens[i][0] == "#")
        places.append((i, cut, -cut if m[3] else None))
    if len(places) == 1 and found[0].group() == value:
        [(i, begin, end)] = places
        return lambda own: own[i][begin:end]
    form = "%s".join(text.replace("%", "%%") for text in _between(value, found))
    return lambda own: form % tuple([own[i][begin:end] for i, begin, end in places])


def _between(value: str, found: list[re.Match]) -> list[str]:
    ends = [0, *(m.end() for m in found)]
    return [value[a:b] for a, b in zip(ends, [*(m.start() for m in found), len(value)])]


#: What the reader does with the text of a field, to be done with that of the filled one.
_AFTER = {
    "docstring": str.strip,
    "calls": lambda calls: list(dict.fromkeys(calls)),
    "decorators": lambda decorators: [d.split("(")[0] for d in decorators],
}


class Shapes:
    """Reads texts as `read` (text, path) does, which must not look at the path. Of a known shape only `fields` are told, of rows
    of other than `only` these kinds the kind alone, if any are given; an error of a known shape is told by its own text unless the docstring, which holds it, is not asked for."""

    def __init__(self, read: Callable[[str, str], list[dict]], fields: frozenset[str] = frozenset(), only: frozenset[str] = frozenset()):
        self.read, self.fields, self.only = read, fields, only
        self.kinds, self.plans, self.tried, self.known = _Kinds(), {}, 0, 0

    def _shape(self, text: str) -> tuple[str, list[str], list[str]] | None:
        if _ODD.search(text):
            return None
        pieces = _TOKENS.split(text)
        tokens = pieces[1::2]
        gaps = "\0".join(pieces[::2])
        if '"' in gaps or "'" in gaps or len(tokens) > 999_999:
            return None
        kinds = list(map(self.kinds.__getitem__, tokens))
        pieces[1::2] = kinds
        shape = "".join(pieces)
        if _PREFIXED.search(shape):
            return None
        return shape, tokens, kinds

    def _plan(self, text: str, tokens: list[str], kinds: list[str]):
        if any(kind == token and _MARK.search(token) for kind, token in zip(kinds, tokens)):
            return None
        pieces = _TOKENS.split(text)
        pieces[1::2] = [_mark(i, kind) for i, kind in enumerate(kinds)]
        try:
            rows = self.read("".join(pieces), "")
        except SyntaxError:
            return _ERROR
        except Exception:  # what it is depends on more than the shape
            return None
        plan = []
        for row in rows:
            if self.only and row["kind"] not in self.only:
                plan.append(({"kind": row["kind"]}, []))
                continue
            fixed, open_fields = {}, []
            for name, value in row.items():
                if self.fields and name not in self.fields:
                    continue
                fill = _filled(value, tokens)
                if fill is None:
                    fixed[name] = value
                else:
                    open_fields.append((name, fill, _AFTER.get(name)))
            plan.append((fixed, open_fields))
        return plan

    def __call__(self, text: str, path: str) -> list[dict]:
        if self.tried >= TRIED and 2 * self.known < self.tried:
            return self.read(text, path)
        self.tried += 1
        found = self._shape(text)
        if found is None:
            return self.read(text, path)
        shape, tokens, kinds = found
        if shape not in self.plans:  # most shapes are met once
            if len(self.plans) >= KEPT:
                self.plans.clear()
            self.plans[shape] = _ONCE
            return self.read(text, path)
        self.known += 1
        plan = self.plans[shape]
        if plan is _ONCE:
            plan = self.plans[shape] = self._plan(text, tokens, kinds)
        if plan is None or (plan is _ERROR and (not self.fields or "docstring" in self.fields)):
            return self.read(text, path)
        if plan is _ERROR:
            raise SyntaxError("a text of this shape is no Python")
        rows = []
        for fixed, open_fields in plan:
            row = dict(fixed)
            for name, fill, after in open_fields:
                value = fill(tokens)
                row[name] = after(value) if after else value
            rows.append(row)
        return rows

