"""Declarations of a TypeScript or JavaScript text."""

from __future__ import annotations

import re

from codeskein.parsing.scan import Outline, blank, split_top

_MASKED = re.compile(
    r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`"
    r"|(?<=[(,=:\[!&|?{};\n])[ \t]*/(?![/*\s])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/",
    re.DOTALL,
)
_NAME = r"[A-Za-z_$][\w$]*"
_IMPORT = re.compile(r"^[ \t]*import\s+(?:([^'\";()]*?)\s*from\s*)?(['\"])([^'\"\n]+)\2", re.MULTILINE)
_CLASS = re.compile(
    rf"^[ \t]*(?:export\s+)?(?:default\s+)?((?:abstract\s+|declare\s+)*class\s+({_NAME}))", re.MULTILINE
)
_DECORATORS = re.compile(r"(?:@[\w$.]+(?:\([^()]*(?:\([^()]*\)[^()]*)*\))?\s*)+(?:export\s+)?(?:default\s+)?\Z")
_FUNCTION = re.compile(
    rf"^[ \t]*(?:export\s+)?(?:default\s+)?(?P<async>async\s+)?function\s+(?P<name>{_NAME})", re.MULTILINE
)
_MEMBER = re.compile(
    r"(?:(?:public|private|protected|static|override|readonly|get|set|(?P<async>async))\s+)*\*?\s*"
    rf"(?P<name>#?{_NAME})"
)
_VARIABLE = re.compile(r"^[ \t]*(?:export\s+)?(?:const|let|var)\s+", re.MULTILINE)
_PARAMETER = re.compile(
    rf"(?:@[\w$.]+(?:\([^()]*\))?\s*)*(?:(?:public|private|protected|readonly|override)\s+)*({_NAME})\??\s*(?=[:=]|\Z)"
)
_TYPE_MARKS = r"(?:[:|&<,(\[?]|=>|\b(?:is|keyof|extends|readonly))\Z"


def _items(clause: str) -> list[str]:
    """Imported names of a clause: the default, the namespace, the listed ones."""
    clause = re.sub(r"^type\s+(?!from\b)(?=[\w${*])", "", clause.strip())
    listed = re.search(r"\{(.*)\}", clause, re.DOTALL)
    outer = clause[: listed.start()] + clause[listed.end() :] if listed else clause
    names = [re.sub(r"^\*\s*as\s+", "", part) for part in split_top(outer)]
    inner = split_top(listed.group(1)) if listed else []
    return names + [re.split(r"\s+as\s+", re.sub(r"^type\s+", "", part))[0] for part in inner]


def _callable(o: Outline, source: str, m: re.Match, typed: bool) -> dict | None:
    """Parameters, return type and extent of what `m` names; None without a body."""
    opening = re.compile(r"\s*").match(o.code, o.skip_angles(m.end())).end()
    if o.code[opening : opening + 1] != "(":
        return None
    closing = o.closing(opening)
    body = o.body(closing + 1, _TYPE_MARKS)
    between = o.code[closing + 1 : body].strip() if body >= 0 else ";"
    if body < 0 or (between and not between.startswith(":")):
        return None
    parameters = []
    for part in split_top(o.code[opening + 1 : closing]):
        named = _PARAMETER.match(part)
        if named and named.group(1) != "this" and (typed or "=" not in part):
            parameters.append(named.group(1))
    start = m.start() + len(m.group()) - len(m.group().lstrip())
    return {
        "kind": "function",
        "name": m.group("name"),
        "start_line": o.line(start),
        "end_line": o.line(o.closing(body)),
        "params_text": source[opening : closing + 1],
        "parameters": parameters,
        "return_type": source[closing + 1 : body].strip().lstrip(":").strip() or None,
        "is_async": bool(m.group("async")),
    }


def _methods(o: Outline, source: str, body: int, scope: str, typed: bool) -> list[dict]:
    found, i, end = [], body + 1, o.closing(body)
    while i < end:
        i = re.compile(r"(?:\s|;|@[\w$.]+(?:\([^()]*\))?)*").match(o.code, i).end()
        m = _MEMBER.match(o.code, i)
        method = _callable(o, source, m, typed) if m else None
        if method:
            found.append({**method, "scope": scope})
            i = o.closing(o.body(o.closing(o.code.index("(", o.skip_angles(m.end()))) + 1, _TYPE_MARKS)) + 1
        else:
            i = max(o.find(";\n", i), i) + 1
    return found


def _classes(o: Outline, source: str, typed: bool) -> list[dict]:
    found, passed = [], 0
    for m in _CLASS.finditer(o.code):
        if o.depth(m.start(1)):
            continue
        body = o.find("{", m.end())
        heritage = re.sub(r"<[^<>]*>", "", re.sub(r"<[^<>]*>", "", o.code[m.end() : body]))
        parents = re.search(r"\bextends\b(.*?)(?:\bimplements\b|\Z)", heritage, re.DOTALL)
        before = _DECORATORS.search(o.code[passed : m.start(1)])
        tags = re.findall(r"@([\w$.]+)", before.group()) if before else []
        found.append(
            {
                "kind": "class",
                "name": m.group(2),
                "start_line": o.line(passed + before.start() if before else m.start(1)),
                "end_line": o.line(o.closing(body)),
                "bases": re.findall(rf"(?<![.\w$]){_NAME}", parents.group(1)) if parents else [],
                "decorators": tags,
            }
        )
        found += _methods(o, source, body, m.group(2), typed)
        passed = o.closing(body)
    return found


def _declarators(o: Outline, i: int, end: int) -> list[dict]:
    """`name[: type][= value]` entries between two positions; patterns are passed over."""
    found = []
    while i < end:
        m = re.compile(rf"\s*({_NAME})\s*!?(?=\s*[:=,]|\s*\Z)").match(o.code, i, end)
        if m:
            stop = m.end()
            if o.code[stop : stop + 1] == ":":
                stop = _type_end(o.code, stop + 1, end)
            hint = o.code[m.end() + 1 : stop].strip()
            found.append(
                {"kind": "variable", "name": m.group(1), "start_line": o.line(m.start(1)), "type_hint": hint or None}
            )
            i = stop
        i = min(o.find(",", i), end) + 1
    return found


def _type_end(code: str, i: int, end: int) -> int:
    """Where a type annotation stops: at `=` or `,` outside of its brackets."""
    level = 0
    for m in re.compile(r"=>|[(\[{<]|[)\]}>]|[=,]").finditer(code, i, end):
        token = m.group()
        if token in "=," and level == 0:
            return m.start()
        level += (token in "([{<") - (token in ")]}>")
    return end


def _variables(o: Outline, source: str) -> list[dict]:
    found = []
    for m in _VARIABLE.finditer(o.code):
        if o.depth(m.end() - 1):
            continue
        end = m.end()
        while end < len(o.code):  # a line break ends the list unless the line cannot end there
            end = o.find(";\n", end)
            if end >= len(o.code) or o.code[end] == ";" or o.code[m.end() : end].rstrip()[-1:] not in tuple(",=+-*/&|?:<"):
                break
            end += 1
        found += _declarators(o, m.end(), end)
    return found


def read(source: str, path: str, typed: bool = True) -> list[dict]:
    bare = blank(_MASKED, source, keep="\"'`")
    o = Outline(blank(_MASKED, source))
    found = []
    for m in _IMPORT.finditer(bare):
        if not o.code[m.start() : m.end()].lstrip().startswith("import"):
            continue  # inside a string
        start = m.start() + len(m.group()) - len(m.group().lstrip())
        found.append(
            {"kind": "import", "module": m.group(3), "items": _items(m.group(1) or ""), "start_line": o.line(start)}
        )
    found += _classes(o, source, typed)
    functions = [_callable(o, source, m, typed) for m in _FUNCTION.finditer(o.code) if not o.depth(m.start("name"))]
    return found + [f for f in functions if f] + _variables(o, source)


def read_untyped(source: str, path: str) -> list[dict]:
    return read(source, path, typed=False)
