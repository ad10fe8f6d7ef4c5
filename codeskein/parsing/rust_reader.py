"""Declarations of a Rust text."""

from __future__ import annotations

import re

from codeskein.parsing.scan import Outline, blank, comment_above, split_top

_MASKED = re.compile(
    r"//[^\n]*|/\*.*?\*/|\bb?r(#*)\".*?\"\1|b?\"(?:\\.|[^\"\\])*\"|b?'(?:\\[^\n]*?|[^'\\\n])'", re.DOTALL
)
_SCOPE = r"(?:pub(?:\s*\([^)]*\))?\s+)?"
_USE = re.compile(rf"(?:^|(?<=[;{{}}]))[ \t]*{_SCOPE}use\s+([^;]+);", re.MULTILINE)
_TYPE = re.compile(rf"^[ \t]*{_SCOPE}(?:unsafe\s+|auto\s+)*(?:struct|enum|trait)\s+([A-Za-z_]\w*)", re.MULTILINE)
_IMPL = re.compile(r"^[ \t]*(?:unsafe\s+)?impl\b", re.MULTILINE)
_FN = re.compile(
    rf"{_SCOPE}(?P<marks>(?:(?:default|const|async|unsafe|extern)\s+)*)fn\s+(?P<name>[A-Za-z_]\w*)"
)
_VALUE = re.compile(
    rf"^[ \t]*{_SCOPE}(?:const|static)\s+(?:mut\s+)?([A-Za-z_]\w*)\s*:", re.MULTILINE
)
_DOCS = ("///", "//!")


def _start(m: re.Match) -> int:
    return m.start() + len(m.group()) - len(m.group().lstrip())


def _function(o: Outline, source: str, m: re.Match, scope: str | None, lines: list[str]) -> dict:
    opening = o.code.find("(", o.skip_angles(m.end()))
    closing = o.closing(opening)
    stop = o.find("{;", closing + 1)
    tail = re.split(r"\bwhere\b", source[closing + 1 : stop])[0].strip()
    parameters = []
    for part in split_top(o.code[opening + 1 : closing]):
        part = re.sub(r"^(?:#\[[^\]]*\]\s*)+", "", part)
        if re.match(r"(?:&\s*(?:'\w+\s*)?)?(?:mut\s+)?self\b", part):
            parameters += ["self"] if scope else []
        elif ":" in part:
            parameters.append(re.sub(r"^mut\s+", "", part.split(":")[0].strip()))
    line = o.line(_start(m))
    end = o.closing(stop) if o.code[stop : stop + 1] == "{" else stop
    return {
        "kind": "function",
        "name": m.group("name"),
        "scope": scope,
        "start_line": line,
        "end_line": o.line(end),
        "params_text": source[opening : closing + 1],
        "parameters": parameters,
        "return_type": tail.removeprefix("->").strip() or None,
        "is_async": "async" in m.group("marks"),
        "docstring": comment_above(lines, line, _DOCS),
    }


def _impl_type(header: str) -> str:
    """The implementing type of an impl header, generics of the impl itself taken off."""
    header = re.split(r"\bwhere\b", header)[0].strip()
    header = re.split(r"\bfor\b(?!\s*<)", header)[-1]
    return header.strip()


def read(source: str, path: str) -> list[dict]:
    o = Outline(blank(_MASKED, source))
    lines = source.split("\n")
    uses = []
    for m in _USE.finditer(o.code):
        tree = source[m.start(1) : m.end(1)].strip()
        outer = re.sub(r"\{.*\}", "", tree, flags=re.DOTALL)
        # Wildcards, renames and bare lists name no single path.
        if not (tree.startswith("{") or outer.endswith("*") or re.search(r"\sas\s", outer)):
            uses.append({"kind": "import", "module": tree, "start_line": o.line(_start(m))})

    items = [(m.start(), "type", m) for m in _TYPE.finditer(o.code)]
    items += [(m.start(), "impl", m) for m in _IMPL.finditer(o.code)]
    found, bodies = [], []
    for start, kind, m in sorted(items, key=lambda item: item[0]):
        if o.depth(m.end() - 1):
            continue
        line = o.line(_start(m))
        if kind == "type":
            stop = o.find("{;", m.end())
            end = o.closing(stop) if o.code[stop : stop + 1] == "{" else stop
            found.append(
                {
                    "kind": "class",
                    "name": m.group(1),
                    "start_line": line,
                    "end_line": o.line(end),
                    "bases": [],
                    "docstring": comment_above(lines, line, _DOCS),
                }
            )
            continue
        opening = o.find("{", m.end())
        owner = _impl_type(source[o.skip_angles(m.end()) : opening])
        for fn in _FN.finditer(o.code, opening, o.closing(opening)):
            if o.depth(fn.start("name")) == o.depth(opening) + 1:
                found.append(_function(o, source, fn, owner, lines))
    functions = [_function(o, source, m, None, lines) for m in _FN.finditer(o.code) if not o.depth(m.start("name"))]
    values = []
    for m in _VALUE.finditer(o.code):
        if not o.depth(m.end() - 1):
            hint = source[m.end() : o.find("=;", m.end())].strip()
            values.append({"kind": "variable", "name": m.group(1), "start_line": o.line(_start(m)), "type_hint": hint})
    return uses + found + functions + values
