"""Declarations of a Go text."""

from __future__ import annotations

import re

from codeskein.parsing.scan import Outline, blank, comment_above, split_top

_MASKED = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|`[^`]*`|'(?:\\.[^']*|[^'\\\n])'", re.DOTALL)
_DECLARATION = re.compile(r"^(import|type|var|const|func)\b[ \t]*", re.MULTILINE)
_IMPORT = re.compile(r"(?:([\w.]+)[ \t]+)?[\"`]([^\"`\n]+)[\"`]")
_TYPE_MARKS = r"\b(?:interface|struct)\Z"


def _specs(o: Outline, start: int) -> list[tuple[int, int]]:
    """Extents of the entries of a declaration: one, or one per line of a parenthesised group."""
    if o.code[start : start + 1] != "(":
        return [(start, o.find("\n;", start))]
    found, i, end = [], start + 1, o.closing(start)
    while i < end:
        i = re.compile(r"[\s;]*").match(o.code, i).end()
        stop = min(o.find("\n;", i), end)
        if i < stop:
            found.append((i, stop))
        i = stop + 1
    return found


def _embedded(o: Outline, opening: int) -> list[str]:
    """Type names of embedded fields: entries of a struct body that are a type and nothing else."""
    end = o.closing(opening)
    lines = re.split(r"[\n;]", o.code[opening + 1 : end])
    found, at = [], opening + 1
    for line in lines:
        m = re.fullmatch(r"\s*\*?([A-Za-z_][\w.]*(?:\[[^\]]*\])?)\s*", line)
        if m and o.depth(at + m.start(1)) == o.depth(opening) + 1:
            found.append(m.group(1))
        at += len(line) + 1
    return found


def _first_names(parts: list[str]) -> list[str]:
    """First name of each `a, b T` group; entries of types only and variadic ones have none."""
    typed = re.compile(r"(?!(?:chan|map|func|struct|interface)\b)([A-Za-z_]\w*)\s+(\.\.\.)?\S")
    if not any(typed.match(part) for part in parts):
        return []
    names, fresh = [], True
    for part in parts:
        m = typed.match(part)
        if fresh and not (m and m.group(2)):
            names.append(m.group(1) if m else part)
        fresh = bool(m)
    return names


def _function(o: Outline, source: str, m: re.Match, lines: list[str]) -> dict | None:
    i, receiver = m.end(), None
    is_method = o.code[i : i + 1] == "("
    if is_method:
        types = re.split(r"\s+", o.code[i + 1 : o.closing(i)].strip(), maxsplit=1)
        receiver = types[-1].removeprefix("*")
        i = o.closing(i) + 1
    name = re.compile(r"\s*([A-Za-z_]\w*)\s*").match(o.code, i)
    if not name:
        return None
    i = name.end()
    if o.code[i : i + 1] == "[":
        i = o.closing(i) + 1
    opening = o.code.find("(", i)
    closing = o.closing(opening)
    line_end = o.find("\n", closing + 1)
    body = o.body(closing + 1, _TYPE_MARKS)
    stop = body if 0 <= body < line_end else line_end
    parameters = _first_names(split_top(o.code[opening + 1 : closing]))
    line = o.line(m.start())
    return {
        "kind": "function",
        "name": name.group(1),
        "scope": receiver,
        "is_method": is_method,
        "start_line": line,
        "end_line": o.line(o.closing(body)) if stop == body else o.line(stop),
        "params_text": source[opening : closing + 1],
        "parameters": parameters,
        "return_type": source[closing + 1 : stop].strip() or None,
        "docstring": comment_above(lines, line, ("//",)),
    }


def read(source: str, path: str) -> list[dict]:
    bare = blank(_MASKED, source, keep="\"`'")
    o = Outline(blank(_MASKED, source))
    lines = source.split("\n")
    imports, types, functions, variables = [], [], [], []
    for m in _DECLARATION.finditer(o.code):
        if o.depth(m.start()):
            continue
        word, start = m.group(1), m.end()
        if word == "func":
            functions.append(_function(o, source, m, lines))
            continue
        if word == "import":
            # Blank strings look like blanks, so the extent is taken from the text that keeps them.
            opening = re.compile(r"[ \t]*").match(bare, m.end(1)).end()
            end = o.closing(opening) if o.code[opening] == "(" else o.find("\n", opening)
            imports += [
                {"kind": "import", "module": f.group(2), "alias": f.group(1), "start_line": o.line(f.start(2))}
                for f in _IMPORT.finditer(bare, opening, end)
            ]
            continue
        first, last = o.line(m.start()), o.line(o.find("\n", start))
        for begin, end in _specs(o, start):
            spec = o.code[begin:end]
            named = re.match(r"[A-Za-z_]\w*", spec)
            if not named:
                continue
            if word == "type":
                rest = spec[named.end() :].lstrip()
                if rest.startswith("="):
                    continue
                struct = re.match(r"(?:\[[^\]]*\]\s*)?struct\s*\{", rest)
                opening = begin + spec.index(rest) + struct.end() - 1 if struct else None
                types.append(
                    {
                        "kind": "class",
                        "name": named.group(),
                        "start_line": first,
                        "end_line": last,
                        "bases": _embedded(o, opening) if struct else [],
                        "docstring": comment_above(lines, first, ("//",)),
                    }
                )
            else:
                rest = re.sub(r"^(?:\s*,\s*[A-Za-z_]\w*)*", "", spec[named.end() :]).split("=")[0].strip()
                variables.append(
                    {"kind": "variable", "name": named.group(), "start_line": o.line(begin), "type_hint": rest or None}
                )
    return imports + types + [f for f in functions if f] + variables
