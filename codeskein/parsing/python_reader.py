"""Declarations of a Python text, by the standard library's syntax tree."""

from __future__ import annotations

import ast
import re
import warnings

from codeskein.parsing.scan import blank, closing

_STRINGS = re.compile(
    r'"""(?:\\.|[^\\])*?"""|\'\'\'(?:\\.|[^\\])*?\'\'\'|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|#[^\n]*',
    re.DOTALL,
)


class _Text:
    """Slices of a text by the byte positions that syntax tree nodes carry."""

    def __init__(self, text: str):
        self.plain = text if text.isascii() else None
        self.data = text.encode()
        self.starts = [0] + [m.end() for m in re.finditer(b"\n", self.data)]
        self.char_starts = self.starts if self.plain is not None else [0] + [m.end() for m in re.finditer("\n", text)]

    def at(self, line: int, column: int) -> int:
        return self.starts[line - 1] + column

    def char_at(self, line: int, column: int) -> int:
        """The same place counted in characters."""
        begin = self.starts[line - 1]
        return self.char_starts[line - 1] + len(self.data[begin : begin + column].decode())

    def of(self, node: ast.AST) -> str:
        begin, end = self.at(node.lineno, node.col_offset), self.at(node.end_lineno, node.end_col_offset)
        if self.plain is not None:
            return self.plain[begin:end]
        return self.data[begin:end].decode()


def _docstring(node, text: _Text) -> str | None:
    first = node.body[0] if node.body else None
    if not (isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str)):
        return None
    quoted = text.of(first.value)
    for quote in ('"""', "'''", '"', "'"):
        if quoted.startswith(quote):
            return quoted[len(quote) : -len(quote)].strip()
    return None


def _calls(body: list) -> list[ast.expr]:
    """What the calls of a body call, in the order of `ast.walk` over each of its statements."""
    found = []
    for part in body:
        todo = [part]
        for node in todo:  # grows while it is gone through
            if node.__class__ is ast.Call:
                found.append(node.func)
            for name in node._fields:
                value = getattr(node, name, None)
                if isinstance(value, list):
                    todo += [v for v in value if isinstance(v, ast.AST)]
                elif isinstance(value, ast.AST) and value._fields:
                    todo.append(value)
    return found


def _function(node, scope: str | None, text: _Text, code: str, source: str) -> dict:
    args = node.args
    named = [a.arg for a in (*args.posonlyargs, *args.args, *args.kwonlyargs)]
    opening = code.find("(", text.char_at(node.lineno, node.col_offset))
    calls = [text.of(called) for called in _calls(node.body)]
    return {
        "kind": "function",
        "name": node.name,
        "scope": scope,
        "start_line": node.lineno,
        "end_line": node.end_lineno,
        "params_text": source[opening : closing(code, opening) + 1],
        "parameters": named,
        "return_type": text.of(node.returns) if node.returns else None,
        "is_async": isinstance(node, ast.AsyncFunctionDef),
        "docstring": _docstring(node, text),
        "calls": list(dict.fromkeys(calls)),
    }


def _variables(body: list, scope: str | None, text: _Text) -> list[dict]:
    found = []
    for node in body:
        if isinstance(node, ast.Assign):
            target, hint = node.targets[0], None
        elif isinstance(node, ast.AnnAssign):
            target, hint = node.target, text.of(node.annotation)
        else:
            continue
        if isinstance(target, ast.Name):
            found.append(
                {"kind": "variable", "name": target.id, "scope": scope, "start_line": node.lineno, "type_hint": hint}
            )
    return found


def _imports(body: list) -> list[dict]:
    found = []
    for node in body:
        if isinstance(node, ast.Import):
            found += [
                {"kind": "import", "module": a.name, "alias": a.asname, "start_line": node.lineno} for a in node.names
            ]
        elif isinstance(node, ast.ImportFrom):
            items = [a.name for a in node.names if a.name != "*"]
            module = "." * node.level + (node.module or "")
            if items:
                found.append({"kind": "import", "module": module, "items": items, "start_line": node.lineno})
    return found


def read(source: str, path: str) -> list[dict]:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = ast.parse(source)
    text, code = _Text(source), blank(_STRINGS, source)
    defs = (ast.FunctionDef, ast.AsyncFunctionDef)
    found = _imports(tree.body)
    for node in tree.body:
        if isinstance(node, ast.ClassDef):
            found.append(
                {
                    "kind": "class",
                    "name": node.name,
                    "start_line": node.lineno,
                    "end_line": node.end_lineno,
                    "bases": [text.of(b) for b in node.bases if isinstance(b, (ast.Name, ast.Attribute))],
                    "decorators": [text.of(d).split("(")[0] for d in node.decorator_list],
                    "docstring": _docstring(node, text),
                }
            )
            found += [_function(m, node.name, text, code, source) for m in node.body if isinstance(m, defs)]
            found += _variables(node.body, node.name, text)
    found += [_function(n, None, text, code, source) for n in tree.body if isinstance(n, defs)]
    return found + _variables(tree.body, None, text)
