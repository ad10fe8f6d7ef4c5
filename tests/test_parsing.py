import os

import pyarrow as pa
import pytest

from codeskein.operators import symbols
from codeskein.parsing import apart, go_reader, python_reader, rust_reader, script_reader
from codeskein.parsing.registry import ParserRegistry
from codeskein.parsing.shapes import Shapes


def of(rows, kind):
    return [r for r in rows if r["kind"] == kind]


def test_python_function():
    [f] = of(python_reader.read('\ndef hello(name: str) -> str:\n    """Say hello."""\n    return name\n', ""), "function")
    assert (f["name"], f["parameters"], f["return_type"], f["docstring"]) == ("hello", ["name"], "str", "Say hello.")


def test_python_class():
    rows = python_reader.read('class A(B, x.C, G[T], metaclass=M):\n    """Doc."""\n    def run(self):\n        pass\n', "")
    [c], [f] = of(rows, "class"), of(rows, "function")
    assert (c["bases"], c["docstring"]) == (["B", "x.C"], "Doc.")
    assert (f["scope"], f["params_text"]) == ("A", "(self)")


def test_python_imports():
    rows = of(python_reader.read("import os\nfrom pathlib import Path, PurePath\nimport json as j\nfrom x import *\n", ""), "import")
    assert [r["module"] for r in rows] == ["os", "pathlib", "json"]
    assert rows[1]["items"] == ["Path", "PurePath"] and rows[2]["alias"] == "j"


def test_python_async_calls_docstrings_and_wide_characters():
    text = 'é = "é("\nasync def f(a, *args, k=")", **kw):\n    r"""raw"""\n    def g():\n        return x.y(z())\n'
    [f] = of(python_reader.read(text, ""), "function")
    assert f["is_async"] and f["docstring"] is None
    assert f["parameters"] == ["a", "k"] and f["params_text"] == '(a, *args, k=")", **kw)'
    assert f["calls"] == ["x.y", "z"]


def test_script_function_and_class():
    [f] = of(script_reader.read("function greet(name: string): string {\n  return `a ${name}`;\n}\n", ""), "function")
    assert (f["name"], f["parameters"], f["return_type"]) == ("greet", ["name"], "string")
    text = """class User extends BaseUser {
    name: string;
    constructor(name: string) { this.name = name; }
    greet(): { a: string } { if (x) { return y; } }
    overload(a: string): void;
    handler = (e) => { run(e); };
}"""
    rows = script_reader.read(text, "")
    assert of(rows, "class")[0]["bases"] == ["BaseUser"]
    assert [f["name"] for f in of(rows, "function")] == ["constructor", "greet"]
    assert of(rows, "function")[1]["return_type"] == "{ a: string }"


def test_script_imports_and_variables():
    text = "import D, { A as B, type T } from 'm';\nimport * as fs from \"fs\";\n// import no from 'no';\nexport const a: Map<string, number> = new Map(), b = f(1, 2);\nlet c\nfunction x() { const hidden = 1; }\n"
    rows = script_reader.read(text, "")
    assert [(r["module"], r["items"]) for r in of(rows, "import")] == [("m", ["D", "A", "T"]), ("fs", ["fs"])]
    assert [(r["name"], r["type_hint"]) for r in of(rows, "variable")] == [("a", "Map<string, number>"), ("b", None), ("c", None)]


def test_script_strings_and_patterns_hide_brackets():
    text = "class A { a() { return /[}\"]/.test('{'); }\n b() { return `{`; } }\nfunction f() { }\n"
    assert [f["name"] for f in of(script_reader.read(text, ""), "function")] == ["a", "b", "f"]


def test_untyped_script_leaves_out_defaults():
    [f] = of(script_reader.read_untyped("function f(a, b = 1, ...c) { }", ""), "function")
    assert f["parameters"] == ["a"]


def test_go():
    text = 'package main\n\nimport "fmt"\n\n// User is one.\ntype User struct {\n\tBase\n\tName string `x:"{"`\n}\n\nfunc Hello(name string) string {\n\treturn "}" + name\n}\n\nfunc (u *User) Greet(a, b int) (string, error) { return u.Name, nil }\n'
    rows = go_reader.read(text, "")
    assert [r["module"] for r in of(rows, "import")] == ["fmt"]
    [c] = of(rows, "class")
    assert (c["name"], c["docstring"], c["bases"]) == ("User", "User is one.", ["Base"])
    hello, greet = of(rows, "function")
    assert (hello["name"], hello["is_method"], hello["end_line"]) == ("Hello", False, 13)
    assert (greet["scope"], greet["parameters"], greet["return_type"]) == ("User", ["a"], "(string, error)")


def test_go_groups():
    text = "package p\nimport (\n\tj \"encoding/json\"\n\t\"os\" // \"no\"\n)\ntype (\n\tA interface { F() }\n\tB map[string]int\n\tC = A\n)\nconst (\n\tX int = iota\n\tY\n)\n"
    rows = go_reader.read(text, "")
    assert [(r["module"], r["alias"]) for r in of(rows, "import")] == [("encoding/json", "j"), ("os", None)]
    assert [(r["name"], r["start_line"], r["end_line"]) for r in of(rows, "class")] == [("A", 6, 10), ("B", 6, 10)]
    assert [(r["name"], r["type_hint"]) for r in of(rows, "variable")] == [("X", "int"), ("Y", None)]


def test_rust():
    text = "use a::{b, c};\nuse d::*;\nuse e as f;\n/// Doc.\npub struct User<'a> { n: &'a str }\nimpl<'a> User<'a> {\n    fn new(n: &'a str) -> Self { let c = '}'; User { n } }\n    fn greet(&self) -> String { String::new() }\n}\nimpl Tr for User { fn t(&self) {} }\nfn hello(name: &str) -> String { String::new() }\nstatic MAX: [u8; 2] = [1, 2];\nmod m { fn hidden() {} }\n"
    rows = rust_reader.read(text, "")
    assert [r["module"] for r in of(rows, "import")] == ["a::{b, c}"]
    assert [(c["name"], c["docstring"]) for c in of(rows, "class")] == [("User", "Doc.")]
    assert [(f["name"], f["scope"]) for f in of(rows, "function")] == [
        ("new", "User<'a>"), ("greet", "User<'a>"), ("t", "User"), ("hello", None),
    ]
    assert [(v["name"], v["type_hint"]) for v in of(rows, "variable")] == [("MAX", "[u8; 2]")]


def _files(spark, *rows):
    data = [(f"file:{path}", path, text) for path, text in rows]
    return spark.createDataFrame(data, "file_id string, path string, content string")


def test_last_of_equal_ids_wins_but_all_are_counted(spark):
    declarations = symbols.parse_files(_files(spark, ("a.py", "def f(): pass\n\ndef f(x): pass\n"), ("b.txt", "hello\n")))
    nodes = symbols.symbol_nodes(declarations).collect()
    assert [(n["id"], n["signature"]) for n in nodes] == [("func:file:a.py:module:f", "def f(x)")]
    counts = symbols.index_counts(declarations).first()
    assert (counts["files_processed"], counts["files_skipped"], counts["functions"]) == (1, 1, 2)


def test_unreadable_text_is_one_error(spark):
    data = [("file:a.py", "a.py", b"def f(:"), ("file:b.py", "b.py", b"\xff"), ("file:c.py", "c.py", b"x = 1\r\ny = 2")]
    files = spark.createDataFrame(data, "file_id string, path string, content binary")
    declarations = symbols.parse_files(files)
    counts = symbols.index_counts(declarations).first()
    assert (counts["files_processed"], counts["errors"]) == (3, 2)
    lines = {n["id"]: n["line_count"] for n in symbols.file_nodes(declarations).collect()}
    assert lines == {"file:a.py": 1, "file:b.py": 0, "file:c.py": 2}


def test_go_ids_and_method_edges(spark):
    declarations = symbols.parse_files(_files(spark, ("m.go", "package m\ntype T struct {}\nfunc (t *T) F() {}\n")))
    assert {n["id"] for n in symbols.symbol_nodes(declarations).collect()} == {"class:file:m.go:T", "func:file:m.go:T:F"}
    edges = {(e["source_id"], e["target_id"], e["type"]) for e in symbols.symbol_edges(declarations).collect()}
    assert ("class:file:m.go:T", "func:file:m.go:T:F", "contains") in edges


def test_registry_takes_new_languages(spark):
    registry = ParserRegistry()
    assert registry.language_of("x/Y.PY") == "python" and registry.language_of(".py") is None
    assert registry.get_parser_for_file("a.java") is None

    def read(text, path):
        return [{"kind": "class", "name": line.split()[1], "start_line": 1, "end_line": 1} for line in text.splitlines()]

    registry.register("java", [".java"], read)
    assert "java" in registry.supported_languages() and ".java" in registry.supported_extensions()
    nodes = symbols.symbol_nodes(symbols.parse_files(_files(spark, ("A.java", "class A\nclass B\n")), registry))
    assert {n["id"] for n in nodes.collect()} == {"class:file:A.java:A", "class:file:A.java:B"}


def test_portions_are_read_in_children_that_end(monkeypatch):
    schema = pa.schema([("pid", pa.int64()), ("x", pa.int64())])
    batches = [pa.RecordBatch.from_pydict({"x": [10 * i, 10 * i + 1]}) for i in range(3)]

    def work(portion):
        for batch in portion:
            yield pa.RecordBatch.from_pylist([{"pid": os.getpid(), "x": x} for x in batch["x"].to_pylist()], schema)

    monkeypatch.setattr(apart, "CHILD_ROWS", 3)
    rows = [r for b in apart.in_children(work, iter(batches), schema) for r in b.to_pylist()]
    assert [r["x"] for r in rows] == [0, 1, 10, 11, 20, 21]
    assert len({r["pid"] for r in rows}) == 2 and os.getpid() not in {r["pid"] for r in rows}
    for pid in {r["pid"] for r in rows}:  # none is left behind
        with pytest.raises(ChildProcessError):
            os.waitpid(pid, os.WNOHANG)
    with pytest.raises(RuntimeError):
        list(apart.in_children(lambda portion: [schema.no_such], iter(batches), schema))


def test_only_the_columns_asked_for(spark):
    files = _files(spark, ("a.py", "class A(B):\n    def f(self): g()\n"), ("b.py", "def ("), ("c.txt", ""))
    some = symbols.parse_files(files, columns=("kind", "language"))
    assert some.columns == ["language", "kind"]
    assert symbols.index_counts(some).first() == symbols.index_counts(symbols.parse_files(files)).first()


def test_a_bracket_is_closed_as_the_outline_says():
    from codeskein.parsing.scan import Outline, closing

    for code in ("f(a, (b[1]), {c})(d)", "f(a, ]b) x", "f((a)", ") f(a[)])", "f({(})})"):
        opening = code.find("(")
        assert closing(code, opening) == Outline(code).closing(opening)


SHAPED = '''
import os.path as {0}
from .{1} import {2}, b  # of {0}


@deco({0}, "(")
class A_{1}({2}, x.{0}):
    """ About "{1}" %s
    twice """
    limit: int = {3}

    async def f(self, a: {1} = {3}, *, c=(1.5, '{0})')) -> {2}[{3}]:
        return {0}({2}.run(), {1}.run(), {3})


V = {3}
'''


def test_texts_of_one_shape_are_parsed_once_and_read_as_alone():
    parsed = []

    def reader(text, path):
        parsed.append(text)
        return python_reader.read(text, path)

    texts = [SHAPED.format(*names) for names in (("p", "q", "r", 1), ("p", "p", "p", 23), ("a_7", "run", "helper", 70000017))]
    texts += [SHAPED.format(f"n{i}", f"m{i}", "z000001z", i + 1) for i in range(50)]
    shapes = Shapes(reader)
    assert [shapes(text, "") for text in texts] == [python_reader.read(text, "") for text in texts]
    assert len(parsed) <= 3


def test_texts_that_differ_in_more_than_names_have_other_shapes():
    groups = [
        ("x = 1\n", "x = 01\n", "x = 1.5\n", "x = 1.e5\n", "x = 1.a5\n", "x = 1_0\n"),
        ('"""a\n"""; x = 1\n', '"""a"""\n; x = 1\n'),
        ("def f():\n    'a'\n", 'def f():\n    "a"\n', "def f():\n    '''a'''\n", "def f():\n    f'{a}'\n", "def f():\n    b'a'\n"),
        ("x = ''\"a\"\n", 'x = """a"\n', 'x = "a" "b"\n', 'x = "a"b"\n', "x = 'a\n", "x = 'a\\\n'\n"),
        ("a = b\n", "a = if\n", "a = None\n", "None = a\n", "é = b\n", "a = \x0cb\n"),
        ("match a:\n    case b: pass\n", "catch a:\n    case b: pass\n"),
    ]

    def told(read, text):
        try:
            return read(text, "")
        except SyntaxError as error:
            return str(error)

    for texts in groups:
        shapes = Shapes(python_reader.read)
        for text in [*texts * 3, *reversed(texts)]:
            assert told(shapes, text) == told(python_reader.read, text)


def test_counts_of_many_texts_of_one_shape(spark):
    rows = [(f"f{i}.py", f"import a{i}, b\nclass C{i}(D{i}):\n    def g(self): h{i}()\n" + "def (" * (i % 5 == 0)) for i in range(100)]
    counts = symbols.index_counts(symbols.parse_files(_files(spark, *rows).coalesce(1), columns=("language", "kind"))).first()
    assert tuple(counts) == (100, 0, 20, 80, 80, 160)
    errors = symbols.parse_files(_files(spark, *rows).coalesce(1)).filter("kind = 'error'").select("docstring").collect()
    assert all(e[0].startswith("Failed to parse f") and "line 4" in e[0] for e in errors) and len(errors) == 20


def test_only_the_kinds_asked_for(spark):
    texts = [f"import a\nclass A{i}(B):\n    x = 1\n    def f(self): g()\ndef h(): pass\ndef h(a): k{i}(a)\n" for i in range(6)]
    files = _files(spark, *[(f"f{i}.py", text) for i, text in enumerate(texts)], ("b.py", "def (")).coalesce(1)
    needed = ("file_id", "language", "ord", "is_last", "kind", "name", "scope", "module", "items", "bases", "calls")
    some = symbols.parse_files(files, columns=needed, only=("function", "class"))
    every = symbols.parse_files(files)
    wanted = every.filter("kind IN ('function', 'class')")
    assert sorted(map(str, some.collect())) == sorted(map(str, wanted.select(some.columns).collect()))
    assert some.count() == 24
    fields = ("id", "type", "name", "file_id", "ord")
    assert sorted(symbols.symbol_nodes(some).select(*fields).collect()) == sorted(symbols.symbol_nodes(wanted).select(*fields).collect())
    assert sorted(map(str, symbols.symbol_references(some).collect())) == sorted(map(str, symbols.symbol_references(every).collect()))
