"""Registered queries over source texts that Spark writes from table rows, one file per row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeskein.operators import resolve, symbols
from codeskein.plans.suite import query
from codeskein.session import cut, spread


def _texts(rows: DataFrame, path: str, template: str, **columns) -> DataFrame:
    """Files whose text is `template` with `{name}` replaced by columns."""
    content = F.lit(template.strip("\n") + "\n")
    rows = spread(rows.select([c.alias(k) for k, c in columns.items()]))
    columns = {k: F.col(k) for k in columns}
    name = F.lit(path)
    for key, column in columns.items():
        value = column.cast("string")
        content = F.replace(content, F.lit("{" + key + "}"), value)
        name = F.replace(name, F.lit("{" + key + "}"), value)
    files = rows.select(name.alias("path"), content.alias("content"))
    return files.select(F.concat(F.lit("file:"), "path").alias("file_id"), "path", "content")


PYTHON = '''
import mod_{c}, os.path as p
from pkg.{s} import a_{k}, b as c


class Order_{k}(Base_{c}, ns.Mixin):
    """Order {k}."""

    limit: int = {k}

    async def total(self, x: int = 1, *args) -> float:
        return helper_{c}(x) + self.go.run(x)


def main_{k}(a, b):
    """Main."""
    return Order_{k}(a)


VALUE = {k}
'''
PYTHON_TWICE = """

def main_{k}(z):
    pass
"""


def _python_files(spark, folder, broken: bool = False) -> DataFrame:
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    columns = {"k": F.col("o_orderkey"), "c": F.col("o_custkey"), "s": F.lower("o_orderstatus")}
    name = "src/o{k}.py"
    once = _texts(orders.filter("o_orderkey % 5 <> 0"), name, PYTHON, **columns)
    twice = _texts(orders.filter("o_orderkey % 5 = 0"), name, PYTHON + PYTHON_TWICE, **columns)
    if broken:
        twice = twice.withColumn("content", F.concat("content", F.lit("def (")))
    return once.unionByName(twice)


SCRIPT = """
import D, { Component as C, Y } from '@scope/{c}';
import * as fs from "fs";
// class Hidden extends Nothing {
export class Service_{c} extends Base_{n} implements Other {
  private items: Map<string, number> = new Map();
  constructor(private name: string, size = {c}) {
    super("}");
  }
  async load(id: string, cb?: (e: Error) => void): Promise<void> {
    await fetch(`/{c}/${id}`);
  }
}
export function create_{c}(a: number): Service_{c} {
  return new Service_{c}("x");
}
export const limit: number = {c}, other = f(1, 2);
"""


def _script_files(spark, folder, suffix: str) -> DataFrame:
    customer = spark.read.parquet(f"{folder}/customer.parquet")
    text = SCRIPT
    if suffix == ".mjs":
        for typed, plain in [
            (" implements Other", ""), ("private items: Map<string, number>", "items"), ("private name: string", "name"),
            ("id: string, cb?: (e: Error) => void): Promise<void>", "id, cb)"),
            ("(a: number): Service_{c} {", "(a) {"), (": number = {c}", " = {c}"),
        ]:
            text = text.replace(typed, plain)
    return _texts(customer, "web/c{c}" + suffix, text, c=F.col("c_custkey"), n=F.col("c_nationkey"))


GO = """
package main

import (
	"fmt"
	j "encoding/json" // "no"
)

// Part {p} is a part.
type Part_{p} struct {
	Base_{z}
	Name string `json:"name"`
}

// Size tells the size.
func (p *Part_{p}) Size(a, b int, names ...string) (int, error) {
	return {z}, fmt.Errorf("}")
}

func New_{p}(f func(int) int) interface{} { return nil }

const Max_{p}, Min int = {z}, 1
"""


def _go_files(spark, folder) -> DataFrame:
    part = spark.read.parquet(f"{folder}/part.parquet")
    return _texts(part, "go/p{p}.go", GO, p=F.col("p_partkey"), z=F.col("p_size"))


RUST = """
use std::collections::{HashMap, HashSet};
use super::*;

/// Supplier {s}.
pub struct Supplier_{s}<'a> {
    name: &'a str,
}

impl<'a> Supplier_{s}<'a> {
    /// Makes one.
    pub fn new(name: &'a str) -> Self {
        let brace = '{';
        Supplier_{s} { name }
    }

    async fn send(&mut self, mut to: [u8; {n}]) -> Result<(), Error> where Self: Sized {
        Ok(())
    }
}

fn run_{s}<F: Fn(i32) -> i32>(f: F, (a, b): (u8, u8)) {}

pub const LIMIT: usize = {n};
"""


def _rust_files(spark, folder) -> DataFrame:
    supplier = spark.read.parquet(f"{folder}/supplier.parquet")
    return _texts(supplier, "rs/s{s}.rs", RUST, s=F.col("s_suppkey"), n=F.col("s_nationkey"))


def _described(files: DataFrame) -> DataFrame:
    """Symbol nodes with their less common fields packed into one text."""
    nodes = symbols.symbol_nodes(symbols.parse_files(files))
    detail = F.concat_ws(
        "|",
        F.array_join("parameters", ","),
        "return_type",
        F.array_join("bases", ","),
        "module",
        "alias",
        F.array_join("items", ","),
        "type_hint",
        "scope",
        F.when(F.col("is_async"), F.lit("async")),
        F.when(F.col("is_method"), F.lit("method")),
    )
    first = F.coalesce("start_line", "line").alias("first_line")
    return nodes.select("id", "type", "name", "signature", "docstring", first, "end_line", detail.alias("detail"))


def _expected(source: str, rows: list[tuple]) -> str:
    """SQL twin: one SELECT per symbol, its fields being SQL expressions over the table row."""
    names = ("id", "type", "name", "signature", "docstring", "first_line", "end_line", "detail")
    selects = []
    for row in rows:
        *values, where = row if len(row) == 9 else (*row, "true")
        fields = ", ".join(f"{v} AS {n}" for v, n in zip(values, names))
        selects.append(f"SELECT {fields} FROM {source} WHERE {where}")
    typed = "id, type, name, signature::VARCHAR AS signature, docstring::VARCHAR AS docstring, first_line::INTEGER AS first_line, end_line::INTEGER AS end_line, detail"
    return f"SELECT {typed} FROM (" + "\nUNION ALL ".join(selects) + ")"


_O = "(SELECT o_orderkey AS k, o_custkey AS c, lower(o_orderstatus) AS s, 'file:src/o' || o_orderkey || '.py' AS f FROM orders)"


@query(
    _expected(
        _O,
        [
            ("'import:' || f || ':mod_' || c", "'import'", "'mod_' || c", "NULL", "NULL", 1, "NULL", "'mod_' || c || '|'"),
            ("'import:' || f || ':os.path'", "'import'", "'p'", "NULL", "NULL", 1, "NULL", "'os.path|p|'"),
            ("'import:' || f || ':pkg.' || s || ':a_' || k || ',b'", "'import'", "'from pkg.' || s", "NULL", "NULL", 2, "NULL",
             "'pkg.' || s || '|a_' || k || ',b'"),
            ("'class:' || f || ':Order_' || k", "'class'", "'Order_' || k", "NULL", "'Order ' || k || '.'", 5, 11,
             "'Base_' || c || ',ns.Mixin'"),
            ("'func:' || f || ':class:' || f || ':Order_' || k || ':total'", "'function'", "'total'",
             "'async def total(self, x: int = 1, *args) -> float'", "NULL", 10, 11, "'self,x|float|async|method'"),
            ("'var:' || f || ':class:' || f || ':Order_' || k || ':limit'", "'variable'", "'limit'", "NULL", "NULL", 8, "NULL",
             "'int|class'"),
            ("'func:' || f || ':module:main_' || k", "'function'", "'main_' || k", "'def main_' || k || '(a, b)'", "'Main.'", 14, 16,
             "'a,b'", "k % 5 <> 0"),
            ("'func:' || f || ':module:main_' || k", "'function'", "'main_' || k", "'def main_' || k || '(z)'", "NULL", 22, 23,
             "'z'", "k % 5 = 0"),
            ("'var:' || f || ':module:VALUE'", "'variable'", "'VALUE'", "NULL", "NULL", 19, "NULL", "'module'"),
        ],
    )
)
def p1_python_symbols(spark, folder):
    return _described(_python_files(spark, folder))


@query(
    f"""SELECT f AS source_id, 'class:' || f || ':Order_' || k AS target_id, 'defines' AS type FROM {_O}
UNION ALL SELECT f, 'func:' || f || ':module:main_' || k, 'defines' FROM {_O}
UNION ALL SELECT 'class:' || f || ':Order_' || k, 'func:' || f || ':class:' || f || ':Order_' || k || ':total', 'contains' FROM {_O}
UNION ALL SELECT f, 'import:' || f || ':' || unnest(['mod_' || c, 'os.path', 'pkg.' || s || ':a_' || k || ',b']), 'imports' FROM {_O}
UNION ALL SELECT 'class:' || f || ':Order_' || k, 'class:*:' || unnest(['Base_' || c, 'ns.Mixin']), 'inherits' FROM {_O}
UNION ALL SELECT 'func:' || f || ':class:' || f || ':Order_' || k || ':total', 'func:*:*:' || unnest(['helper_' || c, 'run']), 'calls' FROM {_O}
UNION ALL SELECT 'func:' || f || ':module:main_' || k, 'func:*:*:Order_' || k, 'calls' FROM {_O}"""
)
def p4_python_edges_and_references(spark, folder):
    needed = ("file_id", "language", "ord", "is_last", "kind", "name", "scope", "module", "items", "bases", "calls")
    declarations = cut(symbols.parse_files(_python_files(spark, folder), columns=needed), "declarations")  # read once for both
    both = symbols.symbol_edges(declarations).unionByName(symbols.symbol_references(declarations))
    return both.select("source_id", "target_id", "type")


@query(
    """SELECT count(*) AS files_processed, 0::BIGINT AS files_skipped, count(*) FILTER (WHERE o_orderkey % 5 = 0) AS errors,
 2 * count(*) FILTER (WHERE o_orderkey % 5 <> 0) AS functions, count(*) FILTER (WHERE o_orderkey % 5 <> 0) AS classes,
 3 * count(*) FILTER (WHERE o_orderkey % 5 <> 0) AS imports FROM orders"""
)
def a3_index_counts(spark, folder):
    declarations = symbols.parse_files(_python_files(spark, folder, broken=True), columns=("language", "kind"))
    return symbols.index_counts(declarations)


_C = "(SELECT c_custkey AS c, c_nationkey AS n, 'file:web/c' || c_custkey || '{0}' AS f FROM customer)"


def _script_rows(typed: bool) -> list[tuple]:
    method = "'func:' || f || ':class:' || f || ':Service_' || c || ':{0}'"
    made = "'(private name: string, size = ' || c || ')'" if typed else "'(name, size = ' || c || ')'"
    load = "'async load(id: string, cb?: (e: Error) => void): Promise<void>'" if typed else "'async load(id, cb)'"
    create = "'function create_' || c || '(a: number): Service_' || c" if typed else "'function create_' || c || '(a)'"
    return [
        ("'import:' || f || ':@scope/' || c", "'import'", "'@scope/' || c", "NULL", "NULL", 1, "NULL",
         "'@scope/' || c || '|D,Component,Y'"),
        ("'import:' || f || ':fs'", "'import'", "'fs'", "NULL", "NULL", 2, "NULL", "'fs|fs'"),
        ("'class:' || f || ':Service_' || c", "'class'", "'Service_' || c", "NULL", "NULL", 4, 12, "'Base_' || n"),
        (method.format("constructor"), "'function'", "'constructor'", f"'constructor' || {made}", "NULL", 6, 8,
         "'name,size|method'" if typed else "'name|method'"),
        (method.format("load"), "'function'", "'load'", load, "NULL", 9, 11,
         "'id,cb|Promise<void>|async|method'" if typed else "'id,cb|async|method'"),
        ("'func:' || f || ':module:create_' || c", "'function'", "'create_' || c", create, "NULL", 13, 15,
         "'a|Service_' || c" if typed else "'a'"),
        ("'var:' || f || ':module:limit'", "'variable'", "'limit'", "NULL", "NULL", 16, "NULL",
         "'number|module'" if typed else "'module'"),
        ("'var:' || f || ':module:other'", "'variable'", "'other'", "NULL", "NULL", 16, "NULL", "'module'"),
    ]


@query(_expected(_C.format(".ts"), _script_rows(True)))
def p7_typescript_symbols(spark, folder):
    return _described(_script_files(spark, folder, ".ts"))


@query(_expected(_C.format(".mjs"), _script_rows(False)))
def p11_javascript_symbols(spark, folder):
    return _described(_script_files(spark, folder, ".mjs"))


_P = "(SELECT p_partkey AS p, p_size AS z, 'file:go/p' || p_partkey || '.go' AS f FROM part)"


@query(
    _expected(
        _P,
        [
            ("'import:' || f || ':fmt'", "'import'", "'fmt'", "NULL", "NULL", 4, "NULL", "'fmt|'"),
            ("'import:' || f || ':encoding/json'", "'import'", "'j'", "NULL", "NULL", 5, "NULL", "'encoding/json|j|'"),
            ("'class:' || f || ':Part_' || p", "'class'", "'Part_' || p", "NULL", "'Part ' || p || ' is a part.'", 9, 12, "'Base_' || z"),
            ("'func:' || f || ':Part_' || p || ':Size'", "'function'", "'Size'",
             "'func Size(a, b int, names ...string) (int, error)'", "'Size tells the size.'", 15, 17, "'a|(int, error)|method'"),
            ("'func:' || f || ':module:New_' || p", "'function'", "'New_' || p",
             "'func New_' || p || '(f func(int) int) interface{}'", "NULL", 19, 19, "'f|interface{}'"),
            ("'var:' || f || ':module:Max_' || p", "'variable'", "'Max_' || p", "NULL", "NULL", 21, "NULL", "'int|module'"),
        ],
    )
)
def p13_go_symbols(spark, folder):
    return _described(_go_files(spark, folder))


_S = "(SELECT s_suppkey AS s, s_nationkey AS n, 'file:rs/s' || s_suppkey || '.rs' AS f FROM supplier)"
_OWNER = "'func:' || f || ':class:' || f || ':Supplier_' || s || '<''a>:{0}'"


@query(
    _expected(
        _S,
        [
            ("'import:' || f || ':std::collections::{HashMap, HashSet}'", "'import'", "'std::collections::{HashMap, HashSet}'",
             "NULL", "NULL", 1, "NULL", "'std::collections::{HashMap, HashSet}|'"),
            ("'class:' || f || ':Supplier_' || s", "'class'", "'Supplier_' || s", "NULL", "'Supplier ' || s || '.'", 5, 7, "''"),
            (_OWNER.format("new"), "'function'", "'new'", "'fn new(name: &''a str) -> Self'", "'Makes one.'", 11, 14,
             "'name|Self|method'"),
            (_OWNER.format("send"), "'function'", "'send'",
             "'async fn send(&mut self, mut to: [u8; ' || n || ']) -> Result<(), Error>'", "NULL", 16, 18,
             "'self,to|Result<(), Error>|async|method'"),
            ("'func:' || f || ':module:run_' || s", "'function'", "'run_' || s",
             "'fn run_' || s || '(f: F, (a, b): (u8, u8))'", "NULL", 21, 21, "'f,(a, b)'"),
            ("'var:' || f || ':module:LIMIT'", "'variable'", "'LIMIT'", "NULL", "NULL", 23, "NULL", "'usize|module'"),
        ],
    )
)
def p17_rust_symbols(spark, folder):
    return _described(_rust_files(spark, folder))


@query(
    f"""SELECT 'func:' || f || ':module:main_' || k AS source_id, 'class:' || f || ':Order_' || k AS target_id FROM {_O} WHERE false
UNION ALL SELECT 'class:' || o.f || ':Order_' || o.k, 'class:' || p.f || ':Base_' || (p.z * 10) FROM {_O} o
JOIN (SELECT z, max(f) AS f FROM (SELECT p_size AS z, 'file:py/b' || p_partkey || '.py' AS f FROM part) GROUP BY z) p ON o.c = p.z * 10"""
)
def j6_resolved_across_files(spark, folder):
    """Parsed classes of one set of files inherit from classes defined in another."""
    part = spark.read.parquet(f"{folder}/part.parquet")
    bases = _texts(part, "py/b{p}.py", "class Base_{z}:\n    pass", p=F.col("p_partkey"), z=F.col("p_size") * 10)
    needed = ("file_id", "language", "ord", "is_last", "kind", "name", "scope", "module", "items", "bases", "calls")
    files = _python_files(spark, folder).unionByName(bases)
    declarations = cut(symbols.parse_files(files, columns=needed, only=("function", "class")), "declarations")  # what names resolve to
    references = symbols.symbol_references(declarations).filter("type = 'inherits'")
    edges = resolve.resolved_edges(symbols.symbol_nodes(declarations), references)
    return edges.select("source_id", "target_id")
