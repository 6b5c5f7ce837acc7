"""Symbols of small texts in each language."""

import pytest

from marlstone.sources import files
from marlstone.sources.lexing import lexed_symbols

TEXTS = {
    "rust": """use std::fmt::{self, Display as Show};
pub struct Order { id: u64, item: Part }
impl Show for Order {
    pub fn total(&self) -> Price { let x = part7(self.id); x.value }
}
// fn not_this() {
fn main() { println!("a {}", Order::new()); let s = r#"fn nor() {"#; }
""",
    "typescript": """import { parse as read, other } from './util';
export interface Shape { area(): number; }
export class Box extends Base implements Shape {
  private w = make(1);
  area(): number { return this.w * helper(2); }
}
export function run(x: Box) { if (x) { read(x); } }
const y = require('m');
""",
    "go": 'package fixture\nimport (\n  "fmt"\n  alias "net/http"\n)\ntype Service struct { Name string }\nfunc (s *Service) Run() error { fmt.Println(s.Name); return helper() }\nfunc helper() error { return nil }\n',
    "java": "package a.b;\nimport java.util.List;\npublic class Order {\n  private int n = count(3);\n  public int total(List x) { return helper(x) + new Part(1).size; }\n}\n",
    "csharp": "using System.Text;\nnamespace A { public class Order { internal void Run(Part p) { p.Go(); } } }\n",
    "ruby": "require 'net/http'\nmodule Shop\n  class Order < Base\n    def total?(x)\n      return 1 if x\n      items.each do |i|\n        helper(i)\n      end\n    end\n    def self.make; end\n  end\nend\n",
    "lua": 'local helper = require("lua_helper")\nlocal M = {}\nfunction M.run(x)\n  if x then return helper.transform(x) end\n  for i = 1, 3 do print(i) end\n  repeat x = x + 1 until x > 3\nend\nlocal function inner() return M end\n--[[ function no() ]]\nreturn M\n',
    "zig": 'const std = @import("std");\npub const Service = struct {\n    name: []const u8,\n    pub fn run(self: *Service) void { helper(self.name); }\n};\nfn helper(x: []const u8) void { std.debug.print("{}", .{x}); }\ntest "runs" { helper("a"); }\n',
    "javascript": "import d, * as ns from 'x';\nclass A { go(x) { return `}` + x.size; } }\nconst f = function () { d.call(); };\n",
    "python": "import os.path as p\nfrom a import b, c as d\nclass A(Base):\n    size: int = 3\n    def f(self, x: 'No', y: List[Part] = b) -> Price:\n        return self.g(x).h + d(y)\n",
}

#: ``(name, kind, scope, line, end_line, visibility)`` of what each text defines.
DEFINED = {
    "rust": [("fmt", "import", (), 1, 1, "unknown"), ("Show", "import", (), 1, 1, "unknown"), ("Order", "struct", (), 2, 2, "public"), ("total", "method", ("Order",), 4, 4, "public"), ("main", "function", (), 7, 7, "unknown")],
    "typescript": [("read", "import", (), 1, 1, "unknown"), ("other", "import", (), 1, 1, "unknown"), ("Shape", "interface", (), 2, 2, "public"), ("area", "method", ("Shape",), 2, 2, "unknown"), ("Box", "class", (), 3, 6, "public"), ("area", "method", ("Box",), 5, 5, "unknown"), ("run", "function", (), 7, 7, "public"), ("y", "import", (), 8, 8, "unknown")],
    "go": [("fixture", "module", (), 1, 1, "unknown"), ("fmt", "import", ("fixture",), 3, 3, "unknown"), ("alias", "import", ("fixture",), 4, 4, "unknown"), ("Service", "struct", ("fixture",), 6, 6, "public"), ("Run", "method", ("fixture", "Service"), 7, 7, "public"), ("helper", "function", ("fixture",), 8, 8, "internal")],
    "java": [("List", "import", (), 2, 2, "unknown"), ("Order", "class", (), 3, 6, "public"), ("total", "method", ("Order",), 5, 5, "public")],
    "csharp": [("Text", "import", (), 1, 1, "unknown"), ("A", "module", (), 2, 2, "unknown"), ("Order", "class", ("A",), 2, 2, "public"), ("Run", "method", ("A", "Order"), 2, 2, "internal")],
    "ruby": [("http", "import", (), 1, 1, "unknown"), ("Shop", "module", (), 2, 12, "unknown"), ("Order", "class", ("Shop",), 3, 11, "unknown"), ("total?", "method", ("Shop", "Order"), 4, 9, "unknown"), ("make", "method", ("Shop", "Order"), 10, 10, "unknown")],
    "lua": [("helper", "import", (), 1, 1, "unknown"), ("M", "variable", (), 2, 2, "internal"), ("run", "function", ("M",), 3, 7, "public"), ("inner", "function", (), 8, 8, "internal")],
    "zig": [("std", "import", (), 1, 1, "unknown"), ("Service", "struct", (), 2, 5, "public"), ("run", "method", ("Service",), 4, 4, "public"), ("helper", "function", (), 6, 6, "internal"), ("runs", "function", (), 7, 7, "internal")],
    "javascript": [("d", "import", (), 1, 1, "unknown"), ("ns", "import", (), 1, 1, "unknown"), ("A", "class", (), 2, 2, "unknown"), ("go", "method", ("A",), 2, 2, "unknown"), ("f", "const", (), 3, 3, "unknown")],
    "python": [("path", "import", (), 1, 1, "unknown")],
}

#: Some ``(name, evidence, scope)`` that each text refers to.
REFERRED = {
    "rust": [("part7", "call", ("Order", "total")), ("value", "member_reference", ("Order", "total")), ("Part", "type_reference", ("Order",)), ("Price", "type_reference", ("Order",)), ("new", "call", ("main",)), ("Show", "type_reference", ())],
    "typescript": [("Base", "type_reference", ()), ("helper", "call", ("Box", "area")), ("w", "member_reference", ("Box", "area")), ("Box", "type_reference", ()), ("x", "bare_reference", ("run",)), ("read", "call", ("run",))],
    "go": [("Println", "call", ("fixture", "Service", "Run")), ("helper", "call", ("fixture", "Service", "Run")), ("Name", "member_reference", ("fixture", "Service", "Run"))],
    "java": [("count", "call", ("Order",)), ("List", "type_reference", ("Order",)), ("Part", "call", ("Order", "total")), ("size", "member_reference", ("Order", "total"))],
    "csharp": [("Part", "type_reference", ("A", "Order")), ("Go", "call", ("A", "Order", "Run"))],
    "ruby": [("Base", "bare_reference", ("Shop", "Order")), ("each", "member_reference", ("Shop", "Order", "total?")), ("helper", "call", ("Shop", "Order", "total?"))],
    "lua": [("transform", "call", ("M", "run")), ("print", "call", ("M", "run")), ("M", "bare_reference", ("inner",))],
    "zig": [("helper", "call", ("Service", "run")), ("name", "member_reference", ("Service", "run")), ("print", "call", ("helper",)), ("helper", "call", ("runs",))],
    "javascript": [("size", "member_reference", ("A", "go")), ("call", "call", ())],
    "python": [("Base", "type_reference", ()), ("int", "type_reference", ("A",)), ("List", "type_reference", ("A",)), ("Part", "type_reference", ("A",)), ("Price", "type_reference", ("A",)), ("b", "bare_reference", ("A",)), ("g", "call", ("A", "f")), ("h", "member_reference", ("A", "f")), ("d", "call", ("A", "f")), ("self", "bare_reference", ("A", "f"))],
}


@pytest.mark.parametrize("language", [n for n in TEXTS if n != "python"])
def test_definitions_with_scopes_and_ends(language):
    found, whole = lexed_symbols(TEXTS[language], language)
    got = [(s[0], s[1], s[3], s[4], s[6], s[8]) for s in found if s[2] == "definition"]
    assert whole and got == DEFINED[language]


@pytest.mark.parametrize("language", list(TEXTS))
def test_references_with_evidence(language):
    found = files.python_symbols(TEXTS[language]) if language == "python" else lexed_symbols(TEXTS[language], language)[0]
    got = {(s[0], s[9], s[3]) for s in found if s[2] == "reference"}
    assert set(REFERRED[language]) <= got
    lines = TEXTS[language].split("\n")
    for name, _, role, _, line, column, end, last, *_ in found:
        if role == "reference":
            assert line == end and lines[line - 1][column - 1 : last - 1] == name


def test_python_definitions():
    got = [(s[0], s[1], s[3], s[4], s[5], s[6]) for s in files.python_symbols(TEXTS["python"]) if s[2] == "definition"]
    assert got == [("p", "import", (), 1, 1, 1), ("b", "import", (), 2, 1, 2), ("d", "import", (), 2, 1, 2), ("A", "class", (), 3, 7, 6), ("f", "method", ("A",), 5, 9, 6)]


@pytest.mark.parametrize(("language", "text"), [("rust", "fn a() { {"), ("java", "}"), ("ruby", "def a\n"), ("go", 'func a() { "'), ("lua", "end"), ("zig", ""), ("rust", "fn"), ("rust", "impl"), ("go", "func ("), ("lua", "local"), ("java", "class"), ("csharp", "using"), ("zig", "const x ="), ("typescript", "import"), ("ruby", "require")])
def test_broken_texts(language, text):
    found, whole = lexed_symbols(text, language)
    assert isinstance(found, list) and whole == (text.strip() not in ("fn a() { {", "}", "def a", 'func a() { "', "end", "func ("))


def test_long_text_takes_linear_time():
    text = "fn f() { g(h.x); }\n" * 30_000
    found, whole = lexed_symbols(text, "rust")
    assert whole and len(found) == 4 * 30_000


def test_texts_are_dealt_by_their_number(spark, tmp_path):
    from pyspark.sql import functions as F

    from marlstone.plans import sources

    n = sources.TASK_TEXTS * 3
    spark.range(n).select(F.col("id").alias("o_orderkey")).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(9).select(F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.col("id").alias("l_partkey")).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    sizes = [r["count"] for r in sources.source_files(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == n and max(sizes) < n / 2


def test_asked_columns_and_evidence(spark):
    texts = spark.createDataFrame([(f"a.{n}", n, t) for n, t in TEXTS.items()] + [("b", "java", ""), ("c", "python", "def")], "path string, language string, text string")
    columns, evidence = ["path", "ord", "name", "scope", "status"], ("declaration", "call")
    whole = files.extract_symbols(texts, 5).filter("evidence in ('declaration', 'call')").select(*columns)
    some = files.extract_symbols(texts, 5, columns, evidence)
    assert some.schema.names == columns and sorted(some.collect()) == sorted(whole.collect()) != []
