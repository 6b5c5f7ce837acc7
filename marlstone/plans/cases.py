"""Registered queries over cases that each supplier repeats, each with the rows that it must give.

What these operators mean hangs on cases: which rule wins, how ties fall, what a
limit leaves out.  Every supplier of the given table has a copy of each case, with its key in
names and paths (``{g}``), so that the operators' joins and groupings meet as many copies
as there are suppliers and must keep them apart.  The SQL makes the expected rows of all
suppliers from those of one, set down by hand from the meaning of each operator.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions import paths as P
from marlstone.functions import text as X
from marlstone.functions.stage import write_stage
from marlstone.operators import changes, edges, graph, history, ranking, relationships, reports, topology
from marlstone.plans.registry import query
from marlstone.plans.tables import table

G = "{g}"
#: Bytes of the texts that a task makes.
PART_BYTES = 16 << 20


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, int | float):
        return repr(value)
    text = str(value).replace("'", "''")
    return f"'{text}'"


def case(columns: str, rows: list[tuple], once: bool = False):
    """Register a query with its expected rows, for each supplier or, ``once``, as they are; ``columns`` as ``name type`` pairs of SQL types."""
    named = [c.split() for c in columns.split(", ")]

    def add(f):
        value = lambda k, t: f"replace(c{k}, '{G}', CAST(s_suppkey AS VARCHAR))" if t == "VARCHAR" else f"c{k}"
        head = ", ".join(f'CAST({value(k, t)} AS {t}) AS "{n}"' for k, (n, t) in enumerate(named))
        types = ", ".join(f"CAST(c{k} AS {t}) AS c{k}" for k, (_, t) in enumerate(named))
        body = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
        keys = "(SELECT 1 AS s_suppkey)" if once else "supplier"
        return query(f"SELECT {head} FROM {keys}, (SELECT {types} FROM (VALUES {body}) AS v({', '.join(f'c{k}' for k in range(len(named)))}))")(f)

    return add


def spread(spark: SparkSession, sf_dir: str, rows: list, schema: str) -> DataFrame:
    """Rows for each supplier, with its key for ``{g}`` in texts and lists of texts."""
    kind = T.StructType.fromDDL(schema)
    told = [dict(zip(kind.names, r, strict=True)) if not isinstance(r, dict) else r for r in rows]
    made = F.from_json(F.lit(json.dumps(told)), T.ArrayType(kind))
    key = F.col("s_suppkey").cast("string")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey")
    # By bytes that are made, not by those that are read: a key becomes all texts of a case.
    parts = -(-suppliers.count() * len(json.dumps(told)) // PART_BYTES)
    some = (suppliers.repartition(parts, "s_suppkey") if parts > 1 else suppliers).select("s_suppkey", F.explode(made).alias("r"))

    def filled(f):
        c = F.col("r")[f.name]
        if not any(G in json.dumps(r[f.name]) for r in told):
            return c.alias(f.name)
        if f.dataType == T.StringType():
            return F.replace(c, F.lit(G), key).alias(f.name)
        if f.dataType == T.ArrayType(T.StringType()):
            return F.transform(c, lambda x: F.replace(x, F.lit(G), key)).alias(f.name)
        return c.alias(f.name)

    return some.select(*(filled(f) for f in kind.fields))


def _texts(spark: SparkSession, sf_dir: str, *values) -> DataFrame:
    return spread(spark, sf_dir, [(v,) for v in values], "x string")


# Functions

SPACED = "  a b\n", "", " x ", "plain{g}"


@case("x VARCHAR, y VARCHAR", list(zip(SPACED, ["a b", "", "x", "plain{g}"], strict=True)))
def fn_strip_space(spark, sf_dir):
    return _texts(spark, sf_dir, *SPACED).select("x", X.strip_space(F.col("x")).alias("y"))


@case("x VARCHAR, y VARCHAR", [("./a{g}/b/", "a{g}/b"), ("\\a{g}\\b", "a{g}/b"), (" src{g}/x ", "src{g}/x"), ("././a", "a"), ("/", "")])
def fn_normalise_path(spark, sf_dir):
    return _texts(spark, sf_dir, "./a{g}/b/", "\\a{g}\\b", " src{g}/x ", "././a", "/").select("x", P.normalise_path(F.col("x")).alias("y"))


@case("n INTEGER, y VARCHAR", [(5, "a b"), (6, "x" * 180), (7, "y" * 180 + "…"), (8, "")])
def fn_compact_context(spark, sf_dir):
    rows = spread(spark, sf_dir, [(5, " a \n\t b "), (6, "x" * 180), (7, "y" * 181), (8, " ")], "n int, x string")
    return rows.select("n", X.compact_context(F.col("x")).alias("y"))


@case("x VARCHAR, y VARCHAR", [("abc", "abc"), ("abcd", "abc…"), ("éüöä", "éüö…"), ("", "")])
def fn_bounded(spark, sf_dir):
    return _texts(spark, sf_dir, "abc", "abcd", "éüöä", "").select("x", X.bounded(F.col("x"), 3).alias("y"))


@case("x VARCHAR, y VARCHAR", [("a_b*c", "a\\_b\\*c"), ("x\ny", "x y"), ("<p>", "\\<p\\>"), ("plain", "plain")])
def fn_escape_markdown(spark, sf_dir):
    return _texts(spark, sf_dir, "a_b*c", "x\ny", "<p>", "plain").select("x", X.escape_markdown(F.col("x")).alias("y"))


@case("x VARCHAR, y VARCHAR", [('"./Lib/Util.ts"', "lib/util"), ("crate::map::graph;", "crate/map/graph"), ("../a/mod.rs", "a/mod"), ("pkg/__init__.py", "pkg/__init__"), ("pkg/__init__", "pkg"), ("a.py.py", "a"), ("x.ts.js", "x")])
def fn_normalise_hint(spark, sf_dir):
    """Endings go one kind after another, each as often as it stands; what an earlier kind would take of the rest stays."""
    return _texts(spark, sf_dir, '"./Lib/Util.ts"', "crate::map::graph;", "../a/mod.rs", "pkg/__init__.py", "pkg/__init__", "a.py.py", "x.ts.js").select("x", edges.normalise_hint(F.col("x")).alias("y"))


@case("x VARCHAR, language VARCHAR, hints VARCHAR", [("import { a } from './util{g}'", "typescript", "util{g}"), ('local h = require("net{g}.http")', "lua", "net{g}.http|net{g}/http"), ('local h = require("net{g}.http")', "ruby", "net{g}.http"), ("use crate::a{g}::{b, c};", "rust", "crate/a{g}/{b"), ("from .pkg{g} import x", "python", ".pkg{g}"), ("import os", "python", "")])
def fn_import_hints(spark, sf_dir):
    rows = [("import { a } from './util{g}'", "typescript"), ('local h = require("net{g}.http")', "lua"), ('local h = require("net{g}.http")', "ruby"), ("use crate::a{g}::{b, c};", "rust"), ("from .pkg{g} import x", "python"), ("import os", "python")]
    df = spread(spark, sf_dir, rows, "x string, language string")
    return df.select("x", "language", F.array_join(edges.module_hints(F.col("x"), F.col("language")), "|").alias("hints"))


@case("name VARCHAR, names VARCHAR", [("read", "parse|read|util"), ("np", "np|numpy"), ("graph", "graph")])
def fn_import_names(spark, sf_dir):
    rows = spread(spark, sf_dir, [("read", "import { parse as read } from './util'", ["util"]), ("np", "import numpy as np", []), ("graph", "use crate::map::graph", ["crate/map/graph"])], "name string, context string, hints array<string>")
    return rows.select("name", F.array_join(edges.import_names(F.col("name"), F.col("context"), F.col("hints")), "|").alias("names"))


@case("path VARCHAR, base VARCHAR, folder VARCHAR, system VARCHAR", [("a/b{g}/c.rs", "c.rs", "a/b{g}", "b{g}"), ("c.rs", "c.rs", ".", "."), ("a/c.rs", "c.rs", "a", "."), ("x/y{g}/c.rs", "c.rs", "x/y{g}", "x/y{g}")])
def fn_path_parts(spark, sf_dir):
    df = _texts(spark, sf_dir, "a/b{g}/c.rs", "c.rs", "a/c.rs", "x/y{g}/c.rs").select(F.col("x").alias("path"))
    return df.select("path", P.basename(F.col("path")).alias("base"), P.parent(F.col("path")).alias("folder"), P.subsystem(F.col("path"), F.lit("a")).alias("system"))


@case("path VARCHAR, kinds VARCHAR", [("README.md", "readme"), ("docs{g}/readme.rst", "readme"), ("CONTRIBUTING.md", "contributor_instructions"), ("AGENTS.md", "agent_instructions"), ("agents.md", ""), ("a{g}/Cargo.toml", "manifest"), ("Cargo.lock", "lockfile"), ("Makefile", "build_entry_point"), ("pom.xml", "manifest|build_entry_point"), ("justfile", "task_entry_point"), (".circleci/config.yml", "ci"), ("CODEOWNERS", "ownership"), ("LICENSE-MIT", "license"), ("src{g}/x.rs", "")])
def landmark_kinds(spark, sf_dir):
    names = ["README.md", "docs{g}/readme.rst", "CONTRIBUTING.md", "AGENTS.md", "agents.md", "a{g}/Cargo.toml", "Cargo.lock", "Makefile", "pom.xml", "justfile", ".circleci/config.yml", "CODEOWNERS", "LICENSE-MIT", "src{g}/x.rs"]
    return _texts(spark, sf_dir, *names).select(F.col("x").alias("path"), F.array_join(P.landmark_kinds(F.col("x")), "|").alias("kinds"))


@case("path VARCHAR, role VARCHAR", [("src/main.rs", "entry_point"), ("examples/x.rs", "entry_point"), ("a{g}/examples/b.py", "entry_point"), ("tests/main.rs", "entry_point"), ("tests/x{g}.rs", "test"), ("x{g}_test.go", "test"), ("src/ApiClient.ts", "gateway"), ("src/server.py", "gateway"), ("test/x{g}.rs", "source"), ("src/cli.js", "entry_point")])
def snippet_roles(spark, sf_dir):
    df = _texts(spark, sf_dir, "src/main.rs", "examples/x.rs", "a{g}/examples/b.py", "tests/main.rs", "tests/x{g}.rs", "x{g}_test.go", "src/ApiClient.ts", "src/server.py", "test/x{g}.rs", "src/cli.js")
    return df.select(F.col("x").alias("path"), P.snippet_role(F.col("x"), F.array(F.lit("src/cli.js"))).alias("role"))


@case("symbol VARCHAR, confidence VARCHAR, visibility VARCHAR, weight DOUBLE", [("run", "high", "public", 1.0), ("run", "medium", "internal", 0.4), ("_x", "high", "public", 0.25), ("Data", "low", "private", 0.021875), ("run", "low", "unknown", 0.175)])
def edge_weights(spark, sf_dir):
    rows = spread(spark, sf_dir, [("run", "high", "public"), ("run", "medium", "internal"), ("_x", "high", "public"), ("Data", "low", "private"), ("run", "low", "unknown")], "symbol string, confidence string, visibility string")
    return rows.withColumn("weight", F.round(edges.edge_weight(F.col("symbol"), F.col("confidence"), F.col("visibility")), 9))


@case("reach VARCHAR, depth INTEGER, priority BIGINT", [("direct", 1, 3_000_000_000), ("transitive", 2, 1_925_000_000), ("transitive", 5, 1_700_000_000), ("inferred", 1, 1_000_000_000), ("inferred", 16, 0)])
def impact_priorities(spark, sf_dir):
    rows = spread(spark, sf_dir, [("direct", 1), ("transitive", 2), ("transitive", 5), ("inferred", 1), ("inferred", 16)], "reach string, depth int")
    # The sixteenth step takes fifteen times 75 millions off a thousand millions, and no score is below zero.
    return rows.withColumn("priority", graph.impact_priority(F.col("reach"), F.col("depth")))


@case("n INTEGER, first INTEGER, last INTEGER", [(1, 2, 2), (2, 3, 4), (3, 2, 2), (4, None, None), (5, 1, 1)])
def changed_ranges(spark, sf_dir):
    """The lines that a change touches: what is left between the common beginning and end, one line at least."""
    rows = spread(spark, sf_dir, [(1, list("abc"), list("axc")), (2, list("abc"), list("abxyc")), (3, list("abc"), list("ac")), (4, list("ab"), list("ab")), (5, [], list("a"))], "n int, a array<string>, b array<string>")
    return rows.select("n", changes.changed_range(F.col("a"), F.col("b")).alias("r")).select("n", F.col("r.start").alias("first"), F.col("r.end").alias("last"))


# Filters

HEADS = [("// Code generated by x. DO NOT EDIT.", True), ("# @generated", True), ("/* This file is generated */", True), ("let s = '@generated';", False), ("\n" * 16 + "// @generated", False), ("<!-- automatically generated -->", True), ("// code generated", False)]


@case("n INTEGER, hit BOOLEAN", [(k, hit) for k, (_, hit) in enumerate(HEADS)])
def filter_generated_header(spark, sf_dir):
    return spread(spark, sf_dir, [(k, t) for k, (t, _) in enumerate(HEADS)], "n int, t string").select("n", P.generated_header(F.col("t")).alias("hit"))


MINIFIED = [("a.js", "x" * 1600, True), ("a.css", "x" * 1600, False), ("a.js", "x" * 1023, False), ("a.ts", "x " * 800, False), ("a.js", ("x" * 600 + "\n") * 3, True), ("a.js", ("x" * 600 + "\n") * 4, False), ("a.js", "x" * 65_537, False), ("b.mjs", "x" * 511 + "\n" + "y" * 511 + "\n", True)]


@case("n INTEGER, hit BOOLEAN", [(k, hit) for k, (_, _, hit) in enumerate(MINIFIED)])
def filter_minified(spark, sf_dir):
    return spread(spark, sf_dir, [(k, p, t) for k, (p, t, _) in enumerate(MINIFIED)], "n int, p string, t string").select("n", P.looks_minified(F.col("p"), F.col("t")).alias("hit"))


@case("path VARCHAR, out BOOLEAN", [("a.log", True), ("x{g}/a.log", True), ("keep.log", False), ("build/x.o", True), ("src{g}/build/x.o", True), ("docs/a{g}.txt", True), ("x/docs/a{g}.txt", False), ("src/a{g}.rs", False)])
def filter_excluded(spark, sf_dir):
    df = _texts(spark, sf_dir, "a.log", "x{g}/a.log", "keep.log", "build/x.o", "src{g}/build/x.o", "docs/a{g}.txt", "x/docs/a{g}.txt", "src/a{g}.rs")
    return df.select(F.col("x").alias("path"), P.excluded(F.col("x"), ["*.log", "!keep.log", "build/", "/docs"]).alias("out"))


@case("path VARCHAR, safe BOOLEAN", [("a/b{g}.rs", True), ("../a{g}", False), ("a{g}/./b", False), ("/a{g}", False), ("a//b", False), ("C:x", False), ("a\\b", False), ("", False), ("..a/b", True)])
def filter_safe_paths(spark, sf_dir):
    return _texts(spark, sf_dir, "a/b{g}.rs", "../a{g}", "a{g}/./b", "/a{g}", "a//b", "C:x", "a\\b", "", "..a/b").select(F.col("x").alias("path"), P.safe_path(F.col("x")).alias("safe"))


@case("path VARCHAR, language VARCHAR", [("a.rs", "rust"), ("A.PY", "python"), ("x.d.ts", "typescript"), (".busted", "lua"), ("bin/run", "lua"), ("bin/other", None), ("run", None), ("x.unknown", None)])
def languages(spark, sf_dir):
    rows = spread(spark, sf_dir, [("a.rs", ""), ("A.PY", ""), ("x.d.ts", ""), (".busted", ""), ("bin/run", "#!/usr/bin/env lua"), ("bin/other", "#!/bin/sh"), ("run", "#!/usr/bin/lua"), ("x.unknown", "")], "path string, line string")
    return rows.select("path", P.language_of(F.col("path"), F.col("line")).alias("language"))


OMITTED = [
    ("skip/a{g}.rs", 1, "x", False, "rust", "explicit_exclusion"), ("l.rs", 1, "x", True, "rust", "symlink"), ("dist/a{g}.rs", 9, "x", False, "rust", "classified"), ("vendor/b.c", 9, "x", False, None, "classified"), ("a.c", 9, "x", False, None, "unsupported_language"), ("Makefile", 9, "x", False, None, "unsupported_language"),
    ("a.txt", 99, "x", False, None, "non_source"), ("big{g}.rs", 99, "a\0", False, "rust", "oversized"), ("bin.rs", 9, "a\0", False, "rust", "binary"), ("raw.rs", 9, None, False, "rust", "binary"), ("gen{g}.rs", 9, "// @generated\n", False, "rust", "classified"), ("vendor/shown/a.rs", 9, "// @generated\n", False, "rust", None), ("ok{g}.rs", 9, "x", False, "rust", None),
]


@case("path VARCHAR, reason VARCHAR", [(r[0], r[-1]) for r in OMITTED])
def omission_reasons(spark, sf_dir):
    """Exclusion, symlink, class of the path, language, size, bytes, class of the text, in this order; a focus path takes classes back."""
    df = spread(spark, sf_dir, [r[:-1] for r in OMITTED], "path string, size int, text string, symlink boolean, language string")
    reason = topology.omission_reason(F.col("path"), F.col("size"), F.col("text"), F.col("symlink"), F.col("language"), 50, ["skip/"], ["vendor/shown"])
    return df.select("path", reason.alias("reason"))


@case("path VARCHAR, kind VARCHAR, manifests INTEGER", [("w{g}", "workspace", 1), ("a{g}", "mixed", 2), ("b{g}", "package", 1), ("c{g}", "unknown", 1)])
def project_roots(spark, sf_dir):
    """Two families of manifests are mixed; a role nobody read is unknown; a workspace manifest a workspace; else a package."""
    f = _texts(spark, sf_dir, "w{g}/package.json", "a{g}/Cargo.toml", "a{g}/go.mod", "b{g}/pyproject.toml", "c{g}/go.mod", "src/x.rs").select(F.col("x").alias("path"))
    roles = spread(spark, sf_dir, [("w{g}/package.json", "workspace"), ("a{g}/Cargo.toml", "package"), ("a{g}/go.mod", "package"), ("b{g}/pyproject.toml", "package")], "path string, role string")
    return topology.project_roots(f, roles).select("path", "kind", F.size("manifests").alias("manifests"))


# History

@case("id VARCHAR, name VARCHAR, email VARCHAR", [("1-{g}", "Ann", "ann{g}@new"), ("2-{g}", "Bob", "bob{g}@new"), ("3-{g}", "Late", "x{g}@new"), ("4-{g}", "Other", "shared{g}@x"), ("5-{g}", "Unknown", "e{g}@x"), ("6-{g}", "Only Mail", "m{g}@new")])
def mailmap_identities(spark, sf_dir):
    """A name and address before an address alone; of one key the last line; names without a value stay."""
    mail = spread(
        spark, sf_dir, [("ann b", "shared{g}@x", "Ann", "ann{g}@new", 1), ("BOB", "Shared{g}@X", "Bob", "bob{g}@new", 2), (None, "x{g}@x", "Early", "x{g}@old", 3), (None, "X{g}@x", "Late", "x{g}@new", 4), (None, "m{g}@x", None, "m{g}@new", 5)],
        "raw_name string, raw_email string, name string, email string, line int",
    )
    c = spread(spark, sf_dir, [("1-{g}", "Ann B", "shared{g}@x"), ("2-{g}", "Bob", "SHARED{g}@x"), ("3-{g}", "Anyone", "x{g}@x"), ("4-{g}", "Other", "shared{g}@X"), ("5-{g}", "  ", "e{g}@x"), ("6-{g}", "Only Mail", "m{g}@x")], "id string, author_name string, author_email string")
    return history.with_identities(c, mail).select("id", F.col("author_name").alias("name"), F.col("author_email").alias("email"))


# Edges and relations of a small tree

SYMBOL = "path string, language string, ord int, name string, kind string, role string, evidence string, context string, visibility string, modules array<string>, scope array<string>, line int, column int"


def _symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [
        ("src/util{g}.ts", "typescript", 0, "parse{g}", "function", "definition", "declaration", "function parse{g}()", "public", None, [], 1, 1),
        ("src/other{g}.ts", "typescript", 0, "parse{g}", "function", "definition", "declaration", "function parse{g}()", "private", None, [], 1, 1),
        ("src/app{g}.ts", "typescript", 0, "read{g}", "import", "definition", "import", "import { parse{g} as read{g} } from './util{g}'", "unknown", None, [], 1, 1),
        ("src/app{g}.ts", "typescript", 1, "start{g}", "function", "definition", "declaration", "function start{g}()", "public", None, [], 3, 1),
        ("src/app{g}.ts", "typescript", 2, "read{g}", "function", "reference", "call", "read{g}()", "unknown", None, ["start{g}"], 4, 3),
        ("src/app{g}.ts", "typescript", 3, "start{g}", "function", "reference", "call", "start{g}()", "unknown", None, [], 6, 1),
        ("src/app{g}.ts", "typescript", 4, "parse{g}", "function", "reference", "bare_reference", "parse{g}", "unknown", None, [], 7, 1),
        ("tests/app{g}.ts", "typescript", 0, "start{g}", "import", "definition", "import", "import { start{g} } from '../src/app{g}'", "unknown", None, [], 1, 1),
        ("tests/app{g}.ts", "typescript", 1, "start{g}", "function", "reference", "call", "start{g}()", "unknown", None, [], 3, 1),
        ("p{g}/a.go", "go", 0, "Run{g}", "function", "definition", "declaration", "func Run{g}()", "public", ["p"], [], 1, 1),
        ("p{g}/b.go", "go", 0, "Run{g}", "function", "reference", "call", "Run{g}()", "unknown", ["p"], [], 2, 1),
        ("q{g}/c.go", "go", 0, "Run{g}", "function", "reference", "call", "Run{g}()", "unknown", ["p"], [], 2, 1),
        ("m{g}/x.py", "python", 0, "thing{g}", "class", "definition", "declaration", "class thing{g}", "public", None, [], 1, 1),
        ("m{g}/y.py", "python", 0, "thing{g}", "class", "definition", "declaration", "class thing{g}", "public", None, [], 1, 1),
        ("app{g}.py", "python", 0, "thing{g}", "import", "definition", "import", "import thing{g}", "unknown", None, [], 1, 1),
        ("app{g}.py", "python", 1, "thing{g}", "type", "reference", "type_reference", "thing{g}", "unknown", None, [], 2, 1),
        ("app{g}.py", "python", 2, "data", "function", "reference", "call", "data()", "unknown", None, [], 3, 1),
    ]
    return spread(spark, sf_dir, rows, SYMBOL)


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(p, "typescript" if p.endswith("ts") else "go" if p.endswith("go") else "python", "partial" if p == "src/other{g}.ts" else "analyzed", "src" if p.startswith("src") else ".") for p in ("src/util{g}.ts", "src/other{g}.ts", "src/app{g}.ts", "tests/app{g}.ts", "p{g}/a.go", "p{g}/b.go", "q{g}/c.go", "m{g}/x.py", "m{g}/y.py", "app{g}.py")]
    return spread(spark, sf_dir, rows, "path string, language string, status string, project_root string")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _symbols(spark, sf_dir)
    return edges.describe(edges.answers(edges.questions(s), s))


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and relations, written: operations read{g} them several times."""
    made = relationships.nodes(_files(spark, sf_dir), _symbols(spark, sf_dir)), relationships.build(_files(spark, sf_dir), _edges(spark, sf_dir), _symbols(spark, sf_dir))
    return write_stage(made[0], "nodes")[0], write_stage(made[1], "relations")[0]


EDGES = [
    ("app{g}.py", "m{g}/x.py", "thing{g}", True, "imported_name", "medium", "public", "m{g}/x.py|m{g}/y.py"), ("app{g}.py", "m{g}/y.py", "thing{g}", True, "imported_name", "medium", "public", "m{g}/x.py|m{g}/y.py"),
    ("p{g}/b.go", "p{g}/a.go", "Run{g}", False, "same_module", "high", "public", "p{g}/a.go"), ("src/app{g}.ts", "src/app{g}.ts", "start{g}", False, "same_file_explicit", "high", "public", "src/app{g}.ts"),
    ("src/app{g}.ts", "src/util{g}.ts", "read{g}", False, "imported_module", "high", "public", "src/util{g}.ts"), ("tests/app{g}.ts", "src/app{g}.ts", "start{g}", False, "imported_module", "high", "public", "src/app{g}.ts"),
]


@case("source VARCHAR, target VARCHAR, symbol VARCHAR, ambiguous BOOLEAN, reason VARCHAR, confidence VARCHAR, visibility VARCHAR, candidates VARCHAR", EDGES)
def edges_by_tier(spark, sf_dir):
    """All four tiers, an alias that leads to another name, and references that have no edge: bare, generic, and of another folder's package."""
    return _edges(spark, sf_dir).select("source", "target", "symbol", "ambiguous", F.col("resolution_reason").alias("reason"), "confidence", F.col("target_visibility").alias("visibility"), F.array_join("candidates", "|").alias("candidates"))


@query("SELECT DISTINCT source, symbol, source || ':' || symbol || ':' || reason || ':' || sha256(replace(c, '|', chr(0))) AS candidate_group FROM (SELECT " + ", ".join(f"replace(c{k}, '{G}', CAST(s_suppkey AS VARCHAR)) AS {n}" for k, n in enumerate(("source", "symbol", "reason", "c"))) + " FROM supplier, (VALUES " + ", ".join(f"('{r[0]}', '{r[2]}', '{r[4]}', '{r[7]}')" for r in EDGES) + ") AS v(c0, c1, c2, c3))")
def candidate_groups(spark, sf_dir):
    """Every edge has the group of its file, name, reason and candidates."""
    return _edges(spark, sf_dir).select("source", "symbol", "candidate_group").distinct()


NODE = {
    "read_call": "symbol:src/app{g}.ts:4:3:4:3:reference:function:read{g}", "read_import": "symbol:src/app{g}.ts:1:1:1:1:definition:import:read{g}", "start{g}": "symbol:src/app{g}.ts:3:1:3:1:definition:function:start{g}", "start_call": "symbol:src/app{g}.ts:6:1:6:1:reference:function:start{g}",
    "parse{g}": "symbol:src/util{g}.ts:1:1:1:1:definition:function:parse{g}", "test_import": "symbol:tests/app{g}.ts:1:1:1:1:definition:import:start{g}", "test_call": "symbol:tests/app{g}.ts:3:1:3:1:reference:function:start{g}",
}


@case(
    "kind VARCHAR, source VARCHAR, target VARCHAR, symbol VARCHAR, confidence VARCHAR",
    [
        ("import", "file:src/app{g}.ts", "file:src/util{g}.ts", "read{g}", "high"), ("import", NODE["read_import"], NODE["parse{g}"], "read{g}", "high"), ("call", NODE["start{g}"], NODE["parse{g}"], "read{g}", "high"),
        ("dependency", "file:src/app{g}.ts", "file:src/app{g}.ts", "start{g}", "high"), ("call", NODE["start_call"], NODE["start{g}"], "start{g}", "high"),
        ("import", "file:tests/app{g}.ts", "file:src/app{g}.ts", "start{g}", "high"), ("import", NODE["test_import"], NODE["start{g}"], "start{g}", "high"), ("call", NODE["test_call"], NODE["start{g}"], "start{g}", "high"),
    ],
)
def relations_of_calls(spark, sf_dir):
    """Relations of the TypeScript files: an import renames what it takes; a call starts at the function around it."""
    return _graph(spark, sf_dir)[1].filter("source_path like '%.ts'").select("kind", "source", "target", "symbol", "confidence")


@case("operation VARCHAR, node VARCHAR, confidence VARCHAR, ambiguous BOOLEAN", [
    ("symbol", NODE["parse{g}"], "high", False), ("symbol", "symbol:src/other{g}.ts:1:1:1:1:definition:function:parse{g}", "medium", False), ("symbol", "symbol:src/app{g}.ts:7:1:7:1:reference:function:parse{g}", "high", False),
    ("definitions", NODE["parse{g}"], "high", False), ("definitions", "symbol:src/other{g}.ts:1:1:1:1:definition:function:parse{g}", "medium", False), ("references", "symbol:src/app{g}.ts:7:1:7:1:reference:function:parse{g}", "high", False),
    ("imports", "file:src/util{g}.ts", "high", False), ("dependencies", "file:m{g}/x.py", "medium", True), ("dependencies", "file:m{g}/y.py", "medium", True),
    ("reverse_dependencies", "file:tests/app{g}.ts", "high", False), ("tests", "file:tests/app{g}.ts", "high", False),
    ("callers", NODE["start_call"], "high", False), ("callers", NODE["test_call"], "high", False), ("callees", NODE["parse{g}"], "high", False),
], once=True)
def relationship_operations(spark, sf_dir):
    """All nine operations; a node that is an anchor itself is no answer."""
    n, r = _graph(spark, sf_dir)
    asked = {"symbol": "PARSE{g}", "definitions": "parse{g}", "references": "parse{g}", "imports": "src/app{g}.ts", "dependencies": "app{g}.py", "reverse_dependencies": "./src/app{g}.ts", "tests": "src/app{g}.ts", "callers": "start{g}", "callees": "start{g}"}
    out = None
    for operation, target in asked.items():
        found = relationships.candidates(n, r, operation, target.replace(G, "1")).select(F.lit(operation).alias("operation"), "node", "confidence", "ambiguous")
        out = found if out is None else out.unionByName(found)
    return out


@case("target VARCHAR, node VARCHAR", [("src/app{g}.ts", "file:src/app{g}.ts"), ("parse{g}", "file:src/util{g}.ts"), ("parse{g}", "file:src/other{g}.ts"), ("parse{g}", "file:src/app{g}.ts"), ("m{g}/", "file:m{g}/x.py"), ("m{g}/", "file:m{g}/y.py"), ("m{g}", "file:m{g}/x.py"), ("m{g}", "file:m{g}/y.py")], once=True)
def anchor_files(spark, sf_dir):
    """A path, else the files with a symbol of that name, else the files of a folder."""
    n, out = _graph(spark, sf_dir)[0], None
    for target in ("src/app{g}.ts", "parse{g}", "m{g}/", "m{g}"):
        found = relationships.file_anchors(n, target.replace(G, "1").rstrip("/")).select(F.lit(target.replace(G, "1")).alias("target"), F.col("id").alias("node"))
        out = found if out is None else out.unionByName(found)
    return out


# Walks

LINK = "src string, dst string, kind string, confidence string, ambiguous boolean, id string"
LINKS = [
    ("a{g}", "b{g}", "call", "high", False, "1-{g}"), ("a{g}", "c{g}", "dependency", "high", False, "2-{g}"), ("a{g}", "d{g}", "call", "low", False, "3-{g}"), ("a{g}", "e{g}", "call", "high", True, "4-{g}"),
    ("c{g}", "f{g}", "import", "medium", False, "5-{g}"), ("b{g}", "f{g}", "call", "low", False, "6-{g}"), ("f{g}", "a{g}", "call", "high", False, "7-{g}"), ("d{g}", "g{g}", "call", "high", False, "8-{g}"),
]


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark, sf_dir, LINKS, LINK)


def _at(spark: SparkSession, sf_dir: str, *nodes: str) -> DataFrame:
    return spread(spark, sf_dir, [(n,) for n in nodes], "node string")


@case("node VARCHAR, depth INTEGER, reach VARCHAR", [("f{g}", 0, "seed"), ("c{g}", 1, "direct"), ("b{g}", 1, "inferred"), ("a{g}", 2, "transitive")])
def impact_reach(spark, sf_dir):
    """An unsure edge makes what it reaches inferred; the seed's own target is met by the walk as well, which tells how."""
    return graph.impact(_links(spark, sf_dir), _at(spark, sf_dir, "f{g}"), work=None)


@case("node VARCHAR", [("a{g}",), ("b{g}",)])
def walk_in_project(spark, sf_dir):
    """Edges that leave the project are counted, not followed."""
    p = spread(spark, sf_dir, [("a{g}", "x"), ("b{g}", "x"), ("c{g}", "y"), ("d{g}", "y"), ("e{g}", "y"), ("f{g}", "y"), ("g{g}", "x")], "node string, root string")
    w = graph.walk(_links(spark, sf_dir), _at(spark, sf_dir, "a{g}"), depth=4, work=None, projects=p)
    return w.nodes.select("node").filter(F.lit(w.omitted_boundaries > 0))


# Ranking

@case("path VARCHAR, seeds VARCHAR, direct INTEGER", [
    ("src/app{g}.ts", "language:typescript|project:src|search_term:pars|task_term:app", 4), ("src/util{g}.ts", "language:typescript|project:src|search_term:pars", 3),
    ("src/other{g}.ts", "language:typescript|project:src|search_term:pars", 3), ("tests/app{g}.ts", "language:typescript|path:tests|task_term:app", 3), ("app{g}.py", "task_term:app", 1),
])
def seed_matches(spark, sf_dir):
    """Terms meet paths, names and contexts; paths and projects by prefix; a name that nothing has meets nothing."""
    out = ranking.direct_matches(_files(spark, sf_dir), _symbols(spark, sf_dir), terms=["app", "pars"], names=["READ"], paths=["tests"], languages=["typescript"], projects=["src"], changed_paths=["src/util.ts"], changed_symbols=["start"], task_terms=["app"])
    return out.select("path", F.array_join(F.transform("seeds", lambda s: F.concat_ws(":", s["kind"], s["value"])), "|").alias("seeds"), "direct")


@case("path VARCHAR, texts BIGINT, paths BIGINT", [("src/app{g}.ts", 2, 1), ("src/util{g}.ts", 1, 1), ("src/other{g}.ts", 1, 1), ("tests/app{g}.ts", 1, 0)])
def focus_of_symbols(spark, sf_dir):
    """A focus text is looked for in paths, names and contexts."""
    return ranking.focus_hits(_files(spark, sf_dir), _symbols(spark, sf_dir), ["PARSE", "start"], ["src"])


# Reports

@case("path VARCHAR, score BIGINT, reach VARCHAR, depth INTEGER, confidence VARCHAR, evidence VARCHAR", [("a{g}", 3_000, "direct", 1, "medium", "graph|structural"), ("b{g}", 1_000, "inferred", 0, "low", "structural"), ("c{g}", 50, "transitive", 2, "low", "graph")])
def impact_target_merge(spark, sf_dir):
    """The best score decides reach and depth, ties by the stronger reach, then the smaller depth; nothing is surer than medium."""
    rows = [("a{g}", 3_000, "direct", 1, "graph", "r1", "high"), ("a{g}", 1_000, "inferred", 0, "structural", "r2", "medium"), ("b{g}", 1_000, "inferred", 0, "structural", "r2", "low"), ("c{g}", 50, "inferred", 1, "graph", "r1", "low"), ("c{g}", 50, "transitive", 3, "graph", "r1", "medium"), ("c{g}", 50, "transitive", 2, "graph", "r3", "medium")]
    out = reports.merged_targets(spread(spark, sf_dir, rows, "path string, score long, reach string, depth int, evidence string, reason string, confidence string"))
    return out.select("path", "score", "reach", "depth", "confidence", F.array_join("evidence", "|").alias("evidence"))


@case("path VARCHAR, project_root VARCHAR", [("p{g}/tests/a.rs", "p{g}"), ("p{g}/tests/deep/b.rs", "p{g}")])
def tests_of_changed_projects(spark, sf_dir):
    """Files in a test root of a project that holds a change."""
    one = lambda *p: _texts(spark, sf_dir, *p).select(F.col("x").alias("path"))
    return reports.likely_tests(one("p{g}/tests/a.rs", "p{g}/tests/deep/b.rs", "q{g}/tests/c.rs", "tests/d.rs", "p{g}/src/x.rs"), one("p{g}/src/x.rs", "p{g}/new.rs"), one("p{g}/tests", "q{g}/tests", "tests"), one(".", "p{g}", "q{g}"))


@case("purpose VARCHAR, path VARCHAR, score BIGINT, evidence VARCHAR, confidence VARCHAR", [("tests", "a{g}", 12, "x|y", "high"), ("runtime", "a{g}", 1, "x", "low")])
def reading_merge(spark, sf_dir):
    """Reasons to read a file add up."""
    rows = spread(spark, sf_dir, [("tests", "a{g}", 5, "y", "medium"), ("tests", "a{g}", 7, "x", "high"), ("runtime", "a{g}", 1, "x", "low")], "purpose string, path string, score long, evidence string, confidence string")
    return reports.merged_reading(rows).select("purpose", "path", "score", F.array_join("evidence", "|").alias("evidence"), "confidence")


@case("path VARCHAR, name VARCHAR", [("a{g}", "hub"), ("b{g}", "shown")])
def best_definitions(spark, sf_dir):
    """Most referred to, then public, then first by place."""
    s = spread(spark, sf_dir, [("a{g}", "first", 0, "definition", "public"), ("a{g}", "hub", 1, "definition", "private"), ("b{g}", "hidden", 0, "definition", "private"), ("b{g}", "shown", 1, "definition", "public"), ("b{g}", "later", 2, "definition", "public"), ("b{g}", "ref", 3, "reference", "public")], "path string, name string, ord int, role string, visibility string")
    refs = spread(spark, sf_dir, [("a{g}", "hub", 4)], "target string, symbol string, references long")
    return ranking.best_definitions(s, refs).select("path", "name")
