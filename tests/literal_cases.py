"""Small tables for operators whose meaning hangs on cases, with the rows expected, set down by hand."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import paths as P
from marlstone.functions import text as X
from marlstone.functions.stage import write_stage
from marlstone.operators import budget, changes, edges, graph, history, ranking, relationships, reports, search, topology

CASES: dict[str, tuple[Callable[[SparkSession], DataFrame], list[str], list[tuple]]] = {}


def case(columns: str, rows: list[tuple]):
    """Keep a function with its expected rows; ``columns`` as ``name type`` pairs."""
    names = [c.split()[0] for c in columns.split(", ")]

    def add(f):
        CASES[f.__name__] = f, names, rows
        return f

    return add


def _texts(spark: SparkSession, *values) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], "x string")


# Functions

SPACED = "  a b\n", "", " x ", "plain"


@case("x VARCHAR, y VARCHAR", list(zip(SPACED, ["a b", "", "x", "plain"], strict=True)))
def fn_strip_space(spark):
    return _texts(spark, *SPACED).select("x", X.strip_space(F.col("x")).alias("y"))


@case("x VARCHAR, y VARCHAR", [("./a/b/", "a/b"), ("\\a\\b", "a/b"), (" src/x ", "src/x"), ("././a", "a"), ("/", "")])
def fn_normalise_path(spark):
    return _texts(spark, "./a/b/", "\\a\\b", " src/x ", "././a", "/").select("x", P.normalise_path(F.col("x")).alias("y"))


@case("place INTEGER, seed VARCHAR", [(0, "Alpha"), (1, "beta"), (2, "Gamma")])
def fn_seeds(spark):
    """Seeds trimmed, without empty ones, in order without case, each once: of equal ones the first stands."""
    return spark.createDataFrame(list(enumerate(X.seeds([" beta", "Gamma", "", "Alpha", "BETA", "gamma "]))), "place int, seed string")


@case("n INTEGER, y VARCHAR", [(5, "a b"), (6, "x" * 180), (7, "y" * 180 + "…"), (8, "")])
def fn_compact_context(spark):
    rows = spark.createDataFrame([(5, " a \n\t b "), (6, "x" * 180), (7, "y" * 181), (8, " ")], "n int, x string")
    return rows.select("n", X.compact_context(F.col("x")).alias("y"))


@case("x VARCHAR, y VARCHAR", [("abc", "abc"), ("abcd", "abc…"), ("éüöä", "éüö…"), ("", "")])
def fn_bounded(spark):
    return _texts(spark, "abc", "abcd", "éüöä", "").select("x", X.bounded(F.col("x"), 3).alias("y"))


@case("s BIGINT, month VARCHAR, stamp VARCHAR, day VARCHAR", [(0, "1970-01", "1970-01-01T00:00:00Z", "1970-01-01"), (-1, "1969-12", "1969-12-31T23:59:59Z", "1969-12-31"), (951_827_696, "2000-02", "2000-02-29T12:34:56Z", "2000-02-29")])
def fn_times(spark):
    rows = spark.createDataFrame([(0,), (-1,), (951_827_696,)], "s long")
    return rows.select("s", X.month_of(F.col("s")).alias("month"), X.rfc3339(F.col("s")).alias("stamp"), X.capture_date(F.col("s")).alias("day"))


@case("x VARCHAR, y VARCHAR", [("a_b*c", "a\\_b\\*c"), ("x\ny", "x y"), ("<p>", "\\<p\\>"), ("plain", "plain")])
def fn_escape_markdown(spark):
    return _texts(spark, "a_b*c", "x\ny", "<p>", "plain").select("x", X.escape_markdown(F.col("x")).alias("y"))


@case("x VARCHAR, y VARCHAR", [('"./Lib/Util.ts"', "lib/util"), ("crate::map::graph;", "crate/map/graph"), ("../a/mod.rs", "a/mod"), ("pkg/__init__.py", "pkg/__init__"), ("pkg/__init__", "pkg"), ("a.py.py", "a"), ("x.ts.js", "x")])
def fn_normalise_hint(spark):
    """Endings go one kind after another, each as often as it stands; what an earlier kind would take of the rest stays."""
    return _texts(spark, '"./Lib/Util.ts"', "crate::map::graph;", "../a/mod.rs", "pkg/__init__.py", "pkg/__init__", "a.py.py", "x.ts.js").select("x", edges.normalise_hint(F.col("x")).alias("y"))


@case("x VARCHAR, language VARCHAR, hints VARCHAR", [("import { a } from './util'", "typescript", "util"), ('local h = require("net.http")', "lua", "net.http|net/http"), ('local h = require("net.http")', "ruby", "net.http"), ("use crate::a::{b, c};", "rust", "crate/a/{b"), ("from .pkg import x", "python", ".pkg"), ("import os", "python", "")])
def fn_import_hints(spark):
    rows = [("import { a } from './util'", "typescript"), ('local h = require("net.http")', "lua"), ('local h = require("net.http")', "ruby"), ("use crate::a::{b, c};", "rust"), ("from .pkg import x", "python"), ("import os", "python")]
    df = spark.createDataFrame(rows, "x string, language string")
    return df.select("x", "language", F.array_join(edges.module_hints(F.col("x"), F.col("language")), "|").alias("hints"))


@case("name VARCHAR, names VARCHAR", [("read", "parse|read|util"), ("np", "np|numpy"), ("graph", "graph")])
def fn_import_names(spark):
    rows = spark.createDataFrame([("read", "import { parse as read } from './util'", ["util"]), ("np", "import numpy as np", []), ("graph", "use crate::map::graph", ["crate/map/graph"])], "name string, context string, hints array<string>")
    return rows.select("name", F.array_join(edges.import_names(F.col("name"), F.col("context"), F.col("hints")), "|").alias("names"))


@case("path VARCHAR, base VARCHAR, folder VARCHAR, system VARCHAR", [("a/b/c.rs", "c.rs", "a/b", "b"), ("c.rs", "c.rs", ".", "."), ("a/c.rs", "c.rs", "a", "."), ("x/y/c.rs", "c.rs", "x/y", "x/y")])
def fn_path_parts(spark):
    df = _texts(spark, "a/b/c.rs", "c.rs", "a/c.rs", "x/y/c.rs").select(F.col("x").alias("path"))
    return df.select("path", P.basename(F.col("path")).alias("base"), P.parent(F.col("path")).alias("folder"), P.subsystem(F.col("path"), F.lit("a")).alias("system"))


@case("path VARCHAR, kinds VARCHAR", [("README.md", "readme"), ("docs/readme.rst", "readme"), ("CONTRIBUTING.md", "contributor_instructions"), ("AGENTS.md", "agent_instructions"), ("agents.md", ""), ("a/Cargo.toml", "manifest"), ("Cargo.lock", "lockfile"), ("Makefile", "build_entry_point"), ("pom.xml", "manifest|build_entry_point"), ("justfile", "task_entry_point"), (".circleci/config.yml", "ci"), ("CODEOWNERS", "ownership"), ("LICENSE-MIT", "license"), ("src/x.rs", "")])
def landmark_kinds(spark):
    names = ["README.md", "docs/readme.rst", "CONTRIBUTING.md", "AGENTS.md", "agents.md", "a/Cargo.toml", "Cargo.lock", "Makefile", "pom.xml", "justfile", ".circleci/config.yml", "CODEOWNERS", "LICENSE-MIT", "src/x.rs"]
    return _texts(spark, *names).select(F.col("x").alias("path"), F.array_join(P.landmark_kinds(F.col("x")), "|").alias("kinds"))


@case("path VARCHAR, role VARCHAR", [("src/main.rs", "entry_point"), ("examples/x.rs", "entry_point"), ("a/examples/b.py", "entry_point"), ("tests/main.rs", "entry_point"), ("tests/x.rs", "test"), ("x_test.go", "test"), ("src/ApiClient.ts", "gateway"), ("src/server.py", "gateway"), ("test/x.rs", "source"), ("src/cli.js", "entry_point")])
def snippet_roles(spark):
    df = _texts(spark, "src/main.rs", "examples/x.rs", "a/examples/b.py", "tests/main.rs", "tests/x.rs", "x_test.go", "src/ApiClient.ts", "src/server.py", "test/x.rs", "src/cli.js")
    return df.select(F.col("x").alias("path"), P.snippet_role(F.col("x"), F.array(F.lit("src/cli.js"))).alias("role"))


@case("symbol VARCHAR, confidence VARCHAR, visibility VARCHAR, weight DOUBLE", [("run", "high", "public", 1.0), ("run", "medium", "internal", 0.4), ("_x", "high", "public", 0.25), ("Data", "low", "private", 0.021875), ("run", "low", "unknown", 0.175)])
def edge_weights(spark):
    rows = spark.createDataFrame([("run", "high", "public"), ("run", "medium", "internal"), ("_x", "high", "public"), ("Data", "low", "private"), ("run", "low", "unknown")], "symbol string, confidence string, visibility string")
    return rows.withColumn("weight", F.round(edges.edge_weight(F.col("symbol"), F.col("confidence"), F.col("visibility")), 9))


@case("score DOUBLE, scaled BIGINT", [(0.1234567, 123457), (-3.0, 0), (0.0, 0), (1.0, 1_000_000)])
def scaled_scores(spark):
    return spark.createDataFrame([(0.1234567,), (-3.0,), (0.0,), (1.0,)], "score double").withColumn("scaled", graph.scaled_score(F.col("score")))


@case("reach VARCHAR, depth INTEGER, priority BIGINT", [("direct", 1, 3_000_000_000), ("transitive", 2, 1_925_000_000), ("transitive", 5, 1_700_000_000), ("inferred", 1, 1_000_000_000), ("inferred", 16, 0)])
def impact_priorities(spark):
    rows = spark.createDataFrame([("direct", 1), ("transitive", 2), ("transitive", 5), ("inferred", 1), ("inferred", 16)], "reach string, depth int")
    # The sixteenth step takes fifteen times 75 millions off a thousand millions, and no score is below zero.
    return rows.withColumn("priority", graph.impact_priority(F.col("reach"), F.col("depth")))


@case("n INTEGER, first INTEGER, last INTEGER", [(1, 2, 2), (2, 3, 4), (3, 2, 2), (4, None, None), (5, 1, 1)])
def changed_ranges(spark):
    """The lines that a change touches: what is left between the common beginning and end, one line at least."""
    rows = spark.createDataFrame([(1, list("abc"), list("axc")), (2, list("abc"), list("abxyc")), (3, list("abc"), list("ac")), (4, list("ab"), list("ab")), (5, [], list("a"))], "n int, a array<string>, b array<string>")
    return rows.select("n", changes.changed_range(F.col("a"), F.col("b")).alias("r")).select("n", F.col("r.start").alias("first"), F.col("r.end").alias("last"))


# Filters

HEADS = [("// Code generated by x. DO NOT EDIT.", True), ("# @generated", True), ("/* This file is generated */", True), ("let s = '@generated';", False), ("\n" * 16 + "// @generated", False), ("<!-- automatically generated -->", True), ("// code generated", False)]


@case("n INTEGER, hit BOOLEAN", [(k, hit) for k, (_, hit) in enumerate(HEADS)])
def filter_generated_header(spark):
    return spark.createDataFrame([(k, t) for k, (t, _) in enumerate(HEADS)], "n int, t string").select("n", P.generated_header(F.col("t")).alias("hit"))


MINIFIED = [("a.js", "x" * 1600, True), ("a.css", "x" * 1600, False), ("a.js", "x" * 1023, False), ("a.ts", "x " * 800, False), ("a.js", ("x" * 600 + "\n") * 3, True), ("a.js", ("x" * 600 + "\n") * 4, False), ("a.js", "x" * 65_537, False), ("b.mjs", "x" * 511 + "\n" + "y" * 511 + "\n", True)]


@case("n INTEGER, hit BOOLEAN", [(k, hit) for k, (_, _, hit) in enumerate(MINIFIED)])
def filter_minified(spark):
    return spark.createDataFrame([(k, p, t) for k, (p, t, _) in enumerate(MINIFIED)], "n int, p string, t string").select("n", P.looks_minified(F.col("p"), F.col("t")).alias("hit"))


@case("path VARCHAR, out BOOLEAN", [("a.log", True), ("x/a.log", True), ("keep.log", False), ("build/x.o", True), ("src/build/x.o", True), ("docs/a.txt", True), ("x/docs/a.txt", False), ("src/a.rs", False)])
def filter_excluded(spark):
    df = _texts(spark, "a.log", "x/a.log", "keep.log", "build/x.o", "src/build/x.o", "docs/a.txt", "x/docs/a.txt", "src/a.rs")
    return df.select(F.col("x").alias("path"), P.excluded(F.col("x"), ["*.log", "!keep.log", "build/", "/docs"]).alias("out"))


@case("path VARCHAR, safe BOOLEAN", [("a/b.rs", True), ("../a", False), ("a/./b", False), ("/a", False), ("a//b", False), ("C:x", False), ("a\\b", False), ("", False), ("..a/b", True)])
def filter_safe_paths(spark):
    return _texts(spark, "a/b.rs", "../a", "a/./b", "/a", "a//b", "C:x", "a\\b", "", "..a/b").select(F.col("x").alias("path"), P.safe_path(F.col("x")).alias("safe"))


@case("path VARCHAR, language VARCHAR", [("a.rs", "rust"), ("A.PY", "python"), ("x.d.ts", "typescript"), (".busted", "lua"), ("bin/run", "lua"), ("bin/other", None), ("run", None), ("x.unknown", None)])
def languages(spark):
    rows = spark.createDataFrame([("a.rs", ""), ("A.PY", ""), ("x.d.ts", ""), (".busted", ""), ("bin/run", "#!/usr/bin/env lua"), ("bin/other", "#!/bin/sh"), ("run", "#!/usr/bin/lua"), ("x.unknown", "")], "path string, line string")
    return rows.select("path", P.language_of(F.col("path"), F.col("line")).alias("language"))


OMITTED = [
    ("skip/a.rs", 1, "x", False, "rust", "explicit_exclusion"), ("l.rs", 1, "x", True, "rust", "symlink"), ("dist/a.rs", 9, "x", False, "rust", "classified"), ("vendor/b.c", 9, "x", False, None, "classified"), ("a.c", 9, "x", False, None, "unsupported_language"), ("Makefile", 9, "x", False, None, "unsupported_language"),
    ("a.txt", 99, "x", False, None, "non_source"), ("big.rs", 99, "a\0", False, "rust", "oversized"), ("bin.rs", 9, "a\0", False, "rust", "binary"), ("raw.rs", 9, None, False, "rust", "binary"), ("gen.rs", 9, "// @generated\n", False, "rust", "classified"), ("vendor/shown/a.rs", 9, "// @generated\n", False, "rust", None), ("ok.rs", 9, "x", False, "rust", None),
]


@case("path VARCHAR, reason VARCHAR", [(r[0], r[-1]) for r in OMITTED])
def omission_reasons(spark):
    """Exclusion, symlink, class of the path, language, size, bytes, class of the text, in this order; a focus path takes classes back."""
    df = spark.createDataFrame([r[:-1] for r in OMITTED], "path string, size int, text string, symlink boolean, language string")
    reason = topology.omission_reason(F.col("path"), F.col("size"), F.col("text"), F.col("symlink"), F.col("language"), 50, ["skip/"], ["vendor/shown"])
    return df.select("path", reason.alias("reason"))


@case("path VARCHAR, kept BOOLEAN", [("a", True), ("b", False), ("c", True), ("d", True), ("e", False)])
def source_byte_budget(spark):
    """A file that would overflow the bytes is passed over, and later ones still fit."""
    f = spark.createDataFrame([("a", 40), ("b", 70), ("c", 50), ("d", 10), ("e", 1)], "path string, size long")
    taken, left = topology.within_bytes(f, 100)
    return taken.select("path", F.lit(True).alias("kept")).unionByName(left.select("path", F.lit(False).alias("kept")))


# Lists of paths

@case("path VARCHAR, state VARCHAR", [("a", "tracked"), ("b", "tracked"), ("c", "untracked"), ("d", "tracked")])
def candidate_paths(spark):
    one = lambda *p: _texts(spark, *p).select(F.col("x").alias("path"))
    return topology.merge_candidates(one("a", "b"), one("b", "d"), one("a", "c")).select("path", F.col("worktree_state").alias("state"))


@case("path VARCHAR", [("c",)])
def ignored_paths(spark):
    one = lambda *p: _texts(spark, *p).select(F.col("x").alias("path"))
    return topology.ignored_paths(one("a", "b", "c"), one("a"), one("b"))


@case("path VARCHAR", [("b",), ("c",)])
def dirty_paths(spark):
    index = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, sha256 string")
    return topology.modified_paths(index, spark.createDataFrame([("a", "1"), ("b", "x"), ("d", "4")], "path string, sha256 string"))


@case("path VARCHAR", [("a",), ("a/b/c",), ("x/y",)])
def related_paths(spark):
    one = lambda *p: _texts(spark, *p).select(F.col("x").alias("path"))
    return search.related_paths(one("a", "a/b/c", "ab/c", "x/y", "z"), one("a/b", "x/y")).select("path")


@case("path VARCHAR, kind VARCHAR, manifests INTEGER", [(".", "workspace", 1), ("a", "mixed", 2), ("b", "package", 1), ("c", "unknown", 1)])
def project_roots(spark):
    """Two families of manifests are mixed; a role nobody read is unknown; a workspace manifest a workspace; else a package."""
    f = _texts(spark, "package.json", "a/Cargo.toml", "a/go.mod", "b/pyproject.toml", "c/go.mod", "src/x.rs").select(F.col("x").alias("path"))
    roles = spark.createDataFrame([("package.json", "workspace"), ("a/Cargo.toml", "package"), ("a/go.mod", "package"), ("b/pyproject.toml", "package")], "path string, role string")
    return topology.project_roots(f, roles).select("path", "kind", F.size("manifests").alias("manifests"))


@case("path VARCHAR, state VARCHAR", [("a", "modified"), ("b", "untracked"), ("c", "tracked")])
def folder_states(spark):
    rows = spark.createDataFrame([("a", "tracked"), ("a", "modified"), ("a", "untracked"), ("b", "untracked"), ("b", "tracked"), ("c", "tracked")], "path string, worktree_state string")
    return topology.directory_states(rows).select("path", F.col("worktree_state").alias("state"))


@case("place INTEGER, kind VARCHAR, path VARCHAR, matches INTEGER", [(1, "agent_instructions", "AGENTS.md", 0), (2, "readme", "docs/readme.md", 1), (3, "readme", "README.md", 0), (4, "manifest", "a/Cargo.toml", 0), (5, "test_root", "a/tests", 0)])
def landmark_order(spark):
    """By priority, then focus, then path."""
    rows = [(p, "tracked") for p in ("README.md", "docs/readme.md", "AGENTS.md", "a/Cargo.toml", "a/tests/x.rs")]
    marks = topology.landmarks(spark.createDataFrame(rows, "path string, worktree_state string"), focus=["docs"]).collect()
    return spark.createDataFrame([(k, r["kind"], r["path"], r["focus_matches"]) for k, r in enumerate(marks, 1)], "place int, kind string, path string, matches int")


@case("kind VARCHAR, paths BIGINT, samples VARCHAR", [("generated", 3, "dist/a|dist/b"), ("vendor", 1, "vendor/build.rs")])
def class_summary(spark):
    f = _texts(spark, "dist/a", "dist/b", "dist/c", "vendor/build.rs", "src/x.rs").select(F.col("x").alias("path"))
    return topology.classification_summary(f, samples=2).select("kind", "paths", F.array_join("samples", "|").alias("samples"))


# History

@case("id VARCHAR, name VARCHAR, email VARCHAR", [("1", "Ann", "ann@new"), ("2", "Bob", "bob@new"), ("3", "Late", "x@new"), ("4", "Other", "shared@x"), ("5", "Unknown", "e@x"), ("6", "Only Mail", "m@new")])
def mailmap_identities(spark):
    """A name and address before an address alone; of one key the last line; names without a value stay."""
    mail = spark.createDataFrame(
        [("ann b", "shared@x", "Ann", "ann@new", 1), ("BOB", "Shared@X", "Bob", "bob@new", 2), (None, "x@x", "Early", "x@old", 3), (None, "X@x", "Late", "x@new", 4), (None, "m@x", None, "m@new", 5)],
        "raw_name string, raw_email string, name string, email string, line int",
    )
    c = spark.createDataFrame([("1", "Ann B", "shared@x"), ("2", "Bob", "SHARED@x"), ("3", "Anyone", "x@x"), ("4", "Other", "shared@X"), ("5", "  ", "e@x"), ("6", "Only Mail", "m@x")], "id string, author_name string, author_email string")
    return history.with_identities(c, mail).select("id", F.col("author_name").alias("name"), F.col("author_email").alias("email"))


@case("path VARCHAR, status VARCHAR, normalised BIGINT", [("a", "text", 102_400), ("b", "resource_limit", None), ("c", "text", 25_600), ("d", "empty", None), ("e", "missing_at_head", None), ("f", "oversized", None), ("g", "binary", None)])
def churn_sizes(spark):
    """Sizes are looked into in order of commits and path while they fit 200 bytes."""
    churned = spark.createDataFrame([("a", 9), ("b", 8), ("c", 2), ("d", 1), ("e", 1), ("f", 1), ("g", 1)], "path string, commits long")
    head = spark.createDataFrame([("a", 90, False), ("b", 120, False), ("c", 80, False), ("d", 0, False), ("f", 999, False), ("g", 20, True)], "path string, size long, binary boolean").withColumn("generated", F.lit(False))
    return history.normalised_churn(churned, head, 500, 200).select("path", F.col("size_status").alias("status"), "normalised")


@case("path VARCHAR, commits BIGINT", [("s/a", 2), ("s/b", 1)])
def churn_in_scope(spark):
    c = spark.createDataFrame([("1", 1000, False), ("2", 1000, False), ("3", 1000, True), ("4", -90_000, False)], "id string, committer_seconds long, is_merge boolean")
    p = spark.createDataFrame([("1", "s/a"), ("2", "s/a"), ("2", "s/b"), ("3", "s/a"), ("4", "s/a"), ("1", "sx/c")], "id string, path string")
    return history.churn(c, p, 1000, 1, "s")


# Edges and relations of a small tree

SYMBOL = "path string, language string, ord int, name string, kind string, role string, evidence string, context string, visibility string, modules array<string>, scope array<string>, line int, column int"


def _symbols(spark: SparkSession) -> DataFrame:
    rows = [
        ("src/util.ts", "typescript", 0, "parse", "function", "definition", "declaration", "function parse()", "public", None, [], 1, 1),
        ("src/other.ts", "typescript", 0, "parse", "function", "definition", "declaration", "function parse()", "private", None, [], 1, 1),
        ("src/app.ts", "typescript", 0, "read", "import", "definition", "import", "import { parse as read } from './util'", "unknown", None, [], 1, 1),
        ("src/app.ts", "typescript", 1, "start", "function", "definition", "declaration", "function start()", "public", None, [], 3, 1),
        ("src/app.ts", "typescript", 2, "read", "function", "reference", "call", "read()", "unknown", None, ["start"], 4, 3),
        ("src/app.ts", "typescript", 3, "start", "function", "reference", "call", "start()", "unknown", None, [], 6, 1),
        ("src/app.ts", "typescript", 4, "parse", "function", "reference", "bare_reference", "parse", "unknown", None, [], 7, 1),
        ("tests/app.ts", "typescript", 0, "start", "import", "definition", "import", "import { start } from '../src/app'", "unknown", None, [], 1, 1),
        ("tests/app.ts", "typescript", 1, "start", "function", "reference", "call", "start()", "unknown", None, [], 3, 1),
        ("p/a.go", "go", 0, "Run", "function", "definition", "declaration", "func Run()", "public", ["p"], [], 1, 1),
        ("p/b.go", "go", 0, "Run", "function", "reference", "call", "Run()", "unknown", ["p"], [], 2, 1),
        ("q/c.go", "go", 0, "Run", "function", "reference", "call", "Run()", "unknown", ["p"], [], 2, 1),
        ("m/x.py", "python", 0, "thing", "class", "definition", "declaration", "class thing", "public", None, [], 1, 1),
        ("m/y.py", "python", 0, "thing", "class", "definition", "declaration", "class thing", "public", None, [], 1, 1),
        ("app.py", "python", 0, "thing", "import", "definition", "import", "import thing", "unknown", None, [], 1, 1),
        ("app.py", "python", 1, "thing", "type", "reference", "type_reference", "thing", "unknown", None, [], 2, 1),
        ("app.py", "python", 2, "data", "function", "reference", "call", "data()", "unknown", None, [], 3, 1),
    ]
    return spark.createDataFrame(rows, SYMBOL)


def _files(spark: SparkSession) -> DataFrame:
    rows = [(p, "typescript" if p.endswith("ts") else "go" if p.endswith("go") else "python", "partial" if p == "src/other.ts" else "analyzed", "src" if p.startswith("src") else ".") for p in ("src/util.ts", "src/other.ts", "src/app.ts", "tests/app.ts", "p/a.go", "p/b.go", "q/c.go", "m/x.py", "m/y.py", "app.py")]
    return spark.createDataFrame(rows, "path string, language string, status string, project_root string")


def _edges(spark: SparkSession) -> DataFrame:
    s = _symbols(spark)
    return edges.describe(edges.answers(edges.questions(s), s))


def _graph(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Nodes and relations, written: operations read them several times."""
    made = relationships.nodes(_files(spark), _symbols(spark)), relationships.build(_files(spark), _edges(spark), _symbols(spark))
    return write_stage(made[0], "nodes")[0], write_stage(made[1], "relations")[0]


EDGES = [
    ("app.py", "m/x.py", "thing", True, "imported_name", "medium", "public", "m/x.py|m/y.py"), ("app.py", "m/y.py", "thing", True, "imported_name", "medium", "public", "m/x.py|m/y.py"),
    ("p/b.go", "p/a.go", "Run", False, "same_module", "high", "public", "p/a.go"), ("src/app.ts", "src/app.ts", "start", False, "same_file_explicit", "high", "public", "src/app.ts"),
    ("src/app.ts", "src/util.ts", "read", False, "imported_module", "high", "public", "src/util.ts"), ("tests/app.ts", "src/app.ts", "start", False, "imported_module", "high", "public", "src/app.ts"),
]


@case("source VARCHAR, target VARCHAR, symbol VARCHAR, ambiguous BOOLEAN, reason VARCHAR, confidence VARCHAR, visibility VARCHAR, candidates VARCHAR", EDGES)
def edges_by_tier(spark):
    """All four tiers, an alias that leads to another name, and references that have no edge: bare, generic, and of another folder's package."""
    return _edges(spark).select("source", "target", "symbol", "ambiguous", F.col("resolution_reason").alias("reason"), "confidence", F.col("target_visibility").alias("visibility"), F.array_join("candidates", "|").alias("candidates"))


NODE = {
    "read_call": "symbol:src/app.ts:4:3:4:3:reference:function:read", "read_import": "symbol:src/app.ts:1:1:1:1:definition:import:read", "start": "symbol:src/app.ts:3:1:3:1:definition:function:start", "start_call": "symbol:src/app.ts:6:1:6:1:reference:function:start",
    "parse": "symbol:src/util.ts:1:1:1:1:definition:function:parse", "test_import": "symbol:tests/app.ts:1:1:1:1:definition:import:start", "test_call": "symbol:tests/app.ts:3:1:3:1:reference:function:start",
}


@case(
    "kind VARCHAR, source VARCHAR, target VARCHAR, symbol VARCHAR, confidence VARCHAR",
    [
        ("import", "file:src/app.ts", "file:src/util.ts", "read", "high"), ("import", NODE["read_import"], NODE["parse"], "read", "high"), ("call", NODE["start"], NODE["parse"], "read", "high"),
        ("dependency", "file:src/app.ts", "file:src/app.ts", "start", "high"), ("call", NODE["start_call"], NODE["start"], "start", "high"),
        ("import", "file:tests/app.ts", "file:src/app.ts", "start", "high"), ("import", NODE["test_import"], NODE["start"], "start", "high"), ("call", NODE["test_call"], NODE["start"], "start", "high"),
    ],
)
def relations_of_calls(spark):
    """Relations of the TypeScript files: an import renames what it takes; a call starts at the function around it."""
    return _graph(spark)[1].filter("source_path like '%.ts'").select("kind", "source", "target", "symbol", "confidence")


@case("operation VARCHAR, node VARCHAR, confidence VARCHAR, ambiguous BOOLEAN", [
    ("symbol", NODE["parse"], "high", False), ("symbol", "symbol:src/other.ts:1:1:1:1:definition:function:parse", "medium", False), ("symbol", "symbol:src/app.ts:7:1:7:1:reference:function:parse", "high", False),
    ("definitions", NODE["parse"], "high", False), ("definitions", "symbol:src/other.ts:1:1:1:1:definition:function:parse", "medium", False), ("references", "symbol:src/app.ts:7:1:7:1:reference:function:parse", "high", False),
    ("imports", "file:src/util.ts", "high", False), ("dependencies", "file:m/x.py", "medium", True), ("dependencies", "file:m/y.py", "medium", True),
    ("reverse_dependencies", "file:tests/app.ts", "high", False), ("tests", "file:tests/app.ts", "high", False),
    ("callers", NODE["start_call"], "high", False), ("callers", NODE["test_call"], "high", False), ("callees", NODE["parse"], "high", False),
])
def relationship_operations(spark):
    """All nine operations; a node that is an anchor itself is no answer."""
    n, r = _graph(spark)
    asked = {"symbol": "PARSE", "definitions": "parse", "references": "parse", "imports": "src/app.ts", "dependencies": "app.py", "reverse_dependencies": "./src/app.ts", "tests": "src/app.ts", "callers": "start", "callees": "start"}
    out = None
    for operation, target in asked.items():
        found = relationships.candidates(n, r, operation, target).select(F.lit(operation).alias("operation"), "node", "confidence", "ambiguous")
        out = found if out is None else out.unionByName(found)
    return out


@case("target VARCHAR, node VARCHAR", [("src/app.ts", "file:src/app.ts"), ("parse", "file:src/util.ts"), ("parse", "file:src/other.ts"), ("parse", "file:src/app.ts"), ("m/", "file:m/x.py"), ("m/", "file:m/y.py"), ("m", "file:m/x.py"), ("m", "file:m/y.py")])
def anchor_files(spark):
    """A path, else the files with a symbol of that name, else the files of a folder."""
    n, out = _graph(spark)[0], None
    for target in ("src/app.ts", "parse", "m/", "m"):
        found = relationships.file_anchors(n, target.rstrip("/")).select(F.lit(target).alias("target"), F.col("id").alias("node"))
        out = found if out is None else out.unionByName(found)
    return out


# Walks

LINK = "src string, dst string, kind string, confidence string, ambiguous boolean, id string"
LINKS = [
    ("a", "b", "call", "high", False, "1"), ("a", "c", "dependency", "high", False, "2"), ("a", "d", "call", "low", False, "3"), ("a", "e", "call", "high", True, "4"),
    ("c", "f", "import", "medium", False, "5"), ("b", "f", "call", "low", False, "6"), ("f", "a", "call", "high", False, "7"), ("d", "g", "call", "high", False, "8"),
]


def _links(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LINKS, LINK)


def _at(spark: SparkSession, *nodes: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in nodes], "node string")


def _walked(spark: SparkSession, w: graph.Walk) -> DataFrame:
    """Nodes in order of discovery, with what the walk says of itself."""
    rows = [(k, r["node"], r["depth"], r["parent"], w.work, w.depth_limited, w.work_limited) for k, r in enumerate(w.nodes.orderBy("rank").collect())]
    return spark.createDataFrame(rows, "place int, node string, depth int, parent string, work int, depth_limited boolean, work_limited boolean")


WALK = "place INTEGER, node VARCHAR, depth INTEGER, parent VARCHAR, work INTEGER, depth_limited BOOLEAN, work_limited BOOLEAN"


@case(WALK, [(0, "a", 0, None, 7, True, False), (1, "c", 1, "a", 7, True, False), (2, "b", 1, "a", 7, True, False), (3, "e", 1, "a", 7, True, False), (4, "d", 1, "a", 7, True, False), (5, "f", 2, "c", 7, True, False), (6, "g", 2, "d", 7, True, False)])
def walk_order(spark):
    """Sure before unsure, plain before ambiguous, then kinds in their own order; each edge looked at is work, and nodes at the greatest depth limit the walk."""
    return _walked(spark, graph.walk(_links(spark), _at(spark, "a"), depth=2))


@case(WALK, [(0, "a", 0, None, 3, False, True), (1, "c", 1, "a", 3, False, True), (2, "b", 1, "a", 3, False, True), (3, "e", 1, "a", 3, False, True)])
def walk_work_stop(spark):
    """The work limit stops inside a level."""
    return _walked(spark, graph.walk(_links(spark), _at(spark, "a"), depth=5, work=3))


@case("step INTEGER, node VARCHAR, parent VARCHAR", [(0, "a", None), (1, "c", "a"), (2, "f", "c")])
def path_nodes(spark):
    """Of two ways of one length the one met first."""
    return graph.shortest_path(_links(spark), _at(spark, "a"), _at(spark, "f")).select("step", "node", "parent")


@case("edges BIGINT, ambiguous BOOLEAN, confidence VARCHAR", [(2, False, "high")])
def path_confidence(spark):
    """A path is as sure as its surest edge."""
    return graph.path_summary(graph.shortest_path(_links(spark), _at(spark, "a"), _at(spark, "f")))


@case("node VARCHAR, depth INTEGER, reach VARCHAR", [("f", 0, "seed"), ("c", 1, "direct"), ("b", 1, "inferred"), ("a", 2, "transitive")])
def impact_reach(spark):
    """An unsure edge makes what it reaches inferred; the seed's own target is met by the walk as well, which tells how."""
    return graph.impact(_links(spark), _at(spark, "f"))


@case("route VARCHAR, edges INTEGER", [("a>d>g", 2)])
def route_of_edges(spark):
    return graph.lexical_route(_links(spark), _at(spark, "a"), _at(spark, "g")).select(F.array_join("route", ">").alias("route"), "edges")


@case("node VARCHAR", [("a",), ("b",)])
def walk_in_project(spark):
    """Edges that leave the project are counted, not followed."""
    p = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("d", "y"), ("e", "y"), ("f", "y"), ("g", "x")], "node string, root string")
    w = graph.walk(_links(spark), _at(spark, "a"), depth=4, projects=p)
    return w.nodes.select("node").filter(F.lit(w.omitted_boundaries == 4))


# Ranking

@case("path VARCHAR, seeds VARCHAR, direct INTEGER", [
    ("src/app.ts", "change_symbol:start|language:typescript|project:src|search_term:pars|symbol:READ|task_term:app", 6), ("src/util.ts", "change_path:src/util.ts|language:typescript|project:src|search_term:pars", 4),
    ("src/other.ts", "language:typescript|project:src|search_term:pars", 3), ("tests/app.ts", "change_symbol:start|language:typescript|path:tests|task_term:app", 4), ("app.py", "task_term:app", 1),
])
def seed_matches(spark):
    """Terms meet paths, names and contexts; symbols whole names; paths and projects by prefix."""
    out = ranking.direct_matches(_files(spark), _symbols(spark), terms=["app", "pars"], names=["READ"], paths=["tests"], languages=["typescript"], projects=["src"], changed_paths=["src/util.ts"], changed_symbols=["start"], task_terms=["app"])
    return out.select("path", F.array_join(F.transform("seeds", lambda s: F.concat_ws(":", s["kind"], s["value"])), "|").alias("seeds"), "direct")


@case("path VARCHAR, texts BIGINT, paths BIGINT", [("src/app.ts", 2, 1), ("src/util.ts", 1, 1), ("src/other.ts", 1, 1), ("tests/app.ts", 1, 0)])
def focus_of_symbols(spark):
    """A focus text is looked for in paths, names and contexts."""
    return ranking.focus_hits(_files(spark), _symbols(spark), ["PARSE", "start"], ["src"])


@case("path VARCHAR, name VARCHAR, score BIGINT", [("src/app.ts", "start", 302_100), ("src/util.ts", "parse", 50), ("p/a.go", "Run", 1_000), ("m/x.py", "thing", 1_000), ("m/y.py", "thing", 1_000), ("tests/app.ts", "start", 300_000), ("app.py", "thing", 0), ("src/other.ts", "parse", 0)])
def snippet_candidates(spark):
    """Strong files, and the definition that stands for each: its file's score, its references, and the seeds it answers."""
    scores = spark.createDataFrame([("src/app.ts", 100, 0, 0, 0), ("src/util.ts", 50, 0, 0, 0), ("src/other.ts", 0, 0, 5, 0)], "path string, score long, direct long, history long, focus long")
    strong = ranking.strong_files(_files(spark), _symbols(spark), scores, _edges(spark))
    return ranking.snippet_candidates(strong, _symbols(spark), edges.reference_counts(_edges(spark)), seeds=["start"]).select("path", "name", "score")


@case("node VARCHAR, p DOUBLE", [("a", 0.5), ("b", 0.5), ("c", 0.0)])
def personal_shares(spark):
    return ranking.personalisation(_at(spark, "a", "b", "c"), _at(spark, "a", "b", "z").filter("node <> 'z'"))


# Reports

@case("path VARCHAR, score BIGINT, reach VARCHAR, depth INTEGER, confidence VARCHAR, evidence VARCHAR", [("a", 3_000, "direct", 1, "medium", "graph|structural"), ("b", 1_000, "inferred", 0, "low", "structural"), ("c", 50, "transitive", 2, "low", "graph")])
def impact_target_merge(spark):
    """The best score decides reach and depth, ties by the stronger reach, then the smaller depth; nothing is surer than medium."""
    rows = [("a", 3_000, "direct", 1, "graph", "r1", "high"), ("a", 1_000, "inferred", 0, "structural", "r2", "medium"), ("b", 1_000, "inferred", 0, "structural", "r2", "low"), ("c", 50, "inferred", 1, "graph", "r1", "low"), ("c", 50, "transitive", 3, "graph", "r1", "medium"), ("c", 50, "transitive", 2, "graph", "r3", "medium")]
    out = reports.merged_targets(spark.createDataFrame(rows, "path string, score long, reach string, depth int, evidence string, reason string, confidence string"))
    return out.select("path", "score", "reach", "depth", "confidence", F.array_join("evidence", "|").alias("evidence"))


@case("path VARCHAR, project_root VARCHAR", [("p/tests/a.rs", "p"), ("p/tests/deep/b.rs", "p")])
def tests_of_changed_projects(spark):
    """Files in a test root of a project that holds a change."""
    one = lambda *p: _texts(spark, *p).select(F.col("x").alias("path"))
    return reports.likely_tests(one("p/tests/a.rs", "p/tests/deep/b.rs", "q/tests/c.rs", "tests/d.rs", "p/src/x.rs"), one("p/src/x.rs", "p/new.rs"), one("p/tests", "q/tests", "tests"), one(".", "p", "q"))


@case("path VARCHAR, score BIGINT", [("a", 9), ("c", 7)])
def top_scored_tests(spark):
    """The best by score, equal ones by path; a path counts once."""
    return reports.top_tests(spark.createDataFrame([("a", 3), ("a", 9), ("d", 7), ("c", 7), ("e", 1)], "path string, score long"), 2)


@case("root VARCHAR, score BIGINT, paths VARCHAR, tests VARCHAR", [("p", 9, "p/a|p/tests/t", "p/tests/t"), (None, 2, "x", "")])
def projects_of_targets(spark):
    rows = spark.createDataFrame([("p/a", 5, "p"), ("p/tests/t", 9, "p"), ("x", 2, None)], "path string, score long, project_root string")
    return reports.impact_projects(rows).select(F.col("project_root").alias("root"), "score", F.array_join("paths", "|").alias("paths"), F.array_join("tests", "|").alias("tests"))


@case("purpose VARCHAR, path VARCHAR, score BIGINT, evidence VARCHAR, confidence VARCHAR", [("tests", "a", 12, "x|y", "high"), ("runtime", "a", 1, "x", "low")])
def reading_merge(spark):
    """Reasons to read a file add up."""
    rows = spark.createDataFrame([("tests", "a", 5, "y", "medium"), ("tests", "a", 7, "x", "high"), ("runtime", "a", 1, "x", "low")], "purpose string, path string, score long, evidence string, confidence string")
    return reports.merged_reading(rows).select("purpose", "path", "score", F.array_join("evidence", "|").alias("evidence"), "confidence")


@case("path VARCHAR, ord INTEGER", [("a", 0), ("a", 1), ("b", 0)])
def symbol_caps(spark):
    """Two symbols a file, three in all, in order of path and place."""
    return reports.bounded_symbols(spark.createDataFrame([("b", 1), ("b", 0), ("a", 2), ("a", 1), ("a", 0), ("c", 0)], "path string, ord int"), 2, 3)


@case("source VARCHAR, target VARCHAR", [("a", "x"), ("a", "y")])
def edge_cap(spark):
    """The cap counts edges before repeats are dropped."""
    rows = spark.createDataFrame([("a", 1, "y"), ("a", 0, "x"), ("a", 1, "x"), ("b", 0, "z")], "source string, ord int, target string")
    return edges.first_edges(rows, 3).select("source", "target").distinct()


@case("path VARCHAR, name VARCHAR", [("a", "hub"), ("b", "shown")])
def best_definitions(spark):
    """Most referred to, then public, then first by place."""
    s = spark.createDataFrame([("a", "first", 0, "definition", "public"), ("a", "hub", 1, "definition", "private"), ("b", "hidden", 0, "definition", "private"), ("b", "shown", 1, "definition", "public"), ("b", "later", 2, "definition", "public"), ("b", "ref", 3, "reference", "public")], "path string, name string, ord int, role string, visibility string")
    refs = spark.createDataFrame([("a", "hub", 4)], "target string, symbol string, references long")
    return ranking.best_definitions(s, refs).select("path", "name")


@case("name VARCHAR, ordinal INTEGER", [("b", 1), ("c", 2)])
def ordinals(spark):
    return reports.bounded_order(_texts(spark, "c", "d", "b").select(F.col("x").alias("name")), [F.asc("name")], 2)


@case("total BIGINT, returned BIGINT, truncated BOOLEAN, reason VARCHAR", [(3, 2, True, "collection_limit")])
def collection_summaries(spark):
    return budget.collection_summary(_texts(spark, "a", "b", "c"), 2)


@case("event VARCHAR, command VARCHAR", [("repository_open", "orient"), ("session_start", "orient"), ("task_change", "context"), ("before_edit", "context"), ("after_edit", "context"), ("before_review", "impact")])
def lifecycle_events(spark):
    return spark.createDataFrame([(e, reports.dispatch(e)) for e in reports.LIFECYCLE], "event string, command string")


@case("place INTEGER, path VARCHAR, cost INTEGER, truncated BOOLEAN", [(1, "d", 8, False), (2, "c", 8, False), (3, "a", 8, False), (4, "b", 8, False)])
def snippet_choice(spark):
    """A role's bonus first; then what brings a new subsystem, for which the others are cut to a third."""
    base = {"kind": "function", "name": "f", "scope": [], "line": 1, "column": 1, "end_line": 1, "end_column": 9, "project_root": ".", "language": "rust", "partial": False, "generated": False, "task_relevant": False, "context": "fn f()"}
    rows = [{**base, "path": p, "role": r, "subsystem": s, "score": n} for p, r, s, n in [("a", "source", "x", 900), ("b", "source", "x", 890), ("c", "source", "y", 400), ("d", "test", "x", 1)]]
    chosen = ranking.choose_snippets(rows, 1000)
    return spark.createDataFrame([(k, c["path"], c["cost"], c["truncated"]) for k, c in enumerate(chosen, 1)], "place int, path string, cost int, truncated boolean")
