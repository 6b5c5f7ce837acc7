import pytest
from pyspark.sql import functions as F

from marlstone.functions import paths as P
from marlstone.functions import text as X
from marlstone.operators import edges


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_case_folding_keeps_other_letters(spark):
    assert one(spark, X.ascii_lower(F.lit("ÉAbZ"))) == "Éabz"
    assert one(spark, X.strip_space(F.lit("\u00a0 a b\n"))) == "a b"


@pytest.mark.parametrize("mode,want", [("exact", None), ("prefix", 3_000_000_000), ("substring", 2_000_000_000)])
def test_text_score(spark, mode, want):
    assert one(spark, X.text_score(F.lit("ParserState"), " parser ", mode)) == want
    assert one(spark, X.text_score(F.lit("x"), "  ", mode)) is None


def test_path_score_minds_case(spark):
    assert one(spark, X.path_score(F.lit("src/Main.rs"), ".\\src\\Main.rs".replace(".\\", "./"), "exact")) == 4_000_000_000
    assert one(spark, X.path_score(F.lit("src/Main.rs"), "main", "substring")) is None


def test_keywords_by_word_and_substring(spark):
    m = F.lit("Fix prefix_bug; BUG-7 debug")
    assert one(spark, X.matched_keywords(m, ["bug", "fix"], "word")) == ["bug", "fix"]
    assert one(spark, X.matched_keywords(F.lit("prefix debug"), ["bug", "fix"], "word")) == []
    assert one(spark, X.matched_keywords(F.lit("prefix debug"), ["bug", "fix"], "substring")) == ["bug", "fix"]


def test_terms_tokens_bounds(spark):
    assert one(spark, X.task_terms(F.lit("Add the is_valid check-for é of It"))) == ["Add", "valid", "check"]
    assert one(spark, X.token_estimate(F.lit(""))) == 1
    assert one(spark, X.bounded(F.lit("abcdef"), 3)) == "abc…"
    assert one(spark, X.compact_context(F.lit(" a \n\t b "))) == "a b"
    assert one(spark, X.month_of(F.lit(-1))) == "1969-12"
    assert one(spark, X.rfc3339(F.lit(0))) == "1970-01-01T00:00:00Z"


def test_paths(spark):
    assert one(spark, P.ancestors(F.lit("a/b/c"))) == [".", "a", "a/b", "a/b/c"]
    assert one(spark, P.ancestors(F.lit("c"), with_self=False)) == ["."]
    assert one(spark, P.suffixes(F.lit("a/b"))) == ["a/b", "b"]
    assert one(spark, P.parent(F.lit("x"))) == "."
    assert one(spark, P.normalise_path(F.lit(" ./a\\b/ "))) == "a/b"
    assert one(spark, P.is_test_path(F.lit("a/tests/x.rs"))) is True
    assert one(spark, P.is_test_path(F.lit("latest/x.rs"))) is False
    assert one(spark, P.subsystem(F.lit("p/api/src/x.rs"), F.lit("p/api"))) == "src"
    assert one(spark, P.snippet_role(F.lit("src/router.go"))) == "gateway"


@pytest.mark.parametrize("path,want", [("a/x.py", "python"), ("bin/tool", "lua"), (".busted", "lua"), ("x.TSX", "typescript"), ("lib/tool", None)])
def test_language(spark, path, want):
    assert one(spark, P.language_of(F.lit(path), F.lit("#!/usr/bin/env lua5.4"))) == want


def test_classification(spark):
    kinds = [tuple(c) for c in one(spark, P.path_classes(F.lit("Vendor/dist/app.min.js")))]
    assert kinds == [("generated", "generated_directory:dist"), ("minified", "minified_filename"), ("vendor", "vendor_directory:vendor")]
    assert one(spark, P.generated_header(F.lit("x\n// Code generated by t. DO NOT EDIT.\n"))) is True
    assert one(spark, P.generated_header(F.lit("generated file"))) is False
    assert one(spark, P.looks_minified(F.lit("a.js"), F.lit("x" * 2000))) is True
    assert one(spark, P.looks_minified(F.lit("a.js"), F.lit("x y" * 1000))) is False


@pytest.mark.parametrize("path,ok", [("a/b", True), ("/a", False), ("a//b", False), ("../a", False), ("C:/a", False), ("a\\b", False), ("", False)])
def test_safe_path(spark, path, ok):
    assert one(spark, P.safe_path(F.lit(path))) is ok


@pytest.mark.parametrize("pattern,path,hit", [("*.log", "a/b.log", True), ("/build", "a/build/x", False), ("build/", "a/build/x", True), ("a/**/z", "a/b/c/z", True), ("a/*", "a/b/c", True), ("x?z", "xyz", True)])
def test_globs(spark, pattern, path, hit):
    assert one(spark, P.excluded(F.lit(path), [pattern])) is hit
    assert one(spark, P.excluded(F.lit(path), [pattern, "!" + pattern])) is False


def test_module_hints(spark):
    assert one(spark, edges.module_hints(F.lit('import {a} from "./lib/Util.ts";'), F.lit("typescript"))) == ["lib/util"]
    assert one(spark, edges.module_hints(F.lit("use crate::map::graph;"), F.lit("rust"))) == ["crate/map/graph"]
    assert one(spark, edges.hint_keys(F.lit("crate/map/graph"))) == ["crate/map/graph", "map"]
