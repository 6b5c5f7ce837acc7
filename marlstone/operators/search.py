"""Typed queries over files and symbols: match modes, filters, order, pages."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.paths import ancestors, in_scope, is_test_path
from marlstone.functions.text import MODE_CONFIDENCE, ascii_lower, folded, path_score, text_score

CONTENT_SCORE, KIND_SCORE = 700_000_000, 800_000_000
OMISSION_SCORE, CHANGED_SCORE = 500_000_000, 1_000_000_000
#: Places of the confidence tiers in the order that results are sorted by: the weakest sorts first on ties.
CONFIDENCE_ORDER = {"high": 0, "medium": 1, "low": 2}


@dataclass(frozen=True)
class Filters:
    """What a query asks for; a part left out doesn't constrain.  ``modes`` names parts matched another way than ``mode``."""

    text: str | None = None
    symbol: str | None = None
    path: str | None = None
    mode: str = "substring"
    kind: str | None = None
    role: str | None = None
    project: str | None = None
    language: str | None = None
    tests: str = "any"
    changed: str | None = None
    scope: str = "."
    extra: list[Column] = field(default_factory=list)
    modes: dict[str, str] = field(default_factory=dict)

    def mode_of(self, part: str) -> str:
        return self.modes.get(part, self.mode)


def content_score(text: Column, query: str, mode: str = "substring") -> Column:
    """A hit inside a file's text: substring mode, three bytes at least."""
    q = folded(query)
    if mode != "substring" or len(q.encode()) < 3:
        return F.lit(None).cast("long")
    return F.when(ascii_lower(text).contains(q), CONTENT_SCORE).cast("long")


def file_predicates(f: Filters) -> list[Column]:
    out = [in_scope(F.col("path"), f.scope), *f.extra]
    if f.path is not None:
        out.append(path_score(F.col("path"), f.path, f.mode_of("path")).isNotNull())
    if f.language is not None:
        out.append(F.col("language") == f.language)
    if f.project is not None:
        out.append(path_score(F.coalesce("project_root", F.lit(".")), f.project, f.mode_of("project")).isNotNull())
    if f.tests != "any":
        out.append(is_test_path(F.col("path")) if f.tests == "only" else ~is_test_path(F.col("path")))
    return out


def related_paths(paths: DataFrame, changed: DataFrame) -> DataFrame:
    """Rows of ``paths`` that equal, contain or lie in a path of ``changed``: two equi-joins on ancestors."""
    c = changed.select(F.col("path").alias("c")).distinct()
    below = paths.withColumn("__a", F.explode(ancestors(F.col("path")))).join(c, F.col("__a") == F.col("c"), "left_semi")
    tops = c.select(F.explode(ancestors(F.col("c"))).alias("c")).distinct()
    above = paths.join(tops, F.col("path") == F.col("c"), "left_semi")
    return below.drop("__a").unionByName(above).dropDuplicates(["path"])


def confidence_order(c: Column) -> Column:
    return F.when(c == "high", 0).when(c == "medium", 1).otherwise(2)


def result_order() -> list[Column]:
    return [F.desc("score"), confidence_order(F.col("confidence")).desc(), F.asc("path"), F.asc("target"), F.asc_nulls_first("name"), F.asc("line"), F.asc("column")]


def active_changes(files: DataFrame, changed: DataFrame | None) -> DataFrame:
    """``(path)`` of the changes that a query speaks of: those given, with the paths they had before, else modified and untracked files."""
    if changed is None:
        return files.filter(F.col("worktree_state").isin("modified", "untracked")).select("path")
    now = changed.select("path")
    return now.unionByName(changed.select(F.col("previous_path").alias("path")).filter("path is not null")) if "previous_path" in changed.columns else now


def ambiguous_paths(edges: DataFrame) -> DataFrame:
    """``(path)`` of both ends of the ambiguous ones of ``edges(source, target, ambiguous)``."""
    some = edges.filter("ambiguous")
    return some.select(F.explode(F.array("source", "target")).alias("path")).distinct()


RESULT = "target", "path", "name", "line", "column", "score", "confidence", "ambiguous", "partial"


def _nowhere() -> list[Column]:
    return [F.lit(None).cast("string").alias("name"), F.lit(0).alias("line"), F.lit(0).alias("column")]


def _settled(confidence: Column) -> Column:
    """The confidence of a row whose source is partial or ambiguous: weak evidence is lifted to medium, strong evidence stays."""
    return F.when((F.col("ambiguous") | F.col("partial")) & (confidence == "low"), "medium").otherwise(confidence)


def query(files: DataFrame, symbols: DataFrame, f: Filters, changed: DataFrame | None = None, ranking: DataFrame | None = None, ambiguous: DataFrame | None = None) -> DataFrame:
    """All candidates as ``RESULT``.

    Symbols match by name, else by context, and, where only symbols are asked
    for, by path; a file row comes where no symbol of the file matched and its
    path or content did.  Without text or symbol constraints there is one row a
    file.  Scores add up: a thousandth of ``ranking(path, score)``; for a symbol
    the match of its name, ``KIND_SCORE`` where a kind is asked for, and the match
    of the text; for a file those of path filter, text in the path, and content.
    A symbol row is as sure as the surer of its name and text matches, a file row
    is high.  ``ambiguous(path)`` marks files with ambiguous edges.
    """
    some = files.filter(reduce(lambda a, b: a & b, file_predicates(f)))
    if f.changed is not None:
        hit = active_changes(files, changed).filter(path_score(F.col("path"), f.changed, f.mode_of("changed")).isNotNull())
        some = some.join(related_paths(files.select("path"), hit), "path", "left_semi")
    rank = F.lit(0).cast("long")
    if ranking is not None:
        some = some.join(ranking.select("path", F.expr("score div 1000").alias("__rank")), "path", "left")
        rank = F.coalesce("__rank", F.lit(0)).cast("long")
    some = some.join(ambiguous.select("path", F.lit(True).alias("__many")).distinct(), "path", "left") if ambiguous is not None else some.withColumn("__many", F.lit(False))
    base = some.withColumn("__base", rank).withColumn("ambiguous", F.coalesce("__many", F.lit(False))).withColumn("partial", F.col("status") == "partial" if "status" in files.columns else F.lit(False))
    only_symbols = any(x is not None for x in (f.symbol, f.kind, f.role))
    zero = F.lit(0).cast("long")
    by_path = F.coalesce(path_score(F.col("path"), f.path, f.mode_of("path")), zero) if f.path is not None else zero
    if f.text is None and not only_symbols:
        return base.select(F.lit("file").alias("target"), "path", *_nowhere(), (F.col("__base") + by_path).alias("score"), F.lit("high").alias("confidence"), "ambiguous", "partial")
    own = symbols.join(base.select("path", "__base", "ambiguous", "partial"), "path")
    tests, score, sure = [], F.col("__base"), [] if f.symbol is not None else ["high"]
    if f.symbol is not None:
        match = text_score(F.col("name"), f.symbol, f.mode_of("symbol"))
        tests.append(match.isNotNull())
        score += match
        sure.append(MODE_CONFIDENCE[f.mode_of("symbol")])
    if f.kind is not None:
        tests.append(F.col("kind") == f.kind)
        score += KIND_SCORE
    if f.role is not None:
        tests.append(F.col("role") == f.role)
    if f.text is not None:
        tried = [F.col("name"), F.col("context"), *([F.col("path")] if only_symbols else [])]
        match = F.coalesce(*(text_score(c, f.text, f.mode_of("text")) for c in tried))
        tests.append(match.isNotNull())
        score += match
    sure.append(MODE_CONFIDENCE[f.mode_of("text")] if f.text is not None else "high")
    strongest = min(sure, key=CONFIDENCE_ORDER.get)
    hits = own.filter(reduce(lambda a, b: a & b, tests)).select(
        F.lit("symbol").alias("target"), "path", "name", "line", "column", score.cast("long").alias("score"), F.lit(strongest).alias("confidence"), "ambiguous", "partial"
    )
    if f.text is None or only_symbols:
        return hits
    left = base.join(hits.select("path").distinct(), "path", "left_anti")
    in_path, in_text = text_score(F.col("path"), f.text, f.mode_of("text")), content_score(F.col("text"), f.text, f.mode_of("text"))
    found = left.withColumn("__path", in_path).withColumn("__text", in_text).filter("__path is not null or __text is not null")
    whole = F.col("__base") + by_path + F.coalesce("__path", zero) + F.coalesce("__text", zero)
    return hits.unionByName(found.select(F.lit("file").alias("target"), "path", *_nowhere(), whole.alias("score"), F.lit("high").alias("confidence"), "ambiguous", "partial"))


def _test_predicate(f: Filters) -> Column:
    return F.lit(True) if f.tests == "any" else is_test_path(F.col("path")) if f.tests == "only" else ~is_test_path(F.col("path"))


def with_omissions(candidates: DataFrame, f: Filters, omissions: DataFrame, files: DataFrame, changed: DataFrame | None = None, ambiguous: DataFrame | None = None) -> DataFrame:
    """Candidates with a row for each omitted path that the query speaks of and that is no source, and for each changed path that is none.

    An omission counts where the path filter, the text, the changed-path filter or
    the project filter meets ``omissions(path, project_root)``; a changed path only
    where a changed-path filter meets it.  Such rows are partial and of medium confidence.
    """
    known = files.select("path")
    meets = []
    if f.path is not None:
        meets.append(path_score(F.col("path"), f.path, f.mode_of("path")).isNotNull())
    if f.text is not None:
        meets.append(text_score(F.col("path"), f.text, f.mode_of("text")).isNotNull())
    if f.project is not None:
        meets.append(path_score(F.coalesce("project_root", F.lit(".")), f.project, f.mode_of("project")).isNotNull())
    left = omissions.filter(_test_predicate(f)).join(known, "path", "left_anti")
    hit = left.filter(reduce(lambda a, b: a | b, meets)) if meets else left.limit(0)
    missing = None
    if f.changed is not None:
        active = active_changes(files, changed).filter(path_score(F.col("path"), f.changed, f.mode_of("changed")).isNotNull()).distinct()
        hit = hit.unionByName(left.join(related_paths(left.select("path"), active), "path", "left_semi"))
        missing = active.filter(_test_predicate(f)).join(known, "path", "left_anti")
    many = ambiguous.select("path", F.lit(True).alias("__many")).distinct() if ambiguous is not None else None

    def rows(paths: DataFrame, score: int) -> DataFrame:
        paths = paths.join(many, "path", "left") if many is not None else paths.withColumn("__many", F.lit(False))
        flagged = paths.withColumn("ambiguous", F.coalesce("__many", F.lit(False))).withColumn("partial", F.lit(True))
        return flagged.select(F.lit("file").alias("target"), "path", *_nowhere(), F.lit(score).cast("long").alias("score"), _settled(F.lit("low")).alias("confidence"), "ambiguous", "partial")

    # An omission is a row of its own; one met in several ways is one row.
    out = candidates.unionByName(rows(hit.distinct(), OMISSION_SCORE))
    return out if missing is None else out.unionByName(rows(missing, CHANGED_SCORE))


def search_request(text: str | None, symbol: str | None, limit: int = 5) -> tuple[Filters, int]:
    """The plain search as a query: a text anywhere, or a symbol by its exact name; one of the two."""
    if (text is None) == (symbol is None):
        raise ValueError("give either a text or a symbol")
    return (Filters(text=text) if symbol is None else Filters(symbol=symbol, mode="exact")), min(limit, 64)
