"""Project roots, landmarks, classification and inventory of a tree of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.paths import ancestors, ascii_lower, basename, excluded, generated_header, in_scope, is_manifest, landmark_kinds, landmark_priority, looks_minified, manifest_family, parent, path_classes
from marlstone.functions.text import query_path
from marlstone.operators.budget import taken_while_fitting

#: States of a file from the mildest to the worst.
STATES = ["tracked", "untracked", "modified"]


def deepest_root(paths: DataFrame, roots: DataFrame, column: str = "path") -> DataFrame:
    """``paths`` with the deepest of ``roots(path)`` that holds each, or null: an equi-join on exploded ancestors.

    Ancestors are those of folders, each once; a path that is a root itself holds itself.
    """
    known = roots.select(F.col("path").alias("__root")).distinct()
    folder = F.when(F.col(column).isNotNull(), parent(F.col(column)))
    folders = paths.select(folder.alias("__folder")).distinct()
    spread = folders.select("__folder", F.explode(ancestors(F.col("__folder"))).alias("__root"))
    best = spread.join(known, "__root").groupBy(F.col("__folder").alias("__of")).agg(F.max_by("__root", F.when(F.col("__root") == ".", 0).otherwise(F.length("__root"))).alias("__best"))
    met = paths.join(best, folder == F.col("__of"), "left").join(known.withColumnRenamed("__root", "__own"), F.col(column) == F.col("__own"), "left")
    return met.withColumn("project_root", F.coalesce("__own", "__best")).drop("__of", "__best", "__own")


def project_roots(files: DataFrame, roles: DataFrame | None = None, scope: str = ".") -> DataFrame:
    """Folders with manifests: ``(path, kind, manifests)``.

    Manifests of several families make a root mixed; one without a known role
    unknown; a workspace manifest a workspace; else it is a package.  ``roles``
    has ``(path, role)`` of manifests that were read.
    """
    own = files.filter(in_scope(F.col("path"), scope)).withColumn("low", ascii_lower(basename(F.col("path")))).filter(is_manifest(F.col("low")))
    own = own.join(roles, "path", "left") if roles is not None else own.withColumn("role", F.lit(None).cast("string"))
    grouped = own.groupBy(parent(F.col("path")).alias("root")).agg(
        F.count_distinct(manifest_family(F.col("low"))).alias("families"),
        F.bool_or(F.coalesce(F.col("role"), F.lit("unknown")) == "unknown").alias("unknown"),
        F.bool_or(F.coalesce("role", F.lit("")) == "workspace").alias("workspace"),
        F.array_sort(F.collect_set("path")).alias("manifests"),
    )
    kind = F.when(F.col("families") > 1, "mixed").when(F.col("unknown"), "unknown").when(F.col("workspace"), "workspace").otherwise("package")
    return grouped.select(F.col("root").alias("path"), kind.alias("kind"), "manifests")


def landmarks(files: DataFrame, roots: DataFrame | None = None, focus: list[str] = (), most: int | None = None) -> DataFrame:
    """Landmark files, and package and workspace roots, most important first.

    A focus term that a path holds counts as a match.
    """
    found = files.select("path", "worktree_state", F.explode(landmark_kinds(F.col("path"))).alias("kind"))
    tests = files.select(F.explode(ancestors(F.col("path"), with_self=False)).alias("dir"), "worktree_state").filter(ascii_lower(basename(F.col("dir"))).isin("test", "tests", "spec", "__tests__"))
    found = found.unionByName(directory_states(tests.withColumnRenamed("dir", "path")).withColumn("kind", F.lit("test_root")))
    if roots is not None:
        inside = files.select("worktree_state", F.explode(ancestors(F.col("path"), with_self=False)).alias("path")).join(roots.select("path", F.col("kind").alias("k")), "path")
        states = directory_states(inside.drop("k")).join(roots.select("path", F.when(F.col("kind") == "workspace", "workspace_root").otherwise("package_root").alias("kind")), "path")
        found = found.unionByName(states)
    matches = sum((F.when(ascii_lower(F.col("path")).contains(t.lower()), 1).otherwise(0) for t in focus), F.lit(0))
    out = found.withColumn("priority", landmark_priority(F.col("kind"))).withColumn("focus_matches", matches)
    order = [F.desc("priority"), F.desc("focus_matches"), F.asc("path"), F.asc("kind")]
    return out.orderBy(*order) if most is None else out.orderBy(*order).limit(most)


def directory_states(rows: DataFrame) -> DataFrame:
    """The worst state below each folder of ``rows(path, worktree_state)``."""
    rank = F.array_position(F.array(*map(F.lit, STATES)), F.col("worktree_state"))
    return rows.groupBy("path").agg(F.max_by("worktree_state", rank).alias("worktree_state"))


def inventory(files: DataFrame) -> DataFrame:
    return files.agg(*(F.count_if(F.col("worktree_state") == s).alias(s) for s in ("tracked", "modified", "untracked")))


def classification_summary(files: DataFrame, samples: int = 64) -> DataFrame:
    """Paths by class, with the first ``samples`` of each."""
    rows = files.select("path", F.explode(F.array_distinct(F.transform(path_classes(F.col("path")), lambda c: c["kind"]))).alias("kind")).distinct()
    ranked = rows.withColumn("rn", F.row_number().over(Window.partitionBy("kind").orderBy("path"))).filter(F.col("rn") <= samples)
    some = ranked.groupBy("kind").agg(F.array_sort(F.collect_list("path")).alias("samples"))
    return rows.groupBy("kind").agg(F.count("*").alias("paths")).join(some, "kind")


def focus_covers(path: Column, focus_paths: list[str]) -> Column:
    """Whether a path is one of some focus paths or lies in one."""
    out = F.lit(False)
    for p in focus_paths:
        p = query_path(p)
        if p:
            out = out | (path == p) | path.startswith(p + "/")
    return out


def file_classes(path: Column, text: Column | None = None) -> Column:
    """``(kind, reason)`` of a file by its path and, where it is given, its text."""
    classes = path_classes(path)
    if text is None:
        return classes
    one = lambda kind, reason: F.struct(F.lit(kind).alias("kind"), F.lit(reason).alias("reason"))
    read = F.array_compact(F.array(F.when(generated_header(text), one("generated", "generated_header_marker")), F.when(looks_minified(path, text), one("minified", "bounded_minification_heuristic"))))
    return F.array_sort(F.array_distinct(F.concat(classes, read)))


def primary_languages(files: DataFrame, most: int = 3, classified: Column | None = None) -> DataFrame:
    """Languages with a third of the files of the largest, at most three; classified files (by their path, if not told) don't count."""
    classed = F.size(path_classes(F.col("path"))) > 0 if classified is None else classified
    counts = files.filter(F.col("language").isNotNull() & ~classed).groupBy("language").agg(F.count("*").alias("files"))
    top = counts.agg(F.max("files").alias("top"))  # one row
    return counts.filter(F.col("files") * 3 >= top.scalar()).orderBy(F.desc("files"), "language").limit(most)


#: Extensions and names of source files that no parser here reads (fixed values).
SOURCE_LIKE = [
    "c", "cc", "cpp", "cxx", "h", "hh", "hpp", "hxx", "go", "fs", "fsi", "fsx", "ex", "exs", "erl", "hrl", "lua", "php", "swift", "kt", "kts", "scala", "sh", "bash", "zsh", "nu", "zig", "vue", "svelte", "dart", "html", "htm", "css", "scss",
    "sass", "less", "sql",
]
SOURCE_NAMES = ["Dockerfile", "Justfile", "Makefile", "Rakefile"]


def omission_reason(path: Column, size: Column, text: Column, symlink: Column, language: Column, max_bytes: int = 1 << 20, exclude: list[str] = (), focus_paths: list[str] = ()) -> Column:
    """Why a file is no source, else null: the first that holds of excluded, symlink, classified by path, no known language, too large, binary, classified by text.

    A file that a focus path covers is never left out for its class.
    """
    shown = focus_covers(path, list(focus_paths))
    extension = ascii_lower(F.regexp_extract(basename(path), r".\.([^.]+)$", 1))
    return (
        F.when(excluded(path, list(exclude)), "explicit_exclusion")
        .when(symlink, "symlink")
        .when((F.size(path_classes(path)) > 0) & ~shown, "classified")
        .when(language.isNull() & (extension.isin(SOURCE_LIKE) | basename(path).isin(SOURCE_NAMES)), "unsupported_language")
        .when(language.isNull(), "non_source")
        .when(size > max_bytes, "oversized")
        .when(text.isNull() | text.contains("\0"), "binary")
        .when((F.size(file_classes(path, text)) > 0) & ~shown, "classified")
    )


def within_bytes(files: DataFrame, max_total: int) -> tuple[DataFrame, DataFrame]:
    """Files in order of path while their ``size`` fits a running budget of bytes, passing over those that don't, and the paths passed over."""
    taken = taken_while_fitting(files, [F.asc("path")], "size", max_total)
    left = files.join(taken.select("path"), "path", "left_anti")
    return taken, left.select("path", F.lit("oversized").alias("reason"))


def merge_candidates(tracked: DataFrame, index: DataFrame, worktree: DataFrame) -> DataFrame:
    """All paths of the three listings, once each, with the state they have together."""
    rows = tracked.select("path", F.lit("t").alias("s")).unionByName(index.select("path", F.lit("i").alias("s"))).unionByName(worktree.select("path", F.lit("w").alias("s")))
    return rows.groupBy("path").agg(F.when(F.bool_or(F.col("s").isin("t", "i")), "tracked").otherwise("untracked").alias("worktree_state"))


def ignored_paths(walked: DataFrame, visible: DataFrame, candidates: DataFrame) -> DataFrame:
    return walked.select("path").join(visible.select("path"), "path", "left_anti").join(candidates.select("path"), "path", "left_anti").distinct()


def modified_paths(index: DataFrame, worktree: DataFrame) -> DataFrame:
    """Indexed paths whose bytes differ in the worktree, or that it lacks: both ``(path, sha256)``."""
    now = worktree.select("path", F.col("sha256").alias("now"))
    return index.join(now, "path", "left").filter(~F.col("sha256").eqNullSafe(F.col("now"))).select("path")


def cross_project(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Edges between projects that aren't ambiguous, by pair of projects."""
    a, b = (files.select(F.col("path").alias(c), F.col("project_root").alias(f"{c}_project")).distinct() for c in ("source", "target"))
    crossing = edges.filter(~F.col("ambiguous")).join(a, "source").join(b, "target").filter("source_project <> target_project")
    return crossing.groupBy("source_project", "target_project").agg(F.count("*").alias("edges"))


def coverage(files: DataFrame, omissions: DataFrame | None = None) -> DataFrame:
    """``(fact, key, n)``: files by language and by status, omissions by reason."""
    def counts(df: DataFrame, fact: str, column: str) -> DataFrame:
        return df.groupBy(F.col(column).alias("key")).agg(F.count("*").alias("n")).select(F.lit(fact).alias("fact"), "key", "n")

    out = counts(files, "language", "language").unionByName(counts(files, "status", "status"))
    return out if omissions is None else out.unionByName(counts(omissions, "omission", "reason"))
