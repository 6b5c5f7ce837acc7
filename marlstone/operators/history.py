"""Signals from the history of changes.  ``now`` is always given, never the wall clock.

``commits(id, message, author_name, author_email, author_seconds,
committer_seconds, is_merge)`` and ``commit_paths(id, path)``, distinct.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.paths import in_scope
from marlstone.functions.text import matched_keywords, month_of
from marlstone.operators.budget import taken_while_fitting

DAY = 86_400
#: Churn is given for a thousand KiB of a file (fixed value).
CHURN_SCALE = 1_024_000


def since(seconds: Column, now: int, days: int) -> Column:
    return seconds >= now - days * DAY


def changes_in(commits: DataFrame, commit_paths: DataFrame, now: int, days: int, scope: str = ".") -> DataFrame:
    """Paths changed by commits of a window that are no merges."""
    some = commits.filter(since(F.col("committer_seconds"), now, days) & ~F.col("is_merge")).select("id")
    return commit_paths.filter(in_scope(F.col("path"), scope)).join(some, "id")


def commits_in_scope(commits: DataFrame, commit_paths: DataFrame, scope: str = ".") -> DataFrame:
    """Commits that change a path of a scope; all of them in the whole tree.  Every signal of a scope is that of these commits."""
    if scope == ".":
        return commits
    return commits.join(commit_paths.filter(in_scope(F.col("path"), scope)).select("id").distinct(), "id", "left_semi")


def churn(commits: DataFrame, commit_paths: DataFrame, now: int, days: int, scope: str = ".") -> DataFrame:
    return changes_in(commits, commit_paths, now, days, scope).groupBy("path").agg(F.count("*").alias("commits"))


def normalised_churn(churned: DataFrame, head_files: DataFrame, max_bytes: int = 1 << 20, total_bytes: int | None = None) -> DataFrame:
    """Churn by size at head: ``head_files(path, size, binary, generated)``; sizes that say nothing are named.

    With ``total_bytes``, files are looked into in order of commits and path while
    their sizes fit into it; one that doesn't fit is ``resource_limit``.
    """
    joined = churned.join(head_files, "path", "left")
    beyond = F.lit(False)
    if total_bytes is not None:
        read = F.when(F.col("size").between(1, max_bytes), F.col("size")).otherwise(0)
        read_rows = taken_while_fitting(joined.select("path", "commits", read.alias("__read")), [F.desc("commits"), F.asc("path")], "__read", total_bytes)
        joined = joined.join(read_rows.select("path", F.lit(True).alias("__fits")), "path", "left")
        beyond = F.col("__fits").isNull()
    status = (
        F.when(F.col("size").isNull(), "missing_at_head")
        .when(F.col("size") == 0, "empty")
        .when(F.col("size") > max_bytes, "oversized")
        .when(beyond, "resource_limit")
        .when(F.col("binary"), "binary")
        .when(F.col("generated"), "generated")
        .otherwise("text")
    )
    return joined.withColumn("size_status", status).select(
        "path", "commits", "size", "size_status", F.when(F.col("size_status") == "text", F.expr(f"commits * {CHURN_SCALE}L div size")).alias("normalised")
    )


def with_identities(commits: DataFrame, mailmap: DataFrame) -> DataFrame:
    """Commits under canonical names: ``mailmap(raw_email, name, email)``, and maybe ``raw_name`` and ``line``; an unknown author stays.

    An entry with a raw name holds for that name and address, any other for the
    address; both without regard to case.  Of several entries of one key the last
    line's name and address stand (without ``line``, the greatest).  Names come
    trimmed, ``Unknown`` where empty, addresses in lower case.
    """
    columns = mailmap.columns
    raw_name = F.lower(F.trim("raw_name")) if "raw_name" in columns else F.lit(None).cast("string")
    line = F.col("line") if "line" in columns else F.lit(0)
    rows = mailmap.select(F.lower(F.trim("raw_email")).alias("__email"), F.nullif(raw_name, F.lit("")).alias("__name"), "name", "email", line.alias("__line"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("__line", c))).alias(c)
    known = rows.groupBy("__email", "__name").agg(last("name"), last("email"))
    exact = known.filter("__name is not null").select(F.col("__email").alias("__e1"), F.col("__name").alias("__n1"), F.col("name").alias("__name1"), F.col("email").alias("__email1"), F.lit(True).alias("__hit"))
    plain = known.filter("__name is null").select(F.col("__email").alias("__e2"), F.col("name").alias("__name2"), F.col("email").alias("__email2"))
    at_email, at_name = F.lower(F.trim("author_email")), F.lower(F.trim("author_name"))
    met = commits.join(exact, (at_email == F.col("__e1")) & (at_name == F.col("__n1")), "left").join(plain, at_email == F.col("__e2"), "left")
    name = F.trim(F.coalesce(F.when(F.col("__hit"), F.col("__name1")).otherwise(F.col("__name2")), "author_name"))
    email = F.coalesce(F.when(F.col("__hit"), F.col("__email1")).otherwise(F.col("__email2")), "author_email")
    return met.select(
        *(c for c in commits.columns if c not in ("author_name", "author_email")),
        F.when(F.coalesce(name, F.lit("")) == "", "Unknown").otherwise(name).alias("author_name"),
        F.lower(F.trim(email)).alias("author_email"),
        F.col("author_name").alias("raw_name"),
        F.col("author_email").alias("raw_email"),
    )


def identity_mappings(named: DataFrame) -> DataFrame:
    changed = ~F.col("raw_name").eqNullSafe(F.col("author_name")) | ~F.col("raw_email").eqNullSafe(F.col("author_email"))
    return named.filter(changed).select("raw_name", "raw_email", "author_name", "author_email").distinct()


def contributors(commits: DataFrame, now: int | None = None, days: int | None = None) -> DataFrame:
    """Commits by author: by e-mail, or by lower-cased name where it is empty; the first name seen stands.

    A window counts author dates; merges don't count.  ``share`` is whole percents.
    """
    some = commits.filter(~F.col("is_merge"))
    if now is not None:
        some = some.filter(since(F.col("author_seconds"), now, days))
    key = F.when(F.coalesce("author_email", F.lit("")) == "", F.lower("author_name")).otherwise(F.lower("author_email"))
    first = F.struct("committer_seconds", "id")
    grouped = some.groupBy(key.alias("key")).agg(F.count("*").alias("commits"), F.max_by("author_name", first).alias("name"), F.max_by("author_email", first).alias("email"))
    total = some.agg(F.count("*").alias("total"))  # one row
    return grouped.select("name", "email", "commits", F.floor(F.col("commits") * 100 / total.scalar()).alias("share"))


def keyword_commits(commits: DataFrame, keywords: list[str], now: int, days: int, mode: str = "word") -> DataFrame:
    """Commits of a window whose message holds keywords; merges don't count."""
    some = commits.filter(since(F.col("committer_seconds"), now, days) & ~F.col("is_merge"))
    return some.withColumn("keywords", matched_keywords(F.col("message"), keywords, mode)).filter(F.size("keywords") > 0)


def keyword_paths(commits: DataFrame, commit_paths: DataFrame, keywords: list[str], now: int, days: int, mode: str = "word") -> DataFrame:
    """Commits by path among those with keywords."""
    return commit_paths.join(keyword_commits(commits, keywords, now, days, mode).select("id"), "id").groupBy("path").agg(F.count("*").alias("commits"))


def overlap(bug_paths: DataFrame, churned: DataFrame) -> DataFrame:
    return bug_paths.join(churned.select("path"), "path", "left_semi")


def activity(commits: DataFrame) -> DataFrame:
    """Commits by month of the author's date, merges included."""
    return commits.groupBy(month_of(F.col("author_seconds")).alias("month")).agg(F.count("*").alias("commits"))


def busiest_month(commits: DataFrame) -> DataFrame:
    return activity(commits).agg(F.max(F.struct("commits", "month")).alias("m")).select("m.month", "m.commits")


def history_span(commits: DataFrame) -> DataFrame:
    return commits.agg(
        F.min("committer_seconds").alias("first"), F.max("committer_seconds").alias("last"), F.count("*").alias("commits"), F.count_if(~F.col("is_merge")).alias("non_merges")
    )


def history_weight(churned: DataFrame, bug_overlap: DataFrame, firefighting: DataFrame) -> DataFrame:
    """Weight of a path for ranking: churn, keyword commits on churned paths, one for each firefighting commit."""
    parts = [churned.select("path", "commits"), bug_overlap.select("path", "commits"), firefighting.select("path", F.lit(1).cast("long").alias("commits"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("path").agg(F.sum("commits").alias("weight"))


#: Paths that an observation names, and what makes one worth stating: commits of a path or contributor, months and commits seen (fixed values).
NAMED_PATHS, FEW_COMMITS, FEW_MONTHS, FEW_SEEN = 3, 2, 2, 3


def _first_paths(rows: DataFrame, value: str = "commits") -> DataFrame:
    """One row with the ``NAMED_PATHS`` most changed paths, most first, and how many paths there are."""
    top = rows.orderBy(F.desc(value), "path").limit(NAMED_PATHS).agg(F.array_sort(F.collect_list(F.struct((-F.col(value)).alias("n"), "path"))).alias("top"))
    return top.join(F.broadcast(rows.agg(F.count("*").alias("all"))), how="cross").select(F.transform("top", lambda t: t["path"]).alias("paths"), F.transform("top", lambda t: -t["n"]).alias("counts"), "all")  # one row on both sides


def observations(churned: DataFrame, contributors_all: DataFrame, contributors_recent: DataFrame, bug_overlap: DataFrame, bug_paths: DataFrame, commits: DataFrame, fire: DataFrame, commit_paths: DataFrame) -> DataFrame:
    """Statements that the signals support: ``(kind, paths, detail, value, of)``, one row a kind.

    ``churn`` where a path has two commits or two paths have any; ``contributors``, the first of the recent ones or, if they have too few
    commits, of all, with two commits at least; ``bug_overlap`` where paths of bug commits are among the
    changed; ``activity``, the busiest month (the later on ties), from two months and three commits on; ``firefighting`` where there is such a commit.
    """
    none, no_paths = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    head = _first_paths(churned).filter((F.coalesce(F.get("counts", F.lit(0)), F.lit(0)) >= FEW_COMMITS) | (F.col("all") >= 2))
    rows = [head.select(F.lit("churn").alias("kind"), "paths", none.alias("detail"), F.get("counts", F.lit(0)).cast("long").alias("value"), F.col("all").cast("long").alias("of"))]

    both = contributors_recent.withColumn("recent", F.lit(1)).unionByName(contributors_all.withColumn("recent", F.lit(0)))
    order = F.struct(-F.col("commits"), F.coalesce("email", F.lit("")), "name")
    sides = both.groupBy("recent").agg(F.min_by(F.struct("commits", F.coalesce("email", "name").alias("who")), order).alias("first"), F.sum("commits").alias("total")).filter(F.col("first.commits") >= FEW_COMMITS)
    chosen = sides.orderBy(F.desc("recent")).limit(1)
    rows.append(chosen.select(F.lit("contributors").alias("kind"), no_paths.alias("paths"), F.col("first.who").alias("detail"), F.col("first.commits").cast("long").alias("value"), F.col("total").cast("long").alias("of")))

    bugs = bug_paths.agg(F.count("*").alias("n")).filter("n > 0")
    rows.append(_first_paths(bug_overlap).filter("all > 0").join(F.broadcast(bugs), how="cross").select(F.lit("bug_overlap").alias("kind"), "paths", none.alias("detail"), F.get("counts", F.lit(0)).cast("long").alias("value"), F.col("all").cast("long").alias("of")))

    months = activity(commits)
    seen = months.agg(F.max(F.struct("commits", "month")).alias("m"), F.count("*").alias("months"), F.sum("commits").alias("all")).filter((F.col("months") >= FEW_MONTHS) & (F.col("all") >= FEW_SEEN))
    rows.append(seen.select(F.lit("activity").alias("kind"), no_paths.alias("paths"), F.col("m.month").alias("detail"), F.col("m.commits").cast("long").alias("value"), F.col("all").cast("long").alias("of")))

    touched = commit_paths.join(fire.select("id"), "id").groupBy("path").agg(F.count("*").alias("commits"))
    number = fire.agg(F.count("*").alias("n")).filter("n > 0")
    rows.append(_first_paths(touched).join(F.broadcast(number), how="cross").select(F.lit("firefighting").alias("kind"), "paths", none.alias("detail"), F.col("n").cast("long").alias("value"), F.col("all").cast("long").alias("of")))
    return reduce(DataFrame.unionByName, rows)
