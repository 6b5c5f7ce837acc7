"""Changes between two trees, renames, changed lines and the symbols on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.stage import write_stage


def tree_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(path, kind, before_oid, after_oid)`` of paths that differ: both sides ``(path, oid)``."""
    a = before.select("path", F.col("oid").alias("before_oid"))
    b = after.select("path", F.col("oid").alias("after_oid"))
    both = a.join(b, "path", "full_outer").filter(~F.col("before_oid").eqNullSafe(F.col("after_oid")))
    kind = F.when(F.col("before_oid").isNull(), "added").when(F.col("after_oid").isNull(), "deleted").otherwise("modified")
    return both.select("path", kind.alias("kind"), "before_oid", "after_oid")


def tree_entries(tree: DataFrame) -> DataFrame:
    """``(path, parent, depth, file, digest)`` of the files ``(path, oid)`` of a tree and of all its folders.

    A folder's digest says what lies below it, in any order: counts and sums of hashes, so that tasks
    add it up in parts.  Equal digests are equal subtrees but for collisions of 128 bits.
    """
    parts = F.split("path", "/", -1)
    depth = F.size(parts)
    above = F.when(depth > 1, F.sequence(F.lit(1), depth - 1)).otherwise(F.array().cast("array<int>"))
    up = lambda k: F.array_join(F.slice(parts, 1, k), "/")
    files = tree.select("path", up(depth - 1).alias("parent"), depth.alias("depth"), F.lit(True).alias("file"), F.col("oid").cast("string").alias("digest"))
    h = F.xxhash64("path", F.coalesce(F.col("oid").cast("string"), F.lit("")))
    held = tree.select(F.explode(F.transform(above, lambda k: F.struct(up(k).alias("path"), up(k - 1).alias("parent"), k.alias("depth")))).alias("f"), h.alias("h"), F.xxhash64(h, F.lit(1)).alias("g"))
    digest = F.concat_ws(":", F.count("*"), F.sum(F.col("h").cast("decimal(38,0)")), F.bit_xor("g"))
    folders = held.groupBy("f").agg(digest.alias("digest")).select("f.path", "f.parent", "f.depth", F.lit(False).alias("file"), "digest")
    return files.unionByName(folders)


def pruned_diff(before: DataFrame, after: DataFrame, levels: list[int] | None = None) -> DataFrame:
    """``tree_diff`` of two tables of ``tree_entries``, level by level, going down only where folders differ.

    Each level meets only the entries of folders that differ, so the joins stay near what changed however
    large the trees are.  ``levels``, where given, gets the number of entries met at each level.
    Tables stored by ``depth`` are read level by level as well.
    """
    spark, depth, out = before.sparkSession, 1, None
    frontier = spark.createDataFrame([("",)], "parent string")
    while True:
        a, b = (t.filter(F.col("depth") == depth).join(frontier, "parent", "left_semi").select("path", "file", F.col("digest").alias(c)) for t, c in ((before, "before_oid"), (after, "after_oid")))
        met, _ = write_stage(a.join(b, ["path", "file"], "full_outer"), "level")
        if levels is not None:
            levels.append(met.count())
        differ = met.filter(~F.col("before_oid").eqNullSafe(F.col("after_oid")))
        files = differ.filter("file").select("path", "before_oid", "after_oid")
        out = files if out is None else out.unionByName(files)
        frontier = differ.filter(~F.col("file")).select(F.col("path").alias("parent")).distinct()
        if frontier.isEmpty():
            break
        depth += 1
    kind = F.when(F.col("before_oid").isNull(), "added").when(F.col("after_oid").isNull(), "deleted").otherwise("modified")
    return out.select("path", kind.alias("kind"), "before_oid", "after_oid")


def detect_renames(diff: DataFrame) -> DataFrame:
    """Changes with exact renames: the n-th deleted path of a content goes with its n-th added one, by path order.

    Contents that many paths share are numbered after a partial cut per content
    of no effect on others; unmatched paths stay added or deleted.
    """
    gone, came = diff.filter("kind = 'deleted'"), diff.filter("kind = 'added'")
    order = lambda c: F.row_number().over(Window.partitionBy(c).orderBy("path"))
    g = gone.select(F.col("path").alias("previous_path"), F.col("before_oid").alias("oid"), order("before_oid").alias("n"))
    c = came.select("path", F.col("after_oid").alias("oid"), order("after_oid").alias("n"))
    pairs = c.join(g, ["oid", "n"])
    renamed = pairs.select("path", F.lit("renamed").alias("kind"), "previous_path")
    used = renamed.select("path").unionByName(renamed.select(F.col("previous_path").alias("path")))
    rest = diff.join(used, "path", "left_anti").select("path", "kind", F.lit(None).cast("string").alias("previous_path"))
    return rest.unionByName(renamed)


def bounded_changes(found: DataFrame, most: int = 4096) -> tuple[DataFrame, DataFrame]:
    """Distinct changes, the first ``most`` by path, previous path and kind, and ``(reason, detail)`` of what is uncertain: deleted sources, and a cut."""
    distinct = found.select("kind", "path", "previous_path").distinct()
    kept = distinct.orderBy("path", F.asc_nulls_first("previous_path"), "kind").limit(most)
    gone = kept.filter("kind = 'deleted'").select(F.lit("deleted_source").alias("reason"), F.col("path").alias("detail"))
    cut = distinct.agg(F.count("*").alias("n")).filter(F.col("n") > most).select(F.lit("truncated").alias("reason"), F.lit(str(most)).alias("detail"))
    return kept, gone.unionByName(cut)


def changed_range(before: Column, after: Column) -> Column:
    """The one range of lines of ``after`` that common lines at both ends leave, 1-based; null if none differ.

    ``before`` and ``after`` are arrays of lines.  A range of deleted lines is the
    line that follows them.
    """
    n, m = F.size(before), F.size(after)
    shared = F.least(n, m)
    same = lambda flags: F.coalesce(F.nullif(F.array_position(flags, F.lit(0)), F.lit(0)) - 1, F.size(flags).cast("long"))
    head = F.when(shared == 0, F.lit(0).cast("long")).otherwise(same(F.transform(F.sequence(F.lit(1), F.greatest(shared, F.lit(1))), lambda i: (F.get(before, i - 1) == F.get(after, i - 1)).cast("int"))))
    tail = F.when(shared == 0, F.lit(0).cast("long")).otherwise(same(F.transform(F.sequence(F.lit(1), F.greatest(shared, F.lit(1))), lambda i: (F.get(before, n - i) == F.get(after, m - i)).cast("int"))))
    rest = F.least(tail, shared - head)
    start, end = head + 1, F.greatest(head + 1, m - rest)
    return F.when((n == m) & (head == n), F.lit(None)).otherwise(F.struct(start.cast("int").alias("start"), end.cast("int").alias("end")))


def changed_symbols(symbols: DataFrame, ranges: DataFrame) -> DataFrame:
    """Symbols whose lines overlap a changed range of their file: ``symbols(path, name, start, end)``, ``ranges(path, start, end)``.

    The join is on the path; a file's ranges are few.
    """
    r = ranges.select("path", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    return symbols.join(r, "path").filter("start <= r_end and end >= r_start").select(*symbols.columns).distinct()


def missing_changed(changes: DataFrame, sources: DataFrame) -> DataFrame:
    return changes.select("path").distinct().join(sources.select("path"), "path", "left_anti")


def snapshot_check(facts: DataFrame, stored: DataFrame) -> DataFrame:
    """``(side, fact)`` of facts that only one of two snapshots has; empty means up to date."""
    now = facts.exceptAll(stored).select(F.lit("new").alias("side"), F.col("fact"))
    return now.unionByName(stored.exceptAll(facts).select(F.lit("gone").alias("side"), F.col("fact")))
