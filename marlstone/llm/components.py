"""Connected components by alternating large-star and small-star steps.

Only joins, groupings and written tables: no step gathers a node's neighbours,
so a hub that touches a third of all nodes is a skewed join (which adaptive
execution splits) and a partially combined minimum.  Every round's edges are
written to the shared folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.stage import drop_stage, write_stage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return (
        both.filter("v > u")
        .join(least, "u")
        .select(F.col("v").alias("a"), F.least("m", "u").alias("b"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    return (
        joined.select(F.col("v").alias("a"), F.col("m").alias("b"))
        .union(least.select("u", "m"))
        .filter("a <> b")
        .distinct()
    )


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node with an edge; ``root`` is the least node of its component.

    ``edges`` has two columns of one orderable type, in either direction; nulls,
    loops and repeats are ignored.  No edge gives no row.
    """
    spark = edges.sparkSession
    a, b = edges.columns
    start = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct()
    now, path = write_stage(start, "edges")
    seen = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if state == seen or not state["n"]:
            break
        seen = state
        after, new_path = write_stage(_small_star(_large_star(now)), "edges")
        drop_stage(spark, path)
        now, path = after, new_path
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select("b", "b").distinct()
    )
