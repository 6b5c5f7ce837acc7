"""The engine's logical tables, derived from the driver's star schema.

Documents are files, their tokens symbols, orders commits, the parts of their
lines the paths these change, and consecutive parts of an order edges.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions.stage import dealt, import_on_workers, small_batches
from marlstone.functions.text import is_generic_name

#: Fixed "now" of history queries: 2001-08-01 UTC, as epoch seconds.
NOW = 996_624_000
BUG_WORDS, FIRE_WORDS = ["urgent", "high"], ["low", "specified"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.concat_ws("/", "source", "lang", F.concat(F.lit("doc_"), "doc_id")).alias("path"),
        F.col("lang").alias("language"),
        F.col("source").alias("project_root"),
        F.when(F.col("doc_id") % 5 == 0, "modified").when(F.col("doc_id") % 7 == 0, "untracked").otherwise("tracked").alias("worktree_state"),
        F.when(F.col("n_chars") < 100, "partial").otherwise("analyzed").alias("status"),
        "text",
        "doc_id",
        "n_chars",
    )


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ASCII tokens of five letters or more; the first one of a line defines its name."""
    lines = files(spark, sf_dir).select("path", "language", F.posexplode(F.split("text", "\n", -1)).alias("l", "text"))
    tokens = lines.select("path", "language", "l", F.posexplode(F.regexp_extract_all("text", F.lit("[A-Za-z]{5,}"), 0)).alias("t", "name"))
    return tokens.select(
        "path", "language", "name",
        (F.col("l").cast("long") * 100_000 + F.col("t")).alias("ord"),
        (F.col("l") + 1).alias("line"), (F.col("t") + 1).alias("column"),
        F.when(F.col("t") == 0, "definition").otherwise("reference").alias("role"),
        F.lit("function").alias("kind"), F.lit("explicit").alias("evidence"), F.lit("").alias("context"), F.lit("public").alias("visibility"),
        F.array("language").alias("modules"),
    )


_TOKEN = re.compile("[A-Za-z]{5,}")


def _references(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All tokens of ``(language, path, text)`` but the first of each line, and whether a line of the file begins with one like it."""
    find = _TOKEN.findall
    for batch in batches:
        sizes, starts, runs, names, own = [], [], [], [], []
        for text in batch.column(2).to_pylist():
            first, before = set(), len(names)
            for at, line in enumerate((text or "").split("\n")):
                if found := find(line):
                    first.add(found[0])
                    starts.append(at * 100_000 + 1)
                    runs.append(len(found) - 1)
                    names += found[1:]
            sizes.append(len(names) - before)
            own += map(first.__contains__, names[before:])
        runs = np.array(runs, np.int64)
        ords = np.repeat(np.array(starts, np.int64) - np.cumsum(runs) + runs, runs) + np.arange(len(names))
        rows = pa.array(np.repeat(np.arange(len(sizes)), sizes))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(ords), pa.array(names, pa.string()), pa.array(own, pa.bool_())], ["language", "source", "ord", "symbol", "own"])


def _definitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first tokens of the lines of ``(language, path, text)``, once a file."""
    find = _TOKEN.search
    for batch in batches:
        names = [list({m[0] for line in (text or "").split("\n") if (m := find(line))}) for text in batch.column(2).to_pylist()]
        rows = pa.array(np.repeat(np.arange(len(names)), [len(n) for n in names]))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array(list(chain.from_iterable(names)), pa.string()), batch.column(1).take(rows)], ["language", "name", "path"])


def marked_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(language, source, ord, symbol, own, visibility)``: the references of ``symbols``, each also its name's import, cut and marked in one pass over texts.

    For tables in which no path repeats.
    """
    import_on_workers(spark)
    small_batches(spark)
    f = files(spark, sf_dir).filter("language is not null").select("language", "path", "text")
    rows = f.mapInArrow(_references, "language string, source string, ord long, symbol string, own boolean")
    return rows.filter(~is_generic_name(F.col("symbol"))).withColumn("visibility", F.lit("public"))


def token_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(language, name, path, visibility)``: the definitions of ``symbols``, where no path repeats."""
    import_on_workers(spark)
    small_batches(spark)
    f = files(spark, sf_dir).filter("language is not null").select("language", "path", "text")
    return f.mapInArrow(_definitions, "language string, name string, path string").withColumn("visibility", F.lit("public"))


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(src, dst, weight, kind, confidence, ambiguous, id)`` from each part to the next one of its order."""
    line = table(spark, sf_dir, "lineitem")
    rows = line.count()  # by the files' footers
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    own = dealt(line.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"), rows, "l_orderkey")
    steps = own.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst")).filter("dst is not null")
    grouped = dealt(steps, rows, "src", "dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))
    kind = F.when((F.col("src") + F.col("dst")) % 3 == 0, "call").when((F.col("src") + F.col("dst")) % 3 == 1, "import").otherwise("dependency")
    sure = F.when(F.col("weight") > 1, "high").when((F.col("src") * 7 + F.col("dst")) % 11 == 0, "low").otherwise("medium")
    return grouped.select("src", "dst", "weight", kind.alias("kind"), sure.alias("confidence"), ((F.col("src") * 3 + F.col("dst")) % 13 == 0).alias("ambiguous"), F.concat_ws("-", "src", "dst").alias("id"))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    shipped = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("shipped"))
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    return o.join(shipped, "o_orderkey", "left").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("message"),
        F.concat(F.lit("Customer "), "o_custkey").alias("author_name"),
        F.concat(F.lit("c"), "o_custkey", F.lit("@example.com")).alias("author_email"),
        F.coalesce(seconds("shipped"), seconds("o_orderdate")).alias("author_seconds"),
        seconds("o_orderdate").alias("committer_seconds"),
        (F.col("o_orderkey") % 10 == 0).alias("is_merge"),
    )


def part_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(p_partkey, path, size)``: parts as files, their price in cents as bytes."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.concat_ws("/", "p_brand", "p_type", F.concat(F.lit("part_"), "p_partkey")).alias("path"), F.round(F.col("p_retailprice") * 100).cast("long").alias("size"), "p_size")


def commit_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("p_partkey")).distinct()
    return line.join(part_paths(spark, sf_dir).select("p_partkey", "path"), "p_partkey").select("id", "path")


def mailmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers under the name of their nation."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(
        F.concat(F.lit("c"), "c_custkey", F.lit("@example.com")).alias("raw_email"), F.col("n_name").alias("name"), F.concat(F.lower(F.replace("n_name", F.lit(" "), F.lit("_"))), F.lit("@nation")).alias("email")
    )
