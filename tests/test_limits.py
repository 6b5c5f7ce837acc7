"""Queries whose SQL knows no limit of work, over more rows than any limit of an operator lets through."""

import pytest
from pyspark.sql import functions as F

from marlstone.operators import graph, index, topology
from marlstone.plans.registered import QUERIES, SQL
from tests.oracle import connect, rows_of_spark, rows_of_sql


@pytest.fixture(scope="module")
def suppliers(spark, tmp_path_factory):
    """A table of 6000 suppliers."""
    at = str(tmp_path_factory.mktemp("suppliers"))
    spark.range(1, 6001).select(F.col("id").alias("s_suppkey")).write.parquet(f"{at}/supplier.parquet")
    return at


def test_impact_of_many_seeds(spark, suppliers):
    assert rows_of_spark(QUERIES["impact_reach"](spark, suppliers)) == rows_of_sql(connect(suppliers), SQL["impact_reach"])


def test_project_walk_of_many_anchors(spark, suppliers):
    assert rows_of_spark(QUERIES["walk_in_project"](spark, suppliers)) == rows_of_sql(connect(suppliers), SQL["walk_in_project"])


def test_path_through_a_wide_level(spark, tmp_path):
    """A first level of 110 000 edges, and a second one that ends at the last part."""
    order = spark.range(1, 110_001).select(F.col("id").alias("k"))
    last = order.select(F.lit(1).cast("long").alias("l_linenumber"), F.lit(1).cast("long").alias("l_partkey"), F.col("k").alias("l_orderkey"))
    to = order.select(F.lit(2).cast("long"), F.col("k") + 1, F.col("k"))
    end = order.filter("k = 9").select(F.lit(3).cast("long"), F.lit(200_000).cast("long"), F.col("k"))
    line = last.union(to).union(end).withColumns({c: F.lit(1).cast("long") for c in ("l_suppkey", "l_quantity", "l_extendedprice")})
    line.write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(200_000, 200_001).select(F.col("id").alias("p_partkey")).write.parquet(f"{tmp_path}/part.parquet")
    got = rows_of_spark(QUERIES["shortest_path"](spark, str(tmp_path)))
    assert got == rows_of_sql(connect(str(tmp_path)), SQL["shortest_path"]) and got[1] == [(2, False)]


def test_rows_are_counted_over_all_parts_of_a_sort(spark):
    rows = spark.range(1000).select((F.col("id") * 389 % 1000).alias("x")).repartition(7)
    got = {r["x"]: r["n"] for r in graph.counted(rows, ["x"], "n").collect()}
    assert got == {x: x + 1 for x in range(1000)}


def test_index_is_not_shuffled(spark, tmp_path, monkeypatch):
    """A path stands once a bucket, and neither a new index nor an update sends postings to another task."""
    f = spark.createDataFrame([(f"p{k}", f"Many words {k * 7919} of many words") for k in range(200)], "path string, text string")
    written = []
    ix = index.StoredIndex(spark, str(tmp_path / "ix"), buckets=4)
    write = ix.table._write
    monkeypatch.setattr(ix.table, "_write", lambda rows, *a: (written.append(rows._jdf.queryExecution().executedPlan().toString()), write(rows, *a))[1])
    ix.create(f.filter("path <> 'p7'"))
    ix.update(f.filter("path in ('p7', 'p8')"), f.filter("path = 'p9'"))
    assert len(written) == 2 and not any("hashpartitioning" in p for p in written)
    rows = ix.table.read()
    assert rows.count() == rows.select("bucket", "path").distinct().count() > 0
    got = index.unpacked(rows, list(range(1 << 24))).join(f, "path")
    want = index.postings(f.filter("path <> 'p9'"), 4).select("trigram", "path", "positions")
    assert rows_of_spark(got.select("trigram", "path", "positions")) == rows_of_spark(want)
    assert len(ix.search("MANY w").collect()) == 199


def test_roots_are_looked_for_by_folder(spark):
    """Folders meet roots, not paths; a root holds itself, and no path has no root."""
    paths = spark.createDataFrame([(p,) for p in ("a/b/x", "a/b", "a/c/y", "z", "a/bc/x", None, "/r/x", "a/b/x")], "path string")
    found = topology.deepest_root(paths, spark.createDataFrame([(".",), ("a",), ("a/b",), ("/r",), ("a",)], "path string"))
    assert rows_of_spark(found)[1] == sorted([("a/b/x", "a/b")] * 2 + [("a/b", "a/b"), ("a/c/y", "a"), ("z", "."), ("a/bc/x", "a"), (None, None), ("/r/x", "/r")], key=repr)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [__folder") >= 1
