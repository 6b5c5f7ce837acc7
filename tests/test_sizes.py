"""Tasks that hold no more of a larger table, and work that is done once."""

import pytest
from pyspark.sql import functions as F

from marlstone.functions import paths, stage
from marlstone.operators import bounding, edges, graph, relationships
from marlstone.plans import cases
from marlstone.plans import tables as T


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_part_edges_are_dealt_by_size(spark, sf_dir, monkeypatch):
    whole = rows_of(T.part_edges(spark, sf_dir))
    monkeypatch.setattr(stage, "PART_ROWS", 200)
    lines = T.table(spark, sf_dir, "lineitem").count()
    dealt = T.part_edges(spark, sf_dir)
    assert dealt.rdd.getNumPartitions() == -(-lines // 200)
    assert rows_of(dealt) == whole


def times_run(spark, df, work):
    """How often each row of ``df`` is made while ``work`` uses it."""
    made = spark.sparkContext.accumulator(0)

    def count(frames):
        for f in frames:
            made.add(len(f))
            yield f

    work(df.mapInPandas(count, df.schema)).collect()
    return made.value / df.count()


def test_edges_are_made_once(spark):
    links = spark.createDataFrame([(k % 7, k % 5 + 3) for k in range(40)], "src long, dst long").repartition(2)
    seeds = spark.createDataFrame([(1,), (2,)], "node long")
    assert times_run(spark, links, lambda e: edges.degrees(e, "src", "dst")) == 1
    assert times_run(spark, links, lambda e: graph.seed_proximity(e, seeds)) == 1


def test_proximity_of_repeated_and_looping_edges(spark):
    links = spark.createDataFrame([(1, 3), (3, 1), (1, 3), (2, 3), (3, 3), (3, 4), (4, 5), (2, 5), (1, 2), (5, 6)], "src long, dst long")
    got = graph.seed_proximity(links, spark.createDataFrame([(1,), (2,), (1,)], "node long"))
    assert rows_of(got.select("node", "distance", "seed")) == [(3, 1, 1), (4, 2, 1), (5, 1, 2), (6, 2, 2)]


def test_breaks_at_the_end_are_lines(spark):
    texts = [("x" * 2000 + "\n" * n, n <= 3) for n in range(6)]
    got = spark.createDataFrame([(t,) for t, _ in texts], "t string").select(paths.looks_minified(F.lit("a.js"), F.col("t")).alias("hit"))
    assert [r["hit"] for r in got.collect()] == [hit for _, hit in texts]


def test_cases_are_dealt_by_what_they_make(spark, sf_dir, monkeypatch):
    rows = [(1, "a{g}", ["{g}", "b"]), (2, "c", ["d"])]
    whole = rows_of(cases.spread(spark, sf_dir, rows, "n int, x string, y array<string>"))
    monkeypatch.setattr(cases, "PART_BYTES", 100)
    dealt = cases.spread(spark, sf_dir, rows, "n int, x string, y array<string>")
    assert dealt.rdd.getNumPartitions() > 1 and [repr(r) for r in rows_of(dealt)] == [repr(r) for r in whole]
    assert (2, "c", ["d"]) in whole and (1, "a1", ["1", "b"]) in whole


def test_symbols_are_measured_before_they_are_dealt(spark, monkeypatch):
    """What sorts symbols holds their sizes, not their names, and has as many parts as their number asks for."""
    monkeypatch.setattr(stage, "PART_ROWS", 50)
    seen = []
    monkeypatch.setattr(bounding, "dealt", lambda df, rows, *keys: seen.append((rows, stage.dealt(df, rows, *keys))) or seen[-1][1])
    files = bounding.Collection("files", spark.createDataFrame([(f"f{k}",) for k in range(30)], "path string"), [F.asc("path")], bounding.json_bytes("path"))
    rows = spark.createDataFrame([(f"f{k % 30}", k, "name" * 9) for k in range(900)], "path string, ord long, name string")
    got = bounding.evidence_bound([files], bounding.Collection("symbols", rows, [F.asc("ord")], bounding.json_bytes("name")), "path", 30_000)
    assert [n for n, _ in seen] == [900] and seen[0][1].rdd.getNumPartitions() == 18
    # 30 files keep 16 symbols each: 46 bytes a symbol, and the comma.
    assert {r["name"]: (r["total"], r["returned"]) for r in got.collect()} == {"files": (30, 30), "symbols": (900, 480)}


def test_no_growing_table_is_sent_by_the_driver(spark, sf_dir, monkeypatch):
    """The keys of a small table become all rows of a tree, so Spark takes sides of joins for small that grow with it."""
    plans = []

    def noted(df, label, write=stage.write_stage):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return write(df, label)

    for module in (edges, relationships, cases):
        monkeypatch.setattr(module, "write_stage", noted)
    n, r = cases._graph(spark, sf_dir)
    steps = relationships.candidates(n, r, "imports", "src/app1.ts")
    assert [x["node"] for x in steps.collect()] == ["file:src/util1.ts"]
    assert len(plans) > 8 and sum(p.count("Join") for p in plans) > 20
    assert [x for p in plans for x in p.splitlines() if "Broadcast" in x] == []


def test_rounds_of_ranks_shuffle_no_edges(spark, monkeypatch):
    """In several blocks, with ends outside the nodes on both sides, ranks are as by hand; a round shuffles ranks and their sums only."""
    pairs = [(k, (k * 7 + j * j) % 43) for k in range(43) for j in range(5)]
    links = spark.createDataFrame([(a, b, 1 + (a + b) % 3) for a, b in pairs if a % 11], "src long, dst long, weight int")
    inside = [k for k in range(40) if k != 5]
    monkeypatch.setattr(stage, "PART_ROWS", 40)
    plans = []

    def noted(df, label, write=stage.write_stage):
        if label == "rank":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, label)

    monkeypatch.setattr(graph, "write_stage", noted)
    found = graph.pagerank(spark.createDataFrame([(k,) for k in inside], "node long"), links, iterations=6)
    assert len(plans) == 6
    for p in plans:
        assert p.count("Exchange hashpartitioning") == 2 and "Bucketed: true" in p

    out, weights = {}, {}
    for a, b in pairs:
        if a % 11:
            out[a] = out.get(a, 0) + 1 + (a + b) % 3
            weights[a, b] = weights.get((a, b), 0) + 1 + (a + b) % 3
    score = dict.fromkeys(inside, 1 / len(inside))
    for _ in range(6):
        loose = sum(v for k, v in score.items() if k not in out)
        score = {k: (0.15 + 0.85 * loose) / len(inside) + 0.85 * sum(score[a] * w / out[a] for (a, b), w in weights.items() if b == k and a in score) for k in inside}
    assert {r["node"]: r["score"] for r in found.collect()} == pytest.approx(score)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("marlstone_")]
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"
