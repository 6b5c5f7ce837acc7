import json

import pytest
from pyspark.sql import functions as F

from marlstone.operators import edges, graph, index, relationships
from marlstone.sources import store
from tests.test_operators import SYMBOL, sym


def test_relationship_graph(spark):
    s = spark.createDataFrame([sym("a.rs", 0, "run", "definition", "syntax"), sym("b.rs", 0, "run", "definition", "import", "use crate::a::run;", kind="import"), sym("b.rs", 1, "go", "definition", "syntax"), sym("b.rs", 2, "run", kind="call")], SYMBOL)
    s = s.withColumn("scope", F.when(F.col("ord") == 2, F.array(F.lit("go"))).otherwise(F.array().cast("array<string>")))
    f = spark.createDataFrame([("a.rs", "rust", "analyzed"), ("b.rs", "rust", "partial")], "path string, language string, status string")
    told = edges.describe(edges.answers(edges.questions(s), s)).filter("target <> source")
    rel = relationships.build(f, told, s)
    got = {(r["kind"], r["source"], r["target"]) for r in rel.collect()}
    go, run = "symbol:b.rs:1:1:1:1:definition:function:go", "symbol:a.rs:0:1:0:1:definition:function:run"
    assert ("import", "file:b.rs", "file:a.rs") in got and ("call", go, run) in got
    assert rel.select("id").distinct().count() == rel.count()
    assert {r["confidence"] for r in rel.collect()} == {"medium"}  # one end is partial
    n = relationships.nodes(f, s)
    assert n.count() == 6 and relationships.named(n, "RUN", "definition").count() == 2
    assert relationships.provenance(n, rel).first()["partial_nodes"] == 4
    back = graph.callers(relationships.as_graph(rel), spark.createDataFrame([(run,)], "node string"))
    assert [r["other"] for r in back.collect()] == [go]
    page = relationships.report(n, rel, "reverse_dependencies", "a.rs")
    assert page["bounds"]["total"] == 1 and page["bounds"]["continuation"] is None and page["matches"].first()["node"] == "file:b.rs"
    assert relationships.report(n, rel, "callers", "run", tokens=5)["omissions"] == [{"reason": "token_budget", "count": 1}]
    walked = relationships.traverse(n, rel, "neighbors", "b.rs", depth=2)
    assert [r["node"] for r in walked["nodes"].collect()] == ["file:a.rs"] and walked["omissions"] == []
    assert relationships.traverse(n, rel, "path", "go", "a.rs")["path"].count() == 0


def test_cache_index_and_records(spark, tmp_path):
    rows = [(k, "r", f"p{k % 3}", f"f{k % 3}", "x", 1_000_000 + k, 10) for k in range(6)]
    at = str(tmp_path / "cache")
    store.write_cache(spark.createDataFrame(rows, "id long, repo string, path string, fingerprint string, pack string, modified long, bytes long"), at)
    got = {(r["path"], r["id"]) for r in store.read_cache(spark, at, "r").collect()}
    assert got == {("p0", 3), ("p1", 4), ("p2", 5)}
    assert store.cache_status(spark, at).first()["records"] == 6
    store.prune_cache(spark, at, 1_000_003 + 30 * 86_400, str(tmp_path / "pruned"))
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "pruned")).collect()) == [3, 4, 5]
    store.clear_cache(spark, at)
    assert not store.exists(spark, at)
    store.add_task_record(spark, str(tmp_path / "tasks"), "t1", 5, "x")
    with pytest.raises(FileExistsError):
        store.add_task_record(spark, str(tmp_path / "tasks"), "t1", 6, "y")


def test_index_states(spark, tmp_path):
    at, options, now = str(tmp_path / "index"), {"profile": "compact"}, {"head": "1"}
    made = index.postings(spark.createDataFrame([("a", "abcd"), ("b", "bcde")], "path string, text string"))
    state = lambda o=options, s=now, p=at: store.index_state(spark, p, o, s)[0]
    assert state(p=None) == "bypassed" and state() == "missing"
    made.write.parquet(f"{at}/postings-half")  # a publication that got no further
    assert state() == "missing"
    assert store.publish_index(made, at, options, now) == "refreshed"
    assert state() == "hit" and state(s={"head": "2"}) == "stale" and state(o={"profile": "evidence"}) == "incompatible"
    assert store.index_state(spark, at, options, now)[1].count() == made.count()
    store.publish_index(made.filter("path = 'a'"), at, options, {"head": "2"})
    assert state() == "stale" and store.index_state(spark, at, options, now)[1].count() < made.count()
    told = json.loads(next((tmp_path / "index" / "pointer").glob("part-*")).read_text())
    part = tmp_path / "index" / f"postings-{told['part']}"
    file = max(part.glob("part-*.parquet"), key=lambda p: p.stat().st_size)
    whole = file.read_bytes()
    for crc in part.glob(".*.crc"):
        crc.unlink()
    file.write_bytes(whole[: len(whole) // 2])
    assert state() == "corrupt"
    file.unlink()
    assert state() == "corrupt"
    pointer = next((tmp_path / "index" / "pointer").glob("part-*"))
    for crc in (tmp_path / "index" / "pointer").glob(".*.crc"):
        crc.unlink()
    pointer.write_text("no pointer")
    assert state() == "corrupt"
    pointer.write_text('{"schema": 0, "part": "x", "columns": "{\\"type\\":\\"struct\\",\\"fields\\":[]}", "digest": {}, "analysis": {}, "state": {}}')
    assert state() == "incompatible"
    pointer.unlink()
    (tmp_path / "index" / "pointer" / "part-0.txt.gz").write_bytes(b"not packed")
    assert state() == "failed"


def test_manual_cache_takes_the_newest_record(spark):
    files = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("d", "1")], "path string, fingerprint string")
    rows = [(1, "a", "1", "p", 5, 5), (2, "a", "0", "p", 4, 9), (3, "b", "1", "p", 1, 1), (4, "b", "0", "p", 2, 1), (5, "c", "1", "other", 9, 9), (7, "d", "2", "p", 3, 3), (6, "d", "1", "p", 3, 3)]
    cache = spark.createDataFrame(rows, "id long, path string, fingerprint string, pack string, created long, modified long")
    got = {r["path"]: (r["state"], r["record"]["id"] if r["record"] else None) for r in index.cached_manually(files, cache, "p").collect()}
    assert got == {"a": ("hit", 1), "b": ("stale", 4), "c": ("miss", None), "d": ("hit", 6)}
