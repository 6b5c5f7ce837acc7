import random

import pytest
from pyspark.sql import functions as F

from marlstone.operators import budget, changes, edges, graph, history, index, ranking, reports, search, topology
from marlstone.sources import files as sources

EDGE = "src string, dst string, kind string, confidence string, ambiguous boolean, id string, weight int"


def graph_of(spark, text):
    rows = []
    for k, pair in enumerate(text.split()):
        a, b = pair.split(">")
        rows.append((a, b, "call", "high", False, f"e{k:02d}", 1))
    return spark.createDataFrame(rows, EDGE)


def nodes(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def test_walk_order_depth_and_work(spark):
    g = graph_of(spark, "a>b a>c b>d c>d d>a c>e")
    w = graph.walk(g, nodes(spark, "a"), depth=2)
    met = {r["node"]: (r["depth"], r["parent"]) for r in w.nodes.collect()}
    assert met == {"a": (0, None), "b": (1, "a"), "c": (1, "a"), "d": (2, "b"), "e": (2, "c")}
    assert w.depth_limited and not w.work_limited and w.work == 5
    short = graph.walk(g, nodes(spark, "a"), depth=9, work=3)
    assert short.work_limited and {r["node"] for r in short.nodes.collect()} == {"a", "b", "c", "d"}
    whole = graph.walk(g, nodes(spark, "a"), depth=9)
    assert not whole.depth_limited and whole.nodes.count() == 5
    assert graph.neighbours(g, nodes(spark, "a"), results=2, depth=2).count() == 2
    with pytest.raises(ValueError):
        graph.walk(g, nodes(spark, "a"), depth=65)


def test_walk_keeps_to_projects(spark):
    g = graph_of(spark, "a>b b>c")
    p = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "node string, root string")
    w = graph.walk(g, nodes(spark, "a"), depth=5, projects=p)
    assert {r["node"] for r in w.nodes.collect()} == {"a", "b"} and w.omitted_boundaries == 1


def test_shortest_path(spark):
    g = graph_of(spark, "a>b b>c a>d d>c c>e")
    path = [r["node"] for r in graph.shortest_path(g, nodes(spark, "a"), nodes(spark, "e")).collect()]
    assert path == ["a", "b", "c", "e"]
    assert graph.path_summary(graph.shortest_path(g, nodes(spark, "a"), nodes(spark, "e"))).first().asDict() == {"edges": 3, "ambiguous": False, "confidence": "high"}
    assert graph.shortest_path(g, nodes(spark, "e"), nodes(spark, "a")).count() == 0


def test_impact_states(spark):
    rows = [("b", "a", "call", "high", False, "1", 1), ("c", "b", "call", "high", False, "2", 1), ("d", "a", "call", "low", False, "3", 1), ("e", "d", "call", "high", False, "4", 1), ("a", "f", "call", "high", False, "5", 1)]
    got = {r["node"]: (r["depth"], r["reach"]) for r in graph.impact(spark.createDataFrame(rows, EDGE), nodes(spark, "a")).collect()}
    assert got == {"a": (0, "seed"), "b": (1, "direct"), "c": (2, "transitive"), "d": (1, "inferred"), "e": (2, "inferred"), "f": (1, "inferred")}


def test_pagerank_sums_to_one_and_matches_dense(spark):
    g = graph_of(spark, "a>b a>b b>c c>a c>d")
    got = {r["node"]: r["score"] for r in graph.pagerank(nodes(spark, "a", "b", "c", "d"), g).collect()}
    names = ["a", "b", "c", "d"]
    share = {("a", "b"): 1, ("b", "c"): 1, ("c", "a"): 0.5, ("c", "d"): 0.5}
    score = dict.fromkeys(names, 0.25)
    for _ in range(24):
        score = {n: 0.15 * 0.25 + 0.85 * (score["d"] * 0.25 + sum(score[s] * w for (s, t), w in share.items() if t == n)) for n in names}
    assert sum(got.values()) == pytest.approx(1) and got == pytest.approx(score)


def test_budgets_and_pages(spark):
    df = spark.createDataFrame([(k, "x" * n) for k, n in enumerate([4, 40, 4, 8])], "k int, t string")
    kept = budget.prefix_budget(df, [F.asc("k")], F.length("t"), 12)
    assert [r["k"] for r in kept.collect()] == [0, 1]
    assert sorted(r["k"] for r in budget.skip_greedy(df, [F.asc("k")], F.length("t"), 16).collect()) == [0, 2, 3]
    whole = [r["k"] for o in (0, 2) for r in budget.page(df, [F.asc("k")], o, 2).collect()]
    assert whole == [0, 1, 2, 3]
    assert budget.page_summary(4, 2, 2)["continuation"] is None
    with pytest.raises(ValueError):
        budget.page(df, [F.asc("k")], 0, 257)


SYMBOL = "path string, language string, ord int, name string, kind string, role string, evidence string, context string, visibility string, modules array<string>, line int, column int"


def sym(path, ord_, name, role="reference", evidence="call", context="", language="rust", kind="function", modules=None):
    return (path, language, ord_, name, kind, role, evidence, context, "public", modules, ord_, 1)


def test_edge_tiers(spark):
    s = spark.createDataFrame(
        [
            sym("a.rs", 0, "run", "definition", "syntax"), sym("a.rs", 1, "run"), sym("b.rs", 0, "run", "definition", "syntax"),
            sym("c.rs", 0, "run", "definition", "import", "use crate::b::run;", kind="import"), sym("c.rs", 1, "run"),
            sym("d.rs", 1, "run"), sym("e.rs", 0, "run", "definition", "import", "use other;", kind="import"), sym("e.rs", 1, "run"),
            sym("p/x.go", 0, "Go", "definition", "syntax", language="go", modules=["m"]), sym("p/y.go", 1, "Go", language="go", modules=["m"]), sym("q/z.go", 1, "Go", language="go", modules=["m"]),
        ],
        SYMBOL,
    )
    got = {(r["source"], r["target"], r["tier"]) for r in edges.resolve(s).filter("ord = 1").collect()}
    assert got == {("a.rs", "a.rs", 0), ("c.rs", "b.rs", 2), ("e.rs", "a.rs", 3), ("e.rs", "b.rs", 3), ("p/y.go", "p/x.go", 1)}
    told = edges.describe(edges.answers(edges.questions(s), s))
    assert {r["confidence"] for r in told.filter("ambiguous").collect()} == {"medium"}
    assert edges.ambiguity_findings(told).first()["candidates"] == 2
    assert told.filter("candidate_group is null").count() == 0 and told.filter("source = 'a.rs'").first()["resolution_reason"] == "same_file_explicit"


def test_imports_ask_for_other_names(spark):
    make = lambda path, name, **k: sym(path, 0, name, "definition", "syntax", **k)
    load = lambda path, name, context, language: sym(path, 5, name, "definition", "import", context, language=language, kind="import")
    s = spark.createDataFrame(
        [
            make("src/util.ts", "parse", language="typescript"), make("src/other.ts", "parse", language="typescript"),
            load("src/app.ts", "read", "import { parse as read } from './util'", "typescript"),
            make("pkg/num.py", "num", language="python"), load("app.py", "n", "import num as n", "python"),
            make("lib/net/http.lua", "http", language="lua"), load("main.lua", "client", 'local client = require("net.http")', "lua"),
            make("x/thing.py", "thing", language="python"), load("lost.py", "thing", "from nowhere import thing", "python"),
        ],
        SYMBOL,
    )
    got = {(r["source"], r["symbol"], r["target"], r["tier"]) for r in edges.resolve(s).collect()}
    assert got == {("src/app.ts", "read", "src/util.ts", 2), ("app.py", "n", "pkg/num.py", 3), ("main.lua", "client", "lib/net/http.lua", 2), ("lost.py", "thing", "x/thing.py", 3)}


def random_symbols(spark, rng, n):
    names, rows = [f"n{k}" for k in range(9)], []
    for f in range(n):
        path, lang = f"{rng.choice('abc')}/f{f}.{'go' if f % 4 == 0 else 'rs'}", "go" if f % 4 == 0 else "rust"
        mods = [rng.choice("xy")] if lang == "go" else None
        for k in range(rng.randrange(1, 8)):
            what, name = rng.randrange(4), rng.choice(names)
            if what == 0:
                rows.append(sym(path, k, name, "definition", "syntax", language=lang, modules=mods))
            elif what == 1:
                line = rng.choice([f"use crate::f{rng.randrange(n)}::{name};", f"import {rng.choice(names)} as {name}", f"use {name}"])
                rows.append(sym(path, k, name, "definition", "import", line, language=lang, kind="import", modules=mods))
            else:
                rows.append(sym(path, k, name, language=lang, modules=mods))
    return spark.createDataFrame(rows, SYMBOL)


def plain_edges(rows, most=32):
    """Every reference by itself, one loop after another."""
    import re

    def norm(v):
        v = re.sub(r"^(\./)+", "", v.strip("\"'`;,"))
        for e in edges.HINT_ENDINGS:
            while v.endswith(e):
                v = v[: -len(e)]
        return v.replace("::", "/").strip("/").lower()

    def hints_of(line):
        return sorted({h for h in (norm(p) for p in re.split(r"[\s;,()]+", line) if "::" in p or "/" in p) if h})

    def matches(path, hints):
        p = norm(path)
        up = p.rpartition("/")[0]
        for h in hints:
            m = h.rpartition("/")[0] or h
            for w in ("crate/", "self/", "super/"):
                while m.startswith(w):
                    m = m[len(w) :]
            last = h.rpartition("/")[2]
            if any(p == x or p.endswith("/" + x) for x in (h, m)) or up == last or up.endswith("/" + last):
                return True
        return False

    defs, mods = {}, {}
    for r in rows:
        mods[r["path"]] = set(r["modules"] or [])
        if r["role"] == "definition" and r["kind"] in edges.TARGET_KINDS:
            defs.setdefault((r["language"], r["name"]), set()).add(r["path"])
    imports = {}
    for r in rows:
        if r["evidence"] == "import":
            imports.setdefault(r["path"], []).append((r["name"], hints_of(r["context"])))
    out = set()
    for r in rows:
        if not (r["evidence"] == "import" or r["role"] == "reference"):
            continue
        every = defs.get((r["language"], r["name"]), set())
        if r["evidence"] == "import":
            own, words = hints_of(r["context"]), re.findall(r"\w+", r["context"])
            names = {r["name"], *(a for a, b in zip(words, words[1:]) if b == "as"), *(b for a, b in zip(words, words[1:]) if a == "import"), *(h.rpartition("/")[2] for h in own)}
            pool = {p for n in names for p in defs.get((r["language"], n), ()) if not own or matches(p, own)}
            every = pool or every
        here = imports.get(r["path"], [])
        folder = lambda p: p.rpartition("/")[0]
        same = {p for p in every if r["language"] == "go" and p != r["path"] and folder(p) == folder(r["path"]) and mods[p] & mods[r["path"]]}
        far = {p for p in every if any(matches(p, h) for _, h in here)}
        if r["path"] in every:
            tier, got = 0, {r["path"]}
        elif same:
            tier, got = 1, same
        elif far:
            tier, got = 2, far
        elif any(n == r["name"] for n, _ in here):
            tier, got = 3, every
        else:
            continue
        got = sorted(got)[:most]
        out |= {(r["path"], r["ord"], r["name"], t, tier, len(got)) for t in got}
    return out


def test_edges_against_plain_loops_and_updates(spark):
    import random

    rng = random.Random(4)
    s = random_symbols(spark, rng, 40)
    rows = s.collect()
    for most in (32, 2):
        got = {(r["source"], r["ord"], r["symbol"], r["target"], r["tier"], r["n_candidates"]) for r in edges.resolve(s, most).collect()}
        assert got == plain_edges(rows, most) and {t for *_, t, _ in got} == {0, 1, 2, 3}
    after = random_symbols(spark, random.Random(9), 40).filter("path like 'a/%'").unionByName(s.filter("path not like 'a/%'"))
    changed = s.unionByName(after).filter("path like 'a/f1%'").select("path").distinct()
    now = after.join(changed, "path", "left_semi").unionByName(s.join(changed, "path", "left_anti"))
    kept, fresh = edges.update_edges(edges.resolve(s), now, changed, s)
    assert sorted(map(tuple, kept.unionByName(fresh).collect())) == sorted(map(tuple, edges.resolve(now).select(*kept.columns).collect()))
    asked, every = edges.affected_questions(now, changed, s), edges.questions(now)
    assert changed.count() < 9 and asked.count() < every.count()


def test_an_update_resolves_few_rows(spark):
    rows = [sym(f"f{k}.rs", 0, f"d{k}", "definition", "syntax") for k in range(200)] + [sym(f"f{k}.rs", 1, f"d{(k + 1) % 200}", "definition", "import", f"use d{(k + 1) % 200}", kind="import") for k in range(200)] + [sym(f"f{k}.rs", 2, f"d{(k + 1) % 200}") for k in range(200)]
    s = spark.createDataFrame(rows, SYMBOL)
    changed = spark.createDataFrame([("f7.rs",)], "path string")
    asked = edges.affected_questions(s, changed)
    assert sorted({r["source"] for r in asked.collect()}) == ["f6.rs", "f7.rs"]
    assert {r["path"] for r in edges.affected_files(s, changed).collect()} == {"f6.rs", "f7.rs"}
    assert edges.asked_symbols(s, asked).count() == 7


def test_query_modes_and_files(spark):
    f = spark.createDataFrame([("a/parser.rs", "rust", "a", "fn parse() {}"), ("b/x.rs", "rust", "b", "calls PARSE here"), ("tests/t.rs", "rust", ".", "nothing")], "path string, language string, project_root string, text string")
    s = spark.createDataFrame([("b/x.rs", "parse_all", 1, 1, "function", "definition", "fn parse_all")], "path string, name string, line int, column int, kind string, role string, context string")
    got = {(r["target"], r["path"]) for r in search.query(f, s, search.Filters(text="parse")).collect()}
    assert got == {("symbol", "b/x.rs"), ("file", "a/parser.rs")}
    assert search.query(f, s, search.Filters()).count() == 3
    assert search.query(f, s, search.Filters(tests="only")).first()["path"] == "tests/t.rs"
    assert search.query(f, s, search.Filters(project="a", mode="exact")).count() == 1
    changed = spark.createDataFrame([("a",)], "path string")
    assert [r["path"] for r in search.query(f, s, search.Filters(changed="a", mode="exact"), changed).collect()] == ["a/parser.rs"]
    assert search.query(f, s, search.Filters(symbol="parse_all", mode="exact")).first()["confidence"] == "high"
    what = search.Filters(text="parse")
    lost = spark.createDataFrame([("z/parse.c", "."), ("z/other.c", "."), ("a/parser.rs", "a")], "path string, project_root string")
    more = search.with_omissions(search.query(f, s, what), what, lost, f)
    assert [(r["path"], r["score"], r["confidence"]) for r in more.filter("partial").collect()] == [("z/parse.c", search.OMISSION_SCORE, "medium")]
    with pytest.raises(ValueError):
        search.search_request("a", "b")


def test_changed_range(spark):
    def span(a, b):
        return spark.range(1).select(changes.changed_range(F.array(*map(F.lit, a)), F.array(*map(F.lit, b))).alias("x")).first()["x"]

    assert tuple(span("abc", "axc")) == (2, 2)
    assert tuple(span("abc", "abxyc")) == (3, 4)
    assert tuple(span("abc", "ac")) == (2, 2)
    assert span("abc", "abc") is None
    assert tuple(span("aa", "aaa")) == (3, 3)


def test_snapshot_and_retention(spark):
    a = spark.createDataFrame([("x",), ("y",)], "fact string")
    b = spark.createDataFrame([("y",), ("z",)], "fact string")
    assert {tuple(r) for r in changes.snapshot_check(a, b).collect()} == {("new", "x"), ("gone", "z")}


def test_trigrams(spark, tmp_path):
    texts = {"a": "abcabc", "b": "xabCab", "c": "ab", "d": "bcab", "e": None, "f": "aaaaab", "g": "ébcÉab", "h": "abc-bca-cab"}
    f = spark.createDataFrame(list(texts.items()), "path string, text string")
    ix = index.postings(f)
    gram = lambda t: int.from_bytes(t.encode(), "big")
    assert ix.filter(f"path = 'a' and trigram = {gram('abc')}").first()["positions"] == [0, 3]
    assert ix.filter(f"path = 'f' and trigram = {gram('aaa')}").first()["positions"] == [0, 1, 1]
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    for q in ("ABCA", "ab", "bcab", "aaab", "aaaa", "bc\u00c9a", "abcab", "nothing", ""):
        want = sorted(p for p, t in texts.items() if t and len(q.encode()) > 2 and lower(q) in lower(t))
        assert sorted(r["path"] for r in index.find_in_postings(ix, q).collect()) == want, q


def test_stored_trigrams_rewrite_touched_buckets_only(spark, tmp_path):
    f = spark.createDataFrame([(f"p{k}", f"text {k} of many words {k * 7919}") for k in range(50)] + [("q", "zzz yyy")], "path string, text string")
    ix = index.StoredIndex(spark, str(tmp_path / "ix"), buckets=256)
    made = ix.create(f)
    find = lambda q: sorted(r["path"] for r in ix.search(q).collect())
    assert len(find("many WORDS")) == 50 and find("zz y") == ["q"]
    old, new = ({g % 256 for g in index._grams(t).tolist()} for t in ("zzz yyy", "zzz xxx"))
    touched = ix.update(spark.createDataFrame([("q", "zzz xxx")], "path string, text string"))
    assert set(touched) == old | new and len(touched) < len(made) / 5
    assert find("zz y") == [] and find("zz x") == ["q"] and len(find("many words")) == 50
    gone = spark.createDataFrame([("q",), ("p3",)], "path string")
    ix.update(f.limit(0), gone)
    assert find("zzz") == [] and len(find("many words")) == 49
    assert {r["path"] for r in ix.table.read().select("path").distinct().collect()} == {f"p{k}" for k in range(50) if k != 3}
    counts = {r["trigram"]: r["files"] for r in index.trigram_counts(f).collect()}
    assert counts["7a7a7a"] == 1 and counts["657874"] == 50


def test_pruned_diff_meets_changed_folders_only(spark):
    rng = random.Random(2)
    tree = {f"d{rng.randrange(8)}/e{rng.randrange(8)}/f{rng.randrange(4)}/x{k}": str(k) for k in range(600)} | {"top": "1", "a": "file", "b/c": "2"}
    after = dict(tree)
    after["top"] = "other"
    del after["a"]
    after["a/now/a/folder"] = "3"
    del after["b/c"]
    gone, changed = sorted(tree)[40], sorted(tree)[300]
    del after[gone]
    after[changed] = "new"
    one = lambda t: changes.tree_entries(spark.createDataFrame(list(t.items()), "path string, oid string"))
    met = []
    got = {(r["path"], r["kind"], r["before_oid"], r["after_oid"]) for r in changes.pruned_diff(one(tree), one(after), met).collect()}
    want = {(p, "added" if p not in tree else "deleted" if p not in after else "modified", tree.get(p), after.get(p)) for p in tree.keys() | after.keys() if tree.get(p) != after.get(p)}
    assert got == want and sum(met) < 100
    assert changes.pruned_diff(one(tree), one(tree)).count() == 0


def test_topology(spark):
    f = spark.createDataFrame([("package.json", "tracked"), ("a/Cargo.toml", "tracked"), ("a/go.mod", "modified"), ("a/src/x.rs", "tracked"), ("README.md", "untracked"), ("a/tests/t.rs", "modified")], "path string, worktree_state string")
    roles = spark.createDataFrame([("package.json", "workspace")], "path string, role string")
    assert {(r["path"], r["kind"]) for r in topology.project_roots(f, roles).collect()} == {(".", "workspace"), ("a", "mixed")}
    marks = [(r["kind"], r["path"]) for r in topology.landmarks(f).collect()]
    assert marks[0] == ("readme", "README.md") and ("test_root", "a/tests") in marks
    rooted = {r["path"]: r["project_root"] for r in topology.deepest_root(f, topology.project_roots(f)).collect()}
    assert rooted["a/src/x.rs"] == "a" and rooted["README.md"] == "."


def test_snippets_spread():
    base = {"kind": "function", "name": "f", "scope": [], "line": 1, "column": 1, "end_line": 1, "end_column": 9, "project_root": ".", "language": "rust", "partial": False, "generated": False, "task_relevant": False, "context": "fn f()"}
    rows = [{**base, "path": p, "role": r, "subsystem": s, "score": n} for p, r, s, n in [("a", "source", "x", 900), ("b", "source", "x", 890), ("c", "source", "y", 400), ("d", "test", "x", 1)]]
    # The bonus of a role decides first; then "y" is new while "x" costs a third.
    assert [x["path"] for x in ranking.choose_snippets(rows, 1000)] == ["d", "c", "a", "b"]
    assert ranking.choose_snippets(rows, 5) == []
    long = [{**base, "path": "a", "role": "source", "subsystem": "x", "score": 1, "context": "y" * 400}]
    (cut,) = ranking.choose_snippets(long, 20)
    assert cut["truncated"] and cut["cost"] == 20 and cut["context"].endswith("y…")
    assert ranking.fit_snippet(long[0], 6) is None


def test_manifests_and_symbols(spark):
    text = {"package.json": '{"name":"n","main":"./index.js","bin":{"t":"cli.js"},"workspaces":["a"]}', "index.js": "export function go() { run(1) }", "m.py": "import os\nclass A:\n    def f(self):\n        return g()\n", "bad.py": "def ("}
    f = spark.createDataFrame([(p, t, {"js": "javascript", "py": "python"}.get(p.rsplit(".")[-1])) for p, t in text.items()], "path string, text string, language string")
    got = {(r["kind"], r["name"], r["resolved_path"]) for r in sources.manifests(f).collect()}
    assert ("library_export", "main", "index.js") in got and ("role", "workspace", None) in got and ("entry_point", "t", None) in got
    s = {(r["path"], r["name"], r["kind"], r["role"], tuple(r["scope"])) for r in sources.extract_symbols(f).collect()}
    assert ("m.py", "f", "method", "definition", ("A",)) in s and ("m.py", "g", "identifier", "reference", ("A", "f")) in s
    assert ("index.js", "go", "function", "definition", ()) in s and ("index.js", "run", "identifier", "reference", ("go",)) in s
    assert not any(x[0] == "bad.py" for x in s)


def test_reports(spark):
    f = spark.createDataFrame([("src/main.rs", "rust", ".", "tracked", "analyzed", "fn main"), ("tests/a.rs", "rust", ".", "tracked", "partial", "t"), ("README.md", None, ".", "tracked", "analyzed", "r")], "path string, language string, project_root string, worktree_state string, status string, text string")
    s = spark.createDataFrame([sym("src/main.rs", 0, "go", "definition", "syntax"), sym("tests/a.rs", 0, "go", "definition", "import", "use main;", kind="import"), sym("tests/a.rs", 1, "go")], SYMBOL)
    c = spark.createDataFrame([("1", "fix bug", "A", "a@x", 100, 100, False)], "id string, message string, author_name string, author_email string, author_seconds long, committer_seconds long, is_merge boolean")
    p = spark.createDataFrame([("1", "src/main.rs")], "id string, path string")
    facts = reports.Facts(f, s, edges.describe(edges.answers(edges.questions(s), s)), c, p, now=200)
    plan = reports.reading_plan(facts)
    assert plan[0]["purpose"] == "start_here" and plan[0]["path"] in ("README.md", "tests")
    assert len({x["path"] for x in plan}) == len(plan)
    hit = reports.impact_report(facts, f.filter("path = 'src/main.rs'").select("path"))
    assert [r["path"] for r in hit["tests"].collect()] == ["tests/a.rs"]
    assert reports.orient(facts)["inventory"]["tracked"] == 3
    assert reports.review_facts(facts).count() > 3
    assert {r["issue"] for r in reports.quality_issues(facts).collect()} == {"partial_files"}
    assert reports.context(facts, "go").count() > 0
    sections, said = reports.task_context(facts, 600, spark.createDataFrame([("dist/x.js", "classified")], "path string, reason string"))
    assert [r["path"] for r in sections["uncertainty"].collect()] == ["tests/a.rs"] and sections["relationships"].count() == 1 and sections["omissions"].count() == 1
    assert {r["path"] for r in sections["relevant_tests"].collect()} == {"tests/a.rs"} and not any(r["truncated"] for r in said.collect())
    few = {r["name"]: r["returned"] for r in reports.task_context(facts, 70)[1].collect()}
    assert few["uncertainty"] == 1 and few["files"] + few["next_reads"] < 3
    assert reports.explain(facts, "src/main.rs")["definitions"].count() == 1
    assert reports.map_report(facts)["summaries"].count() == 7
    assert reports.history_report(facts, ["bug"], ["hotfix"])["bugs"].first()["path"] == "src/main.rs"
    assert reports.markdown("T", {"s": [{"a": "x" * 500}] * 20}, 200).endswith("budget._\n")
    with pytest.raises(ValueError):
        reports.dispatch("nothing")


def test_history_identity(spark):
    c = spark.createDataFrame([("1", "A", "a@x"), ("2", "B", "A@X"), ("3", "C", "")], "id string, author_name string, author_email string")
    c = c.select("*", F.lit("m").alias("message"), F.col("id").cast("long").alias("author_seconds"), F.col("id").cast("long").alias("committer_seconds"), F.lit(False).alias("is_merge"))
    got = {(r["name"], r["commits"], r["share"]) for r in history.contributors(c).collect()}
    assert got == {("B", 2, 66), ("C", 1, 33)}
