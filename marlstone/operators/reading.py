"""A plan of what to read first: reasons to read each file, and a few files that no two reasons share.

Reasons are rows with a purpose, a path and a score; those of one purpose and
path add up.  Picks are made over ranked rows: first the best of each
purpose, then a manifest of the whole tree, then the best of each project root, every path once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.paths import ancestors
from marlstone.operators import budget, graph, topology

#: Purposes in the order of a plan, and how many files it has (fixed values).
PURPOSES = ["start_here", "architecture", "runtime", "tests", "supporting_context"]
MOST_PICKS, LEAST_PICKS = 5, 3
#: What a landmark of a kind is read for, its base score and how sure that is; a point of priority or a focus match adds a million (fixed values).
LANDMARK_REASONS = {
    "agent_instructions": ("start_here", 3_000_000_000, "high"), "contributor_instructions": ("start_here", 3_000_000_000, "high"), "readme": ("start_here", 3_000_000_000, "high"), "manifest": ("start_here", 3_000_000_000, "high"),
    "build_entry_point": ("runtime", 2_500_000_000, "high"), "task_entry_point": ("runtime", 2_500_000_000, "high"),
    "lockfile": ("supporting_context", 500_000_000, "medium"), "ci": ("supporting_context", 500_000_000, "medium"), "ownership": ("supporting_context", 500_000_000, "medium"), "license": ("supporting_context", 500_000_000, "medium"),
}
POINT, TOP_README = 1_000_000, 500_000
#: Files that by convention are entry points below a project root (fixed values).
LIBRARY_ENTRIES = ["src/lib.rs", "lib.rs", "src/lib.ts", "src/lib.js"]
RUNTIME_ENTRIES = [f"{d}{n}" for n in ("main.rs", "main.py", "main.rb", "main.ts", "main.js", "index.ts", "index.js", "index.tsx", "index.jsx") for d in ("src/", "")]
ENTRY, TARGET, FOCUS, TASK, TEST = 2_800_000_000, 2_900_000_000, 2_000_000_000, 3_500_000_000, 1_500_000_000
OVERLAP, FIRE, COMMIT = 600_000_000, 400_000_000, 100_000
#: A manifest of the whole tree: what it scores at least as a landmark, and what a root's manifest scores where it is none (fixed values).
TREE_MANIFEST, TREE_MANIFEST_ALONE, MANIFEST_ALONE = 3_095_250_000, 3_090_000_000, 3_000_000_000

_REASON = ["purpose", "path", "project_root", "score", "evidence", "confidence"]


def _reason(rows: DataFrame, purpose, score: Column, confidence, evidence: str) -> DataFrame:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return rows.select(lit(purpose).alias("purpose"), "path", "project_root", score.cast("long").alias("score"), F.lit(evidence).alias("evidence"), lit(confidence).alias("confidence"))


def candidates(files: DataFrame, ranks: DataFrame, links: DataFrame, landmarks: DataFrame, roots: DataFrame, churn: DataFrame, bugs: DataFrame, fire: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """``(purpose, path, project_root, score, evidence, confidence)``, one row a purpose and path.

    ``files(path)``; ``ranks(path, score)``, maybe with ``focus_matches`` and ``task_matches``; ``links(path, links)``, how many edges a
    file has; ``landmarks(path, kind, priority, focus_matches)``; ``roots(path, manifests)``; ``churn``, ``bugs`` and
    ``fire`` ``(path, commits)``; ``targets(path, kind)``, what manifests declare as ``library_export`` or ``entry_point``.
    """
    for name in ("focus_matches", "task_matches"):
        if name not in ranks.columns:
            ranks = ranks.withColumn(name, F.lit(0))
    own = topology.deepest_root(files.select("path"), roots.select("path"))
    known = own.join(ranks.select("path", F.col("score").alias("rank"), "focus_matches", "task_matches"), "path", "left").join(links.groupBy("path").agg(F.sum("links").alias("links")), "path", "left").fillna(0, ["rank", "focus_matches", "task_matches", "links"])
    below = F.when(F.coalesce("project_root", F.lit(".")) == ".", F.col("path")).otherwise(F.expr("substring(path, length(project_root) + 2)"))
    marks = landmarks.select("path", "kind", "priority", "focus_matches")
    told = F.create_map(*(x for k, (p, s, c) in LANDMARK_REASONS.items() for x in (F.lit(k), F.struct(F.lit(p).alias("p"), F.lit(s).cast("long").alias("s"), F.lit(c).alias("c")))))
    named = marks.join(own, "path").withColumn("t", told[F.col("kind")]).filter("t is not null")
    readme = F.when((F.col("kind") == "readme") & ~F.col("path").contains("/"), TOP_README).otherwise(0)
    tests = known.withColumn("dir", F.explode(ancestors(F.col("path"), with_self=False))).join(marks.filter("kind = 'test_root'").select(F.col("path").alias("dir")).distinct(), "dir")
    parts = [
        _reason(known, "architecture", F.col("rank"), F.when(F.col("links") > 0, "high").otherwise("medium"), "source_map"),
        _reason(known.filter("links > 0"), "architecture", F.lit(0), "high", "graph"),
        _reason(known.filter(below.isin(LIBRARY_ENTRIES)), "architecture", F.lit(ENTRY), "high", "project_topology"),
        _reason(known.filter(below.isin(RUNTIME_ENTRIES)), "runtime", F.lit(ENTRY), "high", "project_topology"),
        _reason(known.filter("focus_matches > 0"), "architecture", FOCUS + F.col("focus_matches") * POINT, "high", "focus"),
        _reason(known.filter("task_matches > 0"), "architecture", TASK + F.col("rank"), "high", "source_map"),
        _reason(named, F.col("t.p"), F.col("t.s") + (F.col("priority") + F.col("focus_matches")) * POINT + readme, F.col("t.c"), "landmark"),
        _reason(named.filter("focus_matches > 0"), F.col("t.p"), FOCUS + F.col("focus_matches") * POINT, "high", "focus"),
        _reason(tests, "tests", TEST + F.col("rank"), "high", "landmark"),
        *(_reason(own.join(rows, "path"), "supporting_context", base + F.col("commits") * COMMIT, "medium", "history_overlap") for rows, base in ((churn, OVERLAP), (bugs, OVERLAP), (fire, FIRE))),
    ]
    if targets is not None:
        purpose = F.when(F.col("kind") == "library_export", "architecture").otherwise("runtime")
        parts.append(_reason(own.join(targets, "path"), purpose, F.lit(TARGET), "high", "project_topology"))
    every = reduce(DataFrame.unionByName, parts)
    surest = F.min_by("confidence", graph.confidence_rank(F.col("confidence")))
    merged = every.groupBy("purpose", "path").agg(F.min("project_root").alias("project_root"), F.sum("score").alias("score"), F.array_sort(F.collect_set("evidence")).alias("evidence"), surest.alias("confidence"))
    manifests = roots.select(F.col("path").alias("root"), F.explode("manifests").alias("path")).withColumn("purpose", F.lit("start_here"))
    both = merged.join(manifests, ["purpose", "path"], "full_outer")
    tree = F.col("root") == "."
    score = F.when(F.col("score").isNull(), F.when(tree, TREE_MANIFEST_ALONE).otherwise(MANIFEST_ALONE)).when(tree, F.greatest("score", F.lit(TREE_MANIFEST))).otherwise(F.col("score"))
    return both.select("purpose", "path", F.coalesce("project_root", "root").alias("project_root"), score.cast("long").alias("score"), F.coalesce("evidence", F.array(F.lit("landmark"))).alias("evidence"), F.coalesce("confidence", F.lit("high")).alias("confidence"))


def _best() -> list[Column]:
    return [F.desc("score"), F.asc(graph.confidence_rank(F.col("confidence"))), F.asc("path")]


def plan(found: DataFrame, roots: DataFrame, picks: int = MOST_PICKS) -> list[dict]:
    """Up to ``picks`` of ``candidates``, each path once, in order of purpose, score and path.

    The driver sees the best few of each purpose and of the first project roots: a bounded number of rows.
    """
    if not 1 <= picks <= MOST_PICKS:
        raise ValueError(f"a plan has one to {MOST_PICKS} picks")
    rank = lambda r: (-r["score"], {"high": 0, "medium": 1, "low": 2}[r["confidence"]], r["path"])
    first = budget.top_per_key(found, ["purpose"], _best(), MOST_PICKS).collect()
    out: list = []

    def take(rows) -> None:
        rest = sorted((r for r in rows if r["path"] not in {o["path"] for o in out}), key=rank)
        if rest and len(out) < picks:
            out.append(rest[0])

    for purpose in PURPOSES:
        take([r for r in first if r["purpose"] == purpose])
    if len(out) < picks:
        tree = roots.filter("path = '.'").select(F.element_at("manifests", 1).alias("path")).first()
        if tree is not None:
            take(found.filter((F.col("purpose") == "start_here") & (F.col("path") == tree["path"])).collect())
        # A root whose best few are all taken gives none, so so many roots are enough.
        some = found.select(F.col("project_root")).join(roots.select(F.col("path").alias("project_root")), "project_root", "left_semi").distinct().orderBy("project_root").limit(2 * MOST_PICKS)
        near = budget.top_per_key(found.join(F.broadcast(some), "project_root", "left_semi"), ["project_root"], _best(), 3 * MOST_PICKS).collect()
        for root in sorted({r["project_root"] for r in near}):
            take([r for r in near if r["project_root"] == root])
    out.sort(key=lambda r: (PURPOSES.index(r["purpose"]), -r["score"], r["path"]))
    return [{"order": k, **{c: r[c] for c in _REASON}} for k, r in enumerate(out, 1)]


def omitted_roots(found: DataFrame, roots: DataFrame, picked: list[dict]) -> DataFrame:
    """``(project_root)`` of the roots that have candidates but none in the plan."""
    taken = [p["project_root"] for p in picked if p["project_root"] is not None]
    own = found.select("project_root").join(roots.select(F.col("path").alias("project_root")), "project_root", "left_semi").distinct()
    return own.filter(~F.col("project_root").isin(taken)) if taken else own


def shortfall(found: DataFrame, picked: list[dict]) -> dict | None:
    """Why a plan has fewer than ``LEAST_PICKS`` files, if it has."""
    if len(picked) >= LEAST_PICKS:
        return None
    return {"target_minimum": LEAST_PICKS, "returned": len(picked), "candidate_paths": found.select("path").distinct().count()}
