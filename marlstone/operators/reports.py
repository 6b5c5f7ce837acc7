"""Composite reports over the logical tables: reading plans, orientation, explanation, context, impact, export, review."""

from __future__ import annotations

import json
import platform
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions.paths import ancestors, is_test_path
from marlstone.functions.stage import write_stage
from marlstone.functions.text import stable_id, token_estimate
from marlstone.operators import bounding, budget, changes, edges, graph, history, reading, search, topology

SCHEMA_VERSION = 1


@dataclass(frozen=True)
class Limits:
    """Caps of a report; each is a cut on a documented order (fixed values of the two profiles)."""

    max_files: int = 4096
    max_file_bytes: int = 1 << 20
    max_source_bytes: int = 64 << 20
    max_symbols_per_file: int = 128
    max_symbols: int = 20_000
    max_candidates: int = 32
    max_edges: int = 2_000
    max_findings: int = 2_000
    max_commits: int = 100_000
    max_history_items: int = 128
    max_output_bytes: int = 8 << 20
    max_landmarks: int = 64
    max_roots: int = 32

    @classmethod
    def profile(cls, name: str) -> Limits:
        if name == "compact":
            return cls()
        if name == "evidence":
            return cls(max_symbols_per_file=2048, max_symbols=100_000, max_edges=20_000, max_findings=20_000, max_history_items=2_000, max_landmarks=4096, max_roots=1024)
        raise ValueError(f"no profile {name}")


@dataclass
class Facts:
    """The logical tables of one snapshot; all lazy."""

    files: DataFrame
    symbols: DataFrame
    edges: DataFrame
    commits: DataFrame
    commit_paths: DataFrame
    now: int
    days: int = 365
    bug_words: tuple[str, ...] = ("fix", "bug", "broken")
    fire_words: tuple[str, ...] = ("revert", "hotfix", "emergency", "rollback")

    def churn(self) -> DataFrame:
        return history.churn(self.commits, self.commit_paths, self.now, self.days)

    def ranking(self) -> DataFrame:
        """``(path, score)`` by centrality over the lexical edges."""
        weighted = self.edges.select(F.col("source").alias("src"), F.col("target").alias("dst"), edges.edge_weight(F.col("symbol"), F.col("confidence"), F.col("target_visibility")).alias("weight"))
        ranks = graph.pagerank(self.files.select(F.col("path").alias("node")), weighted)
        return ranks.select(F.col("node").alias("path"), graph.scaled_score(F.col("score")).alias("score"))


def map_report(f: Facts, limits: Limits = Limits()) -> dict[str, DataFrame]:
    """The facts of a snapshot within a profile's caps, with a summary row for each collection."""
    ranks = f.ranking()
    out = {
        "files": budget.first_rows(f.files.drop("text"), [F.asc("path")], limits.max_files),
        "symbols": bounded_symbols(f.symbols, limits.max_symbols_per_file, limits.max_symbols),
        "edges": budget.first_rows(f.edges, [F.asc("source"), F.asc("symbol"), F.asc("target")], limits.max_edges),
        "findings": budget.first_rows(edges.ambiguity_findings(f.edges), [F.asc("candidate_group")], limits.max_findings),
        "ranking": budget.first_rows(ranks, [F.desc("score"), F.asc("path")], limits.max_files),
        "landmarks": topology.landmarks(f.files, most=limits.max_landmarks),
        "project_roots": budget.first_rows(topology.project_roots(f.files), [F.asc("path")], limits.max_roots),
    }
    caps = {"files": (f.files, limits.max_files), "symbols": (f.symbols, limits.max_symbols), "edges": (f.edges, limits.max_edges), "findings": (edges.ambiguity_findings(f.edges), limits.max_findings), "ranking": (f.files, limits.max_files), "landmarks": (topology.landmarks(f.files), limits.max_landmarks), "project_roots": (topology.project_roots(f.files), limits.max_roots)}
    summaries = None
    for name, (df, cap) in caps.items():
        one = budget.collection_summary(df, cap).withColumn("collection", F.lit(name))
        summaries = one if summaries is None else summaries.unionByName(one)
    out["summaries"] = summaries
    return out


def history_report(f: Facts, bug_words: list[str], fire_words: list[str]) -> dict[str, DataFrame]:
    churned = f.churn()
    bugs = history.keyword_paths(f.commits, f.commit_paths, bug_words, f.now, f.days)
    both = history.overlap(bugs, churned)
    everyone, recent = history.contributors(f.commits), history.contributors(f.commits, f.now, f.days)
    return {
        "churn": churned.orderBy(F.desc("commits"), "path"),
        "contributors": everyone.orderBy(F.desc("commits"), F.asc_nulls_first("email"), "name"),
        "contributors_recent": recent.orderBy(F.desc("commits"), F.asc_nulls_first("email"), "name"),
        "bugs": bugs.orderBy(F.desc("commits"), "path"),
        "bug_overlap": both.orderBy(F.desc("commits"), "path"),
        "activity": history.activity(f.commits).orderBy("month"),
        "firefighting": history.keyword_commits(f.commits, fire_words, f.now, f.days).orderBy(F.desc("committer_seconds"), "id"),
        "span": history.history_span(f.commits),
        "observations": history.observations(churned, everyone, recent, both, bugs, f.commits, history.keyword_commits(f.commits, fire_words, f.now, f.days), f.commit_paths),
    }


#: How much of each collection a compact map shows (fixed values).
COMPACT = {"files": 32, "symbols_per_file": 16, "symbols": 128, "omissions": 8, "findings": 32, "edges": 32, "ranking": 16, "landmarks": 48, "project_roots": 16}


def bounded_symbols(symbols: DataFrame, per_file: int, total: int) -> DataFrame:
    """The first symbols of each file, and of those the first in all, by path and place."""
    return budget.first_rows(budget.top_per_key(symbols, ["path"], [F.asc("ord")], per_file), [F.asc("path"), F.asc("ord")], total)


def compact_map(report: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """A map report cut to what its compact form shows, each collection in its own order; the summaries stay those of the whole."""
    order = {"files": ["path"], "edges": ["source", "symbol", "target"], "findings": ["candidate_group"], "ranking": [F.desc("score"), "path"], "landmarks": [F.desc("priority"), F.desc("focus_matches"), "path", "kind"], "project_roots": ["path"]}
    out = {k: budget.first_rows(report[k], by, COMPACT[k]) for k, by in order.items()}
    shown = report["symbols"].join(out["files"].select("path"), "path", "left_semi")
    return {**report, **out, "symbols": bounded_symbols(shown, COMPACT["symbols_per_file"], COMPACT["symbols"])}


def merged_reading(rows: DataFrame) -> DataFrame:
    """One row a purpose and path of ``rows(purpose, path, score, evidence, confidence)``: scores add up, evidence is gathered, the surest confidence stands."""
    surest = F.min_by("confidence", graph.confidence_rank(F.col("confidence")))
    return rows.groupBy("purpose", "path").agg(F.sum("score").alias("score"), F.array_sort(F.collect_set("evidence")).alias("evidence"), surest.alias("confidence"))


def reading_candidates(f: Facts, ranks: DataFrame | None = None) -> DataFrame:
    """Reasons to read each file of a snapshot, by purpose."""
    ranks = f.ranking() if ranks is None else ranks
    ends = f.edges.select(F.col("source").alias("path")).unionByName(f.edges.select(F.col("target").alias("path")))
    links = ends.groupBy("path").agg(F.count("*").alias("links"))
    churned = f.churn()
    bugs = history.overlap(history.keyword_paths(f.commits, f.commit_paths, f.bug_words, f.now, f.days), churned)
    fire = f.commit_paths.join(history.keyword_commits(f.commits, f.fire_words, f.now, f.days).select("id"), "id").groupBy("path").agg(F.count("*").alias("commits"))
    return reading.candidates(f.files, ranks, links, topology.landmarks(f.files), topology.project_roots(f.files), churned, bugs, fire)


def reading_plan(f: Facts, picks: int = reading.MOST_PICKS, ranks: DataFrame | None = None) -> list[dict]:
    """Up to ``picks`` files in order of purpose, each once."""
    found, _ = write_stage(reading_candidates(f, ranks), "reading")
    return reading.plan(found, topology.project_roots(f.files), picks)


def orient(f: Facts) -> dict:
    """A first look: inventory, main languages, project roots and the reading plan."""
    return {
        "schema": SCHEMA_VERSION,
        "inventory": topology.inventory(f.files).first().asDict(),
        "languages": [r.asDict() for r in topology.primary_languages(f.files).collect()],
        "project_roots": [r.asDict() for r in budget.first_rows(topology.project_roots(f.files), [F.asc("path")], 16).collect()],
        "reading_plan": reading_plan(f),
    }


def explain(f: Facts, target: str) -> dict[str, DataFrame]:
    """What is known of a file, symbol or folder: its definitions, neighbours, history and place in the ranking."""
    anchors = graph.resolve_anchor(f.files, f.symbols if "scope" in f.symbols.columns else f.symbols.withColumn("scope", F.array().cast("array<string>")), target)
    at = anchors.select(F.col("node").alias("path"))
    own = f.edges.join(at.withColumnRenamed("path", "source"), "source", "left_semi")
    back = f.edges.join(at.withColumnRenamed("path", "target"), "target", "left_semi")
    return {
        "files": f.files.drop("text").join(at, "path", "left_semi"),
        "definitions": f.symbols.filter("role = 'definition'").join(at, "path", "left_semi"),
        "outgoing": own.groupBy("target").agg(F.count("*").alias("edges")).orderBy(F.desc("edges"), "target"),
        "incoming": back.groupBy("source").agg(F.count("*").alias("edges")).orderBy(F.desc("edges"), "source"),
        "churn": f.churn().join(at, "path", "left_semi"),
        "degree": edges.degrees(own.unionByName(back).distinct()).join(at.withColumnRenamed("path", "node"), "node", "left_semi"),
    }


def context(f: Facts, text: str, tokens: int = 1_000) -> DataFrame:
    """Search results for a task that fit a token budget, taken in order and passing over those that don't."""
    found = search.query(f.files, f.symbols, search.Filters(text=text))
    row = F.to_json(F.struct("target", "path", "name", "line"))
    return budget.skip_greedy(found, search.result_order(), token_estimate(row), tokens)


#: Items of small sections of a task's context at most (fixed values).
CONTEXT_RISKS, CONTEXT_UNCERTAINTIES, CONTEXT_OMISSIONS = 4, 4, 8


def task_context(f: Facts, tokens: int = 1_000, omissions: DataFrame | None = None, ranks: DataFrame | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """``(sections, summary)`` of what a task needs, under one token budget that sections take from in their order.

    What is uncertain and risky first, then the files of the reading plan, the tests among them, the relations that touch
    them, what the history says, what was left out (``omissions(path, reason)``), and plan files that did not fit.
    """
    spark = f.files.sparkSession
    plan = [(p["order"], p["purpose"], p["path"], p["score"], p["confidence"]) for p in reading_plan(f, ranks=ranks)]
    picks = spark.createDataFrame(plan, "order int, purpose string, path string, score long, confidence string")
    partial = f.files.filter(F.col("status") != "analyzed").select(F.lit("partial_file").alias("kind"), "path")
    risks = edges.ambiguity_findings(f.edges).select("candidate_group", "source", "symbol")
    said = history_report(f, list(f.bug_words), list(f.fire_words))["observations"].select("kind", "paths", "detail", "value", "of")
    left_out = spark.createDataFrame([], "path string, reason string") if omissions is None else omissions.select("path", "reason")

    def touching(kept: dict[str, DataFrame]) -> DataFrame:
        own = F.broadcast(kept["files"].select(F.col("path").alias("own")).distinct())  # a plan's files
        return f.edges.select("source", "target", "symbol", "confidence").distinct().join(own, (F.col("source") == F.col("own")) | (F.col("target") == F.col("own")), "left_semi")

    def section(name: str, rows, columns: list[str], order: list) -> bounding.Collection:
        return bounding.Collection(name, rows, order, bounding.json_chars(*columns))

    shown = ["order", "purpose", "path", "score", "confidence"]
    return bounding.fill_sections([
        section("uncertainty", budget.first_rows(partial, [F.asc("path")], CONTEXT_UNCERTAINTIES), ["kind", "path"], [F.asc("path")]),
        section("risks", budget.first_rows(risks, [F.asc("candidate_group")], CONTEXT_RISKS), ["candidate_group", "source", "symbol"], [F.asc("candidate_group")]),
        section("files", picks, shown, [F.asc("order")]),
        section("relevant_tests", lambda kept: kept["files"].filter("purpose = 'tests'").select("path", "confidence"), ["path", "confidence"], [F.asc("path")]),
        section("relationships", touching, ["source", "target", "symbol", "confidence"], [F.asc("source"), F.asc("symbol"), F.asc("target"), F.asc("confidence")]),
        section("history", said, ["kind", "paths", "detail", "value", "of"], [F.asc("kind")]),
        section("omissions", budget.first_rows(left_out, [F.asc("path")], CONTEXT_OMISSIONS), ["path", "reason"], [F.asc("path"), F.asc("reason")]),
        section("next_reads", lambda kept: picks.join(kept["files"].select("path"), "path", "left_anti").select(*shown), shown, [F.asc("order")]),
    ], tokens)


REACH_RANK = {"direct": 3, "transitive": 2, "inferred": 1}
#: What a test of the changed project scores, by its place alone (fixed value).
LIKELY_TEST = 1_000_000_000
TESTS_MOST = 16


def likely_tests(files: DataFrame, changed: DataFrame, test_roots: DataFrame, project_roots: DataFrame) -> DataFrame:
    """``(path, project_root)`` of files in a test root whose project holds a changed path: equi-joins on ancestors and roots."""
    roots = test_roots.select(F.col("path").alias("__at"))
    inside = files.select("path").withColumn("__at", F.explode(ancestors(F.col("path")))).join(roots, "__at", "left_semi").select("path").distinct()
    placed = topology.deepest_root(inside, project_roots)
    theirs = topology.deepest_root(changed.select("path").distinct(), project_roots).select(F.col("project_root").alias("__root")).distinct()
    return placed.join(theirs, F.col("project_root").eqNullSafe(F.col("__root")), "left_semi")


def merged_targets(rows: DataFrame) -> DataFrame:
    """One row a path of ``rows(path, score, reach, depth, evidence, reason, confidence)``.

    The greatest score, and the reach and depth of the row that has it (then the
    stronger reach, then the smaller depth); all evidence and reasons; confidence is
    medium, or low where any row's is.
    """
    rank = F.element_at(F.create_map(*(x for k, v in REACH_RANK.items() for x in (F.lit(k), F.lit(v)))), F.col("reach"))
    best = F.max_by(F.struct("reach", "depth"), F.struct("score", rank.alias("r"), (-F.col("depth")).alias("d")))
    grouped = rows.groupBy("path").agg(F.max("score").alias("score"), best.alias("b"), F.array_sort(F.collect_set("evidence")).alias("evidence"), F.array_sort(F.collect_set("reason")).alias("reasons"), F.bool_or(F.col("confidence") == "low").alias("low"))
    return grouped.select("path", "score", "b.reach", "b.depth", F.when(F.col("low"), "low").otherwise("medium").alias("confidence"), "evidence", "reasons")


def top_tests(rows: DataFrame, most: int = TESTS_MOST) -> DataFrame:
    """The ``most`` best-scored of ``rows(path, score)``, each path by its greatest score, then by path."""
    return budget.first_rows(rows.groupBy("path").agg(F.max("score").alias("score")), [F.desc("score"), F.asc("path")], most)


def impact_projects(targets: DataFrame) -> DataFrame:
    """``(project_root, score, paths, tests)`` of targets with their project."""
    test = F.when(is_test_path(F.col("path")), F.col("path"))
    return targets.groupBy("project_root").agg(F.max("score").alias("score"), F.array_sort(F.collect_set("path")).alias("paths"), F.array_sort(F.collect_set(test)).alias("tests"))


def impact_report(f: Facts, changed: DataFrame, depth: int = graph.IMPACT_DEPTH, ranks: DataFrame | None = None) -> dict[str, DataFrame | dict]:
    """What depends on changed files, with projects and tests by priority, and what limited the walk."""
    links = f.edges.select(F.col("source").alias("src"), F.col("target").alias("dst"), F.lit("reference").alias("kind"), "confidence", "ambiguous", F.concat_ws(":", "source", "target", "symbol").alias("id"))
    walked = graph.impact_walk(links, changed.select(F.col("path").alias("node")), depth)
    roots = topology.project_roots(f.files)
    marks = topology.landmarks(f.files).filter("kind = 'test_root'")
    met = walked.nodes.filter("depth > 0").select(F.col("node").alias("path"), graph.impact_priority(F.col("reach"), F.col("depth")).alias("score"), "reach", "depth", F.lit("graph").alias("evidence"), F.concat(F.lit("reached by "), "reach", F.lit(" relations")).alias("reason"), F.when(F.col("reach") == "inferred", "low").otherwise("medium").alias("confidence"))
    near = likely_tests(f.files, changed, marks, roots).select("path", F.lit(LIKELY_TEST).cast("long").alias("score"), F.lit("inferred").alias("reach"), F.lit(0).alias("depth"), F.lit("structural").alias("evidence"), F.lit("in a test root of the changed project").alias("reason"), F.lit("low").alias("confidence"))
    rows = met.unionByName(near)
    if ranks is not None:
        rows = rows.join(ranks.select("path", F.col("score").alias("__rank")), "path", "left").withColumn("score", F.col("score") + F.coalesce("__rank", F.lit(0))).drop("__rank")
    targets = merged_targets(rows).join(f.files.select("path", "project_root"), "path", "left")
    tests = met.filter(is_test_path(F.col("path"))).select("path", "score").unionByName(near.select("path", "score"))
    return {
        "targets": targets.orderBy(F.desc("score"), "path"),
        "projects": impact_projects(targets).orderBy(F.desc("score"), "project_root"),
        "tests": top_tests(tests),
        "missing": changes.missing_changed(changed, f.files),
        "bounds": {"work_used": walked.work, "depth_limited": walked.depth_limited, "work_limited": walked.work_limited},
    }


def quality_issues(f: Facts) -> DataFrame:
    """``(issue, n)``: what makes the facts incomplete."""
    partial = f.files.filter(F.col("status") != "analyzed").agg(F.count("*").alias("n")).select(F.lit("partial_files").alias("issue"), "n")
    unsure = f.edges.filter("ambiguous").agg(F.count("*").alias("n")).select(F.lit("ambiguous_edges").alias("issue"), "n")
    return partial.unionByName(unsure).filter("n > 0")


def export(f: Facts, path: str, limits: Limits = Limits()) -> None:
    """Write the map and history of a snapshot as one folder of JSON tables, with ids, and a manifest row."""
    spark = f.files.sparkSession
    for name, df in map_report(f, limits).items():
        df.withColumn("id", stable_id(name, F.to_json(F.struct(*df.columns)))).write.mode("overwrite").json(f"{path}/{name}")
    f.churn().withColumn("id", stable_id("churn", F.col("path"))).write.mode("overwrite").json(f"{path}/churn")
    spark.createDataFrame([(SCHEMA_VERSION, f.now, json.dumps(asdict(limits)))], "schema int, now long, limits string").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def review_facts(f: Facts, most: int = 2_000) -> DataFrame:
    """One text a fact, distinct and sorted: what a stored snapshot is compared with."""
    parts = [
        topology.coverage(f.files).select(F.concat_ws(" ", "fact", "key", "n").alias("fact")),
        topology.project_roots(f.files).select(F.concat_ws(" ", F.lit("root"), "path", "kind").alias("fact")),
        topology.landmarks(f.files).select(F.concat_ws(" ", F.lit("landmark"), "kind", "path").alias("fact")),
        topology.cross_project(f.edges, f.files).select(F.concat_ws(" ", F.lit("dependency"), "source_project", "target_project").alias("fact")),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.distinct().orderBy("fact").limit(most)


def markdown(title: str, sections: dict[str, list[dict]], tokens: int = 1_000) -> str:
    """Bounded rows as Markdown, cut at a line within four characters a token, with a notice."""
    lines = [f"# {title}", ""]
    for name, rows in sections.items():
        lines += [f"## {name}", ""]
        lines += ["- " + ", ".join(f"{k}: {v}" for k, v in r.items()).replace("\n", " ") for r in rows] + [""]
    text = "\n".join(lines)
    if len(text) <= tokens * 4:
        return text
    notice = "\n_Cut to the token budget._\n"
    return text[: max(0, tokens * 4 - len(notice))].rpartition("\n")[0] + notice


def capabilities() -> dict:
    """The operations and tables of this engine."""
    return {"schema": SCHEMA_VERSION, "operations": ["orient", "map", "history", "search", "query", "relationships", "traverse", "explain", "context", "impact", "export", "review"], "edge_kinds": ["dependency", "import", "reference", "type_reference", "call"], "match_modes": ["exact", "prefix", "substring"]}


def doctor(spark: SparkSession) -> list[dict]:
    """Checks of the session that reports run in."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    return [
        {"check": "python", "ok": True, "detail": platform.python_version()},
        {"check": "spark", "ok": True, "detail": spark.version},
        {"check": "time_zone", "ok": zone == "UTC", "detail": zone},
        {"check": "shared_folder", "ok": bool(spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")), "detail": "spark.checkpoint.dir"},
    ]


#: What a host's events ask for (fixed values).
LIFECYCLE = {"repository_open": "orient", "session_start": "orient", "task_change": "context", "before_edit": "context", "after_edit": "context", "before_review": "impact"}


def dispatch(event: str) -> str:
    if event not in LIFECYCLE:
        raise ValueError(f"no event {event}")
    return LIFECYCLE[event]


def bounded_order(df: DataFrame, order: list, most: int) -> DataFrame:
    """Rows with ordinals from 1 on, after a cut on their order."""
    return df.orderBy(*order).limit(most).withColumn("ordinal", F.row_number().over(Window.orderBy(*order)))
