"""Registered queries of reading plans and of what a history says."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.paths import LANDMARK_PRIORITY
from marlstone.functions.stage import write_stage
from marlstone.operators import history, reading, topology
from marlstone.plans import tables as T
from marlstone.plans.queries import BUGS, NAMED, WINDOW_DAYS, _named, _word_sql
from marlstone.plans.registry import query

#: Documents as files of packages, fifty each, the first package being the tree itself.
NAMES = {0: "package.json", 1: "README.md", 2: "src/main.py", 3: "src/lib.rs", 4: "Makefile", 5: "tests/test_a.py", 6: "tests/test_b.py", 7: "LICENSE"}
PATH = "CASE WHEN doc_id < 50 THEN '' ELSE 'pkg' || (doc_id {0} 50) || '/' END || CASE doc_id % 50 " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in NAMES.items()) + " ELSE 'src/doc_' || doc_id || '.py' END"


def _inputs(spark, sf_dir) -> dict[str, DataFrame]:
    d = T.table(spark, sf_dir, "documents").select(F.expr(PATH.format("DIV")).alias("path"), "doc_id", "n_chars", F.lit("tracked").alias("worktree_state"))
    d, _ = write_stage(d, "files")
    commits = lambda step, offset: d.filter(f"doc_id % {step} = {offset}").select("path", (F.col("n_chars") % 7 + 1).cast("long").alias("commits"))
    focus = F.when(F.col("doc_id") % 211 == 9, 2).otherwise(0)
    return {
        "files": d.select("path"),
        "ranks": d.select("path", F.col("n_chars").cast("long").alias("score"), focus.alias("focus_matches"), F.when(F.col("doc_id") % 307 == 11, 1).otherwise(0).alias("task_matches")),
        "links": d.filter("doc_id % 3 > 0").select("path", (F.col("doc_id") % 3).alias("links")),
        "landmarks": topology.landmarks(d, focus=["pkg3/"]),
        "roots": topology.project_roots(d),
        "churn": commits(5, 2), "bugs": commits(10, 2), "fire": commits(15, 2),
        "targets": d.filter("doc_id % 401 = 17").select("path", F.when(F.col("doc_id") % 2 == 0, "library_export").otherwise("entry_point").alias("kind")),
    }


_MARKS = {"package.json": "manifest", "README.md": "readme", "Makefile": "build_entry_point", "LICENSE": "license"}
_LANDMARK = " UNION ALL ".join(
    f"""SELECT path, root, '{reading.LANDMARK_REASONS[kind][0]}', CAST({reading.LANDMARK_REASONS[kind][1]} AS BIGINT) + ({LANDMARK_PRIORITY[kind]} + focus) * {reading.POINT}{f" + CASE WHEN contains(path, '/') THEN 0 ELSE {reading.TOP_README} END" if kind == 'readme' else ''}, '{reading.LANDMARK_REASONS[kind][2]}' FROM f WHERE path = '{name}' OR ends_with(path, '/{name}')"""
    for name, kind in _MARKS.items()
)
_FOCUSED = " UNION ALL ".join(f"SELECT path, root, '{reading.LANDMARK_REASONS[kind][0]}', CAST({reading.FOCUS} AS BIGINT) + focus * {reading.POINT}, 'high' FROM f WHERE focus > 0 AND ends_with(path, '/{name}')" for name, kind in _MARKS.items())
CANDIDATES = f"""WITH f AS (
  SELECT *, contains(path, 'pkg3/')::INT AS focus, CASE WHEN contains(path, '/') AND starts_with(path, 'pkg') THEN split_part(path, '/', 1) ELSE '.' END AS r FROM (SELECT {PATH.format('//')} AS path, doc_id, n_chars, n_chars % 7 + 1 AS commits FROM documents)
), f0 AS (SELECT f.* EXCLUDE (r), CASE WHEN EXISTS (SELECT 1 FROM f g WHERE g.path = CASE f.r WHEN '.' THEN 'package.json' ELSE f.r || '/package.json' END) THEN r WHEN EXISTS (SELECT 1 FROM f g WHERE g.path = 'package.json') THEN '.' END AS root FROM f
), reasons(path, root, purpose, score, confidence) AS (WITH f AS (SELECT * FROM f0)
  SELECT path, root, 'architecture', CAST(n_chars AS BIGINT), CASE WHEN doc_id % 3 > 0 THEN 'high' ELSE 'medium' END FROM f
  UNION ALL SELECT path, root, 'architecture', {reading.ENTRY}, 'high' FROM f WHERE path = 'src/lib.rs' OR ends_with(path, '/src/lib.rs')
  UNION ALL SELECT path, root, 'runtime', {reading.ENTRY}, 'high' FROM f WHERE path = 'src/main.py' OR ends_with(path, '/src/main.py')
  UNION ALL SELECT path, root, 'architecture', {reading.FOCUS} + 2 * {reading.POINT}, 'high' FROM f WHERE doc_id % 211 = 9
  UNION ALL SELECT path, root, 'architecture', {reading.TASK} + n_chars, 'high' FROM f WHERE doc_id % 307 = 11
  UNION ALL {_LANDMARK} UNION ALL {_FOCUSED}
  UNION ALL SELECT path, root, 'tests', {reading.TEST} + n_chars, 'high' FROM f WHERE starts_with(path, 'tests/') OR contains(path, '/tests/')
  UNION ALL SELECT path, root, 'supporting_context', {reading.OVERLAP} + commits * {reading.COMMIT}, 'medium' FROM f WHERE doc_id % 5 = 2
  UNION ALL SELECT path, root, 'supporting_context', {reading.OVERLAP} + commits * {reading.COMMIT}, 'medium' FROM f WHERE doc_id % 10 = 2
  UNION ALL SELECT path, root, 'supporting_context', {reading.FIRE} + commits * {reading.COMMIT}, 'medium' FROM f WHERE doc_id % 15 = 2
  UNION ALL SELECT path, root, CASE WHEN doc_id % 2 = 0 THEN 'architecture' ELSE 'runtime' END, {reading.TARGET}, 'high' FROM f WHERE doc_id % 401 = 17
), c AS (
  SELECT purpose, path, min(root) AS project_root, CAST(CASE WHEN purpose = 'start_here' AND path = 'package.json' THEN greatest(sum(score), {reading.TREE_MANIFEST}) ELSE sum(score) END AS BIGINT) AS score, CASE WHEN bool_or(confidence = 'high') THEN 'high' ELSE 'medium' END AS confidence
  FROM reasons GROUP BY purpose, path)"""


@query(CANDIDATES + " SELECT purpose, path, project_root, score, confidence FROM c")
def reading_candidates(spark, sf_dir):
    """Reasons to read each file, added up by purpose."""
    return reading.candidates(**_inputs(spark, sf_dir)).select("purpose", "path", "project_root", "score", "confidence")


def _plan_sql() -> str:
    """Greedy picks one after another: each the best of its purpose that no earlier one took."""
    out, taken = CANDIDATES, []
    for k, purpose in enumerate(reading.PURPOSES):
        held = " AND path NOT IN (" + " UNION ALL ".join(f"SELECT path FROM p{j}" for j in taken) + ")" if taken else ""
        out += f", p{k} AS MATERIALIZED (SELECT {k} AS turn, * FROM c WHERE purpose = '{purpose}'{held} ORDER BY score DESC, confidence, path LIMIT 1)"
        taken.append(k)
    return out + ' SELECT CAST(row_number() OVER (ORDER BY turn, score DESC, path) AS BIGINT) AS "order", purpose, path, project_root, score FROM (' + " UNION ALL ".join(f"SELECT * FROM p{k}" for k in taken) + ")"


@query(_plan_sql())
def reading_plan(spark, sf_dir):
    """Five files to read first: the best of each purpose, no path twice."""
    given = _inputs(spark, sf_dir)
    found, _ = write_stage(reading.candidates(**given), "reading")
    rows = [(p["order"], p["purpose"], p["path"], p["project_root"], p["score"]) for p in reading.plan(found, given["roots"])]
    return spark.createDataFrame(rows, "order long, purpose string, path string, project_root string, score long")


_TOP = "(SELECT string_agg(path, '|' ORDER BY commits DESC, path) FROM (SELECT * FROM {0} ORDER BY commits DESC, path LIMIT 3))"


@query(f"""WITH {BUGS}, named AS ({NAMED.rsplit('named AS (', 1)[1]}
, fire AS (SELECT id FROM commits WHERE NOT is_merge AND committer_seconds >= {T.NOW} - {WINDOW_DAYS} * 86400 AND ({_word_sql(T.FIRE_WORDS)})
), touched AS (SELECT path, count(*) AS commits FROM commit_paths JOIN fire USING (id) GROUP BY path
), overlap AS (SELECT * FROM bugs WHERE path IN (SELECT path FROM churn)
), people AS (SELECT 1 AS recent, author_email AS who, count(*) AS commits FROM named WHERE NOT is_merge AND author_seconds >= {T.NOW} - {WINDOW_DAYS} * 86400 GROUP BY 2 UNION ALL SELECT 0, author_email, count(*) FROM named WHERE NOT is_merge GROUP BY 2
), sides AS (SELECT recent, arg_min(who, (-commits, who)) AS who, max(commits) AS first, sum(commits) AS total FROM people GROUP BY recent HAVING max(commits) >= 2
), months AS (SELECT strftime(to_timestamp(author_seconds) AT TIME ZONE 'UTC', '%Y-%m') AS month, count(*) AS commits FROM commits GROUP BY 1)
SELECT 'churn' AS kind, {_TOP.format('churn')} AS paths, CAST(NULL AS VARCHAR) AS detail, max(commits) AS value, count(*) AS of FROM churn HAVING max(commits) >= 2 OR count(*) >= 2
UNION ALL SELECT 'contributors', NULL, who, first, CAST(total AS BIGINT) FROM (SELECT * FROM sides ORDER BY recent DESC LIMIT 1)
UNION ALL SELECT 'bug_overlap', {_TOP.format('overlap')}, NULL, max(commits), count(*) FROM overlap HAVING count(*) > 0
UNION ALL SELECT 'activity', NULL, arg_max(month, (commits, month)), max(commits), CAST(sum(commits) AS BIGINT) FROM months HAVING count(*) >= 2 AND sum(commits) >= 3
UNION ALL SELECT 'firefighting', {_TOP.format('touched')}, NULL, (SELECT count(*) FROM fire), count(*) FROM touched HAVING (SELECT count(*) FROM fire) > 0""")
def history_observations(spark, sf_dir):
    """What the signals of a history support: a row for each of five kinds that has enough behind it."""
    commits, paths = T.commits(spark, sf_dir), T.commit_paths(spark, sf_dir)
    churned = history.churn(commits, paths, T.NOW, WINDOW_DAYS)
    bugs = history.keyword_paths(commits, paths, T.BUG_WORDS, T.NOW, WINDOW_DAYS)
    fire = history.keyword_commits(commits, T.FIRE_WORDS, T.NOW, WINDOW_DAYS)
    named = _named(spark, sf_dir)
    found = history.observations(churned, history.contributors(named), history.contributors(named, T.NOW, WINDOW_DAYS), history.overlap(bugs, churned), bugs, commits, fire, paths)
    return found.withColumn("paths", F.array_join("paths", "|"))
