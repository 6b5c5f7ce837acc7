"""More registered queries over the logical tables: lists of paths, caps, budgets, scopes and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import text as X
from marlstone.functions.stage import write_stage
from marlstone.operators import budget, changes, edges, graph, history, index, ranking, reports, search, topology
from marlstone.operators.bounding import placed
from marlstone.plans import tables as T
from marlstone.plans.queries import BUGS, CHURN, CLASSED, COMMITS, FILES, NAMED, SYMBOLS, TOKEN_EDGES, WINDOW_DAYS, _named, _token_questions, _token_symbols, _word_sql
from marlstone.plans.registry import query

SCOPE = "Brand#11"


@query("""WITH v AS (SELECT c_custkey AS k, trim(CASE c_custkey % 4 WHEN 0 THEN ' ' || c_mktsegment || ' ' WHEN 1 THEN lower(c_mktsegment) WHEN 2 THEN c_mktsegment || c_nationkey ELSE '' END) AS v FROM customer)
SELECT row_number() OVER (ORDER BY lower(v)) - 1 AS place, arg_min(v, k) AS seed FROM v WHERE v <> '' GROUP BY lower(v)""")
def fn_seeds(spark, sf_dir):
    """Seeds trimmed, without empty ones, in order without case, each once: of equal ones the first stands."""
    value = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit(" "), "c_mktsegment", F.lit(" "))).when(F.col("c_custkey") % 4 == 1, F.lower("c_mktsegment")).when(F.col("c_custkey") % 4 == 2, F.concat("c_mktsegment", "c_nationkey")).otherwise("")
    return placed(X.seed_rows(T.table(spark, sf_dir, "customer"), value, F.col("c_custkey")), [F.asc("key")])[0].select("place", "seed")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS stamp, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def fn_times(spark, sf_dir):
    s = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    return T.table(spark, sf_dir, "orders").select("o_orderkey", X.month_of(s).alias("month"), X.rfc3339(s).alias("stamp"), X.capture_date(s).alias("day"))


@query("SELECT s_suppkey, CAST(round(greatest(s_acctbal, 0) * 1000000) AS BIGINT) AS scaled FROM supplier")
def scaled_scores(spark, sf_dir):
    """Scores in millionths, none below zero."""
    return T.table(spark, sf_dir, "supplier").select("s_suppkey", graph.scaled_score(F.col("s_acctbal").cast("double")).alias("scaled"))


def _fold_sql(rows: str, budget_: int, keep: str = "hit") -> str:
    """A fold in order over ``(rn, cost)``: what fits is taken, the rest is passed over."""
    return f"""WITH RECURSIVE {rows}, taken(rn, used, hit) AS (
  SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), false
  UNION ALL SELECT f.rn, CASE WHEN t.used + f.cost <= {budget_} THEN t.used + f.cost ELSE t.used END, t.used + f.cost <= {budget_} FROM taken t JOIN first f ON f.rn = t.rn + 1)"""


SOURCE_BYTES = 64 << 20


@query(_fold_sql(f"{COMMITS}, first AS (SELECT path, size AS cost, row_number() OVER (ORDER BY path) AS rn FROM part_paths)", SOURCE_BYTES) + " SELECT path, hit AS kept FROM first JOIN taken USING (rn)")
def source_byte_budget(spark, sf_dir):
    """A file that would overflow the bytes is passed over, and later ones still fit."""
    taken, left = topology.within_bytes(T.part_paths(spark, sf_dir).select("path", "size"), SOURCE_BYTES)
    return taken.select("path", F.lit(True).alias("kept")).unionByName(left.select("path", F.lit(False).alias("kept")))


@query(_fold_sql(f"""{CHURN}, head AS (SELECT * FROM part_paths WHERE p_partkey % 9 <> 0), joined AS (SELECT c.path, c.commits, h.size, h.p_size FROM churn c LEFT JOIN head h USING (path)
), first AS (SELECT *, CASE WHEN size BETWEEN 1 AND 150000 THEN size ELSE 0 END AS cost, row_number() OVER (ORDER BY commits DESC, path) AS rn FROM joined)""", 20_000_000) + """
SELECT path, CASE WHEN size IS NULL THEN 'missing_at_head' WHEN size = 0 THEN 'empty' WHEN size > 150000 THEN 'oversized' WHEN cost > 0 AND NOT hit THEN 'resource_limit' WHEN p_size % 10 = 0 THEN 'binary' ELSE 'text' END AS status FROM first JOIN taken USING (rn)""")
def churn_sizes(spark, sf_dir):
    """Sizes are looked into in order of commits and path while they fit."""
    head = T.part_paths(spark, sf_dir).filter("p_partkey % 9 <> 0").select("path", "size", (F.col("p_size") % 10 == 0).alias("binary"), F.lit(False).alias("generated"))
    churned = history.churn(T.commits(spark, sf_dir), T.commit_paths(spark, sf_dir), T.NOW, WINDOW_DAYS)
    return history.normalised_churn(churned, head, 150_000, 20_000_000).select("path", F.col("size_status").alias("status"))


@query(f"WITH {FILES} SELECT path, CASE WHEN bool_or(doc_id % 3 = 0 OR doc_id % 4 = 0) THEN 'tracked' ELSE 'untracked' END AS state FROM files WHERE doc_id % 3 = 0 OR doc_id % 4 = 0 OR doc_id % 5 <> 0 GROUP BY path")
def candidate_paths(spark, sf_dir):
    """Listings of a tree, an index and a worktree, merged."""
    f = T.files(spark, sf_dir)
    return topology.merge_candidates(f.filter("doc_id % 3 = 0"), f.filter("doc_id % 4 = 0"), f.filter("doc_id % 5 <> 0")).select("path", F.col("worktree_state").alias("state"))


@query(f"WITH {FILES} SELECT DISTINCT path FROM files WHERE doc_id % 2 <> 0 AND doc_id % 3 <> 0")
def ignored_paths(spark, sf_dir):
    f = T.files(spark, sf_dir)
    return topology.ignored_paths(f, f.filter("doc_id % 2 = 0"), f.filter("doc_id % 3 = 0"))


@query(f"WITH {FILES} SELECT path FROM files WHERE doc_id % 11 = 3 OR doc_id % 7 = 1")
def dirty_paths(spark, sf_dir):
    """Indexed paths with other bytes in the worktree, or none there."""
    f = T.files(spark, sf_dir)
    now = f.filter("doc_id % 11 <> 3").select("path", F.sha2(F.when(F.col("doc_id") % 7 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha256"))
    return topology.modified_paths(f.select("path", F.sha2("text", 256).alias("sha256")), now)


@query(f"WITH {FILES} SELECT path FROM files WHERE doc_id % 97 = 3 OR starts_with(path, 'src1/en/') OR starts_with(path, 'src2/')")
def related_paths(spark, sf_dir):
    """Paths that are, hold or lie in a changed one."""
    f = T.files(spark, sf_dir).select("path", "doc_id")
    changed = f.filter("doc_id % 97 = 3").select("path").union(f.filter("startswith(path, 'src1/en/')").select(F.regexp_replace("path", "/[^/]*$", ""))).union(f.filter("startswith(path, 'src2/')").select(F.split("path", "/")[0]))
    return search.related_paths(f.select("path"), changed).select("path")


@query(f"WITH {FILES} SELECT project_root || '/' || language AS path, CASE WHEN bool_or(worktree_state = 'modified') THEN 'modified' WHEN bool_or(worktree_state = 'untracked') THEN 'untracked' ELSE 'tracked' END AS state FROM files WHERE doc_id % 13 < 2 GROUP BY 1")
def folder_states(spark, sf_dir):
    """The worst state below each folder."""
    rows = T.files(spark, sf_dir).filter("doc_id % 13 < 2").select(F.concat_ws("/", "project_root", "language").alias("path"), "worktree_state")
    return topology.directory_states(rows).select("path", F.col("worktree_state").alias("state"))


@query(f"""WITH {FILES}, p AS (SELECT {CLASSED} AS path FROM files), k AS (
  SELECT DISTINCT path, unnest(list_concat(
    CASE WHEN list_has_any(string_split(lower(path), '/'), ['dist', 'build']) OR ends_with(path, '_pb.go') THEN ['generated'] ELSE [] END,
    CASE WHEN list_has_any(string_split(lower(path), '/'), ['vendor', 'node_modules']) THEN ['vendor'] ELSE [] END,
    CASE WHEN ends_with(path, '.map') THEN ['source_map'] ELSE [] END, CASE WHEN ends_with(path, '.min.js') THEN ['minified'] ELSE [] END)) AS kind FROM p
), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY path) AS rn FROM k)
SELECT kind, count(*) AS paths, string_agg(path, '|' ORDER BY path) FILTER (rn <= 3) AS samples FROM r GROUP BY kind""")
def class_summary(spark, sf_dir):
    p = T.files(spark, sf_dir).select(F.expr(CLASSED).alias("path"))
    return topology.classification_summary(p, samples=3).select("kind", "paths", F.array_join("samples", "|").alias("samples"))


IN_SCOPE = f"id IN (SELECT id FROM commit_paths WHERE path = '{SCOPE}' OR starts_with(path, '{SCOPE}/'))"


@query(f"WITH {CHURN} SELECT path, commits FROM churn WHERE starts_with(path, '{SCOPE}/')")
def churn_in_scope(spark, sf_dir):
    return history.churn(T.commits(spark, sf_dir), T.commit_paths(spark, sf_dir), T.NOW, WINDOW_DAYS, SCOPE)


@query(f"""WITH {NAMED}, own AS (SELECT * FROM named WHERE {IN_SCOPE} AND NOT is_merge)
SELECT author_name AS name, author_email AS email, count(*) AS commits, count(*) * 100 // (SELECT count(*) FROM own) AS share FROM own GROUP BY 1, 2""")
def contributors_in_scope(spark, sf_dir):
    return history.contributors(history.commits_in_scope(_named(spark, sf_dir), T.commit_paths(spark, sf_dir), SCOPE))


@query(f"WITH {COMMITS} SELECT strftime(to_timestamp(author_seconds) AT TIME ZONE 'UTC', '%Y-%m') AS month, count(*) AS commits FROM commits WHERE {IN_SCOPE} GROUP BY 1")
def activity_in_scope(spark, sf_dir):
    return history.activity(history.commits_in_scope(T.commits(spark, sf_dir), T.commit_paths(spark, sf_dir), SCOPE))


@query(f"WITH {BUGS} SELECT path, commits FROM bugs WHERE starts_with(path, '{SCOPE}/')")
def bugs_in_scope(spark, sf_dir):
    """Paths of the scope that commits with bug words change; other paths of these commits don't count."""
    paths = T.commit_paths(spark, sf_dir)
    commits = history.commits_in_scope(T.commits(spark, sf_dir), paths, SCOPE)
    return history.keyword_paths(commits, paths.filter(F.startswith("path", F.lit(SCOPE + "/"))), T.BUG_WORDS, T.NOW, WINDOW_DAYS)


@query(f"WITH {COMMITS} SELECT id, message FROM commits WHERE {IN_SCOPE} AND NOT is_merge AND committer_seconds >= {T.NOW} - {WINDOW_DAYS} * 86400 AND ({_word_sql(T.FIRE_WORDS)})")
def firefighting_in_scope(spark, sf_dir):
    commits = history.commits_in_scope(T.commits(spark, sf_dir), T.commit_paths(spark, sf_dir), SCOPE)
    return history.keyword_commits(commits, T.FIRE_WORDS, T.NOW, WINDOW_DAYS).select("id", "message")


@query(f"WITH n AS (SELECT count(*) AS n FROM part WHERE p_brand = '{SCOPE}') SELECT p_partkey AS node, CASE WHEN p_brand = '{SCOPE}' THEN 1.0 / n ELSE 0.0 END::DOUBLE AS p FROM part, n")
def personal_shares(spark, sf_dir):
    """The parts of a brand share one evenly."""
    p = T.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), "p_brand")
    return ranking.personalisation(p, p.filter(F.col("p_brand") == SCOPE))


@query("SELECT p_brand || '/' || p_type AS path, max(p_partkey) AS score FROM part GROUP BY 1 ORDER BY score DESC, path LIMIT 20")
def top_scored_tests(spark, sf_dir):
    """The best by score, equal ones by path; a path counts once."""
    return reports.top_tests(T.table(spark, sf_dir, "part").select(F.concat_ws("/", "p_brand", "p_type").alias("path"), F.col("p_partkey").alias("score")), 20)


TARGETS = "p_brand || CASE WHEN p_partkey % 5 = 0 THEN '/tests/' ELSE '/' END || 'part_' || p_partkey"


@query(f"""WITH t AS (SELECT {TARGETS} AS path, p_size AS score, CASE WHEN p_partkey % 17 <> 0 THEN p_brand END AS root FROM part)
SELECT root, CAST(max(score) AS BIGINT) AS score, string_agg(DISTINCT path, '|' ORDER BY path) AS paths, coalesce(string_agg(DISTINCT path, '|' ORDER BY path) FILTER (contains(path, '/tests/')), '') AS tests FROM t GROUP BY root""")
def projects_of_targets(spark, sf_dir):
    rows = T.table(spark, sf_dir, "part").select(F.expr(TARGETS).alias("path"), F.col("p_size").cast("long").alias("score"), F.when(F.col("p_partkey") % 17 != 0, F.col("p_brand")).alias("project_root"))
    return reports.impact_projects(rows).select(F.col("project_root").alias("root"), "score", F.array_join("paths", "|").alias("paths"), F.array_join("tests", "|").alias("tests"))


@query(f"WITH {SYMBOLS}, r AS (SELECT path, ord, row_number() OVER (PARTITION BY path ORDER BY ord) AS rn FROM symbols) SELECT path, ord FROM r WHERE rn <= 16 ORDER BY path, ord LIMIT 3000")
def symbol_caps(spark, sf_dir):
    """Sixteen symbols a file, three thousand in all, in order of path and place."""
    return reports.bounded_symbols(T.symbols(spark, sf_dir).select("path", "ord"), 16, 3000)


@query(f"WITH {TOKEN_EDGES} SELECT DISTINCT source, target FROM (SELECT source, target FROM edges ORDER BY source, ord, target LIMIT 5000)")
def edge_cap(spark, sf_dir):
    """The cap counts edges before repeats are dropped."""
    s = _token_symbols(spark, sf_dir)
    some = edges.first_edges_by_name(s, 5000) if edges.by_name_alone(s) else edges.first_edges(edges.resolve(s, asked=_token_questions(s)), 5000)
    return some.select("source", "target").distinct()


@query(f"WITH {COMMITS} SELECT path, size, CAST(row_number() OVER (ORDER BY size DESC, path) AS INT) AS ordinal FROM part_paths ORDER BY size DESC, path LIMIT 50")
def ordinals(spark, sf_dir):
    return reports.bounded_order(T.part_paths(spark, sf_dir).select("path", "size"), [F.desc("size"), F.asc("path")], 50)


@query("SELECT count(*) AS total, least(count(*), 100) AS returned, count(*) > 100 AS truncated, CASE WHEN count(*) > 100 THEN 'collection_limit' END AS reason FROM documents")
def collection_summaries(spark, sf_dir):
    return budget.collection_summary(T.files(spark, sf_dir), 100)


SOME_CHANGED = f"""WITH {COMMITS}, before AS (SELECT path, 'v' || size AS oid FROM part_paths WHERE p_partkey % 401 <> 5), after AS (SELECT path, CASE WHEN p_partkey % 499 = 7 THEN 'new' ELSE 'v' || size END AS oid FROM part_paths WHERE p_partkey % 601 <> 9)"""


@query(SOME_CHANGED + """ SELECT coalesce(b.path, a.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'deleted' ELSE 'modified' END AS kind, b.oid AS before_oid, a.oid AS after_oid
FROM before b FULL JOIN after a ON a.path = b.path WHERE b.oid IS DISTINCT FROM a.oid""")
def tree_diff_pruned(spark, sf_dir):
    """Two trees that differ in a few files, met only in folders whose digests differ."""
    p, oid = T.part_paths(spark, sf_dir), F.concat(F.lit("v"), "size")
    before = changes.tree_entries(p.filter("p_partkey % 401 <> 5").select("path", oid.alias("oid")))
    after = changes.tree_entries(p.filter("p_partkey % 601 <> 9").select("path", F.when(F.col("p_partkey") % 499 == 7, "new").otherwise(oid).alias("oid")))
    return changes.pruned_diff(write_stage(before, "before")[0], write_stage(after, "after")[0])


@query(f"""WITH {FILES}, own AS (SELECT path, doc_id, sha256(text) AS fingerprint FROM files), records AS (
  SELECT doc_id * 4 AS id, path, fingerprint, doc_id % 3 AS created, 1 AS modified FROM own WHERE doc_id % 5 <> 4
  UNION ALL SELECT doc_id * 4 + 1, path, 'older', 1, doc_id % 2 FROM own WHERE doc_id % 7 <> 6
), newest AS (SELECT path, arg_max(id, (created, modified, -id)) AS id, arg_max(fingerprint, (created, modified, -id)) AS print FROM records GROUP BY path)
SELECT path, CASE WHEN n.id IS NULL THEN 'miss' WHEN print = fingerprint THEN 'hit' ELSE 'stale' END AS state, n.id AS record FROM own LEFT JOIN newest n USING (path)""")
def cache_states(spark, sf_dir):
    """Files against the newest record of each, of the text as it is or as it was."""
    own = T.files(spark, sf_dir).select("path", "doc_id", F.sha2("text", 256).alias("fingerprint"))
    fresh = own.filter("doc_id % 5 <> 4").select((F.col("doc_id") * 4).alias("id"), "path", "fingerprint", (F.col("doc_id") % 3).alias("created"), F.lit(1).cast("long").alias("modified"))
    old = own.filter("doc_id % 7 <> 6").select((F.col("doc_id") * 4 + 1).alias("id"), "path", F.lit("older").alias("fingerprint"), F.lit(1).cast("long").alias("created"), (F.col("doc_id") % 2).alias("modified"))
    cache = fresh.unionByName(old).withColumn("pack", F.lit("text-v1"))
    return index.cached_manually(own.select("path", "fingerprint"), cache, "text-v1").select("path", "state", F.col("record.id").alias("record"))
