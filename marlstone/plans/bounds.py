"""Registered queries that fit collections of the given tables into sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import bounding
from marlstone.operators.bounding import Collection
from marlstone.plans import tables as T
from marlstone.plans.queries import FILES, STEPS, SYMBOLS
from marlstone.plans.registry import query

TOKENS, SMALL_TOKENS, JSON_BYTES = 400_000, 200, 2 << 20


def _collections(spark, sf_dir, size):
    """The collections of a report: documents as files, parts as what is ranked, steps between parts as edges."""
    f = T.files(spark, sf_dir).select("path", F.coalesce("language", F.lit("")).alias("language"), "status", "n_chars", "doc_id")
    p = T.part_paths(spark, sf_dir).select("path", F.col("size").alias("score"))
    part = T.table(spark, sf_dir, "part")
    steps = T.part_edges(spark, sf_dir).select("src", "dst", "weight")

    def of(name, rows, order):
        return Collection(name, rows, order, size(*rows.columns))

    return [
        of("files", f.select("path", "language", "status"), [F.asc("path")]),
        of("omissions", f.filter("n_chars % 10 = 0").select("path", F.lit("oversized").alias("reason")), [F.asc("path")]),
        of("findings", f.filter("status = 'partial'").select("path", F.lit("parse_error").alias("kind")), [F.asc("path")]),
        of("edges", steps, [F.desc("weight"), F.asc("src"), F.asc("dst")]),
        of("ranking", p, [F.desc("score"), F.asc("path")]),
        of("landmarks", part.select(F.concat_ws("/", "p_brand", "p_type").alias("path")).distinct(), [F.asc("path")]),
        of("project_roots", part.select(F.col("p_brand").alias("path")).distinct(), [F.asc("path")]),
        of("snippets", f.filter("n_chars > 3000").select("path", "n_chars", "doc_id"), [F.desc("n_chars"), F.asc("doc_id")]),
    ]


def _items_sql(length: str, files: str) -> str:
    """All items with their places and sizes, the comma before an item among them."""
    js = lambda *c: f"{length}(CAST(to_json(struct_pack({', '.join(f'{x} := {x}' for x in c)})) AS VARCHAR))"
    one = lambda name, source, columns, order: f"SELECT '{name}' AS name, row_number() OVER (ORDER BY {order}) - 1 AS place, {js(*columns)} AS size FROM ({source})"
    part_path = "p_brand || '/' || p_type || '/part_' || p_partkey"
    parts = [
        one("omissions", "SELECT path, 'oversized' AS reason FROM files WHERE n_chars % 10 = 0", ["path", "reason"], "path"),
        one("findings", "SELECT path, 'parse_error' AS kind FROM files WHERE status = 'partial'", ["path", "kind"], "path"),
        one("edges", "SELECT src, dst, weight FROM edges", ["src", "dst", "weight"], "weight DESC, src, dst"),
        one("ranking", f"SELECT {part_path} AS path, CAST(round(p_retailprice * 100) AS BIGINT) AS score FROM part", ["path", "score"], "score DESC, path"),
        one("landmarks", "SELECT DISTINCT p_brand || '/' || p_type AS path FROM part", ["path"], "path"),
        one("project_roots", "SELECT DISTINCT p_brand AS path FROM part", ["path"], "path"),
        one("snippets", "SELECT path, n_chars, doc_id FROM files WHERE n_chars > 3000", ["path", "n_chars", "doc_id"], "n_chars DESC, doc_id"),
    ]
    if files:
        parts.append(one("files", "SELECT path, coalesce(language, '') AS language, status FROM files", ["path", "language", "status"], "path"))
    return "items AS MATERIALIZED (SELECT name, place, size + CASE WHEN place > 0 THEN 1 ELSE 0 END AS size FROM (" + " UNION ALL ".join(parts) + "))"


def _compact_sql(tokens: int) -> str:
    small = tokens < bounding.SMALL_TOKENS
    order = bounding.SMALL_POP_ORDER if small else bounding.POP_ORDER
    turns = " ".join(f"WHEN '{n}' THEN {k}" for k, n in enumerate(order))
    cleared = ["findings", "omissions", *(["edges", "ranking"] if tokens < bounding.TINY_TOKENS else ["snippets"])]
    end = f"CASE WHEN (SELECT coalesce(sum(size), 0) FROM popped WHERE before < excess) < (SELECT excess FROM need) AND c.name IN ({', '.join(map(repr, cleared))}) THEN 0 ELSE n - coalesce(gone, 0) END" if small else "n - coalesce(gone, 0)"
    frame = bounding.frame_size(bounding.POP_ORDER)
    return f"""WITH {FILES}, {STEPS}, {_items_sql('length', 'files')}, need AS (SELECT {frame} + sum(size) - 4 * {tokens} AS excess FROM items
), popped AS MATERIALIZED (SELECT *, coalesce(sum(size) OVER (ORDER BY CASE name {turns} END, place DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM items, need WHERE name IN ({', '.join(map(repr, order))}) AND place >= {int(small)}
), gone AS (SELECT name, count(*) AS gone FROM popped WHERE before < excess GROUP BY name
), c AS (SELECT name, count(*) AS n FROM items GROUP BY name), names AS (SELECT unnest([{', '.join(map(repr, bounding.POP_ORDER))}]) AS name
), kept AS (SELECT names.name, coalesce(n, 0) AS total, coalesce({end}, 0) AS returned FROM names LEFT JOIN c ON c.name = names.name LEFT JOIN gone ON gone.name = names.name)
SELECT name, total, CAST(returned AS BIGINT) AS returned, returned < total AS truncated, CASE WHEN returned < total THEN 'output_budget' END AS reason FROM kept"""


@query(_compact_sql(TOKENS))
def compact_bound(spark, sf_dir):
    """What each collection keeps when items are popped in a fixed order of collections until a token budget holds."""
    return bounding.compact_bound(_collections(spark, sf_dir, bounding.json_chars), TOKENS)


@query(_compact_sql(SMALL_TOKENS))
def compact_bound_small(spark, sf_dir):
    """Under 256 tokens collections keep an item each, as long as that fits."""
    return bounding.compact_bound(_collections(spark, sf_dir, bounding.json_chars), SMALL_TOKENS)


_SYMBOL = ["name", "line", "column", "role"]
_EVIDENCE = f"""WITH RECURSIVE {SYMBOLS}, {STEPS}, {_items_sql('strlen', '')}, sym AS (
  SELECT path, row_number() OVER (PARTITION BY path ORDER BY ord) AS nth, strlen(CAST(to_json(struct_pack(name := name, line := line, "column" := "column", role := role)) AS VARCHAR)) + 1 AS size FROM symbols
), per_file AS MATERIALIZED (SELECT f.path, f.language, f.status, coalesce(n, 0) AS n FROM files f LEFT JOIN (SELECT path, count(*) AS n FROM sym GROUP BY path) USING (path)
), most AS (SELECT coalesce(max(n), 0) AS n FROM per_file
), steps_of(step, n) AS (SELECT 0, n FROM most UNION ALL SELECT step + 1, greatest((n + 1) // 2, {bounding.SYMBOLS_LEAST}) FROM steps_of WHERE n > {bounding.SYMBOLS_LEAST}
), halved AS MATERIALIZED (SELECT path, step, CASE WHEN p.n <= {bounding.SYMBOLS_LEAST} THEN p.n ELSE greatest({bounding.SYMBOLS_LEAST}, CAST(ceil(p.n / pow(2, step)) AS BIGINT)) END AS kept FROM per_file p, steps_of
), file_items AS MATERIALIZED (
  SELECT step, row_number() OVER (PARTITION BY step ORDER BY p.path) - 1 AS place, any_value(h.kept) AS kept,
    any_value(strlen(CAST(to_json(struct_pack(path := p.path, language := coalesce(p.language, ''), status := p.status)) AS VARCHAR))) + {len(',"symbols":[]')} + greatest(coalesce(sum(s.size), 0) - 1, 0) AS size
  FROM halved h JOIN per_file p ON p.path = h.path LEFT JOIN sym s ON s.path = h.path AND s.nth <= h.kept GROUP BY step, p.path
), counts AS (SELECT name, count(*) AS n FROM items GROUP BY name UNION ALL SELECT 'files', count(*) FROM files
), cuts(name, k, cut, least) AS (
  SELECT name, 0, n, CASE name WHEN 'files' THEN {bounding.FILES_LEAST} WHEN 'project_roots' THEN 8 ELSE 16 END FROM counts
  UNION ALL SELECT name, k + 1, greatest((cut + 1) // 2, least), least FROM cuts WHERE cut > least
), last_cut AS (SELECT name, max(k) AS k FROM cuts GROUP BY name
), states AS (
  SELECT step AS i, step, 0 AS k, 0 AS f FROM steps_of
  UNION ALL SELECT (SELECT max(step) FROM steps_of) + k, (SELECT max(step) FROM steps_of), k, 0 FROM (SELECT DISTINCT k FROM cuts WHERE name <> 'files' AND k > 0)
  UNION ALL SELECT (SELECT max(step) FROM steps_of) + coalesce((SELECT max(k) FROM last_cut WHERE name <> 'files'), 0) + k, (SELECT max(step) FROM steps_of), coalesce((SELECT max(k) FROM last_cut WHERE name <> 'files'), 0), k FROM cuts WHERE name = 'files' AND k > 0
), other_sizes AS (SELECT s.i, sum(x.size) AS size FROM states s JOIN last_cut l ON l.name <> 'files' JOIN cuts c ON c.name = l.name AND c.k = least(s.k, l.k) JOIN items x ON x.name = c.name AND x.place < c.cut GROUP BY s.i
), file_sizes AS (SELECT s.i, sum(x.size + CASE WHEN x.place > 0 THEN 1 ELSE 0 END) AS size, sum(x.kept) AS kept FROM states s JOIN cuts c ON c.name = 'files' AND c.k = s.f JOIN file_items x ON x.step = s.step AND x.place < c.cut GROUP BY s.i
), chosen AS (
  SELECT s.*, fs.kept FROM states s LEFT JOIN other_sizes o ON o.i = s.i LEFT JOIN file_sizes fs ON fs.i = s.i
  ORDER BY ({bounding.frame_size(bounding.POP_ORDER)} + coalesce(o.size, 0) + coalesce(fs.size, 0) > {JSON_BYTES}), CASE WHEN {bounding.frame_size(bounding.POP_ORDER)} + coalesce(o.size, 0) + coalesce(fs.size, 0) > {JSON_BYTES} THEN -s.i ELSE s.i END LIMIT 1
), kept AS (
  SELECT c.name, n.n AS total, c.cut AS returned FROM chosen s JOIN last_cut l ON true JOIN cuts c ON c.name = l.name AND c.k = CASE WHEN l.name = 'files' THEN s.f ELSE least(s.k, l.k) END JOIN counts n ON n.name = c.name
  UNION ALL SELECT 'symbols', (SELECT sum(n) FROM per_file), kept FROM chosen
  UNION ALL SELECT name, 0, 0 FROM (SELECT unnest([{', '.join(map(repr, bounding.POP_ORDER))}]) AS name) WHERE name NOT IN (SELECT name FROM counts))
SELECT name, CAST(total AS BIGINT) AS total, CAST(returned AS BIGINT) AS returned, returned < total AS truncated, CASE WHEN returned < total THEN 'output_budget' END AS reason FROM kept"""


@query(_EVIDENCE)
def evidence_bound(spark, sf_dir):
    """What stays when symbols, then the other collections, then files are halved until their JSON fits some bytes."""
    rows = T.symbols(spark, sf_dir).select("path", "ord", *_SYMBOL)
    symbols = Collection("symbols", rows, [F.asc("ord")], bounding.json_bytes(*_SYMBOL))
    return bounding.evidence_bound(_collections(spark, sf_dir, bounding.json_bytes), symbols, "path", JSON_BYTES)


SECTION_TOKENS = 700
_SECTIONS = [
    ("findings", "SELECT path, 'parse_error' AS kind FROM files WHERE status = 'partial'", ["path", "kind"], "path"),
    ("files", "SELECT path, coalesce(language, '') AS language, status FROM files WHERE doc_id % 50 = 0", ["path", "language", "status"], "path"),
    ("edges", "SELECT src, dst, weight FROM edges WHERE src <= 3 OR dst <= 3", ["src", "dst", "weight"], "weight DESC, src, dst"),
    ("snippets", "SELECT path, n_chars, doc_id FROM files WHERE n_chars > 3000 AND doc_id % 7 = 0", ["path", "n_chars", "doc_id"], "n_chars DESC, doc_id"),
]


def _sections_sql() -> str:
    one = lambda k, name, source, columns, order: f"SELECT {k} AS section, '{name}' AS name, row_number() OVER (ORDER BY {order}) AS place, length(CAST(to_json(struct_pack({', '.join(f'{c} := {c}' for c in columns)})) AS VARCHAR)) AS size FROM ({source})"
    rows = " UNION ALL ".join(one(k, *s) for k, s in enumerate(_SECTIONS))
    room = 4 * SECTION_TOKENS - bounding.frame_size([s[0] for s in _SECTIONS])
    return f"""WITH RECURSIVE {FILES}, {STEPS}, items AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY section, place) AS rn FROM ({rows})
), fold(rn, section, filled, used, hit) AS (
  SELECT CAST(0 AS BIGINT), -1, false, CAST(0 AS BIGINT), false
  UNION ALL SELECT i.rn, i.section, (i.section = f.section AND f.filled) OR f.used + i.size + (i.section = f.section AND f.filled)::INT <= {room},
    CASE WHEN f.used + i.size + (i.section = f.section AND f.filled)::INT <= {room} THEN f.used + i.size + (i.section = f.section AND f.filled)::INT ELSE f.used END,
    f.used + i.size + (i.section = f.section AND f.filled)::INT <= {room} FROM fold f JOIN items i ON i.rn = f.rn + 1
), n AS (SELECT name, count(*) AS total, count(*) FILTER (hit) AS returned FROM items JOIN fold USING (rn) GROUP BY name)
SELECT s.name, coalesce(total, 0) AS total, coalesce(returned, 0) AS returned, coalesce(returned < total, false) AS truncated, CASE WHEN returned < total THEN 'token_budget' END AS reason
FROM (SELECT unnest([{', '.join(repr(s[0]) for s in _SECTIONS)}]) AS name) s LEFT JOIN n ON n.name = s.name"""


@query(_sections_sql())
def section_budget(spark, sf_dir):
    """Unlike sections, filled one after another under one token budget, passing over what doesn't fit."""
    given = {c.name: c for c in _collections(spark, sf_dir, bounding.json_chars)}
    f = T.files(spark, sf_dir).select("path", F.coalesce("language", F.lit("")).alias("language"), "status", "doc_id", "n_chars")
    some = {
        "findings": given["findings"].rows, "files": f.filter("doc_id % 50 = 0").select("path", "language", "status"),
        "edges": given["edges"].rows.filter("src <= 3 or dst <= 3"), "snippets": f.filter("n_chars > 3000 and doc_id % 7 = 0").select("path", "n_chars", "doc_id"),
    }
    return bounding.fill_sections([Collection(n, rows, given[n].order, bounding.json_chars(*rows.columns)) for n, rows in some.items()], SECTION_TOKENS)[1]
