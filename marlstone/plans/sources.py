"""Registered queries over source texts that Spark writes from the tables: an order is a class, its lines are methods that call parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.plans import tables as T
from marlstone.plans.registry import query
from marlstone.sources.files import extract_symbols

LANGUAGES = ["rust", "javascript", "typescript", "go", "java", "csharp", "ruby", "lua", "zig"]
#: Texts that a task reads.
TASK_TEXTS = 1 << 13
#: Head, method and end of a text in each language; ``{o}`` is the order, ``{n}`` the line, ``{p}`` the part.
TEXTS = {
    "rust": ("pub struct Order{o};\nimpl Order{o} {\n", "    pub fn line{n}(&self) { part{p}(); }\n", "}\n"),
    "javascript": ("export class Order{o} {\n", "  line{n}() { part{p}(); } // line0() {\n", "}\n"),
    "typescript": ("export class Order{o} {\n", "  line{n}(): string { part{p}('}'); }\n", "}\n"),
    "go": ("package shop\ntype Order{o} struct {\n}\n", "func (o *Order{o}) line{n}() { part{p}(`}`) }\n", ""),
    "java": ("public class Order{o} {\n", "  public void line{n}() { part{p}(\"{\"); }\n", "}\n"),
    "csharp": ("public class Order{o} {\n", "  public void line{n}() { part{p}(); /* { */ }\n", "}\n"),
    "ruby": ("class Order{o}\n", "  def line{n}\n    part{p}(1) if true\n  end\n", "end\n"),
    "lua": ("local Order{o} = {}\n", "function Order{o}.line{n}()\n  if true then part{p}() end -- end\nend\n", ""),
    "zig": ("pub const Order{o} = struct {\n", "    pub fn line{n}() void { part{p}(); }\n", "};\n"),
}


def source_files(spark, sf_dir) -> DataFrame:
    """``(path, language, text)``: a text for each order, dealt by their number: reading them is work for Python, far more than their bytes tell."""
    orders = T.table(spark, sf_dir, "orders").select("o_orderkey")
    parts = max(1, -(-orders.count() // TASK_TEXTS))  # by the files' footers
    line = T.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").repartition(parts, "l_orderkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("items"))
    own = orders.repartition(parts, "o_orderkey").join(line, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    key = F.col("o_orderkey").cast("string")
    empty = F.array().cast("array<struct<l_linenumber:int,l_partkey:bigint>>")

    def fill(template: str, item=None):
        out = F.replace(F.lit(template), F.lit("{o}"), key)
        return out if item is None else F.replace(F.replace(out, F.lit("{n}"), item["l_linenumber"].cast("string")), F.lit("{p}"), item["l_partkey"].cast("string"))

    def text(language: str):
        head, method, end = TEXTS[language]
        return F.concat(fill(head), F.array_join(F.transform(F.coalesce("items", empty), lambda x: fill(method, x)), ""), F.lit(end))

    turn = F.col("o_orderkey") % len(LANGUAGES)
    language = F.element_at(F.array(*map(F.lit, LANGUAGES)), (turn + 1).cast("int"))
    whole = F.coalesce(*(F.when(turn == k, text(n)) for k, n in enumerate(LANGUAGES)))
    return own.select(F.concat_ws("/", language, F.concat(F.lit("order"), key)).alias("path"), language.alias("language"), whole.alias("text"))


def _of(values: dict[str, str], other: str) -> str:
    return "CASE language " + " ".join(f"WHEN '{n}' THEN {v}" for n, v in values.items()) + f" ELSE {other} END"


_FIRST = {"rust": "3", "go": "4"}  # the line of the first method
_EACH = {"ruby": "3", "lua": "3"}  # lines a method takes
_BELOW = {"ruby": "1", "lua": "1"}  # lines from a method's name to its call
SYMBOLS_SQL = f"""WITH o AS (SELECT o_orderkey AS k, ['{"','".join(LANGUAGES)}'][o_orderkey % {len(LANGUAGES)} + 1] AS language FROM orders
), l AS (SELECT k, language, l_linenumber AS n, l_partkey AS p, row_number() OVER (PARTITION BY k ORDER BY l_linenumber, l_partkey) - 1 AS nth FROM o JOIN lineitem ON l_orderkey = k
), placed AS (SELECT *, {_of(_FIRST, '2')} + nth * {_of(_EACH, '1')} AS line, CASE language WHEN 'go' THEN 'shop/' ELSE '' END || 'Order' || k AS holder FROM l
), found AS (
  SELECT k, language, 'Order' || k AS name, {_of({'rust': "'struct'", 'go': "'struct'", 'zig': "'struct'", 'lua': "'variable'"}, "'class'")} AS kind, 'declaration' AS evidence,
    CASE language WHEN 'go' THEN 'shop' ELSE '' END AS scope, CASE language WHEN 'go' THEN 2 ELSE 1 END AS line, {_of({'ruby': "'unknown'", 'lua': "'internal'"}, "'public'")} AS visibility FROM o
  UNION ALL SELECT k, language, 'shop', 'module', 'declaration', '', 1, 'unknown' FROM o WHERE language = 'go'
  UNION ALL SELECT k, language, 'line' || n, {_of({'lua': "'function'"}, "'method'")}, 'declaration', holder, line, {_of({'go': "'internal'", 'javascript': "'unknown'", 'typescript': "'unknown'", 'ruby': "'unknown'"}, "'public'")} FROM placed
  UNION ALL SELECT k, language, 'part' || p, 'identifier', 'call', holder || '/line' || n, line + {_of(_BELOW, '0')}, 'unknown' FROM placed)
"""


@query(SYMBOLS_SQL + "SELECT language || '/order' || k AS path, name, kind, evidence, scope, CAST(line AS INT) AS line, visibility FROM found")
def lexed_symbols(spark, sf_dir):
    """Definitions and calls that the lexer finds in texts of nine languages, with the definitions around them."""
    found = extract_symbols(source_files(spark, sf_dir), columns=["path", "name", "kind", "scope", "line", "visibility", "evidence"], evidence=("declaration", "call"))
    return found.select("path", "name", "kind", "evidence", F.array_join("scope", "/").alias("scope"), "line", "visibility")


@query(SYMBOLS_SQL + """, per AS (SELECT language, line, k, n FROM placed)
SELECT language || '/order' || k AS path, 'line' || n AS name, CAST(line AS INT) AS line, CAST(line + """ + _of(_EACH, "1") + """ - 1 AS INT) AS end_line FROM per
UNION ALL SELECT language || '/order' || k, 'Order' || k, CASE language WHEN 'go' THEN 2 ELSE 1 END,
  CAST(CASE language WHEN 'lua' THEN 1 WHEN 'go' THEN 3 WHEN 'rust' THEN 1 ELSE 2 + (SELECT count(*) FROM l WHERE l.k = o.k) * """ + _of(_EACH, "1") + """ END AS INT) FROM o""")
def lexed_extents(spark, sf_dir):
    """Where each definition begins and ends."""
    found = extract_symbols(source_files(spark, sf_dir), columns=["path", "name", "kind", "line", "end_line"], evidence=("declaration",)).filter("kind <> 'module'")
    return found.select("path", "name", "line", "end_line")
