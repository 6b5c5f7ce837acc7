"""The relationship graph: files and symbols as nodes, typed edges with evidence, and the questions it answers.

``symbols`` have ``path, ord, name, kind, role, evidence, context, scope, line,
column`` and maybe ``end_line`` and ``end_column``; ``edges`` are those that
``edges.describe`` gives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.paths import is_test_path
from marlstone.functions.stage import growing, write_stage
from marlstone.functions.text import ascii_lower, folded, query_path
from marlstone.operators.budget import page
from marlstone.operators.edges import TARGET_KINDS, import_names
from marlstone.operators.graph import KINDS, adjacency, confidence_rank, kind_rank, of_kinds, walk  # noqa: F401

#: Relations of a result in their order (fixed values).
RELATIONS = ["symbol", "definition", "reference", "import", "dependency", "reverse_dependency", "test", "caller", "callee"]
SYMBOL_PLACE = ["line", "column", "end_line", "end_column", "role", "kind"]


def file_node(path: Column) -> Column:
    return F.concat(F.lit("file:"), path)


def _placed(symbols: DataFrame) -> DataFrame:
    for c, start in (("end_line", "line"), ("end_column", "column")):
        if c not in symbols.columns:
            symbols = symbols.withColumn(c, F.col(start))
    return symbols if "scope" in symbols.columns else symbols.withColumn("scope", F.array().cast("array<string>"))


def symbol_node() -> Column:
    """A symbol's id: its path, where it begins and ends, role, kind and name."""
    return F.concat_ws(":", F.lit("symbol"), "path", *(F.col(c).cast("string") for c in SYMBOL_PLACE), "name")


def nodes(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """``(id, kind, path, name, scope, role, language, partial)`` of all files and symbols."""
    f = files.select(file_node(F.col("path")).alias("id"), F.lit("file").alias("kind"), "path", F.lit(None).cast("string").alias("name"), F.lit(None).cast("array<string>").alias("scope"), F.lit(None).cast("string").alias("role"), "language", (F.col("status") == "partial").alias("partial"))
    own = _placed(symbols).drop("language").join(growing(files.select("path", "language", (F.col("status") == "partial").alias("partial"))), "path")
    return f.unionByName(own.select(symbol_node().alias("id"), F.lit("symbol").alias("kind"), "path", "name", "scope", "role", "language", "partial").dropDuplicates(["id"]))


def call_owners(symbols: DataFrame) -> DataFrame:
    """``(path, ord, owner)``: the innermost enclosing scope of a call that the file defines, its first definition."""
    own = _placed(symbols)
    calls = own.filter("role = 'reference' and evidence = 'call'").select("path", "ord", F.posexplode("scope").alias("depth", "name"))
    defs = own.filter((F.col("role") == "definition") & F.col("kind").isin(TARGET_KINDS)).groupBy("path", "name").agg(F.min_by(symbol_node(), "ord").alias("owner"))
    return calls.join(growing(defs), ["path", "name"]).groupBy("path", "ord").agg(F.max_by("owner", "depth").alias("owner"))


def build(files: DataFrame, edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """``(id, source, target, kind, symbol, ambiguous, candidates, candidate_group, resolution_reason, confidence, evidence, ...)``: relations between files, and between symbols.

    Whether a relation of files is an import hangs on the file importing that name
    at all, not on the single reference.  Between symbols, each reference to and
    import of the edge's name meets each definition of that name, or of a name that
    the imports take it from, in the target; a call starts at the definition around
    it.  An id holds both ends, kind, name and candidate group, and stands once; an
    end that is partial lowers high to medium.
    """
    edges, _ = write_stage(edges, "edges")  # read several times
    own = _placed(symbols)
    known = files.select("path", (F.col("status") == "partial").alias("partial"))
    some = edges.join(growing(known.select(F.col("path").alias("source"), F.col("partial").alias("__a"))), "source").join(growing(known.select(F.col("path").alias("target"), F.col("partial").alias("__b"))), "target")
    imports = own.filter("role = 'definition' and evidence = 'import'")
    taken = imports.select(F.col("path").alias("source"), F.col("name").alias("symbol"), F.explode(import_names(F.col("name"), F.coalesce("context", F.lit("")), F.array(F.regexp_replace(F.regexp_replace(F.regexp_extract(F.coalesce("context", F.lit("")), "[\"']([^\"']*)[\"']", 1), r"^(\./)*(\.\./)*", ""), r"(\.js)*(\.ts)*(\.py)*(\.rs)*$", "")))).alias("wanted")).filter("wanted <> ''").distinct()
    named = imports.select(F.col("path").alias("source"), F.col("name").alias("symbol")).distinct().withColumn("__imports", F.lit(True))
    told = some.join(growing(named), ["source", "symbol"], "left")
    kept = ["symbol", "ambiguous", "candidates", "candidate_group", "resolution_reason", "confidence", "__a", "__b"]
    kind = F.when(F.coalesce("__imports", F.lit(False)), "import").otherwise("dependency")
    between_files = told.select(file_node(F.col("source")).alias("from"), file_node(F.col("target")).alias("to"), F.col("source").alias("source_path"), F.col("target").alias("target_path"), kind.alias("kind"), *kept)

    by_evidence = F.when(F.col("evidence") == "import", "import").when(F.col("evidence") == "call", "call").when(F.col("evidence") == "type_reference", "type_reference").otherwise("reference")
    refs = own.filter("role = 'reference' or (role = 'definition' and evidence = 'import')").join(growing(call_owners(symbols)), ["path", "ord"], "left")
    refs = refs.select(F.col("path").alias("source"), F.col("name").alias("symbol"), by_evidence.alias("kind"), F.coalesce("owner", symbol_node()).alias("from"))
    defs = own.filter((F.col("role") == "definition") & F.col("kind").isin(TARGET_KINDS)).select(F.col("path").alias("target"), F.col("name").alias("wanted"), symbol_node().alias("to"))
    names = some.select("source", "symbol").distinct().withColumn("wanted", F.col("symbol")).unionByName(taken).distinct()
    met = some.join(growing(names), ["source", "symbol"]).join(growing(defs), ["target", "wanted"]).drop("wanted").join(growing(refs), ["source", "symbol"])
    between_symbols = met.select("from", "to", F.col("source").alias("source_path"), F.col("target").alias("target_path"), "kind", *kept)

    every = between_files.unionByName(between_symbols)
    ident = F.concat_ws(":", F.lit("relationship"), "from", "to", "kind", "symbol", "candidate_group")
    one = lambda kind, detail: F.struct(F.lit(kind).alias("kind"), detail.alias("detail"))
    partial = F.col("__a") | F.col("__b")
    evidence = F.array_compact(
        F.array(
            one("lexical_edge", F.concat("kind", F.lit(" lexical edge resolved by "), "resolution_reason", F.lit(" evidence"))),
            F.when(partial, one("partial_source", F.lit("one endpoint was analyzed partially"))),
            F.when(F.col("ambiguous"), one("ambiguity", F.concat(F.size("candidates").cast("string"), F.lit(" lexical candidates were retained")))),
        )
    )
    sure = F.when(partial & (F.col("confidence") == "high"), "medium").otherwise(F.col("confidence"))
    return every.select(ident.alias("id"), F.col("from").alias("source"), F.col("to").alias("target"), "source_path", "target_path", "kind", "symbol", "ambiguous", "candidates", "candidate_group", "resolution_reason", sure.alias("confidence"), evidence.alias("evidence")).dropDuplicates(["id"])


def as_graph(relationships: DataFrame) -> DataFrame:
    """Relationships as the edges that walks take."""
    return relationships.select(F.col("source").alias("src"), F.col("target").alias("dst"), "kind", "confidence", "ambiguous", "id")


def named(all_nodes: DataFrame, name: str, role: str | None = None) -> DataFrame:
    """Symbol nodes of a name, or of a name with its scopes before it, whatever its ASCII case: all, definitions, or references."""
    q = folded(name)
    whole = ascii_lower(F.concat_ws("::", "scope", "name"))
    hit = all_nodes.filter((F.col("kind") == "symbol") & ((ascii_lower(F.col("name")) == q) | (whole == q)) & F.lit(q != ""))
    return hit if role is None else hit.filter(F.col("role") == role)


def _in_order(parts: list[DataFrame]) -> DataFrame:
    """``(id)`` of the first of some answers that has rows."""
    every = parts[0].select("id", F.lit(0).alias("how"))
    for k, p in enumerate(parts[1:], 1):
        every = every.unionByName(p.select("id", F.lit(k).alias("how")))
    best = every.agg(F.min("how").alias("best"))  # one row
    return every.filter(F.col("how") == best.scalar()).select("id").distinct()


def anchors(all_nodes: DataFrame, target: str) -> DataFrame:
    """``(id)`` of what a target names: the file of that path, else symbols of that name, else files in that folder."""
    path, files = query_path(target), all_nodes.filter("kind = 'file'")
    return _in_order([files.filter(F.col("path") == path), named(all_nodes, target), files.filter(F.col("path").startswith(path + "/"))])


def file_anchors(all_nodes: DataFrame, target: str) -> DataFrame:
    """``(id)`` of the files that a target names: that path, else those with a symbol of that name, else those in that folder."""
    path, files = query_path(target), all_nodes.filter("kind = 'file'")
    return _in_order([files.filter(F.col("path") == path), files.join(named(all_nodes, target).select("path"), "path", "left_semi"), files.filter(F.col("path").startswith(path + "/"))])


def candidates(all_nodes: DataFrame, relationships: DataFrame, operation: str, target: str) -> DataFrame:
    """``(relation, id, node, path, relationship, confidence, ambiguous, partial, reason)`` of one of the nine operations.

    ``symbol``, ``definitions`` and ``references`` give the nodes of a name;
    ``imports``, ``dependencies``, ``reverse_dependencies`` and ``tests`` one step
    from the target's files, ``callers`` and ``callees`` one call from its
    definitions, never to an anchor itself.
    """
    node = lambda df: df.select(F.col("id").alias("node"), "path", "partial")
    words = {"symbol": (None, "symbol", "the exact symbol name matched"), "definitions": ("definition", "definition", "the exact name matched a retained definition"), "references": ("reference", "reference", "the exact name matched a retained reference")}
    if operation in words:
        role, relation, reason = words[operation]
        found = node(named(all_nodes, target, role))
        return found.select(F.lit(relation).alias("relation"), F.col("node").alias("id"), "node", "path", F.lit(None).cast("string").alias("relationship"), F.when(F.col("partial"), "medium").otherwise("high").alias("confidence"), F.lit(False).alias("ambiguous"), "partial", F.lit(reason).alias("reason"))
    steps = {
        "imports": ("import", False, ["import"], "the target file has a retained outgoing file relationship"),
        "dependencies": ("dependency", False, None, "the target file has a retained outgoing file relationship"),
        "reverse_dependencies": ("reverse_dependency", True, None, "the target file has a retained incoming file relationship"),
        "tests": ("test", True, None, "the test path has a retained lexical relationship to the target"),
        "callers": ("caller", True, ["call"], "the retained call edge points to the requested definition"),
        "callees": ("callee", False, ["call"], "the retained call edge starts at the requested definition"),
    }
    if operation not in steps:
        raise ValueError(f"no operation {operation}")
    relation, back, kinds, reason = steps[operation]
    at = (named(all_nodes, target, "definition") if relation in ("caller", "callee") else file_anchors(all_nodes, target)).select(F.col("id").alias("node")).distinct()
    links = adjacency(of_kinds(as_graph(relationships), kinds), "in" if back else "out").join(at, "node", "left_semi")
    links = links.join(at.select(F.col("node").alias("other")), "other", "left_anti")
    met = links.select("other", F.col("id").alias("relationship"), "confidence", "ambiguous").join(growing(node(all_nodes)), F.col("other") == F.col("node"))
    if relation == "test":
        met = met.filter(is_test_path(F.col("path")))
    sure = F.when(F.col("partial") & (F.col("confidence") == "high"), "medium").otherwise(F.col("confidence"))
    return met.select(F.lit(relation).alias("relation"), F.concat_ws(":", F.lit("match"), "node", "relationship").alias("id"), "node", "path", "relationship", sure.alias("confidence"), "ambiguous", "partial", F.lit(reason).alias("reason"))


def relation_order() -> list[Column]:
    rank = F.array_position(F.array(*map(F.lit, RELATIONS)), F.col("relation"))
    return [confidence_rank(F.col("confidence")).asc(), F.col("ambiguous").cast("int").asc(), rank.asc(), F.asc("path"), F.asc("node"), F.asc_nulls_first("relationship")]


def within_payload(rows: DataFrame, order: list[Column], payload: Column, edge: Column, edge_payload: Column, tokens: int) -> DataFrame:
    """The longest prefix of a bounded page whose JSON stays in a token budget: the rows' array and that of their edges, each edge once.

    ``[[rows],[edges]]`` costs its texts, a comma between two, and the brackets.
    """
    place = Window.orderBy(*order)
    ranked = rows.withColumn("__rn", F.row_number().over(place)).withColumn("__row", F.length(payload)).withColumn("__edge", edge)
    first = F.row_number().over(Window.partitionBy("__edge").orderBy("__rn")) == 1
    ranked = ranked.withColumn("__new", F.col("__edge").isNotNull() & first).withColumn("__size", F.when(F.col("__new"), F.length(edge_payload)).otherwise(0))
    so_far = Window.orderBy("__rn").rowsBetween(Window.unboundedPreceding, 0)
    n_edges = F.sum(F.col("__new").cast("int")).over(so_far)
    chars = F.lit(7) + F.sum("__row").over(so_far) + F.col("__rn") - 1 + F.sum("__size").over(so_far) + F.greatest(n_edges - 1, F.lit(0))
    return ranked.withColumn("cost", F.ceil(chars / 4).cast("long")).filter(F.col("cost") <= tokens).drop("__rn", "__row", "__edge", "__new", "__size")


def report(all_nodes: DataFrame, relationships: DataFrame, operation: str, target: str, offset: int = 0, limit: int = 20, tokens: int = 1_000, omitted_paths: int = 0) -> dict[str, DataFrame | dict]:
    """A page of one operation: ``matches`` in order, their ``relationships`` once each, ``bounds`` and ``omissions``.

    The page is at most 256 rows; what a token budget cuts off it is counted.
    """
    found = candidates(all_nodes, relationships, operation, target)
    total, edges_total = found.count(), found.select("relationship").filter("relationship is not null").distinct().count()
    rows = page(found, relation_order(), offset, limit).join(relationships.select(F.col("id").alias("relationship"), F.to_json(F.struct(*relationships.columns)).alias("__edge_json")), "relationship", "left")
    fit = within_payload(rows, relation_order(), F.to_json(F.struct(*found.columns)), F.col("relationship"), F.col("__edge_json"), tokens).drop("__edge_json")
    returned, page_end = fit.count(), min(total, offset + limit)
    stopped = returned < page_end - min(offset, total)
    omissions = []
    if stopped:
        omissions.append({"reason": "token_budget", "count": total - min(offset, total) - returned})
    elif page_end < total:
        omissions.append({"reason": "result_limit", "count": total - page_end})
    if omitted_paths:
        omissions.append({"reason": "source_evidence", "count": omitted_paths})
    edges = relationships.join(fit.select(F.col("relationship").alias("id")).distinct(), "id", "left_semi")
    bounds = {"offset": offset, "total": total, "returned": returned, "omitted": total - returned, "total_relationships": edges_total, "returned_relationships": edges.count(), "truncated": returned < total, "continuation": offset + returned if offset + returned < total else None}
    return {"matches": fit, "relationships": edges, "bounds": bounds, "omissions": omissions}


def traverse(all_nodes: DataFrame, relationships: DataFrame, operation: str, start: str, target: str | None = None, direction: str = "out", kinds: list[str] | None = None, project: str | None = None, roots: DataFrame | None = None, depth: int = 1, work: int = 10_000, limit: int = 256, tokens: int = 1_000) -> dict[str, DataFrame | dict]:
    """``neighbors``, ``reverse_dependencies`` or ``path`` from a start, with bounds and omissions.

    ``project`` with ``roots(path, project_root)`` keeps to the nodes of one project.
    """
    from marlstone.operators.graph import shortest_path

    graph, at = as_graph(relationships), anchors(all_nodes, start)
    if operation == "reverse_dependencies":
        direction, kinds = "in", kinds or ["dependency", "import"]
        files = all_nodes.filter("kind = 'file'").select("id")
        at = at.join(files, "id", "left_semi")
        graph = graph.join(files.select(F.col("id").alias("src")), "src", "left_semi").join(files.select(F.col("id").alias("dst")), "dst", "left_semi")
    placed = None
    if project is not None:
        own = all_nodes.select("id", "path").join(roots.select("path", "project_root"), "path", "left")
        placed = own.select(F.col("id").alias("node"), (F.coalesce("project_root", F.lit(".")) == query_path(project)).alias("root"))
        at = at.join(placed.filter("root").select(F.col("node").alias("id")), "id", "left_semi")
    first = at.select(F.col("id").alias("node"))
    if operation == "path":
        goal = anchors(all_nodes, target).select(F.col("id").alias("node"))
        return {"path": shortest_path(of_kinds(graph, kinds), first, goal, depth, work, direction)}
    if operation not in ("neighbors", "reverse_dependencies"):
        raise ValueError(f"no operation {operation}")
    w = walk(graph, first, direction, depth, work, kinds, placed)
    met = w.nodes.filter("depth > 0").select("node", "depth", "rank", "via")
    total = met.count()
    rows = met.orderBy("rank").limit(limit).join(all_nodes.select(F.col("id").alias("node"), "path", "kind", "partial"), "node").join(relationships.select(F.col("id").alias("via"), F.to_json(F.struct(*relationships.columns)).alias("__edge_json")), "via", "left")
    fit = within_payload(rows, [F.asc("rank")], F.to_json(F.struct("node", "depth", "path", "kind", "partial")), F.col("via"), F.col("__edge_json"), tokens).drop("__edge_json")
    returned = fit.count()
    reasons = {"result_limit": max(0, total - limit), "token_budget": total - returned if returned < min(total, limit) else 0, "work_limit": int(w.work_limited), "depth_limit": int(w.depth_limited), "project_boundary": w.omitted_boundaries}
    bounds = {"total": total, "returned": returned, "work_used": w.work, "work_limited": w.work_limited, "depth_limited": w.depth_limited}
    return {"nodes": fit.select("node", "depth", "path", "via", "rank"), "bounds": bounds, "omissions": [{"reason": k, "count": n} for k, n in reasons.items() if n]}


def provenance(all_nodes: DataFrame, relationships: DataFrame) -> DataFrame:
    """``(nodes, partial_nodes, relationships, ambiguous)`` as one row."""
    n = all_nodes.agg(F.count("*").alias("nodes"), F.count_if("partial").alias("partial_nodes"))
    e = relationships.agg(F.count("*").alias("relationships"), F.count_if("ambiguous").alias("ambiguous"))
    return n.crossJoin(F.broadcast(e))  # one row each
