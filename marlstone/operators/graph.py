"""Walks over edges: neighbourhoods, shortest paths, impact, proximity, rank.

``edges(src, dst, kind, confidence, ambiguous, id)``.  Walks run level by level;
each level is one join of the frontier with the edges and one distributed top-k or sort
in the order of discovery, so no more rows than the greatest work limit ever meet in one
task.  The state of each level is written to the shared folder.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.paths import is_test_path
from marlstone.functions import stage
from marlstone.functions.stage import by_some_keys, drop_buckets, drop_stage, write_buckets, write_stage

# Limits of walks and constants of the ranks (fixed values).
DEPTH_MOST, WORK_DEFAULT, WORK_MOST, RESULTS_MOST = 64, 10_000, 100_000, 256
IMPACT_DEPTH, IMPACT_WORK = 16, 20_000
DAMPING, ITERATIONS, RANK_SCALE = 0.85, 24, 1_000_000
NEAR, NEARER = 125_000, 250_000


def confidence_rank(c: Column) -> Column:
    return F.when(c == "high", 0).when(c == "medium", 1).otherwise(2)


#: Kinds of relations in the order that results have (fixed values).
KINDS = ["dependency", "import", "reference", "type_reference", "call"]


def kind_rank(c: Column) -> Column:
    out = F.when(c == KINDS[0], 0)
    for k, kind in enumerate(KINDS[1:], 1):
        out = out.when(c == kind, k)
    return out.otherwise(len(KINDS))


def adjacency(edges: DataFrame, direction: str = "out") -> DataFrame:
    """``(node, other, ...)`` along edges, against them, or both."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    out = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), *rest)
    back = edges.select(F.col("dst").alias("node"), F.col("src").alias("other"), *rest)
    return {"out": out, "in": back}[direction] if direction != "both" else out.unionByName(back)


def of_kinds(edges: DataFrame, kinds: list[str] | None) -> DataFrame:
    return edges.filter(F.col("kind").isin(kinds)) if kinds else edges


@dataclass
class Walk:
    """Nodes by discovery and what stopped the walk."""

    nodes: DataFrame
    work: int
    depth_limited: bool
    work_limited: bool
    omitted_boundaries: int


def numbered(df: DataFrame, order: list, name: str) -> tuple[DataFrame, str]:
    """Rows with growing numbers in an order, by a distributed sort, written."""
    return write_stage(df.orderBy(*order).withColumn(name, F.monotonically_increasing_id()), "numbered")


def counted(df: DataFrame, order: list, name: str) -> DataFrame:
    """Rows with the numbers from 1 on in an order: a distributed sort, and for each of its parts how many rows lie before it."""
    rows, _ = numbered(df, order, "__id")
    part = F.shiftright("__id", 33)
    sizes = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()  # one row a part of the sort
    before, starts = 0, []
    for r in sizes:
        starts.append((r["part"], before))
        before += r["n"]
    starts = df.sparkSession.createDataFrame(starts, "__part long, __before long")
    return rows.join(F.broadcast(starts), part == F.col("__part")).withColumn(name, F.col("__before") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__id", "__part", "__before")


def _level(front: DataFrame, links: DataFrame, room: int | None) -> tuple[DataFrame, int]:
    """The first ``room`` edges of a level in order of discovery (all without a room), numbered, and how many there are."""
    if front.count() <= WORK_MOST:
        front = F.broadcast(front)
    joined, where = write_stage(links.join(front, links["node"] == front["at"]).drop("at"), "level")
    total = joined.count()
    order = ["parent_rank", confidence_rank(F.col("confidence")), F.col("ambiguous").cast("int"), kind_rank(F.col("kind")), "id", "other"]
    taken = total if room is None else min(total, room)
    if taken > WORK_MOST:  # only without a room
        first, _ = write_stage(counted(joined, order, "work"), "first")
    else:
        first = joined.orderBy(*order).limit(taken)
        first, _ = write_stage(first.withColumn("work", F.row_number().over(Window.orderBy(*order))), "first")  # WORK_MOST rows at most
    drop_stage(links.sparkSession, where)
    return first, total


def walk(edges: DataFrame, anchors: DataFrame, direction: str = "out", depth: int = 1, work: int | None = WORK_DEFAULT, kinds: list[str] | None = None, projects: DataFrame | None = None, until=None) -> Walk:
    """Breadth-first discovery from ``anchors(node)``, in queue order.

    A node's parent is the edge that met it first: parents in order of their own
    discovery, then each one's edges by confidence, ambiguity, kind and id.
    Every edge looked at is work, also to nodes already met; the walk stops
    inside a level when the work limit is reached; with ``None`` there is no limit.  ``projects(node, root)``
    keeps a walk inside the anchors' project and counts the edges that leave it.
    """
    if not 0 <= depth <= DEPTH_MOST or not (work is None or 1 <= work <= WORK_MOST):
        raise ValueError("depth or work out of bounds")
    links = adjacency(of_kinds(edges, kinds), direction)
    start, _ = numbered(anchors.select("node").distinct(), ["node"], "rank")
    start = start.select("node", F.lit(0).alias("depth"), "rank", F.lit(None).cast(links.schema["other"].dataType).alias("parent"), F.lit(None).cast("string").alias("via"), F.lit("high").alias("confidence"), F.lit(False).alias("ambiguous"))
    met, where = write_stage(start, "walk")
    if projects is not None:
        links = links.join(projects.select(F.col("node").alias("node"), F.col("root").alias("__from")), "node").join(projects.select(F.col("node").alias("other"), F.col("root").alias("__to")), "other")
    used, level, boundaries, depth_limited, work_limited = 0, 0, 0, False, False
    while True:
        now = met.filter(F.col("depth") == level)
        if until is not None and not met.join(until, "node", "left_semi").isEmpty():
            break
        if now.isEmpty():
            break
        if level == depth:
            depth_limited = True
            break
        room = None if work is None else work - used
        if room == 0:
            work_limited = True
            break
        front = now.select(F.col("node").alias("at"), F.col("rank").alias("parent_rank"))
        first, total = _level(front, links, room)
        looked = total if room is None else min(total, room)
        work_limited = looked < total
        if projects is not None:
            boundaries += first.filter(F.col("__from") != F.col("__to")).count()
            first = first.filter(F.col("__from") == F.col("__to"))
        fresh = first.join(met.select("node"), first["other"] == met["node"], "left_anti")
        chosen = fresh.groupBy("other").agg(F.min(F.struct("work", "node", "id", "confidence", "ambiguous")).alias("m"))
        base = 1 << 40
        added = chosen.select(F.col("other").alias("node"), F.lit(level + 1).alias("depth"), (F.lit((level + 1) * base) + F.col("m.work")).cast("long").alias("rank"), F.col("m.node").alias("parent"), F.col("m.id").cast("string").alias("via"), F.col("m.confidence").alias("confidence"), F.col("m.ambiguous").alias("ambiguous"))
        met, new = write_stage(met.unionByName(added), "walk")
        drop_stage(edges.sparkSession, where)
        where = new
        used += looked
        level += 1
        if work_limited:
            break
    return Walk(met, used, depth_limited, work_limited, boundaries)


def neighbours(edges: DataFrame, anchors: DataFrame, results: int = RESULTS_MOST, **limits) -> DataFrame:
    """Nodes met, without the anchors: the first ``results`` by discovery, in order of depth and node."""
    found = walk(edges, anchors, **limits).nodes.filter("depth > 0")
    return found.orderBy("rank").limit(results).orderBy("depth", "node")


def path_search(edges: DataFrame, sources: DataFrame, targets: DataFrame, depth: int = DEPTH_MOST, work: int | None = WORK_MOST, direction: str = "out") -> tuple[DataFrame, Walk]:
    """``(step, node, parent, via, confidence, ambiguous)`` of the path met first, empty if there is none, and the walk that looked for it.

    Parents are followed back by one join a step over the nodes met.
    """
    goal = targets.select("node").distinct()
    walked = walk(edges, sources, direction, depth, work, until=goal)
    met = walked.nodes
    last = met.join(goal, "node", "left_semi").orderBy("depth", "rank").limit(1)
    path = last
    row = last.first()
    for _ in range(row["depth"] if row else 0):
        last = met.join(F.broadcast(last.select(F.col("parent").alias("__p"))), F.col("node") == F.col("__p"), "left_semi")  # one row
        path = path.unionByName(last)
    return path.select(F.col("depth").alias("step"), "node", "parent", "via", "confidence", "ambiguous").orderBy("step"), walked


def shortest_path(edges: DataFrame, sources: DataFrame, targets: DataFrame, depth: int = DEPTH_MOST, work: int | None = WORK_MOST, direction: str = "out") -> DataFrame:
    """The path of ``path_search``."""
    return path_search(edges, sources, targets, depth, work, direction)[0]


def path_summary(path: DataFrame) -> DataFrame:
    """Length, whether any edge is ambiguous, and the strongest confidence among its edges."""
    hops = path.filter("step > 0")
    return hops.agg(F.count("*").alias("edges"), F.bool_or("ambiguous").alias("ambiguous"), F.min_by("confidence", confidence_rank(F.col("confidence"))).alias("confidence"))


@dataclass
class Impact:
    """``nodes(node, depth, reach)``, and what stopped the walk."""

    nodes: DataFrame
    work: int
    depth_limited: bool
    work_limited: bool


def impact_walk(edges: DataFrame, seeds: DataFrame, depth: int = IMPACT_DEPTH, work: int | None = IMPACT_WORK, paths: DataFrame | None = None) -> Impact:
    """What depends on ``seeds(node)``.

    First all edges of the seeds are looked at, in order of seed, incoming before
    outgoing: the targets of outgoing ones are related, as inferred, unless they
    are seeds or, by ``paths(node, path)``, lie in the seed's own file.  Then
    against the edges: direct at depth one, transitive beyond, inferred from an
    ambiguous or weak edge on.  Every edge looked at is work; the walk stops where
    it is used up, with ``None`` nowhere.  Depth-limited is a walk with nodes at the greatest depth.
    """
    start, where = numbered(seeds.select("node").distinct(), ["node"], "rank")
    links = adjacency(edges, "in")
    around = links.withColumn("way", F.lit(0)).unionByName(adjacency(edges, "out").withColumn("way", F.lit(1))).join(start.select("node"), "node", "left_semi")
    around, looked = write_stage(around, "around")
    first = around
    if work is not None:
        first = around.orderBy("node", "way", confidence_rank(F.col("confidence")), F.col("ambiguous").cast("int"), kind_rank(F.col("kind")), "id", "other").limit(work)
    out = first.filter((F.col("way") == 1) & (F.col("other") != F.col("node")))
    if paths is not None:
        here, there = paths.select("node", F.col("path").alias("__here")), paths.select(F.col("node").alias("other"), F.col("path").alias("__there"))
        out = out.join(here, "node", "left").join(there, "other", "left").filter(~F.col("__here").eqNullSafe(F.col("__there")))
    related, _ = write_stage(out.select(F.col("other").alias("node")).distinct().join(start.select("node"), "node", "left_anti").select("node", F.lit(1).alias("depth"), F.lit("inferred").alias("reach")), "related")
    total = around.count()
    drop_stage(edges.sparkSession, looked)
    used, stopped, deep = total if work is None else min(work, total), work is not None and total > work, False
    state, where = write_stage(start.select("node", F.lit(0).alias("depth"), F.lit("seed").alias("reach"), "rank"), "impact")
    for level in range(depth + 1):
        now = state.filter(F.col("depth") == level)
        if stopped or now.isEmpty():
            break
        if level == depth:
            deep = True
            break
        front = now.select(F.col("node").alias("at"), F.col("rank").alias("parent_rank"), F.col("reach").alias("parent_reach"))
        left = None if work is None else work - used
        ranked, total = _level(front, links, left)
        stopped = left is not None and total > left
        used += left if stopped else total
        weak = F.col("ambiguous") | (F.col("confidence") == "low") | (F.col("parent_reach") == "inferred")
        reach = F.when(weak, "inferred").when(F.lit(level == 0), "direct").otherwise("transitive")
        fresh = ranked.join(state.select("node"), ranked["other"] == state["node"], "left_anti")
        chosen = fresh.withColumn("r", reach).groupBy("other").agg(F.min(F.struct("work", "r")).alias("m"))
        added = chosen.select(F.col("other").alias("node"), F.lit(level + 1).alias("depth"), F.col("m.r").alias("reach"), (F.lit((level + 1) << 40) + F.col("m.work")).cast("long").alias("rank"))
        state, new = write_stage(state.unionByName(added), "impact")
        drop_stage(edges.sparkSession, where)
        where = new
    met = state.select("node", "depth", "reach")
    return Impact(met.unionByName(related.join(met.select("node"), "node", "left_anti")), used, deep, stopped)


def impact(edges: DataFrame, seeds: DataFrame, depth: int = IMPACT_DEPTH, work: int | None = IMPACT_WORK) -> DataFrame:
    """``(node, depth, reach)`` of ``impact_walk``."""
    return impact_walk(edges, seeds, depth, work).nodes


def impact_priority(reach: Column, depth: Column) -> Column:
    base = F.when(reach == "direct", 3_000_000_000).when(reach == "transitive", 2_000_000_000).otherwise(1_000_000_000)
    return F.greatest(F.lit(0).cast("long"), base.cast("long") - (F.greatest(depth, F.lit(1)) - 1) * 75_000_000)


def seed_proximity(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``(node, distance, seed, score)``: the nearest seed within two undirected steps, the smallest on ties."""
    pairs, where = write_stage(edges.select("src", "dst").filter("src <> dst"), "pairs")  # read by both steps; the least seed needs no distinct ones
    links = adjacency(pairs, "both")
    zero = seeds.select("node", F.col("node").alias("seed")).distinct()
    one = zero.join(links, "node").groupBy(F.col("other").alias("node")).agg(F.min("seed").alias("seed"))
    one, _ = write_stage(one.join(zero.select("node"), "node", "left_anti"), "one_step")
    two = one.join(links, "node").groupBy(F.col("other").alias("node")).agg(F.min("seed").alias("seed"))
    two = two.join(zero.select("node"), "node", "left_anti").join(one.select("node"), "node", "left_anti")
    two, _ = write_stage(two, "two_steps")
    drop_stage(edges.sparkSession, where)
    near = one.select("node", F.lit(1).alias("distance"), "seed", F.lit(NEARER).cast("long").alias("score"))
    return near.unionByName(two.select("node", F.lit(2).alias("distance"), "seed", F.lit(NEAR).cast("long").alias("score")))


def pagerank(nodes: DataFrame, edges: DataFrame, personal: DataFrame | None = None, iterations: int = ITERATIONS, damping: float = DAMPING) -> DataFrame:
    """Personalised rank of ``nodes(node)`` over ``edges(src, dst, weight)``: a fixed number of rounds.

    Parallel edges add up, loops stay; weights are shared out over all of a
    node's edges before those that leave ``nodes`` are dropped; the rank of nodes
    without edges goes back by ``personal(node, p)`` (uniform by default).

    Each round is one join and one grouping of the ranks before it, which are
    written; the loose rank is read off them as one number.  Nodes lie in blocks of
    neighbours by their order; shares are written once by the block of their source, so a round
    shuffles no edges but, from each block, one sum for each node that it flows to.
    """
    spark, total = nodes.sparkSession, Window.partitionBy("src")
    n = nodes.count()
    p = nodes.select("node").withColumn("p", F.lit(1.0 / max(n, 1))) if personal is None else nodes.select("node").join(personal, "node", "left").select("node", F.coalesce("p", F.lit(0.0)).alias("p"))
    summed = edges.groupBy("src", "dst").agg(F.sum("weight").alias("w"))
    shares = summed.withColumn("share", F.col("w") / F.sum("w").over(total))
    shares, _ = write_stage(shares, "shares")
    base = p.join(shares.select(F.col("src").alias("node")).distinct().withColumn("flows", F.lit(True)), "node", "left").select("node", "p", F.coalesce("flows", F.lit(False)).alias("flows"))
    parts = max(1, -(-(shares.count() + n) // stage.PART_ROWS))
    base, _ = write_stage(base.repartitionByRange(parts, "node").withColumn("block", F.spark_partition_id()), "personal")
    placed = base.select(F.col("node").alias("src"), "block").distinct()
    kept = shares.join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").join(placed, "src").select("block", "src", "dst", "share")
    links, table, place = write_buckets(kept, parts, "block", "shares")
    rank, where = base.withColumn("score", F.col("p")), None
    try:
        for _ in range(iterations):
            loose = rank.filter("not flows").agg(F.sum("score")).first()[0] or 0.0
            # A block's nodes are few enough to be hashed; its links, which lie in one bucket, pass by.
            at = rank.select("block", "node", "score").repartition(parts, "block").hint("shuffle_hash")
            flow = at.join(links, (at["block"] == links["block"]) & (at["node"] == links["src"])).select(F.col("dst").alias("node"), (F.col("score") * F.col("share")).alias("got"))
            # A node's own row and what flows to it meet in one grouping.
            rows = base.select("node", "p", "flows", "block", F.lit(None).cast("double").alias("got")).unionByName(flow, allowMissingColumns=True)
            score = F.lit((1 - damping) + damping * loose) * F.sum("p") + damping * F.coalesce(F.sum("got"), F.lit(0.0))
            with by_some_keys(spark):
                rank, new = write_stage(rows.groupBy("node").agg(F.max("flows").alias("flows"), F.max("block").alias("block"), score.alias("score")), "rank")
            if where:
                drop_stage(spark, where)
            where = new
    finally:
        drop_buckets(spark, table, place)
    return rank.select("node", "score")


def scaled_score(score: Column) -> Column:
    return F.round(F.greatest(score, F.lit(0.0)) * RANK_SCALE).cast("long")


def relationship_nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()


def one_hop(edges: DataFrame, anchors: DataFrame, direction: str, kinds: list[str] | None = None) -> DataFrame:
    """Edges of one step from anchors to other nodes, strongest first."""
    links = adjacency(of_kinds(edges, kinds), direction)
    own = anchors.select("node").distinct()
    out = links.join(own, "node", "left_semi")
    away = out.join(own.select(F.col("node").alias("other")), "other", "left_anti")
    return away.orderBy(confidence_rank(F.col("confidence")), F.col("ambiguous").cast("int"), kind_rank(F.col("kind")), "other", "id")


def callers(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    return one_hop(edges, anchors, "in", ["call"])


def callees(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    return one_hop(edges, anchors, "out", ["call"])


def dependencies(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    return one_hop(edges, anchors, "out", ["dependency", "import"])


def reverse_dependencies(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    return one_hop(edges, anchors, "in", ["dependency", "import"])


def imports(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    return one_hop(edges, anchors, "out", ["import"])


def tests(edges: DataFrame, anchors: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges from nodes of test files to the anchors; ``nodes(node, path)``."""
    in_tests = nodes.filter(is_test_path(F.col("path"))).select(F.col("node").alias("other"))
    return one_hop(edges, anchors, "in").join(in_tests, "other", "left_semi")


def lexical_route(edges: DataFrame, sources: DataFrame, targets: DataFrame, most: int = 3) -> DataFrame:
    """``(route, edges)``: the way of at most ``most`` steps from ``sources(node)`` to ``targets(node)`` over distinct edges.

    Fewest steps, then the least nodes from the front; none where a source is a target.
    """
    links = edges.select("src", "dst").filter("src <> dst").distinct()
    met = sources.select("node").distinct().select(F.array("node").alias("route"), F.col("node").alias("at"))
    goal, found, seen = targets.select(F.col("node").alias("at")).distinct(), None, None
    met = met.join(goal, "at", "left_anti")
    for _ in range(most):
        # Of the routes to one node the least stands, and no later one to it counts.
        seen = met.select("at") if seen is None else seen.unionByName(met.select("at"))
        step = met.join(links, met["at"] == links["src"]).filter(~F.array_contains("route", F.col("dst"))).select(F.concat("route", F.array("dst")).alias("route"), F.col("dst").alias("at"))
        met = step.join(seen.distinct(), "at", "left_anti").groupBy("at").agg(F.min("route").alias("route")).select("route", "at")
        hit = met.join(goal, "at", "left_semi")
        found = hit if found is None else found.unionByName(hit)
    return found.select("route", (F.size("route") - 1).alias("edges")).orderBy("edges", "route").limit(1)


def resolve_anchor(files: DataFrame, symbols: DataFrame, target: str) -> DataFrame:
    """Files that a target names: the exact path, else files that define the symbol, else files in the folder."""
    from marlstone.functions.text import ascii_lower, folded

    exact = files.filter(F.col("path") == target).select(F.col("path").alias("node"), F.lit(0).alias("how"))
    name = ascii_lower(F.col("name"))
    whole = ascii_lower(F.concat_ws("::", F.col("scope"), F.col("name")))
    named = symbols.filter(((name == folded(target)) | (whole == folded(target))) & (F.col("role") == "definition")).select(F.col("path").alias("node"), F.lit(1).alias("how"))
    inside = files.filter(F.col("path").startswith(target.rstrip("/") + "/")).select(F.col("path").alias("node"), F.lit(2).alias("how"))
    every = exact.unionByName(named).unionByName(inside).distinct()
    best = every.agg(F.min("how").alias("best"))  # one row
    return every.filter(F.col("how") == best.scalar()).select("node")
