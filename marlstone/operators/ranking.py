"""Ranking files for a task, and choosing snippets within a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.paths import path_classes, snippet_role
from marlstone.functions.text import ascii_lower, folded
from marlstone.operators.topology import focus_covers

# Weights of the parts of a file's score (fixed values).
DIRECT, HISTORY, HISTORY_MOST, TEXT_FOCUS, PATH_FOCUS = 300_000, 25_000, 20, 350_000, 700_000


def _holds(files: DataFrame, symbols: DataFrame, text: str) -> DataFrame:
    """Paths of files whose path, or whose symbols' names or contexts, hold a text without regard to ASCII case."""
    q = folded(text)
    inside = symbols.filter(ascii_lower(F.col("name")).contains(q) | ascii_lower(F.coalesce("context", F.lit(""))).contains(q)).select("path")
    return files.filter(ascii_lower(F.col("path")).contains(q)).select("path").unionByName(inside).join(files.select("path"), "path", "left_semi").distinct()


def _named(symbols: DataFrame, name: str) -> DataFrame:
    """Paths with a symbol of a name, or of a name with its scopes before it."""
    whole = ascii_lower(F.concat_ws("::", "scope", "name")) if "scope" in symbols.columns else ascii_lower(F.col("name"))
    return symbols.filter((ascii_lower(F.col("name")) == folded(name)) | (whole == folded(name))).select("path").distinct()


def direct_matches(files: DataFrame, symbols: DataFrame, terms: list[str] = (), names: list[str] = (), paths: list[str] = (), languages: list[str] = (), projects: list[str] = (), changed_paths: list[str] = (), changed_symbols: list[str] = (), task_terms: list[str] = ()) -> DataFrame:
    """``(path, seeds, direct)``: the distinct seeds that a file answers, by kind and value.

    ``terms`` are searched for; those that ``task_terms`` name count as terms of the task.
    """
    parts, known = [], {t.lower() for t in task_terms}

    def seed(df: DataFrame, kind: str, value: str) -> None:
        parts.append(df.select("path", F.struct(F.lit(kind).alias("kind"), F.lit(value).alias("value")).alias("seed")))

    for t in terms:
        if folded(t):
            seed(_holds(files, symbols, t), "task_term" if folded(t) in known else "search_term", t)
    for kind, some in (("symbol", names), ("change_symbol", changed_symbols)):
        for n in some:
            seed(_named(symbols, n), kind, n)
    for kind, some in (("path", paths), ("change_path", changed_paths)):
        for p in some:
            seed(files.filter(focus_covers(F.col("path"), [p])), kind, p)
    for lang in languages:
        seed(files.filter(F.col("language") == lang), "language", lang)
    for r in projects:
        seed(files.filter(focus_covers(F.col("project_root"), [r])), "project", r)
    if not parts:
        return files.select("path", F.array().cast("array<struct<kind:string,value:string>>").alias("seeds"), F.lit(0).alias("direct")).limit(0)
    every = parts[0]
    for x in parts[1:]:
        every = every.unionByName(x)
    return every.groupBy("path").agg(F.array_sort(F.collect_set("seed")).alias("seeds")).withColumn("direct", F.size("seeds"))


def focus_hits(files: DataFrame, symbols: DataFrame | None, focus_texts: list[str] = (), focus_paths: list[str] = ()) -> DataFrame:
    """``(path, texts, paths)``: how many focus texts and focus paths meet each file that any meets."""
    parts = []
    for t in focus_texts:
        if folded(t):
            met = _holds(files, symbols, t) if symbols is not None else files.filter(ascii_lower(F.col("path")).contains(folded(t)))
            parts.append(met.select("path", F.lit(1).alias("t"), F.lit(0).alias("p")))
    for p in focus_paths:
        parts.append(files.filter(focus_covers(F.col("path"), [p])).select("path", F.lit(0).alias("t"), F.lit(1).alias("p")))
    if not parts:
        return files.select("path", F.lit(0).alias("texts"), F.lit(0).alias("paths")).limit(0)
    every = parts[0]
    for x in parts[1:]:
        every = every.unionByName(x)
    return every.groupBy("path").agg(F.sum("t").alias("texts"), F.sum("p").alias("paths"))


def file_scores(files: DataFrame, centrality: DataFrame, proximity: DataFrame | None = None, direct: DataFrame | None = None, weights: DataFrame | None = None, focus_texts: list[str] = (), focus_paths: list[str] = (), symbols: DataFrame | None = None) -> DataFrame:
    """``(path, score, ...)`` of the parts: centrality, nearness to seeds, direct matches, history, focus on paths, names and contexts."""
    out = files.select("path").join(centrality.select("path", F.col("score").alias("centrality")), "path", "left")
    out = out.join(proximity.select("path", F.col("score").alias("proximity")), "path", "left") if proximity is not None else out.withColumn("proximity", F.lit(0))
    out = out.join(direct.select("path", "direct"), "path", "left") if direct is not None else out.withColumn("direct", F.lit(0))
    out = out.join(weights.select("path", "weight"), "path", "left") if weights is not None else out.withColumn("weight", F.lit(0))
    out = out.join(focus_hits(files, symbols, focus_texts, focus_paths), "path", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    parts = out.select("path", zero("centrality").alias("centrality"), zero("proximity").alias("proximity"), (zero("direct") * DIRECT).alias("direct"), (F.least(zero("weight"), F.lit(HISTORY_MOST)) * HISTORY).alias("history"), (zero("texts") * TEXT_FOCUS + zero("paths") * PATH_FOCUS).cast("long").alias("focus"))
    return parts.withColumn("score", F.col("centrality") + F.col("proximity") + F.col("direct") + F.col("history") + F.col("focus")).select("path", "score", "centrality", "proximity", "direct", "history", "focus")


def personalisation(nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """``(node, p)``: the seeds' nodes share one evenly; without any, all nodes do."""
    own = nodes.select("node").distinct().join(seeds.select("node").distinct().withColumn("seed", F.lit(True)), "node", "left")
    total = own.agg(F.count("*").alias("all"), F.count("seed").alias("seeds"))  # one row
    few = total.select(F.when(F.col("seeds") > 0, F.col("seeds")).otherwise(F.col("all"))).scalar()
    none = total.select(F.col("seeds") == 0).scalar()
    return own.select("node", F.when(F.col("seed") | none, F.lit(1.0) / few).otherwise(0.0).alias("p"))


def strong_files(files: DataFrame, symbols: DataFrame, scores: DataFrame, edges: DataFrame, entry_points: Column | None = None) -> DataFrame:
    """Files worth a snippet, with ``score``, ``role``, ``generated`` and ``task_relevant``.

    A file is strong by direct evidence of the task (``direct`` or ``focus``), by
    history, by an edge, by its role, or by a public symbol; a classified file
    only by the task.
    """
    linked = edges.select(F.explode(F.array("source", "target")).alias("path")).distinct().withColumn("linked", F.lit(True))
    public = symbols.filter("visibility = 'public'").select("path").distinct().withColumn("public", F.lit(True))
    met = files.join(scores.select("path", "score", "direct", "history", "focus"), "path", "left").join(linked, "path", "left").join(public, "path", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    met = met.withColumn("task_relevant", (zero("direct") > 0) | (zero("focus") > 0)).withColumn("role", snippet_role(F.col("path"), entry_points)).withColumn("generated", F.size(path_classes(F.col("path"))) > 0)
    strong = F.col("task_relevant") | (zero("history") > 0) | F.col("linked").isNotNull() | (F.col("role") != "source") | F.col("public").isNotNull()
    kept = met.filter(strong & (~F.col("generated") | F.col("task_relevant")))
    return kept.withColumn("score", zero("score").cast("long")).drop("direct", "history", "focus", "linked", "public")


# What a definition adds to its file's score (fixed values).
A_REFERENCE, A_FOCUS, A_SEED = 1_000, 250_000, 300_000


def snippet_candidates(strong: DataFrame, symbols: DataFrame, references: DataFrame, focus_texts: list[str] = (), seeds: list[str] = ()) -> DataFrame:
    """The definition that stands for each strong file, with its ``score``: the file's, and what references, focus and seeds add.

    The highest score stands, then the first by place and name.
    """
    own = symbols.filter("role = 'definition'").join(strong, "path").join(references.select(F.col("target").alias("path"), F.col("symbol").alias("name"), "references"), ["path", "name"], "left")
    low = ascii_lower(F.col("name"))
    context = ascii_lower(F.coalesce("context", F.lit("")))
    whole = ascii_lower(F.concat_ws("::", "scope", "name")) if "scope" in symbols.columns else low
    focus = sum(((low.contains(folded(t)) | context.contains(folded(t))).cast("int") for t in focus_texts if folded(t)), F.lit(0))
    seed = sum((((low == folded(t)) | (whole == folded(t))).cast("int") for t in seeds), F.lit(0))
    score = F.col("score") + F.coalesce("references", F.lit(0)) * A_REFERENCE + focus * A_FOCUS + seed * A_SEED
    ranked = own.withColumn("score", score.cast("long"))
    order = [F.desc("score"), F.asc("line"), F.asc("column"), F.asc("name")]
    return ranked.withColumn("rn", F.row_number().over(Window.partitionBy("path").orderBy(*order))).filter("rn = 1").drop("rn")


def best_definitions(symbols: DataFrame, references: DataFrame) -> DataFrame:
    """The definition that stands for each file: most referred to, then public, then by place."""
    counted = symbols.filter("role = 'definition'").join(references.select(F.col("target").alias("path"), F.col("symbol").alias("name"), "references"), ["path", "name"], "left")
    order = [F.coalesce("references", F.lit(0)).desc(), (F.col("visibility") == "public").desc(), F.asc("ord")]
    return counted.withColumn("rn", F.row_number().over(Window.partitionBy("path").orderBy(*order))).filter("rn = 1").drop("rn")


#: Bonus of a file's role, after the discounts (fixed values).
ROLE_BONUS = {"entry_point": 1_000_000, "gateway": 750_000, "test": 500_000, "source": 0}


def _tokens(text: str) -> int:
    return max(1, -(-len(text) // 4))


def fit_snippet(row: dict, budget: int) -> tuple[str, int, bool] | None:
    """``(context, cost, truncated)`` of a snippet within a budget: whole, else the longest beginning with an ellipsis, else None."""
    head = f"{row['path']} {row['kind']} {row['name']} {row['line']}:{row['column']}-{row['end_line']}:{row['end_column']} {'::'.join(row['scope'] or []) or 'root'} "
    cost = _tokens(head + row["context"])
    if cost <= budget:
        return row["context"], cost, False
    room = 4 * budget - len(head) - 1
    if room < 0:
        return None
    context = row["context"][:room] + "…"
    return context, _tokens(head + context), True


def choose_snippets(candidates: list[dict], budget: int, most: int = 5) -> list[dict]:
    """Up to ``most`` snippets within a token budget, from bounded candidates, one a file.

    Each step takes the greatest score that fits what is left, then the smallest
    cost, then the first by score, path, place and name.  A file that the task names
    keeps its score; others are discounted: half where partial, a quarter where
    generated, a third where their subsystem, two thirds where their language and
    three quarters where their root is chosen already and another one is still to
    be had; then the role adds its bonus.
    """
    left, chosen, used = list(candidates), [], 0
    place = lambda c: (-c["score"], c["path"], c["line"], c["column"], c["end_line"], c["end_column"], c["name"])
    while left and len(chosen) < most:
        taken = {k: {c[k] for c in chosen if c[k] is not None} for k in ("subsystem", "language", "project_root")}
        more = {k: any(c[k] is not None and c[k] not in taken[k] for c in left) for k in taken}

        def worth(c: dict) -> int:
            score = c["score"]
            if c["task_relevant"]:
                return score
            score = score // 2 if c["partial"] else score
            score = score // 4 if c["generated"] else score
            for k, times, parts in (("subsystem", 1, 3), ("language", 2, 3), ("project_root", 3, 4)):
                if more[k] and c[k] in taken[k]:
                    score = score * times // parts
            return score + ROLE_BONUS[c["role"]]

        fitting = [(c, f) for c in left if (f := fit_snippet(c, budget - used)) is not None]
        if not fitting:
            break
        best, (context, cost, truncated) = min(fitting, key=lambda x: (-worth(x[0]), x[1][1], place(x[0])))
        chosen.append({**best, "context": context, "cost": cost, "truncated": truncated})
        left.remove(best)
        used += cost
    return chosen
