"""Fitting a report of several collections into a size, without rendering it again and again.

A report is a JSON object of arrays.  Each item's size is measured once, where its
row lies; what a report would take with other cuts is then sums of these
sizes, which Spark adds up as running totals over all collections at once.
The driver holds a few numbers for each collection, never items.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions.stage import dealt, drop_stage, write_stage
from marlstone.operators.budget import fitting_rounds

#: The order in which collections give up items, at usual budgets and at those under ``SMALL_TOKENS`` (fixed values).
POP_ORDER = ["findings", "edges", "ranking", "files", "omissions", "landmarks", "project_roots", "snippets"]
SMALL_POP_ORDER = ["findings", "snippets", "edges", "ranking", "files", "omissions"]
SMALL_TOKENS, TINY_TOKENS = 256, 20
#: What halving leaves at least (fixed values): symbols of a file first, then all of these at once, then files.
SYMBOLS_LEAST, FILES_LEAST = 16, 8
HALVED = {"omissions": 16, "findings": 16, "edges": 16, "ranking": 16, "snippets": 16, "landmarks": 16, "project_roots": 8}
MOST_JSON_BYTES = 4 << 20


def placed(rows: DataFrame, order: list[Column]) -> tuple[DataFrame, str]:
    """Rows with ``place``, 0 and on in a total order, and the path of their table.

    The sort's partitions are written with their own counts; a place is the count of the partitions before and the
    position inside.  No task sees more than a partition.
    """
    sorted_, path = write_stage(rows.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "placed")
    part, inside = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    offsets = sorted_.groupBy(part.alias("__part")).agg(F.count("*").alias("n")).select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__offset"))
    found = sorted_.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    return found.withColumn("place", F.col("__offset") + inside).drop("__at", "__part", "__offset"), path


def running_total(rows: DataFrame, order: list[Column], value: str) -> tuple[DataFrame, str]:
    """Rows with ``before``, the sum of ``value`` over all earlier rows of a total order, and the path of their table.

    As in ``placed``: running sums inside the sort's partitions, and what the partitions before hold.
    """
    sorted_, path = write_stage(rows.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "running")
    cut = sorted_.withColumn("__part", F.shiftright("__at", 33))
    parts = cut.groupBy("__part").agg(F.sum(value).alias("n")).select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__offset"))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return cut.join(F.broadcast(parts), "__part").withColumn("before", F.col("__offset") + inside).drop("__at", "__part", "__offset"), path


@dataclass(frozen=True)
class Collection:
    """Items of a report: rows in a total order, and how much JSON each takes.

    In ``fill_sections`` ``rows`` may be a function of the rows that earlier sections keep, by name.
    """

    name: str
    rows: DataFrame | Callable[[dict[str, DataFrame]], DataFrame]
    order: list[Column]
    size: Column


def json_chars(*columns: str) -> Column:
    """Characters of the JSON object that columns make; nulls are left out."""
    return F.length(F.to_json(F.struct(*columns))).cast("long")


def json_bytes(*columns: str) -> Column:
    """Bytes of that object in UTF-8."""
    return F.octet_length(F.to_json(F.struct(*columns))).cast("long")


def frame_size(names: list[str]) -> int:
    """What the object takes with all arrays empty: ``{"a":[],"b":[]}``."""
    return 2 + max(0, len(names) - 1) + sum(len(n) + 5 for n in names)


def _measured(collections: list[Collection]) -> tuple[DataFrame, list[str]]:
    """``(name, place, size)`` of all items, where ``size`` has the comma before an item, and the paths to drop."""
    out, paths = None, []
    for c in collections:
        rows, path = placed(c.rows.withColumn("__size", c.size), c.order)
        paths.append(path)
        own = rows.select(F.lit(c.name).alias("name"), "place", (F.col("__size") + F.when(F.col("place") > 0, 1).otherwise(0)).alias("size"))
        out = own if out is None else out.unionByName(own)
    return out, paths


def _counts(spark: SparkSession, totals: dict[str, int], kept: dict[str, int], reason: str) -> DataFrame:
    rows = [(n, t, kept[n], kept[n] < t, reason if kept[n] < t else None) for n, t in totals.items()]
    return spark.createDataFrame(rows, "name string, total long, returned long, truncated boolean, reason string")


def compact_bound(collections: list[Collection], tokens: int) -> DataFrame:
    """``(name, total, returned, truncated, reason)``: how many items each collection keeps under a token budget.

    As if items were popped one at a time, always from the end of the first collection in
    ``POP_ORDER`` that has some, until the JSON's characters make at most ``tokens`` (four characters
    each, rounded up).  Under ``SMALL_TOKENS`` each collection of ``SMALL_POP_ORDER`` keeps one item at first; if that is still
    too much, findings and omissions go, and then snippets or, under ``TINY_TOKENS``, edges and ranking.
    The items in the order of popping are one list, and those popped are its shortest prefix that is large
    enough: one running total finds it.  An empty collection keeps nothing.
    """
    spark, names = collections[0].rows.sparkSession, [c.name for c in collections]
    order, least = (SMALL_POP_ORDER, 1) if tokens < SMALL_TOKENS else (POP_ORDER, 0)
    items, paths = _measured(collections)
    sums = {r["name"]: (r["n"], r["size"]) for r in items.groupBy("name").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()}
    totals = {n: sums.get(n, (0, 0))[0] for n in names}
    excess = frame_size(names) + sum(s for _, s in sums.values()) - 4 * tokens
    kept = dict(totals)
    if excess > 0:
        turn = F.create_map(*(x for k, n in enumerate(order) for x in (F.lit(n), F.lit(k))))
        popped, path = running_total(items.filter(F.col("name").isin(order) & (F.col("place") >= least)).withColumn("turn", turn[F.col("name")]), [F.asc("turn"), F.desc("place")], "size")
        gone = popped.filter(F.col("before") < excess).groupBy("name").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()
        kept |= {r["name"]: totals[r["name"]] - r["n"] for r in gone}
        if least and sum(r["size"] for r in gone) < excess:
            cleared = ["findings", "omissions", *(["edges", "ranking"] if tokens < TINY_TOKENS else ["snippets"])]
            kept |= {n: 0 for n in cleared if n in kept}
        paths.append(path)
    for path in paths:
        drop_stage(spark, path)
    return _counts(spark, totals, kept, "output_budget")


def halvings(n: int, least: int) -> list[int]:
    """The counts that halving goes through from ``n``, rounded up and never under ``least``."""
    out = [n]
    while out[-1] > least:
        out.append(max(-(-out[-1] // 2), least))
    return out


def _symbol_halvings(symbols: DataFrame, most: int) -> DataFrame:
    """``(key, step, kept)`` from ``(key, n)``: how many symbols a file keeps after each common step."""
    steps = max(1, len(halvings(most, SYMBOLS_LEAST)))
    # Halved rounding up k times is divided by 2**k rounding up.
    kept = F.when(F.col("n") <= SYMBOLS_LEAST, F.col("n")).otherwise(F.greatest(F.lit(SYMBOLS_LEAST), F.ceil(F.col("n") / F.pow(F.lit(2), F.col("step"))))).cast("long")
    return symbols.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).withColumn("kept", kept)


def evidence_bound(collections: list[Collection], symbols: Collection, key: str, most_bytes: int = MOST_JSON_BYTES) -> DataFrame:
    """``(name, total, returned, truncated, reason)``: what stays when collections are halved until the JSON fits.

    ``collections`` hold ``files``, with a column ``key``; each file's JSON ends with an array ``symbols`` of the rows
    of ``symbols`` with its key, in their order.  A step halves the symbols of all files with over 16;
    where none has, all other collections; where none of these can, files.  All cuts that steps can
    reach are known beforehand, so one job sums sizes up to each of them and the steps are walked over these sums.
    """
    spark, names = collections[0].rows.sparkSession, [c.name for c in collections]
    files = next(c for c in collections if c.name == "files")
    per_file = symbols.rows.groupBy(key).agg(F.count("*").alias("n"))
    per_file, per_path = write_stage(files.rows.select(key).join(per_file, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n")), "symbols_of_files")
    most, every = (x or 0 for x in per_file.agg(F.max("n"), F.sum("n")).first())
    # Sizes are measured before symbols are dealt, so only these, keys and what orders them are sorted.
    sizes = dealt(symbols.rows.withColumn("size", symbols.size + 1), every, key)
    numbered = sizes.select(key, "size", F.row_number().over(Window.partitionBy(key).orderBy(*symbols.order)).alias("nth"))
    halved = _symbol_halvings(per_file, most)
    # A file after each step: its symbols up to the cut, a comma less than symbols.
    sized = numbered.join(halved, key).filter(F.col("nth") <= F.col("kept")).groupBy(key, "step").agg((F.sum("size") - 1).alias("symbols_size"))
    steps = len(halvings(most, SYMBOLS_LEAST)) or 1
    per_step = halved.join(sized, [key, "step"], "left").groupBy(key).agg(*(F.max(F.when(F.col("step") == k, F.coalesce("symbols_size", F.lit(0)))).alias(f"s{k}") for k in range(steps)))
    frame = len(',"symbols":[]')
    rows, file_path = placed(files.rows.withColumn("__size", files.size + frame).join(per_step, key), files.order)
    comma = F.when(F.col("place") > 0, 1).otherwise(0)
    items, paths = _measured([c for c in collections if c.name != "files"]) if len(collections) > 1 else (None, [])

    # One job each: sums of all collections at every cut, of files at every step and cut, of symbols at every step.
    count = {r["name"]: r["n"] for r in items.groupBy("name").agg(F.count("*").alias("n")).collect()} if items is not None else {}
    total = {n: count.get(n, 0) for n in names}
    total["files"] = rows.count()
    cuts = {n: halvings(total[n], HALVED.get(n, 0) if n != "files" else FILES_LEAST) for n in names}
    size: dict[tuple[str, int], int] = {}
    if items is not None:
        asked = [(n, r) for n in names if n != "files" for r in cuts[n]]
        asked_rows = spark.createDataFrame(asked, "name string, cut long") if asked else None
        if asked_rows is not None:
            found = items.join(F.broadcast(asked_rows), "name").filter(F.col("place") < F.col("cut")).groupBy("name", "cut").agg(F.sum("size").alias("size"))
            size = {(r["name"], r["cut"]): r["size"] for r in found.collect()}
    file_sums = rows.agg(*(F.sum(F.when(F.col("place") < cut, F.col("__size") + comma + F.col(f"s{k}"))).alias(f"f{k}_{j}") for k in range(steps) for j, cut in enumerate(cuts["files"]))).first()
    symbol_sums = halved.groupBy("step").agg(F.sum("kept").alias("n")).collect()
    symbols_at = {r["step"]: r["n"] for r in symbol_sums} or {0: 0}

    step, now, file_cut = 0, {n: 0 for n in names if n != "files"}, 0

    def taken() -> int:
        return frame_size(names) + sum(size.get((n, cuts[n][k]), 0) for n, k in now.items()) + (file_sums[f"f{step}_{file_cut}"] or 0)

    while taken() > most_bytes:
        if step + 1 < steps and symbols_at[step + 1] < symbols_at[step] and not file_cut:
            step += 1
            continue
        more = [n for n, k in now.items() if n in HALVED and k + 1 < len(cuts[n])]
        for n in more:
            now[n] += 1
        if not more:
            if file_cut + 1 >= len(cuts["files"]):
                break
            file_cut += 1
    kept = {n: cuts[n][k] for n, k in now.items()} | {"files": cuts["files"][file_cut]}
    in_files = rows.filter(F.col("place") < kept["files"]).join(halved.filter(F.col("step") == step), key).agg(F.sum("kept")).first()[0] or 0
    total["symbols"], kept["symbols"] = symbols_at[0], in_files
    for path in [*paths, per_path, file_path]:
        drop_stage(spark, path)
    return _counts(spark, total, kept, "output_budget")


def fill_sections(sections: list[Collection], tokens: int) -> tuple[dict[str, DataFrame], DataFrame]:
    """The rows that unlike sections keep under one token budget, and ``(name, total, returned, truncated, reason)``.

    Sections are filled one after another: each item in its section's order is added if the JSON of all
    that is in then still fits, and passed over if not.  The first item that a section takes needs no
    comma, all others do; so it is looked for by itself, and the rest are taken by rounds of running
    totals over the section (``budget.fitting_rounds``).  The driver holds what is left of the budget.
    """
    left, kept, counts = 4 * tokens - frame_size([s.name for s in sections]), {}, {}
    for s in sections:
        rows = s.rows(kept) if callable(s.rows) else s.rows
        ranked, _ = write_stage(rows.withColumn("__size", s.size).orderBy(*s.order).withColumn("__place", F.monotonically_increasing_id()), s.name)
        first = ranked.filter(F.col("__size") <= left).agg(F.min(F.struct("__place", "__size")).alias("first")).first()["first"] if left > 0 else None
        if first is None:
            own = ranked.filter(F.lit(False))
        else:
            left -= first["__size"]
            rest = ranked.withColumn("__cost", F.col("__size") + 1).filter(F.col("__place") > first["__place"])
            taken = F.lit(False)
            for after, stop, had, large in fitting_rounds(rest, "__cost", left):
                inside = (F.col("__place") > after) & (F.col("__cost") * 2 <= had)
                taken |= inside if stop is None else inside & (F.col("__place") <= stop)
                if large:
                    taken |= F.col("__place") == stop
            more = rest.filter(taken)
            left -= more.agg(F.coalesce(F.sum("__cost"), F.lit(0))).first()[0]
            own = ranked.filter(F.col("__place") == first["__place"]).unionByName(more.drop("__cost"))
        kept[s.name] = own.drop("__size", "__place")
        counts[s.name] = (ranked.count(), own.count())
    return kept, _counts(rows.sparkSession, {n: t for n, (t, _) in counts.items()}, {n: k for n, (_, k) in counts.items()}, "token_budget")
