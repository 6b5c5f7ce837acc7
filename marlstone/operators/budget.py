"""Pages, prefix budgets, skip-greedy budgets and caps on documented orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.stage import write_stage

PAGE_DEFAULT, PAGE_MOST = 20, 256


def page(df: DataFrame, order: list[Column], offset: int = 0, limit: int = PAGE_DEFAULT) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of a total order.

    The cut is a distributed top-k; only its rows meet in one task.
    """
    if not 1 <= limit <= PAGE_MOST or offset < 0:
        raise ValueError(f"a page has 1 to {PAGE_MOST} rows and begins at 0 or later")
    return df.orderBy(*order).limit(offset + limit).orderBy(*order).offset(offset)


def page_summary(total: int, offset: int, returned: int) -> dict:
    """Totals of a page and where the next one begins."""
    more = offset + returned < total
    return {"total": total, "returned": returned, "truncated": more, "continuation": offset + returned if more else None}


def prefix_budget(df: DataFrame, order: list[Column], chars: Column, tokens: int, most: int = PAGE_MOST) -> DataFrame:
    """The longest prefix whose JSON array of ``chars`` a row stays within a token budget.

    An array of rows costs its characters, a comma between two, and brackets; a
    token is four characters, rounded up.  At most ``most`` rows come into question.
    """
    first = df.withColumn("__chars", chars).orderBy(*order).limit(most)
    so_far = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    cost = F.ceil((F.lit(2) + F.sum("__chars").over(so_far) + F.row_number().over(Window.orderBy(*order)) - 1) / 4)
    return first.withColumn("cost", cost.cast("long")).filter(F.col("cost") <= tokens).drop("__chars")


def skip_greedy(df: DataFrame, order: list[Column], cost: Column, budget: int) -> DataFrame:
    """Rows taken in order while they fit, passing over those that don't, to the end of the table."""
    return taken_while_fitting(df.withColumn("__cost", cost.cast("long")), order, "__cost", budget).drop("__cost")


def taken_while_fitting(rows: DataFrame, order: list[Column], cost: str, budget: int) -> DataFrame:
    """The rows that a fold over the whole table takes: each whose cost fits what is left.

    The table is sorted once, distributed, and written with a place for each row.  Rounds of running totals then stand
    in for the fold (``fitting_rounds``); what they took is a condition on place and cost, so no row passes the driver.
    A cost of nothing or less always fits and takes nothing.
    """
    ranked, _ = write_stage(rows.orderBy(*order).withColumn("__place", F.monotonically_increasing_id()), "ranked")
    taken = F.col(cost) <= 0
    for after, stop, left, large in fitting_rounds(ranked, cost, budget):
        inside = (F.col("__place") > after) & (F.col(cost) > 0) & (F.col(cost) * 2 <= left)
        taken |= inside if stop is None else inside & (F.col("__place") <= stop)
        if large:
            taken |= F.col("__place") == stop
    return ranked.filter(taken).drop("__place")


def fitting_rounds(ranked: DataFrame, cost: str, budget: int) -> list[tuple[int, int | None, int, bool]]:
    """``(after, stop, left, large)`` of rounds over rows with a ``__place``: each takes the rows after a place up to another that cost at most half of what is left, and the row at ``stop`` too if it is ``large``.

    Rows that cost over half of what is left can be taken once a round at most; the first that fits beside the
    small ones before it ends the round, as does the small row at which half is used.  Either halves what is
    left, so there are at most as many rounds as the budget has bits.  The driver holds a place and a sum.
    """
    out, after, left = [], -1, budget
    while left > 0:
        small = F.when(F.col(cost) * 2 <= left, F.col(cost)).otherwise(0)
        some = ranked.filter((F.col("__place") > after) & F.col(cost).between(1, left)).select("__place", F.col(cost).alias("n"), small.alias("small"), F.shiftright("__place", 33).alias("part"))
        parts = some.groupBy("part").agg(F.sum("small").alias("sum"))
        offsets = parts.select("part", F.coalesce(F.sum("sum").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))  # a row a partition
        inside = F.coalesce(F.sum("small").over(Window.partitionBy("part").orderBy("__place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        used = F.col("offset") + F.col("inside") + F.col("n")
        ends = F.when(F.col("small") > 0, used * 2 > left).otherwise(used <= left)
        stop = some.withColumn("inside", inside).join(F.broadcast(offsets), "part").filter(ends).agg(F.min(F.struct("__place", used.alias("used"), (F.col("small") == 0).alias("large"))).alias("stop")).first()["stop"]
        if stop is None:
            out.append((after, None, left, False))
            break
        out.append((after, stop["__place"], left, stop["large"]))
        after, left = stop["__place"], left - stop["used"]
    return out


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each key; each task keeps no more than that before the shuffle."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("__rn") <= most).drop("__rn")


def first_rows(df: DataFrame, order: list[Column], most: int) -> DataFrame:
    """A cap on a documented order."""
    return df.orderBy(*order).limit(most)


def collection_summary(df: DataFrame, cap: int) -> DataFrame:
    """``(total, returned, truncated, reason)`` of a capped collection."""
    n = df.agg(F.count("*").alias("total"))
    cut = F.col("total") > cap
    return n.select("total", F.least("total", F.lit(cap).cast("long")).alias("returned"), cut.alias("truncated"), F.when(cut, "collection_limit").alias("reason"))


def retention(records: DataFrame, key: str, most: int = 256, most_bytes: int = 32 << 20, oldest: Column | None = None) -> DataFrame:
    """Cache records that stay: newest first per repository, under a count and a running size."""
    order = Window.partitionBy(key).orderBy(F.desc("modified"), "id").rowsBetween(Window.unboundedPreceding, 0)
    ranked = records if oldest is None else records.filter(F.col("modified") >= oldest)
    ranked = ranked.withColumn("__n", F.count("*").over(order)).withColumn("__bytes", F.sum("bytes").over(order))
    return ranked.filter((F.col("__n") <= most) & (F.col("__bytes") <= most_bytes)).drop("__n", "__bytes")
