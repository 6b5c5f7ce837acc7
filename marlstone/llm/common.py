"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.stage import small_batches

#: The separators of words in every contract here: space and the controls 9 to 13.
SPACES = " \t\n\x0b\x0c\r"
WORD_GAP = "[ \\t\\n\\x0B\\f\\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, in order; null has none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_GAP, -1))


def whole_texts(query):
    """A query or stage whose rows hold whole documents: it asks for small batches."""

    @wraps(query)
    def run(spark: SparkSession, *rest) -> DataFrame:
        small_batches(spark)
        return query(spark, *rest)

    return run


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, with ``_`` before them until none is among the columns."""
    taken, mark = {c.lower() for c in columns}, "_"
    while any(mark + n in taken for n in names):
        mark += "_"
    return [mark + n for n in names]


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, even where lambdas in ``body`` use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def give_back_memory() -> None:
    """Return what a worker has freed to the machine; idle workers stay beside the next stage's."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
