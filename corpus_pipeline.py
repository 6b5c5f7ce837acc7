"""The corpus pipeline: documents through five of the training-data operators.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run``
writes each stage's rows to the shared folder and hands them to the next reread.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.functions.stage import drop_stage, write_stage
from marlstone.llm import bpe, decontaminate, near, quality, substring
from marlstone.llm.common import table, whole_texts
from marlstone.llm.queries import RULES, vocabulary


@whole_texts
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.apply_quality(docs, RULES)


@whole_texts
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8) stays, the one with the smallest id.

    Operator 6's fingerprints and pivot tables link first, minimum hashes find what 64 bits leave apart.
    """
    return near.similar_dedup(docs)


@whole_texts
def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings that an earlier document holds are cut out; documents left empty go."""
    return substring.drop_repeats(docs)


@whole_texts
def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


@whole_texts
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text as token ids, with digests of the ids and of the decoded bytes."""
    return bpe.encode_documents(docs, *vocabulary(), with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("benchmark_leaks", benchmark_leaks),
    ("tokens", tokens),
]

#: Byte-pair merges and components of near copies are beyond SQL; a test holds every stage and the whole against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, read = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = write_stage(stage(spark, docs, sf_dir), name)
        if read is not None:
            drop_stage(spark, read)  # the next table is written
        read = path
    return STAGES[-1][1](spark, docs, sf_dir)
