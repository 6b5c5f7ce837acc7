"""Stored state: parse caches, indexes and task records as parquet tables."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions.stage import drop_stage
from marlstone.operators.budget import retention

CACHE_SCHEMA, INDEX_SCHEMA = 2, 3
CACHE_ROWS, CACHE_BYTES, CACHE_DAYS = 256, 32 << 20, 30


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def write_cache(records: DataFrame, path: str) -> None:
    """Append records ``(id, repo, path, fingerprint, pack, modified, bytes, ...)``; readers take the newest of a fingerprint."""
    records.withColumn("schema", F.lit(CACHE_SCHEMA)).write.mode("append").partitionBy("repo").parquet(path)


def read_cache(spark: SparkSession, path: str, repo: str) -> DataFrame:
    """The newest record of each (path, fingerprint, pack) of a repository, of this schema only."""
    own = spark.read.parquet(path).filter((F.col("repo") == repo) & (F.col("schema") == CACHE_SCHEMA))
    rest = [c for c in own.columns if c not in ("path", "fingerprint", "pack")]
    return own.groupBy("path", "fingerprint", "pack").agg(F.max_by(F.struct(*rest), F.struct("modified", "id")).alias("r")).select("path", "fingerprint", "pack", "r.*")


def cache_status(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("repo").agg(F.count("*").alias("records"), F.sum("bytes").alias("bytes"), F.max("modified").alias("newest"))


def prune_cache(spark: SparkSession, path: str, now: int, into: str) -> None:
    """Write the records that retention keeps to ``into``: newest first, by count, size and age."""
    records = spark.read.parquet(path)
    kept = retention(records, "repo", CACHE_ROWS, CACHE_BYTES, oldest=F.lit(now - CACHE_DAYS * 86_400))
    kept.write.mode("overwrite").partitionBy("repo").parquet(into)


def clear_cache(spark: SparkSession, path: str) -> None:
    drop_stage(spark, path)


def _digest(rows: DataFrame) -> DataFrame:
    """``(rows, sum, mix)`` of a table, whatever its order: counts and sums of hashes, added up in parts."""
    h = F.xxhash64(*rows.columns)
    return rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("sum"), F.coalesce(F.bit_xor(F.xxhash64(h, F.lit(1))), F.lit(0)).alias("mix"))


def publish_index(postings: DataFrame, path: str, analysis: dict[str, str], state: dict[str, str]) -> str:
    """Store postings and publish them by a pointer that is written last; returns ``refreshed``.

    The pointer names the folder of the postings and holds their digest, the options of the
    ``analysis`` that made them and the ``state`` of what was read.  A publication that fails leaves the one before.
    """
    spark, part = postings.sparkSession, uuid.uuid4().hex
    postings.write.parquet(f"{path}/postings-{part}")
    seen = _digest(spark.read.schema(postings.schema).parquet(f"{path}/postings-{part}")).first().asDict()
    pointer = json.dumps({"schema": INDEX_SCHEMA, "part": part, "columns": postings.schema.json(), "digest": seen, "analysis": analysis, "state": state}, sort_keys=True)
    spark.createDataFrame([(pointer,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/pointer")
    return "refreshed"


def index_state(spark: SparkSession, path: str | None, analysis: dict[str, str], state: dict[str, str]) -> tuple[str, DataFrame | None]:
    """``(status, postings)`` of a stored index; postings only for ``hit`` and ``stale``.

    ``bypassed`` without a path; ``missing`` without a pointer; ``failed`` where it can't be read; ``corrupt`` where it is no pointer, or
    postings are gone or don't have its digest; ``incompatible`` for another schema or analysis; ``stale`` where what was read has changed since; else ``hit``.
    """
    if path is None:
        return "bypassed", None
    if not exists(spark, f"{path}/pointer"):
        return "missing", None
    try:
        lines = [r[0] for r in spark.read.text(f"{path}/pointer", wholetext=True).collect()]
    except (PySparkException, Py4JJavaError):
        return "failed", None
    try:
        told = json.loads("".join(lines))
        kind, part, digest = T.StructType.fromJson(json.loads(told["columns"])), told["part"], told["digest"]
        known, own, schema = told["analysis"], told["state"], told["schema"]
    except (ValueError, KeyError, TypeError):
        return "corrupt", None
    if schema != INDEX_SCHEMA or known != analysis:
        return "incompatible", None
    try:
        rows = spark.read.schema(kind).parquet(f"{path}/postings-{part}")
        if _digest(rows).first().asDict() != digest:
            return "corrupt", None
    except (PySparkException, Py4JJavaError):
        return "corrupt", None
    return ("hit" if own == state else "stale"), rows


def add_task_record(spark: SparkSession, path: str, task_id: str, now: int, body: str) -> None:
    """Append a task record; an id that is there is refused and never overwritten."""
    where = f"{path}/id={task_id}"
    if exists(spark, where):
        raise FileExistsError(task_id)
    spark.createDataFrame([(now, body)], "recorded long, body string").coalesce(1).write.mode("errorifexists").json(where)
