"""Cutting lineage with written tables in the folder the cluster shares.

Iterative operators (graph walks, components, rank propagation) need their
state on storage that outlives any executor.  ``write_stage`` writes a parquet
table under ``spark.checkpoint.dir`` and reads it back; ``drop_stage`` removes
one that no later plan reads.  Only where the setting is absent and the master is
local (unit tests) a private folder is created and removed at exit; a cluster
without the setting is an error, for its machines share no private folder.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

BATCH_ROWS = 1000
#: Rows of a part that is sorted or grouped.
PART_ROWS = 1 << 19
_local: list[str] = []
_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or, under a local master, a private one if it is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="marlstone-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return f"file://{_local[0]}"


def stage_path(spark: SparkSession, label: str) -> str:
    """A new place in the shared folder."""
    return f"{shared_dir(spark)}/marlstone/{label}-{uuid.uuid4().hex}"


def write_stage(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` as parquet in the shared folder; return it reread, and its path."""
    spark = df.sparkSession
    path = stage_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` by ``keys`` in as many parts as leave each ``PART_ROWS`` of ``rows``, so that a task holds no more in a larger table.

    Where the session's shuffle partitions are enough, ``df`` as it is: the shuffle that follows deals it.
    """
    parts = -(-rows // PART_ROWS)
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def write_buckets(df: DataFrame, parts: int, key: str, label: str) -> tuple[DataFrame, str, str]:
    """Write ``df`` in ``parts`` buckets of a column, as a table of the shared folder: a join by that column (and others, ``by_some_keys``) with rows dealt likewise doesn't shuffle it.

    Return it reread, and the table's name and path.
    """
    spark = df.sparkSession
    path = stage_path(spark, label)
    name = f"marlstone_{label}_{uuid.uuid4().hex}"
    df.repartition(parts, key).write.bucketBy(parts, key).option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name), name, path


def drop_buckets(spark: SparkSession, name: str, path: str) -> None:
    """Delete a table that ``write_buckets`` made."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    drop_stage(spark, path)


@contextmanager
def by_some_keys(spark: SparkSession) -> Iterator[None]:
    """For the jobs run inside: sides that are dealt alike by some of a join's keys are joined as they lie."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def growing(df: DataFrame) -> DataFrame:
    """``df`` for joins by shuffle and sort, never by a copy that the driver collects and sends to all tasks.

    Spark takes rows that a few keys or a packed file become for as small as these, so it would send tables that grow with the input.
    """
    return df.hint("merge")


def drop_stage(spark: SparkSession, path: str) -> None:
    """Delete a table that ``write_stage`` made."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def import_on_workers(spark: SparkSession) -> None:
    """Let Python workers import this package: a cluster gets it as an archive, once a session's context."""
    sc, root = spark.sparkContext, Path(__file__).resolve().parents[1]
    sc.environment.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")  # gives freed batches back
    if sc.master.startswith("local"):
        paths = [p for p in sc.environment.get("PYTHONPATH", "").split(":") if p]
        if str(root.parent) not in paths:
            sc.environment["PYTHONPATH"] = ":".join([*paths, str(root.parent)])
    elif sc.applicationId not in _shipped:
        _shipped.add(sc.applicationId)
        made = Path(tempfile.mkdtemp(prefix="marlstone-"))
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        archive = made / f"{root.name}.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(str(archive))  # the driver serves it


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Send Python workers at most ``rows`` rows at once, unless the session was given its own size.

    For jobs whose rows hold whole documents; callers ask for it, operators don't.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not spark.sparkContext.getConf().contains(key):
        spark.conf.set(key, rows)
