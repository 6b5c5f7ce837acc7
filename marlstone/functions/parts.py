"""A table in numbered buckets, of which an update writes only those it touches.

A bucket's part is never changed: a new one lies beside it under the next
generation, and a small table says which generation of each bucket holds.  It is
written last, so an update that fails leaves the table as it was.  Rows are not
shuffled: a bucket has a file of each task that holds some of it, however large it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.stage import drop_stage


class BucketedTable:
    """Rows with a column ``bucket``, in the folder ``path``."""

    def __init__(self, spark: SparkSession, path: str, schema: str, order: list[str]):
        self.spark, self.path, self.schema, self.order = spark, path, schema, order

    def _exists(self, path: str) -> bool:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def parts(self) -> tuple[int, dict[int, int]]:
        """The last generation, and the generation of each bucket."""
        last = -1
        while self._exists(f"{self.path}/parts={last + 1}/_SUCCESS"):
            last += 1
        if last < 0:
            raise FileNotFoundError(self.path)
        return last, {r["bucket"]: r["generation"] for r in self.spark.read.schema("bucket int, generation int").parquet(f"{self.path}/parts={last}").collect()}

    def _write(self, rows: DataFrame, generation: int, parts: dict[int, int]) -> list[int]:
        where = f"{self.path}/g={generation}"
        rows.sortWithinPartitions("bucket", *self.order).write.mode("overwrite").partitionBy("bucket").parquet(where)  # what a failed update left goes
        made = sorted(r[0] for r in self.spark.read.schema(self.schema).parquet(where).select("bucket").distinct().collect())  # numbers, one a bucket
        rows = sorted((parts | {b: generation for b in made}).items())
        self.spark.createDataFrame(rows, "bucket int, generation int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/parts={generation}")
        return made

    def create(self, rows: DataFrame) -> list[int]:
        """Write all rows; returns the buckets."""
        return self._write(rows, 0, {})

    def replace(self, buckets: list[int], rows: DataFrame) -> None:
        """Put ``rows`` in place of all that some buckets hold."""
        generation, parts = self.parts()
        self._write(rows, generation + 1, parts | {b: generation + 1 for b in buckets})

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets: only their folders are read."""
        _, parts = self.parts()
        out = None
        for generation in sorted(set(parts.values())):
            own = [b for b, g in parts.items() if g == generation and (buckets is None or b in set(buckets))]
            if own:
                rows = self.spark.read.schema(self.schema).parquet(f"{self.path}/g={generation}").filter(F.col("bucket").isin(own))
                out = rows if out is None else out.unionByName(rows)
        return self.spark.createDataFrame([], self.schema) if out is None else out

    def drop(self) -> None:
        drop_stage(self.spark, self.path)
