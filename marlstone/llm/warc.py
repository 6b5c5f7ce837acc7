"""WARC archives and a Merkle audit of their replicas.

A record is named by its file and offset.  Leaves of a file's tree are ordered
ranges of ``SPAN`` bytes of offsets, each the digest of its records' offsets,
lengths and digests in order; ``FANOUT`` nodes form the next.  Replicas are
compared at the roots, and only children of nodes that differ are looked at
further down, so the joins below the roots grow with the damage.

Trees are groupings with bounded groups; the record bytes are read once, for
their digests, and never shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions.stage import import_on_workers, write_stage

SPAN, FANOUT, PAGES_PER_FILE = 1 << 16, 16, 1000
END = "\r\n\r\n"


def record_text(page_id: Column, url: Column, html: Column) -> Column:
    """A response record, less the blank lines that end it; nulls are empty."""
    body = F.coalesce(html, F.lit(""))
    head = [
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit(END),
    ]
    return F.concat(*head, body)


def archive(pages: DataFrame, per_file: int = PAGES_PER_FILE) -> DataFrame:
    """``(file, offset, length, sha256, page_id)`` of the records that ``pages(page_id, url, html)`` make.

    A file holds ``per_file`` consecutive ids, in order of id and digest; rows
    without an id share file -1.
    """
    text = record_text(F.col("page_id"), F.col("url"), F.col("html"))
    records = pages.select("page_id", text.alias("text")).select(
        F.coalesce(F.floor(F.col("page_id") / per_file).cast("long"), F.lit(-1).cast("long")).alias("file"),
        F.col("page_id").cast("long").alias("page_id"),
        (F.octet_length("text") + len(END)).cast("long").alias("length"),
        F.sha2("text", 256).alias("sha256"),
    )
    before = Window.partitionBy("file").orderBy(F.col("page_id").asc_nulls_first(), "sha256").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return records.withColumn("offset", F.sum("length").over(before) - F.col("length")).select("file", "offset", "length", "sha256", "page_id")


def write_warc(pages: DataFrame, path: str, per_file: int = PAGES_PER_FILE, compression: str = "none") -> None:
    """Write pages as the WARC files of ``archive``, one folder ``file=n`` each, records in its order; compressed ones are a stream each."""
    text = record_text(F.col("page_id"), F.col("url"), F.col("html"))
    rows = pages.select(F.coalesce(F.floor(F.col("page_id") / per_file).cast("long"), F.lit(-1).cast("long")).alias("file"), F.col("page_id").cast("long").alias("page_id"), text.alias("value"))
    rows = rows.repartition("file").sortWithinPartitions("file", F.col("page_id").asc_nulls_first(), F.sha2("value", 256))
    rows.select("file", "value").write.option("lineSep", END).option("compression", compression).partitionBy("file").text(path)


def plain_bytes(data: bytes) -> bytes:
    """A file's bytes, unpacked if they are gzip, by member or whole; a damaged end is left out."""
    if data[:2] != b"\x1f\x8b":
        return data
    parts = []
    try:
        while data:
            member = zlib.decompressobj(31)
            parts.append(member.decompress(data))
            parts.append(member.flush())
            data = member.unused_data
    except zlib.error:
        pass
    return b"".join(parts)


def parse_records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """``(offset, length, headers, body)`` of the records in a file's bytes, unpacked where needed.

    Offsets are those of the uncompressed stream.  Reading ends at the first
    bytes that are no record; a record cut short has a shorter body.  A record whose
    length is missing a number, or is below nothing, ends it too: it and all that follows are one record
    of the type ``damaged``, without a body.
    """
    data = plain_bytes(data)
    at = 0
    while data.startswith(b"WARC/", at):
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        said = headers.get("content-length") or "0"
        if not (said.isascii() and said.isdigit()):
            yield at, len(data) - at, headers | {"warc-type": "damaged"}, b""
            return
        size = int(said)
        stop = min(len(data), end + 4 + size + 4)
        yield at, stop - at, headers, data[end + 4 : end + 4 + size]
        at = stop


def read_warc(spark: SparkSession, path: str, bodies: bool = True) -> DataFrame:
    """``(name, file, offset, length, sha256, uri, type, body)`` of all records of the WARC files under ``path``.

    ``file`` is the number in a folder ``file=n``, ``sha256`` the digest of a record
    without the blank lines that end it.  Bodies are left out where not asked for.
    A task holds a file at a time.
    """
    import_on_workers(spark)
    schema = "name string, file long, offset long, length long, sha256 string, uri string, type string, body binary"
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        import re

        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                number = re.search(r"file=(-?\d+)/", name.as_py())
                rows: list[tuple] = []
                data = plain_bytes(content.as_py())
                for at, size, headers, body in parse_records(data):
                    end = at + size - len(END) if data.endswith(END.encode(), at, at + size) else at + size
                    rows.append((name.as_py(), int(number.group(1)) if number else None, at, size, hashlib.sha256(data[at:end]).hexdigest(), headers.get("warc-target-uri"), headers.get("warc-type"), body if bodies else None))
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in schema.split(", ")])
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in schema.split(", ")])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInArrow(run, schema)


def _digest(order: list[str], *values: str) -> Column:
    rows = F.array_sort(F.collect_list(F.struct(*order, *values)))
    return F.sha2(F.array_join(F.transform(rows, lambda r: F.concat_ws(":", *(r[c].cast("string") for c in (*order, *values)))), ","), 256)


def merkle_tree(records: DataFrame, levels: int, span: int = SPAN, fanout: int = FANOUT) -> DataFrame:
    """``(level, file, node, hash)`` of the trees over records; level 0 has the offset ranges."""
    now = records.withColumn("node", F.floor(F.col("offset") / span)).groupBy("file", "node").agg(_digest(["offset", "length"], "sha256").alias("hash"))
    tree = now.withColumn("level", F.lit(0))
    for level in range(1, levels + 1):
        now = now.groupBy("file", F.floor(F.col("node") / fanout).alias("up")).agg(_digest(["node"], "hash").alias("hash")).withColumnRenamed("up", "node")
        tree = tree.unionByName(now.withColumn("level", F.lit(level)))
    return tree.select("level", "file", "node", "hash")


def tree_height(span: int, fanout: int, *replicas: DataFrame) -> int:
    """Levels above the ranges until every file has one node."""
    last = max(r.agg(F.max("offset")).first()[0] or 0 for r in replicas)
    nodes, height = last // span + 1, 0
    while nodes > 1:
        nodes, height = -(-nodes // fanout), height + 1
    return height


def _different(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    right = b.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col(value).alias("__value"))
    same_key = [F.col(k) == F.col(f"__{k}") for k in keys]
    joined = a.join(right, same_key, "full_outer").filter(~F.col(value).eqNullSafe(F.col("__value")))
    return joined.select(*(F.coalesce(k, f"__{k}").alias(k) for k in keys))


def audit(primary: DataFrame, replica: DataFrame, span: int = SPAN, fanout: int = FANOUT) -> DataFrame:
    """Records on which two replicas disagree: ``(file, offset, status, length, sha256, replica_length, replica_sha256)``.

    Both sides have ``(file, offset, length, sha256)``.  ``status`` is ``changed``,
    ``missing`` (not in the replica) or ``extra`` (only there).  A record whose
    length changed moves all that follow it in its file, and those differ too.
    Equal replicas, and empty ones, give no row; a null file or offset names no
    record; repeated records of one offset count as changed when their digests
    differ.
    """
    columns = "file", "offset", "length", "sha256"
    a, b = (write_stage(x.select(*columns).filter("file is not null and offset is not null").distinct(), "records")[0] for x in (primary, replica))
    height = tree_height(span, fanout, a, b)
    one, two = (write_stage(merkle_tree(x, height, span, fanout), "tree")[0] for x in (a, b))
    bad = None
    for level in range(height, -1, -1):
        sides = [t.filter(F.col("level") == level).drop("level") for t in (one, two)]
        if bad is not None:
            up = bad.select(F.col("file").alias("f"), F.col("node").alias("n"))
            sides = [s.join(up, (F.col("file") == F.col("f")) & (F.floor(F.col("node") / fanout) == F.col("n")), "left_semi") for s in sides]
        bad = _different(*sides, ["file", "node"], "hash")
    ranges = bad.select(F.col("file").alias("f"), F.col("node").alias("n"))
    a, b = (x.join(ranges, (F.col("file") == F.col("f")) & (F.floor(F.col("offset") / span) == F.col("n")), "left_semi") for x in (a, b))
    right = b.select(F.col("file").alias("rf"), F.col("offset").alias("ro"), F.col("length").alias("replica_length"), F.col("sha256").alias("replica_sha256"))
    joined = a.join(right, (F.col("file") == F.col("rf")) & (F.col("offset") == F.col("ro")), "full_outer")
    wrong = ~F.col("sha256").eqNullSafe(F.col("replica_sha256")) | ~F.col("length").eqNullSafe(F.col("replica_length"))
    status = F.when(F.col("rf").isNull(), "missing").when(F.col("file").isNull(), "extra").otherwise("changed")
    return joined.filter(wrong).select(F.coalesce("file", "rf").alias("file"), F.coalesce("offset", "ro").alias("offset"), status.alias("status"), "length", "sha256", "replica_length", "replica_sha256")
