"""A positional trigram index over texts, and fingerprints of what was indexed.

Postings are ``(bucket, trigram, path, positions)``: where a trigram (three bytes of the
text with ASCII letters in lower case, as one number) begins in a file.  They are stored by
bucket of trigram, positions as deltas: a row for each bucket and file (``packed``), so that a path stands once
a bucket and not at every trigram, written where it is made.  A search meets postings at shifted positions and reads no text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.parts import BucketedTable
from marlstone.functions.stage import import_on_workers, write_stage
from marlstone.functions.text import folded

BUCKETS = 256
_POSTINGS = "bucket int, trigram int, path string, positions array<int>"
_PACKED = "bucket int, path string, trigrams array<int>, sizes array<int>, positions array<int>"
FILES_AT_ONCE = 64
_IS_CAPITAL = np.zeros(256, np.uint8)
_IS_CAPITAL[65:91] = 32


def _grams(text: str) -> np.ndarray:
    """The trigrams of a text as numbers, in order of place."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    b = (raw + _IS_CAPITAL[raw]).astype(np.int32)
    return (b[:-2] << 16) | (b[1:-1] << 8) | b[2:] if len(b) >= 3 else b[:0]


def postings(files: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, trigram, path, positions)`` of ``files(path, text)``, positions from 0 as deltas; shorter texts have none.

    A file's postings are made where its row lies: nothing is shuffled.
    """
    import_on_workers(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch.column(0), batch.column(1), strict=True):
                grams = _grams(text.as_py() or "")
                if not len(grams):
                    continue
                at = np.argsort(grams, kind="stable").astype(np.int32)
                first = np.flatnonzero(np.diff(grams[at], prepend=-1))
                deltas = np.diff(at, prepend=np.int32(0))
                deltas[first] = at[first]
                own = grams[at[first]]
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)), pa.int32()), pa.array(deltas, pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(own % buckets, pa.int32()), pa.array(own, pa.int32()), pa.array([path.as_py()] * len(own), pa.string()), lists], ["bucket", "trigram", "path", "positions"])

    return files.select("path", "text").mapInArrow(run, _POSTINGS)


def packed(files: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``postings`` with one row a bucket and file: its ``trigrams``, how many positions each has, and all positions as deltas.  Nothing is shuffled."""
    import_on_workers(files.sparkSession)

    def one(path: str, text: str) -> pa.RecordBatch | None:
        grams = _grams(text)
        if not len(grams):
            return None
        key = (grams.astype(np.int64) % buckets << 24) | grams
        at = np.argsort(key, kind="stable").astype(np.int32)
        first = np.flatnonzero(np.diff(key[at], prepend=-1))
        deltas = np.diff(at, prepend=np.int32(0))
        deltas[first] = at[first]
        own = grams[at[first]]
        begin = np.flatnonzero(np.diff(own % buckets, prepend=-1))
        within, lists = pa.array(np.append(begin, len(own)), pa.int32()), np.append(first[begin], len(at))
        columns = [pa.array(own[begin] % buckets, pa.int32()), pa.array([path] * len(begin), pa.string())]
        columns += [pa.ListArray.from_arrays(within, pa.array(own, pa.int32())), pa.ListArray.from_arrays(within, pa.array(np.diff(np.append(first, len(at))), pa.int32()))]
        return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(lists, pa.int32()), pa.array(deltas, pa.int32()))], ["bucket", "path", "trigrams", "sizes", "positions"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, FILES_AT_ONCE):
                some = batch.slice(k, FILES_AT_ONCE)
                made = [m for path, text in zip(some.column(0), some.column(1), strict=True) if (m := one(path.as_py(), text.as_py() or ""))]
                if made:
                    yield from pa.Table.from_batches(made).combine_chunks().to_batches()

    return files.select("path", "text").mapInArrow(run, _PACKED)


def unpacked(rows: DataFrame, trigrams: list[int]) -> DataFrame:
    """``(trigram, path, positions)`` of some trigrams in rows of ``packed``."""
    import_on_workers(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, sizes, positions = (batch.column(k).flatten().to_numpy(zero_copy_only=False) for k in (1, 2, 3))
            which = np.repeat(np.arange(batch.num_rows), batch.column(1).value_lengths().to_numpy(zero_copy_only=False))
            keep = np.flatnonzero(np.isin(grams, trigrams))
            if not len(keep):
                continue
            length, begin = sizes[keep].astype(np.int64), (np.cumsum(sizes, dtype=np.int64) - sizes)[keep]
            ends = np.cumsum(length)
            taken = positions[np.repeat(begin - (ends - length), length) + np.arange(ends[-1])]
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(taken, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(grams[keep], pa.int32()), batch.column(0).take(pa.array(which[keep])), lists], ["trigram", "path", "positions"])

    return rows.select("path", "trigrams", "sizes", "positions").mapInArrow(run, "trigram int, path string, positions array<int>")


def trigram_counts(files: DataFrame) -> DataFrame:
    """``(trigram, files)`` as hex: how many texts hold each; counted in batches before they are added up."""
    import_on_workers(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << 24, np.int32)
        for batch in batches:
            for text in batch.column(0):
                counts[np.unique(_grams(text.as_py() or ""))] += 1
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used], pa.int64())], ["g", "n"])

    found = files.select("text").mapInArrow(run, "g int, n long").groupBy("g").agg(F.sum("n").alias("files"))
    return found.select(F.lower(F.lpad(F.hex("g"), 6, "0")).alias("trigram"), "files")


def find_in_postings(index: DataFrame, query: str) -> DataFrame:
    """``(path)`` of the files whose folded text holds the folded query; under three bytes none.

    Every trigram of the query must begin at one common place plus its own offset: postings are
    moved by the offset and met at equal places.  Files that lack one of the trigrams are left out first.
    """
    raw = folded(query).encode()
    spark = index.sparkSession
    if len(raw) < 3:
        return index.select("path").limit(0)
    grams = [(raw[k] << 16) | (raw[k + 1] << 8) | raw[k + 2] for k in range(len(raw) - 2)]
    distinct = sorted(set(grams))
    own = index.filter(F.col("trigram").isin(distinct))
    holds = own.groupBy("path").agg(F.count_distinct("trigram").alias("n")).filter(F.col("n") == len(distinct)).select("path")
    offsets = spark.createDataFrame(list(zip(grams, range(len(grams)), strict=True)), "trigram int, offset int")
    met = own.join(holds, "path", "left_semi").join(F.broadcast(offsets), "trigram")
    decoded = _positions(met.select("path", "offset", "positions"))
    return decoded.groupBy("path", "start").agg(F.count("*").alias("n")).filter(F.col("n") == len(grams)).select("path").distinct()


def _positions(met: DataFrame) -> DataFrame:
    """``(path, start)``: positions of deltas, moved back by the offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            size = lists.value_lengths().to_numpy(zero_copy_only=False)
            total = np.cumsum(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
            begin = np.cumsum(size) - size
            base = np.where(begin > 0, total[np.maximum(begin - 1, 0)], 0)
            which = np.repeat(np.arange(len(size)), size)
            start = total - base[which] - batch.column(1).to_numpy()[which]
            keep = start >= 0
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which[keep])), pa.array(start[keep], pa.int64())], ["path", "start"])

    return met.mapInArrow(run, "path string, start long")


class StoredIndex:
    """Postings in a folder, in buckets of trigrams; an update writes the touched buckets anew and no others."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.table, self.buckets = BucketedTable(spark, path, _PACKED, ["path"]), buckets

    def create(self, files: DataFrame) -> list[int]:
        """Index ``files(path, text)``, whose paths are unique; returns the buckets."""
        return self.table.create(packed(files, self.buckets))

    def search(self, query: str) -> DataFrame:
        """Paths whose text holds the query, from its trigrams' buckets alone."""
        raw = folded(query).encode()
        grams = sorted({(raw[k] << 16) | (raw[k + 1] << 8) | raw[k + 2] for k in range(len(raw) - 2)})
        return find_in_postings(unpacked(self.table.read(sorted({g % self.buckets for g in grams})), grams), query)

    def update(self, added: DataFrame, removed: DataFrame | None = None) -> list[int]:
        """Take in the files ``added(path, text)`` (in place of older ones) and drop the paths ``removed``; returns the buckets rewritten.

        A file's old postings are looked for by its path, which reads the paths of all parts but writes only the touched ones.
        """
        gone = added.select("path") if removed is None else added.select("path").unionByName(removed.select("path"))
        gone, _ = write_stage(gone.distinct(), "gone")  # of known size, so few paths are broadcast and the postings stay where they are
        fresh = packed(added, self.buckets)
        hit = self.table.read().join(gone, "path", "left_semi").select("bucket").unionByName(fresh.select("bucket")).distinct()
        touched = sorted(r[0] for r in hit.collect())  # numbers of buckets
        self.table.replace(touched, self.table.read(touched).join(gone, "path", "left_anti").unionByName(fresh))
        return touched

    def drop(self) -> None:
        self.table.drop()


def fingerprint(files: DataFrame) -> DataFrame:
    """``(path, fingerprint)`` of texts."""
    return files.select("path", F.sha2("text", 256).alias("fingerprint"))


def content_state(fingerprints: DataFrame) -> DataFrame:
    """One digest of a set of fingerprints, in any order: sums of hashes, so no task gathers them all."""
    h = F.xxhash64("path", "fingerprint")
    return fingerprints.agg(F.sha2(F.concat_ws(":", F.count("*"), F.bit_xor(h), F.sum(h.cast("decimal(38,0)"))), 256).alias("state"))


def invalidated(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(path, change)`` where fingerprints differ: added, removed, changed."""
    a, b = old.select("path", F.col("fingerprint").alias("a")), new.select("path", F.col("fingerprint").alias("b"))
    both = a.join(b, "path", "full_outer").filter(~F.col("a").eqNullSafe(F.col("b")))
    return both.select("path", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed").alias("change"))


def cached(files: DataFrame, cache: DataFrame, pack: str) -> tuple[DataFrame, DataFrame]:
    """Files found in ``cache(path, fingerprint, pack, ...)`` with their record, and those to be parsed."""
    own = cache.filter(F.col("pack") == pack).drop("pack")
    return files.join(own, ["path", "fingerprint"]), files.join(own, ["path", "fingerprint"], "left_anti")


def cached_manually(files: DataFrame, cache: DataFrame, pack: str) -> DataFrame:
    """``files(path, fingerprint)`` with the newest cache record of their path, and ``state``: ``hit``, ``stale`` or ``miss``.

    In manual mode the newest record stands (by ``created``, then ``modified``, then the smallest ``id``), whatever it was
    made from; one of another fingerprint is stale.  ``record`` holds its columns, null for a miss.
    """
    own = cache.filter(F.col("pack") == pack)
    newest = own.groupBy("path").agg(F.max_by(F.struct(*(c for c in own.columns if c not in ("path", "pack"))), F.struct("created", "modified", (-F.col("id")).alias("i"))).alias("record"))
    state = F.when(F.col("record").isNull(), "miss").when(F.col("record.fingerprint") == F.col("fingerprint"), "hit").otherwise("stale")
    return files.join(newest, "path", "left").withColumn("state", state)
