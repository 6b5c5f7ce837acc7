"""SimHash near-duplicates over pivot distance tables.

Fingerprints: 64 bits over XXH64 hashes of word shingles.  Linked pairs: two
fingerprints that differ in at most ``MAX_BITS`` bits.

1. Equal fingerprints are one node (a grouping with partial counts), so copies
   are never paired.
2. Blocks: the 64 bits are cut into ``MAX_BITS + kept`` blocks; two linked
   fingerprints agree on ``kept`` blocks at least, so each node is dealt once
   for every choice of ``kept`` blocks.  More nodes take longer keys
   (``_plan``); every plan is complete.
3. Inside a block the pivot table decides: the distances of every node to
   ``PIVOTS`` reference fingerprints are looked up, a pair whose largest
   coordinate difference exceeds ``MAX_BITS`` is discarded by the triangle
   inequality, and survivors are verified bit by bit.
4. In a crowded block (a large family of near copies) the pivots are taken
   from the block itself until each node lies within ``MAX_BITS`` of one; a
   pivot joins all its neighbours at once, and only nodes of different
   components whose pivot distances allow a link are compared.  So a family
   yields a spanning forest, not all its pairs.
5. Components come from the star steps of ``components``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions.stage import import_on_workers, write_stage
from marlstone.llm.common import fresh
from marlstone.llm.components import connected_components

MAX_BITS = 4
SEED = 42
#: Blocks up to this size compare their pairs; above it the pivots come from the block.
SMALL_BLOCK = 48
#: Shingles whose bits are counted at once: a very long text stays small in memory.
CHUNK = 1 << 16
PIVOTS = np.random.default_rng(20_061).integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def print_of(chunks: Iterable[np.ndarray], n: int) -> int:
    """The unsigned fingerprint of ``n`` hashes, which come in chunks: the bits that over half of them have."""
    ones = np.zeros(64, np.int64)
    for h in chunks:
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The unsigned fingerprint of one text; a text without words has zero."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_UPPER)
    joined, ends, at = b" ".join(_WORD.findall(raw)), [], 0
    if not joined:
        return 0
    while (at := joined.find(b" ", at)) >= 0:
        ends.append(at)
        at += 1
    ends.append(len(joined))
    starts = [0, *(e + 1 for e in ends[:-1])]
    if len(ends) <= shingle:
        pairs = [(0, len(joined))]
    else:
        pairs = list(zip(starts, ends[shingle - 1 :], strict=False))
    digest = xxhash.xxh64_intdigest
    return print_of((np.array([digest(joined[s:e], SEED) for s, e in pairs[k : k + CHUNK]], np.uint64) for k in range(0, len(pairs), CHUNK)), len(pairs))


def with_fingerprints(docs: DataFrame, name: str, shingle: int = 4) -> DataFrame:
    """``docs`` with the fingerprint of ``text`` as a signed long (the same 64 bits); rows pass through as they come."""
    import_on_workers(docs.sparkSession)
    at, schema = docs.columns.index("text"), T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(at)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints)], [*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _plan(nodes: int) -> list[int]:
    """Masks of the block choices: key bits exceed the bits that count the nodes."""
    blocks, kept = (6, 2) if nodes < 1 << 24 else (8, 4) if nodes < 1 << 34 else (10, 6)
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    parts = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:], strict=False)]
    masks = [sum(choice) for choice in combinations(parts, kept)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _links_small(key: np.ndarray, fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs of equal keys; rows are sorted by key, blocks hold ``most`` rows at most."""
    table = np.bitwise_count(fp[:, None] ^ PIVOTS[None, :]).astype(np.int8)
    left, right = [], []
    for shift in range(1, most):
        i = np.flatnonzero(key[shift:] == key[:-shift])
        if not i.size:
            break
        i = i[np.abs(table[i] - table[i + shift]).max(axis=1) <= MAX_BITS]
        i = i[_distance(fp[i], fp[i + shift]) <= MAX_BITS]
        left.append(fp[i])
        right.append(fp[i + shift])
    none = np.empty(0, np.uint64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def spanning_links(fp: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the link graph of distinct fingerprints, with pivots taken from them."""
    n, links = len(fp), []
    comp, covered, pivots = np.arange(n), np.zeros(n, bool), []

    def join(x: int, near: np.ndarray) -> None:
        others, at = np.unique(comp[near], return_index=True)
        for c, k in zip(others.tolist(), at.tolist(), strict=True):
            if c != comp[x]:
                links.append((int(fp[x]), int(fp[near[k]])))
                comp[comp == c] = comp[x]

    at = 0
    while True:
        while at < n and covered[at]:
            at += 1
        if at == n:
            break
        near = np.flatnonzero(_distance(fp, fp[at]) <= MAX_BITS)
        covered[near] = True
        pivots.append(at)
        join(at, near)
    if (comp == comp[0]).all():
        return links
    for p in pivots:
        d = _distance(fp, fp[p])
        own = np.flatnonzero(d <= MAX_BITS)
        far = np.flatnonzero((d > MAX_BITS) & (d <= 2 * MAX_BITS) & (comp != comp[p]))
        for x in own.tolist() if far.size else ():
            ok = far[(np.abs(d[far].astype(np.int8) - np.int8(d[x])) <= MAX_BITS) & (comp[far] != comp[x])]
            ok = ok[_distance(fp[ok], fp[x]) <= MAX_BITS]
            if ok.size:
                join(x, ok)
    return links


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of rows ``(choice, key, fp)`` that come sorted by choice and key."""
    held: list[np.ndarray] = []

    def solve(rows: np.ndarray) -> pa.RecordBatch:
        _, start, size = np.unique(rows[:, :2], axis=0, return_index=True, return_counts=True)
        block = np.repeat(np.arange(len(size)), size)
        fp = rows[:, 2].astype(np.int64).view(np.uint64)
        small = np.repeat(size <= SMALL_BLOCK, size)
        a, b = _links_small(block[small], fp[small], SMALL_BLOCK)
        rest = [x for k in np.flatnonzero(size > SMALL_BLOCK) for x in spanning_links(np.unique(fp[start[k] : start[k] + size[k]]))]
        a = np.concatenate([a, np.array([x for x, _ in rest], np.uint64)]).view(np.int64)
        b = np.concatenate([b, np.array([y for _, y in rest], np.uint64)]).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        rows = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)], axis=1)
        if not len(rows):
            continue
        change = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1))
        fresh = not held or (held[-1][-1, :2] != rows[0, :2]).any()
        if fresh and held:
            yield solve(np.concatenate(held))
            held = []
        if change.size:
            cut = change[-1] + 1
            yield solve(np.concatenate([*held, rows[:cut]]))
            held = [rows[cut:]]
        else:
            held.append(rows)
    if held:
        yield solve(np.concatenate(held))


def fingerprint_links(fps: DataFrame, nodes: int) -> DataFrame:
    """Links ``(a, b)`` that span the components of the distinct longs ``fp``."""
    import_on_workers(fps.sparkSession)
    keys = F.array(*(F.struct(F.lit(k).cast("int").alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(_plan(nodes))))
    dealt = fps.select("fp", F.explode(keys).alias("k")).select("k.choice", "k.key", "fp")
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "choice", "key").sortWithinPartitions("choice", "key").mapInArrow(_link, "a long, b long").distinct()


def classes(prints: DataFrame) -> DataFrame:
    """``(fp, root, component_id)`` for every distinct ``fp`` of ``prints(doc_id, fp)``.

    ``root`` names the component; ``component_id`` is its smallest doc_id, null
    only where none of its rows has an id.
    """
    groups, _ = write_stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    roots = connected_components(fingerprint_links(groups.select("fp"), groups.count()))
    named = groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named, _ = write_stage(named, "roots")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return named.join(ids, "root").select("fp", "root", "component_id")


def simhash_components(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs(doc_id, text)``.

    Null and wordless texts have fingerprint zero and link like any other.  Rows
    that repeat stay; a null doc_id is never a component's id unless all its ids
    are null.  An empty table gives no row.  Other columns are not read.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prints, _ = write_stage(with_fingerprints(own, "fp", shingle).drop("text"), "fingerprints")
    return prints.join(classes(prints).drop("root"), "fp").select("doc_id", fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """The rows of ``docs`` whose doc_id is their component's smallest; one row of each component.

    Columns stay as they are, whatever their names.  Components whose ids are all
    null keep one row.  Of several rows with that id the one with the least digest
    stays.  An empty table gives no row; very long texts are read whole.
    """
    fp, root, best_id, digest = fresh(docs.columns, "fp", "root", "id", "digest")
    marked, _ = write_stage(with_fingerprints(docs, fp, shingle), "marked")
    named = classes(marked.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(fp).alias("fp")))
    # A representative is one (fingerprint, id): rows of other ids need not meet their class.
    best = named.select(F.col("fp").alias(fp), F.col("root").alias(root), F.col("component_id").alias(best_id))
    kept = marked.join(best.withColumnRenamed(fp, "_" + fp), (F.col(fp) == F.col("_" + fp)) & F.col("doc_id").eqNullSafe(F.col(best_id))).withColumn(digest, F.xxhash64(*docs.columns))
    least = kept.groupBy(root).agg(F.min(digest).alias(digest))
    return kept.join(least, [root, digest]).dropDuplicates([root]).select(*docs.columns)
