"""Near copies by exact shingle similarity: the pipeline's rule, five words and 0.8.

Operator 6 comes first: fingerprints of the shingles, met by its pivot distance
tables.  64 bits can't hold the whole rule: at similarity 0.8 two texts differ in
10 bits on average and in up to 17, and no block choice is complete there.  So
minimum hashes find what the fingerprints leave apart, and every link is verified.

1. Equal texts are one node.  Nodes of one fingerprint meet the least of them, and
   these meet along the links of ``simhash.fingerprint_links``, where pivot tables
   decide; those that are similar enough are linked.
2. Each node has ``BANDS`` keys, each of ``ROWS`` minimum hashes of its shingles.
   Nodes with a key in common form a block.  A pair of similarity 0.8 shares no
   key with a probability of ``(1 - 0.8 ** ROWS) ** BANDS``, 3 in a million;
   closer pairs less.
3. The least node of a block is its pivot.  All others that no link joins to it
   yet are compared with it by the similarity of their whole shingle sets.
4. Nodes that the pivots' links leave in different components of a block meet by
   filters that lose nothing.  Order all shingles, rare ones first (by a table of
   counts of a fixed size); two sets of similarity 0.8 have one of the first
   ``n - ceil(0.8 n) + 1`` shingles of each in common, and enough of both is left
   from the first common one on.  And their parity bitmaps, ``BITS`` long, differ in
   no more places than the sets do.  A large family of loose copies passes few.  First each such
   shingle draws one of its nodes as a pivot, again and again while that joins
   components; then all pairs of different components meet whose sizes allow a link.

So a family of near copies costs a star, not its pairs, and no candidate pair is
dropped unseen.  Texts travel only for nodes that have a candidate.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.stage import drop_buckets, import_on_workers, write_buckets, write_stage
from marlstone.llm.common import fresh, give_back_memory
from marlstone.llm.components import connected_components
from marlstone.llm.simhash import _UPPER, SEED, fingerprint_links, print_of
from marlstone.llm.simhash import CHUNK as PRINT_CHUNK

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 5
#: Another draw of pivots pays while this share of its pairs links components, and so many pairs are drawn (a draw saves work, the last step finds all links).
PAYS, WORTH = 0.05, 1000
#: Places of the table of counts, in slices, and of the bitmap of a set of shingles.
COUNTS, SLICE, BITS = 1 << 20, 1 << 14, 1024
#: Sums that tasks' tables of counts go into before these are added.
LIMBS = 256
#: Shingles that meet all hash functions at once.
CHUNK = 1 << 9
_rng = np.random.default_rng(20_062)
_MASKS = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)[:, None]
_FACTORS = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; a text with fewer words has one."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_UPPER).split()  # of bytes: at space and the controls 9 to 13
    joined = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False)) if len(words) > shingle else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(SEED)), np.uint64)
    hashes.sort()
    return hashes[np.concatenate([[True], hashes[1:] != hashes[:-1]])]


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """The keys of a set of hashes, one a band."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), CHUNK):
        mixed = hashes[None, k : k + CHUNK] ^ _MASKS
        mixed *= _FACTORS
        np.minimum(least, mixed.min(axis=1), out=least)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _ODD
    for column in least.reshape(BANDS, ROWS).T:
        key = (key ^ column) * _ODD
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def set_print(hashes: np.ndarray) -> int:
    """The signed fingerprint of a set of hashes."""
    bits = print_of((hashes[k : k + PRINT_CHUNK] for k in range(0, len(hashes), PRINT_CHUNK)), len(hashes))
    return bits - (1 << 64) if bits >= 1 << 63 else bits


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _node() -> Column:
    return F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))


def _row(node: Column, doc_id: Column) -> Column:
    """Names a text under an id, so that copies of a hot text under many ids lie apart."""
    return F.concat_ws(":", F.hex(node), doc_id.cast("string"))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, prints = [], []
        for t in batch.column(2):
            own = shingles(t.as_py())
            keys.append(band_keys(own))
            prints.append(set_print(own))
        flat = pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * BANDS, pa.int32()), flat)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists, pa.array(prints, pa.int64())], ["doc_id", "node", "keys", "fp"])
    give_back_memory()


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = lru_cache(8)(shingles)
    for batch in batches:
        distance = [1 - similarity(held(x.as_py()), held(y.as_py())) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(distance, pa.float64())], ["a", "b", "d"])
    give_back_memory()


def _all_texts(docs: DataFrame, nodes: DataFrame) -> tuple[DataFrame, str, str]:
    """``(node, text)`` of one row of each node, in buckets by node, with its name and path: steps that want some texts read them all but shuffle none."""
    rows = docs.select(_row(_node(), F.col("doc_id").cast("long")).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    one = rows.join(nodes.select("node", _row(F.col("node"), F.col("least")).alias("row")), "row").dropDuplicates(["row"])
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return write_buckets(one.select("node", "text"), parts, "node", "texts")


def _texts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(node, text)``, written, of the nodes ``wanted(node)``, whose names alone are shuffled."""
    return write_stage(texts.join(wanted.hint("shuffle_hash"), "node", "left_semi"), "texts")[0]


def _distances(every: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(a, b, d)``: the exact distance of each pair of nodes, written."""
    pairs, _ = write_stage(pairs.distinct(), "pairs")
    texts = _texts(every, pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    met = pairs.join(texts.toDF("a", "x"), "a").join(texts.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return write_stage(met.mapInArrow(_measure, "a binary, b binary, d double"), "distances")[0]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts of a task have a shingle at each place of the table, in slices."""
    held = np.zeros(COUNTS, np.int64)
    for batch in batches:
        for t in batch.column(1):
            np.add.at(held, (shingles(t.as_py()) % np.uint64(COUNTS)).astype(np.int64), 1)
    parts = held.reshape(-1, SLICE)
    some = np.flatnonzero(parts.any(axis=1))
    limb = TaskContext.get().partitionId() % LIMBS
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([limb] * len(some), pa.int32()), pa.array([parts[k].tobytes() for k in some], pa.binary())], ["slice", "limb", "counts"])


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(c.as_py(), np.int64) for c in table.column("counts"))
    return pa.table([table.column("slice").slice(0, 1), table.column("limb").slice(0, 1), pa.array([total.tobytes()], pa.binary())], ["slice", "limb", "counts"])


def shingle_counts(texts: DataFrame) -> np.ndarray:
    """A table of ``COUNTS`` numbers, whatever the input: texts with a shingle at each place.

    Tasks' tables are added as a tree: those of each ``LIMBS``-th task first, then these sums, so a group
    holds the tables of a part of the tasks only.
    """
    schema, out = "slice int, limb int, counts binary", np.zeros(COUNTS, np.int32)
    limbs = texts.mapInArrow(_count, schema).groupBy("slice", "limb").applyInArrow(_add, schema)
    for r in limbs.groupBy("slice").applyInArrow(_add, schema).collect():  # COUNTS / SLICE rows
        out[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.minimum(np.frombuffer(r["counts"], np.int64), 1 << 30)
    return out


def parity_bits(hashes: np.ndarray) -> np.ndarray:
    """A bit for each place that an odd number of hashes fall on: two sets differ in as many elements as their bits do, at least."""
    odd = np.bincount((hashes >> np.uint64(40)).astype(np.int64) % BITS, minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def prefix_of(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(place, shingle)`` of the first shingles of a set, rare ones first, that another text may have."""
    held = counts[(hashes % np.uint64(COUNTS)).astype(np.int64)]
    order = np.lexsort((hashes, held))[: len(hashes) - int(np.ceil(len(hashes) * SIMILARITY - 1e-9)) + 1]
    some = np.flatnonzero(held[order] > 1)
    return some + 1, hashes[order][some]


def _prefixes(every: DataFrame, live: DataFrame) -> DataFrame:
    """``(h, node, n, place, bits)``, written: of each node the first shingles, one of which it shares with any node that is similar enough; ``n`` shingles in all."""
    texts = _texts(every, live)
    counts = every.sparkSession.sparkContext.broadcast(shingle_counts(texts))  # a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, t in enumerate(batch.column(1)):
                own = shingles(t.as_py())
                place, h = prefix_of(own, counts.value)
                bits = parity_bits(own)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(h) + 1) * len(bits), pa.int32()), pa.array(np.tile(bits, len(h))))
                columns = [pa.array(h.view(np.int64)), batch.column(0).slice(k, 1).take(pa.array(np.zeros(len(h), np.int32))), pa.array(np.full(len(h), len(own), np.int32)), pa.array(place.astype(np.int32)), lists]
                yield pa.RecordBatch.from_arrays(columns, ["h", "node", "n", "place", "bits"])
        give_back_memory()

    return write_stage(texts.mapInArrow(run, "h long, node binary, n int, place int, bits array<long>"), "prefixes")[0]


_SIDE = ["node", "root", "n", "place", "bits"]


def _fits() -> Column:
    """Whether two nodes are of different components, and neither the shingles left from a shared one on nor their bitmaps rule a link out."""
    left = 1 + F.least(F.col("n") - F.col("place"), F.col("n_1") - F.col("place_1"))
    need = (F.col("n") + F.col("n_1")) * (SIMILARITY / (1 + SIMILARITY)) - 1e-9
    differ = sum((F.bit_count(F.get("bits", F.lit(k)).bitwiseXOR(F.get("bits_1", F.lit(k)))) for k in range(1, BITS // 64)), F.bit_count(F.get("bits", F.lit(0)).bitwiseXOR(F.get("bits_1", F.lit(0)))))
    return (F.col("root") != F.col("root_1")) & (left >= need) & ((F.col("n") + F.col("n_1") - differ) / 2 >= need)


def _pair() -> list[Column]:
    return [F.least("node", "node_1").alias("a"), F.greatest("node", "node_1").alias("b")]


def _drawn_pairs(prefix: DataFrame, draw: int) -> DataFrame:
    """``(a, b)``: each shingle's nodes with the one that it draws, of those that leave room for a link with one of their size."""
    tight = 1 + F.col("n") - F.col("place") < F.col("n") * (2 * SIMILARITY / (1 + SIMILARITY))
    drawn = prefix.groupBy("h").agg(F.min(F.struct(tight, F.xxhash64("node", "h", F.lit(draw)), *_SIDE)).alias("p"))
    drawn = drawn.select("h", *(F.col(f"p.{c}").alias(f"{c}_1") for c in _SIDE))
    return prefix.join(drawn, "h").filter(_fits()).select(*_pair()).distinct()


def _open_pairs(prefix: DataFrame) -> DataFrame:
    """``(a, b)`` of all nodes that share a shingle and lie in different components."""
    main = prefix.groupBy("h").agg(F.min("root").alias("main"), F.max("root").alias("other")).filter("main <> other").select("h", "main")
    some = prefix.join(main, "h")
    far = some.filter("root <> main").select("h", *(F.col(c).alias(f"{c}_1") for c in _SIDE))
    met = far.join(some, "h").filter(_fits() & ((F.col("root") == F.col("main")) | (F.col("node_1") < F.col("node"))))
    return met.select(*_pair()).distinct()


def _linked(distances: DataFrame) -> DataFrame:
    # Distances are fractions of counts: a small slack keeps 0.8 itself.
    return distances.filter(F.col("d") <= 1 - SIMILARITY + 1e-9).select("a", "b")


def print_pairs(nodes: DataFrame) -> DataFrame:
    """``(a, b)`` of ``nodes(node, fp)``: the nodes of a fingerprint with the least of them, and these along the links that pivot tables give."""
    prints, _ = write_stage(nodes.groupBy("fp").agg(F.min("node").alias("first")), "prints")
    same = nodes.join(prints, "fp").filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    links = fingerprint_links(prints.select("fp"), prints.count()).toDF("fp", "fp_1")
    met = links.join(prints.withColumnRenamed("first", "node"), "fp").join(prints.toDF("fp_1", "node_1"), "fp_1")
    return same.union(met.select(*_pair()))


def near_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(node, least)`` for every distinct text of ``docs(doc_id, text)``, and ``(node, root)`` for those with a near copy."""
    import_on_workers(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _node().alias("node"), "text")
    sketches, _ = write_stage(own.mapInArrow(_sketch, "doc_id long, node binary, keys array<long>, fp long"), "sketches")
    nodes, _ = write_stage(sketches.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("fp").alias("fp")), "nodes")
    every, name, path = _all_texts(docs, nodes)
    close = _distances(every, print_pairs(nodes))
    roots, _ = write_stage(connected_components(_linked(close)), "roots")

    dealt = sketches.select("node", F.explode("keys").alias("key"))
    blocks = dealt.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).filter("pivot <> last").select("key", "pivot")
    members, _ = write_stage(dealt.join(blocks, "key").distinct(), "members")

    apart = members.filter("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    for end in ("a", "b"):
        apart = apart.join(roots.toDF(end, f"root_{end}"), end, "left")
    apart = apart.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
    stars = _distances(every, apart.join(close.select("a", "b"), ["a", "b"], "left_anti"))
    links, known = _linked(close).union(_linked(stars)), close.union(stars).select("a", "b")
    roots, _ = write_stage(connected_components(links), "roots")

    placed = members.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    # In a block of three or more nodes, pairs without the pivot are not compared yet.
    open_keys = placed.groupBy("key").agg(F.count("*").alias("size"), F.min("root").alias("low"), F.max("root").alias("high")).filter("size > 2 and low <> high").select("key")
    prefix = _prefixes(every, placed.join(open_keys, "key").select("node").distinct())
    draw, last = 0, False
    while True:
        rooted = prefix.join(roots, "node", "left").select("h", "node", "n", "place", "bits", F.coalesce("root", "node").alias("root"))
        pairs = _open_pairs(rooted) if last else _drawn_pairs(rooted, draw)
        more = _distances(every, pairs.join(known, ["a", "b"], "left_anti"))
        found = _linked(more)
        links, known = links.union(found), known.union(more.select("a", "b"))
        met, joined = more.count(), found.count()
        if joined:
            roots, _ = write_stage(connected_components(links), "roots")
        if last:
            break
        draw, last = draw + 1, joined < PAYS * met or met < WORTH
    drop_buckets(docs.sparkSession, name, path)
    return nodes, roots


def similar_dedup(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies: the one with the group's smallest doc_id.

    Two texts are near copies at a similarity of ``SIMILARITY`` or more of their
    sets of five-word shingles, and groups are transitive.  Null and wordless texts are
    copies of each other.  Columns stay as they are, whatever their names.  A group
    whose ids are all null keeps one row; of several rows of one id and text the one
    with the least digest stays; an empty table gives no row.  Very long texts are
    read whole.
    """
    nodes, roots = near_classes(docs)
    named = nodes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    # Ids before null, then the least node: one text of each group.
    best = named.groupBy("root").agg(F.min(F.struct(F.col("least").isNull(), "least", "node")).alias("b"))
    row, digest = fresh(docs.columns, "row", "digest")
    kept = best.select(_row(F.col("b.node"), F.col("b.least")).alias(row))
    marked = docs.withColumn(row, _row(_node(), F.col("doc_id").cast("long"))).join(kept, row, "left_semi").withColumn(digest, F.xxhash64(*docs.columns))
    least = marked.groupBy(row).agg(F.min(digest).alias(digest))
    return marked.join(least, [row, digest]).dropDuplicates([row]).select(*docs.columns)
