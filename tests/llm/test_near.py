import random

import corpus_pipeline
from marlstone.llm import near

DOC = "doc_id long, text string, fp string, n_bytes int, component_id string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], DOC)


def plain_shingles(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def plain_groups(rows):
    sets = [plain_shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(find(k), []).append(i)
    return sorted((min((i for i in g if i is not None), default=None) for g in groups.values()), key=repr)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"W{k}é" for k in range(400)]
    rows = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randrange(3, 300))]
        for _ in range(8):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 18)):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((len(rows), " ".join(w)))
    family = [rng.choice(words) for _ in range(200)]
    for _ in range(70):
        w = list(family)
        for at in rng.sample(range(200), rng.choice([1, 2, 3, 12])):
            w[at] = rng.choice(words)
        rows.append((len(rows), " ".join(w)))
    rng.shuffle(rows)
    return rows


def test_near_copies_of_08_go(spark):
    rows = [*corpus(1), (900, "twice"), (900, "twice"), (None, "no id at all"), (None, "no id at all"), (901, ""), (902, None), (903, " \n"), (None, "twice")]
    kept = corpus_pipeline.near_duplicates(spark, frame(spark, rows), "")
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == plain_groups(rows)
    assert kept.columns == [c.split()[0] for c in DOC.split(", ")]
    assert corpus_pipeline.near_duplicates(spark, frame(spark, []), "").count() == 0


def test_shingles_and_keys():
    for text in ("", "a", "a b c d e", "A b c d E f", " x  y\tz " * 9):
        assert len(near.shingles(text)) == len(plain_shingles(text))
    assert (near.shingles("A b\nc d E f") == near.shingles("a B c  d e f")).all()
    h = near.shingles(" ".join(map(str, range(9000))))
    assert len(h) == 8996 and (near.band_keys(h) == near.band_keys(h[::-1])).all()


def test_prefixes_and_bitmaps_lose_nothing():
    import numpy as np

    rng = random.Random(5)
    words = [f"w{k}" for k in range(60)]
    for _ in range(300):
        a = [rng.choice(words) for _ in range(rng.randrange(5, 90))]
        b = list(a)
        for _ in range(rng.randrange(0, 5)):
            b[rng.randrange(len(b))] = rng.choice(words)
        x, y = (near.shingles(" ".join(t)) for t in (a, b))
        differ = sum(int(d).bit_count() for d in (near.parity_bits(x) ^ near.parity_bits(y)).view(np.uint64))
        assert differ <= len(np.setxor1d(x, y))
        counts = np.zeros(near.COUNTS, np.int32)
        for s in (x, y):
            counts += np.bincount((s % np.uint64(near.COUNTS)).astype(np.int64), minlength=near.COUNTS).astype(np.int32)
        if near.similarity(x, y) >= 0.8:
            (pa_, ha), (pb, hb) = (near.prefix_of(s, counts) for s in (x, y))
            shared = np.intersect1d(ha, hb)
            assert len(shared)
            left = max(1 + min(len(x) - pa_[ha == h][0], len(y) - pb[hb == h][0]) for h in shared)
            need = (len(x) + len(y)) * 0.8 / 1.8 - 1e-9
            assert left >= need and (len(x) + len(y) - differ) / 2 >= need


def test_fingerprints_and_pivot_tables_come_first(spark):
    """Pairs of operator 6's step: its fingerprints at 4 bits give the same components as brute force."""
    rng = random.Random(11)
    words = [f"w{k}" for k in range(900)]
    texts = []
    for _ in range(6):
        base = [rng.choice(words) for _ in range(400)]
        for _ in range(60):  # over simhash.SMALL_BLOCK
            w = list(base)
            w[rng.randrange(400)] = rng.choice(words)
            texts.append(" ".join(w))
    sets = [near.shingles(t) for t in dict.fromkeys(texts)]
    prints = [near.set_print(s) for s in sets]
    nodes = spark.createDataFrame([(bytearray(k.to_bytes(4)), p) for k, p in enumerate(prints)], "node binary, fp long")
    pairs = [tuple(int.from_bytes(x) for x in r) for r in near.print_pairs(nodes).collect()]
    bits = lambda a, b: ((prints[a] ^ prints[b]) & ((1 << 64) - 1)).bit_count()
    assert pairs and all(a < b and bits(a, b) <= 4 and near.similarity(sets[a], sets[b]) >= 0.8 for a, b in pairs)

    def parts(links):
        root = list(range(len(sets)))
        for a, b in links:
            x, y = root[a], root[b]
            root = [x if r == y else r for r in root]
        return {frozenset(k for k, r in enumerate(root) if r == x) for x in root}

    assert parts(pairs) == parts([(a, b) for a in range(len(sets)) for b in range(a) if bits(a, b) <= 4])
    assert len(pairs) < len(sets) * 16  # forests of blocks, not all pairs
