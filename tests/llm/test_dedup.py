import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from marlstone.llm import induced, simhash, substring
from marlstone.llm.queries import QUERIES

DOC = "doc_id long, text string, fp string, n_bytes int, component_id string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], DOC)


def plain_fingerprint(text, shingle=4):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = lower.encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    prints = {}
    for i, t in rows:
        prints.setdefault(plain_fingerprint(t), []).append(i)
    names = list(prints)
    root = {p: p for p in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(names)):
        for b in range(a):
            if bin(names[a] ^ names[b]).count("1") <= 4:
                root[find(names[a])] = find(names[b])
    best = {}
    for p, ids in prints.items():
        own = [i for i in ids if i is not None]
        best[find(p)] = min([*own, *([best[find(p)]] if best.get(find(p)) is not None else [])], default=None)
    return sorted(((i, f"{plain_fingerprint(t):016x}", best[find(plain_fingerprint(t))]) for i, t in rows), key=repr)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"W{k}é" for k in range(300)]
    base = [[rng.choice(words) for _ in range(rng.randrange(1, 400))] for _ in range(n // 3)]
    rows = []
    for k in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((k, " ".join(w)))
    return rows


def test_fingerprint_against_plain():
    for _, t in [*corpus(1, 60), (0, ""), (0, None), (0, " \n"), (0, "One"), (0, "a\x85b \u00a0c"), (0, "A b c D e f")]:
        assert simhash.fingerprint(t) == plain_fingerprint(t)
    long = " ".join(str(k % 977) for k in range(200_000))
    assert simhash.fingerprint(long) == plain_fingerprint(long)


def test_components_against_brute_force(spark):
    rows = [*corpus(2, 300), (7, "same id other text"), (7, "same id other text"), (None, None), (None, "  "), (900, ""), (901, None)]
    got = simhash.simhash_components(frame(spark, rows))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_components(rows)
    assert simhash.simhash_components(frame(spark, [])).count() == 0


def test_spanning_links_against_brute_force():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, 6, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 9)), replace=False)) for _ in range(900)], np.uint64)
    fp = np.unique(base[rng.integers(0, 6, 900)] ^ flips)

    def groups(links):
        root = {int(x): int(x) for x in fp}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            assert bin(a ^ b).count("1") <= 4
            root[find(a)] = find(b)
        seen = {}
        for x in root:
            seen.setdefault(find(x), set()).add(x)
        return sorted(map(sorted, seen.values()))

    every = [(int(fp[i]), int(fp[j])) for i in range(len(fp)) for j in np.flatnonzero(np.bitwise_count(fp[i + 1 :] ^ fp[i]) <= 4) + i + 1]
    links = simhash.spanning_links(fp)
    assert len(links) < len(fp) and groups(links) == groups(every)


@pytest.mark.parametrize("nodes", [10, 1 << 30, 1 << 40])
def test_every_plan_meets_all_close_pairs(nodes):
    masks, rng = [m & ((1 << 64) - 1) for m in simhash._plan(nodes)], random.Random(1)
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a ^ sum(1 << k for k in rng.sample(range(64), 4))
        assert any(a & m == b & m for m in masks)


def test_near_dedup_keeps_one_of_each(spark):
    rows = [*corpus(4, 120), (130, "twice"), (130, "twice"), (None, "no id at all"), (None, "no id at all")]
    kept = simhash.near_dedup(frame(spark, rows))
    want = {c for _, _, c in plain_components(rows) if c is not None}
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(want) and ids.count(None) == 1
    assert kept.columns == [c.split()[0] for c in DOC.split(", ")]


def plain_cut(rows):
    first, out = {}, []
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    for k in order:
        i, b = rows[k][0], (rows[k][1] or "").encode()
        for s in range(len(b) - 49):
            first.setdefault(b[s : s + 50], (i is None, i or 0))
    for i, t in rows:
        b = (t or "").encode()
        hit = bytearray(len(b))
        for s in range(len(b) - 49):
            if first[b[s : s + 50]] < (i is None, i or 0):
                hit[s : s + 50] = b"\1" * 50
        left = bytes(c for c, h in zip(b, hit, strict=True) if not h)
        spans = sum(1 for s in range(len(b)) if hit[s] and (s == 0 or not hit[s - 1]))
        out.append((i, len(b), sum(hit), spans, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore")))
    return sorted(out, key=repr)


def passages(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdeé \n") for _ in range(n))
    shared = [text(n) for n in (49, 50, 51, 60, 81, 120, 400)]
    rows = []
    for k in range(60):
        parts = [text(rng.randrange(0, 150)) for _ in range(3)]
        parts.insert(rng.randrange(3), rng.choice(shared))
        if rng.random() < 0.3:
            parts.insert(rng.randrange(3), rng.choice(shared)[: rng.randrange(30, 120)])
        rows.append((k, "".join(parts)))
    rows += [(70, rows[5][1]), (71, "ab" * 2000), (72, "ab" * 1500), (73, "a" * 60), (74, "a" * 49), (75, ""), (76, None), (5, "same id " + rows[5][1]), (77, rows[9][1]), (77, rows[9][1]), (None, rows[9][1]), (None, None)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_cut_against_brute_force(spark, seed):
    rows = passages(seed)
    got = substring.cut_repeats(frame(spark, rows).repartition(3), bucket_bytes=3000)
    want = plain_cut(rows)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == [w[:5] for w in want]
    whole = substring.cut_repeats(frame(spark, rows), with_rows=True)
    assert sorted(((r["doc_id"], r["text"]) for r in whole.collect()), key=repr) == sorted(((w[0], w[5]) for w in want), key=repr)


def test_cut_in_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(substring, "CHUNK", 97)
    data = np.frombuffer("".join(random.Random(1).choice("ab") for _ in range(3000)).encode(), np.uint8)
    place, size, rep, whole = substring.runs(data, np.array([700, 740, 3000]))
    covered = sorted(p + k for p, n in zip(place.tolist(), size.tolist(), strict=True) for k in range(n))
    assert covered == [*range(651), *range(740, 2951)]


def test_drop_repeats_edges(spark):
    assert substring.cut_repeats(frame(spark, [])).count() == 0
    rows = [(1, "x" * 80), (2, "x" * 80), (3, ""), (4, None), (5, "y" * 10)]
    kept = substring.drop_repeats(frame(spark, rows).withColumn("n_chars", F.length("text").cast("long")))
    assert sorted((r["doc_id"], r["n_chars"]) for r in kept.collect()) == [(1, 80), (3, 0), (4, 0), (5, 10)]


def test_registered_queries_against_brute_force(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in QUERIES["op6_simhash"](spark, sf_dir).collect()), key=repr) == plain_components(docs)
    assert sorted((tuple(r) for r in QUERIES["op1_suffix_dedup"](spark, sf_dir).collect()), key=repr) == [w[:5] for w in plain_cut(docs)]


def test_suffix_arrays_against_sorting():
    rng = random.Random(1)
    for _ in range(400):
        data = np.frombuffer("".join(rng.choice(rng.choice(["ab", "a", "abc", "é\0z"])) for _ in range(rng.randrange(1, 70))).encode(), np.uint8)
        raw, digest = data.tobytes(), substring._Strings(data).digest
        order = induced.suffix_array(data, digest, 1000)
        assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
        same = induced.same_prefix(order, digest, 3, len(raw)).tolist()
        assert same == [False] + [raw[a : a + 3] == raw[b : b + 3] and max(a, b) + 3 <= len(raw) for a, b in zip(order, order[1:], strict=False)]
    assert induced.suffix_array(np.zeros(0, np.uint8), None, 5).tolist() == []


def test_hot_passages_are_spread(spark, monkeypatch):
    rows = passages(3)
    want = [w[:5] for w in plain_cut(rows)]
    monkeypatch.setattr(substring, "HOT_ROWS", 2)
    assert sorted((tuple(r) for r in substring.cut_repeats(frame(spark, rows), bucket_bytes=3000).collect()), key=repr) == want
