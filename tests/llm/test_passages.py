import hashlib
import random
import re

import pytest

from marlstone.llm import passages, queries


def plain(rows, window=13):
    """``(doc_id, n_words, n_removed, kept_sha256)`` by a table of all windows; null ids come last."""
    split = [(float("inf") if i is None else i, re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t in rows]
    first = {}
    for i, w in split:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for (i, w), (own_id, _) in zip(split, rows):
        lost = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                lost.update(range(k, k + window))
        kept = [x for k, x in enumerate(w) if k not in lost]
        out.append((own_id, len(w), len(lost), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows, schema="doc_id long, text string", **options):
    return sorted((tuple(r) for r in passages.cut_passages(spark.createDataFrame(rows, schema), **options).collect()), key=repr)


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{k}é" for k in range(30)]
    shared = [[rng.choice(words) for _ in range(rng.randrange(8, 70))] for _ in range(12)]
    for i in range(n):
        w = []
        for _ in range(rng.randrange(5)):
            w += [rng.choice(words) for _ in range(rng.randrange(30))] + rng.choice(shared)[rng.randrange(5) :]
        yield i, rng.choice([" ", "\n", "\t ", "  "]).join(w)


EDGES = [(900, None), (901, ""), (902, " \n"), (903, "x " * 12), (904, "x " * 13), (905, "x " * 14), (905, "x " * 40), (None, "x " * 20), (None, "no"), (906, "a\x1c b " * 30), (907, "a\x1c b " * 30), (907, "a\x1c b " * 30)]


@pytest.mark.parametrize("group_bytes", [12 << 20, 300])
def test_against_plain_code(spark, group_bytes):
    rows = [*corpus(1), *EDGES, (3, "a second text of an id " * 20)]
    random.Random(2).shuffle(rows)
    assert run(spark, rows, group_bytes=group_bytes) == plain(rows)


def test_other_windows(spark):
    rows = list(corpus(4, 60))
    for window in (2, 5):
        assert run(spark, rows, window=window) == plain(rows, window)


def test_a_hot_passage_and_a_hot_id(spark):
    said = " ".join(f"said{k}" for k in range(60))
    rows = [(i, f"own{i} {said} end{i}") for i in range(400)] + [(7, f"text {k} of one id {said}") for k in range(400)]
    assert run(spark, rows, group_bytes=2000) == plain(rows)


def test_rows_with_their_columns(spark):
    passage = " ".join(f"p{k}" for k in range(20))
    rows = [(1, "x", f"one {passage} two", 4), (2, None, f"three\n{passage} four {passage}", 5), (3, "z", None, None)]
    frame = spark.createDataFrame(rows, "doc_id int, n_words string, text string, removed int")
    assert passages.measure_names(frame.columns) == ["_n_words", "_n_removed", "_kept_sha256", "_removed"]
    got = sorted(passages.cut_passages(frame, with_rows=True).collect())
    assert [(r.doc_id, r.n_words, r.text, r.removed) for r in got] == [(1, "x", f"one {passage} two", 4), (2, None, "three four", 5), (3, "z", None, None)]
    assert [tuple(x) for x in got[1]["_removed"]] == [(1, 21), (22, 42)]


def test_a_long_text(spark):
    rng = random.Random(9)
    words = [str(rng.randrange(500)) for _ in range(300_000)]
    rows = [(1, " ".join(words[1000:9000])), (2, " ".join(words)), (3, " ".join(words[:2000]))]
    assert run(spark, rows) == plain(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_registered_query_against_plain_code(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in queries.QUERIES["op12_substring_dedup"](spark, sf_dir).collect()), key=repr) == plain(rows)
