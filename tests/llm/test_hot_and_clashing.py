"""Hot passages, clashing column names, ties, and the pipeline's edges."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marlstone.llm import near, quality, simhash, substring
from tests.llm.test_dedup import plain_cut


def test_a_passage_in_a_third_of_all_documents(spark):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, window = text(75), text(50)
    rows = [(k, text(60) + {0: passage, 1: window}.get(k % 3, "") + text(60)) for k in range(1800)] + [(5000, passage), (5001, window), (None, passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = [w[:5] for w in plain_cut(rows)]
    for parts in (1, 4):
        got = substring.cut_repeats(docs.repartition(parts))
        assert sorted((tuple(r) for r in got.collect()), key=repr) == want


def test_flags_of_a_portion():
    ids, rep, whole = np.array([5, 3, 5, 9, 7]), np.array([1, 1, 1, 2, 1], np.uint64), np.array([8, 8, 8, 8, 4], np.uint64)
    assert substring._flags(ids, rep, whole).tolist() == [1, 0, 1, 0, 0]
    many = substring.HOT_LOCAL + 1
    flags = substring._flags(np.arange(many + 1), np.array([7] * many + [9], np.uint64), np.arange(many + 1).astype(np.uint64))
    assert flags.tolist() == [2] * many + [0]
    assert substring._flags(*(np.empty(0, t) for t in (np.int64, np.uint64, np.uint64))).tolist() == []


def test_one_passage_puts_few_rows_into_a_bucket(spark):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = text(75)
    docs = spark.createDataFrame([(k, text(50) + passage * (k % 3 == 0) + text(50)) for k in range(9000)], "doc_id long, text string").repartition(4)
    sent = docs.mapInArrow(substring._send_runs(64), "bucket int, blob binary").collect()
    sizes = {}
    for r in sent:
        sizes[r["bucket"]] = sizes.get(r["bucket"], 0) + len(substring._unpack(r["blob"])[3])
    assert max(sizes.values()) < 3 * np.median(list(sizes.values()))


NAMES = "_n_bytes", "_n_removed", "__fp", "_fp", "_row", "_digest", "_root", "_id", "__key", "_key", "__kept", "__lost", "n_words", "h", "node", "key"


def clashing(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    return docs.select("*", *(F.lit(k).alias(n) for k, n in enumerate(NAMES)))


def test_operators_bear_clashing_names(spark):
    long = " ".join(f"w{k}" for k in range(80))
    docs = clashing(spark, [(1, long, "en", "s", 1), (2, long, "en", "s", 2), (3, None, None, None, None)])
    for f, left in ((near.similar_dedup, 2), (simhash.near_dedup, 2), (substring.drop_repeats, 2), (quality.apply_quality, 2)):
        out = f(docs)
        assert out.columns == docs.columns and out.count() == left, f
    assert substring.cut_repeats(docs, with_rows=True).count() == 3


def test_ties_are_ordered(spark):
    rows = [(1, " ".join(f"w{k}" for k in range(60)), "en", s, n) for s in "ab" for n in (1, 2)]
    for f in (near.similar_dedup, simhash.near_dedup):
        kept = {tuple(f(clashing(spark, rows).repartition(n)).first()) for n in (1, 2, 3)}
        assert len(kept) == 1


PIPE_DOC = "doc_id long, text string, lang string, source string, n_chars int"


def pipeline_rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    good = [text(90) for _ in range(12)]
    passage = text(40)
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(good)]
    rows += [(20, good[0], "en", "s", 1), (21, good[1] + " extra", "en", "t", 1), (22, f"{text(60)} {passage}", "en", "s", 1), (23, f"{text(60)} {passage} {text(9)}", "en", "s", 1)]
    rows += [(24, "too short", "en", "s", 1), (25, None, None, None, None), (26, "", "en", "s", 0), (None, good[2], "en", "s", 1), (None, text(70), "en", None, 1), (3, good[3], "en", "s", len(good[3]))]
    leak = text(30)
    rows.append((27, f"{text(50)} {leak} {text(20)}", "en", "s", 1))
    return rows, leak


def test_the_whole_pipeline_against_brute_force(spark, tmp_path):
    import hashlib
    import re

    import tiktoken

    from marlstone.llm import bpe, decontaminate
    from marlstone.llm.queries import vocabulary
    from tests.llm.test_near import plain_groups

    rows, leak = pipeline_rows()
    spark.createDataFrame(rows, PIPE_DOC).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    def good(t):  # no line is frequent here, so the base rules decide
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        seen = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        cover = {k + j for k, x in enumerate(seen) if seen.count(x) > 1 for j in range(3)}
        return len(w) >= 50 and 100 * len(cover) <= 50 * len(w)

    now = [(r[0], r[1]) for r in rows if good(r[1])]
    stay, once = plain_groups(now), []
    for i, t in now:
        if i in stay and (i is not None or t not in {x for k, x in now if k is not None}):
            stay.remove(i)
            once.append((i, t))
    cut = [(i, left) for i, _, removed, _, _, left in plain_cut(once) if not removed or left.strip()]
    b = decontaminate.normalise(leak)
    clean = [(i, t) for i, t in cut if b not in decontaminate.normalise(t)]
    own = tiktoken.Encoding("own", pat_str=vocabulary()[1], mergeable_ranks=bpe.load(*vocabulary()).ranks, special_tokens={})
    want = sorted((str(i), hashlib.sha256(" ".join(map(str, own.encode_ordinary(t))).encode()).hexdigest()) for i, t in clean)
    assert sorted((str(r["doc_id"]), r["ids_sha256"]) for r in got) == want and 10 < len(want) < len(rows)


def test_the_pipeline_on_empty_and_null_tables(spark, tmp_path):
    for name, rows in (("none", []), ("nulls", [(None, None, None, None, None)] * 3)):
        spark.createDataFrame(rows, PIPE_DOC).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        assert corpus_pipeline.run(spark, f"{tmp_path}/{name}").count() == 0


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_the_columns(spark, sf_dir, stage):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert stage(spark, docs, sf_dir).schema.fieldNames() == docs.columns
