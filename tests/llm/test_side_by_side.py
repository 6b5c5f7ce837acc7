import random

import pytest
import tiktoken

from marlstone.llm import bpe, near
from marlstone.llm.queries import vocabulary


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=vocabulary()[1], mergeable_ranks=bpe.load(*vocabulary()).ranks, special_tokens={})


def fresh_coder():
    return bpe.PrefixBPE(bpe.load(*vocabulary()).ranks, vocabulary()[1])


def texts(seed, n):
    rng = random.Random(seed)
    parts = ["th", "ing", "Ció", "ñ", "x", "é", "漢", "🙂", "zq", "0", "19", ",;", "'s", " ", "  ", "\n", "\0", " ", "ß"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 80))) for _ in range(n)]


def test_new_short_pieces_are_filled_together(reference, monkeypatch):
    one_by_one = []
    fill = bpe.PrefixBPE.fill
    monkeypatch.setattr(bpe.PrefixBPE, "fill", lambda self, piece, last: one_by_one.append(piece) or fill(self, piece, last))
    some = texts(1, 400)
    assert list(fresh_coder().encode_texts(some)) == [reference.encode_ordinary(t) for t in some]
    assert all(len(p) > bpe.SHORT_PIECE for p in one_by_one)


@pytest.mark.parametrize("memory", [1, 50, 1 << 18])
def test_batches_with_a_full_memory(reference, monkeypatch, memory):
    monkeypatch.setattr(bpe, "PIECE_MEMORY", memory)
    monkeypatch.setattr(bpe, "SIDE_BY_SIDE", 7)
    monkeypatch.setattr(bpe, "PAIR_PLACES", 64)
    coder = fresh_coder()
    some = [*texts(2, 150), "", "y" * 47, "y" * 48, "y" * 49, "zqx" * 400, *texts(2, 50)]
    got = [ids for k in range(0, len(some), 40) for ids in coder.encode_texts(some[k : k + 40])]
    assert got == [reference.encode_ordinary(t) for t in some]
    assert list(coder.encode_texts([])) == []


def test_rows_hold_the_ids_of_their_texts(spark, reference):
    rows = [(k, t) for k, t in enumerate([*texts(3, 600), None, ""])]
    got = {r["doc_id"]: list(r["ids"]) for r in bpe.encode_documents(spark.createDataFrame(rows, "doc_id long, text string"), *vocabulary(), with_ids=True).collect()}
    assert got == {k: reference.encode_ordinary(t or "") for k, t in rows}


def test_texts_of_near_copies_are_not_shuffled_again(spark, monkeypatch):
    docs = spark.createDataFrame([(k, " ".join(texts(k % 40, 30))) for k in range(80)], "doc_id long, text string")
    kept, write = {}, near.write_stage

    def written(df, label):
        if label == "texts":
            kept[len(kept)] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, label)

    monkeypatch.setattr(near, "write_stage", written)
    assert near.similar_dedup(docs).count() == 40
    assert kept and all("text#" not in line for plan in kept.values() for line in exchanges(plan))


def exchanges(plan):
    """What goes into each shuffle of a plan: its own line and those below it."""
    lines = plan.splitlines()
    deep = [len(x) - len(x.lstrip(" :+-|*()0123456789")) for x in lines]
    for k, x in enumerate(lines):
        if "Exchange" in x:
            end = next((n for n in range(k + 1, len(lines)) if deep[n] <= deep[k]), len(lines))
            yield "\n".join(lines[k:end])
