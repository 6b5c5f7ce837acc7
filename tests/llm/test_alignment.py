import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest

from marlstone.llm import alignment, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
EMPTY = [0, 0, 0, 0, 0, 0, ""]


@pytest.fixture(scope="module")
def tokenizers():
    return alignment.Tokenizers(A, B)


def plain_groups(tokenizers, text):
    """Groups by whole texts and sets of ends."""
    if not text:
        return None
    a = tokenizers.a.encode(f" {text}", add_special_tokens=False).ids
    b = tokenizers.b.encode(text)
    whole = f" {text}".encode()
    ends = []
    for ids, spelled in ((a, tokenizers.a_bytes), (b, tokenizers.b_bytes)):
        if b"".join(spelled[t] for t in ids) != whole:
            return None
        at, own = 0, []
        for t in ids:
            at += len(spelled[t])
            own.append(at)
        ends.append(own)
    shared = sorted(set(ends[0]) & set(ends[1]))
    return [
        (tuple(t for t, e in zip(a, ends[0]) if lo < e <= hi), tuple(t for t, e in zip(b, ends[1]) if lo < e <= hi)) for lo, hi in zip([0, *shared], shared)
    ]


def plain(tokenizers, rows):
    found = [(i, plain_groups(tokenizers, t)) for i, t in rows]
    docs = Counter()
    for _, groups in found:
        docs.update({(x, y) for a, b in groups or () for x in a for y in b})
    most = {}
    for (x, _), n in docs.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for i, groups in found:
        if groups is None:
            out.append((i, *EMPTY))
            continue
        links = [(x, y) for a, b in groups for x in a for y in b]
        said = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        out.append((
            i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sum(docs[p] == most[p[0]] for p in links), sum(docs[p] for p in links), hashlib.sha256(said.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def run(spark, rows, schema="doc_id long, text string"):
    return sorted((tuple(r) for r in alignment.align_documents(spark.createDataFrame(rows, schema), A, B).collect()), key=repr)


ODD = [
    None, "", " ", "  x", "x  ", "a b", "a  b", "a\n b", "a \nb", "\tx y", "don't it's", "<|endoftext|> <s> </s> <unk>", "▁ here", "x▁y", "日本語 のテキスト 😀 é", "é ê x", " x y", "\x1c a \x1c b", "a\x00b c", "0 12 345,6",
    "ﬁ ﬀ ①", "é x", "word " * 300, "z" * 3000, " " * 3000, "...!!! ?? --",
]


def test_against_plain_code(spark, tokenizers):
    assert tokenizers.parts
    rng = random.Random(3)
    letters = ["a", "B", " ", "  ", "\n", "é", "本", "😀", "'s", "1", ".", "the", "ing ", " of", " ", "\t"]
    texts = [*ODD, *("".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(150))]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, "a b"), (None, "a b"), (None, None)]
    assert run(spark, rows) == plain(tokenizers, rows)


def test_portions_make_no_difference(spark, tokenizers):
    rows = [(k, f"word{k % 7} the ünit {'x' * (k % 5)}") for k in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in alignment.Alignment(frame, A, B, pack_bytes=100).documents().collect()), key=repr) == plain(tokenizers, rows)


def test_registered_query_against_plain_code(spark, sf_dir, tokenizers):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in queries.QUERIES["op11_cross_tokenizer"](spark, sf_dir).collect()), key=repr)
    assert got == plain(tokenizers, rows)


def test_empty_table_and_clashing_columns(spark):
    assert run(spark, []) == []
    rows = [(1, "a b", "x", 2, "k"), (2, None, None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id int, text string, key string, portion int, docs string")
    got = {r.doc_id: r.n_a for r in alignment.align_documents(frame, A, B).collect()}
    assert got[2] == 0 and got[1] == 2


def test_a_group_is_counted_once_a_document_and_pair(spark):
    frame = spark.createDataFrame([(1, "the the the"), (2, "the")], "doc_id long, text string")
    pairs = alignment.Alignment(frame, A, B).pairs().collect()
    assert [(r.docs) for r in pairs] == [2]
