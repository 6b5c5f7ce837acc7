import random

from marlstone.llm import decontaminate


def test_every_13_words_are_found(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 10))) for _ in range(500)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    item = text(45)
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "abcde 1234"), (3, "\u6f22\u5b57" * 100 + "\u8a9e")], "item_id long, text string")
    docs = [(k, " ".join([*text(20), *item[k : k + 13], *text(20)])) for k in range(33)]
    docs += [(100, " ".join([*text(20), *item[5:12], *text(20)])), (200, "x y abcde 1234 z w"), (300, "\u4e00" + "\u6f22\u5b57" * 15 + "\u4e01")]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {*((k, 1) for k in range(33)), (200, 2), (300, 3)}
    assert [r["doc_id"] for r in decontaminate.drop_contaminated(docs, bench).collect()] == [100]


def test_long_passages():
    for data in (b"a" * 5000, b"b" * 300 + b" c d", " ".join("w" * (k % 90) + "x" for k in range(90)).encode()):
        spans = decontaminate.passages(data)
        assert spans[0][0] == 0 and max(e for _, e in spans) == len(data) and all(decontaminate.Q <= e - s <= decontaminate.PASSAGE for s, e in spans)
