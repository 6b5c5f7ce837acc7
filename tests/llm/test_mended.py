import io
import random
import time
import zlib

import pytest
from pyspark.sql import functions as F

from marlstone.llm import decontaminate, near, quality, toxicity, warc


def test_one_text_of_an_id_is_learned_whatever_the_order(spark):
    rows = [(1, "b"), (1, "a"), (1, None), (2, "x"), (3, None)]
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    got = {tuple(toxicity.training_sample(spark.createDataFrame(order, "doc_id long, text string").repartition(n), labels)) for n in (1, 3) for order in (rows, rows[::-1])}
    assert len(got) == 1
    (one,) = got
    assert [y for _, y in one] == [1, 0, 0] and one[1:] == (("x", 0), ("", 0))


def test_cut_of_many_lines_is_linear(spark):
    common = [f"a line that many pages have, number {k}" for k in range(300)]
    rng = random.Random(1)
    own = lambda i, n: [" ".join(str(rng.random()) for _ in range(4)) for _ in range(n)]
    rows = [(i, "h", "\n".join(own(i, 40) + common[:20])) for i in range(60)]
    long = own(99, 200_000)
    for k in range(0, 200_000, 7):
        long[k] = common[k % 20]
    rows.append((99, "h", "\n".join(long)))
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string")
    began = time.time()
    got = {r["doc_id"]: r["text"] for r in quality.apply_quality(frame).collect()}
    assert time.time() - began < 90
    assert got[99] == "\n".join(x for x in long if x not in set(common[:20]))


@pytest.mark.parametrize("said", ["abc", "-37", "1e3", "+5", "٣", "5 5"])
def test_damaged_lengths_end_a_file(spark, tmp_path, said):
    good = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    bad = f"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: {said}\r\n\r\nhi\r\n\r\n".encode()
    found = list(warc.parse_records(good + bad + good))
    assert [(at, n, h["warc-type"], body) for at, n, h, body in found] == [(0, len(good), "response", b"hi"), (len(good), len(bad) + len(good), "damaged", b"")]
    (tmp_path / "file=0").mkdir()
    (tmp_path / "file=0" / "part.gz").write_bytes(_gzip(good + bad))
    rows = warc.read_warc(spark, str(tmp_path)).orderBy("offset").collect()
    assert [r["type"] for r in rows] == ["response", "damaged"]


def _gzip(data):
    out, packer = io.BytesIO(), zlib.compressobj(wbits=31)
    out.write(packer.compress(data) + packer.flush())
    return out.getvalue()


def test_long_texts_are_searched_in_pieces(monkeypatch):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(900)]
    item = " ".join(rng.choice(words) for _ in range(30))
    items = [(1, item.encode()), (2, b"zz y"), (3, b"q")]
    index = decontaminate.build_index(items)
    filler = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [filler(3000), " ".join([filler(700), item, filler(900), "zz y", filler(300)]), " ".join([filler(1500), item.replace("w1", "w2", 1), filler(1500), "xq q", filler(40)]), "q" * 9000, ""]
    texts = [t.encode() for t in texts]
    whole = decontaminate.find_passages(texts, index)
    monkeypatch.setattr(decontaminate, "BYTES_AT_ONCE", 1500)
    pieces = decontaminate.find_everywhere(texts, index)
    assert [(t, i) for t, i, *_ in pieces] == [(t, i) for t, i, *_ in whole] and {(1, 1), (1, 2), (2, 1), (2, 3)} <= {(t, i) for t, i, *_ in whole}
    assert [(s, e, d) for t, i, s, e, d in pieces if i > 1] == [(s, e, d) for t, i, s, e, d in whole if i > 1]
    assert all(d <= w for (*_, d), (*_, w) in zip(pieces, whole, strict=True))


def test_counts_of_many_tasks_are_added_in_parts(spark):
    texts = spark.range(2000).select(F.col("id").cast("string").cast("binary").alias("node"), F.concat(F.lit("one two three four five "), F.col("id")).alias("text"))
    few, many = near.shingle_counts(texts.repartition(2)), near.shingle_counts(texts.repartition(300))
    assert (few == many).all() and few.max() >= 2000 and few.sum() == 2 * 2000
