from marlstone.llm import quality


def test_frequent_lines_are_cut(spark):
    body = lambda k: "\n\n".join(" ".join(f"w{k}x{i}y{j}" for i in range(30)) for j in range(3))
    rules = quality.QualityRules(line_min_docs=5, line_host_percent=10)
    top, end = "Home | About", "All rights reserved"
    rows = [(k, f" {top.upper()} \n{body(k)}\n{end}\t\n{end}", "a", 7) for k in range(10)]
    rows += [(k % 10, t, s, n) for k, t, s, n in rows[:1]] + [(50, f"{body(50)}\n{top}", "b", 7), (51, None, "a", 7), (52, f"{end}\n{body(52)}", None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int")
    kept = quality.apply_quality(docs, rules)
    want = [(k, body(k), "a", len(body(k))) for k in [0, *range(10)]] + [(50, rows[11][1], "b", 7), (52, rows[13][1], None, 7)]
    assert kept.schema == docs.schema and sorted(map(tuple, kept.collect()), key=repr) == sorted(want, key=repr)
