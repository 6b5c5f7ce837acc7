import pytest

from marlstone.functions import stage
from marlstone.operators import edges
from marlstone.plans import queries
from marlstone.plans import tables as T
from marlstone.plans.registered import SQL
from tests.oracle import connect, rows_of_spark, rows_of_sql

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars int"


def write(spark, path, rows):
    spark.createDataFrame([(k, t, lang, source, len(t or "")) for k, t, lang, source in rows], DOCUMENTS).write.parquet(f"{path}/documents.parquet")
    return str(path)


def corpus():
    words = [f"{a}{b}word" for a in "abcdef" for b in "uvwxyz"]
    rows = []
    for k in range(120):
        lines = [" ".join(words[(k * 7 + n * 5 + m * (k + 3)) % 36] for m in range((k + n) % 6)) for n in range(7)]
        rows.append((k, "\n".join(lines), "en" if k % 3 else "de", "src" if k % 2 else "a/b"))
    return [*rows, (200, None, "en", "src"), (201, "", "en", "src"), (202, "Error error\nError resultx Result éabcde fghijé\r\nabcdeéfghij", "en", "src")]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("once"), corpus())


@pytest.mark.parametrize("name", ["lexical_edges", "incremental_edges", "incremental_merged"])
def test_marked_references_equal_sql(spark, tables, name):
    query = getattr(queries, name)
    got = rows_of_spark(query(spark, tables))
    assert got == rows_of_sql(connect(tables), SQL[name]) and got[1]


def test_marks_equal_symbols(spark, tmp_path):
    where = write(spark, tmp_path, [*corpus(), (300, "start " + "other " * 100_001 + "start", "en", "src")])
    symbols = T.symbols(spark, where).filter("language is not null")
    defs = T.token_definitions(spark, where).select("language", "name", "path")
    assert sorted(map(tuple, defs.collect())) == sorted(map(tuple, symbols.filter("role = 'definition'").select("language", "name", "path").distinct().collect()))
    marked = T.marked_references(spark, where).select("language", "source", "symbol", "ord", "own")
    named = symbols.filter("role = 'reference'").join(symbols.filter("role = 'definition'").selectExpr("language", "name", "path", "true as own").distinct(), ["language", "name", "path"], "left")
    want = named.filter("lower(name) not in ('error', 'result')").selectExpr("language", "path", "name", "ord", "own is not null")
    assert sorted(map(tuple, marked.collect())) == sorted(map(tuple, want.collect()))


def test_tokens_are_not_written_and_edges_are_not_shuffled(spark, tmp_path, monkeypatch):
    where, labels = write(spark, tmp_path, corpus()), []
    for module in (queries, edges):
        monkeypatch.setattr(module, "write_stage", lambda df, label: labels.append(label) or stage.write_stage(df, label))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if changed names were many
    try:
        plan = queries.incremental_merged(spark, where)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "tokens" not in labels
    lines = plan.splitlines()
    # Lists of targets are taken apart above all shuffles and joins of their references.
    taken = [k for k, x in enumerate(lines) if "Generate explode(" in x]
    assert taken and not any("Exchange" in x or "Join" in x for x in lines[: taken[0]])


def test_paths_that_repeat_take_the_general_way(spark, tmp_path):
    """A line of one row defines names for the other row of its file."""
    where = write(spark, tmp_path, [*corpus(), (7, "fuword auword\nbuword", "en", "src"), (7, "dvword buword auword", "en", "src")])
    assert queries._token_definitions(spark, where) is None
    symbols = queries._token_symbols(spark, where)
    want = edges.resolve_names(symbols).select("source", "ord", "symbol", "target", "tier", "n_candidates")
    got = sorted(map(tuple, queries.lexical_edges(spark, where).collect()))
    assert got == sorted(map(tuple, want.collect())) and any(r[:4] == ("src/en/doc_7", 1, "buword", "src/en/doc_7") for r in got)
