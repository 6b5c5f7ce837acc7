"""Quality rules with cross-document line frequency.  DataFrame functions only.

Two parts.  The base rules look at one text: length, repeated three-word
windows.  The corpus rule hashes normalised lines, counts on how many distinct
documents of a host each occurs, removes the lines above the limit, and rejects
documents that lose most of their words.

A document that is repeated exactly counts once in the line counts (distinct
texts are counted), so copies of a clean document don't turn its lines into
boilerplate.  The count is a two-level aggregation with partial sums: a line on
a third of all documents is no hot key there.  Frequent lines meet the
documents' lines in an equi-join that adaptive execution splits or broadcasts
by measured size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import fresh, let, SPACES, words_of


@dataclass(frozen=True)
class QualityRules:
    """Limits. A line is removed from a host when its distinct documents exceed both line limits.

    The count limit decides on hosts of up to ``100 * line_min_docs /
    line_host_percent`` (400) distinct texts.  On larger ones the share does, whatever
    their size: boilerplate is what stands on that part of a host, so a host of
    3 million texts loses lines that stand on over 150,000 of them.
    """

    min_words: int = 50
    max_repeat_percent: int = 50
    line_min_docs: int = 20
    line_host_percent: int = 5
    min_left_percent: int = 30


def repeat_words(words: Column) -> Column:
    """How many words lie in a three-word window that occurs twice or more.

    Windows are sorted by 40 hash bits with their place in the low 24, all in one
    long; only windows whose neighbour shares those bits are compared in full.  A
    text of 2**24 words or more is compared in full from the start.
    """

    def window(w: Column, i: Column) -> Column:
        return F.struct(F.get(w, i).alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"))

    def counted(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(w) - 3)
        packed = F.transform(
            places,
            lambda i: F.shiftleft(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), 24).bitwiseOR(i.cast("long")),
        )
        near = let(
            F.sort_array(packed),
            lambda s: F.filter(
                s,
                lambda x, k: (F.shiftright(x, 24) == F.shiftright(F.get(s, k - 1), 24))
                | F.coalesce(F.shiftright(x, 24) == F.shiftright(F.get(s, k + 1), 24), F.lit(False)),
            ),
        )
        few = F.transform(near, lambda x: x.bitwiseAND(F.lit((1 << 24) - 1)).cast("int"))
        return let(
            F.when(F.size(w) < 1 << 24, few).otherwise(places),
            lambda near_places: F.when(F.size(near_places) == 0, F.lit(0).cast("long")).otherwise(_covered(w, near_places, window)),
        )

    return let(words, lambda w: F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(counted(w)))


def _covered(w: Column, places: Column, window) -> Column:
    """Words under the windows at ``places`` that equal another window there."""
    full = F.sort_array(F.transform(places, lambda i: F.struct(window(w, i).alias("w"), i.alias("i"))))
    twice = let(
        full,
        lambda s: F.filter(
            s,
            lambda x, k: F.coalesce(x["w"] == F.get(s, k - 1)["w"], F.lit(False)) | F.coalesce(x["w"] == F.get(s, k + 1)["w"], F.lit(False)),
        ),
    )
    order = F.sort_array(F.transform(twice, lambda x: x["i"]))
    # Windows in order of place: each adds the words that the one before it doesn't cover.
    return let(
        order,
        lambda o: F.aggregate(
            F.transform(o, lambda x, k: F.least(F.lit(3), x - F.coalesce(F.get(o, k - 1), x - 3)).cast("long")),
            F.lit(0).cast("long"),
            lambda a, x: a + x,
        ),
    )


def base_measures(docs: DataFrame) -> DataFrame:
    """``docs`` with the base measures of ``text`` (null counts as empty) as further columns."""
    whole = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    split = docs.withColumn("__words", words_of(F.col("text")))
    words = F.col("__words")
    return split.select(
        *docs.columns,
        F.length(whole).cast("long").alias("n_text_chars"),
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        (F.length(whole) - F.length(F.regexp_replace(whole, "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        repeat_words(words).alias("n_repeat_words"),
    )


def base_failed(rules: QualityRules) -> Column:
    return (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))


def all_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def normalised_lines(text: Column) -> Column:
    """The lines of a text that hold a word, trimmed and in lower case."""
    return F.filter(F.transform(all_lines(F.lower(text)), lambda x: F.btrim(x, F.lit(SPACES))), lambda x: x != "")


def _key(*parts: Column) -> Column:
    """A digest that names a row by its content: rows that agree in it get the same result."""
    return F.md5(F.concat_ws("\x00", *(F.coalesce(p.cast("string"), F.lit("\x01")) for p in parts)))


def frequent_lines(docs: DataFrame, rules: QualityRules) -> DataFrame:
    """``(host, line)`` hashes of the lines that too many distinct texts of a host hold; a null text is an empty one."""
    docs = docs.withColumn("text", F.coalesce("text", F.lit("")))
    # Digests of a text are made before its lines are rows: beside an explode they would be made for each line.
    texts = docs.select(F.xxhash64("host").alias("host"), F.xxhash64("text").alias("print"), F.array_distinct(F.transform(normalised_lines(F.col("text")), lambda x: F.xxhash64(x))).alias("lines"))
    texts = texts.select("host", "print", F.explode("lines").alias("line"))
    held = texts.groupBy("host", "line").agg(F.count_distinct("print").alias("n"))
    hosts = docs.groupBy(F.xxhash64("host").alias("host")).agg(F.count_distinct(F.xxhash64("text")).alias("of"))
    return held.filter(F.col("n") > rules.line_min_docs).join(hosts, "host").filter(100 * F.col("n") > rules.line_host_percent * F.col("of")).select("host", "line")


def quality_verdicts(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """Per row of ``docs(doc_id, source, text)``: measures, ``removed_chars``, ``lost_lines``, ``base_failed``, ``kept``.

    ``lost_lines`` are the places of the frequent lines among all lines of the
    text, null where it has none.

    ``source`` is the host; null hosts form one host.  A null text has no words
    and so fails the base rules.  Repeated rows get the same verdict each.  An
    empty table gives no row.  Other columns are not read.
    """
    keyed = _keyed(docs)
    measured = base_measures(keyed).drop("host", "text")
    lost = _lost_chars(keyed, frequent_lines(keyed, rules))
    joined = measured.join(lost, "key", "left").withColumn("removed_chars", F.coalesce("removed_chars", F.lit(0).cast("long")))
    depleted = 100 * (F.col("n_text_chars") - F.col("removed_chars")) < rules.min_left_percent * F.col("n_text_chars")
    return joined.withColumn("base_failed", base_failed(rules)).withColumn("kept", ~F.col("base_failed") & ~depleted)


def _keyed(docs: DataFrame) -> DataFrame:
    own = docs.select("doc_id", F.col("source").alias("host"), "text")
    return own.withColumn("key", _key(F.col("doc_id"), F.col("host"), F.col("text")))


def _lost_chars(keyed: DataFrame, frequent: DataFrame) -> DataFrame:
    """``(key, removed_chars, lost_lines)`` of the rows that lose lines; rows of equal content count once."""
    lines = F.transform(all_lines(F.lower("text")), lambda x, k: F.struct(k.alias("at"), F.btrim(x, F.lit(SPACES)).alias("x")))
    held = keyed.select(F.xxhash64("host").alias("host"), "key", F.explode(F.filter(lines, lambda l: l["x"] != "")).alias("l"))
    hits = held.select("host", "key", "l.at", F.xxhash64("l.x").alias("line"), F.length("l.x").alias("chars")).join(frequent, ["host", "line"])
    return hits.dropDuplicates(["key", "at"]).groupBy("key").agg(F.sum("chars").alias("removed_chars"), F.collect_list("at").alias("lost_lines"))


def apply_quality(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The rows of ``docs`` that pass, without their frequent lines.

    ``n_chars``, where ``docs`` has it, is the new length of a text that lost
    lines; all else stays as it was, whatever the other columns' names.
    """
    verdicts = quality_verdicts(docs, rules).filter(~F.col("kept") | F.col("lost_lines").isNotNull())
    key, kept, lost = fresh(docs.columns, "key", "kept", "lost")
    changes = verdicts.select(F.col("key").alias(key), F.col("kept").alias(kept), F.col("lost_lines").alias(lost)).dropDuplicates([key])
    marked = docs.withColumn(key, _key(F.col("doc_id"), F.col("source"), F.col("text")))
    passed = marked.join(changes, key, "left").filter(F.coalesce(kept, F.lit(True)))
    # Numbers of lines are set apart by hash, so the cut is linear in them.
    left = let(all_lines(F.col("text")), lambda ls: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col(lost)), lambda k: F.get(ls, k)), "\n"))
    cut = passed.withColumn("text", F.when(F.col(lost).isNull(), F.col("text")).otherwise(left))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col(lost).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return cut.select(*docs.columns)
