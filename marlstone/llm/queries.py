"""The registered queries over the corpus tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.stage import drop_stage, stage_path
from marlstone.llm import alignment, bpe, chat, decontaminate, langid, passages, quality, simhash, substring, tandem, toxicity, urls, warc
from marlstone.llm.common import let, table, whole_texts, words_of


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -1 whose texts are control strings."""
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    return chat.chat_digests(chat.format_chats(chat.conversation_events(rows)))


OP3_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), joined AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(length(role) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + 24) AS formatted_chars
  FROM rows GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM joined
"""


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"), shingle=4)


RULES = quality.QualityRules()


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_verdicts(table(spark, sf_dir, "documents"), RULES)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP8_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), places AS (
  SELECT r, i, (w[i], w[i + 1], w[i + 2]) AS win FROM docs, unnest(generate_series(1, len(w) - 2)) AS t(i)
), twice AS (
  SELECT p.r, p.i FROM places p JOIN (SELECT r, win FROM places GROUP BY r, win HAVING count(*) > 1) d ON p.r = d.r AND p.win = d.win
), repeated AS (
  SELECT r, count(*) AS n FROM (
    SELECT DISTINCT r, i + k AS at FROM twice, (VALUES (0), (1), (2)) AS s(k)
  ) GROUP BY r
), lines AS (
  SELECT r, source, text, trim(lower(u), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line
  FROM docs, unnest(l) AS t(u)
), frequent AS (
  SELECT source, line FROM (
    SELECT coalesce(source, chr(0)) AS source, line, count(DISTINCT text) AS n FROM lines GROUP BY ALL
  ) JOIN (SELECT coalesce(source, chr(0)) AS source, count(DISTINCT text) AS total FROM docs GROUP BY ALL) USING (source)
  WHERE n > {RULES.line_min_docs} AND 100 * n > {RULES.line_host_percent} * total
), lost AS (
  SELECT r, sum(length(lines.line)) AS n FROM lines JOIN frequent f ON coalesce(lines.source, chr(0)) = f.source AND lines.line = f.line GROUP BY r
), base AS (
  SELECT r, doc_id, length(text) AS chars, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words, coalesce(lost.n, 0) AS removed
  FROM docs LEFT JOIN repeated USING (r) LEFT JOIN lost USING (r)
), judged AS (
  SELECT *, n_words < {RULES.min_words} OR 100 * n_repeat_words > {RULES.max_repeat_percent} * n_words AS base_failed FROM base
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND 100 * (chars - removed) >= {RULES.min_left_percent} * chars AS kept
FROM judged
"""

URL_RULES = [
    urls.UrlRule("allow", "com", "/"),
    urls.UrlRule("block", "example.com", "/en/"),
    urls.UrlRule("allow", "www.example.com", "/en/"),
    urls.UrlRule("block", "net", "/es/"),
    urls.UrlRule("block", "net", "/fr/"),
]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


#: Without alias edges the method's verdict is the default; the tables' pages have none (tests cover edges).
OP10_SQL = r"""
WITH parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), rules(verdict, rhost, rpath) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), ranked AS (
  SELECT row_number() OVER () AS r, * FROM parts
), best AS (
  SELECT r, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM ranked JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY r
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM ranked LEFT JOIN best USING (r)
"""


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out_of_training = langid.held_out(F.col("doc_id"), 4, 2)
    model = langid.train(docs.filter(~out_of_training))
    return langid.identify(docs, model).select("doc_id", out_of_training.alias("held_out"), "lang_pred", "score")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def vocabulary() -> tuple[str, str]:
    """The rank file and pattern of the registered encoding."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), *vocabulary())


def op11_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.align_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.cut_passages(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM docs, unnest(generate_series(1, len(w) - 12)) AS t(i)
), hit AS (
  SELECT r, i FROM win JOIN (SELECT s, min(doc_id) AS first_id FROM win GROUP BY s) USING (s) WHERE doc_id > first_id
), lost AS (
  SELECT DISTINCT r, i + k AS i FROM hit, (SELECT unnest(generate_series(0, 12)) AS k)
), kept AS (
  SELECT p.r, count(lost.i) AS n_removed, string_agg(CASE WHEN lost.i IS NULL THEN p.word END, ' ' ORDER BY p.i) AS left_over
  FROM (SELECT r, unnest(generate_series(1, len(w))) AS i, unnest(w) AS word FROM docs) AS p LEFT JOIN lost ON lost.r = p.r AND lost.i = p.i GROUP BY p.r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(left_over, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)
"""


def periodic(docs: DataFrame) -> DataFrame:
    """Documents, of which a tenth by a digest of their id repeat some of their words to the end, with the period and from the word that the digest says."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def repeated(words):
        n = F.size(words)

        def of(a):
            period = 1 + F.floor((n - a) / (3 + g % 8))
            return F.array_join(F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + (i - a) % period).cast("int")))), " ")

        return F.when(n > 0, let(g % n, of)).otherwise(F.lit(""))

    return docs.select("doc_id", F.when(h % 10 == 0, let(words_of(F.col("text")), repeated)).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tandem.collapse_runs(periodic(table(spark, sf_dir, "documents")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out_of_training = langid.held_out(F.col("doc_id"), 5, 0)
    rows = toxicity.training_sample(docs, table(spark, sf_dir, "labels").filter(~out_of_training))
    scored = toxicity.score_documents(docs, toxicity.train(rows))
    return scored.select("doc_id", out_of_training.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.cut_repeats(table(spark, sf_dir, "documents"))


def damaged(pages: DataFrame) -> DataFrame:
    """Pages as a replica holds them that lost a byte of some: those whose size leaves 5 modulo 97."""
    hit = (F.octet_length("html") % 97 == 5) & (F.length("html") > 16)
    return pages.withColumn("html", F.when(hit, F.overlay("html", F.lit("#"), F.lit(16), F.lit(1))).otherwise(F.col("html")))


def op7_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of the archive that all pages make, against a replica: WARC files with damaged records, written to the shared folder, read and parsed."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    replica = stage_path(spark, "replica")
    warc.write_warc(damaged(pages), replica, compression="gzip")
    found = warc.audit(warc.archive(pages), warc.read_warc(spark, replica, bodies=False))
    drop_stage(spark, replica)  # the audit has taken down what it holds
    return found


OP7_SQL = f"""
WITH both_sides AS (
  SELECT page_id, url, coalesce(html, '') AS html, 0 AS side FROM pages
  UNION ALL
  SELECT page_id, url, CASE WHEN strlen(html) % 97 = 5 AND length(html) > 16 THEN html[1:15] || '#' || html[17:] ELSE coalesce(html, '') END, 1 FROM pages
), texts AS (
  SELECT side, page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '')
    || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html AS t
  FROM both_sides
), records AS (
  SELECT side, coalesce(CAST(page_id // {warc.PAGES_PER_FILE} AS BIGINT), -1) AS file, page_id, strlen(t) + 4 AS length, sha256(t) AS sha256 FROM texts
), placed AS (
  SELECT side, file, length, sha256, sum(length) OVER (PARTITION BY side, file ORDER BY page_id NULLS FIRST, sha256 ROWS UNBOUNDED PRECEDING) - length AS "offset" FROM records
), a AS (SELECT * FROM placed WHERE side = 0), b AS (SELECT * FROM placed WHERE side = 1)
SELECT coalesce(a.file, b.file) AS file, CAST(coalesce(a."offset", b."offset") AS BIGINT) AS "offset",
  CASE WHEN b.file IS NULL THEN 'missing' WHEN a.file IS NULL THEN 'extra' ELSE 'changed' END AS status,
  CAST(a.length AS BIGINT) AS length, a.sha256, CAST(b.length AS BIGINT) AS replica_length, b.sha256 AS replica_sha256
FROM a FULL JOIN b ON a.file = b.file AND a."offset" = b."offset"
WHERE a.sha256 IS DISTINCT FROM b.sha256 OR a.length IS DISTINCT FROM b.length
"""

QUERIES = {
    query.__name__: whole_texts(query)
    for query in (op1_suffix_dedup, op2_language_id, op3_chat_format, op4_decontaminate, op5_byte_bpe, op6_simhash, op7_warc_audit, op8_quality_rules, op9_toxicity, op10_url_filter, op11_cross_tokenizer, op12_substring_dedup, op13_periodic_runs)
}
SQL = {"op3_chat_format": OP3_SQL, "op7_warc_audit": OP7_SQL, "op8_quality_rules": OP8_SQL, "op10_url_filter": OP10_SQL, "op12_substring_dedup": OP12_SQL}
