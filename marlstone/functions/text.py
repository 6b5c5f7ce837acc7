"""Text expressions: case folding, matching, terms, keywords, token estimates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words that carry no meaning in a task description (fixed values).
STOP_WORDS = ["a", "an", "and", "at", "by", "for", "from", "in", "into", "is", "of", "on", "or", "the", "to", "with"]
#: Symbol names that say little about a target (fixed values).
GENERIC_NAMES = ["data", "default", "error", "item", "key", "main", "new", "result", "self", "value"]
#: Scores of the three modes of a match (fixed values).
EXACT, PREFIX, SUBSTRING = 4_000_000_000, 3_000_000_000, 2_000_000_000
MODE_SCORES = {"exact": EXACT, "prefix": PREFIX, "substring": SUBSTRING}
#: How sure each mode is (fixed values).
MODE_CONFIDENCE = {"exact": "high", "prefix": "high", "substring": "medium"}


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, everything else left alone."""
    return F.translate(c, _UPPER, _UPPER.lower())


def strip_space(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def folded(text: str) -> str:
    """A query text as it is compared: trimmed, A-Z lower-cased."""
    return text.strip().translate(str.maketrans(_UPPER, _UPPER.lower()))


def _graded(value: Column, query: str, mode: str) -> Column:
    hit = {"exact": value == query, "prefix": value.startswith(query), "substring": value.contains(query)}[mode]
    return F.when(hit, MODE_SCORES[mode]).cast("long")


def text_score(c: Column, query: str, mode: str = "substring") -> Column:
    """Match score of a text without regard to ASCII case; null where it doesn't match or the query is empty.

    The mode alone sets the score: a substring query scores as one also where the text equals it.
    """
    q = folded(query)
    return _graded(ascii_lower(c), q, mode) if q else F.lit(None).cast("long")


def query_path(text: str) -> str:
    """A path as a query gives it: trimmed, ``\\`` is ``/``, a leading ``./`` goes."""
    return re.sub(r"^(\./)+", "", text.strip().replace("\\", "/"))


def path_score(c: Column, query: str, mode: str = "substring") -> Column:
    """Match score of a path; case counts, and both sides are taken as ``query_path`` takes them."""
    q = query_path(query)
    subject = F.regexp_replace(F.replace(strip_space(c), F.lit("\\"), F.lit("/")), r"^(\./)+", "")
    return _graded(subject, q, mode) if q else F.lit(None).cast("long")


def matched_keywords(message: Column, keywords: list[str], mode: str = "word") -> Column:
    """The keywords a message holds, distinct and sorted; ``word`` asks for word borders (letters, digits, ``_``)."""
    text, kept = F.lower(message), sorted({k.lower() for k in keywords if k})
    found = []
    for k in kept:
        hit = text.rlike(rf"(?U)(?<![\p{{L}}\p{{N}}_]){re.escape(k)}(?![\p{{L}}\p{{N}}_])") if mode == "word" else text.contains(k)
        found.append(F.when(hit, F.lit(k)))
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def task_terms(task: Column) -> Column:
    """Terms of a task description: split at what is no letter, digit; three bytes at least; no stop words."""
    words = F.split(task, r"[^\p{L}\p{N}]+", -1)
    return F.filter(words, lambda w: (F.octet_length(w) >= 3) & ~ascii_lower(w).isin(STOP_WORDS))


def seeds(values: list[str]) -> list[str]:
    """Seeds as a task gives them: trimmed, without empty ones, in order of the text without ASCII case, each once."""
    kept: dict[str, str] = {}
    for v in sorted((v.strip() for v in values), key=folded):
        if v:
            kept.setdefault(folded(v), v)
    return list(kept.values())


def seed_rows(rows: DataFrame, value: Column, order: Column) -> DataFrame:
    """``(key, seed)`` of a table's seeds as in ``seeds``; of equal ones the first in an order stands."""
    own = rows.select(strip_space(value).alias("v"), order.alias("o")).filter("v <> ''")
    return own.groupBy(ascii_lower(F.col("v")).alias("key")).agg(F.min_by("v", "o").alias("seed"))


def token_estimate(c: Column) -> Column:
    """A quarter of the characters, rounded up, at least one."""
    return F.greatest(F.lit(1), F.ceil(F.length(c) / 4)).cast("long")


def bounded(c: Column, most: int) -> Column:
    """At most ``most`` characters, with an ellipsis where some are cut."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("…"))).otherwise(c)


def compact_context(c: Column, most: int = 180) -> Column:
    """One line: white space collapsed, bounded."""
    return bounded(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), most)


def is_generic_name(c: Column) -> Column:
    return ascii_lower(c).isin(GENERIC_NAMES)


def stable_id(kind: str, *parts: Column) -> Column:
    """``kind:`` and 16 hex digits of a digest of the parts, nulls kept apart from empty texts."""
    body = F.to_json(F.struct(*(p.cast("string").alias(f"p{k}") for k, p in enumerate(parts))), {"ignoreNullFields": "false"})
    return F.concat(F.lit(f"{kind}:"), F.substring(F.sha2(body, 256), 1, 16))


def month_of(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM")


def rfc3339(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def capture_date(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd")


def escape_markdown(c: Column) -> Column:
    """Control characters become spaces; characters that Markdown reads get a backslash."""
    return F.regexp_replace(F.regexp_replace(c, r"[\p{Cc}]", " "), r"([\\`*_\[\]<>|#])", r"\\$1")
