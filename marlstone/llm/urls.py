"""URL filters with redirect equivalence.  DataFrame functions only.

Rules name a host and a path prefix; the longest that fits decides a url.  Urls
without a rule take the decision of their aliases: pages are joined to the
targets of their redirects and canonical links, connected components are found
by distributed star steps, and a component with an allowed url allows, else one
with a blocked url blocks, else the default holds.

Aliases are compared in a normal form (scheme and host in lower case, no default
port, no dot segments, no fragment, an empty path is ``/``), and go through the
star steps as 128-bit digests, so no url is shuffled in each round.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.stage import write_stage
from marlstone.llm.components import connected_components

#: Up to so many rules are folded into one expression; more are a table that urls are joined to, with the same result.
MOST_RULES = 1000
_A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1), _A_TO_Z, _A_TO_Z.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


VERDICT = "struct<rule:string,verdict:string>"


def rule_column(rules: list[UrlRule], host: Column, path: Column) -> Column:
    """The fitting rule with the longest name as ``struct(rule, verdict)``, else null: one test a rule."""
    ranked = sorted(rules, key=lambda r: (-len(r.name), r.verdict != "allow", r.name))
    out = None
    for r in ranked:
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        value = F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.lit(None).cast(VERDICT) if out is None else out


def with_rules(urls: DataFrame, rules: list[UrlRule]) -> DataFrame:
    """``urls(host, path, ...)`` with the fitting rule as ``r``, by an expression or, for many rules, by joins.

    The joins meet a url at each suffix of its host, take the lengths of the paths
    that rules of that host have, and look the prefixes up: a url meets each rule
    that fits it and no other, so a host with many rules or urls costs no product.
    """
    if len(rules) <= MOST_RULES:
        return urls.withColumn("r", rule_column(rules, F.col("host"), F.col("path")))
    spark = urls.sparkSession
    table = spark.createDataFrame([(r.host, r.path, r.verdict) for r in rules], "rhost string, rpath string, verdict string")
    table = table.groupBy("rhost", "rpath").agg(F.min("verdict").alias("verdict"))  # allow before block
    lengths = table.groupBy("rhost").agg(F.array_sort(F.collect_set(F.length("rpath"))).alias("lengths"))
    own = urls.select("host", "path").distinct()
    parts = F.split("host", "\\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    met = own.withColumn("rhost", F.explode(suffixes)).join(lengths, "rhost")
    asked = met.withColumn("n", F.explode("lengths")).filter(F.col("n") <= F.length("path")).withColumn("rpath", F.expr("left(path, n)"))
    fits = asked.join(table, ["rhost", "rpath"]).withColumn("rule", F.concat("rhost", "rpath"))
    best = fits.groupBy("host", "path").agg(F.min(F.struct(-F.length("rule"), F.col("verdict"), F.col("rule"))).alias("b"))
    best = best.select(F.col("host").alias("__host"), F.col("path").alias("__path"), F.struct(F.col("b.rule").alias("rule"), F.col("b.verdict").alias("verdict")).alias("r"))
    return urls.join(best, (F.col("host") == F.col("__host")) & (F.col("path") == F.col("__path")), "left").drop("__host", "__path")


def _attribute(tag: Column, name: str) -> Column:
    return F.regexp_extract(tag, f"(?is)\\b{name}\\s*=\\s*[\"']?([^\"'\\s>]+)", 1)


#: Character references that urls are written with (fixed values); ``&amp;`` comes last.
ENTITIES = [("&quot;|&#34;|&#x22;", '"'), ("&apos;|&#39;|&#x27;", "'"), ("&lt;|&#60;|&#x3c;", "<"), ("&gt;|&#62;|&#x3e;", ">"), ("&#47;|&#x2f;|&sol;", "/"), ("&#58;|&#x3a;|&colon;", ":"), ("&#61;|&#x3d;|&equals;", "="), ("&amp;|&#38;|&#x26;", "&")]


def decode_entities(text: Column) -> Column:
    for pattern, char in ENTITIES:
        text = F.regexp_replace(text, f"(?i){pattern}", char)
    return text


def live_html(html: Column) -> Column:
    """A page without comments, scripts and styles."""
    return F.regexp_replace(html, "(?is)<!--.*?(?:-->|$)|<(script|style|template)\\b.*?(?:</\\1\\s*>|$)", " ")


def link_targets(html: Column) -> Column:
    """Targets of canonical links and meta refreshes in a page, with character references decoded."""
    links = F.regexp_extract_all(html, F.lit("(?is)<link\\b[^>]*\\brel\\s*=\\s*[\"']?canonical\\b[^>]*>"), 0)
    metas = F.regexp_extract_all(html, F.lit("(?is)<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*[\"']?refresh\\b[^>]*>"), 0)
    found = F.concat(
        F.transform(links, lambda t: _attribute(t, "href")),
        F.transform(metas, lambda t: F.regexp_extract(t, "(?is)\\burl\\s*=\\s*[\"']?([^\"'\\s>]+)", 1)),
    )
    return F.filter(F.transform(found, decode_entities), lambda x: x != "")


def absolute(base: Column, target: Column) -> Column:
    """A target as seen from a page: absolute, or relative to scheme, host or folder."""
    scheme = F.regexp_extract(base, "(?s)^(.*?)://", 1)
    site = F.regexp_extract(base, "(?s)^.*?://[^/?#]*", 0)
    folder = F.regexp_extract(base, "(?s)^.*?://[^/?#]*(?:[^?#]*/)?", 0)
    folder = F.when(folder == site, F.concat(site, F.lit("/"))).otherwise(folder)
    return (
        F.when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(site, target))
        .otherwise(F.concat(folder, target))
    )


def without_dots(path: Column) -> Column:
    """A path from ``/`` on with ``.`` and ``..`` segments resolved."""
    start = F.array().cast("array<string>")
    up = lambda a: F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))
    segments = F.slice(F.split(path, "/", -1), F.lit(2), F.greatest(F.size(F.split(path, "/", -1)) - 1, F.lit(0)))
    walked = F.aggregate(segments, start, lambda a, x: F.when(x == "..", up(a)).when(x == ".", a).otherwise(F.concat(a, F.array(x))))
    closed = F.when(path.rlike("/\\.\\.?$") & (F.size(walked) > 0), F.lit("/")).otherwise(F.lit(""))
    return F.concat(F.lit("/"), F.array_join(walked, "/"), closed)


def normal_url(url: Column) -> Column:
    """The form in which aliases are compared; null where there is no ``://``."""
    scheme = F.lower(F.regexp_extract(url, "(?s)^(.*?)://", 1))
    port = F.when(scheme == "http", ":80$").when(scheme == "https", ":443$").otherwise(F.lit("(?!)"))
    host = F.regexp_replace(F.regexp_replace(host_of(url), F.lit(":$"), F.lit("")), port, F.lit(""))
    path = F.when(path_of(url) == "", F.lit("/")).otherwise(path_of(url))
    path = F.when(path.contains("/."), without_dots(path)).otherwise(path)
    query = F.regexp_extract(url, "(?s)^[^?#]*(\\?[^#]*)", 1)
    return F.when(url.contains("://"), F.concat(scheme, F.lit("://"), host, path, query))


def url_node(normal: Column) -> Column:
    """A 128-bit digest that stands for a normal url."""
    return F.unhex(F.md5(normal.cast("binary")))


def page_edges(pages: DataFrame) -> DataFrame:
    """``(a, b)`` normal urls that the pages' redirects and canonical links make equivalent."""
    some = pages.filter(F.col("url").contains("://") & F.col("html").rlike("(?i)canonical|refresh"))
    aimed = some.select("url", F.explode(link_targets(live_html(F.col("html")))).alias("target"))
    return aimed.select(normal_url(F.col("url")).alias("a"), normal_url(absolute(F.col("url"), F.col("target"))).alias("b")).filter("a is not null and b is not null")


def judge_urls(pages: DataFrame, rules: list[UrlRule], redirects: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for every row of ``pages(page_id, url, html)``.

    ``redirects`` adds edges ``(a, b)`` known from elsewhere.  Null urls and urls
    without ``://`` have an empty host and path, no rule, and the default verdict.
    Repeated rows are judged each; an empty table gives no row; other columns are
    not read.  Very long urls and pages are read whole.
    """
    own = pages.select("page_id", "url", "html")
    edges = page_edges(own)
    if redirects is not None:
        a, b = redirects.columns[:2]
        edges = edges.union(redirects.select(normal_url(F.col(a)).alias("a"), normal_url(F.col(b)).alias("b")).filter("a is not null and b is not null"))
    edges, _ = write_stage(edges.filter("a <> b").distinct(), "links")
    roots, _ = write_stage(connected_components(edges.select(url_node(F.col("a")).alias("a"), url_node(F.col("b")).alias("b"))), "aliases")
    placed = own.select("page_id", url_node(normal_url(F.col("url"))).alias("node"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = with_rules(placed, rules)
    # Pages vote as they are written, targets that may be no page of this table by their normal form.
    ends = edges.select(F.explode(F.array("a", "b")).alias("url")).distinct()
    ends = with_rules(ends.select(url_node(F.col("url")).alias("node"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), rules)
    said = ends.select("node", F.col("r.verdict").alias("v")).unionByName(ruled.select("node", F.col("r.verdict").alias("v"))).filter("v is not null")
    votes = said.join(roots, "node").groupBy("root").agg(F.bool_or(F.col("v") == "allow").alias("allowed"), F.bool_or(F.col("v") == "block").alias("blocked"))
    decided = votes.select("root", F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").alias("shared")).filter("shared is not null")
    aliases = roots.join(decided, "root").select("node", "shared")
    return ruled.join(aliases, "node", "left").select(
        "page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce(F.col("r.verdict"), F.col("shared"), F.lit(default)).alias("verdict")
    )
