"""Lexical edges: references resolved to the files that define their names.

``symbols(path, ord, name, kind, role, evidence, context, visibility)`` with the
file's ``language`` and, for packages, ``modules`` (an array).

What a reference resolves to hangs on its file and name alone, for an import on
its line as well.  So *questions* are resolved, each once, to an array of
candidates; references meet these arrays, and only then are edges exploded.

Where no import says more than its name (``by_name_alone``), references are told
apart inside their files, and what stands in many rows is only the key of a list
of candidates: the lists themselves meet rows last and never travel with them.
References that come marked already (whether their own file defines the name) are
cut, marked and dealt in one pass; an update leaves out and chooses references,
not edges, each of which would stand for up to ``MOST_CANDIDATES`` rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.paths import parent, suffixes
from marlstone.functions.stage import growing, write_stage
from marlstone.functions.text import is_generic_name
from marlstone.operators.budget import top_per_key

MOST_CANDIDATES = 32
#: Kinds of definitions that can be the target of an edge (fixed values).
TARGET_KINDS = ["function", "struct", "enum", "trait", "type", "const", "static", "module", "macro", "class", "method", "interface"]
#: Tiers of a resolution, strongest first, with their names and confidence.
TIERS = {0: ("same_file_explicit", "high"), 1: ("same_module", "high"), 2: ("imported_module", "high"), 3: ("imported_name", "medium")}
#: Endings that a module hint drops, one after another (fixed values).
HINT_ENDINGS = ["/__init__", "/mod", ".js", ".ts", ".tsx", ".py", ".rb", ".rs", ".java", ".cs", ".go", ".lua", ".rockspec", ".zig"]


def definitions(symbols: DataFrame) -> DataFrame:
    """One row per (language, name, path) that defines a name; the smallest visibility label stands."""
    some = symbols.filter((F.col("role") == "definition") & F.col("kind").isin(TARGET_KINDS))
    return some.groupBy("language", "name", "path").agg(F.min("visibility").alias("visibility"))


def references(symbols: DataFrame) -> DataFrame:
    """Imports, and references that are neither bare, a member, nor a field; generic names say nothing."""
    imported = (F.col("role") == "definition") & (F.col("evidence") == "import")
    explicit = (F.col("role") == "reference") & ~F.col("evidence").isin("bare_reference", "member_reference") & (F.col("kind") != "field")
    return symbols.filter((imported | explicit) & ~is_generic_name(F.col("name")))


def normalise_hint(c: Column) -> Column:
    c = F.regexp_replace(c, "^[\"'`;,]+|[\"'`;,]+$", "")
    c = F.regexp_replace(F.regexp_replace(c, r"^(\./)+", ""), r"^(\.\./)+", "")
    c = F.replace(c, F.lit("\\"), F.lit("/"))
    for ending in HINT_ENDINGS:
        c = F.regexp_replace(c, "(" + ending.replace(".", r"\.") + ")+$", "")
    return F.lower(F.regexp_replace(F.replace(c, F.lit("::"), F.lit("/")), "^/+|/+$", ""))


def module_hints(context: Column, language: Column) -> Column:
    """What an import line says of its module: a quoted text (in Lua with dots as slashes too), the word after ``from``, parts with ``::`` or ``/``."""
    double, single = F.regexp_extract(context, '"([^"]*)"', 1), F.regexp_extract(context, "'([^']*)'", 1)
    quoted = normalise_hint(F.when(context.rlike('"[^"]*"'), double).otherwise(single))
    dotted = F.when((language == "lua") & quoted.contains("."), F.replace(quoted, F.lit("."), F.lit("/")))
    after = normalise_hint(F.regexp_extract(context, r"(?:^|\s)from\s+(\S+)", 1))
    parts = F.filter(F.split(context, r"[\s;,()]+", -1), lambda p: p.contains("::") | p.contains("/"))
    hints = F.concat(F.array(quoted, F.coalesce(dotted, F.lit("")), after), F.transform(parts, normalise_hint))
    return F.array_sort(F.array_distinct(F.filter(hints, lambda h: h != "")))


def import_names(name: Column, context: Column, hints: Column) -> Column:
    """Names that an import can stand for: its own, what stands before ``as`` and after ``import``, and the last parts of its hints."""
    words = F.filter(F.split(context, r"[^\p{L}\p{N}_]+", -1), lambda w: w != "")
    places = F.when(F.size(words) > 1, F.sequence(F.lit(1), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))
    at = lambda k: F.element_at(words, k)
    before = F.transform(places, lambda k: F.when(at(k + 1) == "as", at(k)))
    after = F.transform(places, lambda k: F.when(at(k) == "import", at(k + 1)))
    last = F.transform(hints, lambda h: F.element_at(F.split(h, "/", -1), -1))
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(F.array(name), before, after, last))))


def hint_keys(hint: Column) -> Column:
    """What a path must end in, by component, to answer a hint: the hint, or its module without crate, self, super."""
    module = F.when(hint.contains("/"), F.regexp_replace(hint, "/[^/]*$", "")).otherwise(hint)
    for word in ("crate/", "self/", "super/"):
        module = F.regexp_replace(module, f"^({word})+", "")
    return F.array_distinct(F.array(hint, module))


def path_keys(path: Column) -> Column:
    """All that a path can answer: its own ends, marked ``=``, and its folder's ends, marked ``/``."""
    whole = normalise_hint(path)
    own = F.transform(suffixes(whole), lambda s: F.concat(F.lit("="), s))
    folder = F.transform(suffixes(parent(whole)), lambda s: F.concat(F.lit("/"), s))
    return F.array_distinct(F.concat(own, folder))


def hint_matches(hints: DataFrame, paths: DataFrame) -> DataFrame:
    """``(source, target)`` where a hint of ``hints(source, hint)`` names a path: an equi-join on exploded ends."""
    last = F.element_at(F.split("hint", "/", -1), -1)
    asked = hints.withColumn("key", F.explode(F.concat(F.transform(hint_keys(F.col("hint")), lambda k: F.concat(F.lit("="), k)), F.array(F.concat(F.lit("/"), last)))))
    answers = paths.select(F.col("path").alias("target"), F.explode(path_keys(F.col("path"))).alias("key"))
    return asked.join(growing(answers), "key").select("source", "target").distinct()


QUESTION = ["language", "source", "symbol", "context"]


def questions(symbols: DataFrame) -> DataFrame:
    """``(language, source, symbol, context, modules)``: what there is to resolve, once each; ``context`` is null but for imports."""
    line = F.when(F.col("role") == "definition", F.coalesce("context", F.lit("")))
    refs = references(symbols).select("language", F.col("path").alias("source"), F.col("name").alias("symbol"), line.alias("context"), "modules")
    return refs.dropDuplicates(QUESTION)


def answers(asked: DataFrame, symbols: DataFrame, candidates: int = MOST_CANDIDATES) -> DataFrame:
    """``(language, source, symbol, context, tier, targets)`` for each of ``questions`` that has an answer.

    Each candidate gets the tier by which it is reached: the same file; for Go,
    the same folder with a common package; a file that an import of the source
    names; any file, where the source imports the name.  Candidates of the
    strongest tier stay, the first ``candidates`` by path, as an array of
    ``(target, visibility)``.

    An import also asks for the names that it renames or takes from a module, and
    only in files that its own line names, if it names any; where that finds
    nothing it asks as any reference does.  A name that many files define meets
    its questions as one array of its first ``candidates`` files.
    """
    # Each is read several times below: written once, not made anew.
    hinted_asks = asked.select(*QUESTION, "modules", F.when(F.col("context").isNotNull(), module_hints(F.col("context"), F.col("language"))).alias("hints"))
    named, _ = write_stage(hinted_asks.withColumn("names", F.when(F.col("context").isNotNull(), import_names(F.col("symbol"), F.col("context"), F.col("hints")))), "questions")
    defs, _ = write_stage(definitions(symbols), "definitions")
    imports = symbols.filter("role = 'definition' and evidence = 'import'").withColumn("hints", module_hints(F.coalesce("context", F.lit("")), F.col("language")))
    imports, _ = write_stage(imports.select("path", "name", "hints").distinct(), "imports")
    found = defs.select("language", F.col("name").alias("wanted"), F.col("path").alias("target"), "visibility")
    of_file = [*QUESTION, "target", "visibility"]
    hints = named.filter("size(hints) > 0").select(F.explode("hints").alias("hint")).unionByName(imports.filter("size(hints) > 0").join(growing(named.select("source")), F.col("path") == F.col("source"), "left_semi").select(F.explode("hints").alias("hint"))).distinct()
    some_hints = not hints.isEmpty()
    some_go = not defs.filter("language = 'go'").isEmpty()
    if some_hints or some_go:
        files, _ = write_stage(symbols.select("path", "modules").dropDuplicates(["path"]), "files")
    plain_name = F.array("symbol")
    wide, near = named, []
    if some_hints:
        led, _ = write_stage(hint_matches(hints.select(F.col("hint").alias("source"), "hint"), files.select("path")).withColumnRenamed("source", "hint"), "led")
        # Imports whose own line names files.
        strict = named.filter("size(hints) > 0").select(*QUESTION, "modules", F.explode("hints").alias("hint"), "names").join(growing(led), "hint")
        strict = strict.select(*QUESTION, "modules", "target", F.explode("names").alias("wanted")).distinct().join(growing(found), ["language", "wanted", "target"]).join(growing(files.select(F.col("path").alias("target"), F.col("modules").alias("own"))), "target", "left")
        same_folder = (F.col("language") == "go") & (parent(F.col("source")) == parent(F.col("target"))) & F.arrays_overlap("modules", "own")
        strict, _ = write_stage(strict.select(*of_file, F.when(F.col("source") == F.col("target"), 0).when(same_folder, 1).otherwise(2).alias("tier")), "strict")
        near.append(strict)
        # All others, and imports whose line led to no definition.
        done = strict.select(*QUESTION).distinct()
        wide = named.filter("context is null").unionByName(named.filter("context is not null").join(growing(done), QUESTION, "left_anti"))
    wide = wide.withColumn("names", F.when(F.size("hints") == 0, F.col("names")).otherwise(plain_name)).withColumn("names", F.coalesce("names", plain_name))
    asks, _ = write_stage(wide.select(*QUESTION, "modules", F.explode("names").alias("wanted")), "asks")
    near.append(asks.join(growing(found.withColumnRenamed("target", "source").withColumn("target", F.col("source"))), ["language", "wanted", "source"]).select(*of_file, F.lit(0).alias("tier")))
    if some_go:
        go = found.filter("language = 'go'").join(growing(files.select(F.col("path").alias("target"), F.col("modules").alias("own"))), "target").withColumn("folder", parent(F.col("target")))
        near.append(asks.filter("language = 'go'").withColumn("folder", parent(F.col("source"))).join(growing(go.drop("language")), ["wanted", "folder"]).filter((F.col("source") != F.col("target")) & F.arrays_overlap("modules", "own")).select(*of_file, F.lit(1).alias("tier")))
    if some_hints:
        linked = imports.select(F.col("path").alias("source"), F.explode("hints").alias("hint")).distinct().join(growing(led), "hint").select("source", "target").distinct()
        near.append(asks.join(growing(linked), "source").join(growing(found), ["language", "wanted", "target"]).select(*of_file, F.lit(2).alias("tier")))

    near = reduce(DataFrame.unionByName, near)
    near = near.groupBy(*QUESTION, "tier", "target").agg(F.min("visibility").alias("visibility"))
    first = top_per_key(near, [*QUESTION, "tier"], [F.asc("target")], candidates)
    met = first.groupBy(*QUESTION).agg(F.min("tier").alias("tier"), F.array_sort(F.collect_list(F.struct("tier", "target", "visibility"))).alias("every"))
    strong = met.select(*QUESTION, "tier", F.transform(F.filter("every", lambda x: x["tier"] == F.col("tier")), lambda x: F.struct(x["target"].alias("target"), x["visibility"].alias("visibility"))).alias("targets"))

    # The weakest tier: the source imports the name itself.
    lists = top_per_key(defs, ["language", "name"], [F.asc("path")], candidates).groupBy("language", F.col("name").alias("wanted")).agg(F.array_sort(F.collect_list(F.struct(F.col("path").alias("target"), "visibility"))).alias("targets"))
    says = imports.select(F.col("path").alias("source"), F.col("name").alias("symbol")).distinct()
    weak = asks.join(growing(says), ["source", "symbol"], "left_semi").join(growing(lists), ["language", "wanted"])
    single = weak.filter("context is null").select(*QUESTION, "targets")
    several = weak.filter("context is not null").groupBy(*QUESTION).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("targets")))).alias("all"))
    # One file that defines two of the names stands once, with its smaller visibility label.
    unique = F.filter("all", lambda x, k: (k == 0) | (x["target"] != F.col("all")[F.greatest(k - 1, F.lit(0))]["target"]))
    weak = single.unionByName(several.select(*QUESTION, F.slice(unique, 1, candidates).alias("targets"))).withColumn("weak", F.lit(3))
    both = strong.select(*QUESTION, "tier", F.col("targets").alias("strong")).join(growing(weak.select(*(F.col(c).alias(f"_{c}") for c in QUESTION), "targets", "weak")), _same_question(), "full_outer")
    return both.select(*(F.coalesce(c, f"_{c}").alias(c) for c in QUESTION[:3]), F.when(F.col("source").isNotNull(), F.col("context")).otherwise(F.col("_context")).alias("context"), F.coalesce("tier", "weak").alias("tier"), F.coalesce("strong", "targets").alias("targets"))


def _same_question(other: str = "_") -> Column:
    same = F.col("context").eqNullSafe(F.col(f"{other}context"))
    for c in QUESTION[:3]:
        same = same & (F.col(c) == F.col(f"{other}{c}"))
    return same


def resolve(symbols: DataFrame, candidates: int = MOST_CANDIDATES, asked: DataFrame | None = None) -> DataFrame:
    """Edges ``(source, ord, symbol, target, visibility, tier, n_candidates)`` of all references, or of those of the questions ``asked``.

    A reference that no tier reaches has no edge.
    """
    told = answers(questions(symbols) if asked is None else asked, symbols, candidates)
    told = told.select(*(F.col(c).alias(f"_{c}") for c in QUESTION), "tier", "targets")
    line = F.when(F.col("role") == "definition", F.coalesce("context", F.lit("")))
    refs = references(symbols).select("language", F.col("path").alias("source"), "ord", F.col("name").alias("symbol"), line.alias("context"))
    met = refs.join(growing(told), _same_question())
    return met.select("source", "ord", "symbol", "tier", F.size("targets").alias("n_candidates"), F.explode("targets").alias("t")).select("source", "ord", "symbol", "t.target", "t.visibility", "tier", "n_candidates")


def describe(told: DataFrame) -> DataFrame:
    """Distinct edges of ``answers``, with ambiguity, candidates, their group, reason and confidence."""
    reason = F.element_at(F.create_map(*(x for t, (r, _) in TIERS.items() for x in (F.lit(t), F.lit(r)))), F.col("tier"))
    confidence = F.element_at(F.create_map(*(x for t, (_, c) in TIERS.items() for x in (F.lit(t), F.lit(c)))), F.col("tier"))
    whole = told.select("source", "symbol", "targets", F.transform("targets", lambda t: t["target"]).alias("candidates"), reason.alias("resolution_reason"), confidence.alias("confidence"))
    whole = whole.dropDuplicates(["source", "symbol", "resolution_reason", "candidates"]).withColumn("ambiguous", F.size("candidates") > 1)
    whole = whole.withColumn("candidate_group", F.concat_ws(":", "source", "symbol", "resolution_reason", F.sha2(F.array_join("candidates", "\0"), 256)))
    return whole.withColumn("t", F.explode("targets")).select("source", "t.target", "symbol", "ambiguous", "candidates", "candidate_group", "resolution_reason", "confidence", F.col("t.visibility").alias("target_visibility"))


def by_name_alone(symbols: DataFrame) -> bool:
    """Whether names alone decide: no import has a line, and no definition is of Go, whose packages count."""
    lines = symbols.filter("role = 'definition' and evidence = 'import'").filter(F.coalesce("context", F.lit("")) != "")
    packages = symbols.filter((F.col("role") == "definition") & F.col("kind").isin(TARGET_KINDS) & (F.col("language") == "go"))
    return lines.isEmpty() and packages.isEmpty()


def _of_files(symbols: DataFrame) -> DataFrame:
    """``(language, source, symbol, ord, refers, defines, visibility, says)``: what each symbol does in its file, all of a file in one part."""
    target = (F.col("role") == "definition") & F.col("kind").isin(TARGET_KINDS)
    says = (F.col("role") == "definition") & (F.col("evidence") == "import")
    refers = (F.col("role") == "reference") & ~F.col("evidence").isin("bare_reference", "member_reference") & (F.col("kind") != "field") & ~is_generic_name(F.col("name"))
    rows = symbols.select("language", F.col("path").alias("source"), F.col("name").alias("symbol"), "ord", refers.alias("refers"), target.alias("defines"), F.when(target, F.col("visibility")).alias("visibility"), says.alias("says"))
    return rows.filter("(refers or defines or says) and language is not null").repartition("source")


def candidate_lists(symbols: DataFrame, candidates: int = MOST_CANDIDATES) -> DataFrame:
    """``(language, symbol, targets)``: the first files by path that define each name, as an array of ``(target, visibility)``."""
    return lists_of(definitions(symbols), candidates)


def lists_of(defs: DataFrame, candidates: int = MOST_CANDIDATES) -> DataFrame:
    """``candidate_lists`` of ``definitions``."""
    first = top_per_key(defs, ["language", "name"], [F.asc("path")], candidates)
    return first.groupBy("language", F.col("name").alias("symbol")).agg(F.array_sort(F.collect_list(F.struct(F.col("path").alias("target"), "visibility"))).alias("targets"))


def _marked(symbols: DataFrame) -> DataFrame:
    """``(language, source, ord, symbol, own, visibility)`` of references that their own file defines (``own``) or that it says it imports."""
    same = Window.partitionBy("language", "source", "symbol")
    told = _of_files(symbols).withColumns({"own": F.max("defines").over(same), "visibility": F.min("visibility").over(same), "said": F.max("says").over(same)})
    return told.filter("refers and (own or said)").select("language", "source", "ord", "symbol", "own", "visibility")


def _with_targets(marked: DataFrame, lists: DataFrame) -> DataFrame:
    """References with the array of their ``targets`` and its tier."""
    own = F.array(F.struct(F.col("source").alias("target"), "visibility"))
    met = marked.join(lists.hint("shuffle_hash"), ["language", "symbol"], "left").withColumn("targets", F.when(F.col("own"), own).otherwise(F.col("targets")))
    return met.filter("targets is not null").withColumn("tier", F.when(F.col("own"), 0).otherwise(3))


def _exploded(met: DataFrame) -> DataFrame:
    rows = met.select("language", "source", "ord", "symbol", "tier", F.size("targets").alias("n_candidates"), F.explode("targets").alias("t"))
    return rows.select("source", "ord", "symbol", "t.target", "t.visibility", "tier", "n_candidates", "language")


def resolve_names(symbols: DataFrame, candidates: int = MOST_CANDIDATES, told: DataFrame | None = None) -> DataFrame:
    """``resolve``, with each edge's ``language``, for references that stand in no import, where ``by_name_alone``.

    ``told`` are the symbols among which references are looked for, whole by file and name, if not all are.
    """
    return _exploded(_with_targets(_marked(symbols if told is None else told), candidate_lists(symbols, candidates)))


def first_edges_by_name(symbols: DataFrame, cap: int, candidates: int = MOST_CANDIDATES) -> DataFrame:
    """``first_edges`` of ``resolve_names``: the first ``cap`` references by place and first target hold them, for each has an edge."""
    lists, marked = candidate_lists(symbols, candidates), _marked(symbols)
    heads = marked.join(lists.select("language", "symbol", F.col("targets")[0]["target"].alias("head")), ["language", "symbol"], "left").withColumn("head", F.when(F.col("own"), F.col("source")).otherwise(F.col("head")))
    heads, _ = write_stage(heads.filter("head is not null").orderBy("source", "ord", "head").limit(cap), "heads")
    return first_edges(_exploded(_with_targets(heads, lists)), cap)


def ambiguous_by_name(symbols: DataFrame, candidates: int = MOST_CANDIDATES) -> DataFrame:
    """``ambiguity_findings`` where ``by_name_alone``: a list's digest is made once, and a file that defines the name has one candidate."""
    asked = _of_files(symbols).groupBy("language", "source", "symbol").agg(F.max("refers").alias("refers"), F.max("defines").alias("defines"), F.max("says").alias("says")).filter("refers and says and not defines")
    paths = F.transform("targets", lambda t: t["target"])
    several = candidate_lists(symbols, candidates).filter(F.size("targets") > 1).select("language", "symbol", F.size("targets").alias("candidates"), F.sha2(F.array_join(paths, "\0"), 256).alias("digest"))
    return asked.join(several, ["language", "symbol"]).select(F.concat_ws(":", "source", "symbol", F.lit(TIERS[3][0]), "digest").alias("candidate_group"), "source", "symbol", "candidates")


def reference_counts_by_name(symbols: DataFrame, candidates: int = MOST_CANDIDATES) -> DataFrame:
    """``reference_counts`` where ``by_name_alone``: references of a name are added up before they meet its list."""
    asked = _of_files(symbols).groupBy("language", "source", "symbol").agg(F.sum(F.col("refers").cast("int")).alias("n"), F.max("defines").alias("defines"), F.max("says").alias("says")).filter("n > 0")
    own = asked.filter("defines").select(F.col("source").alias("target"), "symbol", "n")
    named = asked.filter("says and not defines").groupBy("language", "symbol").agg(F.sum("n").alias("n"))
    other = named.join(candidate_lists(symbols, candidates), ["language", "symbol"]).select(F.explode("targets").alias("t"), "symbol", "n").select("t.target", "symbol", "n")
    return own.unionByName(other).groupBy("target", "symbol").agg(F.sum("n").alias("references"))


def resolve_marked(marked: DataFrame, defs: DataFrame, candidates: int = MOST_CANDIDATES) -> DataFrame:
    """``resolve_names`` of references ``(language, source, ord, symbol, own, visibility)`` that their file defines (``own``) or imports, over ``definitions``."""
    return _exploded(_with_targets(marked, lists_of(defs, candidates)))


def update_marked(marked: DataFrame, defs: DataFrame, old: DataFrame, old_defs: DataFrame, changed: DataFrame, candidates: int = MOST_CANDIDATES) -> tuple[DataFrame, DataFrame]:
    """``update_edges_by_name`` over marked references and definitions, now and ``old``: references whose edges stay, and those whose edges are made anew, meet their lists only then.

    The changed paths and names are written, so that they are broadcast where they are few.
    """
    paths, _ = write_stage(changed.select("path").distinct(), "changed")
    inside = paths.select(F.col("path").alias("source"), F.lit(True).alias("__p"))
    names, _ = write_stage(defs.unionByName(old_defs).join(paths, "path", "left_semi").select("language", F.col("name").alias("symbol")).distinct(), "names")
    names = names.withColumn("__n", F.lit(True))
    hit = lambda m: m.join(inside, "source", "left").join(names, ["language", "symbol"], "left")
    kept = hit(old).filter("__p is null and __n is null").select(*old.columns)
    fresh = hit(marked).filter("__p or __n").select(*marked.columns)
    return resolve_marked(kept, old_defs, candidates), resolve_marked(fresh, defs, candidates)


def first_edges(resolved: DataFrame, cap: int) -> DataFrame:
    """The first ``cap`` of the edges that ``resolve`` gives, in order of source, place and target, before repeats are dropped."""
    return resolved.orderBy("source", "ord", "target").limit(cap)


def ambiguity_findings(edges: DataFrame) -> DataFrame:
    return edges.filter("ambiguous").groupBy("candidate_group").agg(F.first("source").alias("source"), F.first("symbol").alias("symbol"), F.max(F.size("candidates")).alias("candidates"))


def reference_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("target", "symbol").agg(F.count("*").alias("references"))


def degrees(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """Incoming, outgoing and all edges of each node that has one."""
    end = lambda c, o, i: F.struct(F.col(c).alias("node"), F.lit(o).alias("o"), F.lit(i).alias("i"))
    ends = edges.select(F.explode(F.array(end(source, 1, 0), end(target, 0, 1))).alias("end")).select("end.*")  # edges are made once
    return ends.groupBy("node").agg(F.sum("i").alias("incoming"), F.sum("o").alias("outgoing"), F.count("*").alias("degree"))


def edge_weight(symbol: Column, confidence: Column, visibility: Column) -> Column:
    """Lexical, confidence and visibility factors of an edge (fixed values)."""
    lexical = F.when(is_generic_name(symbol) | symbol.startswith("_"), 0.25).otherwise(1.0)
    sure = F.when(confidence == "high", 1.0).when(confidence == "medium", 0.5).otherwise(0.25)
    seen = F.when(visibility == "public", 1.0).when(visibility == "internal", 0.8).when(visibility == "private", 0.35).otherwise(0.7)
    return lexical * sure * seen


def changed_names(symbols: DataFrame, changed: DataFrame) -> DataFrame:
    """``(language, name)`` of the definitions in changed files."""
    return definitions(symbols.join(changed.select("path").distinct(), "path", "left_semi")).select("language", "name").distinct()


def affected_questions(symbols: DataFrame, changed: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Questions whose answer a change can touch: those of changed files, and those that ask for a name that a changed file defines or, by the symbols ``before``, did.

    An answer hangs on its file's own lines and on who defines its names, so no
    further file can be touched.
    """
    names = changed_names(symbols, changed)
    if before is not None:
        names = names.unionByName(changed_names(before, changed)).distinct()
    asked, _ = write_stage(questions(symbols), "questions")  # read three times
    wanted = F.when(F.col("context").isNull(), F.array("symbol")).otherwise(import_names(F.col("symbol"), F.col("context"), module_hints(F.col("context"), F.col("language"))))
    spread = asked.select(*QUESTION, F.explode(wanted).alias("name")).join(names, ["language", "name"], "left_semi").select(*QUESTION)
    inside = asked.join(changed.select(F.col("path").alias("source")).distinct(), "source", "left_semi").select(*QUESTION)
    hit = inside.unionByName(spread).distinct().select(*(F.col(c).alias(f"_{c}") for c in QUESTION))
    return asked.join(hit, _same_question(), "left_semi")


def affected_files(symbols: DataFrame, changed: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """``(path)`` of the changed files and of those with an affected question."""
    return affected_questions(symbols, changed, before).select(F.col("source").alias("path")).unionByName(changed.select("path")).distinct()


def asked_symbols(symbols: DataFrame, asked: DataFrame) -> DataFrame:
    """The symbols that answering some questions needs: all of their files, and the definitions of the names that they ask for."""
    wanted = F.when(F.col("context").isNull(), F.array("symbol")).otherwise(import_names(F.col("symbol"), F.col("context"), module_hints(F.col("context"), F.col("language"))))
    names = asked.select("language", F.explode(wanted).alias("name")).distinct()
    files = asked.select(F.col("source").alias("path")).distinct()
    inside = symbols.join(files, "path", "left_semi")
    outside = symbols.filter("role = 'definition' and evidence <> 'import'").join(files, "path", "left_anti").join(names, ["language", "name"], "left_semi")
    return inside.unionByName(outside.select(*inside.columns))


def update_edges(old: DataFrame, symbols: DataFrame, changed: DataFrame, before: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(kept, fresh)``: old edges that a change can't touch, and the affected ones made anew; together they equal a cold build.

    ``old`` are edges that ``resolve`` gave for the symbols ``before``, or for
    fewer files; an edge goes with its question.  Only symbols that the affected
    questions need are resolved.
    """
    asked, _ = write_stage(affected_questions(symbols, changed, before), "asked")
    fresh = resolve(asked_symbols(symbols, asked), asked=asked)
    told = references(symbols).select("language", F.col("path").alias("source"), "ord", F.col("name").alias("symbol"), F.when(F.col("role") == "definition", F.coalesce("context", F.lit(""))).alias("context"))
    gone = told.join(asked.select(*(F.col(c).alias(f"_{c}") for c in QUESTION)), _same_question(), "left_semi").select("source", "ord").distinct()
    left = old.join(changed.select(F.col("path").alias("source")).distinct(), "source", "left_anti")
    return left.join(gone, ["source", "ord"], "left_anti").select(*old.columns), fresh.select(*old.columns)


def update_edges_by_name(old: DataFrame, symbols: DataFrame, changed: DataFrame, before: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``update_edges`` for edges of ``resolve_names``: one goes, and is made anew, with its file or with its name.

    The changed paths and names are written, so that they are broadcast where they are few.
    """
    paths, _ = write_stage(changed.select("path").distinct(), "changed")
    names, _ = write_stage(changed_names(symbols, paths).unionByName(changed_names(before, paths)).distinct(), "names")
    near = symbols.join(paths.withColumn("__p", F.lit(True)), "path", "left").join(names.withColumn("__n", F.lit(True)), ["language", "name"], "left")
    fresh = resolve_names(symbols, told=near.filter("__p or __n").drop("__p", "__n"))
    left = old.join(paths.withColumnRenamed("path", "source"), "source", "left_anti")
    return left.join(names.withColumnRenamed("name", "symbol"), ["language", "symbol"], "left_anti").select(*old.columns), fresh.select(*old.columns)
