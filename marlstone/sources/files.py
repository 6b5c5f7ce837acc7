"""Files of a worktree, their manifests and their symbols."""

from __future__ import annotations

import ast
import json
import tomllib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.paths import basename, in_scope, language_of
from marlstone.functions.stage import import_on_workers
from marlstone.operators.topology import file_classes, omission_reason
from marlstone.sources.lexing import Symbol, lexed_symbols

MAX_BYTES = 1 << 20
ITEMS_MOST = 16


def read_worktree(spark: SparkSession, repository: str, max_bytes: int = MAX_BYTES, exclude: list[str] = (), focus_paths: list[str] = (), recursive: bool = False, scope: str = ".") -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(sources, omissions, nested)`` of a worktree.

    Sources are ``(path, size, text, sha256, language, classifications)``.  Every
    other path stands among the omissions with its reason, ignored and oversized
    ones too; ``nested`` are the repositories inside.  Text is null where bytes hold
    a NUL or aren't UTF-8.  Dot names are files like any other.
    """
    from marlstone.sources.git import read_git

    raw = read_git(spark, "git_worktree", repository.removeprefix("file://"), max_bytes=max_bytes, recursive=str(recursive).lower()).filter(in_scope(F.col("path"), scope))
    nested = raw.filter("kind = 'nested_repository'").select("path")
    binary = F.position(F.lit(b"\0"), F.col("content")) > 0
    told = raw.filter("kind <> 'nested_repository'").withColumn("text", F.when(~binary, F.try_validate_utf8(F.col("content").cast("string")))).withColumn("sha256", F.sha2("content", 256)).drop("content")
    told = told.withColumn("language", language_of(F.col("path"), F.substring_index("text", "\n", 1))).withColumn("classifications", file_classes(F.col("path"), F.coalesce("text", F.lit(""))))
    reason = omission_reason(F.col("path"), F.col("size"), F.col("text"), F.col("kind") == "symlink", F.col("language"), max_bytes, exclude, focus_paths)
    reason = F.when(~F.col("visible"), "ignored_untracked").when(F.col("kind") == "unreadable", "read_error").otherwise(reason)
    judged = told.withColumn("reason", reason)
    return judged.filter("reason is null").select("path", "size", "text", "sha256", "language", "classifications"), judged.filter("reason is not null").select("path", "size", "reason", "classifications"), nested


def manifest_items(name: str, text: str) -> list[tuple[str, str, str]]:
    """``(kind, name, target)`` of entry points, library exports and commands that a manifest declares."""
    out: list[tuple[str, str, str]] = []

    def exports(value, key: str = ".") -> None:
        if isinstance(value, str):
            out.append(("library_export", key, value))
        elif isinstance(value, dict):
            for k in sorted(value):
                exports(value[k], k if k.startswith(".") else key)

    low = name.lower()
    try:
        data = json.loads(text) if low == "package.json" else tomllib.loads(text)
    except (ValueError, RecursionError):
        return [("unreadable", name, "")]
    if low == "package.json" and isinstance(data, dict):
        for k in ("main", "module"):
            if isinstance(data.get(k), str):
                out.append(("library_export", k, data[k]))
        exports(data.get("exports"))
        bins = data.get("bin")
        for k, v in sorted((bins if isinstance(bins, dict) else {str(data.get("name", "bin")): bins} if bins else {}).items()):
            out.append(("entry_point", k, str(v)))
        out += [("command", k, str(v)) for k, v in sorted((data.get("scripts") or {}).items())]
        out.append(("role", "workspace" if data.get("workspaces") else "package", ""))
    elif low == "cargo.toml":
        out += [("entry_point", str(b.get("name", "")), str(b.get("path", f"src/bin/{b.get('name', '')}.rs"))) for b in data.get("bin", [])]
        if "package" in data:
            out += [("entry_point", str(data["package"].get("name", "")), "src/main.rs"), ("library_export", str(data["package"].get("name", "")), str(data.get("lib", {}).get("path", "src/lib.rs")))]
        out.append(("role", "workspace" if "workspace" in data else "package" if "package" in data else "unknown", ""))
    elif low == "pyproject.toml":
        project = data.get("project", {})
        out += [("entry_point", k, str(v)) for k, v in sorted(project.get("scripts", {}).items())]
        out.append(("role", "package" if project or "poetry" in data.get("tool", {}) else "unknown", ""))
    counts: dict[str, int] = {}
    kept = []
    for item in out:
        counts[item[0]] = counts.get(item[0], 0) + 1
        if counts[item[0]] <= ITEMS_MOST:
            kept.append(item)
    return kept


def manifests(files: DataFrame) -> DataFrame:
    """``(path, kind, name, target, resolved_path)`` of manifests; targets resolve only to known paths."""
    import_on_workers(files.sparkSession)
    own = files.filter(F.lower(basename(F.col("path"))).isin("cargo.toml", "package.json", "pyproject.toml") & F.col("text").isNotNull()).select("path", "text")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, *item) for p, t in zip(f["path"], f["text"], strict=True) for item in manifest_items(p.rsplit("/", 1)[-1], t)]
            yield pd.DataFrame(rows, columns=["path", "kind", "name", "target"])

    found = own.mapInPandas(run, "path string, kind string, name string, target string")
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", "[^/]*$", "")).otherwise("")
    asked = found.withColumn("__at", F.concat(folder, F.regexp_replace("target", r"^(\./)+", "")))
    known = files.select(F.col("path").alias("__at"), F.col("path").alias("resolved_path"))
    return asked.join(known, "__at", "left").drop("__at")


SYMBOL_SCHEMA = "path string, ord int, name string, kind string, role string, scope array<string>, line int, column int, end_line int, end_column int, context string, visibility string, evidence string, status string"

#: The order of a row's values in a task: the path, the number, the symbol, what hangs on the text.
_FIELDS = ["path", "ord", "name", "kind", "role", "scope", "line", "column", "end_line", "end_column", "visibility", "evidence", "context", "status"]
_ARROW = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}


def _in_order(symbol: Symbol) -> tuple:
    return (symbol[4], symbol[5], symbol[2], symbol[0], symbol[6:])


def python_symbols(text: str) -> list[Symbol]:
    """Symbols of a Python text by its syntax tree; places count code points."""
    lines, out = text.split("\n"), []

    def place(node: ast.AST, name: str = "") -> tuple[int, int, int, int]:
        """Where a node lies; a definition from its name on."""
        line, byte = node.lineno, node.col_offset
        column = len(lines[line - 1].encode()[:byte].decode(errors="ignore")) + 1
        if name:
            word = "class" if isinstance(node, ast.ClassDef) else "def"
            column = lines[line - 1].find(name, lines[line - 1].find(word, column - 1) + len(word)) + 1 or column
        end = node.end_lineno or line
        return line, column, end, len(lines[end - 1].encode()[: node.end_col_offset or 0].decode(errors="ignore")) + 1

    def refer(node: ast.AST, scope: tuple[str, ...], evidence: str) -> None:
        if isinstance(node, ast.Name):
            out.append((node.id, "type" if evidence == "type_reference" else "identifier", "reference", scope, *place(node), "unknown", evidence))
        elif isinstance(node, ast.Attribute):
            line, column, end, last = place(node)
            out.append((node.attr, "identifier", "reference", scope, end, max(1, last - len(node.attr)), end, last, "unknown", "member_reference" if evidence == "bare_reference" else evidence))
            visit(node.value, scope, False)
        elif isinstance(node, ast.Constant) or node is None:
            return
        else:
            for child in ast.iter_child_nodes(node):
                refer(child, scope, evidence) if evidence == "type_reference" else visit(child, scope, False)

    def visit(node: ast.AST, scope: tuple[str, ...], in_class: bool) -> None:
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            is_class = isinstance(node, ast.ClassDef)
            hidden = node.name.startswith("_") and not node.name.endswith("__")
            out.append((node.name, "class" if is_class else "method" if in_class else "function", "definition", scope, *place(node, node.name), "private" if hidden else "public", "declaration"))
            for decorator in node.decorator_list:
                visit(decorator, scope, False)
            if is_class:
                for base in node.bases:
                    refer(base, scope, "type_reference")
            else:
                args = node.args
                for a in (*args.posonlyargs, *args.args, *args.kwonlyargs, *filter(None, (args.vararg, args.kwarg))):
                    refer(a.annotation, scope, "type_reference")
                refer(node.returns, scope, "type_reference")
                for default in (*args.defaults, *(d for d in args.kw_defaults if d)):
                    visit(default, scope, False)
            for child in node.body:
                visit(child, (*scope, node.name), is_class)
        elif isinstance(node, ast.Import | ast.ImportFrom):
            out.extend(((a.asname or a.name).split(".")[-1], "import", "definition", scope, *place(node), "unknown", "import") for a in node.names)
        elif isinstance(node, ast.Call):
            refer(node.func, scope, "call") if isinstance(node.func, ast.Name | ast.Attribute) else visit(node.func, scope, False)
            for child in (*node.args, *(k.value for k in node.keywords)):
                visit(child, scope, False)
        elif isinstance(node, ast.AnnAssign):
            refer(node.annotation, scope, "type_reference")
            visit(node.target, scope, False)
            if node.value:
                visit(node.value, scope, False)
        elif isinstance(node, ast.Name | ast.Attribute):
            if isinstance(node.ctx, ast.Load) or isinstance(node, ast.Attribute):
                refer(node, scope, "bare_reference")
        else:
            for child in ast.iter_child_nodes(node):
                visit(child, scope, in_class)

    visit(ast.parse(text), (), False)
    return out


def extract_symbols(files: DataFrame, most: int = 2048, columns: list[str] | None = None, evidence: tuple[str, ...] = ()) -> DataFrame:
    """Symbols of source files, up to ``most`` a file in order of place.

    Python is parsed, other languages are read by the lexer.  Files whose blocks don't
    close, Python that doesn't parse and files with more symbols are ``partial``.
    Only ``columns`` are made (all by default), and only rows of some ``evidence``, if any is given;
    ``ord``, ``status`` and what ``most`` leaves go by all symbols.
    """
    import_on_workers(files.sparkSession)
    own = files.filter(F.col("language").isNotNull() & F.col("text").isNotNull()).select("path", "language", "text")
    made = [c.split() for c in SYMBOL_SCHEMA.split(", ")]
    schema = pa.schema([(n, _ARROW[t]) for n, t in made if columns is None or n in columns])
    wanted = set(evidence)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = [_FIELDS.index(n) for n in schema.names]
        with_context = "context" in schema.names
        for batch in batches:
            rows = []
            for path, language, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found, whole = [], False
                if language == "python":
                    try:
                        found, whole = python_symbols(text), True
                    except (SyntaxError, ValueError, RecursionError):
                        found = []
                else:
                    found, whole = lexed_symbols(text, language)
                lines, found = text.split("\n") if with_context else [], sorted(set(found), key=_in_order)
                status = "analyzed" if whole and len(found) <= most else "partial"
                for k, symbol in enumerate(found[:most]):
                    if wanted and symbol[9] not in wanted:
                        continue
                    line = symbol[4]
                    context = " ".join(lines[line - 1].split())[:180] if line <= len(lines) else ""
                    rows.append((path, k, *symbol, context, status))
            values = list(zip(*rows, strict=True)) if rows else [()] * len(_FIELDS)
            yield pa.RecordBatch.from_arrays([pa.array(values[i], f.type) for i, f in zip(at, schema, strict=True)], schema=schema)

    return own.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in made if n in schema.names))
