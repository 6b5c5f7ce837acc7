"""Path expressions: scope, ancestors, classification, landmarks, languages."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions.text import ascii_lower

# Names that decide what a path is.
GENERATED_DIRS = ["target", "dist", "build", "_build", "out", "coverage", "generated", "gen", "obj", "bin", ".gradle", ".next", ".nuxt", ".svelte-kit", ".astro", ".turbo", ".vite", ".dart_tool", "tmp"]
VENDOR_DIRS = ["vendor", "node_modules", ".pnpm-store", ".venv", "venv", "bower_components", "third_party", "third-party", "external", "deps", "vendor_modules", "pods"]
GENERATED_STEMS = ["generated", "autogenerated", "auto-generated", "codegen", "generated_code"]
GENERATED_MARKS = ["@generated", "generated file", "this file is generated", "this file was generated", "automatically generated"]
MINIFIABLE = ["js", "mjs", "cjs", "jsx", "ts", "mts", "cts", "tsx"]
TEST_ENDS = ["_test.go", "_test.rs", ".test.js", ".test.ts", ".spec.js", ".spec.ts"]
MANIFESTS = ["cargo.toml", "package.json", "pyproject.toml", "setup.py", "setup.cfg", "gemfile", "gemspec", "pom.xml", "build.gradle", "build.gradle.kts", "settings.gradle", "settings.gradle.kts", "composer.json", "mix.exs", "pnpm-workspace.yaml", "pnpm-workspace.yml", "lerna.json", "nx.json", "go.mod", "go.work", "build.zig.zon"]
MANIFEST_FAMILIES = {
    "rust": ["cargo.toml"],
    "node": ["package.json", "pnpm-workspace.yaml", "pnpm-workspace.yml", "lerna.json", "nx.json"],
    "go": ["go.mod", "go.work"],
    "zig": ["build.zig.zon"],
    "python": ["pyproject.toml", "setup.py", "setup.cfg"],
    "ruby": ["gemfile", "gemspec"],
    "jvm": ["pom.xml", "build.gradle", "build.gradle.kts", "settings.gradle", "settings.gradle.kts"],
}
LOCKFILES = ["cargo.lock", "package-lock.json", "pnpm-lock.yaml", "yarn.lock", "bun.lockb", "poetry.lock", "uv.lock", "gemfile.lock", "go.sum", "composer.lock"]
BUILD_FILES = ["build.rs", "build.zig", "makefile", "gnumakefile", "pom.xml", "build.gradle", "build.gradle.kts"]
TASK_FILES = ["justfile", "taskfile.yml", "taskfile.yaml", "rakefile", "procfile"]
CI_FILES = [".gitlab-ci.yml", ".gitlab-ci.yaml", "azure-pipelines.yml", "azure-pipelines.yaml"]
CI_DIRS = ["workflows", ".circleci", ".buildkite"]
OWNERSHIP = ["codeowners", "owners", "maintainers"]
READMES = ["readme", "readme.md", "readme.rst", "readme.txt"]
COMMUNITY = ["code_of_conduct.md", "community.md"]
AGENT_FILES = ["AGENTS.md", "CLAUDE.md", "CODEX.md"]
TEST_DIRS = ["test", "tests", "spec", "__tests__"]
LANDMARK_PRIORITY = {"agent_instructions": 100, "readme": 95, "contributor_instructions": 90, "manifest": 85, "workspace_root": 85, "package_root": 85, "lockfile": 80, "build_entry_point": 75, "task_entry_point": 75, "test_root": 70, "ci": 65, "ownership": 60, "license": 50, "submodule": 45, "nested_repository": 45, "unknown": 0}
ENTRY_NAMES = ["main.rs", "main.py", "main.rb", "main.ts", "main.js", "index.ts", "index.js", "index.tsx", "index.jsx"]
GATEWAY_TERMS = ["api", "gateway", "handler", "router", "server"]
LANGUAGE_EXTENSIONS = {"rust": ["rs"], "javascript": ["js", "mjs", "cjs", "jsx"], "typescript": ["ts", "mts", "cts", "tsx"], "python": ["py", "pyi"], "ruby": ["rb"], "go": ["go"], "lua": ["lua", "rockspec"], "zig": ["zig"], "java": ["java"], "csharp": ["cs"]}


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/", -1), -1)


def parent(path: Column) -> Column:
    """The folder of a path; ``.`` at the top."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def ancestors(path: Column, with_self: bool = True) -> Column:
    """A path's folders from the top, ``.`` first, then the path itself."""
    parts = F.split(path, "/", -1)
    n = F.size(parts) - (0 if with_self else 1)
    below = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(F.lit(".")), below)


def suffixes(path: Column) -> Column:
    """All ends of a path that begin at a component."""
    parts = F.split(path, "/", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def in_scope(path: Column, scope: str) -> Column:
    return F.lit(True) if scope == "." else (path == scope) | path.startswith(scope + "/")


def normalise_path(c: Column) -> Column:
    """Trimmed, with ``/`` between components, no leading ``./`` and no outer ``/``."""
    slashed = F.replace(F.trim(c), F.lit("\\"), F.lit("/"))
    return F.regexp_replace(F.regexp_replace(slashed, r"^(\./)+", ""), "^/+|/+$", "")


def is_test_path(path: Column) -> Column:
    inside = path.startswith("test/") | path.startswith("tests/") | path.contains("/test/") | path.contains("/tests/")
    return inside | _any([path.endswith(e) for e in TEST_ENDS])


def path_classes(path: Column) -> Column:
    """``(kind, reason)`` for every directory and file-name rule that fits, sorted and distinct."""

    def one(kind: str, reason: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), reason.alias("reason"))

    parts = F.split(ascii_lower(path), "/", -1)
    dirs = F.concat(
        F.transform(F.array_intersect(parts, F.array(*map(F.lit, GENERATED_DIRS))), lambda x: one("generated", F.concat(F.lit("generated_directory:"), x))),
        F.transform(F.array_intersect(parts, F.array(*map(F.lit, VENDOR_DIRS))), lambda x: one("vendor", F.concat(F.lit("vendor_directory:"), x))),
    )
    name = ascii_lower(basename(path))
    stem = F.when(name.contains("."), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)
    made = stem.isin(GENERATED_STEMS) | _any([stem.endswith(e) for e in (".generated", ".gen", "_pb", ".designer")])
    named = F.array_compact(
        F.array(
            F.when(name.endswith(".map"), one("source_map", F.lit("source_map_filename"))),
            F.when(name.contains(".min.") | stem.endswith(".min"), one("minified", F.lit("minified_filename"))),
            F.when(made, one("generated", F.lit("generated_filename"))),
        )
    )
    return F.array_sort(F.array_distinct(F.concat(dirs, named)))


def generated_header(text: Column) -> Column:
    """Whether a comment in the first 16 lines says that the file is generated."""
    lines = F.slice(F.split(text, "\n", -1), 1, 16)
    comments = F.transform(lines, lambda x: F.regexp_extract(ascii_lower(x), r"^\s*(?://|#|/\*|\*|<!--|--)\s*(.*)$", 1))
    said = lambda c: _any([c.contains(m) for m in GENERATED_MARKS]) | (c.contains("code generated") & c.contains("do not edit"))
    return F.coalesce(F.exists(comments, said), F.lit(False))


def looks_minified(path: Column, text: Column, least: int = 1024, most: int = 65536, line_bytes: int = 512, space_percent: int = 2) -> Column:
    extension = F.regexp_extract(path, r"\.([^./]+)$", 1)
    size = F.octet_length(text)
    without = lambda c: F.replace(text, F.lit(c), F.lit(""))
    lines = size - F.octet_length(without("\n")) + F.when(F.endswith(text, F.lit("\n")), 0).otherwise(1)
    space = sum((size - F.octet_length(without(c)) for c in " \t\n\f\r"), F.lit(0))
    return extension.isin(MINIFIABLE) & size.between(least, most) & (F.floor(size / lines) >= line_bytes) & (lines <= 3) & (space * 100 <= size * space_percent)


def landmark_kinds(path: Column) -> Column:
    """The landmark kinds of a file, most important first."""
    name = basename(path)
    low = ascii_lower(name)
    parts = F.split(ascii_lower(path), "/", -1)
    rules = {
        "agent_instructions": name.isin(AGENT_FILES),
        "readme": low.isin(READMES),
        "contributor_instructions": low.startswith("contributing") | low.isin(COMMUNITY),
        "manifest": is_manifest(low),
        "lockfile": low.isin(LOCKFILES),
        "build_entry_point": low.isin(BUILD_FILES),
        "task_entry_point": low.isin(TASK_FILES),
        "ci": low.isin(CI_FILES) | F.arrays_overlap(parts, F.array(*map(F.lit, CI_DIRS))),
        "ownership": low.isin(OWNERSHIP),
        "license": low.startswith("license") | low.startswith("copying") | low.startswith("notice"),
    }
    return F.array_compact(F.array(*(F.when(test, F.lit(kind)) for kind, test in rules.items())))


def landmark_priority(kind: Column) -> Column:
    pairs = [x for k, v in LANDMARK_PRIORITY.items() for x in (F.lit(k), F.lit(v))]
    return F.element_at(F.create_map(*pairs), kind)


def is_manifest(low_name: Column) -> Column:
    return low_name.isin(MANIFESTS) | low_name.endswith(".gemspec") | low_name.endswith(".csproj") | low_name.endswith(".sln")


def manifest_family(low_name: Column) -> Column:
    out = F.when(low_name.endswith(".gemspec"), "ruby").when(low_name.endswith(".csproj") | low_name.endswith(".sln"), "dotnet")
    for family, names in MANIFEST_FAMILIES.items():
        out = out.when(low_name.isin(names), family)
    return out.otherwise("other")


def snippet_role(path: Column, entry_points: Column | None = None) -> Column:
    """``entry_point``, ``test``, ``gateway`` or ``source``; ``entry_points`` are paths that manifests declare."""
    name = basename(path)
    entry = path.startswith("examples/") | path.contains("/examples/") | name.isin(ENTRY_NAMES)
    if entry_points is not None:
        entry = entry | F.coalesce(F.array_contains(entry_points, path), F.lit(False))
    test = path.startswith("tests/") | path.contains("/tests/") | name.endswith("_test.go")
    gateway = _any([ascii_lower(name).contains(t) for t in GATEWAY_TERMS])
    return F.when(entry, "entry_point").when(test, "test").when(gateway, "gateway").otherwise("source")


def subsystem(path: Column, root: Column) -> Column:
    """The folder of a path below its project root."""
    inner = F.when((root != ".") & path.startswith(F.concat(root, F.lit("/"))), F.substr(path, F.length(root) + 2)).otherwise(path)
    return parent(inner)


def language_of(path: Column, first_line: Column | None = None) -> Column:
    """Language by extension, by name, or for extensionless files under bin/ or scripts/ by a Lua shebang."""
    extension = ascii_lower(F.regexp_extract(basename(path), r".\.([^.]+)$", 1))
    out = F.when(basename(path).isin(".busted", ".luacheckrc"), "lua")
    for language, known in LANGUAGE_EXTENSIONS.items():
        out = out.when(extension.isin(known), language)
    if first_line is not None:
        bare = ~F.substring(basename(path), 2, 1 << 30).contains(".") & path.rlike(r"(^|/)(bin|scripts)/")
        out = out.when(bare & first_line.rlike(r"^#!.*(^|[\s/!])lua(jit|[0-9]\S*)?(\s|$)"), "lua")
    return out


def safe_path(path: Column) -> Column:
    """Whether a path is relative, without empty, ``.`` or ``..`` components, drive, NUL or backslash."""
    parts = F.split(path, "/", -1)
    plain = F.forall(parts, lambda p: ~p.isin("", ".", ".."))
    return plain & ~path.contains("\\") & ~path.contains("\0") & ~path.rlike("^[A-Za-z]:")


def glob_to_regex(pattern: str) -> str:
    """A gitignore pattern as a regular expression over whole paths and their folders."""
    p, anchored = pattern.strip(), "/" in pattern.strip().rstrip("/")
    p = p.strip("/")
    out, i = "", 0
    while i < len(p):
        if p.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif p.startswith("**", i):
            out, i = out + ".*", i + 2
        elif p[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        elif p[i] == "[" and "]" in p[i + 1 :]:
            end = p.index("]", i + 1)
            out, i = out + "[" + p[i + 1 : end].replace("!", "^", 1) + "]", end + 1
        else:
            out, i = out + re.escape(p[i]), i + 1
    return f"^{'' if anchored else '(?:.*/)?'}{out}(?:/.*)?$"


def excluded(path: Column, patterns: list[str]) -> Column:
    """Whether a path, or a folder above it, matches the patterns; a later ``!`` pattern takes it back."""
    out = F.lit(False)
    for p in patterns:
        hit = path.rlike(glob_to_regex(p.removeprefix("!")))
        out = F.when(hit, F.lit(not p.startswith("!"))).otherwise(out)
    return out
