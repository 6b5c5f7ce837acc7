"""Symbols of source texts by one table-driven lexer for languages without a parser here.

A text is cut into tokens by its language's pattern; strings and comments are
tokens of their own.  A walk over the tokens keeps a stack of open blocks (braces, or words that
``end`` closes), so each symbol knows the definitions around it, and each definition
where it ends.  What a language's words mean stands in ``LANGUAGES``.

Not a grammar: macros, generics over several lines and inference are read as
they are written.  Files are marked ``partial`` where blocks don't close.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

#: ``(name, kind, role, scope, line, column, end_line, end_column, visibility, evidence)``
Symbol = tuple[str, str, str, tuple[str, ...], int, int, int, int, str, str]

_SLASH, _HASH, _DASH = r"//[^\n]*|/\*.*?(?:\*/|\Z)", r"\#[^\n]*", r"--\[(?P<long>=*)\[.*?(?:\](?P=long)\]|\Z)|--[^\n]*"
_DOUBLE, _SINGLE, _BACK = r'"(?:\\.|[^"\\\n])*"?', r"'(?:\\.|[^'\\\n])*'?", r"`(?:\\.|[^`\\])*`?"


@dataclass(frozen=True)
class Language:
    """What the words of a language mean."""

    comment: str
    string: str
    #: Words before the name they define, and what kind it is.
    defines: dict[str, str]
    words: str = ""
    #: Words that begin an import, to the end of the statement.
    imports: tuple[str, ...] = ()
    #: Words that open a block which ``end`` closes; none where braces do.
    opens: tuple[str, ...] = ()
    #: Kinds whose blocks hold methods, and whether these come without a word before them.
    holders: tuple[str, ...] = ("class", "interface", "struct", "trait", "enum", "impl")
    bare_methods: bool = False
    #: Tokens before a name that make it a type.
    typed: tuple[str, ...] = ("new", "extends", "implements", "->")
    public: tuple[str, ...] = ("pub", "public", "export")
    name: str = r"[^\W\d]\w*"
    token: re.Pattern = field(init=False)
    keywords: frozenset[str] = field(init=False)

    def __post_init__(self):
        # What is met most often stands first; blanks are matches without a group.
        pattern = rf"[^\S\n]+|(?P<name>{self.name}|@\w+)|(?P<line>\n)|(?P<number>\d[\w.]*)|(?P<comment>{self.comment})|(?P<string>{self.string})|(?P<mark>::|->|=>|\.\.+|[^\w\s])"
        object.__setattr__(self, "token", re.compile(pattern, re.S))
        object.__setattr__(self, "keywords", frozenset([*self.words.split(), *self.defines, *self.imports, *self.opens, *self.public, *(w for w in self.typed if w.isalpha())]))


_C_WORDS = "if else for while do switch case break continue return try catch finally throw new this super static final abstract async await var let in of instanceof typeof void null true false default yield delete private protected internal readonly sealed override virtual partial get set out ref is as foreach lock using namespace package throws synchronized volatile transient native goto int long short byte char bool boolean float double string decimal object from with declare"

#: What stands for each language (fixed values).
LANGUAGES = {
    "rust": Language(_SLASH, rf'r(?P<raw>\#*)".*?(?:"(?P=raw)|\Z)|{_DOUBLE}|\'(?:\\.[^\']*|[^\'\\])\'', {"fn": "function", "struct": "struct", "enum": "enum", "trait": "trait", "type": "type", "const": "const", "static": "static", "mod": "module", "macro_rules": "macro", "impl": "impl"}, "let mut ref if else for while loop match return break continue self Self super crate where as in move unsafe async await dyn true false extern i8 i16 i32 i64 u8 u16 u32 u64 usize isize f32 f64 bool char str", ("use",), typed=(":", "->", "&", "<", "dyn"), name=r'(?!r\#*")[^\W\d]\w*'),
    "javascript": Language(_SLASH, rf"{_DOUBLE}|{_SINGLE}|{_BACK}", {"function": "function", "class": "class", "const": "const", "let": "variable", "var": "variable"}, _C_WORDS, ("import",), bare_methods=True),
    "typescript": Language(_SLASH, rf"{_DOUBLE}|{_SINGLE}|{_BACK}", {"function": "function", "class": "class", "interface": "interface", "enum": "enum", "type": "type", "const": "const", "let": "variable", "var": "variable"}, _C_WORDS + " any number unknown never keyof", ("import",), bare_methods=True, typed=("new", "extends", "implements", ":", "<", "as")),
    "go": Language(_SLASH, rf"{_DOUBLE}|{_SINGLE}|{_BACK}", {"func": "function", "type": "type", "package": "module", "const": "const", "var": "variable"}, "if else for range switch case default return break continue go defer select chan map struct interface nil true false fallthrough goto string int int64 bool error byte float64", ("import",), typed=("*", "&")),
    "java": Language(_SLASH, rf'""".*?(?:"""|\Z)|{_DOUBLE}|{_SINGLE}', {"class": "class", "interface": "interface", "enum": "enum", "record": "class"}, _C_WORDS, ("import",), bare_methods=True),
    "csharp": Language(_SLASH, rf'@"(?:""|[^"])*"?|{_DOUBLE}|{_SINGLE}', {"class": "class", "interface": "interface", "enum": "enum", "struct": "struct", "record": "class", "namespace": "module"}, _C_WORDS, ("using",), bare_methods=True),
    "ruby": Language(rf"^=begin.*?^=end|{_HASH}", rf"{_DOUBLE}|{_SINGLE}", {"def": "method", "class": "class", "module": "module"}, "then else elsif when in return yield self nil true false and or not super rescue ensure end next break redo retry alias undef attr_accessor attr_reader private protected public raise", ("require", "require_relative"), ("if", "unless", "while", "until", "case", "for", "begin", "do"), holders=("class", "module"), name=r"[^\W\d]\w*(?:[?!](?!=))?"),
    "lua": Language(_DASH, rf"\[(?P<raw>=*)\[.*?(?:\](?P=raw)\]|\Z)|{_DOUBLE}|{_SINGLE}", {"function": "function"}, "local then else elseif end for while in return break nil true false and or not goto until", (), ("if", "do", "repeat"), holders=()),
    "zig": Language(r"//[^\n]*", rf"\\\\[^\n]*|{_DOUBLE}|{_SINGLE}", {"fn": "function", "const": "const", "var": "variable", "test": "function"}, "if else for while switch return break continue defer errdefer try catch orelse and or comptime inline extern struct enum union error null undefined true false usize u8 u16 u32 u64 i32 i64 f64 bool void anytype type", (), holders=("struct", "enum"), typed=(":",)),
}
LANGUAGES |= {"javascript_jsx": LANGUAGES["javascript"], "typescript_tsx": LANGUAGES["typescript"]}

_OPEN, _CLOSE = {"{": "}", "(": ")", "[": "]"}, {"}", ")", "]"}


def tokens(text: str, language: Language) -> tuple[list[str], list[str], list[int]]:
    """The kinds, texts and offsets of a text's tokens, without comments."""
    found = [(m.lastgroup, m[0], m.start()) for m in language.token.finditer(text)]
    found = [t for t in found if t[0] and t[0] != "comment"]
    kinds, texts, starts = zip(*found, strict=True) if found else ((), (), ())
    return list(kinds), list(texts), list(starts)


def _unquoted(text: str) -> str:
    return text.strip("\"'`@").strip("[]=")


class _Walk:
    def __init__(self, name: str, language: Language, text: str):
        self.of, self.language = name, language
        self.kinds, self.texts, self.starts = tokens(text, language)
        self.size = len(self.texts)
        #: Offsets of lines; only tokens that a symbol names get a line and a column.
        self.lines = [0, *(m.end() for m in re.finditer("\n", text))]
        self.symbols: list[list] = []
        #: Open blocks: the closing mark, the names it gives to scopes, its kind, and its definition's row.
        self.blocks: list[tuple[str, tuple[str, ...], str, int | None]] = []
        self.pending: tuple[tuple[str, ...], str, int | None] | None = None
        self.outer: tuple[str, ...] = ()
        self.broken = False

    def scope(self) -> tuple[str, ...]:
        return (*self.outer, *(n for b in self.blocks for n in b[1]))

    def at(self, k: int) -> str:
        return self.texts[k] if 0 <= k < self.size else ""

    def place(self, k: int) -> tuple[int, int]:
        """Line and column of a token."""
        line = bisect_right(self.lines, self.starts[k])
        return line, self.starts[k] - self.lines[line - 1] + 1

    def add(self, k: int, kind: str, role: str, evidence: str, name: str | None = None, scope: tuple[str, ...] | None = None, shown: str = "unknown") -> int:
        text, (line, column) = self.texts[k], self.place(k)
        self.symbols.append([name or text, kind, role, self.scope() if scope is None else scope, line, column, line, column + len(text), shown, evidence])
        return len(self.symbols) - 1

    def shown(self, first: int, name: str, kind: str) -> str:
        """Visibility by the words that begin the declaration."""
        word = self.at(first)
        if self.of == "go" and kind != "module":
            return "public" if name[:1].isupper() else "internal"
        if self.of == "lua":
            return "internal" if word == "local" else "public" if not self.blocks else "unknown"
        if self.of == "zig":
            return "public" if word == "pub" else "internal"
        if word in ("pub", "public", "export"):
            return "public"
        return {"private": "private", "protected": "internal", "internal": "internal"}.get(word, "unknown")

    def statement(self, k: int) -> int:
        """The first token after ``k``'s statement: at a semicolon, or a line's end outside of brackets."""
        depth = 0
        while k < self.size:
            text = self.texts[k]
            depth += text in _OPEN
            depth -= text in _CLOSE
            if (text == ";" or self.kinds[k] == "line") and depth <= 0:
                break
            k += 1
        return k

    def imports(self, k: int, first: int) -> int:
        """Names that an import brings: the last ones of its paths, or what they are renamed to."""
        end = self.statement(k)
        own = [j for j in range(k + 1, end) if self.kinds[j] in ("name", "string")]
        names = [j for j in own if self.kinds[j] == "name" and self.at(j) not in ("from", "type", "static", "as", "mod")]
        if self.of in ("go", "ruby") or not names:
            for j in (j for j in own if self.kinds[j] == "string"):
                alias = self.kinds[j - 1]
                last = re.split(r"[/.]", _unquoted(self.at(j)).rstrip("/"))[-1] if self.of == "go" else _unquoted(self.at(j)).rsplit("/", 1)[-1]
                self.add(j - 1 if self.of == "go" and alias == "name" and self.at(j - 1) != "import" else j, "import", "definition", "import", None if self.of == "go" and alias == "name" and self.at(j - 1) != "import" else last)
            return end
        for j in names:
            if self.at(j) == "self":  # the module before the braces
                j = next((x for x in range(j, k, -1) if self.at(x) == "{"), j) - 2
                self.add(j, "import", "definition", "import", shown=self.shown(first, self.at(j), "import"))
                continue
            after = self.at(j + 1)
            if after not in ("::", ".", "as") or self.at(j + 2) == "*":
                self.add(j, "import", "definition", "import", shown=self.shown(first, self.at(j), "import"))
        return end

    def define(self, k: int, first: int) -> int:
        """The definition that the word at ``k`` begins; returns the next token to look at."""
        kind, j, scope, name = self.language.defines[self.at(k)], k + 1, None, None
        while self.at(j) in ("*", "mut", "!", "async") or (self.at(j) == "<" and kind == "impl"):
            j = next((x for x in range(j, self.size) if self.at(x) == ">"), j) + 1 if self.at(j) == "<" else j + 1
        if kind == "impl":  # a block for a type: the last name before its brace, without generics
            end = next((x for x in range(j, self.size) if self.at(x) in ("{", ";")), self.size)
            where = next((x + 1 for x in range(j, end) if self.at(x) == "for"), j)
            path = [x for x in range(where, end) if self.kinds[x] == "name"]
            while path and self.at(path[0] + 1) == "::":
                path.pop(0)
            for x in range(j, where):
                if self.kinds[x] == "name" and self.at(x) not in self.language.keywords:
                    self.add(x, "type", "reference", "type_reference")
            self.pending = ((self.at(path[0]),) if path else (), "impl", None)
            return end
        if self.of == "go" and kind == "function" and self.at(j) == "(":  # a receiver
            close = next((x for x in range(j, self.size) if self.at(x) == ")"), j)
            holder = [self.at(x) for x in range(j, close) if self.kinds[x] == "name"][-1:]
            kind, scope, j = "method", (*self.outer, *holder), close + 1
        if self.of == "lua" or self.of == "ruby":  # a dotted name: what is before the last point holds it
            parts = []
            while self.at(j + 1) in (".", ":") and self.kinds[j] == "name":
                parts.append(self.at(j))
                j += 2
            if parts and parts != ["self"]:
                scope = (*self.scope(), ".".join(parts))
        if j >= self.size or self.kinds[j] not in ("name", "string") or (self.kinds[j] == "string" and self.of != "zig"):
            if kind == "function":
                self.pending = ((), kind, None)  # without a name
                if self.language.opens:
                    self.blocks.append(("end", (), kind, None))
            return k + 1
        name = _unquoted(self.at(j)) if self.kinds[j] == "string" else self.at(j)
        value = [self.at(x) for x in range(j + 1, min(j + 6, self.size))]
        if self.of == "go" and kind == "type":
            kind = {"struct": "struct", "interface": "interface"}.get(self.at(j + 1), "type")
        elif self.of == "zig" and "=" in value:
            after = [x for x in value[value.index("=") + 1 :] if x not in ("packed", "extern")]
            kind = {"struct": "struct", "enum": "enum", "union": "struct", "@import": "import"}.get(after[0] if after else "", kind)
        elif kind in ("const", "variable") and value[:2] == ["=", "require"]:
            kind = "import"
        elif kind == "function" and self.blocks and self.blocks[-1][2] in self.language.holders:
            kind = "method"
        row = self.add(j, kind, "definition", "import" if kind == "import" else "declaration", name, scope, "unknown" if kind == "import" else self.shown(first, name, kind))
        if self.of == "go" and kind == "module":
            self.outer = (name,)
            self.symbols[row][3] = ()
        inner = (name,) if scope is None else (*scope[len(self.scope()) :], name)
        if self.language.opens:
            self.blocks.append(("end", inner, kind, row))
        elif kind not in ("import", "module") or self.of in ("rust", "csharp"):
            self.pending = (inner if kind not in ("const", "variable") else (), kind, row)
        return j + 1

    def reference(self, k: int) -> None:
        before, after = self.at(k - 1), self.at(k + 1)
        member = before in (".", "::", "?.") or (self.of == "lua" and before == ":")
        if after == "(" or (after == "!" and self.at(k + 2) == "(" and self.of == "rust") or (self.of == "lua" and k + 1 < self.size and self.kinds[k + 1] == "string"):
            point = member and before != "::"
            self.add(k, "identifier" if not point else "method" if self.of in ("go", "zig") else "field", "reference", "call")
        elif member:
            self.add(k, "field", "reference", "member_reference")
        elif before in self.language.typed or (self.language.bare_methods and k + 1 < self.size and self.kinds[k + 1] == "name" and after not in self.language.keywords):
            self.add(k, "type", "reference", "type_reference")
        else:
            self.add(k, "identifier", "reference", "bare_reference")

    def bare_method(self, k: int, given: bool) -> bool:
        """Whether a name in a class's block begins a method: a parenthesis after it, no value before it."""
        if not self.language.bare_methods or given or self.at(k + 1) != "(" or not self.blocks or self.blocks[-1][2] not in self.language.holders:
            return False
        return self.at(k - 1) not in (".", "new", "@")

    def close(self, mark: str, k: int) -> None:
        while self.blocks:
            closing, _, _, row = self.blocks.pop()
            if row is not None:
                line, column = self.place(k)
                self.symbols[row][6:8] = [line, column + len(self.texts[k])]
            if closing == mark:
                return
            self.broken = True
        self.broken = True

    def run(self) -> None:
        language, k, first, fresh, given = self.language, 0, 0, True, False
        kinds, texts, size = self.kinds, self.texts, self.size
        while k < size:
            kind, text = kinds[k], texts[k]
            if fresh:
                first, given = k, False
            fresh = kind == "line" or text in (";", "{", "}")
            if text == "=":
                given = True
            if kind == "line" or text == ";":
                if text == ";" and not (self.blocks and self.blocks[-1][0] in ")]"):
                    self.pending = None
            elif kind == "mark":
                if text in _OPEN and not (language.opens and text == "{"):
                    name, of, row = self.pending if text == "{" and self.pending else ((), "", None)
                    if text == "{":
                        self.pending = None
                    self.blocks.append((_OPEN[text], name, of, row))
                elif text in _CLOSE and not (language.opens and text == "}"):
                    self.close(text, k)
            elif kind == "name":
                word, member = text, self.at(k - 1) in (".", "::")
                if member and word not in language.keywords:
                    self.reference(k)
                elif word in language.imports and (k == first or self.at(k - 1) in ("pub", "global")) and (self.at(k + 1) not in ("(", ".") or self.of == "go"):
                    k = self.imports(k, first)
                    fresh = True
                    continue
                elif word in language.defines and not member and not (word in ("const", "var") and self.at(k - 1) in ("]", "*", "&", "?")):
                    k = self.define(k, first)
                    continue
                elif self.of == "lua" and word == "local" and k + 1 < self.size and self.kinds[k + 1] == "name" and self.at(k + 1) != "function":
                    self.add(k + 1, "import" if self.at(k + 3) == "require" else "variable", "definition", "import" if self.at(k + 3) == "require" else "declaration", shown="unknown" if self.at(k + 3) == "require" else "internal")
                    k += 2
                    continue
                elif language.opens and (word in language.opens) and not member:
                    loop = word == "do" and self.of == "ruby" and self.at(first) in ("while", "until", "for")
                    trailing = self.of == "ruby" and word in ("if", "unless", "while", "until") and k != first and self.at(k - 1) not in ("=", "then", "do")
                    if not loop and not trailing:
                        self.blocks.append(("until" if word == "repeat" else "end", (), "", None))
                elif language.opens and word in ("end", "until") and not member:
                    if word == "end" or (self.of == "lua" and self.blocks and self.blocks[-1][0] == "until"):
                        self.close(word, k)
                elif word in language.keywords or word.startswith("@"):
                    pass
                elif self.bare_method(k, given):
                    row = self.add(k, "method", "definition", "declaration", shown=self.shown(first, word, "method"))
                    self.pending = ((word,), "method", row)
                else:
                    self.reference(k)
            k += 1
        self.broken |= bool(self.blocks)


def lexed_symbols(text: str, language: str) -> tuple[list[Symbol], bool]:
    """The symbols of a text in order of place, and whether all blocks close."""
    spec = LANGUAGES.get(language)
    if spec is None:
        return [], False
    walk = _Walk(language.split("_")[0], spec, text)
    walk.run()
    return [(*s[:3], tuple(s[3]), *s[4:]) for s in walk.symbols], not walk.broken
