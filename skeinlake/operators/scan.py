"""Structure from whole source files: heads over several lines, methods, arrow functions, block comments, balanced brackets.

Lines alone can't tell a comment from code or where a parameter list ends, and that isn't expressible with built-in functions;
so each file is scanned once, in Arrow batches, by itself. Comments and strings are blanked first, so that nothing inside
them looks like code; then heads are found by a pattern for each language and their brackets are followed. The documented
subset: preprocessor branches are all read, macros aren't expanded, and types are kept as written.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lookups import LANGUAGES, case, extension
from .extract import BUILT_IN

SCHEMA = (
    "path string, language string, kind string, name string, parameters array<string>, return_type string, visibility string, is_async boolean, extends string, implements array<string>, "
    "text string, is_doc boolean, is_method boolean, line_start int, line_end int"
)
_STRING = r'"(?:\\.|[^"\\\n])*"?'
_C_COMMENT = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
#: What is blanked: comments (group c) and strings.
BLANK = {
    "rust": re.compile(rf"(?P<c>{_C_COMMENT})|r(#*)\".*?\"\2|\"(?:\\.|[^\"\\])*\"?|'(?:\\[^\n]+?|[^'\\\n])'", re.S),
    "python": re.compile(r"(?P<c>#[^\n]*)|(?P<q>\"\"\"|''').*?(?:(?P=q)|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?", re.S),
    "go": re.compile(rf"(?P<c>{_C_COMMENT})|{_STRING}|`[^`]*`?|'(?:\\.|[^'\\\n])*'?", re.S),
    "javascript": re.compile(rf"(?P<c>{_C_COMMENT})|{_STRING}|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?", re.S),
    "java": re.compile(rf"(?P<c>{_C_COMMENT})|\"\"\".*?(?:\"\"\"|\Z)|{_STRING}|'(?:\\.|[^'\\\n])*'?", re.S),
    "c": re.compile(rf"(?P<c>{_C_COMMENT})|R\"\(.*?\)\"|{_STRING}|'(?:\\.|[^'\\\n])*'?", re.S),
}
BLANK["typescript"], BLANK["cpp"] = BLANK["javascript"], BLANK["c"]

#: A word isn't given back letter by letter, as nothing that may follow one is a letter; and where a search has failed at its first letter, it isn't begun at the next (_BEGIN).
_WORD = r"[A-Za-z_$][\w$]*+"
_BEGIN = r"(?<![A-Za-z_$])"
_SCRIPT = rf"(?:(?<=[{{;}}])|^|(?=\b[edafclv]))(?:(?:\b(?:export|default|async)\s+)*\bfunction\b\s*\*?\s*(?P<f>{_WORD})|(?:\bexport\s+)?\b(?:const|let|var)\s+(?P<a>{_WORD})\s*(?::[^=;]*?)?=\s*(?:async\b\s*)?(?=\(|<|{_WORD}\s*=>)|(?:(?<=[{{;}}])|^)\s*(?P<mods>(?:(?:public|private|protected|static|readonly|override|abstract|async|get|set)\s+|\*\s*)*)(?P<m>\#?{_WORD})(?=\s*[(<]))"
_C_HEAD = rf"(?=[A-Za-z_$~])(?P<q>(?:{_BEGIN}{_WORD}(?:<[^<>;{{}}()]*>)?::)*)(?P<n>~?{_BEGIN}{_WORD}|operator\s*[^\s\w(]+)\s*(?=\()"
HEADS = {
    "rust": re.compile(r"(?=\b[pdcauef])(?:\bpub(?:\([^)]*\))?\s+)?(?:\b(?:default|const|async|unsafe|extern)\s+(?:\s{2,})?)*\bfn\s+(?P<f>\w+)"),
    "python": re.compile(r"^[ \t]*(?:async\s+)?def\s+(?P<f>\w+)\s*", re.M),
    "javascript": re.compile(_SCRIPT, re.M),
    "typescript": re.compile(_SCRIPT, re.M),
    "java": re.compile(rf"(?:(?<=[{{;}}])|^)\s*(?:@[\w.]+(?:\([^()]*\))?\s*)*(?P<mods>(?:(?:public|private|protected|static|final|abstract|synchronized|native|default|strictfp)\s+)*)(?:<[^;{{}}()]*?>\s+)?(?:(?P<t>{_WORD}(?:\.{_WORD})*(?:<[^;{{}}()]*>)?(?:\s*\[\s*\])*)\s+)?(?P<m>{_WORD})\s*(?=\()", re.M),
    "go": re.compile(r"^func\s+(?:\([^)]*\)\s*)?(?P<f>\w+)\s*", re.M),
    "c": re.compile(_C_HEAD),
    "cpp": re.compile(_C_HEAD),
}
CLASSES = {
    "rust": re.compile(r"(?=\b[pset])(?:\bpub(?:\([^)]*\))?\s+)?\b(?:struct|enum|trait)\s+(?P<n>\w+)"),
    "python": re.compile(r"^[ \t]*class\s+(?P<n>\w+)\s*", re.M),
    "javascript": re.compile(rf"(?=\b[edaci])(?:\b(?:export|default|abstract)\s+)*\b(?:class|interface)\s+(?P<n>{_WORD})"),
    "java": re.compile(rf"(?=\b[psfacier])(?:\b(?:public|private|protected|static|final|abstract|sealed)\s+)*\b(?:class|interface|enum|record)\s+(?P<n>{_WORD})"),
    "go": re.compile(r"\btype\s+(?P<n>\w+)\s+(?:\[[^\]]*\]\s*)?(?:struct|interface)\b"),
    "c": re.compile(r"\b(?:struct|union)\s+(?P<n>\w+)(?=\s*\{)"),
    "cpp": re.compile(r"(?<!enum )\b(?:class|struct)\s+(?P<n>\w+)(?=\s*(?:final\s*)?[:{])"),
}
CLASSES["typescript"] = CLASSES["javascript"]
KEYWORDS = set("if for while switch match return catch fn def function func sizeof elif else and or not in new throw await typeof with super do case assert yield lambda print del raise except static_assert alignof decltype defined using namespace class struct enum impl where let const var foreach synchronized try async pub Fn FnMut FnOnce".split()) - {"print", "super"}
#: A call's name begins with a set of letters, which the search skips to; what stands before it is read backwards.
CALL = re.compile(rf"(?P<t>[A-Za-z_$](?<![A-Za-z_$][A-Za-z_$])[\w$]*+(?:\s*(?:\.|::|->)\s*{_WORD})*)\s*(?=\()")
OPEN, CLOSE = "([{", ")]}"
#: Languages whose calls stand in functions only; what looks like one elsewhere declares something.
INSIDE_ONLY = {"c", "cpp", "go"}
PRIMITIVE = {"void", "int", "long", "short", "byte", "char", "boolean", "float", "double"}


class Source:
    """A file, blanked; matched() matches its brackets, which comments don't need."""

    def __init__(self, text: str, language: str):
        self.text, self.language = text, language
        self.comments: list[tuple[int, int]] = []
        self.strings: list[tuple[int, int]] = []
        code, plain, at = [], [], 0
        for m in BLANK[language].finditer(text):
            a, b = m.span()
            gap = re.sub(r"[^\n]", " ", m.group())
            code += [text[at:a], gap]
            is_comment = m.group("c") is not None
            (self.comments if is_comment else self.strings).append((a, b))
            # Parameters and types are shown with their strings, but without comments.
            plain += [text[at:a], gap if is_comment else m.group()]
            at = b
        self.code, self.plain = "".join([*code, text[at:]]), "".join([*plain, text[at:]])
        self.breaks = [m.start() for m in re.finditer("\n", text)]

    def matched(self) -> Source:
        """Matches the brackets."""
        self.pair: dict[int, int] = {}
        self.opens: list[int] = []
        # Where the innermost open brace changes, and to which one: -1 outside of all.
        self.turns, self.inner = [0], [-1]
        stack: list[int] = []
        braces: list[int] = []
        for m in re.finditer(r"[()\[\]{}]", self.code):
            k, c = m.start(), m.group()
            if c in OPEN:
                stack.append(k)
                self.opens.append(k)
                if c == "{":
                    braces.append(k)
            else:
                want = OPEN[CLOSE.index(c)]
                while stack and self.code[stack[-1]] != want:
                    stack.pop()
                if stack:
                    self.pair[stack.pop()] = k
                if c == "}" and braces:
                    braces.pop()
            if c in "{}":
                self.turns.append(k + 1)
                self.inner.append(braces[-1] if braces else -1)
        return self

    def line(self, k: int) -> int:
        return bisect_left(self.breaks, k) + 1

    @cached_property
    def continued(self) -> set[int]:
        """Lines that begin inside a string or a bracket."""
        spans = [(a, b - 1) for a, b in self.strings] + [(a, b) for a, b in self.pair.items() if self.code[a] != "{" or self.language == "python"]
        return {k for a, b in spans for k in range(self.line(a) + 1, self.line(b) + 1)}

    def brace_around(self, k: int) -> int:
        return self.inner[bisect_right(self.turns, k) - 1]

    def skip(self, k: int, stops: str) -> int:
        """The first of some characters from k on, outside of brackets that open from there on; the end without one."""
        n = len(self.code)
        while k < n:
            c = self.code[k]
            if c in stops:
                return k
            if c in OPEN:
                k = self.pair.get(k, n)
            elif c in CLOSE:
                return k
            k += 1
        return n

    def angle(self, k: int) -> int:
        """Past generics that open at k, if any."""
        if self.code[k : k + 1] != "<":
            return k
        depth = 0
        for j in range(k, min(len(self.code), k + 5000)):
            c = self.code[j]
            if c == "<":
                depth += 1
            elif c == ">" and self.code[j - 1] not in "-=":
                depth -= 1
                if not depth:
                    return j + 1
            elif c in ";{":
                break
        return k

    def before_call(self, k: int) -> tuple[bool, bool]:
        """Whether `new`, and whether a dot, an arrow or a path stands before a call's name."""
        code, j = self.code, k
        while j and code[j - 1].isspace():
            j -= 1
        mark = 1 if code[j - 1 : j] == "." else 2 if code[max(j - 2, 0) : j] in ("::", "->") else 0
        if mark:
            k = j = j - mark
            while j and code[j - 1].isspace():
                j -= 1
        new = j < k and code[max(j - 3, 0) : j] == "new" and not re.match(r"\w", code[max(j - 4, 0) : j - 3])
        return new, mark > 0

    def space(self, k: int) -> int:
        while k < len(self.code) and self.code[k].isspace():
            k += 1
        return k


_NESTING = re.compile(r"[\"'()\[\]{}<>]")


def split(text: str) -> list[str]:
    """A parameter list at commas outside of brackets and strings; empty ones are dropped."""
    if not _NESTING.search(text):
        return [p for p in (" ".join(x.split()) for x in text.split(",")) if p]
    out, depth, now, quote = [], 0, [], ""
    for j, c in enumerate(text):
        if quote:
            quote = "" if c == quote and text[j - 1] != "\\" else quote
        elif c in "\"'" and not (c == "'" and re.match(r"'[a-z_]\w*\b(?!')", text[j:])):
            quote = c
        elif c in "([{<":
            depth += 1
        elif c in ")]}" or c == ">" and text[j - 1 : j] not in ("-", "="):
            depth -= 1
        if c == "," and depth <= 0 and not quote:
            out.append("".join(now))
            now = []
        else:
            now.append(c)
    return [p for p in (re.sub(r"\s+", " ", x).strip() for x in [*out, "".join(now)]) if p]


def _indent_end(s: Source, start: int, colon: int) -> int:
    """The last line of a Python block whose head ends at the colon: the last one with code that is indented deeper, or that goes on with a string or bracket."""
    first, head = s.line(colon), s.line(s.space(start))
    rest_end = s.breaks[first - 1] if first - 1 < len(s.breaks) else len(s.text)
    if s.plain[colon + 1 : rest_end].strip():
        return first
    margin = s.space(start) - (s.breaks[head - 2] + 1 if head > 1 else 0)
    last, k, going = first, first, s.continued
    while k <= len(s.breaks):
        k += 1
        a = s.breaks[k - 2] + 1
        b = s.breaks[k - 1] if k - 1 < len(s.breaks) else len(s.text)
        row = s.plain[a:b]
        if k in going:
            last = k
            continue
        if not row.strip():
            continue
        if len(row) - len(row.lstrip()) <= margin:
            break
        last = k
    return last


def _bases(s: Source, k: int, end: int) -> tuple[str | None, list[str]]:
    """What stands between a class's name and its body."""
    text = s.code[k:end]
    if s.language == "python":
        names = [p for p in split(text.strip()[1:-1]) if "=" not in p] if text.strip().startswith("(") else []
        return (names[0] if names else None), names[1:]
    if s.language == "cpp":
        names = [re.sub(r"\b(public|private|protected|virtual)\b", "", p).strip() for p in split(text.partition(":")[2])]
        return (names[0] if names else None), names[1:]
    if s.language not in ("javascript", "typescript", "java"):
        return None, []
    base = re.search(r"\bextends\s+([\w$.]+)", text)
    impl = re.search(r"\bimplements\s+(.*)", text, re.S)
    return (base.group(1) if base else None), [re.sub(r"<.*", "", p, flags=re.S).strip() for p in split(impl.group(1))] if impl else []


KINDS = frozenset(("class", "function", "call", "comment"))


def scanned(path: str, language: str, text: str, kinds: frozenset[str] = KINDS) -> Iterator[tuple]:
    """Rows of SCHEMA of one file: classes, functions, calls, comments, each kind in the order of the text. What no kind that is wanted needs isn't looked for: functions need classes, calls both, comments none."""
    s = Source(text, language)
    if kinds != {"comment"}:
        yield from _code(s.matched(), path, kinds)
    if "comment" in kinds:
        none: list[str] = []
        docs = [(a, b) for a, b in s.strings if language == "python" and text[a : a + 3] in ('"""', "'''") and not s.code[text.rfind("\n", 0, a) + 1 : a].strip()]
        for a, b in sorted(s.comments + docs):
            body = text[a:b]
            yield path, language, "comment", None, none, None, None, None, None, none, body, body.startswith(BUILT_IN[language].doc), None, s.line(a), s.line(max(b - 1, a))


def _code(s: Source, path: str, kinds: frozenset[str]) -> Iterator[tuple]:
    """The rows of classes, functions and calls."""
    language = s.language
    none: list[str] = []
    named, bodies, covered = set(), set(), set()
    for m in CLASSES[language].finditer(s.code):
        k = s.angle(m.end())
        named.add(m.start("n"))
        if language == "python":
            colon = s.skip(k, ":")
            end_line, (base, rest) = _indent_end(s, m.start(), colon), _bases(s, k, colon)
        else:
            stop = s.skip(k, "{;")
            # A tuple struct's fields end before its semicolon.
            end = s.pair.get(stop, stop) if s.code[stop : stop + 1] == "{" else stop
            bodies.add(stop)
            end_line, (base, rest) = s.line(min(end, len(s.code))), _bases(s, k, stop)
        if "class" not in kinds:
            continue
        begin = s.space(m.start())
        yield path, language, "class", m.group("n"), none, None, None, None, base, rest, None, None, None, s.line(begin), end_line
    if not kinds & {"function", "call"}:
        return
    for m in HEADS[language].finditer(s.code):
        found = _function(s, m, bodies)
        if found:
            name, at, params, result, public, is_async, begin, end_line = found
            # A private or destructor's name has a sign before it.
            named.update((at, at + 1) if name[0] in "#~" else (at,))
            if language in INSIDE_ONLY:
                covered.update(range(s.line(begin), end_line + 1))
            if "function" in kinds:
                yield path, language, "function", name, split(params), result, "public" if public else "private", is_async, None, none, None, None, None, s.line(begin), end_line
    if "call" not in kinds:
        return
    for m in CALL.finditer(s.code):
        parts = re.split(r"\.|::|->", re.sub(r"\s+", "", m.group("t")))
        first, last = m.start("t"), parts[-1]
        line = s.line(m.end("t") - 1)
        if last in KEYWORDS or last in PRIMITIVE or first in named or m.end("t") - len(last) in named:
            continue
        new, dot = s.before_call(first)
        if new:
            continue
        if language == "rust" and s.code[first - 2 : first] == "#[":
            continue
        if language in INSIDE_ONLY and line not in covered:
            continue
        yield path, language, "call", last, none, None, None, None, None, none, None, None, len(parts) > 1 or dot, line, line


def _function(s: Source, m: re.Match, bodies: set[int]) -> tuple | None:
    """(name, its place, parameters, return type, public, async, begin, last line) of a head, or None if it isn't one."""
    language, code = s.language, s.code
    groups = m.groupdict()
    key = next((k for k in ("f", "a", "m", "n") if groups.get(k)), None)
    if key is None:
        return None
    name, at = m.group(key), m.start(key)
    k = s.space(s.angle(s.space(m.end())))
    if language in ("javascript", "typescript") and key == "a" and code[k : k + 1] != "(":
        one = re.compile(rf"({_WORD})\s*(?==>)").match(code, k)
        if not one:
            return None
        params, k = one.group(1), one.end()
    else:
        if language == "go" and code[k : k + 1] == "[":
            k = s.space(s.pair.get(k, len(code)) + 1)
        close = s.pair.get(k)
        if code[k : k + 1] != "(" or close is None:
            return None
        params, k = s.plain[k + 1 : close], close + 1
    begin = s.space(m.start())
    head = code[begin:at]
    if language == "python":
        colon = s.skip(k, ":")
        arrow = s.plain[k:colon].partition("->")[2].strip()
        return name, at, params, arrow or None, not name.startswith("_"), "async" in head, begin, _indent_end(s, begin, colon)
    if language in ("c", "cpp"):
        return _c_function(s, m, params, k, bodies)
    if language == "java":
        if s.brace_around(at) not in bodies or name in KEYWORDS or groups["t"] in KEYWORDS:
            return None
        stop = s.skip(k, "{;")
        if code[k:stop].strip() and not code[k:stop].strip().startswith("throws"):
            return None
        result = groups["t"] if groups["t"] and re.fullmatch(_WORD, groups["t"]) and groups["t"] not in PRIMITIVE else None
        begin = s.space(m.start("mods") if groups["mods"] else (m.start("t") if groups["t"] else at))
        return name, at, params, result, "public" in groups["mods"], False, begin, s.line(s.pair.get(stop, stop) if code[stop : stop + 1] == "{" else stop)
    if language in ("javascript", "typescript"):
        if key == "m" and (s.brace_around(at) not in bodies or name in KEYWORDS):
            return None
        stop = _result_end(s, k, "=>" if key == "a" else "{")
        if stop is None:
            return None
        kind = s.plain[k:stop].strip().removeprefix(":").strip() or None
        if key == "a":
            body = s.space(stop + 2)
            end = s.pair.get(body, len(code)) if code[body : body + 1] == "{" else s.skip(body, ";,\n") - 1
        else:
            end = s.pair.get(stop, stop) if code[stop : stop + 1] == "{" else stop
        public = "export" in head if key != "m" else not name.startswith("#") and not re.search(r"\b(private|protected)\b", groups["mods"])
        is_async = bool(re.search(r"\basync\b", code[begin : m.end()]))
        return name, at, params, kind, public, is_async, begin, s.line(max(end, stop))
    stop = s.skip(k, "{;") if language == "rust" else _go_body(s, k)
    end = s.pair.get(stop, stop) if code[stop : stop + 1] == "{" else stop
    result = s.plain[k:stop].strip()
    if language == "rust":
        result = re.split(r"\bwhere\b", result)[0].strip().removeprefix("->").strip()
        return name, at, params, result or None, head.startswith("pub"), bool(re.search(r"\basync\b", head)), begin, s.line(min(end, len(code)))
    return name, at, params, result or None, name[0].isupper(), False, begin, s.line(min(end, len(code)))


def _go_body(s: Source, k: int) -> int:
    """The brace of a Go function's body: the first after its result, whose own braces (interface{}, struct{}) are passed."""
    while True:
        stop = s.skip(k, "{\n")
        if s.code[stop : stop + 1] == "{" and re.search(r"\b(interface|struct)\s*$", s.code[k:stop]):
            k = s.pair.get(stop, len(s.code)) + 1
            continue
        return stop


def _result_end(s: Source, k: int, what: str) -> int | None:
    """Where a head of a script ends: its arrow, or its body's brace (or the semicolon of a signature); None if it is none."""
    j = s.space(k)
    if what == "=>":
        if s.code[j : j + 2] == "=>":
            return j
        if s.code[j : j + 1] != ":":
            return None
        while j < len(s.code):
            j = s.skip(j, "=;")
            if s.code[j : j + 2] == "=>":
                # An arrow after a parameter list belongs to a type.
                after = s.space(j + 2)
                nxt = s.skip(after, "=;{\n")
                if s.code[nxt : nxt + 2] == "=>":
                    j = nxt
                return j
            return None
        return None
    if s.code[j : j + 1] == "{":
        return j
    if s.code[j : j + 1] == ";":
        return j if s.language == "typescript" else None
    if s.code[j : j + 1] != ":":
        return None
    j = s.space(j + 1)
    if s.code[j : j + 1] == "{":
        j = s.pair.get(j, len(s.code)) + 1
    return s.skip(j, "{;")


def _c_function(s: Source, m: re.Match, params: str, k: int, bodies: set[int]) -> tuple | None:
    """A definition of C or C++: a type (or a qualified or class's own name) before, a body after."""
    code, name, at = s.code, m.group("n"), m.start("n")
    if name in KEYWORDS:
        return None
    around = s.brace_around(at)
    if around >= 0 and around not in bodies and not re.search(r"(?:\bnamespace(?:\s+[\w:]+)?|\bextern(?:\s{2,})?)\s*$", code[max(0, around - 200) : around]):
        return None
    after = re.compile(r"\s*(?:(?:const|noexcept|override|final|volatile|&&?|->\s*[\w:<>*& ]+)\s*)*").match(code, k)
    j = after.end()
    if code[j : j + 1] == ":" and code[j : j + 2] != "::":
        # Initialisers of a constructor, each with brackets of its own.
        while code[j : j + 1] in (":", ","):
            j = s.skip(j + 1, "({")
            j = s.space(s.pair.get(j, len(code)) + 1)
    if code[j : j + 1] != "{":
        return None
    last = max(code.rfind(c, 0, m.start()) for c in ";{}")
    label = max((x.end() for x in re.finditer(r"\b(?:public|private|protected)\s*:(?!:)|^[ \t]*#[^\n]*$", code[last + 1 : m.start()], re.M)), default=0)
    begin = s.space(last + 1 + label)
    kind = code[begin : m.start()].strip()
    own = m.group("q") or name.startswith("~") or around in bodies
    if not kind and not own or kind and (re.search(r"[=,()?]|\breturn\b|\belse\b", kind) and not kind.startswith(("template", "__attribute__"))):
        return None
    return name, at, params, None, "static" not in kind.split(), False, begin, s.line(s.pair.get(j, len(code) - 1))


def _run(batches: Iterator[pa.RecordBatch], kinds: frozenset[str] = KINDS) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    lists, flags, whole = {"parameters", "implements"}, {"is_async", "is_doc", "is_method"}, {"line_start", "line_end"}
    kind = lambda n: pa.list_(pa.string()) if n in lists else pa.bool_() if n in flags else pa.int32() if n in whole else pa.string()
    batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, kind(n)) for n, c in zip(names, zip(*rows))], names)
    for batch in batches:
        rows: list[tuple] = []
        for path, language, text in zip(*(c.to_pylist() for c in batch.columns)):
            rows += scanned(path, language, text, kinds)
            # A batch of many files' rows costs little more than one of a few.
            if len(rows) >= 4096:
                yield batch_of(rows)
                rows = []
        if rows:
            yield batch_of(rows)


def structure(files: DataFrame, *kinds: str) -> DataFrame:
    """Rows of SCHEMA of files (path, content): one scan of each gives its classes, functions, calls and comments, or only those of some kinds. Unknown languages and null contents give no row."""
    known = files.select("path", case(extension(F.col("path")), LANGUAGES).alias("language"), F.col("content").cast("string").alias("content")).where("language is not null and content is not null")
    wanted = frozenset(kinds) or KINDS
    return known.mapInArrow(lambda batches: _run(batches, wanted), SCHEMA)


def functions(rows: DataFrame) -> DataFrame:
    """(path, language, name, parameters, return_type, visibility, is_async, line_start, line_end): functions, methods and named arrow functions."""
    return rows.where("kind = 'function'").select("path", "language", "name", "parameters", "return_type", "visibility", "is_async", "line_start", "line_end")


def classes(rows: DataFrame) -> DataFrame:
    """(path, language, name, extends, implements, line_start, line_end)."""
    return rows.where("kind = 'class'").select("path", "language", "name", "extends", "implements", "line_start", "line_end")


def calls(rows: DataFrame) -> DataFrame:
    """(path, callee, line, is_method): is_method if the call goes through a dot, an arrow or a path."""
    return rows.where("kind = 'call'").select("path", F.col("name").alias("callee"), F.col("line_start").alias("line"), "is_method")


def comments(rows: DataFrame) -> DataFrame:
    """(path, text, line, is_doc): line, trailing and block comments, each as it is written."""
    return rows.where("kind = 'comment'").select("path", "text", F.col("line_start").alias("line"), "is_doc")
