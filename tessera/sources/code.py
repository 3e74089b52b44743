"""Symbols and imports of Python code by its own parser; of Rust, TypeScript and JavaScript by a lexer, marked as inexact."""

from __future__ import annotations

import ast
import bisect
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__package__.partition(".")[0]])

#: Symbol kinds by what declares them (fixed values).
RUST_KINDS = {"fn": "function", "struct": "struct", "enum": "enum", "trait": "trait", "const": "constant", "static": "static", "mod": "module"}
TS_KINDS = {"function": "function", "class": "class", "interface": "interface", "enum": "enum", "type": "type_alias", "const": "variable", "let": "variable", "var": "variable"}
FAMILY = {"rust": "rust", "ts": "ts", "tsx": "ts", "js": "js", "jsx": "js"}

_RUST_SKIP = re.compile(r"""//[^\n]*|/\*|b?r(#*)".*?"\1|b?"(?:\\.|[^"\\])*"|b?'(?:\\(?:u\{[^}]*\}|x..|.)|[^'\\\n])'""", re.S)
_TS_SKIP = re.compile(r"""//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`|(?:(?<=[=(,:\[!&|?;{}])|(?<==>)|(?<=return))(?P<re>\s*/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/)""", re.S)
_RUST_ITEM = re.compile(r"(?<![\w#$*])(fn|struct|enum|trait|const(?!\s+(?:fn|unsafe|async|extern)\b)|static|mod)\s+(?:(?:ref|mut)\s+)?((?:r#)?[A-Za-z_]\w*)")
_RUST_USE = re.compile(r"(?<![\w#])(?:use|extern\s+crate)\s+")
_TS_ITEM = re.compile(r"(?<![\w$.])(function|class|interface|enum|type|const(?!\s+enum\b)|let|var)(?:\s+([A-Za-z_$][\w$]*)|\s*([{\[]))")
_TS_METHOD = re.compile(r"(?<=[{},;\n])[ \t]*(?:(?:public|private|protected|static|async|override|readonly|get|set)[ \t]+)*\*?[ \t]*(#?[A-Za-z_$][\w$]*)[ \t]*(?:<[^>()\n]*>[ \t]*)?(?=\()")
_TS_BODY = re.compile(r"\s*(?::[^;={}()]*)?(?=\{)")
_TS_IMPORT = re.compile(r"(?<![\w$.])import(?=[\s{*'\"])")
_TS_FROM = re.compile(r"['\"]([^'\"\n]+)['\"]|;")
_ALIAS = re.compile(r"\s*(?:<[^=]*>)?\s*=")
_EACH = re.compile(r"\s+(?:of|in)\b")
_EXPRESSION = re.compile(r"(?:[=(,:?\[!&|+>]|\b(?:return|new|typeof|await|case))(?:\s*async)?$")
_NO_METHOD = frozenset(("if", "for", "while", "switch", "catch", "with", "return", "function"))
_OPEN, _CLOSE = "([{", ")]}"


def _blank(text: str) -> str:
    return "".join(c if c == "\n" else " " for c in text)


def _template_end(text: str, at: int) -> int:
    """Behind the template literal whose back quote is at `at`; what ${} holds may hold templates again."""
    depth: list[int] = []  # braces open in each ${} around
    k = at + 1
    while k < len(text):
        c = text[k]
        if c == "\\":
            k += 1
        elif depth and depth[-1] >= 0:
            if c == "`":
                depth.append(-1)
            elif c == "{":
                depth[-1] += 1
            elif c == "}":
                depth[-1] -= 1
                if depth[-1] < 0:
                    depth.pop()
        elif c == "`":
            if not depth:
                return k + 1
            depth.pop()
        elif c == "$" and text[k + 1 : k + 2] == "{":
            depth.append(0)
            k += 1
        k += 1
    return len(text)


def _masked(text: str, rust: bool) -> str:
    """text, of the same length, with comments and literals blanked."""
    out, at, skip = [], 0, _RUST_SKIP if rust else _TS_SKIP
    while m := skip.search(text, at):
        begin, end = m.span()
        if rust and m.group() == "/*":  # these nest
            depth = 1
            while depth and (n := re.compile(r"/\*|\*/").search(text, end)):
                depth, end = depth + (1 if n.group() == "/*" else -1), n.end()
            end = end if not depth else len(text)
        elif not rust and m.group() == "`":
            end = _template_end(text, begin)
        out += [text[at:begin], _blank(text[begin:end])]
        at = end
    return "".join([*out, text[at:]])


def _brackets(masked: str) -> tuple[dict[int, int], bool]:
    """Where each bracket closes, and whether all do."""
    ends, stack, fine = {}, [], True
    for m in re.finditer(r"[()\[\]{}]", masked):
        c = m.group()
        if c in _OPEN:
            stack.append((m.start(), c))
        elif stack and _OPEN.index(stack[-1][1]) == _CLOSE.index(c):
            ends[stack.pop()[0]] = m.start()
        else:
            fine = False
    return ends, fine and not stack


def lexed_facts(lang: str, text: str) -> tuple[list[tuple[str, str, int, int]], str | None]:
    """(kind, name, first and last line) of declarations at any depth and of imports, or a diagnostic where brackets don't close.

    Comments, strings, templates and regular expressions are blanked first, so nothing in them counts; declarations
    and imports may run over lines. Functions without a body, function and class expressions, generators and abstract
    classes are no symbols. This is a lexer, not a grammar: its rows are marked inexact.
    """
    rust, typed = FAMILY[lang] == "rust", FAMILY[lang] == "ts"
    masked = _masked(text, rust)
    ends, fine = _brackets(masked)
    marks = [m.start() for m in re.finditer(r"[()\[\]{};]", masked)]
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    out: list[tuple[str, str, int, int]] = []

    def item_end(at: int) -> int:
        """The last character of an item whose name ends at `at`: its body's brace or its semicolon, whichever is first."""
        k = bisect.bisect_left(marks, at)
        while k < len(marks):
            c, begin = masked[marks[k]], marks[k]
            if c in "{;":
                return ends.get(begin, begin)
            if c in _CLOSE:
                return begin - 1
            k = bisect.bisect_right(marks, ends.get(begin, begin))
        return len(masked) - 1

    def add(kind: str, name: str, begin: int, end: int) -> None:
        out.append((kind, " ".join(name.split()), bisect.bisect_right(starts, begin), bisect.bisect_right(starts, max(begin, end))))

    if rust:
        for m in _RUST_ITEM.finditer(masked):
            end = item_end(m.end())
            parameter = m.group(1) == "const" and masked[max(0, m.start() - 40) : m.start()].rstrip()[-1:] in ("<", ",")
            if not parameter and (m.group(1) != "fn" or masked[end : end + 1] == "}"):
                add(RUST_KINDS[m.group(1)], m.group(2), m.start(), end)
        done = -1
        for m in _RUST_USE.finditer(masked):
            if m.start() > done:
                done = masked.find(";", m.end())
                if done < 0:
                    break
                add("import", masked[m.end() : done], m.start(), done)
        return sorted(out, key=lambda r: (r[2], r[0], r[1])), None if fine else "syntax_error"
    for m in _TS_ITEM.finditer(masked):
        word, name, pattern = m.groups()
        before = masked[max(0, m.start() - 40) : m.start()].rstrip()
        if (word in ("interface", "type", "enum") and not typed) or (word == "type" and not _ALIAS.match(masked, m.end())):
            continue
        if pattern or word in ("const", "let", "var"):
            if pattern and (word not in ("const", "let", "var") or m.end() - 1 not in ends):
                continue
            after = ends[m.end() - 1] + 1 if pattern else m.end()
            if not _EACH.match(masked, after):
                add("variable", text[m.end() - 1 : after] if pattern else name, m.start(), item_end(after))
            continue
        end = item_end(m.end())
        body = masked[end : end + 1] == "}"
        if word in ("function", "class") and (not body or _EXPRESSION.search(before) or before.endswith("abstract")):
            continue
        add(TS_KINDS[word], name, m.start(), end)
    for m in _TS_METHOD.finditer(masked):
        body = _TS_BODY.match(masked, ends.get(m.end(), len(masked)) + 1)
        if body and m.group(1) not in _NO_METHOD:
            add("method", m.group(1), m.start(1), ends.get(body.end(), body.end()))
    for m in _TS_IMPORT.finditer(masked):
        found = _TS_FROM.search(text, m.end())
        if found and found.group(1):
            add("import", found.group(1), m.start(), found.end() - 1)
    return sorted(out, key=lambda r: (r[2], r[0], r[1])), None if fine else "syntax_error"


def python_facts(text: str) -> tuple[list[tuple[str, str, int, int]], str | None]:
    """(kind, qualified name, first and last line) of definitions and imports, or a diagnostic."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return [], "syntax_error"
    out: list[tuple[str, str, int, int]] = []

    def visit(node, outer: str) -> None:
        for n in ast.iter_child_nodes(node):
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                name = f"{outer}.{n.name}".lstrip(".")
                out.append(("class" if isinstance(n, ast.ClassDef) else "function", name, n.lineno, n.end_lineno or n.lineno))
                visit(n, name)
            elif isinstance(n, (ast.Import, ast.ImportFrom)):
                module = f"{'.' * n.level}{n.module or ''}" if isinstance(n, ast.ImportFrom) else None
                out.extend(("import", f"{module}.{a.name}" if module else a.name, n.lineno, n.end_lineno or n.lineno) for a in n.names)
            else:
                visit(n, outer)

    visit(tree, "")
    return out, None


def code_facts(files: DataFrame) -> DataFrame:
    """UDF-05, UDF-06: files (path, lang, text) as (path, kind, name, first_line, last_line, diagnostic, exact); other languages have no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, lang, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                exact = lang == "py"
                found, wrong = python_facts(text or "") if exact else lexed_facts(lang, text or "")
                rows += [(path, *f, None, exact) for f in found] + ([(path, None, None, None, None, wrong, exact)] if wrong else [])
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_())
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["path", "kind", "name", "first_line", "last_line", "diagnostic", "exact"])

    known = files.filter(F.col("lang").isin("py", *FAMILY))
    return known.select("path", "lang", "text").mapInArrow(run, "path string, kind string, name string, first_line int, last_line int, diagnostic string, exact boolean")
