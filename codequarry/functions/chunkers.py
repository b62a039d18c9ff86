"""Splitting source files into chunks by language: one table function over files.

A signature pattern per language finds definitions; a stack of braces, or the
indentation, finds where they end. Files run through tasks in Arrow batches, and a
file that fails is kept with its error instead of failing the run.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_I = r"[A-Za-z_]\w*"
_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|virtual|override|async|readonly|partial|synchronized|default|export|declare|unsafe|extern)\s+)*"
#: By language: kind of chunk and the pattern of its first line; the group ``name`` is the symbol, ``receiver`` what it belongs to.
DEFINITIONS: dict[str, list[tuple[str, str]]] = {
    "go": [("method", rf"^func\s+\((?P<receiver>[^)]*)\)\s*(?P<name>{_I})\s*[\[(]"), ("function", rf"^func\s+(?P<name>{_I})\s*[\[(]"), ("struct", rf"^type\s+(?P<name>{_I})\s+struct\b"), ("interface", rf"^type\s+(?P<name>{_I})\s+interface\b"), ("type", rf"^type\s+(?P<name>{_I})\s+\S"), ("const", r"^const\s*\((?P<name>)"), ("var", r"^var\s*\((?P<name>)")],
    "typescript": [("function", rf"^(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>{_I})\s*[<(]"), ("class", rf"^(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<name>{_I})"), ("interface", rf"^(?:export\s+)?interface\s+(?P<name>{_I})"), ("type", rf"^(?:export\s+)?type\s+(?P<name>{_I})\s*(?:<[^=]*>)?\s*="), ("enum", rf"^(?:export\s+)?(?:const\s+)?enum\s+(?P<name>{_I})"), ("const", rf"^(?:export\s+)?const\s+(?P<name>{_I})\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|{_I})\s*(?::[^=]+)?=>|^(?:export\s+)?const\s+(?P<name2>{_I})\s*=\s*(?:async\s+)?function\b")],
    "python": [("function", rf"^(?P<indent>[ \t]*)(?:async\s+)?def\s+(?P<name>{_I})\s*[(\[]"), ("class", rf"^(?P<indent>[ \t]*)class\s+(?P<name>{_I})\s*[(:\[]")],
    "rust": [("function", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+|extern\s+\"[^\"]*\"\s+)*fn\s+(?P<name>{_I})"), ("struct", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+(?P<name>{_I})"), ("enum", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+(?P<name>{_I})"), ("interface", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+(?P<name>{_I})"), ("class", rf"^\s*(?:unsafe\s+)?impl\b(?:<[^>]*>)?\s+(?:[^{{]*?\bfor\s+)?(?P<name>{_I})"), ("type", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?type\s+(?P<name>{_I})"), ("const", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const|static)\s+(?P<name>{_I})\s*:")],
    "java": [("class", rf"^\s*{_MODS}(?:class|record)\s+(?P<name>{_I})"), ("interface", rf"^\s*{_MODS}@?interface\s+(?P<name>{_I})"), ("enum", rf"^\s*{_MODS}enum\s+(?P<name>{_I})")],
    "csharp": [("class", rf"^\s*{_MODS}(?:class|record(?:\s+(?:class|struct))?)\s+(?P<name>{_I})"), ("interface", rf"^\s*{_MODS}interface\s+(?P<name>{_I})"), ("struct", rf"^\s*{_MODS}struct\s+(?P<name>{_I})"), ("enum", rf"^\s*{_MODS}enum\s+(?P<name>{_I})")],
    "cpp": [("module", rf"^\s*(?:inline\s+)?namespace\s+(?P<name>{_I}(?:::{_I})*)\s*\{{"), ("class", rf"^\s*(?:template\s*<[^>]*>\s*)?class\s+(?P<name>{_I})[^;]*$"), ("struct", rf"^\s*(?:template\s*<[^>]*>\s*)?(?:typedef\s+)?struct\s+(?P<name>{_I})\s*[^;(]*$"), ("enum", rf"^\s*enum\s+(?:class\s+|struct\s+)?(?P<name>{_I})"), ("function", rf"^\s*(?!(?:return|else|if|for|while|switch|case|throw|new|delete|using|typedef)\b)(?:template\s*<[^>]*>\s*)?(?:[\w:<>,*&~]+\s+)+[*&]*(?:(?P<receiver>{_I}(?:::{_I})*)::)?(?P<name>~?{_I})\s*\([^;]*$")],
}
for _same in ("tsx", "javascript", "jsx"):
    DEFINITIONS[_same] = DEFINITIONS["typescript"]
_IMPORTS = {
    "go": r"^\s*(?:import\s+)?(?:[\w.]+\s+)?\"([^\"]+)\"\s*$",
    "typescript": r"^\s*import\s+(?:[^'\"]*?\sfrom\s+)?['\"]([^'\"]+)['\"]",
    "python": r"^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))",
    "rust": r"^\s*(?:pub\s+)?use\s+([^;]+);",
    "java": r"^\s*import\s+(?:static\s+)?([\w.*]+)\s*;",
    "csharp": r"^\s*using\s+(?:static\s+)?([\w.]+)\s*;",
    "cpp": r"^\s*#\s*include\s*[<\"]([^>\"]+)[>\"]",
}
_PACKAGES = {"go": rf"^package\s+({_I})", "java": r"^\s*package\s+([\w.]+)\s*;", "csharp": r"^\s*namespace\s+([\w.]+)"}
_TEXT = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|//[^\n]*|/\*.*?\*/|([{}])|(;)", re.S)
#: Definitions that hold others, which are chunks of their own.
_HOLDERS = {"python": {"class"}, "rust": {"class"}, "cpp": {"module"}}


def _braces_end(text: str, start: int) -> int:
    """The end of a definition that begins at ``start``: where its braces are closed, or its first semicolon outside of braces."""
    depth = 0
    for m in _TEXT.finditer(text, start):
        if m[1] == "{":
            depth += 1
        elif m[1] == "}":
            depth -= 1
            if depth <= 0:
                return m.end()
        elif m[2] and not depth:
            return m.end()
    return len(text)


def _indent_end(lines: list[str], at: int) -> int:
    """The last line of an indented block that begins on line ``at``."""
    margin = len(lines[at]) - len(lines[at].lstrip())
    depth, last = 0, at
    for i in range(at, len(lines)):
        bare = lines[i].strip()
        if i > at and bare and depth <= 0 and len(lines[i]) - len(lines[i].lstrip()) <= margin and not bare.startswith((")", "]", "}")):
            break
        if bare:
            last = i
        if i == at or depth > 0:
            depth += sum(map(lines[i].count, "([{")) - sum(map(lines[i].count, ")]}"))
    return last


def parse(source: str, language: str) -> list[dict]:
    """The chunks of a source text: kind, symbol, receiver, signature, lines (from 1), content and documentation."""
    family = "typescript" if language in ("tsx", "javascript", "jsx") else language
    rules = [(k, re.compile(p)) for k, p in DEFINITIONS[family]]
    lines = source.split("\n")
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)
    out: list[dict] = []
    open_class: list[tuple[str, int]] = []
    i = 0
    while i < len(lines):
        open_class = [c for c in open_class if c[1] >= i]
        hit = next(((k, m) for k, rx in rules if (m := rx.match(lines[i]))), None)
        if not hit:
            i += 1
            continue
        kind, m = hit
        groups = m.groupdict()
        name = groups.get("name") or groups.get("name2") or None
        receiver = groups.get("receiver")
        last = _indent_end(lines, i) if family == "python" else source.count("\n", 0, max(_braces_end(source, starts[i]) - 1, 0))
        last = max(i, min(last, len(lines) - 1))
        if kind == "function" and open_class and family in ("python", "rust"):
            kind, receiver = "method", open_class[-1][0]
        content = "\n".join(lines[i : last + 1])
        if not (kind in ("const", "var") and family in ("go", "rust") and last - i + 1 <= (3 if family == "go" else 2)):
            signature = lines[i].strip().rstrip("{:").strip()
            out.append({"chunk_type": kind, "symbol_name": name, "receiver_type": receiver, "signature": signature, "start_line": i + 1, "end_line": last + 1, "content": content, "doc_comment": _doc(lines, i, last, family)})
        if kind in _HOLDERS.get(family, ()):
            open_class.append((name, last))
            i += 1
        else:
            i = last + 1
    return out


def _doc(lines: list[str], at: int, last: int, family: str) -> str | None:
    """The documentation of a definition: a Python docstring, else the comment that ends on the line above."""
    if family == "python":
        m = re.compile(r"\s*[rRuU]?(\"\"\"|''')(.*?)\1", re.S).match("\n".join(lines[at + 1 : last + 1]))
        if m:
            return m[2].strip() or None
    i = at - 1
    while i >= 0 and re.match(r"\s*(?:@\w|#\[)", lines[i]):
        i -= 1
    end, mark = i, "#" if family == "python" else "//"
    if i >= 0 and lines[i].strip().endswith("*/"):
        while i > 0 and "/*" not in lines[i]:
            i -= 1
        body = "\n".join(lines[i : end + 1])
        return re.sub(r"(?m)^\s*/?\*+/?[ \t]?|\s*\*/\s*$", "", body).strip() or None
    while i >= 0 and lines[i].strip().startswith(mark):
        i -= 1
    return "\n".join(x.strip().lstrip("/#! ").rstrip() for x in lines[i + 1 : end + 1]).strip() or None


def imports(source: str, language: str) -> list[str]:
    """What a source text imports, each once."""
    family = "typescript" if language in ("tsx", "javascript", "jsx") else language
    rx = _IMPORTS.get(family)
    found = [next(g for g in m.groups() if g) for m in re.finditer(rx, source, re.M)] if rx else []
    return list(dict.fromkeys(found))


def package(source: str, language: str) -> str | None:
    rx = _PACKAGES.get(language)
    m = re.search(rx, source, re.M) if rx else None
    return m[1] if m else None


_SCHEMA = (
    "file_path string, language string, chunk_type string, symbol_name string, receiver_type string, signature string, package_name string,"
    " start_line int, end_line int, content string, doc_comment string, imports array<string>, error string"
)
_FIELDS = [f.strip().split(" ")[0] for f in _SCHEMA.split(",")]


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.list_(pa.string()) if f == "imports" else pa.int32() if f.endswith("_line") else pa.string() for f in _FIELDS]
    for b in batches:
        rows: list[dict] = []
        for path, language, source in zip(*(c.to_pylist() for c in b.columns), strict=True):
            base = {"file_path": path, "language": language}
            try:
                shared = {"package_name": package(source, language), "imports": imports(source, language)}
                found = []
                blocks = [(source, 0)]
                if language == "svelte":
                    blocks = [(m[1], source.count("\n", 0, m.start(1))) for m in re.finditer(r"(?is)<script\b[^>]*>(.*?)</script\s*>", source)]
                    template = re.sub(r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", "", source).strip()
                    if template:
                        found.append({"chunk_type": "component", "start_line": 1, "end_line": source.count("\n") + 1, "content": template})
                for text, offset in blocks:
                    for c in parse(text, "typescript" if language == "svelte" else language):
                        found.append(c | {"start_line": c["start_line"] + offset, "end_line": c["end_line"] + offset})
                rows += [base | shared | c for c in found]
            except Exception as e:  # one bad file must not end the run
                rows.append(base | {"error": f"{type(e).__name__}: {e}"[:300]})
        yield pa.RecordBatch.from_arrays([pa.array([r.get(f) for r in rows], t) for f, t in zip(_FIELDS, types, strict=True)], _FIELDS)


def chunked(files: DataFrame) -> DataFrame:
    """The chunks of ``file_path, language, content``, for the twelve languages but SQL, which ``sqltext.sql_chunks`` splits on the JVM. Files of other languages and null contents give none; a file that fails gives one row with its ``error``."""
    known = files.filter(F.col("language").isin([*DEFINITIONS, "svelte"]) & F.col("content").isNotNull())
    return known.select("file_path", "language", "content").mapInArrow(_run, _SCHEMA)
