"""SQL source: statements, their kinds and names, dialects and features. Files are scanned one by one in Arrow batches; dialects and features of single texts are Spark expressions too."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weighted marks of dialects, and features by dialect.
DIALECT_MARKS = {
    "postgres": [(r"\$[A-Za-z_]*\$", 2), (r"(?i)\bLANGUAGE\s+plpgsql\b", 3), (r"(?i)\bCREATE\s+EXTENSION\b", 2), (r"(?i)\bJSONB\b", 2), (r"(?i)\bRETURNING\b", 1), (r"(?i)\bSERIAL\b|\bBIGSERIAL\b", 1), (r"(?i)\bUSING\s+(?:gin|gist|brin)\b", 2), (r"(?i)\bILIKE\b", 1)],
    "mysql": [(r"(?i)\bENGINE\s*=\s*[A-Za-z]+", 3), (r"(?i)\bAUTO_INCREMENT\b", 3), (r"(?i)\bUNSIGNED\b", 1), (r"(?i)\bCHARACTER\s+SET\b", 1), (r"(?i)\bCOLLATE\s*=", 2), (r"(?i)\bON\s+UPDATE\s+CURRENT_TIMESTAMP\b", 3), (r"(?i)\bDELIMITER\s+\S+", 3)],
    "sqlite": [(r"(?i)\bAUTOINCREMENT\b", 3), (r"(?i)\bWITHOUT\s+ROWID\b", 3), (r"(?i)\)\s*STRICT\b", 3), (r"(?im)^\s*PRAGMA\s+", 2)],
    "mssql": [(r"(?i)\bIDENTITY\s*\(\s*\d+\s*,\s*\d+\s*\)", 3), (r"(?i)\bNVARCHAR\b", 2), (r"(?m)^\s*GO\s*$", 3), (r"@@[A-Za-z_]+", 2), (r"(?i)\bUSE\s+\[", 2)],
}
COMMON_FEATURES = [(r"(?i)\bCHECK\s*\(", "check"), (r"(?i)\bFOREIGN\s+KEY\b|\bREFERENCES\b", "foreign-key"), (r"(?i)\bUNIQUE\b", "unique"), (r"(?i)\bCREATE\s+TRIGGER\b", "trigger"), (r"(?i)\bCREATE\s+(?:OR\s+REPLACE\s+)?VIEW\b", "view"), (r"(?i)\bCREATE\s+MATERIALIZED\s+VIEW\b", "materialized-view")]
DIALECT_FEATURES = {
    "postgres": [(r"\$[A-Za-z_]*\$", "dollar-quoted"), (r"(?i)\bLANGUAGE\s+plpgsql\b", "plpgsql"), (r"(?i)\bJSONB\b", "jsonb"), (r"(?i)\bUUID\b", "uuid"), (r"(?i)\b(?:BIG)?SERIAL\b", "serial"), (r"(?i)\bPARTITION\s+BY\b", "partition"), (r"(?i)\bCREATE\s+EXTENSION\b", "extension"), (r"(?i)\bUSING\s+gin\b", "gin-index"), (r"(?i)\bGENERATED\s+(?:ALWAYS|BY\s+DEFAULT)\s+AS\b", "generated-column"), (r"(?i)\bRETURNING\b", "returning")],
    "mysql": [(r"(?i)\bENGINE\s*=\s*InnoDB\b", "engine-innodb"), (r"(?i)\bENGINE\s*=\s*MyISAM\b", "engine-myisam"), (r"(?i)\bAUTO_INCREMENT\b", "auto-increment"), (r"(?i)\bUNSIGNED\b", "unsigned"), (r"(?i)\bCHARACTER\s+SET\s+utf8mb4\b", "charset-utf8mb4"), (r"(?i)\bCOLLATE\s*=?\s*[A-Za-z0-9_]+", "collation"), (r"(?i)\bON\s+UPDATE\s+CURRENT_TIMESTAMP\b", "on-update-timestamp"), (r"(?i)\bFULLTEXT\s+(?:INDEX|KEY)\b", "fulltext-index")],
    "sqlite": [(r"(?i)\bAUTOINCREMENT\b", "autoincrement"), (r"(?i)\bWITHOUT\s+ROWID\b", "without-rowid"), (r"(?i)\)\s*STRICT\b", "strict"), (r"(?im)^\s*PRAGMA\s+", "pragma")],
    "mssql": [(r"(?i)\bIDENTITY\s*\(", "identity"), (r"\[[A-Za-z_][^\]\n]*\]", "bracket-ident"), (r"(?i)\bNVARCHAR\b", "nvarchar"), (r"(?m)^\s*GO\s*$", "go-batch"), (r"(?i)\bCREATE\s+TABLE\s+#[A-Za-z_]", "temp-hash"), (r"(?i)\bCLUSTERED\s+INDEX\b", "cluster-index")],
}
MOST_FEATURES = 8

_NAME = r"([A-Za-z_#`\"\[][\w$#`\"\[\].]*)"
_IF_NOT, _REPLACE, _TEMP = r"(?:IF\s+NOT\s+EXISTS\s+)?", r"(?:OR\s+REPLACE\s+)?", r"(?:TEMP(?:ORARY)?\s+)?"
_OBJECT = r"(?:MATERIALIZED\s+)?(?:TABLE|COLUMN|VIEW|INDEX|FUNCTION|PROCEDURE|TYPE|SCHEMA|SEQUENCE|TRIGGER)\s+"
#: In order: kind of chunk, what the receiver is (``on``: the second name), whether tables it uses are imports, and the start of the statement; group 1 is the name.
KINDS = [
    (kind, receiver, uses, re.compile(rf"\s*{start}", re.I))
    for kind, receiver, uses, start in (
        ("struct", "", True, rf"CREATE\s+{_REPLACE}(?:GLOBAL\s+|LOCAL\s+)?(?:TEMP(?:ORARY)?\s+|UNLOGGED\s+|VIRTUAL\s+|EXTERNAL\s+)?TABLE\s+{_IF_NOT}{_NAME}"),
        ("type", "", True, rf"CREATE\s+{_REPLACE}MATERIALIZED\s+VIEW\s+{_IF_NOT}{_NAME}"),
        ("type", "", True, rf"CREATE\s+{_REPLACE}{_TEMP}(?:RECURSIVE\s+)?VIEW\s+{_IF_NOT}{_NAME}"),
        ("function", "", True, rf"CREATE\s+{_REPLACE}FUNCTION\s+{_NAME}"),
        ("function", "", True, rf"CREATE\s+{_REPLACE}PROCEDURE\s+{_NAME}"),
        ("const", "on", False, rf"CREATE\s+(?:UNIQUE\s+)?(?:CLUSTERED\s+|NONCLUSTERED\s+|FULLTEXT\s+)?INDEX\s+(?:CONCURRENTLY\s+)?{_IF_NOT}{_NAME}\s+ON\s+(?:ONLY\s+)?{_NAME}"),
        ("method", "on", False, rf"CREATE\s+{_REPLACE}(?:CONSTRAINT\s+)?{_TEMP}TRIGGER\s+{_IF_NOT}{_NAME}[\s\S]*?\bON\s+{_NAME}"),
        ("type", "", False, rf"CREATE\s+{_REPLACE}TYPE\s+{_NAME}"),
        ("module", "", False, rf"CREATE\s+SCHEMA\s+{_IF_NOT}{_NAME}"),
        ("const", "", False, rf"CREATE\s+{_TEMP}SEQUENCE\s+{_IF_NOT}{_NAME}"),
        ("method", "alter", True, rf"ALTER\s+TABLE\s+(?:IF\s+EXISTS\s+)?(?:ONLY\s+)?{_NAME}"),
        ("const", "drop", False, rf"DROP\s+{_OBJECT}(?:IF\s+EXISTS\s+)?{_NAME}"),
        ("const", "comment", False, rf"COMMENT\s+ON\s+{_OBJECT}{_NAME}"),
        ("const", "grant", False, rf"(?:GRANT|REVOKE)\s+[\s\S]*?\bON\s+(?:TABLE\s+|SCHEMA\s+|FUNCTION\s+)?{_NAME}"),
    )
]
_USES = [re.compile(rf"\b{word}\s+{_NAME}", re.I) for word in ("REFERENCES", "(?:JOIN|FROM)")]
_COMMENT_MARK = re.compile(r"/\*|\*/")


@lru_cache(maxsize=256)
def _marks(delimiter: str) -> re.Pattern[str]:
    """What a scanner stops at: lines that are directives, quoted parts and comments, and the delimiter of statements."""
    return re.compile(
        rf"(?P<directive>^[ \t]*(?:GO|DELIMITER[ \t]+(?P<new>\S+))[ \t]*\r?(?:\n|\Z))|(?P<end>{re.escape(delimiter)})|(?P<block>/\*)|(?P<dollar>\$(?:[A-Za-z_]\w*)?\$)"
        r"|--[^\n]*|'(?:[^']|'')*(?:'|\Z)|\"[^\"]*(?:\"|\Z)|`[^`]*(?:`|\Z)|\[[^\]\n]*\]",
        re.M | re.I,
    )


def _after_comment(source: str, at: int) -> int:
    """The end of the block comment that begins at ``at``; comments may lie in each other."""
    depth = 0
    for m in _COMMENT_MARK.finditer(source, at):
        depth += 1 if m[0] == "/*" else -1
        if not depth:
            return m.end()
    return len(source)


def scanned(source: str) -> Iterator[tuple[int, int]]:
    """The spans of the statements of SQL source, without white space around them.

    Statements end at the delimiter, a semicolon unless a ``DELIMITER`` line says
    otherwise, and at ``GO`` lines. Delimiters in strings, quoted names, comments and
    dollar quotes end nothing. What is left at the end of the source is a statement.
    """

    def bare(s: int, e: int) -> Iterator[tuple[int, int]]:
        text = source[s:e]
        if text.strip():
            yield s + len(text) - len(text.lstrip()), s + len(text.rstrip())

    start = at = 0
    marks = _marks(";")
    while m := marks.search(source, at):
        at = m.end()
        if m["directive"] is not None:
            yield from bare(start, m.start())
            start = at
            marks = _marks(m["new"]) if m["new"] else marks
        elif m["end"] is not None:
            yield from bare(start, m.start())
            start = at
        elif m["block"] is not None:
            at = _after_comment(source, m.start())
        elif m["dollar"] is not None:
            close = source.find(m["dollar"], at)
            at = len(source) if close < 0 else close + len(m["dollar"])
    yield from bare(start, len(source))


def _after_comments(text: str) -> int:
    """Where a statement begins after the comments before it."""
    at = 0
    while m := re.compile(r"\s+|--[^\n]*(?:\n|\Z)|(?P<block>/\*)").match(text, at):
        at = _after_comment(text, at) if m["block"] else m.end()
    return at


def _named(quoted: str) -> tuple[str | None, str]:
    """Schema and name of a qualified name, without quotes; the first dot divides them."""
    schema, dot, name = re.sub(r"[`\"\[\]]", "", quoted).partition(".")
    return (schema.strip() or None, name.strip()) if dot else (None, schema.strip())


def classify(text: str) -> dict | None:
    """``chunk_type, receiver, symbol_name, package_name, imports`` of a statement that defines or changes something; none of others."""
    at = _after_comments(text)
    for kind, receiver, uses, pattern in KINDS:
        m = pattern.match(text, at)
        if not m:
            continue
        schema, name = _named(m[1])
        on = _named(m[2])[1] if receiver == "on" else receiver or None
        found = [_named(x)[1] for p in _USES for x in p.findall(text)] if uses else [on] if receiver == "on" else []
        imports = list(dict.fromkeys(x for x in found if x and (not uses or x != name)))
        return {"chunk_type": kind, "receiver": on, "symbol_name": name, "package_name": None if kind == "module" else schema, "imports": imports}
    return None


@lru_cache(maxsize=None)
def _compiled(pattern: str) -> re.Pattern[str]:
    return re.compile(pattern)


def shown_dialect(text: str) -> str | None:
    """The dialect with the highest score of marks; none at no marks or a tie."""
    scores = {d: sum(w * sum(1 for _ in _compiled(p).finditer(text)) for p, w in marks) for d, marks in DIALECT_MARKS.items()}
    best = max(scores.values())
    winners = [d for d, n in scores.items() if n == best]
    return winners[0] if best and len(winners) == 1 else None


def shown_features(dialect: str, text: str) -> list[str]:
    """``sql-feature:`` tags: common ones, then those of the dialect; at most eight."""
    return [f"sql-feature:{t}" for p, t in COMMON_FEATURES + DIALECT_FEATURES.get(dialect, []) if _compiled(p).search(text)][:MOST_FEATURES]


def remark_before(text: str) -> str | None:
    """The ``--`` lines that a statement begins with, without the mark; none if there are none."""
    m = re.match(r"\s*((?:[ \t]*--[^\n]*(?:\n|\Z))+)", text)
    return "\n".join(re.sub(r"^\s*--", "", line).strip() for line in m[1].rstrip("\n").split("\n")) if m else None


def dialect_scores(text: Column) -> dict[str, Column]:
    return {d: sum((F.size(F.regexp_extract_all(text, F.lit(p), 0)) * w for p, w in marks), F.lit(0)) for d, marks in DIALECT_MARKS.items()}


def dialect_of_content(text: Column) -> Column:
    """The dialect with the highest score of marks; null at no marks or a tie."""
    scores = dialect_scores(text)
    best = F.greatest(*scores.values())
    winners = F.array_compact(F.array(*(F.when((s == best) & (best > 0), F.lit(d)) for d, s in scores.items())))
    return F.when(F.size(winners) == 1, F.try_element_at(winners, F.lit(1)))


def dialect_of_path(path: Column) -> Column:
    low = F.lower(path)
    parts = F.split(low, "/")
    has = lambda *names: F.arrays_overlap(parts, F.array(*map(F.lit, names)))
    return (
        F.when(low.rlike(r"\.(?:pgsql|plpgsql)$"), "postgres")
        .when(low.endswith(".mysql"), "mysql")
        .when(has("postgres", "pg", "postgresql"), "postgres")
        .when(has("mysql", "mariadb"), "mysql")
        .when(has("sqlite"), "sqlite")
        .when(has("mssql", "tsql", "sqlserver"), "mssql")
    )


def feature_tags(dialect_col: Column, text: Column) -> Column:
    """``sql-feature:`` tags: common ones, then those of the dialect; at most eight."""
    tag = lambda p, t, extra: F.when(extra & text.rlike(p), F.lit(f"sql-feature:{t}"))
    common = [tag(p, t, F.lit(True)) for p, t in COMMON_FEATURES]
    own = [tag(p, t, dialect_col == d) for d, rows in DIALECT_FEATURES.items() for p, t in rows]
    return F.slice(F.array_compact(F.array(*common, *own)), 1, MOST_FEATURES)


_FIELDS = "file_path string, n int, chunk_type string, receiver string, symbol_name string, package_name string, signature string, imports array<string>, dialect string, features array<string>, doc_comment string, start_line int, end_line int, content string"


def sql_chunks(files: DataFrame, path_col: str = "file_path", text_col: str = "content") -> DataFrame:
    """The defining statements of SQL files, one row each: ``file_path, n, chunk_type, receiver, symbol_name, package_name, signature, imports, dialect, features, doc_comment, start_line, end_line, content``.

    A file's dialect is what its path says, else its whole text, else the standard; a
    statement that shows another one has that. ``n`` counts all statements from 0.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(f.split()[0], {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}[f.split()[1]]) for f in _FIELDS.split(", ")])
        for b in batches:
            rows = []
            for path, hint, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = hint or shown_dialect(text) or "ansi"
                line, at = 1, 0
                for n, (s, e) in enumerate(scanned(text)):
                    line, at, statement = line + text.count("\n", at, s), s, text[s:e]
                    if found := classify(statement):
                        dialect = shown_dialect(statement) or own
                        signature = " ".join(statement.split("\n", 1)[0].split())
                        rows.append({"file_path": path, "n": n, "signature": signature, "dialect": dialect, "features": shown_features(dialect, statement), "doc_comment": remark_before(statement), "start_line": line, "end_line": line + statement.count("\n"), "content": statement, **found})
            yield pa.RecordBatch.from_pylist(rows, schema)

    rows = files.select(F.col(path_col).alias("file_path"), dialect_of_path(F.col(path_col)).alias("hint"), F.col(text_col).alias("text"))
    return rows.filter(F.col("text").isNotNull()).mapInArrow(scan, _FIELDS)
