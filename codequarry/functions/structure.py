"""Lines, parts, comments and embedded scripts of source text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Languages by file extension.
LANGUAGES = {".go": "go", ".ts": "typescript", ".tsx": "tsx", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "jsx", ".py": "python", ".pyi": "python", ".rs": "rust", ".java": "java", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".c": "cpp", ".hpp": "cpp", ".hh": "cpp", ".h": "cpp", ".cs": "csharp", ".svelte": "svelte", ".sql": "sql", ".pgsql": "sql", ".plpgsql": "sql", ".mysql": "sql"}


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def language_of(path: Column) -> Column:
    """The language of a path by its last extension; null if unknown."""
    pairs = [F.lit(x) for item in LANGUAGES.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), F.regexp_extract(F.lower(path), r"(\.[^.]*)$", 1))


def snippet(content: Column, lines: int = 30) -> Column:
    """The first lines of a text, with a remark if there are more."""
    parts = F.split(content, "\n", -1)
    return F.when(F.size(parts) > lines, F.concat(F.array_join(F.slice(parts, 1, lines), "\n"), F.lit("\n// ...(truncated)"))).otherwise(content)


def split_long_chunks(chunks: DataFrame, max_lines: int = 512) -> DataFrame:
    """``chunk_id, symbol_name, start_line, end_line, content``: chunks of over ``max_lines`` lines as consecutive parts named ``symbol#partN``, others as they are."""
    lines = F.split("content", "\n", -1)
    long = F.size(lines) > max_lines
    starts = F.when(long, F.sequence(F.lit(0), F.size(lines) - 1, F.lit(max_lines))).otherwise(F.array(F.lit(0)))
    parts = chunks.withColumn("_lines", lines).withColumn("_long", long).select("*", F.posexplode(starts).alias("_n", "_at"))
    name = F.when(F.col("_long"), F.concat(F.coalesce("symbol_name", F.lit("")), F.lit("#part"), (F.col("_n") + 1).cast("string"))).otherwise(F.col("symbol_name"))
    first = F.col("start_line") + F.col("_at")
    last = F.when(F.col("_long"), first + F.size(F.slice("_lines", F.col("_at") + 1, F.lit(max_lines))) - 1).otherwise(F.col("end_line"))
    text = F.when(F.col("_long"), F.array_join(F.slice("_lines", F.col("_at") + 1, F.lit(max_lines)), "\n")).otherwise(F.col("content"))
    return parts.select("chunk_id", name.alias("symbol_name"), first.cast("int").alias("start_line"), last.cast("int").alias("end_line"), text.alias("content"))


def comment_above(source: Column, line: Column, mark: str) -> Column:
    """The comment lines that begin with ``mark`` directly above a line (from 1), without the mark; null if there are none."""
    above = F.slice(F.split(source, "\n", -1), F.lit(1), F.greatest(F.lit(0), line - 1))
    backward = F.reverse(F.transform(above, lambda x: F.trim(x)))
    is_comment = F.transform(backward, lambda x: x.startswith(mark))
    gap = F.array_position(is_comment, F.lit(False))
    run = F.when(gap > 0, F.slice(backward, F.lit(1), (gap - 1).cast("int"))).otherwise(backward)
    text = F.array_join(F.transform(F.reverse(run), lambda x: F.trim(F.substring(x, F.lit(len(mark) + 1), F.length(x)))), "\n")
    return F.when(F.size(run) > 0, text)


def block_comment_above(source: Column, line: Column) -> Column:
    """The text of a ``/* */`` comment that ends on the line above, else of ``//`` lines; null if there is neither."""
    before = F.array_join(F.slice(F.split(source, "\n", -1), F.lit(1), F.greatest(F.lit(0), line - 1)), "\n")
    block = F.regexp_extract(before, r"(?s)/\*\*?((?:(?!\*/).)*)\*/[ \t\r]*$", 1)
    clean = _stripped(F.regexp_replace(block, r"(?m)^[ \t]*\*[ \t]?", ""))
    return F.when(block != "", clean).otherwise(comment_above(source, line, "//"))


def docstring(source: Column) -> Column:
    """The leading string literal of a Python function's body, without its quotes; null if there is none."""
    found = F.regexp_extract(source, r"""(?s)^\s*(?:async\s+)?(?:def|class)\b[^\n]*?:[ \t]*(?:#[^\n]*)?\n\s*[rRuU]?("{3}|'{3})(.*?)\1""", 2)
    return F.when(found != "", _stripped(found))


def script_blocks(source: Column) -> Column:
    """The script blocks of a component file: ``attributes, is_module, code, first_line`` (from 1) each."""
    pattern = F.lit(r"(?is)<script\b[^>]*>.*?</script\s*>")
    blocks = F.regexp_extract_all(source, pattern, 0)

    def one(b: Column) -> Column:
        attributes = F.regexp_extract(b, r"(?is)^<script\b([^>]*)>", 1)
        before = F.call_function("substring_index", source, b, F.lit(1))
        return F.struct(
            F.trim(attributes).alias("attributes"),
            attributes.rlike(r"""(?i)context\s*=\s*["']?module|\bmodule\b""").alias("is_module"),
            F.regexp_extract(b, r"(?is)^<script\b[^>]*>(.*?)</script\s*>$", 1).alias("code"),
            (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).alias("first_line"),
        )

    return F.transform(blocks, one)


def template_text(source: Column) -> Column:
    """A component file without its script and style blocks."""
    return _stripped(F.regexp_replace(source, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", ""))
