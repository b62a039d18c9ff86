"""Cutting oversized items into overlapping pieces at natural boundaries (problem 3).

Everything runs as Spark SQL on the JVM. Two regular expressions with bounded
quantifiers take as much text as fits; their alternatives are ordered by the
strength of the boundary they end at, and the last ones cut a line by characters.
The first one bounds the lines of a piece, the second one its characters. The
overlap is then looked up in the preceding segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def line_count(text: Column) -> Column:
    r"""Lines separated by ``\n``; a final ``\n`` starts no further line; null and empty texts have none."""
    text = F.coalesce(text, F.lit(""))
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(text == "", 0).otherwise(breaks + F.when(text.endswith("\n"), 0).otherwise(1)).cast("int")


def over_limit(text: Column, max_lines: int, max_chars: int) -> Column:
    """Whether ``text`` has more lines or characters (code points) than allowed."""
    return (F.length(text) > max_chars) | (line_count(text) > max_lines)


def _line_pattern(most: int) -> str:
    """Takes up to ``most`` lines: the rest; up to a blank line before an unindented line; a blank line; before an unindented line; any line end."""
    line, half = r"(?:[^\n]*+\n)", most // 2
    opening = r"(?=[^\s})\]])"
    return "|".join(
        [
            rf"{line}{{0,{most - 1}}}[^\n]++\z",
            rf"{line}{{1,{most}}}\z",
            rf"{line}{{{half},{most - 1}}}[ \t\r]*+\n{opening}",
            rf"{line}{{{half},{most - 1}}}[ \t\r]*+\n",
            rf"{line}{{{half},{most}}}{opening}",
            rf"{line}{{1,{most}}}",
        ]
    )


def _char_pattern(most: str) -> str:
    """SQL expression of a pattern that takes up to ``most`` (an SQL expression) characters, by the same order of boundaries, then a blank, then any character."""
    opening = r"(?=[^\\s})\\]])"
    ends = [
        ("1", r"\\z"),
        ("H", r"(?<=\\n\\r?\\n)" + opening),
        ("H", r"(?<=\\n\\r?\\n)"),
        ("H", r"(?<=\\n)" + opening),
        ("1", r"(?<=\\n)"),
        ("H", r"(?<=[\\s,;])"),
        ("1", ""),
    ]
    half = f"cast({most} div 2 as string)"
    parts = [f"'.{{', {half if least == 'H' else "'1'"}, ',', cast({most} as string), '}}{end}'" for least, end in ends]
    return "concat('(?s)', " + ", '|', ".join(parts) + ")"


def _pinned(df: DataFrame, name: str, sql: str) -> DataFrame:
    """Adds a column that is computed once a row; a plain projection would be inlined into the lambdas that read it and run once an element."""
    return df.select("*", F.explode(F.array(F.expr(sql))).alias(name))


def split_oversized(
    items: DataFrame,
    max_lines: int = 512,
    max_chars: int = 20_000,
    overlap_lines: int = 10,
    overlap_chars: int = 200,
    id_col: str = "chunk_id",
    text_col: str = "content",
    start_col: str = "start_line",
) -> DataFrame:
    """Pieces of the items over the limit: ``id_col, piece_no, n_pieces, start_line, end_line, overlap, content``.

    Each piece has at most ``max_lines`` lines and ``max_chars`` characters. A piece
    that begins at a line repeats the ``overlap_lines`` lines before it; one that
    begins inside a line that had to be cut repeats ``overlap_chars`` characters.
    Where the lines to repeat are longer than half the character limit, characters
    are repeated instead. ``overlap`` is the number of characters repeated.
    Concatenating the pieces without their overlaps gives the text.

    Items within the limit, null and empty texts give no piece. A null start line
    counts as 1. Rows that repeat an id count once. Other columns are ignored.
    """
    if max_lines <= overlap_lines or max_chars < 4 * overlap_chars or overlap_lines < 1:
        raise ValueError("the overlap must be well below the limit")
    line_p = _line_pattern(max_lines - overlap_lines).replace("\\", "\\\\").replace("'", "\\'")
    over = (
        items.select(F.col(id_col).alias("id"), F.coalesce(F.col(start_col), F.lit(1)).cast("long").alias("at"), F.col(text_col).alias("text"))
        .filter(over_limit(F.col("text"), max_lines, max_chars))
        .dropDuplicates(["id"])
    )
    # The longest stretch of lines that an overlap may need; the new text of a piece leaves room for it.
    sized = _pinned(over, "lens", "transform(split(text, '\\n', -1), x -> length(x) + 1)")
    sized = _pinned(
        sized,
        "reserve",
        f"least({max_chars // 2}, greatest({overlap_chars}, aggregate(sequence(1, size(lens)), 0,"
        f" (m, i) -> greatest(m, aggregate(slice(lens, i, {overlap_lines}), 0, (s, x) -> s + x)))))",
    ).drop("lens")
    sized = _pinned(sized, "pattern", _char_pattern(f"({max_chars} - reserve)"))
    cut = _pinned(sized, "segs", f"flatten(transform(regexp_extract_all(text, '{line_p}', 0), s -> regexp_extract_all(s, pattern, 0)))").drop("text", "pattern")
    # Before segment i: the text just before it, then the part of that which is repeated.
    look = _pinned(
        cut,
        "before",
        f"transform(segs, (s, i) -> if(i = 0, '', array_join(slice(segs, greatest(1, i - {overlap_lines + 1}), least(i, {overlap_lines + 2})), '')))",
    )
    look = _pinned(
        look,
        "shared",
        f"transform(before, b -> if(b = '', '', if(endswith(b, '\\n') and length(substring_index(b, '\\n', -{overlap_lines + 1})) <= reserve,"
        f" substring_index(b, '\\n', -{overlap_lines + 1}), right(b, {overlap_chars}))))",
    ).drop("before")
    look = _pinned(look, "parts", "arrays_zip(segs, shared)").select("id", "at", F.size("segs").alias("n_pieces"), F.posexplode("parts").alias("i", "part"))
    pieces = look.select("id", "at", "n_pieces", "i", F.col("part.segs").alias("seg"), F.col("part.shared").alias("own"))
    # Pieces still lie where their items were told apart, so lines are summed up without a shuffle.
    breaks = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    before = F.sum(breaks(F.col("seg"))).over(Window.partitionBy("id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    own = F.col("own")
    first = F.col("at") + F.coalesce(before, F.lit(0)) - breaks(own)
    pieces = pieces.withColumn("first", first)
    first = F.col("first")
    return pieces.select(
        F.col("id").alias(id_col),
        (F.col("i") + 1).alias("piece_no"),
        "n_pieces",
        first.cast("int").alias("start_line"),
        (first + line_count(F.concat(own, F.col("seg"))) - 1).cast("int").alias("end_line"),
        F.length(own).alias("overlap"),
        F.concat(own, F.col("seg")).alias("content"),
    )
