"""Tokens of texts and of queries, stemming, and excerpts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accented letters and what they are folded to.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
#: Query words that stand for operators and match exactly, without a prefix.
RESERVED = ["AND", "OR", "NOT", "NEAR"]


def tokens(text: Column) -> Column:
    """Runs of letters and digits, lower-cased and without accents; an underscore separates."""
    return F.regexp_extract_all(F.translate(F.lower(text), ACCENTED, PLAIN), F.lit(r"[\p{L}\p{N}]+"), 0)


def query_terms(query: Column) -> Column:
    r"""``term, is_prefix`` of a query's words: runs of letters, digits and underscores of two characters or more; all are prefixes but reserved words. Repeated words stay."""
    found = F.regexp_extract_all(query, F.lit(r"[\p{L}\p{N}_]{2,}"), 0)
    return F.transform(found, lambda t: F.struct(t.alias("term"), (~F.upper(t).isin(RESERVED)).alias("is_prefix")))


def _measure(stem: str) -> int:
    """The number of vowel-consonant sequences."""
    kinds = "".join("v" if _vowel(stem, i) else "c" for i in range(len(stem)))
    return sum(a == "v" and b == "c" for a, b in zip(kinds, kinds[1:], strict=False))


def _vowel(w: str, i: int) -> bool:
    return w[i] in "aeiou" or w[i] == "y" and i > 0 and not _vowel(w, i - 1)


def _has_vowel(s: str) -> bool:
    return any(_vowel(s, i) for i in range(len(s)))


def _short(s: str) -> bool:
    return len(s) > 2 and not _vowel(s, len(s) - 1) and _vowel(s, len(s) - 2) and not _vowel(s, len(s) - 3) and s[-1] not in "wxy"


# Fixed values of the published algorithm: steps 2, 3 and 4.
_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("logi", "log"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def stem(w: str) -> str:
    """The English stem of a lower-case word, by the published suffix-stripping algorithm; other words stay."""
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("s"):
        w = w[:-2] if w.endswith(("sses", "ies")) else w if w.endswith("ss") else w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _has_vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "lsz" and not _vowel(w, len(w) - 1):
                    w = w[:-1]
                elif _measure(w) == 1 and _short(w):
                    w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for rules in (_STEP2, _STEP3):
        for end, new in sorted(rules, key=lambda r: -len(r[0])):
            if w.endswith(end):
                if _measure(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + new
                break
    for end in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(end):
            root = w[: -len(end)]
            if _measure(root) > 1 and (end != "ion" or root.endswith(("s", "t"))):
                w = root
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _short(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w


def stemmed(rows: DataFrame, column: str = "token") -> DataFrame:
    """``rows`` with the words of ``column`` stemmed. Each distinct word is stemmed once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(_stem=b[column].map(stem))

    distinct = rows.select(column).distinct().mapInPandas(run, f"{column} string, _stem string")
    return rows.join(distinct, column).withColumn(column, F.col("_stem")).drop("_stem").select(rows.columns)


def highlighted(content: Column, terms: Column, width: int = 16, before: str = "<<", after: str = ">>") -> Column:
    """Up to ``width`` words of a text from the first word that begins with one of the terms, which are marked; null if none does."""
    words = F.filter(F.split(content, r"\s+"), lambda w: w != "")
    hit = lambda w: F.exists(terms, lambda t: F.exists(F.regexp_extract_all(F.lower(w), F.lit(r"[\p{L}\p{N}]+"), 0), lambda x: x.startswith(F.lower(t))))
    first = F.array_position(F.transform(words, hit), F.lit(True))
    start = F.greatest(F.lit(1), first - 2).cast("int")
    part = F.slice(words, start, F.lit(width))
    marked = F.array_join(F.transform(part, lambda w: F.when(hit(w), F.concat(F.lit(before), w, F.lit(after))).otherwise(w)), " ")
    lead = F.when(start > 1, F.lit("…")).otherwise(F.lit(""))
    tail = F.when(F.size(words) > start + width - 1, F.lit("…")).otherwise(F.lit(""))
    return F.when(first > 0, F.concat(lead, marked, tail))
