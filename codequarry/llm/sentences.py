"""Sentence units of documents in many languages and scripts (problem 10).

Texts are cut by lines into headings, list items, fenced code and paragraphs. A
pushdown automaton then runs over each of them, from one event (end mark, quotation
mark, bracket, line break, blank between Thai letters) to the next, with a stack of
the open quotations and brackets; at the outermost level it ends a sentence where
the mark, the word before it and the word after it allow. Offsets count code points.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BOM = "﻿"
#: Abbreviations after which no sentence ends, and those after which one may (fixed values of the languages).
NEVER = set(
    "e.g i.e cf vs approx fig figs sec secs p pp ver est rev resp incl max ca vgl abschn bzgl bzw ggf evtl inkl zzgl abb bd tab nr hr fr dr mr mrs ms. prof st sr sra srta dra vol no eq ch viz al. "
    "pág págs art aprox cap núm num ej env chap éd réf av рис стр см табл гл им ул г-н напр англ напр. sog z.b u.a d.h s.o o.ä i.d.r p.ej c.-à-d т.е т.н डॉ श्री".split()
)
MAY = set("etc usw a.m p.m inc ltd co corp min std sek jr etc. u.ä u.s.w т.д т.п и.др др al sq ff дол руб тыс млн max. dept".split())
# Single letters that belong to an abbreviation written with blanks: the letter before, and whether a sentence may end.
_PAIRS = {("z", "b"): False, ("u", "a"): False, ("d", "h"): False, ("o", "ä"): False, ("s", "o"): False, ("s", "u"): False, ("i", "e"): False, ("e", "g"): False, ("т", "е"): False, ("т", "д"): True, ("т", "п"): True, ("т", "н"): False, ("p", "ej"): False, ("u", "s"): False, ("u", "ä"): True}
_FIRST = {"z", "u", "d", "т", "p", "o"}
_MONTHS = set("januar februar märz april mai juni juli august september oktober november dezember jan feb mär apr jun jul aug sep sept okt nov dez january february march may june july october december".split())
_STARTERS = set("the it this that these those each every only one in as we a an for if when once our his her they there once neither never use see set why is does no sadly some however".split())
_PAUSES = set("hmm hm well uh um er ah oh wait ok okay so and but or äh nun also eh euh bueno pues ну э".split())
_QUOTED_ON = re.compile(r"(?:と|って|という|との|라고|라는|이라고|이라는|하고|고 |란 )")

_FENCE = re.compile(r"^[ \t﻿ ]*(`{3,}|~{3,})")
_HEADING = re.compile(r"^[ \t﻿ ]{0,3}#{1,6}(?:\s|$)")
_ITEM = re.compile(r"^[\s﻿]*(?:[-*+•·‣▪]|\d{1,9}[.)])\s+(?=\S)")
_END = "。！？｡．।॥؟"
_CLOSERS = {'"': '"', "“": "”", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "【": "】", "《": "》", "〈": "〉", "”": "”"}
_BRACKETS = "(（[【"
_AFTER = "\"'”’»›」』)）]】》〉*_"
_THAI = "ก-ฺเ-๎"
_EVENT = re.compile(rf"[.!?…{_END}]+|[\"“”„«»‹›「」『』()（）\[\]【】《》〈〉`]|\n|(?<=[{_THAI}])[^\S\n]+(?=[{_THAI}])")
_LINE_SCRIPT = re.compile(r"[ก-๎ᄀ-ᇿ぀-ヿ㄰-㆏㐀-鿿가-힯ｦ-ﾟ]")
_CASELESS = re.compile(r"[֐-෿฀-࿿ᄀ-ᇿ぀-ヿ㄰-㆏㐀-鿿가-힯ｦ-ﾟ]")
_EAST = re.compile(r"[ᄀ-ᇿ぀-ヿ㄰-㆏㐀-鿿가-힯ｦ-ﾟ]")
_NEXT = re.compile(r"[\s﻿]*")
_TOKEN = re.compile(r"\S+")
# Of a word in a script without case only its beginning is looked at, which in scripts without blanks may be followed by the whole text.
_CASELESS_TOKEN = re.compile(r"\S{1,8}")
_BACK = regex.compile(r"(?r)\S+")
_BACK_GAP = regex.compile(r"(?r)\s+")
_IDENTIFIER = re.compile(r"^[\"'(`]*(?:`|\w*_\w|[\w.]*\w\(|[^\W\d_A-Z]+[A-Z]|\w+(?:[./]\w+)+|v?\d)")
_PLAIN_NEXT = re.compile(r"[^\W\d_]+(?:'\w+)?(?=[\s,;:]|$)")


def blocks(text: str) -> list[tuple[int, int, int]]:
    """``start, end, body``: the stretches of text that units do not cross; ``body`` is where a list item's text begins. A code block has ``body`` -1."""
    out: list[tuple[int, int, int]] = []
    start, pos, fence, plain = -1, 0, "", False
    for line in text.split("\n"):
        end = pos + len(line)
        if fence:
            if line.strip(" \t\r﻿ ").startswith(fence) and not line.strip(" \t\r﻿ " + fence[0]):
                out.append((start, end, -1))
                start, fence = -1, ""
            pos = end + 1
            continue
        opened = _FENCE.match(line)
        blank = not line.strip("﻿ \t\r 　​") or not line.replace(BOM, "").strip()
        heading = _HEADING.match(line)
        item = None if plain else _ITEM.match(line)
        if (opened or blank or heading or item) and start >= 0:
            out.append((start, pos, start))
            start = -1
        if opened:
            start, fence = pos, opened[1]
        elif heading:
            out.append((pos, end, pos + heading.end()))
            out[-1] = (pos, end, -1)
        elif item:
            out.append((pos, end, pos + item.end()))
        elif not blank and start < 0:
            start = pos
        plain = not (opened or blank or heading or item)
        pos = end + 1
    if start >= 0:
        out.append((start, len(text), -1 if fence else start))
    return out


def _is_line_ended(line: str) -> bool:
    """Whether a line break after this line ends a unit: the line is Chinese, Japanese, Korean or Thai."""
    found = len(_LINE_SCRIPT.findall(line))
    return found >= 4 or found >= 1 and found * 4 >= sum(map(str.isalpha, line))


def _word_before(text: str, start: int, at: int) -> tuple[str, str, str]:
    """The chunk before an end mark, its last word in lower case, and the word before that if it ended in a dot."""
    found = _BACK.match(text, start, at)
    if not found:
        return "", "", ""
    chunk = unicodedata.normalize("NFC", found[0])
    word = re.search(r"[^\W_]+(?:\.[^\W_]+)*$|[ऀ-ॣ]+$", chunk)
    gap = _BACK_GAP.match(text, start, found.start())
    before = gap and text[gap.start() - 1 : gap.start()] == "." and gap.start() > start and _BACK.match(text, start, gap.start())
    return chunk, word[0].lower() if word else "", before[0].lower()[:-1].strip("(\"'«„“") if before else ""


def _next_kind(text: str, at: int, end: int) -> tuple[str, bool, str]:
    """What follows: ``end``, ``upper``, ``lower``, ``name`` (an identifier, path or version), ``digit``, ``open``, ``caseless`` or ``other``; whether white space comes before it; and it."""
    gap = _NEXT.match(text, at, end).end()
    if gap >= end:
        return "end", gap > at, ""
    c = text[gap]
    if _CASELESS.match(c):
        return "caseless", gap > at, _CASELESS_TOKEN.match(text, gap, end)[0]
    token = _TOKEN.match(text, gap, end)[0]
    if c in "\"“„«‹「『(（[【¿¡`《〈":
        kind = "open"
    elif c.isdigit():
        kind = "digit"
    elif c.isalpha():
        plain = unicodedata.normalize("NFC", token)
        kind = "upper" if c.isupper() else "name" if _IDENTIFIER.match(plain) else "lower"
    else:
        kind = "other"
    return kind, gap > at, token


def _ends(text: str, start: int, s: int, e: int, after: int, end: int) -> bool:
    """Whether the end mark ``text[s:e]``, with its closing marks up to ``after``, ends a sentence that began at ``start``."""
    mark = text[s:e]
    kind, gap, token = _next_kind(text, after, end)
    if kind == "end":
        return True
    if any(c in _END for c in mark):
        return True
    chunk, word, previous = _word_before(text, start, s)
    caseless_before = bool(chunk) and bool(_CASELESS.match(chunk[-1]))
    if "…" in mark or mark.count(".") > 1 and not mark.strip("."):
        if chunk and _EAST.match(chunk.rstrip("`()\"'”」』")[-1:] or "") or mark.count("…") > 1:
            return True
        if word in _PAUSES or not gap:
            return False
        return kind in ("upper", "name", "open") or kind == "caseless"
    if "!" in mark or "?" in mark:
        if not gap:
            return kind == "caseless" or kind == "upper" and bool(_PLAIN_NEXT.match(token)) and not re.search(r"[/_=]", chunk)
        return kind not in ("lower", "other") or kind == "other" and token[0] in "-–—*#>•"
    # A single dot.
    if not chunk:
        return False
    if not gap:
        if after > e:
            return kind == "upper" and bool(_PLAIN_NEXT.match(token))
        if kind == "caseless":
            return caseless_before or chunk[-1] in ")`"
        plain = re.fullmatch(r"[\"'(«“„\[]*[^\W\d_]*[^\W\d_A-Z](?:[-'’][^\W\d_]+)*[)\]\"'”»%]*|\d+|%|[^\s/]*[`)]", chunk)
        return kind == "upper" and bool(plain) and bool(_PLAIN_NEXT.match(unicodedata.normalize("NFC", token))) and word not in NEVER
    if kind == "other" and token[0] in ",;:/)]}%&=|":
        return False
    pair = _PAIRS.get((previous, word))
    may = word in MAY or pair is True
    if pair is False and not may or word in NEVER and word != "no" or word == "no" and kind == "digit":
        return False
    if word in _FIRST and len(chunk.strip("(\"'«„")) == 1 and kind in ("lower", "upper") and (word, token.lower().rstrip(".,")) in _PAIRS:
        return False
    if word == "u.s":
        return kind in ("upper", "open") and token.lower().strip("(\"'`") in _STARTERS
    if chunk and "ऀ" <= chunk[-1] <= "ॿ":
        return False
    if may:
        return kind in ("upper", "name", "open", "caseless")
    number = re.fullmatch(r"[(\"'«„]*(\d{1,3})", chunk)
    if number and (unicodedata.normalize("NFC", token).lower().strip(".,;") in _MONTHS or kind == "lower"):
        return False
    if len(word) == 1 and chunk.strip("(\"'«„") == chunk[-1] and chunk[-1].isupper() and kind == "upper":
        return token.lower() in _STARTERS
    if kind == "lower":
        return caseless_before
    return True


def _after_close(text: str, opener: str, led: bool, after: int, end: int) -> bool:
    """Whether a sentence ends after a closing mark before which a sentence ended; ``led``: the opening mark began the sentence."""
    kind, gap, token = _next_kind(text, after, end)
    if kind == "end":
        return True
    if opener in _BRACKETS and not led:
        return False
    if kind == "other":
        return led and token[0] not in ",;:.!?…-–—%/" + _END
    if kind == "caseless":
        return led and not _QUOTED_ON.match(token)
    return kind in ("upper", "name", "open") or led and kind == "digit"


def sentence_ends(text: str) -> list[int]:
    """The offsets of the ends of all units: after their last character that is not white."""
    ends: list[int] = []

    def emit(start: int, end: int) -> None:
        unit = text[start:end].rstrip(" \t\r\n\f\v      　\x1c\x1d\x1e\x1f\x85﻿" + "".join(map(chr, range(0x2000, 0x200B))))
        if unit.strip().strip(BOM).strip():
            ends.append(start + len(unit))

    for start, end, body in blocks(text):
        if body < 0:
            emit(start, end)
            continue
        stack: list[tuple[str, int]] = []
        unit, first = start, _NEXT.match(text, body, end).end()
        at = body
        line_start, last_of = start, {}
        # Quotation marks of the unit, counted as far as ``quoted[0]``.
        quoted = [unit, 0]

        def closed_later(opener: str, after: int) -> bool:
            for x in _CLOSERS[opener]:
                if x not in last_of:
                    last_of[x] = text.rfind(x, start, end)
                if last_of[x] >= after:
                    return True
            return False

        def odd_quotes(until: int) -> bool:
            if quoted[0] < unit:
                quoted[:] = [unit, 0]
            quoted[:] = [until, quoted[1] + text.count('"', quoted[0], until)]
            return quoted[1] % 2 == 1

        while m := _EVENT.search(text, at, end):
            s, e = m.span()
            c, at = text[s], e
            cut = -1
            if c == "`":
                close = text.find("`", e, end)
                at = close + 1 if close >= 0 else e
            elif c == "\n":
                if _is_line_ended(text[max(line_start, unit) : s]):
                    cut, stack = s, []
                line_start = e
            elif c.isspace():
                cut = s if not stack else -1
            elif stack and c in _CLOSERS[stack[-1][0]]:
                opener, place = stack.pop()
                while at < end and text[at] in _AFTER and not (stack and text[at] in _CLOSERS[stack[-1][0]]) and text[at] not in '"*_':
                    at += 1
                inner = text[place + 1 : s].rstrip()
                if not stack and inner and (inner[-1] in ".!?…" or inner[-1] in _END) and _after_close(text, opener, place == first, at, end):
                    cut = at
            elif c in _CLOSERS:
                if closed_later(c, e) and not (c == "(" and text[e : e + 1] == ")"):
                    stack.append((c, s))
            elif c in ".!?…" or c in _END:
                if not stack:
                    while at < end and text[at] in _AFTER and text[at] != '"':
                        at += 1
                    if at < end and text[at] == '"' and at + 1 < end and text[at + 1].isspace() and odd_quotes(at):
                        at += 1
                    if _ends(text, unit, s, e, at, end):
                        cut = at
            if cut >= 0:
                emit(unit, cut)
                unit = cut
                first = _NEXT.match(text, cut, end).end()
                at = max(at, cut)
        emit(unit, end)
    return ends


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, numbers, starts, ends, units = [], [], [], [], []
        for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            at = 0
            for n, end in enumerate(sentence_ends(text), 1):
                start = at + len(text[at:end]) - len(text[at:end].lstrip().lstrip(BOM).lstrip())
                ids.append(key)
                numbers.append(n)
                starts.append(start)
                ends.append(end)
                units.append(text[start:end])
                at = end
        cols = [pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(units, pa.string())]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "unit", "start_char", "end_char", "sentence"])


def split_sentences(docs: DataFrame) -> DataFrame:
    """``doc_id, unit, start_char, end_char, sentence``: every sentence unit of every text, in order from 1.

    ``start_char`` and ``end_char`` are code point offsets of the unit without the
    white space around it. Null, empty and blank texts have no units. Rows that repeat
    a ``doc_id`` are split each. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text").filter(F.length("text") > 0)
    return rows.mapInArrow(_split, "doc_id long, unit int, start_char long, end_char long, sentence string")
