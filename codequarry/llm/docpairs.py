"""Functions paired with their documentation (problem 1).

Spark keeps the functions and methods and hands them to tasks in Arrow batches.
There a regular expression finds the signature, a stack (of braces, of indentation
or of begin/end keywords) delimits the body, and the comments next to the
signature, by line distance, or the docstring after it are attached. Documentation
that says nothing is dropped line by line; a pair remains if anything is left.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most lines between a comment and the signature it belongs to.
MAX_GAP = 1

_OPEN = re.compile(r"^\s*(?:///?!?|/\*+!?|\*+(?!/)|#+!?(?!\[)|--+(?!-*\s*$)|<!--|%+|;+|\"\"\"|''')")
_CLOSE = re.compile(r"(?:\*+/|-->|\"\"\"|''')\s*$")
_LINE_COMMENT = re.compile(r"^\s*(?://|#(?!\[|define|include|pragma|if|endif|else|region|endregion|undef|ifdef|ifndef)|--|;;)")
_DECORATOR = re.compile(r"^\s*(?:@\w[\w.]*(?:\(.*\))?|#\[.*\]|\[[A-Z]\w*(?:\(.*\))?\]|template\s*<.*>)\s*$")
_DOCSTRING = re.compile(r"\s*[rRuUbB]{0,2}(\"\"\"|''')(.*?)\1", re.S)
_SKIP = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|//[^\n]*|/\*.*?\*/|([{}])", re.S)
_BLOCKS = re.compile(r"'(?:''|[^'])*'|--[^\n]*|\b(?:(BEGIN|CASE|IF(?=[^;]*\bTHEN\b)|LOOP)|(END)(?:\s+(?:IF|LOOP|CASE))?)\b|(\$\w*\$)", re.I | re.S)

# What documentation that says nothing looks like, in several languages.
_EMPTY = re.compile(
    r"^(?:todo|fixme|xxx|hack|wip|tbd|tba|tbc|n\s*/?\s*a|none|null|nil|nothing|\.{2,}|…|"
    r"(?:(?:a|the|this|some|internal|private|small|simple|main)\s+)*(?:helpers?|utils?|utility|utilities|constructor|ctor|destructor|getters?|setters?|accessor|function|method|stub|placeholder|callback|wrapper|implementation|internal|private|description|comment|docs?|documentation|summary)(?:\s+(?:functions?|methods?|here|goes here|text|only))*|"
    r"(?:auto[- ]?)?generated (?:method|function|constructor|catch block)?\s*stub|(?:default|empty|copy) (?:constructor|implementation|method|body)|"
    r"(?:please\s+)?(?:add|write|insert|fill in|fix|update|complete|needs?|missing|no|lacks?|enter|provide)\s+(?:an?\s+|the\s+|some\s+|me\s+|proper\s+|missing\s+|more\s+)*(?:descriptions?|docs?|documentation|comments?|docstrings?|summary|details?|text)(?:\s+(?:here|yet|later|needed|required|missing|available|provided|given))*|"
    r"(?:descriptions?|docs?|documentation|comments?|docstring)\s+(?:is\s+|are\s+)?(?:missing|needed|required|pending|to do|todo|to follow|follows|to come|coming soon|goes here|here|tbd)|"
    r"(?:to be )?(?:documented|described|written|implemented|done|determined|defined|completed|continued)(?:\s+later)?|(?:please\s+)?document(?: this| me| it)?(?: (?:function|method|later|properly))?|not (?:yet )?(?:documented|implemented)(?: yet)?|undocumented|implement(?: me| this| it)?|fix(?: me| this| it)|later|cleanup|clean up|refactor(?: this)?|remove(?: this)?|"
    r"문서화\s*(?:필요|예정|하기)?|설명\s*(?:없음|필요|추가|추가 필요|추가 예정|누락)?|주석\s*(?:없음|필요|추가)|작성\s*(?:예정|필요|중)|추후\s*(?:작성|추가|작성 예정)|미작성|"
    r"(?:die\s+)?(?:beschreibung|dokumentation|kommentar)\s*(?:fehlt|folgt|ergänzen|hinzufügen|nachtragen|noch offen)?(?:\s+noch)?|keine? (?:beschreibung|dokumentation|kommentar)|noch (?:zu dokumentieren|nicht dokumentiert|offen)|"
    r"(?:sin|falta|añadir|agregar|pendiente de)\s+(?:la\s+|una\s+)?(?:descripci[oó]n|documentaci[oó]n|documentar|comentarios?)|pendiente|por documentar|descripci[oó]n pendiente|"
    r"(?:sans|ajouter|manque)\s+(?:la\s+|une\s+)?(?:description|documentation|commentaire)|(?:description|documentation) (?:manquante|à (?:faire|compléter|venir))|à (?:documenter|compléter|faire)|"
    r"説明\s*(?:なし|未記入|を?追加|が?必要|を書く)?|ドキュメント\s*(?:なし|未作成|を?追加|が?必要|化)?|要(?:ドキュメント|説明|記載)|未(?:記入|記載|作成)|後で書く|なし|"
    r"(?:暂无|缺少|没有|无|待补充|补充|需要|添加|待)?(?:说明|描述|文档|注释)(?:缺失|待补充|待完善|待写)?|待补充|待完善|待办|暂无|无|"
    r"(?:нет|без|добавить|нужно|требуется)\s+(?:описани[еяю]|документаци[июя]|комментари[йяи])|описание\s+(?:отсутствует|позже|добавить)|документация\s+(?:отсутствует|позже)|"
    r"ไม่มีคำอธิบาย|เพิ่มคำอธิบาย|विवरण\s*(?:नहीं|जोड़ें|आवश्यक)?|وصف\s*(?:مفقود)?|بدون وصف)$",
    re.I,
)
_TODO = re.compile(r"^(?:@?todo|fixme|xxx|hack)\b(?:\s*\([^)]*\))?\s*[:\-–]*\s*", re.I)
_POINTER = re.compile(
    r"^(?:\{@inheritdoc\}|@inheritdoc|inheritdoc|<inheritdoc.*|(?:@see|see(?:\s+also)?|refer\s+to|cf\.?|same as|as|like|described in|documented in|docs?\s*:|siehe|vgl\.?|wie|voir|comme|v[eé]ase|ver|como|см\.?|смотри|참고|참조)\b[^.;!?。]{0,90}|\{@link [^}]*\}|"
    r"(?:위|아래|상단)[^.]{0,12}(?:참조|참고|동일)|上記(?:参照|と同じ)?|下記参照|同上|以上参照|见上(?:文|面)?|见下(?:文|面)?|参见.{0,40}|https?://\S+)[\s.。]*$",
    re.I,
)
_LINT = re.compile(
    r"^(?:eslint|tslint|jslint|jshint|pylint|flake8|noqa|nolint|nosec|noinspection|prettier-ignore|biome-ignore|ts-(?:ignore|nocheck|expect-error)|@ts-\w+|type:\s*ignore|mypy:|pyright:|ruff:|isort:|fmt:|yapf:|rustfmt|clippy|clang-(?:format|tidy)|checkstyle|rubocop|phpcs|golangci|lint:|gosec|go:\w+|\+build|istanbul|c8 ignore|v8 ignore|coverage:|pragma:|cppcheck|resharper|suppresswarnings|suppress|stylelint|sqlfluff|-\*-|vim:|@formatter)\b[^。]*$|^@?(?:override|nullable|nonnull|internal|private|public|protected|async|static|export|api|function|method|class|constructor|memberof \S+|access \w+|since [\w.]+|version [\w.]+|@?author .*|generated|(?:end)?region\b(?: \w+)?)\.?$",
    re.I,
)
_NOTICE = re.compile(
    r"copyright|©|\(c\)\s*\d{4}|all rights reserved|spdx-|licen[sc]ed?\b.{0,60}\b(?:under|terms|see|file|apache|mit|bsd|gpl|mpl)|\b(?:apache|mit|bsd|gpl|lgpl|mpl|isc)[- ](?:licen[sc]e|style)|redistribution and use|without warranty|\bas is\b.{0,20}without|permission is hereby|source terms|"
    r"\b(?:auto[- ]?generated|machine[- ](?:written|generated)|generated (?:by|from|code|file|with|automatically)|(?:code|file|this) (?:is |was )?(?:auto)?generated|built automatically|produced by a tool|do not (?:edit|modify|patch|touch|change)|don't edit|never edit|edits? (?:will be|are) (?:lost|overwritten)|changes will be lost|edit the (?:schema|source|template) instead|to refresh$|hand edits|(?:get|gets|be|are|is) overwritten|this is an? \w+ artifact)|"
    r"\bvendored\b|third[- ]party|upstream (?:licence|license|revision|commit)|mirrored for|taken unchanged|\bminified\b|source tree:|kept by hand|idea borrowed from|</?auto-generated|automatisch (?:erzeugt|generiert)|nicht (?:bearbeiten|ändern)|autogenerado|generado autom|no (?:modificar|editar)|généré automatiquement|ne pas modifier|자동\s*생성|수정하지 마|自動生成|編集しない|自动生成|请勿(?:修改|编辑)|не редактировать|сгенерирован|-----begin|^[\w.@/-]+(?: [\w.-]+)? v?\d+\.\d+(?:\.\d+)*$|^@(?:license|preserve|copyright|file|fileoverview)\b",
    re.I,
)
_CODE = re.compile(
    r"[;{}]\s*$|^\s*[})\]]|=>|^(?:if|for|while|switch|match|elif|else if|catch|with|unless)\b.*[({:]\s*$|^(?:if|for|while|switch)\s*\(|^(?:else|try|finally|do|loop)\s*[:{]?$|^(?:const|let|var|auto|mut)\s+\S+.*=|^(?:return|throw|raise|yield|await|defer|delete|assert)\b\s+[\w\"'(\[{!&*.-]+[\w.\[\]]*(?:\(.*|\s*[=!<>+*/-]=?.*)?$|"
    r"^(?:import|from|using|package|include|require)\s+[\w.\"'<]+(?:\s+import\s+.*)?$|^[\w.\[\]>*&-]+(?:\s*:\s*[\w<>\[\], ]+)?\s*(?::=|\+=|-=|\*=|/=|<-|=(?!=))\s*\S|^(?:await\s+)?[\w$]+(?:(?:\.|::|->)[\w$]+)*!?\(.*\)\s*[;?]?\s*$|^(?:def|func|fn|function|class|public|private|protected|static|void|async)\s+\w+.*[({:]|^(?:SELECT|INSERT|UPDATE|DELETE|DROP|CREATE|ALTER)\s.*(?:FROM|INTO|SET|WHERE|TABLE)|^[\w<>:, ]+[*&]?\s+\w+\s*=\s*\S|^(?:case\s.+|default)\s*:$|^[\w$]+(?:\s*,\s*[\w$]+)+\s*:?=\s|^[\w.]+\[[^\]]*\]\s*[-+*/]?=\s|\b(?:LOOP|THEN)\s*$|^(?:FOR|IF|WHILE|PERFORM|RETURN|RAISE|EXECUTE|DECLARE|BEGIN|END)\b[^a-z]*(?:[a-z_]|$)|^</?\w+[^>]*>$",
)
_SECTION = re.compile(r"^(?:args?|arguments?|param(?:eter)?s?|returns?|return values?|raises|throws|yields|notes?|examples?|inputs?|outputs?|see also|attributes|parameter|rückgabe|parámetros|paramètres|引数|戻り値|参数|返回(?:值)?|매개변수|반환(?:값)?)\s*[:：]?\s*[-=]*$", re.I)
_PARAM = re.compile(
    r"^(?:[@\\](?:param(?:eter)?|arg(?:ument)?|tparam|typeparam|property|prop|template)\b|:(?:param|parameter|arg|argument|key|keyword|type|var)\b|<(?:param|typeparam)\s+name=\"?[^>]*>)\s*(?:\[(?:in|out|in,out)\]\s*)?(?:\{[^}]*\}\s*)?(?:\w[\w<>,\[\]|. ]*\s+(?=\w+\s*:))?\[?\$?[\w.*-]*(?:=[^\]]*)?\]?\s*[:\-–—]*\s*(.*)$",
    re.I,
)
_RETURN = re.compile(r"^(?:[@\\](?:returns?|result|yields?|throws|exception|raises)\b|:(?:returns?|rtype|raises?|yields?)\b\s*:?|<returns>)\s*(?:\{[^}]*\})?\s*[:\-–—]*\s*(.*)$", re.I)
_ARG_LINE = re.compile(r"^[-*•]?\s*`?\*{0,2}\w+`?\s*(?:\([^)]*\))?\s*(?::|--|–|—|-\s)\s*(.*)$")
_TYPE_ONLY = re.compile(r"^(?:(?:the|a|an)\s+)?(?:string|str|int|integer|number|bool|boolean|float|double|object|any|void|none|null|list|array|dict|map|date|optional|promise|error|value|result|param(?:eter)?|argument|[A-Z]\w*(?:<.*>)?|\w+\[\])?[\s.]*$")
_TAG = re.compile(r"</?(?:summary|remarks|para|returns|param|c|code|p|br|value|b|i)(?:\s[^>]*)?/?>", re.I)
_LETTERS = re.compile(r"[^\W\d_]")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_a-zA-Z]+")
_GLUE = {"the", "a", "an", "of", "for", "to", "from", "in", "and", "or", "this", "that", "it", "is", "by", "with", "on", "at", "as", "its", "function", "method", "func", "getter", "setter", "helper", "constructor", "returns", "return", "gets", "sets", "performs", "does", "handles", "implements", "calls", "used", "called", "simple", "new", "given", "will", "die", "der", "das", "den", "el", "la", "los", "las", "le", "les", "un", "une", "una", "eine", "einen"}


def _stems(words: list[str]) -> set[str]:
    """Forms a word may have beside its own: without plural, third person, gerund or past endings."""
    out = set()
    for w in words:
        w = w.lower()
        out.add(w)
        for end in ("ies", "es", "s", "ing", "ed", "er", "d"):
            if w.endswith(end) and len(w) - len(end) >= 2:
                root = w[: -len(end)]
                out |= {root, root + "e"}
                if end == "ies":
                    out.add(root + "y")
                if len(root) > 2 and root[-1] == root[-2]:
                    out.add(root[:-1])
    return out


def _only_name(sentence: str, name: str) -> bool:
    """Whether a sentence holds nothing but the name, its words and filling words."""
    words = [w for part in re.findall(r"[^\W_]+", sentence) for w in _WORD.findall(part)]
    own = [w for part in re.findall(r"[^\W_]+", name) for w in _WORD.findall(part)]
    base = _stems(own)
    return bool(words) and all(w.lower() in _GLUE or w.lower() in base or _stems([w]) & base for w in words)


def clean_comment(text: str) -> list[str]:
    """The lines of a comment without its markers."""
    out = []
    for line in text.replace("\r", "").split("\n"):
        line = _CLOSE.sub("", line.strip())
        line = _OPEN.sub("", line, count=1)
        out.append(_TAG.sub("", _CLOSE.sub("", line)).strip())
    return out


def described(text: str | None, name: str) -> str:
    """What of a comment describes the function; the empty string if nothing does."""
    kept: list[str] = []
    in_args = False
    for line in clean_comment(text or ""):
        bare = line.strip(" \t\"'*-=_#~/.:!")
        if not line or not _LETTERS.search(line) or re.match(r"^([=\-*#~_+])\1{2,}.*\1{2,}$", line):
            continue
        if _SECTION.match(line):
            in_args = True
            continue
        if _NOTICE.search(line) or _LINT.match(line) or _POINTER.match(line) or _EMPTY.match(bare) or _EMPTY.match(line.rstrip(" .!。")):
            continue
        for pattern in (_PARAM, _RETURN):
            if m := pattern.match(line):
                rest = m[1].strip()
                line = "" if _TYPE_ONLY.match(rest) or _EMPTY.match(rest.strip(" .")) else rest
                break
        else:
            if m := _TODO.match(line):
                line = line[m.end() :]
                if _EMPTY.match(line.strip(" .!")):
                    continue
            elif in_args and (m := _ARG_LINE.match(line)):
                line = "" if _TYPE_ONLY.match(m[1].strip()) else m[1]
            elif _CODE.search(line):
                continue
            elif line.startswith("@"):
                line = re.sub(r"^@\w+\s*", "", line)
        parts = [s for s in re.split(r"(?<=[.!?。])\s+", line) if s and not _only_name(s, name) and not _EMPTY.match(s.strip(" .!。")) and not _POINTER.match(s)]
        kept += [s for s in parts if len(re.findall(r"\w+", s)) >= 2 or len(re.findall(r"[^\W\d_a-zA-Z]", s)) >= 4 or re.match(r"^[A-Z][a-z]{4,}\.?$", s)]
    return "\n".join(kept)


def signature_line(lines: list[str], name: str) -> int:
    """The line of the signature: the first one outside comments where the name stands before parameters or after a keyword of definitions; else where the name first stands; else the first line of code."""
    word = re.escape(name)
    strict = re.compile(rf"(?:\b(?:def|func|fn|function|sub|proc|procedure|fun)\b.*?[\s.*:]{word}\b|(?<![\w.]){word}\s*(?:<[^()]*>)?\s*\(|\b(?:const|let|var)\s+{word}\s*[:=]|::{word}\s*\(|[\w\"`\]]\.[\"`\[]?{word}\b)", re.I if name.islower() else 0)
    block, seen, code = False, -1, -1
    for i, line in enumerate(lines):
        text = line.strip()
        if block:
            block = "*/" not in text
            continue
        if text.startswith("/*"):
            block = "*/" not in text
            continue
        if not text or _LINE_COMMENT.match(line) or _DECORATOR.match(line):
            continue
        if strict.search(line):
            return i
        if code < 0:
            code = i
        if seen < 0 and re.search(rf"(?<!\w){word}(?!\w)", line):
            seen = i
    return seen if seen >= 0 else code


def comments_above(lines: list[str], at: int) -> str:
    """The comment lines that end at most ``MAX_GAP`` lines above the signature; decorators between do not count."""
    i = at - 1
    while i >= 0 and _DECORATOR.match(lines[i]):
        i -= 1
    gap = 0
    while i >= 0 and not lines[i].strip() and gap < MAX_GAP:
        i, gap = i - 1, gap + 1
    last = i
    while i >= 0:
        text = lines[i].strip()
        if text.endswith("*/") or text.endswith("-->"):
            start = "/*" if text.endswith("*/") else "<!--"
            while i >= 0 and start not in lines[i]:
                i -= 1
            if i < 0 or not lines[i].strip().startswith(start):
                break
        elif not _LINE_COMMENT.match(lines[i]):
            break
        i -= 1
    return "\n".join(lines[max(i, -1) + 1 : last + 1])


def body_end(text: str, start: int, language: str) -> int:
    """Offset of the end of the function that begins at ``start``: a stack of indentation, of begin/end keywords or of braces is empty again."""
    if language == "python":
        head = re.compile(r"[^\n]*").match(text, start)[0]
        margin = len(head) - len(head.lstrip())
        end, depth = len(text), 0
        pos = start
        for line in text[start:].split("\n"):
            bare = line.strip()
            if pos > start and bare and depth <= 0 and len(line) - len(line.lstrip()) <= margin and not bare.startswith((")", "#", "]", "}")):
                end = pos
                break
            if pos == start or depth > 0:
                depth += line.count("(") + line.count("[") - line.count(")") - line.count("]")
            pos += len(line) + 1
        return end
    if language == "sql":
        depth, quote = 0, None
        for m in _BLOCKS.finditer(text, start):
            if m[3]:
                if quote == m[3]:
                    return m.end()
                quote = quote or m[3]
            elif m[1]:
                depth += 1
            elif m[2]:
                depth -= 1
                if depth <= 0 and not quote:
                    return m.end()
        return len(text)
    depth = 0
    for m in _SKIP.finditer(text, start):
        if m[1] == "{":
            depth += 1
        elif m[1] == "}":
            depth -= 1
            if depth <= 0:
                return m.end()
    return len(text)


def pair(content: str, name: str, language: str, doc_comment: str | None) -> tuple[str, str, int, int] | None:
    """``description, code, first line, last line`` (from 0) of a documented function, else None."""
    text = content.replace("\r\n", "\n")
    lines = text.split("\n")
    at = signature_line(lines, name)
    found = [described(doc_comment, name)]
    start = 0
    if at >= 0:
        found.append(described(comments_above(lines, at), name))
        start = sum(len(x) + 1 for x in lines[:at])
        if language == "python" or re.match(r"\s*(?:async\s+)?def\s", lines[at]):
            opened = re.compile(r"(?:[^()]|\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))*?:[^\S\n]*(?:#[^\n]*)?\n(?:[^\S\n]*(?:#[^\n]*)?\n)*").match(text, start)
            if opened and (m := _DOCSTRING.match(text, opened.end())):
                found.append(described(m[2], name))
    best = max(found, key=len)
    if not best:
        return None
    end = body_end(text, start, language or "")
    return best, text[start:end].rstrip(), max(at, 0), text.count("\n", 0, max(end - 1, 0))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["chunk_id", "symbol_name", "description", "code", "first_line", "last_line"]
    for b in batches:
        rows = []
        for key, name, content, doc, language in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if p := pair(content or "", name, language, doc):
                rows.append((key, name, *p))
        cols = [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in names]
        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)


def function_doc_pairs(chunks: DataFrame) -> DataFrame:
    """``chunk_id, symbol_name, description, code, first_line, last_line`` of each documented function or method.

    ``first_line`` and ``last_line`` count the function's lines within ``content`` from 0.
    Rows of other types, without a name or without documentation that says anything
    give none; a null content is an empty one. A repeated ``chunk_id`` gives a pair
    each time; ``distinct_pairs`` counts it once. Other columns are ignored.
    """
    wanted = chunks.filter(F.col("chunk_type").isin("function", "method") & F.col("symbol_name").isNotNull())
    rows = wanted.select(F.col("chunk_id").cast("long"), "symbol_name", "content", "doc_comment", F.lower(F.coalesce("language", F.lit(""))).alias("language"))
    schema = "chunk_id long, symbol_name string, description string, code string, first_line int, last_line int"
    return rows.mapInArrow(_pairs, schema)


def distinct_pairs(pairs: DataFrame) -> DataFrame:
    """One pair a chunk: the greatest one by its columns in their order."""
    others = [c for c in pairs.columns if c != "chunk_id"]
    return pairs.groupBy("chunk_id").agg(F.max(F.struct(*others)).alias("p")).select("chunk_id", "p.*")
