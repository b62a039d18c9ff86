"""Credentials written out as literals, found and blanked (problem 7).

Candidates are all string literals (those joined to one together), values in
addresses, headers and flags, key blocks, and the words of comments. Each is scored
by its characters per subword of a public tokenizer: chance strings take about two
characters a subword, names and phrases twice as many. The context, that is the name
or the words before a candidate, sets the limit that the score must stay below;
without a context that asks for a secret only strings of a known format are looked
at. Placeholders, references and patterns are turned away. Blanking keeps every
offset, line break and quote.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.tokens import encoding, rank_file

#: Limits of the score by context: below it a candidate counts as unnatural. ``password``: what a name or an address calls a password may be made of words; ``said``: so may a word of a comment about one, if it holds letters and digits. ``letters``: secrets without digits, whose score says less.
LIMITS = {"password": 4.5, "said": 4.0, "secret": 2.2, "maybe": 2.2, "letters": 1.75, "format": 2.7}
#: A name of 20 characters or more takes at least so many characters a subword; what is less natural is a string, no name.
NAME_SCORE = 1.9
#: What a secret's characters are replaced by.
MASK = "*"

_ASK = r"pass|pwd|secret|token|key|auth|cred|jwt|pem|session|bearer|cookie|signature|dsn|conn|비밀|암호|contrase|clave|senha|mot de passe|密码|密钥|口令|パスワード|пароль|kennwort"
_LITERAL = r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`"
_STRINGS = re.compile(_LITERAL)
# What stands before a literal, matched from its end: a name that may ask for a secret, and what may stand between.
_NAMED = regex.compile(
    rf"(?ri)(?P<name>[\w.\-]*(?:{_ASK})[\w\-\u0300-\u036f]*)[\"'`\])]*\s*(?::\s*&?(?:'static\s+)?[A-Za-z][\w<>\[\], ]*?\s*)?(?:=>|:=|==|=|:|,|\(|\s)\s*(?:[\w.\[\]\"'()]+\s*(?:\|\||\?\?|\bor\b|,)\s*)?(?:[bBrRuUfFLS$@&]{{0,2}}|String::from\(|\()?"
)
_JOINED = re.compile(r"\s*(?:\+|\.|\|\||\\|<<)\s*|\s*\n\s*")
_ASKING = re.compile(_ASK, re.I)
# Comments after code and in blocks; what stands in literals is none.
_REMARK = re.compile(rf"{_LITERAL}|(?P<remark>(?<![^\s;,(){{}}])(?://|#|--)(?=\s)[^\n]*|/\*[\s\S]*?\*/|<!--[\s\S]*?-->)")
# A password among the parts of a connection string.
_PART = re.compile(r"(?:^|[\s;])(?:password|pwd)\s*=\s*(?P<value>'[^']*'|[^;\s\"']+)", re.I)
_NO_PART = re.compile(r"[$%{<(\[:@?]|(?:true|false|yes|no|required|optional)$", re.I)
_COMMENT = re.compile(r"(?m)^[ \t]*(?://|#|--|\*|/\*|<!--|;|\"\"\")[^\n]*|^[ \t]*[\w.\-]{3,60}[ \t]*=[ \t]*[^\s\"'`;(){}\[\]]{6,}[ \t]*\r?$")
_MARKS = ("eyJ", "AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "glpat", "xox", "AIza", "sk-", "npm_", "live_", "live-", "test_", "test-", "pat-", "pat_", "prod_", "prod-")
_PLAIN = re.compile(rf"(?P<name>[\w\-]*(?:{_ASK}|passwort)[\w\-\u0300-\u036f]*)\s*(?:is\s+|[:=]{{1,2}}>?\s*|\s은\s|\s는\s)(?P<value>[^\s\"'`,;(){{}}<>\[\]]{{6,}})", re.I)
_URL = re.compile(r"://(?P<user>[^\s:/@\"'`]*):(?P<value>[^\s/@\"'`]+)@", re.I)
_QUERY = re.compile(r"[?&](?P<name>[\w\-]*(?:token|key|secret|sig|signature|password|pwd|auth|code)[\w\-]*)=(?P<value>[^&\s\"'`#<>]+)", re.I)
_FLAG = re.compile(r"(?:--?(?P<name>[\w\-]*(?:password|passwd|pass|pwd|token|secret|api-?key|auth)[\w\-]*)[= ]\s*|\bcurl\b[^\n\"'`]*?\s(?:-u|--user)[= ]?\s*[^\s:\"'`]+:|\bsshpass\s+-p\s*)(?P<value>[^\s\"'`]+)", re.I)
_HEADER = re.compile(r"\b(?P<name>Basic|Bearer|Token|ApiKey|Digest)\s+(?P<value>[A-Za-z0-9+/_\-.~]{12,}={0,2})")
_BEGIN = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_OPEN = re.compile(r"(?:(?:\\n|[\s\"'`+*/#\-])*[A-Za-z0-9+/=]{40,})+")
# Words of a comment that speak of a password, and the values that follow.
_SPEAKS = re.compile(r"\b(?:log-?in|credentials?|pass(?:word|phrase|code|wd)|pw|pwd|passwor[td]|kennwort|contrase(?:ñ|n\u0303|n)a|clave|senha|mot de passe)\b|пароль|비밀번호|암호|密码|密碼|口令|パスワード", re.I)
_SPOKEN = re.compile(r"(?:\b(?:is|are|ist|lautet|es|est)|[:=/]|[-=]>)\s+[\"'`]?(?P<value>[^\s\"'`,;()<>\[\]{}]{6,})", re.I)
_NO_SPOKEN = re.compile(r"^(?:https?:|[./~]|v?\d+(?:[.:-]\d+)*\w{0,2}$)|[=/\\]|^\w+[.:]\w|^[-\w]+:$|[a-z]\.[a-z]", re.I)
_FORMAT = re.compile(
    r"(?<![A-Za-z0-9_\-/+.])(?P<value>eyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}|(?:AKIA|ASIA)[A-Z0-9]{12,}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{30,}|glpat-[\w\-]{18,}|xox[abprs]-[\w\-]{20,}|AIza[\w\-]{30,}|sk-[A-Za-z0-9_\-]{24,}|npm_[A-Za-z0-9]{30,}|(?:[a-z0-9]{2,6}[_\-])?(?:live|test|pat|prod)[_\-][A-Z0-9]{16,}|[a-z]+_(?:live|test)_[A-Za-z0-9]{16,})(?![A-Za-z0-9_\-/+])"
)
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[^\W\d_A-Z]+|\d+")

#: Name words that ask for a password, for another secret, or for one only if the string is unnatural.
_PASSWORD = {"password", "passwd", "pwd", "pass", "passphrase", "passcode", "passwort", "kennwort", "senha", "clave", "contraseña", "contrasena", "비밀번호", "암호", "密码", "密碼", "口令", "パスワード", "пароль", "userpass", "pw"}
_SECRET = {"secret", "token", "apikey", "credential", "credentials", "jwt", "authorization", "auth", "bearer", "密钥", "signature"}
_KEY_OF = {"api", "access", "secret", "private", "signing", "encryption", "service", "hmac", "master", "auth", "account", "storage", "license", "deploy", "app", "client", "crypto", "aes", "rsa", "ssh", "session", "webhook", "signer", "encrypt", "sign", "shared", "admin", "root", "prod", "stripe", "cookie"}
#: Words of names that stand for something other than the secret itself.
_OTHER = {"field", "name", "names", "pattern", "regex", "regexp", "hint", "label", "message", "msg", "error", "url", "uri", "endpoint", "path", "file", "filename", "dir", "type", "kind", "length", "len", "count", "min", "max", "id", "ids", "header", "prefix", "suffix", "placeholder", "title", "text", "help", "description", "desc", "public", "pub", "trace", "cache", "primary", "partition", "sort", "foreign", "object", "idempotency", "hash", "digest", "checksum", "policy", "expiry", "ttl", "rule", "rules", "format", "column", "param", "parameter", "parameters", "env", "var", "index", "map", "ring", "board", "press", "down", "up", "code", "word", "alphabet", "example", "strength", "i18n", "issuer", "audience", "scope", "scopes", "provider", "algorithm", "alg", "version", "etag", "integrity", "lookup"}
_PLACEHOLDER = re.compile(
    r"^[<\[{(].*[>\])}]$|^(?:\*+|x+|\.+|-+|_+|#+|•+|0+|1234567?8?9?0?)$|\$\{|\{\{|\$\(|^%[sdv]$|%\(\w+\)[sd]|(?<!\w)%[sdv](?!\w)|^\{\w*\}$|\{\w+\}|^\$[A-Z_a-z]\w*$|^%\w+%$|^@\w+@$|<[\w \-]+>|\.\.\.|…|xxxx|\*{3,}|"
    r"^(?:process\.env|os\.environ|env|secrets|vault|ssm|arn|config|ref|file|gcp|aws|azure|op|keyring)[.:/]",
    re.I,
)
_UUID = re.compile(r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", re.I)
_HEX = re.compile(r"^(?:0x)?[0-9a-f]+$", re.I)
_ENCODED = re.compile(r"^(?:data:|sha\d+-|md5-|urn:|https?://(?![^\s/]*:[^\s/]*@)|\^|[./~]|[A-Z]:\\)|[\[\](){}|^$\\].*[+*?{]|\\[dwsb]|\s")
#: Words that stand for a value to come.
_STAND_INS = {"change", "changeme", "me", "this", "replace", "insert", "enter", "put", "your", "my", "the", "here", "example", "sample", "dummy", "fake", "mock", "test", "placeholder", "redacted", "todo", "tbd", "none", "null", "undefined", "empty", "value", "app", "please", "1", "12", "123", "1234", "12345", "123456"}
_SENSITIVE_WORDS = _PASSWORD | _SECRET | {"key", "user", "db", "login", "new", "old", "current", "confirm", "access", "api", "client", "private", "refresh", "id", "csrf", "x", "signing", "smtp", "admin"}


@lru_cache(maxsize=100_000)
def chars_per_subword(text: str, path: str) -> float:
    """The score of a string. Capitals alone count as small letters, which words are mostly written in."""
    text = text.lower() if text.isupper() else text
    return len(text) / max(1, len(encoding(path).encode_ordinary(text)))


def _words(name: str) -> list[str]:
    return [w.lower() for w in _WORDS.findall(unicodedata.normalize("NFC", name))]


def _asks(name: str) -> str:
    """``password``, ``secret`` or ``maybe``, or nothing."""
    words = _words(name)
    if not words or words[-1] in _OTHER or set(words[:-1]) & {"public", "pub", "trace", "cache", "primary", "partition", "foreign", "idempotency", "object", "sort", "max", "min"} or (words[0] in {"is", "has", "no", "wrong", "missing"}):
        return ""
    last = words[-1]
    if last in _PASSWORD or (last == "auth" and len(words) > 1):
        return "password"
    if last == "key" or last == "keys":
        return "secret" if len(words) > 1 and words[-2] in _KEY_OF else "maybe"
    if last in _SECRET or last.rstrip("s") in _SECRET or "".join(words[-2:]) in ("apikey", "apitoken"):
        return "secret"
    return "maybe" if set(words) & (_PASSWORD | _SECRET | {"session", "cookie", "key", "pem", "conn", "dsn", "cred", "creds"}) else ""


def _unnatural(value: str, context: str, path: str) -> bool:
    """Whether the score of a candidate is below the limit of its context."""
    return chars_per_subword(value, path) < LIMITS[context]


def _random(value: str, context: str, path: str) -> bool:
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]"))
    return len(value) >= 12 and kinds >= 2 and _unnatural(value, context, path)


def _is_secret(value: str, ask: str, path: str) -> bool:
    """Whether a literal under a name that asks for a secret is one."""
    if len(value) < 6 or _PLACEHOLDER.search(value) or _UUID.match(value) or _ENCODED.search(value.replace(" ", "")):
        return False
    # Names of secrets; a password's loose limit would let words for a value to come pass, of other secrets the score tells them.
    known = _SENSITIVE_WORDS | _OTHER | _STAND_INS if ask == "password" else _SENSITIVE_WORDS | _OTHER
    if all(w in known for w in _words(value)):
        return False
    # Blanks between words belong to a passphrase if it is unnatural as a whole.
    value = value.replace(" ", "") if (spaced := " " in value) else value
    if ask == "password" and not spaced:
        # A password may be made of words, if they are not plain ones; else it must be as unnatural as other secrets.
        plain = not re.search(r"\d", value) and not re.search(r"[^\w\-./:]", value)
        return _unnatural(value, "secret" if plain else "password", path)
    if _HEX.match(value):
        return ask == "secret" and len(value) >= 24 and bool(re.search(r"\d", value)) and bool(re.search("[a-f]", value, re.I)) and _unnatural(value, ask, path)
    if spaced and (ask == "maybe" or not re.search(r"\d", value)):
        return False
    if ask == "secret" and not spaced:
        return len(value) >= 8 and _unnatural(value, ask if re.search(r"\d", value) else "letters", path)
    return _random(value, "secret" if spaced else ask, path)


def _key_blocks(text: str, path: str) -> list[tuple[int, int]]:
    """The spans of private keys: to their end mark, or, where there is none before the next key, as far as encoded lines go."""
    spans = []
    begins = list(_BEGIN.finditer(text))
    for m, following in zip(begins, [*begins[1:], None], strict=True):
        until = following.start() if following else len(text)
        end = _END.search(text, m.end(), until)
        body = (m.end(), end.start()) if end else _OPEN.match(text, m.end(), until).span() if _OPEN.match(text, m.end(), until) else None
        if body is None:
            continue
        inner = re.sub(r"\\n|[^A-Za-z0-9+/=]", "", text[body[0] : body[1]])
        if len(inner) >= 20 and not _PLACEHOLDER.search(re.sub(r"[^A-Za-z ]", "", text[body[0] : body[0] + 60])) and _unnatural(inner, "secret", path):
            spans.append((m.start(), end.end() if end else body[1]))
    return spans


def find_secrets(text: str, path: str) -> list[tuple[int, int]]:
    """The spans of ``text`` that hold credentials, in order, without overlaps."""
    spans: list[tuple[int, int]] = _key_blocks(text, path) if "PRIVATE KEY" in text else []
    # Literals, those joined to one string together.
    runs: list[list[tuple[int, int]]] = []
    before = []
    last = 0
    for m in _STRINGS.finditer(text):
        s, e = m.span()
        if runs and _JOINED.fullmatch(text, runs[-1][-1][1], s):
            runs[-1].append((s, e))
        elif e - s >= 8:
            runs.append([(s, e)])
            before.append(last)
        last = s
    for parts, since in zip(runs, before, strict=True):
        value = "".join(text[s + 1 : e - 1] for s, e in parts)
        # Other parts make a connection string of it.
        if value.count("=") > 1:
            for start, end in parts:
                for m in _PART.finditer(text[start + 1 : end - 1]):
                    inner = m["value"].strip("'")
                    if len(inner) >= 3 and not _PLACEHOLDER.search(inner) and not _NO_PART.match(inner) and not all(w in _SENSITIVE_WORDS | _STAND_INS for w in _words(inner)) and _unnatural(inner, "password", path):
                        at = start + 1 + m.start("value") + m["value"].startswith("'")
                        spans.append((at, at + len(inner)))
        s = parts[0][0]
        # The name stands on the same line, or on the one before if nothing else does; a literal before this one may be it.
        line = text.rfind("\n", 0, s) + 1
        if line and not text[line:s].strip(" \t("):
            line = text.rfind("\n", 0, line - 1) + 1
        line = max(line, since)
        # Every name that asks holds one of these words.
        named = _ASKING.search(text, line, s) and _NAMED.match(text, line, s)
        # An unnatural name is a literal before this one, not a name.
        if named and (ask := _asks(named["name"])) and (len(named["name"]) < 20 or chars_per_subword(named["name"], path) >= NAME_SCORE) and _is_secret(value, ask, path):
            spans += [(s + 1, e - 1) for s, e in parts]
    if re.search(r"\b(?:basic|bearer|token|apikey|digest) ", text, re.I):
        for m in _HEADER.finditer(text):
            value = m["value"].rstrip("=.")
            if not _PLACEHOLDER.search(value) and _random(value, "secret", path):
                spans.append(m.span("value"))
    for pattern, least, mark in ((_URL, 3, "://"), (_FLAG, 4, "-"), (_QUERY, 12, "=")):
        if mark not in text or (pattern is _FLAG and not re.search(r"--?\w*pass|--?pwd|--?\w*token|--?\w*secret|--api|--auth|curl|sshpass", text)):
            continue
        for m in pattern.finditer(text):
            value = m["value"].rstrip(").,;")
            if len(value) < least or _PLACEHOLDER.search(value) or re.match(r"[$%{<(\[]", value):
                continue
            if not (_random(value, "secret", path) if pattern is _QUERY else _unnatural(value, "password", path)):
                continue
            if all(w in _SENSITIVE_WORDS | _STAND_INS for w in _words(value)) or (pattern is _FLAG and _ENCODED.search(value)):
                continue
            spans.append((m.start("value"), m.start("value") + len(value)))
    asking, speaking = _ASKING.search(text), _SPEAKS.search(text)
    comments = [c.span() for c in _COMMENT.finditer(text)] + [c.span("remark") for c in _REMARK.finditer(text) if c["remark"]] if asking or speaking else []
    for start, end in comments:
        for m in _PLAIN.finditer(text, start, end) if asking else ():
            ask = _asks(m["name"])
            value = m["value"].rstrip(".,;:!")
            # Code in comments reads values from elsewhere.
            if not ask or ask != "password" and re.search(r"\w\.[a-zA-Z_]\w*\.|^\w+\.\w+$", value) or ask == "password" and not re.search(r"\d|[^\w]", value):
                continue
            if _is_secret(value, ask, path):
                spans.append((m.start("value"), m.start("value") + len(value)))
        spoken = speaking and _SPEAKS.search(text, start, end)
        for m in _SPOKEN.finditer(text, spoken.end(), end) if spoken else ():
            value = m["value"].rstrip(".:!?")
            if len(value) >= 6 and re.search(r"\d", value) and re.search(r"[^\W\d_]", value) and not _NO_SPOKEN.search(value) and not _PLACEHOLDER.search(value) and not _UUID.match(value) and not _HEX.match(value) and _unnatural(value, "said", path):
                spans.append((m.start("value"), m.start("value") + len(value)))
    if any(mark in text for mark in _MARKS):
        for m in _FORMAT.finditer(text):
            if not _PLACEHOLDER.search(m["value"]) and _unnatural(m["value"], "format", path):
                spans.append(m.span("value"))
    merged: list[tuple[int, int]] = []
    for s, e in sorted(set(spans)):
        if merged and s < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
        else:
            merged.append((s, e))
    return merged


def redact(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` with the spans blanked; line breaks, the marks of a key block and escaped line breaks stay, so do all offsets."""
    out, at = [], 0
    for s, e in spans:
        kept = re.sub(r"-----(?:BEGIN|END)[^\n]*?-----|\\[nrt]|[\n\r]|(.)", lambda m: MASK if m[1] else m[0], text[s:e])
        out += [text[at:s], kept]
        at = e
    return "".join([*out, text[at:]])


def _starts(text: str, spans: list[tuple[int, int]]) -> list[int]:
    """The lines (from 1) on which credentials start. Parts of a split one on following lines are its continuation."""
    lines, last_end = [], -1
    for s, e in spans:
        joined = last_end >= 0 and re.fullmatch(r"[\"'`]\s*(?:\+|\.|\\|\|\||<<)?\s*[\"'`]", text[last_end:s])
        if not joined:
            lines.append(text.count("\n", 0, s) + 1)
        last_end = e
    return sorted(set(lines))


def _scan(path: str):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lines, texts = [], [], []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if spans := find_secrets(text, path):
                    ids.append(key)
                    lines.append(_starts(text, spans))
                    texts.append(redact(text, spans))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lines, pa.list_(pa.int32())), pa.array(texts, pa.string())], ["chunk_id", "lines", "content"])

    return scan


def redacted_chunks(chunks: DataFrame, vocabulary: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """``chunk_id, lines, content`` of the chunks with credentials: the lines on which one starts, and the content with them blanked.

    The blanked content is as long as the original and has the same line breaks.
    Chunks without credentials, with null or empty content give no row. A repeated
    ``chunk_id`` gives a row each time; ``found_lines`` counts it once. Other columns are ignored.
    """
    rows = chunks.select(F.col("chunk_id").cast("long"), "content").filter(F.length("content") >= 8)
    return rows.mapInArrow(_scan(rank_file(vocabulary, folder)), "chunk_id long, lines array<int>, content string")


def found_lines(redacted: DataFrame) -> DataFrame:
    """``chunk_id, line_no``, each line once."""
    return redacted.select("chunk_id", F.explode("lines").alias("line_no")).distinct()
