"""Files that nobody on the project wrote by hand (problem 2).

A file is vendored, generated, minified or a data blob.

Vendored copies are found by winnowing: token streams are normalized (names of
projects, numbers and strings become one token each), k-grams are hashed, and the
smallest hash of each window is kept. A fingerprint is widespread if it comes from
many unrelated owners. There are two kinds of streams. Of code, the owner is the
repository of the path (one project's tree is one, each library in it another); a file most of whose fingerprints are widespread is a copy.
Of notices, that is comment lines before the first or after the last code that name a
project with a version or a year, the owner is the project named: what copies of many
projects say alike is a copy's notice, while the own licence header, in however many
files, names one project only. No list of phrases takes part in it.

Other evidence is in the path, in generators' remarks, and in the shape of the text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.session import staged

#: Tokens of a k-gram, and k-grams of a window of which one hash is kept, in code and in notices (which are short, so all are kept).
GRAM, WINDOW = 12, 32
NOTICE_GRAM, NOTICE_WINDOW = 4, 1
#: A fingerprint is widespread from so many owners on; a file is a copy if it has at least so many fingerprints of code and this share of them, or of those of one of its notices, is widespread.
OWNERS, FINGERPRINTS, SHARE = 8, 8, 0.8
#: Owners of a fingerprint are counted in a bitmap of so many bits, which tells at least how many there are.
OWNER_BITS = 64
#: Widespread fingerprints are sent to all tasks up to this number; more of them are joined by a shuffle, hot ones cut in so many parts.
MOST_SENT, SALTS = 100_000, 16
#: Characters of data, and their share of a chunk, that make a blob.
BLOB_CHARS, BLOB_SHARE = 1_500, 0.5
# Folders and names that tools give to their output, and folders that hold other projects.
PATHS = {
    "generated": r"(?i)(?:^|/)(?:generated|__generated__|autogen|auto_generated|gen|\.gen|gensrc|generated[-_]sources?)/|\.(?:pb|gen|g|generated|designer|grpc|auto)\.[a-z]+$|[_-](?:generated|pb2(?:_grpc)?|gen)\.[a-z]+$|\.pb\.[a-z]+\.[a-z]+$",
    "minified": r"(?i)\.min\.[a-z]+$|[-_.]min\.(?:js|css|mjs)$|[.\-][0-9a-f]{8,32}\.(?:js|mjs|cjs|ts|css|jsx|tsx)$|\.(?:bundle|chunk)\.(?:js|ts|css)$|(?:^|/)dist/",
    "vendored": r"(?i)(?:^|/)(?:vendor|node_modules|bower_components|third[_-]?party|external|externals|extern|deps|site-packages|pods|carthage|godeps|jspm_packages)/",
}

_COMMENT = re.compile(r"^\s*(?:///?!?|/\*+!?|\*+/?|#+!?(?!\s*(?:define|include|pragma|if|ifdef|ifndef|endif|else|undef)\b)(?!\[)|--+|<!--|;+|%+|\"\"\"|''')")
_GENERATED = re.compile(
    r"\b(?:code|file|source) (?:auto-?)?generated by\b|^@generated\b|<auto-?generated|^(?:auto-?)?generated (?:by|from|with|using)\b|^auto-?generated (?:file|code|from|by)\b|\bthis (?:file|code|source|module) (?:is|was|has been) (?:auto(?:matically)?[- ]?)?(?:built|generated|produced|created|written) (?:automatically|by|from)|"
    r"\bthis (?:file|code) (?:is|was) auto-?generated|\bproduced by a tool\b|^machine[- ](?:written|generated|made)\b|\bis an? [\w-]+ artifact\b|\bhand edits (?:get|will be|are)\b|\b(?:do not|don't) (?:edit|modify|change)\b.{0,40}\b(?:generated|by hand|manually)|\bgenerated\b.{0,60}\bdo not (?:edit|modify|change|touch)|"
    r"\bchanges (?:will be|are|get) (?:lost|overwritten)|automatisch (?:erzeugt|generiert|erstellt)|nicht von hand ändern|autogenerad[oa]\b|generad[oa] autom[aá]ticamente|généré automatiquement|gerado automaticamente|자동\s*생성된?\s*(?:파일|코드)|自動生成(?:された|ファイル|コード)|自动生成|автоматически (?:сгенерирован|создан)|сгенерирован автоматически",
    re.I,
)
_NOT_GENERATED = re.compile(r"used to be|no longer|kept by hand|written by hand|hand-?written|maintained by hand|never edit generated|generated files by hand|files? that (?:are|were)|method stub|\bskip\b|\bignore\b|instead of|unlike|\bnot (?:auto-?)?generated|\bif generated", re.I)
_NUMBERS = r"(?:(?:0x[0-9A-Fa-f]+|-?\d+(?:\.\d+)?(?:e-?\d+)?f?)\s*,\s*){8,}"
_STRINGS = r"(?:[\"'][A-Za-z0-9+/=_\-]{32,}[\"']\s*\)?\s*[,;]?\s*\(?\s*){3,}"
_RECORDS = r"(?:^[ \t]*[\[{(][^\n]{10,400}[\]})][,;]?[ \t]*\r?\n?){8,}"
_DATA = re.compile(f"{_NUMBERS}|{_STRINGS}|{_RECORDS}", re.M)
_VERSION = r"v?\d+(?:\.\d+)+[\w.\-]*"
_YEARS = r"(?:19|20)\d\d(?:\s*[-–,]\s*(?:(?:19|20)\d\d|present))*"
# A project with a version, or with the years of its rights.
_ATTRIBUTION = re.compile(rf"(?P<name>[A-Z][\w+\-]*\w)[ ,]*[ @]\s*{_VERSION}|(?P<package>[\w./\-]+)@{_VERSION}|(?:©|\([cC]\)|\b[Cc]opyright\b|\bCOPYRIGHT\b)[\s:,]*(?:©|\([cC]\))?\s*{_YEARS},?\s+(?:by\s+|the\s+)*(?P<holder>[A-Z]\w+)")
_NUMBER = re.compile(r"\bv?\d[\w.\-]*|\b[0-9a-f]*\d[0-9a-f]*\b")
_DIGIT = re.compile(r"\d")
_LEXEME = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|\d[\w.]*|[A-Za-z_]\w*|[^\w\s]")


def header(text: str) -> list[str]:
    """The comment lines before the first code, without their marks."""
    out, block = [], False
    for line in text.split("\n"):
        bare = line.strip()
        if not bare:
            continue
        if not block and not _COMMENT.match(line):
            break
        out.append(re.sub(r"\*+/\s*$|-->\s*$", "", _COMMENT.sub("", line)).strip())
        if bare.startswith("/*"):
            block = True
        if "*/" in bare:
            block = False
    return out


def footer(text: str) -> list[str]:
    """The comment lines after the last code, without their marks."""
    out = []
    for line in reversed(text.rstrip().split("\n")):
        if line.strip() and not _COMMENT.match(line):
            break
        out.append(re.sub(r"\*+/\s*$|-->\s*$", "", _COMMENT.sub("", line)).strip())
    return out


def text_evidence(text: str, remarks: list[str]) -> list[str]:
    """``generated``, ``minified`` and ``data``, as far as the content of a chunk and its remarks (header and footer) show them."""
    found = set()
    for line in remarks:
        if _GENERATED.search(line) and not _NOT_GENERATED.search(line):
            found.add("generated")
    if len(text) > 250:
        for line in text.split("\n") if "\n" in text else (text,):
            if len(line) >= 280:
                marks = sum(map(line.count, "(){};="))
                spaces = line.count(" ") + line.count("\t")
                if marks > 0.1 * len(line) and spaces < 0.05 * len(line):
                    found.add("minified")
                    break
        if len(text) >= BLOB_CHARS:
            data = sum(m.end() - m.start() for m in _DATA.finditer(text))
            if data >= BLOB_CHARS and data > BLOB_SHARE * len(text):
                found.add("data")
    return sorted(found)


def winnowed(tokens: list[bytes], gram: int, window: int, seed: int = 0, words: np.ndarray | None = None) -> np.ndarray:
    """The winnowed hashes of the k-grams of a token stream; one shorter than a k-gram has none. With ``words``, k-grams of which less than a quarter is words are left out: numbers and strings say nothing of their origin."""
    import zlib

    n = len(tokens) - gram + 1
    if n < 1:
        return np.empty(0, np.int64)
    hashes = np.array([zlib.crc32(t, seed) for t in tokens], np.uint64)
    grams = np.zeros(n, np.uint64)
    for i in range(gram):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n]
    grams ^= grams >> np.uint64(29)
    grams = grams * np.uint64(0xBF58476D1CE4E5B9)
    grams ^= grams >> np.uint64(32)
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    if words is not None:
        sums = np.cumsum(np.r_[0, words])
        grams[sums[gram:] - sums[:-gram] < gram // 4] = none
    grams = np.lib.stride_tricks.sliding_window_view(grams, min(window, n)).min(1)
    kept = np.unique(grams)
    return kept[kept != none].view(np.int64)


def fingerprints(text: str) -> np.ndarray:
    """The winnowed fingerprints of the code."""
    kinds = {'"': b"S", "'": b"S"}
    found = _LEXEME.findall(text)
    tokens = [kinds.get(t[0]) or (b"N" if t[0].isdigit() else t.encode("utf-8", "surrogatepass")) for t in found]
    return winnowed(tokens, GRAM, WINDOW, 0, np.array([t[0].isalpha() or t[0] == "_" for t in found], bool))


def notices(remarks: list[str]) -> list[tuple[str, str, np.ndarray]]:
    """``line, project, fingerprints`` of the remarks that name a project with a version or a year; in the normalized line the names are one token."""
    out = []
    for line in remarks:
        if not _DIGIT.search(line):
            continue
        names = {n for m in _ATTRIBUTION.finditer(line) for n in m.groups() if n}
        if not names:
            continue
        plain = line
        for n in sorted(names, key=len, reverse=True):
            plain = re.sub(re.escape(n), "\0", plain, flags=re.I)
        plain = " ".join(re.findall(r"\0|\w+|[^\w\s]", _NUMBER.sub("0", plain).lower()))
        # Marks of its ends, so that the first and last words weigh as much as the others.
        ends = [b"\n"] * (NOTICE_GRAM - 1)
        prints = winnowed([*ends, *(t.encode() for t in plain.split()), *ends], NOTICE_GRAM, NOTICE_WINDOW, 1)
        out += [(plain, n.lower(), prints) for n in names]
    return out


_SEEN = "file_path string, evidence array<string>, prints array<long>, notices array<struct<line: long, size: int, owner: long, prints: array<long>>>"


def _inspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    def number(x: str) -> int:
        return int(np.uint64(xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass"))).view(np.int64))

    notice = pa.list_(pa.struct([("line", pa.int64()), ("size", pa.int32()), ("owner", pa.int64()), ("prints", pa.list_(pa.int64()))]))
    for b in batches:
        evidence, prints, told = [], [], []
        for text in b.column("content").to_pylist():
            text = text or ""
            remarks = header(text) + footer(text)
            evidence.append(text_evidence(text, remarks))
            prints.append(fingerprints(text))
            told.append([{"line": number(line), "size": len(p), "owner": number(owner), "prints": p.tolist()} for line, owner, p in notices(remarks)])
        sizes = np.cumsum([0, *map(len, prints)]).astype(np.int32)
        flat = np.concatenate([*prints, np.empty(0, np.int64)])
        yield pa.RecordBatch.from_arrays(
            [b.column("file_path"), pa.array(evidence, pa.list_(pa.string())), pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat, pa.int64())), pa.array(told, notice)],
            ["file_path", "evidence", "prints", "notices"],
        )


def repository(path: Column) -> Column:
    """The repository that a path of one project's tree belongs to: of a library folder the library, else the project itself. Packages of a project are not unrelated, however often code recurs in them."""
    return F.regexp_extract(path, r"(?i)(?:^|/)(?:vendor|node_modules|bower_components|third[_-]?party|external|deps|site-packages)/([^/]+)/", 1)


def _widespread(prints: DataFrame) -> DataFrame:
    """The fingerprints of ``print, owner`` that have at least ``OWNERS`` owners. Owners become one bit each before the shuffle, so a hot fingerprint is one row a task."""
    bit = F.expr(f"shiftleft(1L, cast(pmod(owner, {OWNER_BITS}) as int))")
    return prints.groupBy("print").agg(F.bit_or(bit).alias("owners")).filter(F.bit_count("owners") >= OWNERS).select("print")


def _marked(rows: DataFrame, wide: DataFrame, many: int) -> DataFrame:
    """The rows whose ``print`` is widespread."""
    if many <= MOST_SENT:
        return rows.join(F.broadcast(wide), "print", "left_semi")
    salted = wide.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("file_path", F.lit(7)), F.lit(SALTS)).cast("int")).join(salted, ["print", "salt"], "left_semi").drop("salt")


def copied_files(seen: DataFrame, owner: Callable[[Column], Column] = repository) -> DataFrame:
    """``file_path, widespread, rule`` of the files that are copies by their fingerprints: ``code`` or ``notice``, and the share of fingerprints that is widespread."""
    code = seen.select("file_path", F.xxhash64(owner(F.col("file_path"))).alias("owner"), F.explode("prints").alias("print"))
    told = seen.select("file_path", F.explode("notices").alias("n")).select("file_path", "n.line", "n.size", "n.owner", F.explode("n.prints").alias("print"))
    wide = staged(_widespread(code.select("print", "owner").unionByName(told.select("print", "owner"))), "widespread")
    many = wide.count()
    shared = _marked(code.select("file_path", "print"), wide, many).groupBy("file_path").agg(F.count("*").alias("wide"))
    sizes = seen.filter(F.size("prints") > 0).groupBy("file_path").agg(F.sum(F.size("prints")).alias("all"))
    by_code = sizes.filter(F.col("all") >= FINGERPRINTS).join(shared, "file_path").select("file_path", (F.col("wide") / F.col("all")).alias("widespread"), F.lit("code").alias("rule"))
    lines = _marked(told.dropDuplicates(["file_path", "line", "print"]), wide, many).groupBy("file_path", "line", "size").agg(F.count("*").alias("wide"))
    by_notice = lines.groupBy("file_path").agg(F.max(F.col("wide") / F.col("size")).alias("widespread")).withColumn("rule", F.lit("notice"))
    return by_code.unionByName(by_notice).filter(F.col("widespread") >= SHARE)


def file_evidence(chunks: DataFrame, by_path: bool = True, owner: Callable[[Column], Column] = repository) -> DataFrame:
    """``file_path, reasons, rules``: every file with evidence, why, and the rules that found it: ``code`` and ``notice`` (fingerprints), ``text`` and ``path``.

    Null paths are left out; a null content holds no evidence. Repeated rows change
    nothing. Other columns are ignored. Without ``by_path`` only contents count.
    ``owner`` gives the repository of a path; a collection of many repositories passes
    its own.
    """
    rows = chunks.select("file_path", "content").filter(F.col("file_path").isNotNull())
    # Read several times below; the inspection of the texts is by far the dearest step.
    seen = staged(rows.mapInArrow(_inspect, _SEEN), "inspected")
    reason = lambda r, rule: F.struct(r.alias("reason"), F.lit(rule).alias("rule"))
    told = F.transform("evidence", lambda e: reason(e, "text"))
    if by_path:
        told = F.concat(told, F.array_compact(F.array(*(F.when(F.col("file_path").rlike(p), reason(F.lit(r), "path")) for r, p in PATHS.items()))))
    found = seen.select("file_path", F.explode(told).alias("r")).select("file_path", "r.*")
    found = found.unionByName(copied_files(seen, owner).select("file_path", F.lit("vendored").alias("reason"), "rule"))
    return found.groupBy("file_path").agg(F.sort_array(F.collect_set("reason")).alias("reasons"), F.sort_array(F.collect_set("rule")).alias("rules"))
