"""Source trees: files of a folder, which of them are admitted, and ignore rules."""

from __future__ import annotations

import re
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions.hashing import git_blob_sha
from codequarry.functions.structure import language_of

#: The largest file that is indexed, and the bytes looked at for a zero byte.
MAX_BYTES, PROBE = 1_048_576, 8_192


def read_tree(spark: SparkSession, root: str, pattern: str = "*", max_bytes: int | None = None) -> DataFrame:
    """``file_path, length, content``: the files under a folder, with paths relative to it; symbolic links and hidden files as Spark's file source has them.

    Files of over ``max_bytes`` are left out before their bytes are read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    if max_bytes is not None:
        files = files.filter(F.col("length") <= max_bytes)
    base = "^" + re.escape(root if "://" in root else f"file:{root}").rstrip("/") + "/"
    return files.select(F.regexp_replace(F.regexp_replace("path", "^file:/+", "file:/"), base.replace("file:///", "file:/"), "").alias("file_path"), "length", "content")


def tree_rules(spark: SparkSession, root: str, name: str = ".gitignore") -> list[str]:
    """The lines of the ignore file in the root of a tree; none if there is no such file."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    stream = fs.open(path)
    text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return text.splitlines()


def revision_diff(spark: SparkSession, root: str, since: str) -> DataFrame:
    """``value``: the name-status lines of a git tree since a revision. Raises if git has no answer."""
    told = subprocess.run(["git", "-C", root, "diff", "--name-status", "-M", "--end-of-options", since, "HEAD"], capture_output=True, text=True, check=True)
    return spark.createDataFrame([(line,) for line in told.stdout.splitlines()], "value string")


def snapshot(files: DataFrame) -> DataFrame:
    """``file_path, blob_sha`` of files with their bytes: the hash of what was read."""
    return files.select("file_path", git_blob_sha(F.col("content")).alias("blob_sha"))


def admission(length: Column, content: Column, max_bytes: int = MAX_BYTES) -> Column:
    """``missing``, ``too-large``, ``binary`` (a zero byte among the first 8,192) or ``ok`` of a file's bytes."""
    probe = F.hex(F.substring(content, 1, PROBE))
    # Two hex digits a byte: a zero byte begins at an even place.
    binary = probe.rlike("^(?:..)*?00")
    return F.when(content.isNull(), "missing").when(length > max_bytes, "too-large").when(binary, "binary").otherwise("ok")


def ignore_pattern(rule: str) -> str | None:
    """A regular expression for one line of an ignore file without its negation mark; null for blanks and comments."""
    rule = rule.rstrip("\n").rstrip()
    if not rule or rule.startswith("#"):
        return None
    folder = rule.endswith("/")
    anchored = "/" in rule.rstrip("/")
    rule = rule.strip("/")
    out, i = "", 0
    while i < len(rule):
        c = rule[i]
        if rule.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if rule.startswith("/**", i) and i + 3 == len(rule):
            out, i = out + "/.+", i + 3
            continue
        if rule.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        out += "[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c)
        i += 1
    return f"^{'' if anchored else '(?:.*/)?'}{out}{'/.*' if folder else '(?:/.*)?'}$"


def ignored(path: Column, rules: list[str]) -> Column:
    """Whether ignore rules leave a path out: the last rule that matches decides, ``!`` takes back. Backslashes count as slashes; an empty path is not ignored."""
    clean = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "^(?:\\./|/)+", "")
    verdict = F.lit(False)
    for rule in rules:
        negated = rule.startswith("!")
        pattern = ignore_pattern(rule[1:] if negated else rule)
        if pattern:
            verdict = F.when(clean.rlike(pattern), F.lit(not negated)).otherwise(verdict)
    return F.when(F.coalesce(clean, F.lit("")) == "", False).otherwise(verdict)


def eligible(files: DataFrame, rules: list[str], languages: list[str]) -> DataFrame:
    """Files that are not ignored and whose language is known and enabled, with their ``language``."""
    return files.withColumn("language", language_of(F.col("file_path"))).filter(F.col("language").isin(languages) & ~ignored(F.col("file_path"), rules))
