"""Hashes and keys of chunks, files and queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def source_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def git_blob_sha(content: Column) -> Column:
    """The object id git gives to a file's bytes."""
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string")), "UTF-8"), F.unhex(F.lit("00")), content))


def signature_hash(parts: Column) -> Column:
    """A hash of signature parts that white space and the order of the parts do not change; empty parts are dropped."""
    tight = F.transform(parts, lambda p: F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(p, F.lit("")), r"\s+", " "), r" ?([(){}\[\],:;<>]) ?", "$1")))
    return F.sha2(F.array_join(F.array_sort(F.filter(tight, lambda p: p != "")), "\n"), 256)


def chunk_signature(chunk_type: Column, receiver: Column, symbol: Column, signature: Column) -> Column:
    """The signature hash of a chunk; its content does not count."""
    return signature_hash(F.array(chunk_type, receiver, symbol, signature))


def chunk_key(chunk_type: Column, symbol: Column, start_line: Column) -> Column:
    return F.concat_ws(":", chunk_type, F.coalesce(symbol, F.lit("")), start_line.cast("string"))


def query_key(mode: Column, query: Column, scope: Column, limit: Column) -> Column:
    """The key of the exact cache: a hash of the query with its mode, scope (null and "all" differ) and limit."""
    parts = F.struct(F.concat_ws("::", mode, query).alias("q"), F.coalesce(scope, F.lit("\u0000all")).alias("s"), F.coalesce(limit, F.lit(10)).alias("l"))
    return F.sha2(F.to_json(parts), 256)


def embedding_text(signature: Column, doc: Column, content: Column) -> Column:
    """What is embedded of a chunk: signature, documentation and content, as far as there are any, with blank lines between."""
    return F.array_join(F.filter(F.array(signature, doc, content), lambda x: x.isNotNull() & (x != "")), "\n\n")


def commented_text(signature: Column, doc: Column, content: Column) -> Column:
    """A chunk as one text with its documentation as a comment: signature and ``// `` documentation, as far as there are any, and the content."""
    remark = F.when(doc != "", F.concat(F.lit("// "), doc))
    return F.concat_ws("\n", F.when(signature != "", signature), remark, F.coalesce(content, F.lit("")))
