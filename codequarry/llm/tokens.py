"""Encoding a corpus with a public tokenizer through a distinct-word table (problem 8).

Spark splits the texts into words by the tokenizer's own pattern, and each distinct
word of the corpus is encoded once. The ids come back by batches of documents: a
batch asks for each of its distinct words once, however often it occurs there, joins
the word table on the word, and puts the ids of its documents together by position.
A frequent word is thus a row a batch, not a row an occurrence.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the vocabulary files lie, unless a call says otherwise.
TOKENIZERS = os.environ.get("CODEQUARRY_TOKENIZERS", "/opt/tokenizers")
#: The published pre-tokenization pattern of the byte-level vocabularies (fixed value).
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a batch of documents; a small corpus is cut finer, but into no less than ``LEAST_CHARS`` each.
BATCH_CHARS, LEAST_CHARS = 1 << 24, 1 << 20
#: Ids that occur more than once are sent to all tasks up to this number; more of them are joined by a shuffle.
MOST_SENT = 100_000


@lru_cache(maxsize=4)
def encoding(path: str):
    """The tokenizer of a rank file, once a process."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})


def rank_file(vocabulary: str, folder: str | None = None) -> str:
    return f"{folder or TOKENIZERS}/{vocabulary}.tiktoken"


def _split(text: Column) -> Column:
    """The words of a text: ``(?U)`` gives white space its Unicode meaning, as the tokenizer's pattern has it."""
    return F.regexp_extract_all(text, F.lit("(?U)" + WORD_PATTERN), F.lit(0))


def word_table(words: DataFrame, vocabulary: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """``word, parts, ids`` of each distinct ``word``: the parts it occurs in (of rows ``word, part``, each pair once), and its token ids."""
    path = rank_file(vocabulary, folder)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for b in batches:
            ids = pa.array([enc.encode_ordinary(w) for w in b.column("word").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("parts"), ids], ["word", "parts", "ids"])

    each = words.groupBy("word").agg(F.collect_list("part").alias("parts"))
    return each.mapInArrow(encode, "word string, parts array<int>, ids array<int>")


def once(rows: DataFrame) -> DataFrame:
    """``rows`` with each ``id`` once: the greatest one by its other columns in their order. Only rows of ids that occur again are shuffled for it."""
    from codequarry.session import staged

    again = staged(rows.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("id").alias("_again")), "again")
    many = again.count()
    if not many:
        return rows
    side = F.broadcast(again) if many <= MOST_SENT else again
    same, others = F.col("id").eqNullSafe(F.col("_again")), [c for c in rows.columns if c != "id"]
    greatest = rows.join(side, same, "left_semi").groupBy("id").agg(F.max(F.struct(*others)).alias("_x"))
    return rows.join(side, same, "left_anti").unionByName(greatest.select("id", "_x.*"))


def _packed_lengths(words: Column) -> Column:
    """The lengths of words as characters below 128: as often 127 as it fits into a length, then the rest."""
    one = lambda w: F.concat(F.repeat(F.char(F.lit(127)), F.floor(F.length(w) / 127).cast("int")), F.char(F.length(w) % 127))
    return F.array_join(F.transform(words, one), "")


def _lengths(packed: str) -> list[int]:
    codes = np.frombuffer(packed.encode(), np.uint8)
    ends = np.flatnonzero(codes < 127)
    return np.diff(np.cumsum(codes, dtype=np.int64)[ends], prepend=0).tolist()


def _assemble(counts: bool):
    """Grouped Arrow function over a batch: its documents with the lengths of their words, and the ids of its distinct words."""

    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        ids = words["ids"].combine_chunks() if words.num_rows else pa.array([], pa.list_(pa.int32()))
        place = {w: i for i, w in enumerate(words["word"].to_pylist())}
        sizes = np.asarray(pa.compute.list_value_length(ids), np.int64)
        flat, starts = np.asarray(ids.flatten(), np.int32), np.cumsum(sizes) - sizes
        found, at_doc = [], [0]
        for text, lengths in zip(docs["text"].to_pylist(), docs["lengths"].to_pylist(), strict=True):
            at = 0
            for n in _lengths(lengths) if lengths else ():
                found.append(place[text[at : at + n]])
                at += n
            at_doc.append(len(found))
        rows = np.array(found, np.int64)
        # The ids of all words in a row: each word's run of ids, one after the other.
        per = sizes[rows]
        ends = np.r_[0, np.cumsum(per)]
        at_doc = ends[np.array(at_doc)]
        if counts:
            return pa.table({"id": docs["id"], "tokens": pa.array(np.diff(at_doc))})
        every = np.repeat(starts[rows] - ends[:-1], per) + np.arange(ends[-1]) if len(rows) else np.empty(0, np.int64)
        return pa.table({"id": docs["id"], "ids": pa.ListArray.from_arrays(pa.array(at_doc.astype(np.int32)), pa.array(flat[every], pa.int32()))})

    return run


def _encoded(docs: DataFrame, vocabulary: str, folder: str | None, counts: bool) -> DataFrame:
    """Of ``id, text``, each id once."""
    size = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).head()["n"]
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    batches = max(1, -(-size // BATCH_CHARS), min(tasks, size // LEAST_CHARS))
    docs = docs.withColumn("batch", F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int"))
    asked = docs.select(F.col("batch").alias("part"), F.explode(F.array_distinct(_split(F.col("text")))).alias("word")).distinct()
    known = word_table(asked, vocabulary, folder).select("word", "ids", F.explode("parts").alias("part"))
    own = docs.select("batch", "id", "text", _packed_lengths(_split(F.col("text"))).alias("lengths"))
    schema = "id long, tokens long" if counts else "id long, ids array<int>"
    return own.groupBy("batch").cogroup(known.groupBy("part")).applyInArrow(_assemble(counts), schema)


def encode_corpus(
    texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k", folder: str | None = None
) -> DataFrame:
    """``id_col, ids``: the token ids of each text, without special tokens.

    Null and empty texts have an empty list. Rows that repeat an id count once (the
    greatest text). A null id is an id of its own. Other columns are ignored.
    """
    docs = once(texts.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))
    return _encoded(docs, vocabulary, folder, False).withColumnRenamed("id", id_col)


def token_counts(
    texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k", folder: str | None = None, distinct: bool = False
) -> DataFrame:
    """``id_col, tokens``: the number of tokens of each text; 0 for null and empty ones. Ids count once, as in ``encode_corpus``; ``distinct``: they are known to occur once."""
    docs = texts.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return _encoded(docs if distinct else once(docs), vocabulary, folder, True).withColumnRenamed("id", id_col)


def piece_table(spark: SparkSession, vocabulary: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """``id, piece``: the bytes of each token id; as many rows as the vocabulary has."""
    lines = spark.read.text(f"file://{rank_file(vocabulary, folder)}")
    parts = F.split("value", " ")
    return lines.select(parts[1].cast("int").alias("id"), F.unbase64(parts[0]).alias("piece"))


def decode_corpus(encoded: DataFrame, id_col: str = "doc_id", vocabulary: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """``id_col, text`` of encoded texts: ids are exploded, joined with the piece table (bounded by the vocabulary) and put together by position.

    An empty or null list gives the empty text.
    """
    pieces = F.broadcast(piece_table(encoded.sparkSession, vocabulary, folder))
    spread = encoded.select(F.col(id_col).alias("doc"), F.posexplode_outer("ids").alias("pos", "id")).join(pieces, "id", "left")
    ordered = spread.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("pos", F.hex("piece").alias("x")))).alias("parts"))
    text = F.decode(F.unhex(F.array_join(F.transform("parts", lambda p: p["x"]), "")), "UTF-8")
    return ordered.select(F.col("doc").alias(id_col), text.alias("text"))
