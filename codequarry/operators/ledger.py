"""Change detection and table upkeep: ledger, upserts, renames, removals and chunk-level reuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.functions.hashing import chunk_key, chunk_signature

ENTRIES = "array<struct<key: string, sig: string>>"


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key; rows whose keys are null are kept apart by nothing (null is a key of its own)."""
    last = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")


def ledger_state(ledger: DataFrame) -> DataFrame:
    """The newest state of each path; late older states do not replace it. Ties go to the greatest hashes."""
    return latest(ledger.filter("file_path is not null"), ["file_path"], [F.desc_nulls_last("indexed_at"), F.desc_nulls_last("blob_sha"), F.desc_nulls_last("signature_hash"), F.desc_nulls_last("chunk_count"), F.desc_nulls_last("chunk_hashes_json")])


def classify(snapshot: DataFrame, state: DataFrame) -> DataFrame:
    """``file_path, change``: ``new``, ``deleted``, ``unchanged`` or ``content-only`` (the hash differs) of a snapshot ``file_path, blob_sha`` against a ledger state. One join tells all."""
    a = snapshot.select("file_path", F.col("blob_sha").alias("sha"), F.lit(True).alias("now")).dropDuplicates(["file_path"])
    b = state.select("file_path", F.col("blob_sha").alias("old"), F.lit(True).alias("before"))
    kind = F.when(F.col("before").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("sha").eqNullSafe(F.col("old")), "unchanged").otherwise("content-only")
    return a.join(b, "file_path", "full_outer").select("file_path", kind.alias("change"))


def name_status(lines: DataFrame, column: str = "value") -> DataFrame:
    """``status, path, old_path`` of name-status lines: A, M, D, and R with its old path; other lines are ignored."""
    parts = F.split(F.regexp_replace(column, "\r$", ""), "\t")
    status = F.substring(parts[0], 1, 1)
    rows = lines.select(status.alias("status"), parts.alias("p")).filter((F.col("status").isin("A", "M", "D") & (F.size("p") >= 2)) | ((F.col("status") == "R") & (F.size("p") >= 3)))
    moved = F.col("status") == "R"
    return rows.select("status", F.when(moved, F.try_element_at("p", F.lit(3))).otherwise(F.try_element_at("p", F.lit(2))).alias("path"), F.when(moved, F.try_element_at("p", F.lit(2))).alias("old_path"))


def files_to_index(changes: DataFrame, snapshot: DataFrame) -> DataFrame:
    """``path, blob_sha`` of the added, changed and renamed paths that the snapshot has. A renamed file is indexed again too, as it may have been edited."""
    touched = changes.filter(F.col("status").isin("A", "M", "R")).select(F.col("path")).distinct()
    return touched.join(snapshot.select(F.col("file_path").alias("path"), "blob_sha"), "path")


def upserted(rows: DataFrame) -> DataFrame:
    """Chunks as an upsert leaves them: per path, symbol, type and start line the row written last (by time, then id). Chunks without a symbol never replace each other."""
    named = latest(rows.filter("symbol_name is not null"), ["file_path", "symbol_name", "chunk_type", "start_line"], [F.desc_nulls_last("indexed_at"), F.desc("chunk_id")])
    return named.unionByName(latest(rows.filter("symbol_name is null"), ["chunk_id"], [F.desc_nulls_last("indexed_at")]))


def renamed(table: DataFrame, moves: DataFrame) -> DataFrame:
    """A table with ``file_path`` replaced by the moves ``old_path, path``; everything else, tags and vectors too, stays. A path that moves twice goes to the smallest new path."""
    moves = moves.filter("old_path is not null").groupBy("old_path").agg(F.min("path").alias("_to"))
    joined = table.join(moves, table["file_path"] == F.col("old_path"), "left")
    return joined.withColumn("file_path", F.coalesce("_to", "file_path")).select(table.columns)


def without_files(table: DataFrame, deleted: DataFrame) -> DataFrame:
    """A table without the rows of deleted paths."""
    return table.join(deleted.select("file_path").distinct(), "file_path", "left_anti").select(table.columns)


def without_chunks(table: DataFrame, kept: DataFrame) -> DataFrame:
    """A table that refers to chunks, such as tags or vectors, without the rows of chunks that no longer exist."""
    return table.join(kept.select("chunk_id").distinct(), "chunk_id", "left_semi").select(table.columns)


def replaced_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` with all rows of the paths in ``new`` replaced by those of ``new``."""
    return without_files(old, new).unionByName(new.select(old.columns))


def with_key_and_signature(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("key", chunk_key(F.col("chunk_type"), F.col("symbol_name"), F.col("start_line"))).withColumn(
        "sig", chunk_signature(F.col("chunk_type"), F.col("receiver_type"), F.col("symbol_name"), F.col("signature"))
    )


def chunk_state(state: DataFrame, chunks: DataFrame) -> DataFrame:
    """``file_path, key, sig``: what each file held. A null or unreadable list is rebuilt from the chunks; an empty list is an empty state."""
    entries = F.from_json("chunk_hashes_json", ENTRIES)
    known = state.select("file_path", entries.alias("e"))
    told = known.filter("e is not null").select("file_path", F.explode("e").alias("x")).select("file_path", "x.key", "x.sig").filter("key is not null")
    rebuilt = with_key_and_signature(chunks.dropDuplicates(["chunk_id"])).join(known.filter("e is null"), "file_path", "left_semi").select("file_path", "key", "sig")
    return told.unionByName(rebuilt).groupBy("file_path", "key").agg(F.min("sig").alias("sig"))


def reuse(new: DataFrame, old: DataFrame) -> DataFrame:
    """``chunk_id, file_path, key, reuse, source_key``: which new chunks (``chunk_id, file_path, key, sig, symbol_name``) need no new vector.

    ``same``: the key had the same signature. ``moved``: another key of the file had
    it (the first in order of keys); chunks without a symbol never count as moved, as
    all of a file share one signature. ``embed``: neither.
    """
    here = old.select("file_path", "key", F.col("sig").alias("old_sig"))
    first = old.groupBy("file_path", "sig").agg(F.min("key").alias("moved_key"))
    rows = new.join(here, ["file_path", "key"], "left").join(first, ["file_path", "sig"], "left")
    same = F.col("old_sig") == F.col("sig")
    moved = F.col("moved_key").isNotNull() & F.col("symbol_name").isNotNull()
    kind = F.when(same, "same").when(moved, "moved").otherwise("embed")
    return rows.select("chunk_id", "file_path", "key", kind.alias("reuse"), F.when(same, F.col("key")).when(moved, F.col("moved_key")).alias("source_key"))


def run_summary(changes: DataFrame) -> DataFrame:
    """``change, n``: the outcome of a run."""
    return changes.groupBy("change").agg(F.count("*").alias("n"))
