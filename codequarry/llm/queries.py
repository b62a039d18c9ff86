"""The registered queries of this package, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm import docpairs, mixing, neardup, provenance, secrets, sentences, splitting, tagpairs, tokens, vectors
from codequarry.session import read_table, staged

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docpairs.function_doc_pairs(read_table(spark, sf_dir, "chunks")).select("chunk_id").distinct()


def p1_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docpairs.distinct_pairs(docpairs.function_doc_pairs(read_table(spark, sf_dir, "chunks")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.file_evidence(read_table(spark, sf_dir, "chunks")).select("file_path")


def p2_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.file_evidence(read_table(spark, sf_dir, "chunks"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_oversized(read_table(spark, sf_dir, "chunks")).select("chunk_id").distinct()


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_oversized(read_table(spark, sf_dir, "chunks"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagpairs.similar_tag_sets(read_table(spark, sf_dir, "chunk_tags"), read_table(spark, sf_dir, "chunks"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = vectors.most_similar(read_table(spark, sf_dir, "chunks_vec"))
    pair = [F.least("chunk_id", "neighbour").alias("chunk_id_a"), F.greatest("chunk_id", "neighbour").alias("chunk_id_b")]
    return near.select(*pair).distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicate_chunks(read_table(spark, sf_dir, "chunks"))


def p6_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicate_classes(read_table(spark, sf_dir, "chunks"))


def p6_traversal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pairs of nodes the traversal tests and follows, by level."""
    return neardup.traversal_counts(neardup.signed_records(read_table(spark, sf_dir, "chunks"), neardup.chunk_text()))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.found_lines(secrets.redacted_chunks(read_table(spark, sf_dir, "chunks")))


def p7_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a repeated id the greatest content."""
    return secrets.redacted_chunks(read_table(spark, sf_dir, "chunks")).groupBy("chunk_id").agg(F.max("content").alias("content"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_corpus(read_table(spark, sf_dir, "documents"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mixture(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixture = staged(p9_mix(spark, sf_dir), "mixture")
    return mixing.reached_shares(mixture, read_table(spark, sf_dir, "mix_targets"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.split_sentences(read_table(spark, sf_dir, "documents")).select("doc_id", "end_char").distinct()


def p10_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.split_sentences(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    own = [
        p1_found, p1_pairs, p2_found, p2_evidence, p3_found, p3_pieces, p4_found, p5_found, p6_found, p6_classes, p6_traversal,
        p7_found, p7_redacted, p8_ids, p9_mix, p9_shares, p10_found, p10_sentences,
    ]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": r"""
            SELECT DISTINCT chunk_id FROM chunks
            WHERE length(content) > 20000
               OR length(content) - length(replace(content, chr(10), ''))
                  + CASE WHEN content = '' OR right(content, 1) = chr(10) THEN 0 ELSE 1 END > 512
        """,
        "p4_found": r"""
            WITH t AS (
                SELECT chunk_id, lower(regexp_replace(tag, '^\s+|\s+$', '', 'g')) AS tag, max(coalesce(weight, 1)) AS w
                FROM chunk_tags WHERE tag IS NOT NULL AND chunk_id IN (SELECT chunk_id FROM chunks) GROUP BY 1, 2
            ), k AS (
                SELECT * FROM t WHERE tag <> '' AND chunk_id IN (SELECT chunk_id FROM t WHERE tag <> '' GROUP BY 1 HAVING count(*) >= 4)
            ), s AS (SELECT chunk_id, sum(w) AS s FROM k GROUP BY 1), p AS (
                SELECT a.chunk_id AS x, b.chunk_id AS y, sum(least(a.w, b.w)) AS m
                FROM k AS a JOIN k AS b ON a.tag = b.tag AND a.chunk_id < b.chunk_id GROUP BY 1, 2
            )
            SELECT x AS chunk_id_a, y AS chunk_id_b
            FROM p JOIN s AS c ON c.chunk_id = x JOIN s AS d ON d.chunk_id = y
            WHERE m >= 0.75 * (c.s + d.s - m)
        """,
    }
