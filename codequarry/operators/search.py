"""Retrieval: nearest vectors, full text, their fusion, symbols, files and related chunks.

All searches take a table of queries, so one job answers many; a single query is a
table of one row. Ranks are cut per query before wide columns are fetched.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.functions.fulltext import query_terms, stemmed, tokens
from codequarry.functions.vectors import cosine_of_distance, rrf_term
from codequarry.session import staged

# Constant of reciprocal rank fusion, rows of each channel, BM25 parameters.
RRF_K, CHANNEL, K1, B = 60, 20, 1.2, 0.75
#: Words of queries, and tokens they stand for, are sent to all tasks up to this number; more of them are joined by a shuffle.
MOST_SENT = 100_000
#: Rows of a block of vectors; a pair of blocks is compared in one matrix product.
BLOCK = 4_096
#: Query vectors are sent to all tasks up to this number.
MOST_QUERIES = 65_536
#: Tokens up to this number are also a filter of the index's scan.
MOST_FILTERED = 500
#: A tag of more chunks is frequent: related chunks by it are rated by combinations of tags, not one by one.
RARE = 512
#: Queries of a block whose distances are held at once, and pairs whose distance is computed again at once.
QUERIES, PAIRS = 256, 1 << 16


def _packed(vectors: DataFrame, id_col: str, vec_col: str, dim: int, names: tuple[str, str], distinct: bool = False) -> DataFrame:
    """Blocks of up to ``BLOCK`` rows: the ids and the vectors, as bytes. Unusable vectors (null, of another length, with nulls, NaN or infinities) are left out."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, BLOCK):
                part = b.slice(s, BLOCK)
                keep = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(part.column(1)), -1)) == dim
                ids = np.asarray(part.column(0))[keep].astype(np.int64)
                x = np.asarray(part.column(1).filter(pa.array(keep)).flatten().cast(pa.float64()).fill_null(float("nan"))).reshape(-1, dim)
                good = np.isfinite(x).all(1)
                if good.any():
                    yield pa.RecordBatch.from_arrays([pa.array([ids[good].tobytes()]), pa.array([np.ascontiguousarray(x[good]).tobytes()])], list(names))

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("e")).filter("id is not null")
    rows = rows if distinct else rows.dropDuplicates(["id"])
    return rows.mapInArrow(pack, f"{names[0]} binary, {names[1]} binary")


def are_few(queries: DataFrame) -> bool:
    """Whether queries may be sent to all tasks."""
    return queries.limit(MOST_QUERIES + 1).count() <= MOST_QUERIES


def nearest(queries: DataFrame, vectors: DataFrame, k: int = CHANNEL, dim: int = 64, query_col: str = "query_id", id_col: str = "chunk_id", vec_col: str = "embedding", distinct: bool = False, few: bool | None = None) -> DataFrame:
    """``query_id, chunk_id, distance, similarity, rank``: exact search, the ``k`` vectors nearest to each query by Euclidean distance; ties by id.

    Both sides are packed into blocks, and every block of queries meets every block
    of vectors once; a pair of blocks returns only the best ``k`` of each query, cut after all rows
    that tie with the last of them are ordered by id. The queries are the side that is
    sent, if a count shows that they are few enough. ``distinct``: ids of vectors are
    known to occur once.
    """

    def candidates(q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of rows, with distances, that hold the nearest ``k`` of each query and all that tie with the last of them."""
        size = (q * q).sum(1)[:, None] + (v * v).sum(1)[None]
        square = size - 2 * q @ v.T
        # The product rounds by less than this, so no row that may be among the nearest is left out.
        size *= 4 * (dim + 8) * np.finfo(float).eps
        m = min(k, len(v)) - 1
        cut = np.partition(square + size, m, axis=1)[:, m, None]
        at, near = np.nonzero(~(square - size > cut))
        # Their distances are computed again, part by part.
        parts = [np.sqrt(((q[at[i : i + PAIRS]] - v[near[i : i + PAIRS]]) ** 2).sum(1)) for i in range(0, len(at), PAIRS)]
        return at, near, np.concatenate(parts)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for qi, qv, vi, vv in zip(*(c.to_pylist() for c in b.columns), strict=True):
                qid, vid = np.frombuffer(qi, np.int64), np.frombuffer(vi, np.int64)
                q, v = np.frombuffer(qv).reshape(-1, dim), np.frombuffer(vv).reshape(-1, dim)
                for s in range(0, len(qid), QUERIES):
                    at, near, dist = candidates(q[s : s + QUERIES], v)
                    order = np.lexsort((vid[near], dist, at))
                    at, near, dist = at[order], near[order], dist[order]
                    top = np.arange(len(at)) - np.searchsorted(at, at, "left") < k
                    yield pa.RecordBatch.from_arrays([pa.array(qid[s + at[top]]), pa.array(vid[near[top]]), pa.array(dist[top])], ["query_id", "chunk_id", "distance"])

    left = _packed(queries, query_col, vec_col, dim, ("qi", "qv"))
    right = _packed(vectors, id_col, vec_col, dim, ("vi", "vv"), distinct)
    if are_few(queries) if few is None else few:
        left = F.broadcast(left)
    found = left.crossJoin(right).select("qi", "qv", "vi", "vv").mapInArrow(compare, "query_id long, chunk_id long, distance double")
    best = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "chunk_id", "distance", cosine_of_distance(F.col("distance")).alias("similarity"), "rank")


def within_scope(found: DataFrame, chunks: DataFrame, scope: str | None) -> DataFrame:
    """Search results of one scope, as the rank stands: filtered after the cut. A null scope never matches; no scope asked for keeps all."""
    return found if scope is None else found.join(chunks.filter(F.col("scope") == scope).select("chunk_id"), "chunk_id", "left_semi")


def postings(chunks: DataFrame, columns: tuple[str, ...] = ("signature", "symbol_name", "content"), stem: bool = False) -> DataFrame:
    """``token, chunk_id, tf, n_tokens, at``: the inverted index, a row for each token of each chunk.

    ``n_tokens`` is the length of the chunk over all columns, ``at`` the places of the
    token: the number of the column in the upper 32 bits, the position in the lower
    ones. Chunks that repeat an id count once.
    """
    one = chunks.dropDuplicates(["chunk_id"])
    parts = F.array(*(F.struct(F.lit(n).alias("col"), F.col(c).alias("text")) for n, c in enumerate(columns)))
    rows = one.select("chunk_id", F.explode(parts).alias("p")).select("chunk_id", "p.col", F.posexplode(tokens(F.col("p.text"))).alias("pos", "token"))
    rows = stemmed(rows) if stem else rows
    place = F.shiftleft(F.col("col").cast("long"), 32) + F.col("pos")
    # Tokens of a chunk lie together, so its length needs no join.
    each = rows.repartition("chunk_id").groupBy("chunk_id", "token").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list(place)).alias("at"))
    length = F.sum("tf").over(Window.partitionBy("chunk_id"))
    return each.select("token", "chunk_id", "tf", length.alias("n_tokens"), "at")


def in_token_order(rows: DataFrame) -> DataFrame:
    """Postings as they are stored: rows of a token side by side, so that a scan for few tokens skips the rest; a frequent one in eight parts."""
    return rows.repartition(F.col("token"), F.pmod("chunk_id", F.lit(8))).sortWithinPartitions("token", "chunk_id")


class Index(NamedTuple):
    """A full-text index: postings, the distinct tokens, and the totals of the corpus."""

    postings: DataFrame
    words: DataFrame
    n_docs: int
    n_tokens: int


def index_words(rows: DataFrame) -> DataFrame:
    """``token, n``: the distinct tokens of postings and how often each occurs."""
    return rows.groupBy("token").agg(F.sum("tf").alias("n"))


def opened_index(rows: DataFrame, words: DataFrame, chunks: DataFrame) -> Index:
    """An index from its stored tables. The totals cover all chunks, those without tokens too."""
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).head()["n"]
    return Index(rows, words, chunks.select("chunk_id").distinct().count(), total)


def built_index(chunks: DataFrame, stem: bool = False) -> Index:
    """The index of chunks, with its tables staged."""
    rows = staged(in_token_order(postings(chunks, stem=stem)), "postings")
    return opened_index(rows, staged(index_words(rows), "words"), chunks)


def _query_parts(queries: DataFrame, query_col: str, text_col: str, stem: bool) -> DataFrame:
    """``query_id, phrase, part, parts, token, is_prefix``: each word of a query is a phrase of the tokens between its underscores; the last one is a prefix."""
    words = queries.select(F.col(query_col).alias("query_id"), F.posexplode(query_terms(F.col(text_col))).alias("phrase", "t"))
    split = words.select("query_id", "phrase", F.col("t.is_prefix").alias("p"), tokens(F.col("t.term")).alias("ts"))
    rows = split.select("query_id", "phrase", F.size("ts").alias("parts"), "p", F.posexplode("ts").alias("part", "token"))
    rows = rows.withColumn("is_prefix", F.col("p") & (F.col("part") == F.col("parts") - 1)).drop("p")
    return stemmed(rows) if stem else rows


def query_tokens(queries: DataFrame, index: Index, query_col: str = "query_id", text_col: str = "query", stem: bool = False, few: bool | None = None) -> DataFrame:
    """``query_id, phrase, part, parts, token``: the tokens of the index that the words of the queries stand for. Prefixes meet the vocabulary on their first two letters."""
    parts, words = _query_parts(queries, query_col, text_col, stem), index.words.select("token")
    if are_few(queries) if few is None else few:
        parts = F.broadcast(parts)
    head = lambda c: F.substring(c, 1, 2)
    open_ended = parts.filter("is_prefix").select("query_id", "phrase", "part", "parts", F.col("token").alias("prefix"))
    expanded = words.join(open_ended, (head("prefix") == head("token")) & F.col("token").startswith(F.col("prefix"))).drop("prefix")
    # A prefix of one letter has no second one to meet on.
    single = words.join(open_ended.filter(F.length("prefix") == 1), (F.substring("prefix", 1, 1) == F.substring("token", 1, 1)) & (F.length("token") > 1)).drop("prefix")
    exact = parts.filter("not is_prefix").select("query_id", "phrase", "part", "parts", "token")
    columns = ["query_id", "phrase", "part", "parts", "token"]
    return expanded.select(columns).unionByName(single.select(columns)).unionByName(exact.select(columns)).distinct()


def phrase_hits(queries: DataFrame, index: Index, query_col: str = "query_id", text_col: str = "query", stem: bool = False, few: bool | None = None) -> DataFrame:
    """``query_id, phrase, chunk_id, n_tokens, tf``: how often each phrase of each query occurs in each chunk.

    Tokens join the index by equality; those of queries are sent if there are at most
    ``MOST_SENT``, and filter the scan if they are few. Places are read for phrases of
    several tokens only.
    """
    wanted = query_tokens(queries, index, query_col, text_col, stem, few)
    rows, single, several = index.postings, F.col("parts") == 1, True
    # At most one row more than may be sent.
    told = wanted.limit(MOST_SENT + 1).toArrow()
    if told.num_rows <= MOST_SENT:
        names = set(told["token"].to_pylist())
        several = any(n > 1 for n in told["parts"].unique().to_pylist())
        wanted = F.broadcast(queries.sparkSession.createDataFrame(told, wanted.schema))
        if len(names) <= MOST_FILTERED:
            rows = rows.filter(F.col("token").isin(sorted(names)))
    group = ["query_id", "phrase", "chunk_id", "n_tokens"]
    alone = rows.select("token", "chunk_id", "tf", "n_tokens").join(wanted.filter(single), "token").groupBy(*group).agg(F.sum("tf").alias("tf"))
    if not several:
        return alone
    at = rows.join(wanted.filter(~single), "token").select(*group, "part", "parts", F.explode("at").alias("place")).withColumn("start", F.col("place") - F.col("part"))
    # A place holds one token, so no part counts twice.
    whole = at.groupBy(*group, "parts", "start").agg(F.count("*").alias("n")).filter("n = parts")
    return alone.unionByName(whole.groupBy(*group).agg(F.count("*").alias("tf")))


def full_text(queries: DataFrame, index: Index, chunks: DataFrame, k: int = CHANNEL, scope: str | None = None, stem: bool = False, query_col: str = "query_id", text_col: str = "query", few: bool | None = None) -> DataFrame:
    """``query_id, chunk_id, score, rank``: the ``k`` best chunks of each query by BM25 over all columns; the scope counts before the cut, ties go to the smaller id."""
    hits = phrase_hits(queries, index, query_col, text_col, stem, few)
    # Of the same columns, so that both uses of the hits share their shuffle.
    spread = hits.groupBy("query_id", "phrase").agg(F.count("tf").alias("df"))
    idf = F.log((F.lit(float(index.n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    rated = hits.join(spread, ["query_id", "phrase"])
    weight = F.when(idf > 0, idf).otherwise(F.lit(1e-6))
    length = F.col("n_tokens") / F.lit(index.n_tokens / max(1, index.n_docs))
    part = weight * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * length))
    scored = rated.groupBy("query_id", "chunk_id").agg(F.sum(part).alias("score"))
    scored = within_scope(scored, chunks, scope)
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "chunk_id", "score", "rank")


def fused(vector_hits: DataFrame, text_hits: DataFrame, limit: int = 10) -> DataFrame:
    """``query_id, chunk_id, rrf, vec_rank, text_rank, rank``: reciprocal rank fusion; ties go to the better vector rank, then the better text rank."""
    both = vector_hits.select("query_id", "chunk_id", F.col("rank").alias("vec_rank"), F.lit(None).cast("int").alias("text_rank"))
    both = both.unionByName(text_hits.select("query_id", "chunk_id", F.lit(None).cast("int").alias("vec_rank"), F.col("rank").alias("text_rank")))
    merged = both.groupBy("query_id", "chunk_id").agg(F.max("vec_rank").alias("vec_rank"), F.max("text_rank").alias("text_rank"))
    terms = [F.coalesce(rrf_term(F.col(c), RRF_K), F.lit(0.0)) for c in ("vec_rank", "text_rank")]
    scored = merged.withColumn("rrf", terms[0] + terms[1])
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("rrf", 12)), F.asc_nulls_last("vec_rank"), F.asc_nulls_last("text_rank"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def hybrid(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, index: Index, limit: int = 10, scope: str | None = None, dim: int = 64, stem: bool = False, distinct: bool = False) -> DataFrame:
    """Both channels of ``query_id, query, embedding`` and their fusion; the vector channel is filtered by scope after its cut, the text channel before."""
    few = are_few(queries)
    near = within_scope(nearest(queries, vectors, CHANNEL, dim, distinct=distinct, few=few), chunks, scope)
    text = full_text(queries, index, chunks, CHANNEL, scope, stem, few=few)
    return fused(near, text, limit)


def hydrated(ranked: DataFrame, chunks: DataFrame, columns: list[str]) -> DataFrame:
    """Ranked ids with columns of their chunks; ids that no longer exist are dropped. The ranked side is small, so it is the one that is sent."""
    return ranked.join(chunks.dropDuplicates(["chunk_id"]).select("chunk_id", *columns), "chunk_id")


def by_file(results: DataFrame) -> DataFrame:
    """``query_id, file_path, hits``: results grouped by file, in each by start line."""
    hit = F.struct("start_line", "chunk_id", "symbol_name", "rank")
    return results.groupBy("query_id", "file_path").agg(F.sort_array(F.collect_list(hit)).alias("hits"))


def lookup_files(paths: DataFrame, chunks: DataFrame, limit: int = 100) -> DataFrame:
    """The chunks of each path of ``file_path``, up to ``limit`` a file in order of their lines."""
    order = Window.partitionBy("file_path").orderBy("start_line", "chunk_id")
    one = chunks.dropDuplicates(["chunk_id"]).join(paths.select("file_path").distinct(), "file_path", "left_semi")
    return one.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= min(limit, 500))


def symbol_pattern(name: str) -> str:
    """A pattern for a substring of symbols without regard to the case of ASCII letters; ``%`` and ``_`` are wildcards, a backslash is itself."""
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in name)
    return "%" + lower.replace("\\", "\\\\") + "%"


def search_symbols(chunks: DataFrame, name: str, exact: bool = False, language: str | None = None, limit: int = 20) -> DataFrame:
    """Chunks by symbol name, in order of path and line; a limit below 1 is refused."""
    if limit < 1:
        raise ValueError("the limit must be at least 1")
    folded = F.translate("symbol_name", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = chunks.dropDuplicates(["chunk_id"]).filter(F.col("symbol_name") == name if exact else folded.like(symbol_pattern(name)))
    if language is not None:
        found = found.filter(F.col("language") == language)
    return found.orderBy(F.asc_nulls_first("file_path"), F.asc_nulls_first("start_line"), "chunk_id").limit(min(limit, 100))


def symbols_named(chunks: DataFrame, names: DataFrame) -> DataFrame:
    """The chunks whose symbol is one of ``asked`` of ``names``, whatever their number; null names match nothing."""
    return chunks.dropDuplicates(["chunk_id"]).join(names.select(F.col("asked").alias("symbol_name")).distinct(), "symbol_name", "left_semi").select(chunks.columns)


def clean_tags(tags: DataFrame) -> DataFrame:
    """``chunk_id, tag, weight``: one row a chunk and tag (trimmed, lower-cased) with the largest weight; a null weight counts 1, null and blank tags are dropped."""
    name = F.lower(F.regexp_replace("tag", r"(?U)^\s+|\s+$", ""))
    return tags.select("chunk_id", name.alias("tag"), F.coalesce("weight", F.lit(1)).alias("weight")).filter("tag <> ''").groupBy("chunk_id", "tag").agg(F.max("weight").alias("weight"))


def _by_place(*before: Column) -> list[Column]:
    """An order that ends with the chunk's line and id."""
    return [*before, F.asc_nulls_first("start_line"), F.asc_nulls_first("chunk_id")]


def related(references: DataFrame, chunks: DataFrame, tags: DataFrame, limit: int = 20, resource_only: bool = False, single: bool = False) -> DataFrame:
    """``query_id, chunk_id, score, rank``: chunks that share tags with the reference chunks of each query (``query_id, chunk_id, file_path``), by the sum of the shared tags' weights.

    Chunks of the reference's files are left out. Ties: path, then line, then id.
    ``single``: there is one query, so the chunks that share a tag are rated one by one;
    of many queries ``_rated`` rates only what may be among the best.
    """
    limit = min(limit, 100)
    weighted = clean_tags(tags)
    if resource_only:
        weighted = weighted.filter(F.col("tag").startswith("resource:"))
    if not single:
        references, weighted = staged(references.select("query_id", "chunk_id", "file_path"), "references"), staged(weighted, "weighted")
    asking = F.broadcast(references) if not single and are_few(references) else references
    wanted = asking.join(weighted.select("chunk_id", "tag"), "chunk_id").select("query_id", "tag").distinct()
    one = chunks.dropDuplicates(["chunk_id"]).select("chunk_id", "file_path", "start_line")
    own = references.select("query_id", "file_path").distinct()
    if single:
        rated = wanted.join(weighted, "tag").groupBy("query_id", "chunk_id").agg(F.sum("weight").alias("score")).join(one, "chunk_id")
    else:
        rated = _rated(staged(wanted, "wanted"), weighted, one, own, limit)
    rows = rated.join(own, ["query_id", "file_path"], "left_anti")
    order = Window.partitionBy("query_id").orderBy(*_by_place(F.desc("score"), F.asc_nulls_first("file_path")))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select("query_id", "chunk_id", "score", "rank")


def _rated(wanted: DataFrame, weighted: DataFrame, one: DataFrame, own: DataFrame, limit: int) -> DataFrame:
    """``query_id, chunk_id, file_path, start_line, score``: of each query at least the best ``limit`` chunks that share a tag of ``wanted`` (``query_id, tag``) and lie in no file of ``own``.

    Pairs of a query and a chunk are made for rare tags only. Frequent ones occur in
    few combinations: queries that ask for the same frequent tags are one, and of chunks
    that have the same ones with the same weights only those stay that may be among the
    best of a query. Those of a rare tag are rated over all tags and never score less
    than by frequent ones, since tags with negative weights count as frequent.
    """
    sums = dict(weighted.groupBy().agg(F.sum("weight").alias("score")).dtypes)["score"]
    # So many files are enough for the best of any query: of them it leaves out at most its own.
    files = limit + (own.filter("file_path is not null").groupBy("query_id").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).head()["n"] or 0)
    sizes = weighted.groupBy("tag").agg(F.count("*").alias("n"), F.min("weight").alias("least"))
    names = wanted.select("tag").distinct()
    kinds = staged(sizes.join(names, "tag", "left_semi").select("tag", ((F.col("n") > RARE) | (F.col("least") < 0)).alias("hot")), "kinds")
    if kinds.count() <= MOST_SENT:
        kinds = F.broadcast(kinds)
    listed = weighted.join(kinds, "tag").groupBy("chunk_id").agg(*(F.sort_array(F.collect_list(F.when(F.col("hot") if hot else ~F.col("hot"), F.struct("tag", F.col("weight").cast(sums).alias("weight"))))).alias(name) for name, hot in (("hot", True), ("rare", False))))
    tagged = staged(one.join(listed, "chunk_id"), "tagged")

    asked = wanted.join(kinds, "tag").groupBy("query_id").agg(F.sort_array(F.collect_list(F.when(F.col("hot"), F.col("tag")))).alias("asked"))
    queries = staged(asked.withColumn("lead", F.min("query_id").over(Window.partitionBy("asked"))), "queries")
    leads = queries.filter("size(asked) > 0").groupBy("asked").agg(F.first("lead").alias("lead"))
    best = _best_by_hot(leads, tagged, limit, files)
    by_hot = queries.select("query_id", F.col("lead").alias("_lead")).join(best, F.col("_lead").eqNullSafe(F.col("lead"))).drop("_lead", "lead")

    posted = tagged.select(F.col("chunk_id"), F.explode("rare").alias("t")).select("chunk_id", "t.tag", "t.weight")
    by_rare = wanted.join(posted, "tag").groupBy("query_id", "chunk_id").agg(F.sum("weight").alias("part"))
    pairs = by_rare.join(tagged.drop("rare"), "chunk_id").join(queries.select(F.col("query_id").alias("_query"), "asked"), F.col("query_id").eqNullSafe(F.col("_query")))
    shared = F.aggregate(F.filter("hot", lambda t: F.array_contains("asked", t["tag"])), F.lit(0).cast(sums), lambda a, t: (a + t["weight"]).cast(sums))
    columns = ["query_id", "chunk_id", "file_path", "start_line"]
    both = by_hot.select(*columns, "score").unionByName(pairs.select(*columns, (F.col("part") + shared).cast(sums).alias("score")))
    return both.groupBy(*columns).agg(F.max("score").alias("score"))


def _best_by_hot(leads: DataFrame, tagged: DataFrame, limit: int, files: int) -> DataFrame:
    """``lead, chunk_id, file_path, start_line, score``: of each list of tags (``asked, lead``) the best chunks by the tags of ``hot``, down to those of ``files`` files."""
    # Of chunks with equal tags those behind so many files, or behind so many chunks of their own file, are never among the best.
    by_class = tagged.filter("size(hot) > 0").withColumn("_f", F.dense_rank().over(Window.partitionBy("hot").orderBy(F.asc_nulls_first("file_path")))).filter(F.col("_f") <= files)
    by_file = Window.partitionBy("hot", "file_path").orderBy(*_by_place())
    kept = by_class.withColumn("_n", F.row_number().over(by_file)).filter(F.col("_n") <= limit).select("chunk_id", "file_path", "start_line", "hot")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in filter(len, batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema) as out:
                out.write_batch(b)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block"])

    def opened(block: bytes) -> pa.Table:
        return pa.ipc.open_stream(block).read_all().combine_chunks()

    def lists(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
        """The row of each item of a column of lists, and the items."""
        whole = column.combine_chunks()
        return np.repeat(np.arange(len(whole)), np.asarray(whole.value_lengths())), whole.flatten()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for left, right in zip(*(c.to_pylist() for c in b.columns), strict=True):
                asked, rows = opened(left), opened(right)
                rows = rows.take(pa.compute.sort_indices(rows, [("file_path", "ascending"), ("start_line", "ascending"), ("chunk_id", "ascending")], null_placement="at_start"))
                path = np.asarray(rows["file_path"].combine_chunks().dictionary_encode(null_encoding="encode").indices)
                at, items = lists(rows["hot"])
                names = items.field("tag").dictionary_encode()
                tag, weight, known = np.asarray(names.indices), np.asarray(items.field("weight")), {t: i for i, t in enumerate(names.dictionary.to_pylist())}
                by_tag = np.argsort(tag, kind="stable")
                ends = np.searchsorted(tag[by_tag], np.arange(len(known) + 1))
                at, weight = at[by_tag], weight[by_tag]
                chosen, scores, of = [], [], []
                for q, wants in enumerate(asked["asked"].to_pylist()):
                    spans = [slice(ends[i], ends[i + 1]) for i in (known.get(t) for t in wants) if i is not None]
                    if not spans:
                        continue
                    # A row has a tag once, so the parts are added row by row.
                    score, shares = np.zeros(rows.num_rows, weight.dtype), np.zeros(rows.num_rows, bool)
                    for s in spans:
                        score[at[s]] += weight[s]
                        shares[at[s]] = True
                    left_over, seen = np.flatnonzero(shares), 0
                    taken: list[np.ndarray] = []
                    while len(left_over) and seen < files:
                        level = score[left_over] == score[left_over].max()
                        taken.append(left_over[level])
                        left_over = left_over[~level]
                        seen = len(np.unique(path[np.concatenate(taken)]))
                    found = np.concatenate(taken)
                    first = np.zeros(len(found), np.int64)
                    first[np.unique(path[found], return_index=True)[1]] = 1
                    found = found[np.cumsum(first) <= files]
                    chosen.append(found)
                    scores.append(score[found])
                    of.append(np.full(len(found), q))
                if chosen:
                    picked = rows.take(pa.array(np.concatenate(chosen)))
                    found = [asked["lead"].take(pa.array(np.concatenate(of))), *(picked[c] for c in ("chunk_id", "file_path", "start_line")), pa.array(np.concatenate(scores))]
                    yield from pa.Table.from_arrays(found, ["lead", "chunk_id", "file_path", "start_line", "score"]).combine_chunks().to_batches()

    kinds = dict(kept.dtypes)
    score = kept.schema["hot"].dataType.elementType["weight"].dataType.simpleString()
    schema = ", ".join(f"{n} {t}" for n, t in (("lead", dict(leads.dtypes)["lead"]), *((c, kinds[c]) for c in ("chunk_id", "file_path", "start_line")), ("score", score)))
    asked = leads.mapInArrow(pack, "block binary").withColumnRenamed("block", "asked")
    if are_few(leads):
        asked = F.broadcast(asked)
    found = asked.crossJoin(kept.mapInArrow(pack, "block binary")).select("asked", "block").mapInArrow(compare, schema)
    # The same cut over the rows of all blocks.
    in_file = Window.partitionBy("lead", "file_path").orderBy(*_by_place(F.desc("score")))
    in_order = Window.partitionBy("lead").orderBy(*_by_place(F.desc("score"), F.asc_nulls_first("file_path"))).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = found.withColumn("_n", F.row_number().over(in_file)).filter(F.col("_n") <= limit)
    return cut.withColumn("_f", F.sum((F.col("_n") == 1).cast("int")).over(in_order)).filter(F.col("_f") <= files).drop("_n", "_f")


def index_totals(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """One row: numbers of chunks and files, and when a file was last indexed (null if there are none)."""
    return chunks.agg(F.countDistinct("chunk_id").alias("chunks")).crossJoin(files.agg(F.count("*").alias("files"), F.max("last_indexed_at").alias("last_indexed_at")))


def index_languages(files: DataFrame) -> DataFrame:
    """``language, n``: files by language, the most first."""
    return files.groupBy("language").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_first("language"))
