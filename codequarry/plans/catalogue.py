"""The registered queries of the core, over whole tables, and their SQL.

Query sets are taken from the tables: searches ask with every chunk whose id is
divisible by 100, against all rows. "Now" and versions are taken from the data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codequarry.functions import chunkers, embedding, fulltext, hashing, identifiers, sqltext, structure, vectors
from codequarry.operators import caching, ledger, search
from codequarry.plans.oracles import ORACLES
from codequarry.session import read_table
from codequarry.sources import tree
from codequarry.streaming import upkeep

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

#: Rules that the tagging and ignoring queries apply.
TAG_RULES = [("uses-cache", r"\bcache\w*"), ("raises", r"(?:throw new|raise) \w+"), ("receipts", "receipts?/")]
IGNORE_RULES = ["node_modules/", "*.min.js", "/vendor/", "services/**", "!services/ocr/**", "*.sql"]
NOW = "2026-01-01 00:00:00"
#: A file put together from chunks is parsed in stretches of whole chunks; a new one begins after so many characters.
STRETCH = 1 << 20


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks, each id once: the row indexed last."""
    return ledger.latest(read_table(spark, d, "chunks"), ["chunk_id"], [F.desc_nulls_last("indexed_at")])


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "chunks_vec")


def _query_vectors(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).filter("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")


def _query_texts(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "chunks").filter("chunk_id % 100 = 0 and symbol_name is not null")
    return rows.select(F.col("chunk_id").alias("query_id"), F.col("symbol_name").alias("query")).distinct()


# Search


@query
def knn_search(spark: SparkSession, d: str) -> DataFrame:
    near = search.nearest(_query_vectors(spark, d), _vectors(spark, d))
    return near.select("query_id", "chunk_id", F.round("distance", 5).alias("distance"), F.round("similarity", 5).alias("similarity"))


@query
def knn_scope_after(spark: SparkSession, d: str) -> DataFrame:
    near = search.within_scope(search.nearest(_query_vectors(spark, d), _vectors(spark, d)), _chunks(spark, d), "backend")
    return near.select("query_id", "chunk_id", "rank")


@query
def knn_scope_before(spark: SparkSession, d: str) -> DataFrame:
    vecs = search.within_scope(_vectors(spark, d), _chunks(spark, d), "backend")
    return search.nearest(_query_vectors(spark, d), vecs).select("query_id", "chunk_id", "rank")


@query
def bm25_search(spark: SparkSession, d: str) -> DataFrame:
    chunks = _chunks(spark, d)
    found = search.full_text(_query_texts(spark, d), search.built_index(chunks), chunks)
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query
def bm25_scope(spark: SparkSession, d: str) -> DataFrame:
    chunks = _chunks(spark, d)
    found = search.full_text(_query_texts(spark, d), search.built_index(chunks), chunks, scope="frontend")
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@query
def bm25_stemmed(spark: SparkSession, d: str) -> DataFrame:
    chunks = _chunks(spark, d)
    return search.full_text(_query_texts(spark, d), search.built_index(chunks, stem=True), chunks, stem=True)


def hybrid_ranked(spark: SparkSession, d: str) -> DataFrame:
    chunks = _chunks(spark, d)
    asked = _query_texts(spark, d).join(_query_vectors(spark, d).dropDuplicates(["query_id"]), "query_id", "left")
    return search.hybrid(asked, chunks, _vectors(spark, d), search.built_index(chunks))


@query
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    ranked = search.hydrated(hybrid_ranked(spark, d), _chunks(spark, d), ["file_path", "symbol_name"])
    return ranked.select("query_id", "chunk_id", "file_path", "symbol_name", F.round("rrf", 9).alias("rrf"), "vec_rank", "text_rank", "rank")


flagship = hybrid_search


@query
def hybrid_by_file(spark: SparkSession, d: str) -> DataFrame:
    ranked = search.hydrated(hybrid_ranked(spark, d), _chunks(spark, d), ["file_path", "symbol_name", "start_line"])
    return search.by_file(ranked).select("query_id", "file_path", F.size("hits").alias("n"), F.array_join(F.transform("hits", lambda h: h["chunk_id"].cast("string")), ",").alias("chunks"))


@query
def hybrid_excerpts(spark: SparkSession, d: str) -> DataFrame:
    ranked = search.hydrated(hybrid_ranked(spark, d), _chunks(spark, d), ["content"]).join(_query_texts(spark, d), "query_id")
    terms = F.transform(fulltext.query_terms(F.col("query")), lambda t: t["term"])
    return ranked.select("query_id", "chunk_id", fulltext.highlighted(F.col("content"), terms).alias("excerpt"))


@query
def fts_query_terms(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents").filter("lower(trim(source)) = 'search_query' and text is not null")
    return docs.select("doc_id", F.posexplode(fulltext.query_terms(F.col("text"))).alias("n", "t")).select("doc_id", "n", "t.term", "t.is_prefix")


@query
def lookup_file(spark: SparkSession, d: str) -> DataFrame:
    paths = read_table(spark, d, "files").filter("file_id % 100 = 0")
    return search.lookup_files(paths, _chunks(spark, d)).select("file_path", "chunk_id", "start_line", "place")


@query
def search_symbol(spark: SparkSession, d: str) -> DataFrame:
    return search.search_symbols(_chunks(spark, d), "_RCHARD", limit=100).select("chunk_id", "symbol_name", "file_path", "start_line")


@query
def search_symbol_exact(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of every 100th chunk's symbol."""
    asked = _chunks(spark, d).filter("chunk_id % 100 = 0").select(F.col("symbol_name").alias("asked"))
    return search.symbols_named(_chunks(spark, d), asked).select("chunk_id", "symbol_name", "file_path", "start_line")


def _references(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).filter("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "chunk_id", "file_path")


@query
def related_by_chunk(spark: SparkSession, d: str) -> DataFrame:
    return search.related(_references(spark, d), _chunks(spark, d), read_table(spark, d, "chunk_tags"))


@query
def related_by_file(spark: SparkSession, d: str) -> DataFrame:
    asked = read_table(spark, d, "files").filter("file_id % 100 = 0").select(F.col("file_id").alias("query_id"), "file_path")
    refs = _chunks(spark, d).select("chunk_id", "file_path").join(asked, "file_path")
    return search.related(refs, _chunks(spark, d), read_table(spark, d, "chunk_tags"))


@query
def related_resources(spark: SparkSession, d: str) -> DataFrame:
    return search.related(_references(spark, d), _chunks(spark, d), read_table(spark, d, "chunk_tags"), resource_only=True)


@query
def index_totals(spark: SparkSession, d: str) -> DataFrame:
    return search.index_totals(read_table(spark, d, "chunks"), read_table(spark, d, "files"))


@query
def index_languages(spark: SparkSession, d: str) -> DataFrame:
    return search.index_languages(read_table(spark, d, "files"))


@query
def index_health(spark: SparkSession, d: str) -> DataFrame:
    """Counts that disagree with the chunks, and files older than 72 hours before the newest one."""
    files, real = read_table(spark, d, "files"), _chunks(spark, d).groupBy("file_path").agg(F.count("*").alias("real"))
    newest = files.agg(F.max("last_indexed_at").alias("newest"))
    rows = files.join(real, "file_path", "left").crossJoin(F.broadcast(newest))
    stale = F.col("last_indexed_at") < F.col("newest") - F.expr("interval 72 hours")
    return rows.select("file_path", (F.coalesce("real", F.lit(0)) != F.col("chunk_count")).alias("count_differs"), stale.alias("stale"))


@query
def vector_dimensions(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"))


@query
def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "embeddings")
    unit = vectors.normalized(F.col("embedding"))
    return rows.select("vec_id", F.round(vectors.l2_norm(F.col("embedding")), 5).alias("norm"), F.round(F.aggregate(unit, F.lit(0.0), lambda s, x: s + x), 5).alias("unit_sum"))


# Text, identifiers and tags


@query
def snippets(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select("chunk_id", structure.snippet(F.col("content")).alias("snippet"))


@query
def long_chunk_parts(spark: SparkSession, d: str) -> DataFrame:
    parts = structure.split_long_chunks(_chunks(spark, d).filter("content is not null"), 100)
    return parts.select("chunk_id", "symbol_name", "start_line", F.md5("content").alias("digest"))


@query
def identifier_words(spark: SparkSession, d: str) -> DataFrame:
    rows = _chunks(spark, d).filter("symbol_name is not null")
    return rows.select("chunk_id", F.array_join(identifiers.words(F.col("symbol_name")), " ").alias("words"), identifiers.kebab(F.col("symbol_name")).alias("kebab"))


@query
def base_tags(spark: SparkSession, d: str) -> DataFrame:
    rows = _chunks(spark, d).filter("file_path is not null")
    return rows.select("chunk_id", F.explode(identifiers.base_tags(F.col("file_path"), F.col("chunk_type"))).alias("tag"))


@query
def resource_tags(spark: SparkSession, d: str) -> DataFrame:
    tags = identifiers.resource_tags(F.col("file_path"), F.col("symbol_name"), exclude=["node_modules/**", "vendor/**"])
    rows = _chunks(spark, d).select("chunk_id", F.posexplode(tags).alias("n", "tag"))
    return rows.select("chunk_id", "n", "tag", identifiers.tag_weight(F.col("tag")).alias("weight"))


@query
def rule_tags(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select("chunk_id", F.explode(identifiers.rule_tags(F.col("file_path"), F.col("content"), TAG_RULES)).alias("tag"))


@query
def chunk_tag_rows(spark: SparkSession, d: str) -> DataFrame:
    """Tags as an index run stores them: base, resource and rule tags, each once, with weights."""
    path, symbol = F.col("file_path"), F.col("symbol_name")
    tags = identifiers.merged_tags(identifiers.base_tags(path, F.col("chunk_type")), identifiers.resource_tags(path, symbol), identifiers.rule_tags(path, F.col("content"), TAG_RULES))
    rows = _chunks(spark, d).select("chunk_id", F.explode(tags).alias("tag")).filter("tag is not null")
    return rows.select("chunk_id", "tag", identifiers.tag_weight(F.col("tag")).alias("weight"))


@query
def clean_tags(spark: SparkSession, d: str) -> DataFrame:
    return search.clean_tags(read_table(spark, d, "chunk_tags"))


@query
def file_languages(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "files").select("file_path", structure.language_of(F.col("file_path")).alias("detected"))


@query
def glob_matches(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "files").filter(identifiers.matches_any(F.col("file_path"), ["src/**/*.ts", "services/*/src/**", "**/api/*.go"])).select("file_path")


@query
def eligible_files(spark: SparkSession, d: str) -> DataFrame:
    kept = tree.eligible(read_table(spark, d, "files").select("file_path"), IGNORE_RULES, ["typescript", "javascript", "go", "python"])
    return kept.select("file_path", F.col("language"))


@query
def file_admission(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents").withColumn("bytes", F.encode("text", "UTF-8"))
    return docs.select("doc_id", tree.admission(F.octet_length("bytes"), F.col("bytes"), 2_000).alias("reason"))


@query
def chunk_signatures(spark: SparkSession, d: str) -> DataFrame:
    rows = ledger.with_key_and_signature(_chunks(spark, d))
    return rows.select("chunk_id", "key", "sig", hashing.source_hash(F.col("content")).alias("content_hash"))


@query
def file_signatures(spark: SparkSession, d: str) -> DataFrame:
    named = _chunks(spark, d).filter("symbol_name is not null and file_path is not null")
    part = F.concat_ws(":", "chunk_type", "symbol_name", F.coalesce("signature", F.lit("")))
    return named.groupBy("file_path").agg(hashing.signature_hash(F.collect_list(part)).alias("signature_hash"))


@query
def embedding_texts(spark: SparkSession, d: str) -> DataFrame:
    text = hashing.embedding_text(F.col("signature"), F.col("doc_comment"), F.col("content"))
    return _chunks(spark, d).select("chunk_id", F.md5(text).alias("digest"), F.length(text).alias("n"))


@query
def hashed_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """The place of the component that is not 0."""
    found = embedding.embedded(_chunks(spark, d), hashing.embedding_text(F.col("signature"), F.col("doc_comment"), F.col("content")), embedding.hashed())
    return found.select("chunk_id", F.array_position("embedding", F.lit(1.0).cast("float")).alias("component"))


@query
def doc_comments(spark: SparkSession, d: str) -> DataFrame:
    """Documentation inside the contents, by language: docstrings, and comments above the line of the signature."""
    rows = _chunks(spark, d).filter("content is not null and symbol_name is not null")
    at = F.size(F.split(F.call_function("substring_index", F.col("content"), F.col("symbol_name"), F.lit(1)), "\n", -1))
    found = F.when(F.col("language") == "python", structure.docstring(F.col("content"))).when(F.col("language") == "sql", structure.comment_above(F.col("content"), at, "--"))
    found = found.otherwise(structure.block_comment_above(F.col("content"), at))
    return rows.select("chunk_id", found.alias("doc")).filter("doc is not null and doc <> ''")


@query
def sql_definitions(spark: SparkSession, d: str) -> DataFrame:
    rows = _chunks(spark, d).filter("language = 'sql' and content is not null")
    return sqltext.sql_chunks(rows).select("file_path", "chunk_type", "receiver", "symbol_name", "package_name", "signature", "imports", "dialect")


@query
def sql_dialects(spark: SparkSession, d: str) -> DataFrame:
    rows = _chunks(spark, d).filter("language = 'sql' and content is not null")
    return rows.select("chunk_id", F.coalesce(sqltext.dialect_of_content(F.col("content")), F.lit("ansi")).alias("dialect"))


@query
def sql_features(spark: SparkSession, d: str) -> DataFrame:
    rows = _chunks(spark, d).filter("content is not null")
    return rows.select("chunk_id", F.explode(sqltext.feature_tags(F.lit("postgres"), F.col("content"))).alias("tag"))


@query
def source_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Files put together from their chunks and split again by language."""
    part = F.struct("start_line", "chunk_id", "content")
    rows = _chunks(spark, d).filter("file_path is not null and content is not null")
    before = Window.partitionBy("file_path").orderBy(F.asc_nulls_first("start_line"), "chunk_id").rowsBetween(Window.unboundedPreceding, -1)
    sized = rows.select("file_path", "start_line", "chunk_id", "content", F.length("content").cast("long").alias("size"), (F.size(F.split("content", "\n", -1)) + 1).cast("long").alias("lines"))
    # Where each chunk stands in its file: characters and lines before it.
    placed = sized.withColumn("stretch", F.floor(F.coalesce(F.sum("size").over(before), F.lit(0)) / STRETCH)).withColumn("first", F.coalesce(F.sum("lines").over(before), F.lit(0)))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda x: x["content"]), "\n\n")
    files = placed.repartition("file_path", "stretch").groupBy("file_path", "stretch").agg(text.alias("content"), F.min("first").alias("first"))
    # The line goes with the path through the parser.
    files = files.withColumn("language", structure.language_of(F.col("file_path"))).withColumn("file_path", F.concat_ws("\0", F.col("first").cast("string"), "file_path"))
    at, path = F.substring_index("file_path", "\0", 1).cast("int"), F.expr("substring(file_path, instr(file_path, char(0)) + 1)")
    found = chunkers.chunked(files).withColumns({"start_line": F.col("start_line") + at, "end_line": F.col("end_line") + at, "file_path": path})
    return found.select("file_path", "language", "chunk_type", "symbol_name", "receiver_type", "start_line", "end_line", "error")


@query
def script_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Components put together from the chunks of each component file, and their script blocks."""
    rows = _chunks(spark, d).filter("language = 'svelte' and content is not null and file_path is not null")
    script = F.concat(F.lit("<script>\n"), F.col("content"), F.lit("\n</script>\n<p>"), F.coalesce("symbol_name", F.lit("")), F.lit("</p>"))
    return rows.select("chunk_id", F.explode(structure.script_blocks(script)).alias("b"), structure.template_text(script).alias("template")).select("chunk_id", "b.is_module", F.length("b.code").alias("n"), "b.first_line", "template")


# Ledger


def _snapshot(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "files").select("file_path", F.col("file_hash").alias("blob_sha"))


@query
def ledger_state(spark: SparkSession, d: str) -> DataFrame:
    return ledger.ledger_state(read_table(spark, d, "index_ledger")).select("file_path", "blob_sha", "indexed_at")


@query
def ledger_changes(spark: SparkSession, d: str) -> DataFrame:
    return ledger.classify(_snapshot(spark, d), ledger.ledger_state(read_table(spark, d, "index_ledger")))


@query
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    return ledger.run_summary(ledger_changes(spark, d))


def _name_status_lines(spark: SparkSession, d: str) -> DataFrame:
    """Name-status lines of the files: by id, added, modified, deleted, renamed or copied."""
    path = F.col("file_path")
    line = F.when(F.col("file_id") % 5 == 0, F.concat(F.lit("A\t"), path)).when(F.col("file_id") % 5 == 1, F.concat(F.lit("M\t"), path)).when(F.col("file_id") % 5 == 2, F.concat(F.lit("D\t"), path))
    line = line.when(F.col("file_id") % 5 == 3, F.concat(F.lit("R097\t"), path, F.lit("\tmoved/"), path)).otherwise(F.concat(F.lit("C100\t"), path, F.lit("\tcopy/"), path))
    return read_table(spark, d, "files").select(line.alias("value"))


@query
def name_status(spark: SparkSession, d: str) -> DataFrame:
    return ledger.name_status(_name_status_lines(spark, d))


@query
def diff_files_to_index(spark: SparkSession, d: str) -> DataFrame:
    return ledger.files_to_index(ledger.name_status(_name_status_lines(spark, d)), _snapshot(spark, d))


@query
def renamed_chunks(spark: SparkSession, d: str) -> DataFrame:
    moves = ledger.name_status(_name_status_lines(spark, d)).filter("status = 'R'").select("old_path", "path")
    return ledger.renamed(_chunks(spark, d), moves).select("chunk_id", "file_path")


@query
def remaining_tags(spark: SparkSession, d: str) -> DataFrame:
    """Tags after the chunks of deleted files are gone."""
    gone = ledger.name_status(_name_status_lines(spark, d)).filter("status = 'D'").select(F.col("path").alias("file_path"))
    kept = ledger.without_files(_chunks(spark, d).filter("file_path is not null"), gone)
    return ledger.without_chunks(search.clean_tags(read_table(spark, d, "chunk_tags")), kept)


@query
def upserted_chunks(spark: SparkSession, d: str) -> DataFrame:
    return ledger.upserted(read_table(spark, d, "chunks")).select("chunk_id", "file_path", "symbol_name")


@query
def replaced_files(spark: SparkSession, d: str) -> DataFrame:
    """Chunks after the files with an id divisible by 100 were indexed anew."""
    chunks = _chunks(spark, d).filter("file_path is not null").select("chunk_id", "file_path", "indexed_at")
    again = read_table(spark, d, "files").filter("file_id % 100 = 0").select("file_path")
    fresh = chunks.join(again, "file_path", "left_semi").select((-F.col("chunk_id")).alias("chunk_id"), "file_path", F.to_timestamp_ntz(F.lit(NOW)).alias("indexed_at"))
    return ledger.replaced_files(chunks, fresh)


@query
def chunk_state(spark: SparkSession, d: str) -> DataFrame:
    return ledger.chunk_state(ledger.ledger_state(read_table(spark, d, "index_ledger")), _chunks(spark, d))


@query
def chunk_reuse(spark: SparkSession, d: str) -> DataFrame:
    """Which chunks of today keep the vectors of the state before, in which all files had lost three lines at the top."""
    rows = ledger.with_key_and_signature(_chunks(spark, d).filter("file_path is not null"))
    shifted = rows.withColumn("start_line", F.when(F.col("chunk_id") % 3 == 0, F.col("start_line")).otherwise(F.col("start_line") - 3))
    shifted = shifted.filter("chunk_id % 7 <> 0").withColumn("key", hashing.chunk_key(F.col("chunk_type"), F.col("symbol_name"), F.col("start_line")))
    old = shifted.groupBy("file_path", "key").agg(F.min("sig").alias("sig"))
    return ledger.reuse(rows.select("chunk_id", "file_path", "key", "sig", "symbol_name"), old)


# Caches: lookups are the events, by type and user.


def _lookups(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "events")
    text = F.concat_ws(" ", "event_type", (F.col("user_id") % 50).cast("string"))
    version = F.when(F.col("user_id") % 4 == 0, "v1").otherwise("v2")
    return rows.select(F.col("event_id").alias("lookup_id"), F.sha2(text, 256).alias("query_hash"), text.alias("query_text"), version.alias("version_sha"), F.col("ts").cast("timestamp_ntz").alias("ts"))


def _exact_cache(spark: SparkSession, d: str) -> DataFrame:
    """One entry a query, made at its first lookup."""
    first = _lookups(spark, d).groupBy("query_hash", "query_text").agg(F.min("version_sha").alias("version_sha"), F.min("ts").alias("at"))
    made = caching.exact_entries(first.withColumn("result_json", F.concat(F.lit('["'), "query_text", F.lit('"]'))).select("query_hash", "query_text", "result_json", "version_sha", "at"), F.lit(None).cast("timestamp_ntz"))
    made = made.drop("created_at", "expires_at").join(first.select("query_hash", F.col("at").alias("created_at")), "query_hash")
    return made.withColumn("expires_at", F.col("created_at") + F.expr(f"interval {caching.TTL_HOURS} hours"))


def _noon(spark: SparkSession, d: str) -> DataFrame:
    """The time of the middle entry of the cache."""
    return _exact_cache(spark, d).agg(F.max("created_at").alias("now"))


@query
def cache_hits(spark: SparkSession, d: str) -> DataFrame:
    cache = _exact_cache(spark, d).crossJoin(F.broadcast(_noon(spark, d)))
    return caching.exact_hits(_lookups(spark, d), cache, F.col("now")).select("lookup_id", "result_json", "hit_count")


@query
def cache_counts(spark: SparkSession, d: str) -> DataFrame:
    cache = _exact_cache(spark, d)
    hits = caching.exact_hits(_lookups(spark, d), cache, F.lit("1970-01-01").cast("timestamp_ntz"))
    return caching.counted_hits(cache, hits).select("query_hash", "hit_count")


@query
def cache_purged(spark: SparkSession, d: str) -> DataFrame:
    cache = _exact_cache(spark, d).crossJoin(F.broadcast(_noon(spark, d)))
    return caching.of_version(caching.purged(cache, F.col("now")), F.lit("v1")).select("query_hash", "query_text")


@query
def cache_stats(spark: SparkSession, d: str) -> DataFrame:
    cache = _exact_cache(spark, d).crossJoin(F.broadcast(_noon(spark, d)))
    return caching.cache_stats(cache, F.col("now"))


@query
def cache_put(spark: SparkSession, d: str) -> DataFrame:
    cache = _exact_cache(spark, d)
    new = cache.filter("version_sha = 'v1'").select("query_hash", "query_text", F.lit("[]").alias("result_json"), F.lit("v3").alias("version_sha"))
    after = caching.exact_put(cache, caching.exact_entries(new, F.to_timestamp_ntz(F.lit(NOW))))
    return after.select("query_hash", "result_json", "version_sha", "hit_count", "expires_at")


def _semantic_entries(spark: SparkSession, d: str) -> DataFrame:
    """Unit vectors with scopes, modes and limits by id."""
    rows = read_table(spark, d, "embeddings")
    return rows.select(
        F.col("vec_id").alias("entry_id"), "embedding", F.when(F.col("vec_id") % 5 == 0, "v1").otherwise("v2").alias("version_sha"), F.when(F.col("vec_id") % 3 == 0, "backend").alias("scope"),
        F.lit("hybrid").alias("mode"), F.lit(10).alias("limit_n"), (F.col("vec_id") % 7).alias("hit_count"),
        (F.to_timestamp_ntz(F.lit(NOW)) + F.make_interval(mins=(F.col("vec_id") % 997).cast("int"))).alias("created_at"), F.to_timestamp_ntz(F.lit("2026-02-01 00:00:00")).alias("expires_at"),
    )


def _semantic_cache(spark: SparkSession, d: str) -> DataFrame:
    """At most 1,000 entries."""
    return caching.evicted(_semantic_entries(spark, d))


@query
def semantic_evicted(spark: SparkSession, d: str) -> DataFrame:
    return caching.evicted(_semantic_entries(spark, d), 200).select("entry_id", "hit_count")


@query
def semantic_hits(spark: SparkSession, d: str) -> DataFrame:
    asked = read_table(spark, d, "embeddings").select(
        F.col("vec_id").alias("lookup_id"), "embedding", F.lit("v2").alias("version_sha"), F.when(F.col("vec_id") % 2 == 0, "backend").alias("scope"), F.lit("hybrid").alias("mode"), F.lit(10).alias("limit_n")
    )
    hits = caching.semantic_hits(asked, _semantic_cache(spark, d), F.to_timestamp_ntz(F.lit("2026-01-15 00:00:00")), threshold=0.5)
    return hits.select("lookup_id", "entry_id", F.round("similarity", 5).alias("similarity"))


@query
def windowed_hits(spark: SparkSession, d: str) -> DataFrame:
    return upkeep.windowed_hits(_lookups(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))).select(F.col("start").cast("timestamp_ntz").alias("start"), "query_hash", "hits")


@query
def streamed_ledger(spark: SparkSession, d: str) -> DataFrame:
    """The ledger folded up as a stream of its files; the state is that of one batch."""
    import uuid

    from codequarry.session import shared_dir
    from codequarry.store import VersionedTable

    rows = read_table(spark, d, "index_ledger")
    where = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows.repartition(4, "file_path").write.parquet(f"{where}/in")
    table = VersionedTable(spark, f"{where}/ledger")
    run = upkeep.follow_ledger(upkeep.stream_folder(spark, f"{where}/in", rows.schema, 2), table, f"{where}/progress")
    run.awaitTermination()
    return table.read().select("file_path", "blob_sha", "indexed_at")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
