"""The engine as a user calls it: index a source tree, then search it."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.config import Settings
from codequarry.functions import chunkers, embedding, hashing, identifiers, sqltext, structure
from codequarry.functions.vectors import l2_norm
from codequarry.operators import caching, ledger, search
from codequarry.session import scratch, staged
from codequarry.sources import tree
from codequarry.store import Store, VersionedTable

#: Buckets by path that the tables of an index are kept in; a run rewrites those of the files that changed.
BUCKETS = 64
#: The version of the tables' columns.
SCHEMA_VERSION = 2
EMPTY_STATE = "file_path string, blob_sha string, signature_hash string, chunk_count int, chunk_hashes_json string, indexed_at timestamp_ntz"


def bucket_of(path: Column) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(BUCKETS)).cast("int")


class Engine:
    """An index under a folder. ``embedder`` turns lists of texts into vectors; the default needs no network."""

    def __init__(self, spark: SparkSession, home: str, settings: Settings | None = None, embedder: embedding.Embedder | None = None):
        self.spark, self.settings = spark, settings or Settings()
        self.embedder = embedder or embedding.hashed(self.settings.dimension)
        self.store = Store(spark, f"{home.rstrip('/')}/index")
        self.tables = {name: VersionedTable(spark, f"{home.rstrip('/')}/{name}") for name in ("exact_cache", "semantic_cache")}
        self._opened: tuple[int, search.Index] | None = None

    def table(self, name: str) -> DataFrame:
        return self.tables[name].read() if name in self.tables else self.store.read(name)

    # Indexing

    def _parsed(self, files: DataFrame) -> DataFrame:
        text = files.withColumn("content", F.decode("content", "UTF-8"))
        columns = ["file_path", "language", "chunk_type", "symbol_name", "receiver_type", "signature", "package_name", "start_line", "end_line", "content", "doc_comment", "imports"]
        code = chunkers.chunked(text.filter("language <> 'sql'"))
        code = code.select(*columns, "error", F.array().cast("array<string>").alias("sql_tags"))
        sql = sqltext.sql_chunks(text.filter("language = 'sql'"))
        tags = F.concat(F.array(F.concat(F.lit("dialect:"), "dialect")), "features")
        sql = sql.select("file_path", F.lit("sql").alias("language"), "chunk_type", "symbol_name", F.col("receiver").alias("receiver_type"), "signature", "package_name", "start_line", "end_line", "content", "doc_comment", "imports", F.lit(None).cast("string").alias("error"), tags.alias("sql_tags"))
        return code.unionByName(sql)

    def _cut(self, chunks: DataFrame) -> DataFrame:
        """Chunks of too many lines in parts, all with the other columns of their chunk; a chunk without a symbol gets none."""
        own = ["symbol_name", "start_line", "end_line", "content"]
        rest = F.struct(*(c for c in chunks.columns if c not in own), F.col("symbol_name").isNotNull().alias("named"))
        parts = structure.split_long_chunks(chunks.withColumn("chunk_id", rest))
        return parts.select("chunk_id.*", *own).withColumn("symbol_name", F.when(F.col("named"), F.col("symbol_name"))).select(chunks.columns)

    def _tagged(self, chunks: DataFrame) -> DataFrame:
        path, s = F.col("file_path"), self.settings
        tags = identifiers.merged_tags(identifiers.base_tags(path, F.col("chunk_type")), F.col("sql_tags"), identifiers.resource_tags(path, F.col("symbol_name"), stopwords=s.stopwords), identifiers.rule_tags(path, F.col("content"), list(s.tag_rules)))
        rows = chunks.select("chunk_id", F.explode(tags).alias("tag")).filter("tag is not null")
        return rows.withColumn("weight", identifiers.tag_weight(F.col("tag"), s.resource_weight))

    def index(
        self, root: str, now: str, full: bool = False, diff: Callable[[], DataFrame] | None = None, keep: Callable[[Column], Column] | None = None,
        hash_of: Callable[[Column], Column] = hashing.git_blob_sha, progress: Callable[[str], None] = lambda _: None,
    ) -> DataFrame:
        """Brings the index up to the files under ``root`` and returns ``change, n``.

        Only new and changed files are parsed, and only chunks whose signature is new
        in their file are embedded. Files that are gone, ignored (by the settings or
        the tree's own ignore file) or no longer of an enabled language leave the
        index. A file that cannot be parsed is counted as ``error``, keeps its former
        chunks and is tried again by the next run.

        ``diff`` gives name-status lines of what changed since the last run: then only
        those paths are looked at, and renamed files keep chunks, tags and vectors. If
        it fails, all files are compared. ``keep`` says of a path whether it takes
        part, ``hash_of`` is the hash of a file's bytes. All tables become visible at
        once; only the buckets of changed files are rewritten.
        """
        with scratch(self.spark):
            counts = self._run(root, now, full, diff, keep, hash_of, progress).collect()
        return self.spark.createDataFrame(counts, "change string, n long")

    def _run(self, root: str, now: str, full: bool, diff: Callable[[], DataFrame] | None, keep: Callable[[Column], Column] | None, hash_of: Callable[[Column], Column], progress: Callable[[str], None]) -> DataFrame:
        s, at = self.settings, F.to_timestamp_ntz(F.lit(now))
        base, version = self.store.manifest()
        version = {} if full else version
        files = tree.read_tree(self.spark, root, max_bytes=s.max_file_bytes)
        rules = list(s.exclude) + tree.tree_rules(self.spark, root)
        admitted = tree.eligible(files, rules, list(s.languages)).filter(tree.admission(F.col("length"), F.col("content"), s.max_file_bytes) == "ok")
        admitted = admitted.filter(keep(F.col("file_path"))) if keep else admitted
        admitted = admitted.withColumn("blob_sha", hash_of(F.col("content")))
        state = self.store.read_or_none("index_ledger", version=version)
        state = self.spark.createDataFrame([], EMPTY_STATE) if state is None else state

        moves = None
        if diff is not None and version:
            try:
                told = staged(ledger.name_status(diff()), "diff")
            except Exception as e:  # noqa: BLE001 - whatever fails, all files are compared
                progress(f"no diff ({e}), comparing all files")
            else:
                moves = told.filter("status = 'R'").select("old_path", "path")
                state = ledger.renamed(state, moves)
                named = told.select(F.col("path").alias("file_path")).distinct()
                admitted, state_seen = admitted.join(named, "file_path", "left_semi"), state.join(named, "file_path", "left_semi")
        changes = staged(ledger.classify(admitted.select("file_path", "blob_sha"), state if moves is None else state_seen), "changes")
        touched = changes.filter("change in ('new', 'content-only')").select("file_path")
        progress("files compared")

        fresh = staged(admitted.join(touched, "file_path", "left_semi"), "fresh")
        parsed = staged(self._parsed(fresh), "parsed")
        failed = parsed.filter("error is not null").select("file_path").distinct()
        done = fresh.join(failed, "file_path", "left_anti")
        gone = staged(changes.filter("change <> 'unchanged'").select("file_path").join(failed, "file_path", "left_anti"), "gone")
        paths = gone if moves is None else gone.unionByName(moves.select(F.explode(F.array("old_path", "path")).alias("file_path")))
        # At most as many as there are buckets.
        buckets = [r["b"] for r in paths.select(bucket_of(F.col("file_path")).alias("b")).distinct().collect()]
        progress("files parsed")

        scope = F.lit(None).cast("string")
        for glob, label in s.scopes.items():
            scope = F.when(identifiers.matches_any(F.col("file_path"), [glob]), F.lit(label)).otherwise(scope)
        key = hashing.chunk_key(F.col("chunk_type"), F.col("symbol_name"), F.col("start_line"))
        whole = self._cut(parsed.filter("error is null").drop("error"))
        whole = whole.withColumn("chunk_id", F.xxhash64("file_path", key)).withColumn("scope", scope).withColumn("indexed_at", at)
        chunks = staged(ledger.with_key_and_signature(ledger.upserted(whole)), "chunks")

        def before(name: str) -> DataFrame | None:
            """The rows of the buckets that are rewritten, under the paths their files have now."""
            rows = self.store.read_or_none(name, buckets, version)
            return rows if rows is None or moves is None else ledger.renamed(rows, moves)

        vectors, old_chunks, old_vectors = None, before("chunks"), before("chunks_vec")
        if old_chunks is not None and old_vectors is not None:
            had = ledger.with_key_and_signature(old_chunks)
            plan = ledger.reuse(chunks.select("chunk_id", "file_path", "key", "sig", "symbol_name"), had.groupBy("file_path", "key").agg(F.min("sig").alias("sig")))
            source = had.join(old_vectors.select("chunk_id", "embedding"), "chunk_id").groupBy("file_path", F.col("key").alias("source_key")).agg(F.first("embedding").alias("embedding"))
            vectors = staged(plan.join(source, ["file_path", "source_key"]).select("chunk_id", "embedding"), "kept")
        to_embed = chunks if vectors is None else chunks.join(vectors, "chunk_id", "left_anti")
        text = hashing.embedding_text(F.col("signature"), F.col("doc_comment"), F.col("content"))
        new_vectors = embedding.embedded(to_embed, text, self.embedder)
        vectors = new_vectors if vectors is None else new_vectors.unionByName(vectors)
        progress("chunks embedded")

        part = F.concat_ws(":", "chunk_type", "symbol_name", F.coalesce("signature", F.lit("")))
        sizes = chunks.groupBy("file_path").agg(
            F.count("*").cast("int").alias("chunk_count"), F.to_json(F.sort_array(F.collect_list(F.struct("key", "sig")))).alias("chunk_hashes_json"),
            hashing.signature_hash(F.collect_list(F.when(F.col("symbol_name").isNotNull(), part))).alias("signature_hash"),
        )
        lines = F.size(F.split(F.decode("content", "UTF-8"), "\n", -1))
        new_files = staged(done.join(sizes, "file_path", "left").select("file_path", F.col("blob_sha").alias("file_hash"), "language", lines.alias("line_count"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), at.alias("last_indexed_at"), "signature_hash", F.coalesce("chunk_hashes_json", F.lit("[]")).alias("chunk_hashes_json")), "new_files")
        new_ledger = new_files.select("file_path", F.col("file_hash").alias("blob_sha"), "signature_hash", "chunk_count", "chunk_hashes_json", F.col("last_indexed_at").alias("indexed_at"))

        path_of = chunks.select("chunk_id", "file_path")

        def merged(name: str, new: DataFrame) -> DataFrame:
            new = new if "file_path" in new.columns else new.join(path_of, "chunk_id")
            old = before(name)
            rows = new if old is None else ledger.without_files(old, gone).unionByName(new.select(old.columns))
            return rows.withColumn("bucket", bucket_of(F.col("file_path")))

        columns = [c for c in chunks.columns if c not in ("key", "sig", "sql_tags")]
        results = {
            "chunks": merged("chunks", chunks.select(columns)),
            "chunk_tags": merged("chunk_tags", self._tagged(chunks)),
            "chunks_vec": merged("chunks_vec", vectors),
            "postings": merged("postings", search.postings(chunks, stem=True)),
            "files": merged("files", new_files.drop("signature_hash", "chunk_hashes_json")),
            "index_ledger": merged("index_ledger", new_ledger),
        }
        results = {name: df.sortWithinPartitions("token") if name == "postings" else df for name, df in results.items()}
        words = {"words": merged_words(self.store.read_or_none("postings", [b for b in range(BUCKETS) if b not in buckets], version), staged(results["postings"].select("token", "tf"), "tokens"))}
        self.store.commit(results | words, None if full or not version else buckets, base)
        progress("tables committed")
        renamed = [] if moves is None else [moves.agg(F.lit("renamed").alias("change"), F.count("*").alias("n"))]
        summary = ledger.run_summary(changes).unionByName(failed.agg(F.lit("error").alias("change"), F.count("*").alias("n")))
        for more in renamed:
            summary = summary.unionByName(more)
        return summary.filter("n > 0")

    # Searching

    def search_code(self, query: str, version: str, now: str, limit: int = 10, scope: str | None = None, mode: str = "hybrid") -> DataFrame:
        """``rank, chunk_id, file_path, symbol_name, start_line, end_line, score, snippet`` of the best chunks, at most 50."""
        if limit < 1 or mode not in ("hybrid", "semantic"):
            raise ValueError("the limit must be at least 1, the mode hybrid or semantic")
        limit = min(limit, 50)
        vector = [float(x) for x in self.embedder([query])[0]]
        asked = self.spark.createDataFrame([(0, query, vector)], "query_id long, query string, embedding array<float>")
        chunks, dim = self.table("chunks"), len(vector)
        if mode == "semantic":
            found = search.within_scope(search.nearest(asked, self.table("chunks_vec"), limit, dim, distinct=True), chunks, scope).withColumn("score", F.col("similarity"))
        else:
            found = search.hybrid(asked, chunks, self.table("chunks_vec"), self.full_text_index(), limit, scope, dim, stem=True, distinct=True).withColumn("score", F.col("rrf"))
        rows = search.hydrated(found, chunks, ["file_path", "symbol_name", "start_line", "end_line", "content"])
        return rows.select("rank", "chunk_id", "file_path", "symbol_name", "start_line", "end_line", "score", structure.snippet(F.col("content")).alias("snippet")).orderBy("rank")

    def full_text_index(self) -> search.Index:
        """The index of the last version; its totals are counted once a version."""
        number, version = self.store.manifest()
        if self._opened is None or self._opened[0] != number:
            tables = [self.store.read_or_none(name, version=version) for name in ("postings", "words", "chunks")]
            self._opened = number, search.opened_index(*tables)
        return self._opened[1]

    def lookup_file(self, path: str, limit: int = 100) -> DataFrame:
        asked = self.spark.createDataFrame([(path,)], "file_path string")
        return search.lookup_files(asked, self.table("chunks"), limit).orderBy("place")

    def described_file(self, path: str, limit: int = 100) -> str:
        """The row of a file and its chunks as text, or that it is not indexed."""
        row = self.table("files").filter(F.col("file_path") == path).head()
        if row is None:
            return f"{path} [not indexed]"
        chunks = self.lookup_file(path, limit).select("start_line", "end_line", "chunk_type", "symbol_name").collect()
        head = f"{path} ({row['language']}, {row['line_count']} lines, {row['chunk_count']} chunks, {row['last_indexed_at']})"
        return "\n".join([head, *(f"  {r['start_line']}-{r['end_line']} {r['chunk_type']} {r['symbol_name'] or ''}".rstrip() for r in chunks)])

    def search_symbol(self, name: str, exact: bool = False, language: str | None = None, limit: int = 20) -> DataFrame:
        return search.search_symbols(self.table("chunks"), name, exact, language, limit)

    def get_related(self, path: str | None = None, chunk_id: int | None = None, limit: int = 20, resource_only: bool = False) -> DataFrame:
        """Chunks that share tags with a chunk (which counts first) or a file."""
        if path is None and chunk_id is None:
            raise ValueError("give a path or a chunk id")
        chunks = self.table("chunks")
        own = chunks.filter(F.col("chunk_id") == chunk_id) if chunk_id is not None else chunks.filter(F.col("file_path") == path)
        refs = own.select(F.lit(0).cast("long").alias("query_id"), "chunk_id", "file_path")
        found = search.related(refs, chunks, self.table("chunk_tags"), limit, resource_only, single=True)
        return search.hydrated(found.drop("query_id"), chunks, ["file_path", "symbol_name", "start_line"]).orderBy("rank")

    def index_status(self, now: str | None = None) -> DataFrame:
        """One row: numbers of chunks and files, when a file was last indexed, files by language, dimension and schema version, and what the caches hold (expired entries as of ``now``)."""
        files = self.table("files")
        languages = files.groupBy("language").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.collect_list(F.struct(F.coalesce("language", F.lit("")), "n"))).alias("languages"))
        out = search.index_totals(self.table("chunks"), files).crossJoin(languages)
        out = out.withColumns({"dimension": F.lit(self.settings.dimension), "schema_version": F.lit(SCHEMA_VERSION)})
        at = F.to_timestamp_ntz(F.lit(now)) if now else F.localtimestamp()
        for name, prefix in (("exact_cache", "exact"), ("semantic_cache", "semantic")):
            cache = self.tables[name].read_or_none()
            told = caching.cache_stats(cache, at) if cache is not None else self.spark.createDataFrame([(0, 0, 0)], "entries long, expired long, hits long")
            out = out.crossJoin(told.select(*(F.col(c).alias(f"{prefix}_{c}") for c in ("entries", "expired", "hits"))))
        return out

    def cached_search(self, query: str, version: str, now: str, limit: int = 10, scope: str | None = None, mode: str = "hybrid") -> list[dict]:
        """``search_code`` through the caches: a live entry of the same version answers without a search, one of the same query first, else one of a similar query."""
        with scratch(self.spark):
            return self._cached_search(query, version, now, limit, scope, mode)

    def _cached_search(self, query: str, version: str, now: str, limit: int, scope: str | None, mode: str) -> list[dict]:
        at = F.to_timestamp_ntz(F.lit(now))
        one = self.spark.createDataFrame([(0, query, mode, scope, limit, version)], "lookup_id long, q string, m string, s string, l int, version_sha string")
        asked = one.withColumn("query_hash", hashing.query_key(F.col("m"), F.col("q"), F.col("s"), F.col("l")))
        cache = self.tables["exact_cache"].read_or_none()
        if cache is not None:
            hits = staged(caching.exact_hits(asked, cache, at), "hits")
            if row := hits.head():
                self.tables["exact_cache"].write(caching.counted_hits(cache, hits))
                return json.loads(row["result_json"])
        similar = staged(embedding.embedded(one, F.col("q"), self.embedder, "lookup_id").join(one, "lookup_id").select("lookup_id", "embedding", F.col("q").alias("query_text"), "version_sha", F.col("s").alias("scope"), F.col("m").alias("mode"), F.col("l").alias("limit_n")), "asked")
        result = self._similar_result(similar, at)
        if result is None:
            rows = [r.asDict() for r in self.search_code(query, version, now, limit, scope, mode).collect()]
            result = json.dumps(rows)
            self._put_similar(similar, result, at)
        made = asked.select("query_hash", F.col("q").alias("query_text"), F.lit(result).alias("result_json"), "version_sha")
        entries = caching.exact_entries(made, at, self.settings.cache_ttl_hours)
        self.tables["exact_cache"].write(entries if cache is None else caching.exact_put(cache, entries))
        return json.loads(result)

    def _similar_result(self, asked: DataFrame, at: Column) -> str | None:
        """The result of the most similar query in the semantic cache, which counts the hit."""
        cache = self.tables["semantic_cache"].read_or_none()
        if cache is None:
            return None
        # Vectors of another embedder's length, and zero ones, resemble nothing.
        size = len(asked.head()["embedding"])
        usable = asked.filter(l2_norm(F.col("embedding")) > 0)
        hit = caching.semantic_hits(usable, cache.filter(F.size("embedding") == size), at, self.settings.semantic_threshold).head()
        if hit is None:
            return None
        found = F.col("entry_id") == hit["entry_id"]
        self.tables["semantic_cache"].write(cache.withColumn("hit_count", F.col("hit_count") + F.when(found, 1).otherwise(0)))
        return cache.filter(found).head()["result_json"]

    def _put_similar(self, asked: DataFrame, result: str, at: Column) -> None:
        """Adds a result to the semantic cache, which is then cut to the entries of the settings."""
        cache = self.tables["semantic_cache"].read_or_none()
        last = 0 if cache is None else cache.agg(F.max("entry_id")).head()[0] or 0
        expires = at + F.make_interval(hours=F.lit(self.settings.cache_ttl_hours))
        new = asked.filter(l2_norm(F.col("embedding")) > 0).select(F.lit(last + 1).cast("long").alias("entry_id"), "embedding", "query_text", F.lit(result).alias("result_json"), "version_sha", "scope", "mode", "limit_n", F.lit(0).cast("long").alias("hit_count"), at.alias("created_at"), expires.alias("expires_at"))
        self.tables["semantic_cache"].write(caching.evicted(new if cache is None else cache.unionByName(new), self.settings.semantic_entries))


def merged_words(kept: DataFrame | None, new: DataFrame) -> DataFrame:
    """The vocabulary of the postings that stay and of those that are written."""
    rows = new if kept is None else new.unionByName(kept.select("token", "tf"))
    return search.index_words(rows)


def rendered(rows: list[dict], mode: str) -> str:
    """Search results as text, grouped by file in order of path and line."""
    out = [f"[{len(rows)} results, mode={mode}]"]
    for path in sorted({r["file_path"] for r in rows}):
        out.append(f"\n{path}")
        for r in sorted((r for r in rows if r["file_path"] == path), key=lambda r: r["start_line"] or 0):
            out.append(f"  {r['start_line']}-{r['end_line']} {r['symbol_name'] or ''} ({r['score']:.3f})\n{r['snippet']}")
    return "\n".join(out)
