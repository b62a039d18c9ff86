"""Operators on small tables: search, ledger, caches, store, streaming and the engine."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from codequarry.api import Engine, rendered
from codequarry.config import Settings
from codequarry.functions.embedding import hashed
from codequarry.operators import caching, ledger, search
from codequarry.plans import catalogue
from codequarry.store import VersionedTable
from codequarry.streaming import upkeep


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 8))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, [1.0]), (902, [float("nan")] * 8), (0, [float(v) for v in x[0]])]
    vecs = spark.createDataFrame(rows, "chunk_id long, embedding array<double>")
    asked = vecs.filter("chunk_id < 5").withColumnRenamed("chunk_id", "query_id")
    got = {}
    for r in search.nearest(asked, vecs, 7, 8).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["chunk_id"]
    for q in range(5):
        want = np.lexsort((np.arange(300), np.linalg.norm(x - x[q], axis=1)))[:7]
        assert [got[q][i + 1] for i in range(7)] == list(want)


def test_nearest_of_many_equal_vectors(spark):
    rng = np.random.default_rng(3)
    ids = [int(i) for i in rng.permutation(300)]
    # Two thirds hold one vector, a few are nearer to one of the queries.
    rows = [(i, [0.6, 0.8, 0.1, 0.3] if n % 3 else [float(x) for x in rng.standard_normal(4)]) for n, i in enumerate(ids)]
    x = {i: np.array(v) for i, v in rows}
    vecs = spark.createDataFrame(rows, "chunk_id long, embedding array<double>").coalesce(1)
    asked = spark.createDataFrame([(0, [0.6, 0.8, 0.1, 0.3]), (1, [0.5, 0.7, 0.2, 0.2])], "query_id long, embedding array<double>")
    found = search.nearest(asked, vecs, 20, 4).collect()
    for q, v in ((0, [0.6, 0.8, 0.1, 0.3]), (1, [0.5, 0.7, 0.2, 0.2])):
        want = sorted(x, key=lambda i: (np.sqrt(((np.array(v) - x[i]) ** 2).sum()), i))[:20]
        assert [r["chunk_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q] == want


def test_nearest_of_nothing(spark):
    empty = spark.createDataFrame([], "chunk_id long, embedding array<float>")
    assert search.nearest(empty.withColumnRenamed("chunk_id", "query_id"), empty).count() == 0


def test_fusion_order(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, chunk_id long, rank int")
    b = spark.createDataFrame([(1, 12, 1), (1, 11, 2)], "query_id long, chunk_id long, rank int")
    rows = search.fused(a, b).orderBy("rank").collect()
    assert [r["chunk_id"] for r in rows] == [11, 10, 12]
    assert rows[0]["rrf"] == pytest.approx(2 / 62)


def test_symbols(spark):
    rows = [(1, "Ab_x", "f", 1, "go"), (2, "aBcx", "e", 1, "go"), (3, None, "e", 1, "go"), (4, "ÀB", "a", 1, "ts"), (1, "Ab_x", "f", 1, "go")]
    chunks = spark.createDataFrame(rows, "chunk_id long, symbol_name string, file_path string, start_line int, language string")
    ids = lambda *a, **k: [r["chunk_id"] for r in search.search_symbols(chunks, *a, **k).collect()]
    assert ids("B_X") == [2, 1] and ids("Ab_x", exact=True) == [1] and ids("à") == [] and ids("\\") == []
    assert ids("b", language="ts") == [4] and ids("b", limit=1) == [4]
    with pytest.raises(ValueError):
        ids("b", limit=0)


def _related(refs, chunks, tags, limit):
    """Related chunks pair by pair: ``(query, chunk, score, rank)``."""
    weights, found = {}, set()
    for c, tag, w in tags:
        own = weights.setdefault(c, {})
        own[tag] = max(w, own.get(tag, w))
    for q in {r[0] for r in refs}:
        wanted, left_out = {t for r in refs if r[0] == q for t in weights.get(r[1], ())}, {r[2] for r in refs if r[0] == q} - {None}
        rows = [(-sum(weights[c][t] for t in wanted & set(weights[c])), path or "", line or 0, c) for c, path, line in chunks if path not in left_out and wanted & set(weights.get(c, ()))]
        found |= {(q, r[-1], -r[0], n) for n, r in enumerate(sorted(rows)[:limit], 1)}
    return found


@pytest.mark.parametrize("rare", [0, 8, 10_000])
def test_related_against_pair_by_pair(spark, monkeypatch, rare):
    monkeypatch.setattr(search, "RARE", rare, raising=False)
    rng = np.random.default_rng(rare)
    paths = [None, "a", "b", "\u00e9", *(f"f{i}" for i in range(20))]
    chunks = [(i, paths[rng.integers(len(paths)) if i % 3 else 1], int(rng.integers(1, 4)) if i % 5 else None) for i in range(400)]
    tags = [(i, f"t{min(int(rng.exponential(6)), 30)}", int(rng.choice([1, 1, 3, 0, -2]))) for i in range(405) for _ in range(rng.integers(5))]
    refs = [(int(rng.integers(30)), i, chunks[i][1]) for i in range(0, 400, 5)]
    tables = (spark.createDataFrame(x, s) for x, s in ((refs, "query_id long, chunk_id long, file_path string"), (chunks, "chunk_id long, file_path string, start_line int"), (tags, "chunk_id long, tag string, weight int")))
    assert {tuple(r) for r in search.related(*tables, limit=7).collect()} == _related(refs, chunks, tags, 7)


def _shuffled(spark):
    """Rows that all stages so far have written for shuffles."""
    sc, gateway = spark.sparkContext, spark.sparkContext._gateway
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(gateway.jvm.java.util.ArrayList(), False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return {(stages.apply(i).stageId(), stages.apply(i).attemptId()): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}


def test_related_by_frequent_tags_makes_no_pair_of_each(spark):
    chunks = [(i, f"f{i % 500}", i) for i in range(3_000)]
    tags = [(i, "function", 1) for i in range(3_000)] + [(i, f"part{i % 4}", 1) for i in range(3_000)]
    refs = [(i, i, f"f{i % 500}") for i in range(0, 3_000, 10)]
    tables = [spark.createDataFrame(x, s) for x, s in ((refs, "query_id long, chunk_id long, file_path string"), (chunks, "chunk_id long, file_path string, start_line int"), (tags, "chunk_id long, tag string, weight int"))]
    before = _shuffled(spark)
    found = {tuple(r) for r in search.related(*tables).collect()}
    # There are 900,000 pairs.
    assert sum(n for k, n in _shuffled(spark).items() if k not in before) < 100_000
    assert found == _related(refs, chunks, tags, 20)


def test_classify_and_state(spark):
    at = dt.datetime(2025, 1, 1)
    rows = [("a", "1", at), ("a", "0", at - dt.timedelta(1)), ("b", "2", at), ("c", None, at), (None, "9", at)]
    state = ledger.ledger_state(spark.createDataFrame(rows, "file_path string, blob_sha string, indexed_at timestamp").withColumns({"signature_hash": F.lit(""), "chunk_count": F.lit(1), "chunk_hashes_json": F.lit(None).cast("string")}))
    snap = spark.createDataFrame([("a", "1"), ("b", "3"), ("d", "4")], "file_path string, blob_sha string")
    assert {r["file_path"]: r["change"] for r in ledger.classify(snap, state).collect()} == {"a": "unchanged", "b": "content-only", "c": "deleted", "d": "new"}


def test_name_status(spark):
    lines = spark.createDataFrame([("A\tx",), ("M\ty\r",), ("R100\tp\tq",), ("C90\ta\tb",), ("",), ("D",), ("D\tz",)], "value string")
    assert sorted(map(tuple, ledger.name_status(lines).fillna("-").collect())) == [("A", "x", "-"), ("D", "z", "-"), ("M", "y", "-"), ("R", "q", "p")]


def test_reuse(spark):
    new = spark.createDataFrame([(1, "f", "k1", "s1", "a"), (2, "f", "k2", "s9", "b"), (3, "f", "k3", "s2", "c"), (4, "f", "k4", "s2", None)], "chunk_id long, file_path string, key string, sig string, symbol_name string")
    old = spark.createDataFrame([("f", "k1", "s1"), ("f", "k8", "s2"), ("f", "k7", "s2")], "file_path string, key string, sig string")
    got = {r["chunk_id"]: (r["reuse"], r["source_key"]) for r in ledger.reuse(new, old).collect()}
    assert got == {1: ("same", "k1"), 2: ("embed", None), 3: ("moved", "k7"), 4: ("embed", None)}


def test_chunk_state_of_null_and_empty_lists(spark):
    state = spark.createDataFrame([("a", None), ("b", "[]"), ("c", "{broken"), ("d", '[{"key": "k", "sig": "s"}]')], "file_path string, chunk_hashes_json string")
    rows = [(i, p, "function", None, "f", "f()", 1) for i, p in enumerate("abcd")]
    chunks = spark.createDataFrame(rows, "chunk_id long, file_path string, chunk_type string, receiver_type string, symbol_name string, signature string, start_line int")
    assert {(r["file_path"], r["key"]) for r in ledger.chunk_state(state, chunks).collect()} == {("a", "function:f:1"), ("c", "function:f:1"), ("d", "k")}


def test_exact_cache(spark):
    now = lambda s: F.to_timestamp_ntz(F.lit(s))
    new = spark.createDataFrame([("k", "q", "[1]", "v1")], "query_hash string, query_text string, result_json string, version_sha string")
    cache = caching.exact_entries(new, now("2025-01-01 00:00:00"))
    asked = spark.createDataFrame([(1, "k", "v1"), (2, "k", "v2"), (3, "x", "v1")], "lookup_id long, query_hash string, version_sha string")
    hits = caching.exact_hits(asked, cache, now("2025-01-01 12:00:00"))
    assert [(r["lookup_id"], r["hit_count"]) for r in hits.collect()] == [(1, 2)]
    assert caching.exact_hits(asked, cache, now("2025-01-02 00:00:00")).count() == 0
    assert caching.purged(cache, now("2025-01-02 00:00:00")).count() == 1 and caching.purged(cache, now("2025-01-02 00:00:01")).count() == 0
    counted = caching.counted_hits(cache, hits)
    again = caching.exact_put(counted, caching.exact_entries(new.withColumn("version_sha", F.lit("v2")), now("2025-01-03 00:00:00"))).head()
    assert (again["hit_count"], again["version_sha"], again["created_at"]) == (2, "v2", dt.datetime(2025, 1, 1))
    assert caching.cache_stats(cache.limit(0), now("2025-01-01 00:00:00")).head().asDict() == {"entries": 0, "expired": 0, "hits": 0}


def test_semantic_cache(spark):
    entry = [(1, [1.0, 0.0], "v1", None), (2, [0.0, 1.0], "v1", "s"), (3, [1.0, 0.0], "v2", None)]
    cache = spark.createDataFrame(entry, "entry_id long, embedding array<double>, version_sha string, scope string").withColumns({"mode": F.lit("h"), "limit_n": F.lit(10), "hit_count": F.col("entry_id"), "created_at": F.lit(0), "expires_at": F.to_timestamp_ntz(F.lit("2025-02-01"))})
    asked = spark.createDataFrame([(1, [0.99, 0.14], "v1", None), (2, [0.0, 1.0], "v1", None), (3, [0.0, 1.0], "v1", "s")], "lookup_id long, embedding array<double>, version_sha string, scope string").withColumns({"mode": F.lit("h"), "limit_n": F.lit(10)})
    at = F.to_timestamp_ntz(F.lit("2025-01-01"))
    assert {(r["lookup_id"], r["entry_id"]) for r in caching.semantic_hits(asked, cache, at).collect()} == {(1, 1), (3, 2)}
    assert {(r["lookup_id"], r["entry_id"]) for r in caching.semantic_hits(asked, cache, at, over_fetch=1).collect()} == {(1, 1), (3, 2)}
    assert [r["entry_id"] for r in caching.evicted(cache, 2).orderBy("entry_id").collect()] == [2, 3]


def test_eviction_takes_the_best_of_each_part_first(spark):
    rows = [(i, (i * 7) % 5 if i % 11 else None, (i * 3) % 4) for i in range(200)]
    cache = spark.createDataFrame(rows, "entry_id long, hit_count long, created_at long").repartition(5)
    kept = caching.evicted(cache, 30)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Window" not in plan
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[0]))[-30:]
    assert {r["entry_id"] for r in kept.collect()} == {r[0] for r in want} and caching.evicted(cache, 500).count() == 200


def test_large_files_are_parsed_in_stretches(spark, monkeypatch):
    rows = [(i, "a.py" if i % 4 else "b.py", None if i == 3 else 100 - i // 2, f"def f{i}(a):\n    return {i}" + "\n" * (i % 3)) for i in range(40)]
    chunks = spark.createDataFrame(rows, "chunk_id long, file_path string, start_line int, content string")
    monkeypatch.setattr(catalogue, "_chunks", lambda spark, d: chunks)
    sizes = []
    chunked = catalogue.chunkers.chunked
    monkeypatch.setattr(catalogue.chunkers, "chunked", lambda files: sizes.append(files.select(F.max(F.length("content"))).head()[0]) or chunked(files))
    whole = sorted(map(str, catalogue.source_chunks(spark, "").collect()))
    monkeypatch.setattr(catalogue, "STRETCH", 60, raising=False)
    assert sorted(map(str, catalogue.source_chunks(spark, "").collect())) == whole and len(whole) == 40
    assert sizes[0] > 700 and sizes[1] < 120


def test_store_and_stream(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    assert table.read_or_none() is None
    table.write(spark.range(3))
    old = table.read()
    table.write(spark.range(5))
    assert table.read().count() == 5 and old.count() == 3
    at = dt.datetime(2025, 1, 1)
    columns = "file_path string, blob_sha string, signature_hash string, chunk_count int, chunk_hashes_json string, indexed_at timestamp_ntz"
    for n, sha, day in ((0, "new", 5), (1, "late", 1)):
        spark.createDataFrame([("a", sha, "", 1, None, at + dt.timedelta(day)), (f"b{n}", "x", "", 1, None, at)], columns).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    state = VersionedTable(spark, str(tmp_path / "ledger"))
    source = upkeep.stream_folder(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, 1)
    upkeep.follow_ledger(source, state, str(tmp_path / "progress")).awaitTermination()
    assert {(r["file_path"], r["blob_sha"]) for r in state.read().collect()} == {("a", "new"), ("b0", "x"), ("b1", "x")}


@pytest.fixture
def project(tmp_path):
    root = tmp_path / "src"
    (root / "handlers").mkdir(parents=True)
    (root / "handlers" / "receipt.py").write_text("def upload_receipt(a):\n    \"\"\"Stores a receipt.\"\"\"\n    return a\n\n\ndef list_receipts():\n    return []\n")
    (root / "api.ts").write_text("import { x } from './x';\nexport async function fetchReceipt(id: string) { return id; }\n")
    (root / "db.sql").write_text("CREATE TABLE receipts (id int);\nSELECT 1;\n")
    (root / "blob.py").write_bytes(b"a = 1\x00")
    return root


def test_engine(spark, tmp_path, project):
    seen: list[str] = []

    def embed(texts):
        return hashed(16)(texts)

    settings = Settings(languages=("python", "typescript", "sql"), dimension=16, tag_rules=(("receipts", "[Rr]eceipt"),), scopes={"handlers/**": "backend"})
    engine = Engine(spark, str(tmp_path / "index"), settings, embed)
    first = {r["change"]: r["n"] for r in engine.index(str(project), "2025-01-01 00:00:00").collect()}
    assert first == {"new": 3}
    chunks = {r["symbol_name"]: r for r in engine.table("chunks").collect()}
    assert set(chunks) == {"upload_receipt", "list_receipts", "fetchReceipt", "receipts"}
    assert chunks["upload_receipt"]["scope"] == "backend" and chunks["upload_receipt"]["doc_comment"] == "Stores a receipt."
    found = engine.search_code("fetchReceipt", "v1", "2025-01-01 00:00:00").collect()
    assert found[0]["symbol_name"] == "fetchReceipt" and "fetchReceipt" in rendered([r.asDict() for r in found], "hybrid")
    assert {r["file_path"] for r in engine.search_code("receipt", "v1", "2025-01-01 00:00:00", scope="backend").collect()} == {"handlers/receipt.py"}
    assert engine.lookup_file("handlers/receipt.py").count() == 2 and engine.search_symbol("RECEIPT").count() == 4
    assert engine.get_related(path="handlers/receipt.py").count() == 2 and engine.index_status().head()["files"] == 3
    with pytest.raises(ValueError):
        engine.get_related()
    cached = engine.cached_search("receipt", "v1", "2025-01-01 00:00:00")
    assert engine.cached_search("receipt", "v1", "2025-01-01 01:00:00") == cached
    assert engine.table("exact_cache").head()["hit_count"] == 2

    # A change of a body keeps the vector, a removed file leaves every table.
    (project / "handlers" / "receipt.py").write_text("def upload_receipt(a):\n    return a + 1\n\n\ndef list_receipts():\n    return []\n")
    (project / "api.ts").unlink()
    second = {r["change"]: r["n"] for r in engine.index(str(project), "2025-01-02 00:00:00").collect()}
    assert second == {"content-only": 1, "deleted": 1, "unchanged": 1}
    assert {r["symbol_name"] for r in engine.table("chunks").collect()} == {"upload_receipt", "list_receipts", "receipts"}
    ids = {r["chunk_id"] for r in engine.table("chunks").collect()}
    for name in ("chunk_tags", "chunks_vec", "postings"):
        assert {r["chunk_id"] for r in engine.table(name).select("chunk_id").distinct().collect()} <= ids
    assert not seen
    again = Engine(spark, str(tmp_path / "fresh"), settings, embed)
    again.index(str(project), "2025-01-02 00:00:00")
    columns = ["chunk_id", "file_path", "symbol_name", "start_line", "content"]
    assert sorted(map(tuple, again.table("chunks").select(columns).collect())) == sorted(map(tuple, engine.table("chunks").select(columns).collect()))


def test_engine_cuts_long_chunks_and_keeps_what_sql_says(spark, tmp_path):
    root = tmp_path / "src"
    root.mkdir()
    (root / "long.py").write_text("def upload_receipt(a):\n" + "".join(f"    a += {i}\n" for i in range(600)) + "    return a\n")
    (root / "db.sql").write_text("-- Receipts of all shops.\nCREATE TABLE receipts (id UUID, body JSONB);\n")
    vague = lambda texts: np.array([[1.0, 0.1 * (t == "receipts"), 0.0] if len(t) < 20 else [0.0, 0.0, 1.0] for t in texts])
    engine = Engine(spark, str(tmp_path / "index"), Settings(languages=("python", "sql"), dimension=3, semantic_entries=1, stopwords=("receipts",)), vague)
    engine.index(str(root), "2025-01-01 00:00:00")
    chunks = {r["symbol_name"]: r for r in engine.table("chunks").collect()}
    assert set(chunks) == {"upload_receipt#part1", "upload_receipt#part2", "receipts"}
    first, second = chunks["upload_receipt#part1"], chunks["upload_receipt#part2"]
    assert (first["start_line"], first["end_line"], second["start_line"]) == (1, 512, 513) and len(first["content"].split("\n")) == 512
    assert chunks["receipts"]["doc_comment"] == "Receipts of all shops."
    tags = {r["tag"] for r in engine.table("chunk_tags").filter(F.col("chunk_id") == chunks["receipts"]["chunk_id"]).collect()}
    assert {"dialect:postgres", "sql-feature:jsonb", "sql-feature:uuid"} <= tags and "resource:receipts" not in tags

    # A similar query is answered from the cache, another version is not; the cache keeps to its size.
    cached = engine.cached_search("receipt", "v1", "2025-01-01 00:00:00")
    assert engine.cached_search("receipts", "v1", "2025-01-01 01:00:00") == cached
    assert [(r["query_text"], r["hit_count"]) for r in engine.table("semantic_cache").collect()] == [("receipt", 1)]
    engine.cached_search("receipts", "v2", "2025-01-01 01:00:00")
    assert engine.table("semantic_cache").count() == 1 and engine.table("exact_cache").count() == 2


def _tree(root, files):
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)


def test_engine_keeps_what_fails_and_rewrites_what_changed(spark, tmp_path, monkeypatch):
    from codequarry.functions import chunkers

    root = tmp_path / "p"
    _tree(root, {"a.py": "def one():\n    return 1\n", "b.py": "def two():\n    return 2\n", "skipped/c.py": "def three():\n    pass\n", ".gitignore": "skipped/\n"})
    engine = Engine(spark, str(tmp_path / "i"), Settings(languages=("python",)))
    assert {r["change"]: r["n"] for r in engine.index(str(root), "2025-01-01 00:00:00").collect()} == {"new": 2}
    assert {r["file_path"] for r in engine.table("files").collect()} == {"a.py", "b.py"}
    row = engine.table("index_ledger").filter("file_path = 'a.py'").head()
    assert '"key"' in row["chunk_hashes_json"] and len(row["signature_hash"]) == 64
    first = engine.store.manifest()[1]

    # A file that fails keeps its chunks, is counted, and is tried again.
    usual = chunkers.chunked
    failing = lambda files: usual(files).withColumn("error", F.when(F.col("file_path") == "a.py", "broken").otherwise(F.col("error")))
    _tree(root, {"a.py": "def one_b():\n    return 1\n"})
    monkeypatch.setattr(chunkers, "chunked", failing)
    assert {r["change"]: r["n"] for r in engine.index(str(root), "2025-01-02 00:00:00").collect()} == {"content-only": 1, "unchanged": 1, "error": 1}
    assert {r["symbol_name"] for r in engine.table("chunks").collect()} == {"one", "two"}
    monkeypatch.setattr(chunkers, "chunked", usual)
    told = []
    assert {r["change"]: r["n"] for r in engine.index(str(root), "2025-01-03 00:00:00", progress=told.append).collect()} == {"content-only": 1, "unchanged": 1}
    assert {r["symbol_name"] for r in engine.table("chunks").collect()} == {"one_b", "two"} and len(told) >= 4
    # Only the bucket of the changed file is another folder.
    last = engine.store.manifest()[1]
    for name in ("chunks", "chunks_vec", "chunk_tags", "postings", "files", "index_ledger"):
        assert sum(first[name][b] != last[name][b] for b in first[name] if b != "schema") == 1
    assert engine.search_code("one_b", "v", "2025-01-03 00:00:00").head()["symbol_name"] == "one_b"
    status = engine.index_status("2025-01-03 00:00:00").head()
    assert status["languages"] == {"python": 2} and status["files"] == 2 and status["exact_entries"] == 0 and status["schema_version"] >= 1
    assert "one_b" in engine.described_file("a.py") and engine.described_file("x.py").endswith("[not indexed]")
    # Of two writers that began from the same version, the later one fails.
    from codequarry.store import ConcurrentWrite

    base = engine.store.manifest()[0]
    engine.store.commit({"notes": spark.range(1)}, base=base)
    with pytest.raises(ConcurrentWrite):
        engine.store.commit({"notes": spark.range(2)}, base=base)
    assert engine.table("notes").count() == 1 and engine.table("chunks").count() == 2


def test_engine_follows_a_diff(spark, tmp_path):
    root = tmp_path / "p"
    _tree(root, {"a.py": "def one():\n    return 1\n", "b.py": "def two():\n    return 2\n", "c.py": "def three():\n    return 3\n", "d.py": "def four():\n    pass\n"})
    calls = []

    def counting(texts):
        calls.extend(texts)
        return np.ones((len(texts), 4), np.float32)

    engine = Engine(spark, str(tmp_path / "i"), Settings(languages=("python",), dimension=4), counting)
    engine.index(str(root), "2025-01-01 00:00:00")
    ids = {r["symbol_name"]: r["chunk_id"] for r in engine.table("chunks").collect()}
    (root / "a.py").rename(root / "moved.py")
    (root / "b.py").unlink()
    _tree(root, {"c.py": "def three_b():\n    return 3\n", "d.py": "def changed_but_not_told():\n    pass\n"})
    lines = spark.createDataFrame([("R100\ta.py\tmoved.py",), ("D\tb.py",), ("M\tc.py",)], "value string")
    got = {r["change"]: r["n"] for r in engine.index(str(root), "2025-01-02 00:00:00", diff=lambda: lines).collect()}
    assert got == {"renamed": 1, "deleted": 1, "content-only": 1, "unchanged": 1}
    chunks = {r["symbol_name"]: r for r in engine.table("chunks").collect()}
    assert {n: r["file_path"] for n, r in chunks.items()} == {"one": "moved.py", "three_b": "c.py", "four": "d.py"} and chunks["one"]["chunk_id"] == ids["one"]
    assert {r["file_path"] for r in engine.table("index_ledger").collect()} == {"moved.py", "c.py", "d.py"}
    # Without an answer all files are compared.
    said = []

    def fails():
        raise OSError("no git here")

    got = {r["change"]: r["n"] for r in engine.index(str(root), "2025-01-03 00:00:00", diff=fails, keep=lambda p: p != "c.py", progress=said.append).collect()}
    assert got == {"deleted": 1, "content-only": 1, "unchanged": 1} and "no git here" in said[0]
    assert {r["symbol_name"] for r in engine.table("chunks").collect()} == {"one", "changed_but_not_told"}


def test_command_line(spark, tmp_path, capsys):
    from codequarry.__main__ import main

    root = tmp_path / "p"
    _tree(root, {"a.js": "function one() {\n  return 1;\n}\n"})
    assert main(["--root", str(root), "--home", str(tmp_path / "i")]) == 0 and "new=1" in capsys.readouterr().out
    (tmp_path / "bad.json").write_text("{")
    assert main(["--root", str(root), "--home", str(tmp_path / "i"), "--config", str(tmp_path / "bad.json")]) == 2
