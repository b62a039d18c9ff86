"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the cores. Each query runs twice on
a warm session, each time with a fresh plan, and the better time counts.
"""

from __future__ import annotations

import json
import os
import time

from codequarry.plans import catalogue
from codequarry.session import get_spark

try:
    from codequarry.llm import queries as corpus
except ImportError:
    corpus = None

HEADLINE = ["knn_search", "bm25_search", "hybrid_search", "related_by_chunk", "lookup_file", "search_symbol", "index_totals", "ledger_changes", "chunk_reuse", "chunk_tag_rows", "source_chunks", "cache_hits"]
CORPUS = ["p1_found", "p2_found", "p3_found", "p4_found", "p5_found", "p6_found", "p7_found", "p8_ids", "p9_mix", "p10_found"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_spark("bench", cpus, cpus)
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalogue.queries() | (corpus.queries() if corpus else {})
    names = HEADLINE + (CORPUS if corpus else [])
    times: dict[str, float] = {}
    queries["index_totals"](spark, folder).collect()
    # One hybrid query, warm, on an index that is already there.
    from codequarry.operators import search
    from codequarry.session import read_table, staged

    chunks = staged(read_table(spark, folder, "chunks").dropDuplicates(["chunk_id"]), "chunks")
    vectors = staged(read_table(spark, folder, "chunks_vec").dropDuplicates(["chunk_id"]), "vectors")
    began = time.time()
    index = search.built_index(chunks)
    times["index_build"] = round(time.time() - began, 3)
    queries["hybrid_one_query"] = lambda s, _: search.hybrid(s.createDataFrame([(1, "resolve_token harbor", [0.125] * 64)], "query_id long, query string, embedding array<float>"), chunks, vectors, index, distinct=True)
    names = ["hybrid_one_query", *names]
    for name in names:
        best = float("inf")
        for _ in range(2):
            began = time.time()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            best = min(best, time.time() - began)
        times[name] = round(best, 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder)}))


if __name__ == "__main__":
    main()
