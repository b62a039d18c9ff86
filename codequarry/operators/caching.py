"""Result caches as tables: exact by key, semantic by vector; time and version are arguments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.functions.vectors import cosine_of_distance, l2_distance

#: Least similarity of a semantic hit, entries kept, hours an entry lives.
THRESHOLD, MOST_ENTRIES, TTL_HOURS = 0.95, 1_000, 24


def exact_entries(results: DataFrame, now: Column, ttl_hours: int = TTL_HOURS) -> DataFrame:
    """New entries of the exact cache from ``query_hash, query_text, result_json, version_sha``: counted as used once."""
    return results.select("query_hash", "query_text", "result_json", "version_sha", F.lit(1).cast("long").alias("hit_count"), now.alias("created_at"), (now + F.make_interval(hours=F.lit(ttl_hours))).alias("expires_at"))


def exact_put(cache: DataFrame, entries: DataFrame) -> DataFrame:
    """The cache after a put: a known key keeps its count, text and creation time and takes the new result, version and expiry. Of equal new keys the greatest result counts."""
    new = entries.groupBy("query_hash").agg(F.max(F.struct("result_json", "version_sha", "query_text", "hit_count", "created_at", "expires_at")).alias("n"))
    old = cache.select("query_hash", F.struct(*(c for c in cache.columns if c != "query_hash")).alias("o"))
    both = old.join(new, "query_hash", "full_outer")
    kept = lambda c: F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c)
    fresh = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c)
    return both.select("query_hash", kept("query_text"), fresh("result_json"), fresh("version_sha"), kept("hit_count"), kept("created_at"), fresh("expires_at"))


def exact_hits(lookups: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """``lookup_id, query_hash, result_json, hit_count`` of the lookups (``lookup_id, query_hash, version_sha``) that hit a live entry of their version; the count is the one after this look."""
    live = cache.filter(F.col("expires_at") > now)
    return lookups.join(live, ["query_hash", "version_sha"]).select("lookup_id", "query_hash", "result_json", (F.col("hit_count") + 1).alias("hit_count"))


def counted_hits(cache: DataFrame, hits: DataFrame) -> DataFrame:
    """The cache with each entry's count raised by its number of hits."""
    n = hits.groupBy("query_hash").agg(F.count("*").alias("_n"))
    return cache.join(n, "query_hash", "left").withColumn("hit_count", F.col("hit_count") + F.coalesce("_n", F.lit(0))).select(cache.columns)


def purged(cache: DataFrame, now: Column) -> DataFrame:
    """Without expired entries; one that expires right now stays."""
    return cache.filter(~(F.col("expires_at") < now))


def of_version(cache: DataFrame, version: Column) -> DataFrame:
    """Without entries of other versions."""
    return cache.filter(F.col("version_sha") == version)


def cache_stats(cache: DataFrame, now: Column) -> DataFrame:
    """One row: entries, expired ones and the sum of hits; 0 for an empty cache."""
    return cache.agg(F.count("*").alias("entries"), F.count_if(F.col("expires_at") < now).alias("expired"), F.coalesce(F.sum("hit_count"), F.lit(0)).alias("hits"))


def semantic_hits(lookups: DataFrame, cache: DataFrame, now: Column, threshold: float = THRESHOLD, over_fetch: int | None = None) -> DataFrame:
    """``lookup_id, entry_id, similarity``: the nearest live entry of the same version, mode, limit and scope (null matches null), if it is similar enough.

    Lookups have ``lookup_id, embedding, version_sha, scope, mode, limit_n``; so have
    entries, with ``entry_id, expires_at``. Unit vectors. The cache holds a bounded
    number of entries, so it is the side that is sent. ``over_fetch``: filter only
    the so many nearest entries of any kind.
    """
    entries = cache.select("entry_id", F.col("embedding").alias("_e"), F.col("version_sha").alias("_v"), F.col("scope").alias("_s"), F.col("mode").alias("_m"), F.col("limit_n").alias("_l"), "expires_at")
    same = (F.col("version_sha") == F.col("_v")) & F.col("scope").eqNullSafe(F.col("_s")) & (F.col("mode") == F.col("_m")) & (F.col("limit_n") == F.col("_l")) & (F.col("expires_at") > now)
    order = Window.partitionBy("lookup_id").orderBy("distance", "entry_id")
    if over_fetch is None:
        pairs = lookups.join(entries, same).withColumn("distance", l2_distance(F.col("embedding"), F.col("_e")))
    else:
        pairs = lookups.crossJoin(entries).withColumn("distance", l2_distance(F.col("embedding"), F.col("_e")))
        pairs = pairs.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= over_fetch).filter(same)
    first = pairs.withColumn("_n", F.row_number().over(order)).filter("_n = 1")
    return first.withColumn("similarity", cosine_of_distance(F.col("distance"))).filter(F.col("similarity") >= threshold).select("lookup_id", "entry_id", "similarity")


def evicted(cache: DataFrame, most: int = MOST_ENTRIES) -> DataFrame:
    """The cache cut to ``most`` entries: those used least go first, of them the oldest, of them the smallest id."""
    return cache.orderBy(F.desc("hit_count"), F.desc("created_at"), F.desc("entry_id")).limit(most)
