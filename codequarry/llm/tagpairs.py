"""All pairs of records with similar weighted sets, by sketch forests (problem 4).

Equal sets are one class. Each class has a minhash signature of its weighted set,
``TREES`` sequences of ``DEEPEST`` values. A tree is the classes in the order of
their sequences; classes with a common prefix are neighbours. Prefixes start
``SHALLOWEST`` long; a neighbourhood of over ``WIDE`` classes is deepened by one
value at a time, as far as the expected recall at the threshold still reaches the
target. Whatever is still wide then is compared whole, block by block. A sketch of
64 bits turns away unlike pairs inside the join; the rest are verified exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.buckets import candidate_pairs, counted, expand_classes, hot_apart, sized
from codequarry.session import staged

TREES, SHALLOWEST, WIDE = 26, 4, 40
#: Expected share of pairs at the threshold that the deepest prefix must still find.
TARGET_RECALL = 0.985
#: A pair whose 64-bit sketches differ in more bits is turned away: five deviations off at the threshold of 0.75.
SKETCH_SIGMAS = 5.0


def deepest(threshold: float) -> int:
    """The longest prefix whose trees still find a pair at the threshold with the target probability."""
    depth = SHALLOWEST
    while depth < 8 and 1 - (1 - threshold ** (depth + 1)) ** TREES >= TARGET_RECALL:
        depth += 1
    return depth


def weighted_sets(tags: DataFrame, id_col: str = "chunk_id", tag_col: str = "tag", weight_col: str = "weight") -> DataFrame:
    """``id, items``: each record's tags (64-bit hashes) with their weights, sorted.

    Tags are trimmed of white space and lower-cased; null and blank ones and null
    ids are left out. A repeated tag has its largest weight; a null weight counts 1,
    a negative one 0.
    """
    name = F.lower(F.regexp_replace(F.col(tag_col), r"(?U)^\s+|\s+$", ""))
    weight = F.greatest(F.lit(0), F.coalesce(F.col(weight_col), F.lit(1)).cast("int"))
    rows = tags.select(F.col(id_col).alias("id"), name.alias("tag"), weight.alias("w")).filter("id is not null and tag <> ''")
    # One shuffle by id serves both aggregations.
    rows = rows.repartition("id").groupBy("id", F.xxhash64("tag").alias("t")).agg(F.max("w").alias("w"))
    return rows.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("t", "w"))).alias("items"))


def _signatures(depth: int):
    """Arrow function: per class the hashes of its prefixes in each tree, and the sketch."""
    rng = np.random.default_rng(4)
    mult = rng.integers(0, 1 << 63, TREES * depth + 64, np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 1 << 63, TREES * depth + 64, np.uint64)

    def mix(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))

    def chance(x: np.ndarray) -> np.ndarray:
        """Numbers between 0 and 1, without either."""
        return ((x >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52

    def least_unit(seed: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The least of as many chance numbers as each tag weighs. Only the numbers below all before them are drawn, and how far apart they stand: a few, whatever the weight."""
        value, seed = chance(seed), seed.copy()
        rows = np.flatnonzero(weight > 1)
        at = np.ones(len(rows))
        while len(rows):
            seed[rows] = mix(seed[rows] + np.uint64(0x9E3779B97F4A7C15))
            at += 1 + np.floor(np.log(chance(seed[rows])) / np.log1p(-value[rows]))
            within = at <= weight[rows]
            rows, at = rows[within], at[within]
            value[rows] *= chance(mix(seed[rows] ^ np.uint64(0xD6E8FEB86659FD93)))
        return value

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = ["cls", "sketch", "key", "deeper"]
        for b in batches:
            for s in range(0, b.num_rows, 4096):
                part = b.slice(s, 4096)
                items = part.column("items")
                sizes = np.asarray(pa.compute.list_value_length(items))
                flat = items.flatten()
                tag = np.asarray(flat.field("t")).view(np.uint64)
                weight = np.asarray(flat.field("w"))
                owner = np.repeat(np.arange(len(sizes)), sizes)
                counts = weight > 0
                tag, weight, owner = mix(tag[counts]), weight[counts], owner[counts]
                if not len(owner):
                    continue
                starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                least = np.stack([mix(np.minimum.reduceat(least_unit(mix(tag * m + a), weight), starts).view(np.uint64)) for m, a in zip(mult, add, strict=True)], axis=1)
                cls = np.asarray(part.column("cls"))[owner[starts]]
                bits = (least[:, -64:] >> np.uint64(17)) & np.uint64(1)
                sketch = (bits << np.arange(64, dtype=np.uint64)).sum(1, dtype=np.uint64).view(np.int64)
                for tree in range(TREES):
                    key, deeper = np.full(len(cls), tree + 1, np.uint64), np.zeros(len(cls), np.uint64)
                    for d in range(depth):
                        value = least[:, tree * depth + d]
                        if d < SHALLOWEST:
                            key = mix(key * np.uint64(31) + value)
                        else:
                            deeper |= (value >> np.uint64(40) & np.uint64(0xFFFF)) << np.uint64(16 * (d - SHALLOWEST))
                    yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array(sketch), pa.array(key.view(np.int64)), pa.array(deeper.view(np.int64))], fields)

    return sign, "cls long, sketch long, key long, deeper long"


def similar_sets(sets: DataFrame, threshold: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """Of ``id, items``: the pairs of classes ``a, b, similarity`` at or above the threshold, and the members ``id, cls``.

    Similarity is the sum of the smaller weights divided by that of the larger ones.
    Members of one class have equal sets. Sets whose weights are all 0 are like no other.
    """
    members = staged(sets.select("id", F.xxhash64("items").alias("cls"), "items"), "sets")
    classes = members.dropDuplicates(["cls"]).select("cls", "items")
    depth = deepest(threshold)
    sign, schema = _signatures(depth)
    usual, hot = hot_apart(classes.mapInArrow(sign, schema), "key")

    def deepened(rows: DataFrame, count: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
        for d in range(SHALLOWEST, depth):
            # 16 bits of the next value deepen the prefix.
            value = F.shiftright("deeper", 16 * (d - SHALLOWEST)).bitwiseAND(F.lit(0xFFFF))
            rows = rows.withColumn("key", F.when(F.col("n") > WIDE, F.xxhash64("key", value, F.lit(d))).otherwise(F.col("key")))
            rows = count(rows.drop("n"), "key")
        return rows.select("key", "n", "cls", "sketch")

    rows = deepened(counted(usual, "key"), counted)
    if hot is not None:
        # Neighbourhoods too wide for one task deepen by the same steps; only their sizes are counted in another way.
        rows = rows.unionByName(deepened(hot, sized))
    bits, spread = 64 * (1 - threshold) / 2, (64 * (1 + threshold) / 2 * (1 - threshold) / 2) ** 0.5
    pairs = candidate_pairs(rows, "key", "cls", "sketch", int(bits + SKETCH_SIGMAS * spread))
    verified = (
        pairs.join(classes.select(F.col("cls").alias("a"), F.col("items").alias("x")), "a")
        .join(classes.select(F.col("cls").alias("b"), F.col("items").alias("y")), "b")
        .withColumn("shared", F.expr("aggregate(x, 0L, (s, i) -> s + least(i.w, coalesce(get(filter(y, j -> j.t = i.t), 0).w, 0)))"))
        .withColumn("both", F.expr("aggregate(x, 0L, (s, i) -> s + i.w) + aggregate(y, 0L, (s, i) -> s + i.w) - shared"))
        .select("a", "b", (F.col("shared") / F.col("both")).alias("similarity"))
        .filter(F.col("similarity") >= threshold)
    )
    return verified, members.select("id", "cls")


def similar_tag_sets(tags: DataFrame, known: DataFrame, threshold: float = 0.75, min_tags: int = 4, id_col: str = "chunk_id") -> DataFrame:
    """``chunk_id_a, chunk_id_b``: all pairs of records that occur in ``known``, have at least ``min_tags`` tags and whose weighted sets are similar.

    Empty tables give no pairs. Repeated rows of ``known`` count once.
    """
    sets = weighted_sets(tags, id_col).filter(F.size("items") >= min_tags)
    sets = sets.join(known.select(F.col(id_col).alias("id")), "id", "left_semi")
    pairs, members = similar_sets(sets, threshold)
    return expand_classes(pairs, members, "cls", "id", ("chunk_id_a", "chunk_id_b"))
