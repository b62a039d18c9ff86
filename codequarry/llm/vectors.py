"""The most similar vectors of every vector, by collision counting (problem 5).

Every vector is hashed on single random projections: a sketch holds the side of
``PROJECTIONS`` of them, and two vectors collide on those where they lie on the same
side. There are ``ARRAYS`` sorted arrays, each over all vectors: a vector's key is
the sequence of the strongest projections of several random rotations, so that the
vectors around its place share a prefix of it. In each array a window around the
place of every query is looked through; virtual rehashing widens it for the queries
that have not met enough near vectors yet. Pairs whose collisions exceed the
threshold in any window are verified by their cosine.

Spark partitions the arrays by range, so a window is local, its size does not depend
on the number of vectors, and a dense region is split like any other. The result is
approximate; ``measured_recall`` in the tests holds it against brute force.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Sorted arrays, and hash values of a key.
ARRAYS, DEPTH = 12, 4
#: Projections whose collisions are counted.
PROJECTIONS = 128
#: The collision threshold lies so many deviations below the mean of two vectors at the least wanted similarity.
SIGMAS = 2.0
#: Virtual rehashing: how far each round's window reaches to either side, in places.
ROUNDS = (64, 256)
#: A query is done once it has met ``k`` vectors with the collisions of this share of the widest radius.
NEAR = 0.5
#: Rows of an array that are looked through at once.
STRETCH = 1 << 16


def usable_vectors(vectors: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """``id, vkey, v``: rows with ``dim`` finite components, not all zero.

    ``vkey`` is a hash of the components; ``v`` holds them as multiples of the
    largest one's 32,767th part, two bytes each: cosines keep five decimals.
    """

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            col = b.column(1)
            sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(col), -1))
            right = pa.array(sizes == dim)
            ids, flat = b.column(0).filter(right), col.filter(right).flatten()
            x = np.asarray(flat.cast(pa.float32()).fill_null(float("nan")), dtype=np.float32).reshape(-1, dim) + np.float32(0)
            good = np.isfinite(x).all(1) & (x != 0).any(1)
            x, ids = np.ascontiguousarray(x[good]), ids.filter(pa.array(good))
            keys = np.fromiter((xxhash.xxh3_64_intdigest(r) for r in map(memoryview, x)), np.uint64, len(x)).view(np.int64)
            short = np.rint(x / np.abs(x).max(1, keepdims=True, initial=1e-45).astype(np.float64) * 32_767).astype(np.int16)
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(keys), _bytes(short)], ["id", "vkey", "v"])

    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("e")).filter("id is not null").mapInArrow(keep, "id long, vkey long, v binary")


def _bytes(rows: np.ndarray) -> pa.Array:
    """One binary value a row."""
    width = rows.shape[1] * rows.itemsize
    at = np.arange(0, (len(rows) + 1) * width, width, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _unit(col: pa.Array, dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(col.to_pylist()), np.int16).reshape(-1, dim).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _hashed(dim: int):
    """Arrow function: rows of ``key, vkey, s0, s1``, a row for each vector and array. The key begins with the number of the array."""
    rng = np.random.default_rng(5)
    rotations = [np.linalg.qr(rng.standard_normal((dim, dim)))[0].astype(np.float32) for _ in range(ARRAYS)]
    axes = rng.standard_normal((dim, PROJECTIONS)).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # Copies within a batch go here already, so that a vector of many ids is a few rows only.
            first = np.unique(np.asarray(b.column("vkey")), return_index=True)[1]
            b = b.take(pa.array(first))
            if not b.num_rows:
                continue
            unit, vkey = _unit(b.column("v"), dim), b.column("vkey")
            sketch = np.packbits(unit @ axes > 0, axis=1).view(np.int64)
            strongest = []
            for r in rotations:
                y = unit @ r
                at = np.abs(y).argmax(1)
                strongest.append(2 * at + (y[np.arange(len(y)), at] < 0))
            for j in range(ARRAYS):
                key = np.full(b.num_rows, j, np.int64)
                for step in range(DEPTH):
                    key = key * (2 * dim) + strongest[(j + step * (step + 1) // 2) % ARRAYS]
                yield pa.RecordBatch.from_arrays([pa.array(key), vkey, pa.array(sketch[:, 0]), pa.array(sketch[:, 1])], ["key", "vkey", "s0", "s1"])

    return run, "key long, vkey long, s0 long, s1 long"


def collisions(similarity: float, sigmas: float = 0.0) -> int:
    """The number of projections on which vectors of a similarity collide, less so many deviations."""
    p = 1 - math.acos(similarity) / math.pi
    return math.ceil(PROJECTIONS * p - sigmas * math.sqrt(PROJECTIONS * p * (1 - p)))


def _look(k: int, least: float, dim: int):
    """Arrow function over rows in the order of their keys: pairs ``a < b`` that collide often enough within a window."""
    enough, near = collisions(least, SIGMAS), collisions(1 - (1 - least) * NEAR)
    one_array, reach = (2 * dim) ** DEPTH, ROUNDS[-1]

    def pairs(key: np.ndarray, vkey: np.ndarray, sketch: np.ndarray, met: np.ndarray, until: int) -> tuple[np.ndarray, np.ndarray]:
        """Compares the first ``until`` rows with those that follow; ``met`` counts the near vectors of each row."""
        array, found, before = key // one_array, [], 0
        for after in ROUNDS:
            done = met >= k
            for step in range(before + 1, after + 1):
                n = min(until, len(key) - step)
                if n <= 0:
                    break
                if before:
                    a = np.flatnonzero(~(done[:n] & done[step : n + step]) & (array[:n] == array[step : n + step]))
                else:
                    a = np.flatnonzero(array[:n] == array[step : n + step])
                same = PROJECTIONS - np.bitwise_count(sketch[a] ^ sketch[a + step]).sum(1, dtype=np.int64)
                hit = same >= enough
                close = a[same >= near]
                np.add.at(met, close, 1)
                np.add.at(met, close + step, 1)
                found.append(np.stack([a[hit], a[hit] + step]))
            before = after
        at = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
        x, y = vkey[at[0]], vkey[at[1]]
        both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
        return both[0], both[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, 2), np.uint64), np.empty(0, np.int64)]

        def emit(last: bool) -> pa.RecordBatch:
            key, vkey, sketch, met = held
            # Copies stand side by side; those looked at before stand first.
            new = np.r_[True, (key[1:] != key[:-1]) | (vkey[1:] != vkey[:-1])] if len(key) else np.empty(0, bool)
            key, vkey, sketch, met = key[new], vkey[new], sketch[new], met[new]
            until = len(key) if last else max(0, len(key) - reach)
            a, b = pairs(key, vkey, sketch, met, until)
            held[:] = [key[until:], vkey[until:], sketch[until:], met[until:]]
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for b in batches:
            c = [np.asarray(x) for x in b.columns]
            new = [c[0], c[1], np.stack([c[2], c[3]], axis=1).view(np.uint64), np.zeros(len(c[0]), np.int64)]
            held[:] = [np.concatenate(x) for x in zip(held, new, strict=True)]
            if len(held[0]) > STRETCH:
                yield emit(False)
        yield emit(True)

    return run


def _cosines(least: float, dim: int):
    """Arrow function: pairs with both vectors, kept if their cosine is at least ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = _unit(b.column("x"), dim).astype(np.float64), _unit(b.column("y"), dim).astype(np.float64)
                sim = np.einsum("ij,ij->i", x, y)
                ok = pa.array(sim >= least)
                yield pa.RecordBatch.from_arrays([b.column("a").filter(ok), b.column("b").filter(ok), pa.array(sim).filter(ok)], ["a", "b", "similarity"])

    return run


def similar_pairs(rows: DataFrame, k: int, least: float, dim: int) -> DataFrame:
    """``a, b, similarity`` of the pairs of distinct vectors ``vkey, v`` that the windows find."""
    hashed, schema = _hashed(dim)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    arrays = rows.select("vkey", "v").mapInArrow(hashed, schema).repartitionByRange(parts, "key", "vkey").sortWithinPartitions("key", "vkey")
    # Partitioned by one side, pairs that several arrays find are told apart where they are joined.
    pairs = arrays.mapInArrow(_look(k, least, dim), "a long, b long").repartition("a").dropDuplicates(["a", "b"])
    each = rows.groupBy("vkey").agg(F.first("v").alias("v"))
    full = pairs.join(each.select(F.col("vkey").alias("a"), F.col("v").alias("x")), "a").join(each.select(F.col("vkey").alias("b"), F.col("v").alias("y")), "b")
    return full.select("a", "b", "x", "y").mapInArrow(_cosines(least, dim), "a long, b long, similarity double")


def most_similar(vectors: DataFrame, k: int = 5, min_similarity: float = 0.85, dim: int = 64, id_col: str = "chunk_id", vec_col: str = "embedding") -> DataFrame:
    """``id_col, neighbour, similarity, rank``: for each usable vector its ``k`` most similar others by cosine, of at least ``min_similarity``.

    Vectors that are null, of another length, all zero or hold nulls, NaN or
    infinities are left out, as are null ids. A repeated id counts once (the
    smallest hash of its vectors). Equal vectors under several ids are compared
    once and are each other's neighbours at similarity 1. Ties go to the smaller
    hash of the vector, among equal vectors to the smaller id. Other columns are
    ignored; an empty table gives no rows.
    """
    rows = usable_vectors(vectors, id_col, vec_col, dim)
    two = F.explode(F.array(F.struct(F.col("a").alias("vkey"), F.col("b").alias("other")), F.struct(F.col("b").alias("vkey"), F.col("a").alias("other"))))
    near = similar_pairs(rows, k, min_similarity, dim).select(two.alias("p"), "similarity").select("p.*", "similarity")
    best = Window.partitionBy("vkey").orderBy(F.desc("similarity"), "other")
    near = near.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k)

    ids = rows.groupBy("id").agg(F.min("vkey").alias("vkey"))
    # The smallest ids of each vector are enough to fill k places.
    few = ids.withColumn("n", F.row_number().over(Window.partitionBy("vkey").orderBy("id"))).filter(F.col("n") <= k + 1).drop("n")
    few = few.select(F.col("vkey").alias("other"), F.col("id").alias("neighbour"))
    equal = few.select(F.col("other").alias("vkey"), "other", "neighbour", F.lit(1.0).alias("similarity"), F.lit(0).alias("place"))
    offers = near.join(few, "other").select("vkey", "other", "neighbour", "similarity", "place").unionByName(equal)
    # Up to k + 1 offers of a vector, the equal ones first; each of its ids takes k of them.
    order = Window.partitionBy("vkey").orderBy("place", "neighbour")
    offers = offers.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1).groupBy("vkey").agg(F.sort_array(F.collect_list(F.struct("n", "neighbour", "similarity"))).alias("offers"))
    own = ids.join(offers, "vkey")
    taken = own.select(F.col("id").alias(id_col), F.posexplode(F.expr(f"slice(filter(offers, o -> o.neighbour != id), 1, {k})")).alias("at", "o"))
    return taken.select(id_col, "o.neighbour", "o.similarity", (F.col("at") + 1).alias("rank"))

