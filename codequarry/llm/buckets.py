"""Comparing the rows of hash buckets without handing a hot bucket to one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codequarry.session import staged

#: Rows of a bucket that are compared at once; a larger bucket is cut into blocks, and every pair of blocks is compared on its own.
BLOCK = 2_000
#: Hot keys are sent to all tasks up to this number; more of them are joined by a shuffle.
MOST_SENT = 100_000


def counted(rows: DataFrame, key: str, name: str = "n") -> DataFrame:
    """``rows`` with the size of their bucket; rows that are alone are dropped. Meant for buckets of bounded size: all rows of one pass through one task."""
    return rows.withColumn(name, F.count("*").over(Window.partitionBy(key))).filter(F.col(name) > 1)


def hot_apart(rows: DataFrame, key: str, block: int = BLOCK) -> tuple[DataFrame, DataFrame | None]:
    """The rows of buckets of up to ``block`` rows, and those of larger ones with their size ``n``, if there are any. Sizes are summed before they are shuffled."""
    hot = staged(rows.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > block), "hot")
    many = hot.count()
    if not many:
        return rows, None
    side = F.broadcast(hot) if many <= MOST_SENT else hot
    return rows.join(side.select(key), key, "left_anti"), rows.join(side, key)


def sized(rows: DataFrame, key: str, block: int = BLOCK) -> DataFrame:
    """``rows`` with the size ``n`` of their bucket, without those that are alone."""
    usual, hot = hot_apart(rows, key, block)
    usual = counted(usual, key)
    return usual if hot is None else usual.unionByName(hot.select(usual.columns))


def blocked(rows: DataFrame, key: str, id_col: str, size: str = "n", block: int = BLOCK) -> DataFrame:
    """Adds ``bi, bj, block``: each row once for every pair of blocks that its own block is part of; buckets of up to ``block`` rows have one block."""
    parts = F.ceil(F.col(size) / block).cast("int")
    own = F.when(parts > 1, F.pmod(F.xxhash64(id_col, F.lit(3)), parts)).otherwise(0).cast("int")
    spread = rows.withColumn("block", own).withColumn("_with", F.explode(F.sequence(F.lit(0), parts - 1)))
    return spread.withColumn("bi", F.least("block", "_with")).withColumn("bj", F.greatest("block", "_with")).drop("_with")


def over_buckets(rows: DataFrame, key: str, columns: list[str], compare: Callable[[pa.Table, np.ndarray, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """Runs ``compare(table, starts, ends)`` over blocked rows in the order of their buckets and blocks, so that each pair of blocks is whole in one call.

    Rows stream through: as many buckets at a time as fit into some 50,000 rows.
    """
    names = [key, "bi", "bj", "block", *columns]

    def emit(t: pa.Table, last: bool) -> tuple[pa.RecordBatch | None, pa.Table]:
        k, bi, bj = (np.asarray(t[c]) for c in (key, "bi", "bj"))
        new = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])])
        ends = np.r_[new[1:], len(k)]
        if not last:
            new, ends = new[:-1], ends[:-1]
        if not len(new):
            return None, t
        return compare(t.slice(0, ends[-1]), new, ends), t.slice(ends[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            if b.num_rows:
                t = pa.Table.from_batches([b])
                held = t if held is None else pa.concat_tables([held, t]).combine_chunks()
                if held.num_rows > 50_000:
                    out, held = emit(held, False)
                    if out is not None:
                        yield out
        if held is not None and held.num_rows:
            out, _ = emit(held, True)
            if out is not None:
                yield out

    ordered = rows.select(*names).repartition(key, "bi", "bj").sortWithinPartitions(key, "bi", "bj")
    return ordered.mapInArrow(run, schema)


def candidate_pairs(rows: DataFrame, key: str, id_col: str, sketch: str, most_bits: int, block: int = BLOCK) -> DataFrame:
    """Distinct ``a, b`` (``a < b``) of rows (with bucket size ``n``) that share a bucket and whose 64-bit sketches differ in at most ``most_bits`` bits."""

    def compare(t: pa.Table, starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        ids, bits, blk = np.asarray(t[id_col]), np.asarray(t[sketch]).view(np.uint64), np.asarray(t["block"])
        cross = np.repeat((np.asarray(t["bi"]) != np.asarray(t["bj"]))[starts], ends - starts)
        until = np.repeat(ends, ends - starts)
        found: list[np.ndarray] = []
        at, step = np.arange(len(ids)), 1
        # Neighbours one place apart, then two, as far as the widest bucket goes.
        while len(at := at[at + step < until[at]]):
            other = at + step
            near = np.bitwise_count(bits[at] ^ bits[other]) <= most_bits
            near &= ~cross[at] | (blk[at] != blk[other])
            if near.any():
                x, y = ids[at[near]], ids[other[near]]
                found.append(np.stack([np.minimum(x, y), np.maximum(x, y)]))
            step += 1
        pairs = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.empty((2, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    return over_buckets(blocked(rows, key, id_col, "n", block), key, [id_col, sketch], compare, "a long, b long").distinct()


def expand_classes(pairs: DataFrame, members: DataFrame, cls: str, id_col: str, names: tuple[str, str]) -> DataFrame:
    """Pairs of ids from pairs of classes (``a, b``): all of one with all of the other, and all pairs within each class. The smaller id comes first."""
    one = members.select(F.col(cls).alias("a"), F.col(id_col).alias("x"))
    two = members.select(F.col(cls).alias("b"), F.col(id_col).alias("y"))
    across = pairs.select("a", "b").join(one, "a").join(two, "b").select(F.least("x", "y").alias(names[0]), F.greatest("x", "y").alias(names[1]))
    within = one.join(two, (F.col("a") == F.col("b")) & (F.col("x") < F.col("y"))).select(F.col("x").alias(names[0]), F.col("y").alias(names[1]))
    return across.unionByName(within)
