"""Near-duplicate records by signature trees (problem 6).

Records are sets of word shingles; equal sets are one class. There are ``TREES``
orders of the whole collection, each by the least ``LEAST`` shingle hashes under its
own hash function; classes that share them stand side by side, the others of an
order cannot meet there. A signature tree lies over the rows of an order: its leaves
hold a class's bitmap and size, its inner nodes the OR of the bitmaps below, the
range of their sizes and of their places in the order. A dual traversal of the tree
with itself follows a pair of nodes only while their places overlap and the largest
possible overlap of sets below them reaches the threshold. Surviving pairs are
verified on the whole texts. Two sets of similarity ``t`` meet in some tree with the
probability ``1 - (1 - t ** LEAST) ** TREES``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.llm.buckets import blocked, expand_classes, over_buckets, sized
from codequarry.session import staged

TREES, LEAST = 14, 2
#: Entries of a tree node, and bits of the nodes' bitmaps.
FANOUT, NODE_BITS = 4, 512
#: A class's own bitmap has at least so many bits a shingle, as a power of two.
BITS_EACH = 4
#: Pairs of nodes that are tested at once.
SLICE = 1 << 17

_TOKENS = re.compile(rb"[a-z0-9_]+")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str, words: int, known: dict[bytes, int]) -> np.ndarray:
    """The sorted distinct 64-bit hashes of all runs of ``words`` tokens; tokens are runs of ASCII letters, digits and underscores, lower-cased."""
    import xxhash

    # Lower-casing bytes changes ASCII letters only.
    found = _TOKENS.findall(text.encode("utf-8", "surrogatepass").lower())
    if len(found) < words:
        return np.empty(0, np.uint64)
    if len(known) > 500_000:
        known.clear()
    ids = []
    for w in found:
        h = known.get(w)
        if h is None:
            h = known[w] = xxhash.xxh3_64_intdigest(w)
        ids.append(h)
    one = np.array(ids, np.uint64)
    n = len(one) - words + 1
    run = one[:n].copy()
    for i in range(1, words):
        run = _mix(run) * np.uint64(0x9E3779B97F4A7C15) + one[i : i + n]
    run = np.sort(_mix(run))
    return run[np.r_[True, run[1:] != run[:-1]]]


def _bits(sizes: np.ndarray) -> np.ndarray:
    """The width of the bitmaps of sets, a power of two in proportion to their sizes."""
    return np.maximum(NODE_BITS, 1 << np.ceil(np.log2(np.maximum(sizes, 1) * BITS_EACH)).astype(np.int64))


def bitmap(members: np.ndarray, bits: int) -> bytes:
    """The bitmap of a set of hashes. Halves of it laid over each other are the bitmap of half the width."""
    out = np.zeros(bits, bool)
    out[(members >> np.uint64(3)).astype(np.int64) & (bits - 1)] = True
    return np.packbits(out).tobytes()


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps of equal width laid over themselves until they have so many 64-bit words."""
    while bits.shape[1] > words:
        bits = bits[:, : bits.shape[1] // 2] | bits[:, bits.shape[1] // 2 :]
    return bits


def _sign(words: int, least: int):
    """Arrow function: ``id, cls, size, bitmap, keys, text`` of every record with at least ``least`` shingles; the text is compressed."""
    rng = np.random.default_rng(6)
    mult = rng.integers(0, 1 << 31, TREES * LEAST, np.uint32) * np.uint32(2) + np.uint32(1)
    add = rng.integers(0, 1 << 31, TREES * LEAST, np.uint32)
    names = ["id", "cls", "size", "bitmap", "keys", "text"]

    def flush(ids: list[int], texts: list[str], sets: list[np.ndarray]) -> pa.RecordBatch:
        import xxhash

        sizes = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        starts = np.cumsum(sizes) - sizes
        half = (flat >> np.uint64(20)).astype(np.uint32)
        keys = np.empty((len(sets), TREES), np.uint64)
        for tree in range(TREES):
            key = np.full(len(sets), tree + 1, np.uint64)
            for j in range(tree * LEAST, (tree + 1) * LEAST):
                x = half * mult[j] + add[j]
                key = _mix(key * np.uint64(31) + np.minimum.reduceat(x ^ (x >> np.uint32(15)), starts).astype(np.uint64))
            keys[:, tree] = key
        cls = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
        maps = [bitmap(s, n) for s, n in zip(sets, _bits(sizes).tolist(), strict=True)]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, TREES, dtype=np.int32)), pa.array(keys.ravel().view(np.int64)))
        whole = [zlib.compress(t.encode("utf-8", "surrogatepass"), 1) for t in texts]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(cls), pa.array(sizes.astype(np.int32)), pa.array(maps, pa.binary()), lists, pa.array(whole, pa.binary())], names)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        ids, texts, sets, held = [], [], [], 0
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = shingle_set(text or "", words, known)
                if len(s) < least:
                    continue
                ids.append(key)
                texts.append(text)
                sets.append(s)
                held += len(s)
                if held > 400_000:
                    yield flush(ids, texts, sets)
                    ids, texts, sets, held = [], [], [], 0
        if ids:
            yield flush(ids, texts, sets)

    return sign, "id long, cls long, size int, bitmap binary, keys array<long>, text binary"


class Tree:
    """A signature tree over rows in their order; level 0 is the rows.

    A level has the ORs of bitmaps, the least and the greatest size, the most
    shingles beyond the set bits, and the first and the last ``place`` below each
    node; rows can only match rows of the same place.
    """

    def __init__(self, bits: np.ndarray, size: np.ndarray, place: np.ndarray):
        spare = size - np.bitwise_count(bits).sum(1)
        self.levels = [(bits, size, size, spare, place, place)]
        while len(self.levels[-1][1]) > 1:
            bits, low, high, spare, first, last = self.levels[-1]
            at = np.arange(0, len(low), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(bits, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(spare, at), np.minimum.reduceat(first, at), np.maximum.reduceat(last, at)))

    def matches(self, threshold: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int, int]]]:
        """Pairs of rows, each once, whose largest possible overlap reaches the threshold; and of each level the pairs of nodes that were met, those of overlapping places, whose bitmaps and sizes were tested, and those that were followed."""
        a = b = np.zeros(1 if len(self.levels[0][1]) else 0, np.int64)
        told = []
        for level in range(len(self.levels) - 1, -1, -1):
            bits, low, high, spare, first, last = self.levels[level]
            met = len(a)
            near = (first[a] <= last[b]) & (first[b] <= last[a])
            if not level:
                near &= a < b
            a, b = a[near], b[near]
            kept = []
            for s in range(0, len(a), SLICE):
                x, y = a[s : s + SLICE], b[s : s + SLICE]
                need = np.maximum(threshold / (1 + threshold) * (low[x] + low[y]), threshold * np.maximum(low[x], low[y]))
                ok = np.flatnonzero(np.minimum(high[x], high[y]) >= need - 1e-9)
                x, y, need = x[ok], y[ok], need[ok]
                most = np.bitwise_count(bits[x] & bits[y]).sum(1) + np.minimum(spare[x], spare[y])
                kept.append(ok[most >= need - 1e-9] + s)
            ok = np.concatenate(kept) if kept else np.empty(0, np.int64)
            told.append((level, met, len(a), len(ok)))
            a, b = a[ok], b[ok]
            if not level:
                break
            n = len(self.levels[level - 1][1])
            down = np.arange(FANOUT)
            x = np.broadcast_to((a[:, None] * FANOUT + down)[:, :, None], (len(a), FANOUT, FANOUT)).ravel()
            y = np.broadcast_to((b[:, None] * FANOUT + down)[:, None, :], (len(a), FANOUT, FANOUT)).ravel()
            ok = (x < n) & (y < n) & (x <= y)
            a, b = x[ok], y[ok]
        return a, b, told


def _tree_join(threshold: float, told: bool = False):
    """Over the rows of an order: candidate pairs of classes; or, of each level, how many pairs of nodes were met, tested and followed."""

    def compare(t: pa.Table, new: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        place = np.repeat(np.arange(len(new)), ends - new)
        size, block, cross = np.asarray(t["size"]), np.asarray(t["block"]), np.asarray(t["bi"]) != np.asarray(t["bj"])
        own = t["bitmap"].to_pylist()
        width = np.array([len(x) for x in own])
        bits = np.empty((len(own), NODE_BITS // 64), np.uint64)
        wide = {w: np.flatnonzero(width == w) for w in np.unique(width)}
        for w, at in wide.items():
            bits[at] = _folded(np.frombuffer(b"".join([own[i] for i in at]), np.uint64).reshape(len(at), -1), NODE_BITS // 64)
        order = np.lexsort((bits[:, 0], size, place))
        tree = Tree(bits[order], size[order], place[order])
        a, b, counts = tree.matches(threshold)
        if told:
            return pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*counts, strict=True)], ["level", "met", "tested", "followed"])
        a, b = order[a], order[b]
        ok = ~cross[a] | (block[a] != block[b])
        a, b = a[ok], b[ok]
        # Leaves are tested again on their own bitmaps, at the width of the narrower one.
        keep = np.zeros(len(a), bool)
        narrow = np.minimum(width[a], width[b])
        for w in np.unique(narrow):
            for part in np.array_split(np.flatnonzero(narrow == w), 1 + np.count_nonzero(narrow == w) * int(w) // (1 << 24)):
                x, y = (_at_width(own, width, side[part], int(w) // 8) for side in (a, b))
                both = np.bitwise_count(x & y).sum(1) + np.minimum(size[a[part]] - np.bitwise_count(x).sum(1), size[b[part]] - np.bitwise_count(y).sum(1))
                keep[part] = both >= threshold / (1 + threshold) * (size[a[part]] + size[b[part]]) - 1e-9
        cls = np.asarray(t["cls"])
        x, y = cls[a[keep]], cls[b[keep]]
        pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    return compare


def _at_width(own: list[bytes], width: np.ndarray, rows: np.ndarray, words: int) -> np.ndarray:
    out = np.empty((len(rows), words), np.uint64)
    for w in np.unique(width[rows]):
        at = np.flatnonzero(width[rows] == w)
        out[at] = _folded(np.frombuffer(b"".join([own[i] for i in rows[at]]), np.uint64).reshape(len(at), -1), words)
    return out


def _exact(threshold: float, words: int):
    """Arrow function: pairs with both texts, kept if the intersection of their sets has at least ``threshold`` times the size of the union."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for b in batches:
            sim, sets = np.zeros(b.num_rows), {}

            def members(cls: int, text: bytes) -> np.ndarray:
                found = sets.get(cls)
                if found is None:
                    found = sets[cls] = shingle_set(zlib.decompress(text).decode("utf-8", "surrogatepass"), words, known)
                return found

            left, right = b.column("a").to_pylist(), b.column("b").to_pylist()
            for i, (x, y) in enumerate(zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)):
                one, two = members(left[i], x), members(right[i], y)
                both = len(one) + len(two)
                shared = both - len(np.union1d(one, two))
                sim[i] = shared / (both - shared)
            ok = pa.array(sim >= threshold - 1e-12)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(ok), b.column("b").filter(ok), pa.array(sim).filter(ok)], ["a", "b", "similarity"])

    return verify


def signed_records(records: DataFrame, text: Column, words: int = 3, min_shingles: int = 25, id_col: str = "chunk_id") -> DataFrame:
    """``id, cls, size, bitmap, keys, text`` of the records that take part, staged."""
    sign, schema = _sign(words, min_shingles)
    return staged(records.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).filter("id is not null").mapInArrow(sign, schema), "signed")


def forest(signed: DataFrame) -> DataFrame:
    """The rows of all orders that share their place with another, with bitmap and size; places of too many rows are cut into pairs of blocks."""
    classes = signed.select("cls", "size", "bitmap", "keys").dropDuplicates(["cls"])
    rows = classes.select("cls", F.explode("keys").alias("key"))
    spread = blocked(sized(rows, "key"), "key", "cls").drop("n")
    return spread.join(signed.select("cls", "size", "bitmap").dropDuplicates(["cls"]), "cls")


def traversal_counts(signed: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``level, met, tested, followed``: the pairs of nodes of each level (0 is the leaves) that the traversal met, those whose largest possible overlap was computed, and those that reached the threshold."""
    counts = over_buckets(forest(signed), "key", ["cls", "size", "bitmap"], _tree_join(threshold, True), "level long, met long, tested long, followed long")
    return counts.groupBy("level").agg(*(F.sum(c).alias(c) for c in ("met", "tested", "followed")))


def near_duplicates(records: DataFrame, text: Column, threshold: float = 0.7, words: int = 3, min_shingles: int = 25, id_col: str = "chunk_id") -> tuple[DataFrame, DataFrame]:
    """The pairs of classes ``a, b, similarity`` at or above the threshold, and the members ``id, cls``.

    ``text`` is the column expression whose shingles of ``words`` tokens are compared.
    Members of a class have equal sets. Records with fewer than ``min_shingles``
    distinct shingles (null and empty texts, for instance) take no part, nor do null
    ids. A repeated id counts once for each different set it has.
    """
    signed = signed_records(records, text, words, min_shingles, id_col)
    members = signed.select("id", "cls").distinct()
    pairs = over_buckets(forest(signed), "key", ["cls", "size", "bitmap"], _tree_join(threshold), "a long, b long").distinct()
    texts = signed.select("cls", "text").dropDuplicates(["cls"])
    full = pairs.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("cls").alias("b"), F.col("text").alias("y")), "b")
    return full.select("a", "b", "x", "y").mapInArrow(_exact(threshold, words), "a long, b long, similarity double"), members


def chunk_text() -> Column:
    """Signature and content, as problem 6 compares them."""
    return F.concat(F.coalesce(F.col("signature"), F.lit("")), F.lit("\n"), F.coalesce(F.col("content"), F.lit("")))


def near_duplicate_chunks(chunks: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``chunk_id_a, chunk_id_b``: all pairs of chunks whose signature and content are alike but for small edits; equal ones count."""
    pairs, members = near_duplicates(chunks, chunk_text(), threshold)
    return expand_classes(pairs, members, "cls", "id", ("chunk_id_a", "chunk_id_b")).distinct()


def near_duplicate_classes(chunks: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``chunk_id, cls, links``: each chunk that takes part once for each of its texts, the class of its text, and the number of other classes that are like it. Groups of copies are not expanded."""
    pairs, members = near_duplicates(chunks, chunk_text(), threshold)
    links = pairs.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("links"))
    return members.join(links, "cls", "left").select(F.col("id").alias("chunk_id"), "cls", F.coalesce("links", F.lit(0)).alias("links"))
