"""Splitting, encoding, mixing and the similarity joins, against brute force or exact round trips."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codequarry.llm import buckets, mixing, neardup, splitting, tagpairs, tokens, vectors


def _lines(s):
    return 0 if not s else s.count("\n") + (not s.endswith("\n"))


def test_splitting(spark):
    rng = random.Random(3)
    code = "".join(f"def f{i}(a):\r\n    return {i}\r\n" + ("\n" if i % 3 else "    # x\n") for i in range(600))
    texts = {1: code, 2: "x" * 45_000, 3: "\n" * 1_200, 4: "é" * 19_999 + "\n" + "z" * 19_999, 5: "\n".join("w" * rng.randint(1, 3_000) for _ in range(40)), 6: "short", 7: "", 8: None, 9: "a\n" * 512, 10: "a\n" * 512 + "b", 11: "y" * 20_000, 12: "y" * 20_001}
    rows = [(k, v, 7 if k != 2 else None, "clash", 1) for k, v in texts.items()] * 2
    df = spark.createDataFrame(rows, "chunk_id long, content string, start_line int, segs string, id int")
    got = {}
    for r in splitting.split_oversized(df).orderBy("chunk_id", "piece_no").collect():
        got.setdefault(r["chunk_id"], []).append(r)
    assert set(got) == {1, 2, 3, 4, 5, 10, 12}
    for k, pieces in got.items():
        text, pos, first = texts[k], 0, 7 if k != 2 else 1
        assert "".join(r["content"][r["overlap"] :] for r in pieces) == text and len(pieces) == pieces[0]["n_pieces"]
        for r in pieces:
            assert len(r["content"]) <= 20_000 and _lines(r["content"]) <= 512
            start = pos - r["overlap"]
            assert r["content"] == text[start : start + len(r["content"])]
            assert r["start_line"] == first + text.count("\n", 0, start) and r["end_line"] == r["start_line"] + _lines(r["content"]) - 1
            if r["piece_no"] > 1:
                shared = r["content"][: r["overlap"]]
                whole_lines = text[pos - 1] == "\n" and (shared.count("\n") == 10 or start == 0)
                assert whole_lines or len(shared) == 200
            pos = start + len(r["content"])
    assert splitting.split_oversized(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        splitting.split_oversized(df, max_lines=5)


TEXTS = ["Hello world, it's 3.5!", "  two  spaces\n\n\ttab ", "값이 늘었다。「動きます」 ไทย 🙂🙂", "", None, "a\u00a0b\u3000c\u2028d", "x" * 30_000, "Hello world, it's 3.5!", "<|endoftext|>", " "]


def test_encoding_round_trip(spark):
    rows = [(i, t, "clash", [1]) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "clash", [2])]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string, ids array<int>")
    encoded = tokens.encode_corpus(df)
    enc = tokens.encoding(tokens.rank_file("byte_bpe_50k"))
    got = {r["doc_id"]: r["ids"] for r in encoded.collect()}
    assert got == {i: enc.encode_ordinary(t or "") for i, t in enumerate(TEXTS)}
    assert {r["doc_id"]: r["text"] for r in tokens.decode_corpus(encoded).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert {r["doc_id"]: r["tokens"] for r in tokens.token_counts(df.dropDuplicates(["doc_id"])).collect()} == {i: len(x) for i, x in got.items()}
    assert tokens.encode_corpus(df.limit(0)).count() == 0


@pytest.mark.parametrize("sent", [100_000, 0])
def test_encoding_in_many_batches(spark, monkeypatch, sent):
    monkeypatch.setattr(tokens, "BATCH_CHARS", 40)
    monkeypatch.setattr(tokens, "MOST_SENT", sent)
    rows = [(i, t) for i, t in enumerate(TEXTS * 3)] + [(None, "no id"), (None, None), (0, None), (1, ""), (2, "a"), (2, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {}
    for i, t in rows:
        want[i] = max(want.get(i) or "", t or "")
    enc = tokens.encoding(tokens.rank_file("byte_bpe_50k"))
    got = tokens.encode_corpus(df).collect()
    assert len(got) == len(want) and {r["doc_id"]: r["ids"] for r in got} == {i: enc.encode_ordinary(t) for i, t in want.items()}


def test_mixing(spark):
    rows = [(i, "word " * (10 + i % 7), " Big " if i % 4 else "SMALL") for i in range(400)] + [(900, None, "big"), (901, "", "big"), (902, "x y", None), (903, "x y", "other"), (0, "word", "big")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"tokens": F.lit("clash"), "block": F.lit("clash")})
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 3), ("none", 0.0, 1), (None, 0.3, 1)], "source string, target_share double, max_repeats int")
    mix = mixing.plan_mixture(docs, targets, block_tokens=50)
    got = mix.collect()
    used = {}
    for r in got:
        used.setdefault((r["source"], r["doc_id"]), []).append(r["repeat"])
    assert all(len(v) == len(set(v)) <= (1 if s == "big" else 3) for (s, _), v in used.items()) and max(map(len, used.values())) > 1
    assert not {900, 901, 902, 903} & {r["doc_id"] for r in got}
    shares = {r["source"]: r for r in mixing.reached_shares(mix, targets).filter("source is not null").collect()}
    assert shares["big"]["share"] == pytest.approx(0.5, abs=0.05) and shares["none"]["tokens"] == 0
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.plan_mixture(docs, targets, block_tokens=50).collect()))
    assert mixing.plan_mixture(docs.limit(0), targets).count() == 0 and mixing.plan_mixture(docs, targets.limit(0)).count() == 0


def _weighted(a, b):
    keys = set(a) | set(b)
    return sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / max(1, sum(max(a.get(k, 0), b.get(k, 0)) for k in keys))


def test_tag_pairs_against_brute_force(spark):
    rng = random.Random(5)
    base = [{f"tag{rng.randint(0, 400)}": rng.randint(1, 5) for _ in range(rng.randint(4, 9))} for _ in range(60)]
    sets = {}
    for i in range(300):
        s = dict(rng.choice(base))
        if rng.random() < 0.6:
            s[f"tag{rng.randint(0, 400)}"] = rng.randint(1, 3)
        sets[i] = s
    rows = [(i, t, w) for i, s in sets.items() for t, w in s.items()]
    rows += [(0, f" {t.upper()}\t", None if w == 1 else w) for t, w in sets[0].items()] + [(1, None, 3), (1, "  ", 2), (None, "tag1", 1), (999, "tag1", 1)]
    tags = spark.createDataFrame(rows, "chunk_id long, tag string, weight int").withColumns({"id": F.lit("clash"), "w": F.lit("clash")})
    known = spark.createDataFrame([(i, "x") for i in range(1, 300)] * 2, "chunk_id long, tag string")
    want = {(a, b) for a in range(1, 300) for b in range(a + 1, 300) if min(len(sets[a]), len(sets[b])) >= 4 and _weighted(sets[a], sets[b]) >= 0.75}
    found = tagpairs.similar_tag_sets(tags, known).collect()
    assert len(found) == len(set(map(tuple, found))) and set(map(tuple, found)) == want and len(want) > 50
    assert tagpairs.similar_tag_sets(tags.limit(0), known).count() == 0 and tagpairs.similar_tag_sets(tags, known.limit(0)).count() == 0


def test_hot_neighbourhoods_deepen_by_the_same_steps(spark, monkeypatch):
    rng = random.Random(6)
    sets = {i: {f"tag{t}": 1 + t % 3 for t in rng.sample(range(9), 6)} for i in range(150)}
    tags = spark.createDataFrame([(i, t, w) for i, s in sets.items() for t, w in s.items()], "chunk_id long, tag string, weight int")
    known = spark.createDataFrame([(i,) for i in sets], "chunk_id long")
    want = {(a, b) for a in sets for b in sets if a < b and _weighted(sets[a], sets[b]) >= 0.75}
    monkeypatch.setattr(tagpairs, "WIDE", 2)
    usual = set(map(tuple, tagpairs.similar_tag_sets(tags, known).collect()))
    monkeypatch.setattr(tagpairs, "hot_apart", lambda rows, key: buckets.hot_apart(rows, key, 3))
    monkeypatch.setattr(tagpairs, "sized", lambda rows, key: buckets.sized(rows, key, 3))
    assert set(map(tuple, tagpairs.similar_tag_sets(tags, known).collect())) == usual <= want and len(usual) > 0.95 * len(want)


def test_heavy_tags_count_whole_in_signatures():
    rng = np.random.default_rng(6)
    sets = []
    for n in range(60):
        # 1000 shared units of 1320: a case, and so is its signature.
        for side in range(2):
            own = rng.integers(0, 1 << 62, 8)
            sets.append([{"t": 1_000_000 + n, "w": 1_000}, *({"t": int(t), "w": 20} for t in own)])
    items = pa.array(sets, pa.list_(pa.struct([("t", pa.int64()), ("w", pa.int32())])))
    sign, _ = tagpairs._signatures(tagpairs.deepest(0.75))
    keys, deeper = {}, {}
    for b in sign(iter([pa.RecordBatch.from_arrays([pa.array(range(120)), items], ["cls", "items"])])):
        for r in b.to_pylist():
            keys.setdefault(r["cls"], []).append(r["key"])
            deeper.setdefault(r["cls"], []).append((r["key"], r["deeper"]))
    share = np.mean([np.mean(np.array(keys[2 * n]) == np.array(keys[2 * n + 1])) for n in range(60)])
    assert all(set(keys[2 * n]) & set(keys[2 * n + 1]) for n in range(60)) and abs(share - (1_000 / 1_320) ** 4) < 0.06
    assert sum(bool(set(deeper[2 * n]) & set(deeper[2 * n + 1])) for n in range(60)) >= 56


def test_blocks_hold_every_pair(spark):
    rows = spark.createDataFrame([(i, 1 if i < 40 else 2 if i < 45 else i, 0 if i % 2 else 7) for i in range(48)], "id long, key long, sketch long")
    want = {(a, b) for a in range(45) for b in range(a + 1, 45) if (a < 40) == (b < 40)}
    for block in (7, 2_000):
        counted = buckets.sized(rows, "key", block)
        assert {r["id"]: r["n"] for r in counted.collect()} == {i: 40 if i < 40 else 5 for i in range(45)}
        assert set(map(tuple, buckets.candidate_pairs(counted, "key", "id", "sketch", 64, block).collect())) == want
        assert set(map(tuple, buckets.candidate_pairs(counted, "key", "id", "sketch", 2, block).collect())) == {(a, b) for a, b in want if (a - b) % 2 == 0}


def _jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("block", [2_000, 3])
def test_near_duplicates_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "sized", lambda rows, key: buckets.sized(rows, key, block))
    monkeypatch.setattr(neardup, "blocked", lambda rows, key, cls: buckets.blocked(rows, key, cls, "n", block))
    rng = random.Random(7)
    word = lambda: rng.choice("abcdefgh") + str(rng.randint(0, 300))
    base = [[word() for _ in range(rng.randint(20, 120))] for _ in range(40)]
    rows = []
    for i in range(240):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 6)):
            at = rng.randrange(len(w))
            w[at : at + rng.randint(0, 1)] = [word()]
        rows.append((i, None if i % 2 else "f(x)", " ".join(w), "clash", 1))
    rows += [(500, None, None, "c", 1), (501, "a", "", "c", 1), (502, "x", "Ä " * 50, "c", 1), rows[0], (503, None, "İ K " + " ".join(f"w{i}" for i in range(30)), "c", 1), (504, None, "İ K " + " ".join(f"W{i}" for i in range(30)), "c", 1)]
    df = spark.createDataFrame(rows, "chunk_id long, signature string, content string, cls string, key long")
    sets = {}
    for i, s, c, *_ in rows:
        x = {int(v) for v in neardup.shingle_set(f"{s or ''}\n{c or ''}", 3, {})}
        if len(x) >= 25:
            sets[i] = x
    want = {(a, b) for a in sets for b in sets if a < b and _jaccard(sets[a], sets[b]) >= 0.7}
    got = neardup.near_duplicate_chunks(df).collect()
    assert set(map(tuple, got)) == want and len(got) == len(want) > 100 and (503, 504) in want
    assert neardup.near_duplicate_chunks(df.limit(0)).count() == 0


def test_near_duplicate_classes(spark):
    text = lambda n, *more: " ".join([f"w{n}_{i}" for i in range(60)] + list(more))
    rows = [(1, None, text(1)), (2, "", text(1)), (3, None, text(1, "x")), (4, None, text(2)), (5, None, "short"), (1, None, text(1))]
    df = spark.createDataFrame(rows, "chunk_id long, signature string, content string")
    got = {r["chunk_id"]: (r["cls"], r["links"]) for r in neardup.near_duplicate_classes(df).collect()}
    assert set(got) == {1, 2, 3, 4} and got[1] == got[2] and got[1][1] == got[3][1] == 1 and got[4][1] == 0
    assert len({c for c, _ in got.values()}) == 3


def test_trees_prune_only_what_cannot_match():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 1 << 62, rng.integers(25, 60), np.uint64)) for _ in range(30)]
    sets += [np.unique(np.r_[s[3:], rng.integers(0, 1 << 62, 3, np.uint64)]) for s in sets for _ in range(3)]
    size = np.array([len(s) for s in sets], np.int32)
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if _jaccard(set(sets[i]), set(sets[j])) >= 0.7}
    order = np.array([k for i in range(30) for k in (i, 30 + 3 * i, 31 + 3 * i, 32 + 3 * i)])
    bits = np.stack([np.frombuffer(neardup.bitmap(sets[i], neardup.NODE_BITS), np.uint64) for i in order])
    for place in (np.zeros(len(sets), int), np.arange(len(sets)) // 40):
        tree = neardup.Tree(bits, size[order], place)
        a, b, told = tree.matches(0.7)
        found = {(min(x, y), max(x, y)) for x, y in zip(order[a].tolist(), order[b].tolist(), strict=True)}
        where = dict(zip(order.tolist(), place.tolist(), strict=True))
        assert {(i, j) for i, j in want if where[i] == where[j]} <= found and all(where[i] == where[j] for i, j in found)
        assert len(tree.levels) == 5 and len(found) == len(a) and told[-1][2] < len(sets) * (len(sets) - 1) / 6
        assert any(followed < met / 2 for level, met, _, followed in told if level)


def test_bitmaps_of_all_widths_bound_the_overlap(spark):
    """Texts of very different lengths in one place: the narrower bitmap decides."""
    rows, rng = [], random.Random(11)
    for n in (30, 45, 60, 400, 500, 3_000):
        words = [f"a{rng.randint(0, 1 << 30)}" for _ in range(n)]
        for i in range(4):
            w = list(words)
            for _ in range(i * n // 60):
                w[rng.randrange(n)] = f"b{rng.randint(0, 1 << 30)}"
            rows.append((len(rows), None, " ".join(w)))
    df = spark.createDataFrame(rows, "chunk_id long, signature string, content string")
    sets = {i: set(neardup.shingle_set(f"\n{c}", 3, {}).tolist()) for i, _, c in rows}
    want = {(a, b) for a in sets for b in sets if a < b and min(len(sets[a]), len(sets[b])) >= 25 and _jaccard(sets[a], sets[b]) >= 0.7}
    assert set(map(tuple, neardup.near_duplicate_chunks(df).collect())) == want and len(want) > 20
    told = neardup.traversal_counts(neardup.signed_records(df, neardup.chunk_text())).collect()
    assert {r["level"] for r in told} >= {0, 1} and all(r["followed"] <= r["tested"] <= r["met"] for r in told)


def measured_recall(found, x, ids, k, least):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = unit @ unit.T
    np.fill_diagonal(sim, -1)
    want = set()
    for i in range(len(ids)):
        want |= {(ids[i], ids[j]) for j in np.lexsort((ids, -sim[i]))[:k] if sim[i, j] >= least}
    return len(want & found) / len(want), found - want


@pytest.mark.parametrize("stretch", [1 << 16, 50])
def test_vectors_against_brute_force(spark, monkeypatch, stretch):
    monkeypatch.setattr(vectors, "STRETCH", stretch)
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((150, 16))
    x = np.concatenate([c + rng.standard_normal((rng.integers(1, 12), 16)) * 0.15 for c in centres]).astype(np.float32) * 3
    rows = [(i, [float(v) for v in r], "clash") for i, r in enumerate(x)]
    bad = [(9_000, None, "c"), (9_001, [0.0] * 16, "c"), (9_002, [1.0] * 3, "c"), (9_003, [float("nan")] * 16, "c"), (9_004, [float("inf")] * 16, "c"), (None, [1.0] * 16, "c"), (9_005, [1.0, None] * 8, "c")]
    df = spark.createDataFrame(rows + bad + rows[:5], "chunk_id long, embedding array<float>, vkey string")
    got = vectors.most_similar(df, 5, 0.85, 16).collect()
    found = {(r["chunk_id"], r["neighbour"]) for r in got}
    recall, extra = measured_recall(found, x.astype(np.float64), np.arange(len(x)), 5, 0.85)
    assert recall >= 0.9 and len(extra) <= 0.05 * len(found) and max(r["rank"] for r in got) <= 5


def test_windows_look_through_few_of_many_vectors(spark):
    """Windows do not grow with the collection: of 20,000 vectors they cover a part, and still find the near ones, in dense regions too."""
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((6_000, 64))
    x = np.concatenate([np.repeat(centres, 3, axis=0) + rng.standard_normal((18_000, 64)) * 0.3, centres[0] + rng.standard_normal((2_000, 64)) * 0.2]).astype(np.float32)
    found = {(r["chunk_id"], r["neighbour"]) for r in vectors.most_similar(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "chunk_id long, embedding array<float>")).collect()}
    part = np.r_[0:6_000]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = set()
    for i in part[3:]:
        sim = unit @ unit[i]
        sim[i] = -1
        want |= {(i, int(j)) for j in np.argsort(-sim)[:5] if sim[j] >= 0.85}
    assert len(want & found) >= 0.9 * len(want) > 5_000
    dense = {a for a, _ in found if a >= 18_000}
    assert len(dense) == 2_000
    assert vectors.ARRAYS * 2 * vectors.ROUNDS[-1] < len(x) / 3


def test_collision_threshold():
    assert vectors.collisions(1.0) == vectors.PROJECTIONS and vectors.collisions(0.0) == vectors.PROJECTIONS // 2
    assert vectors.collisions(0.85, 2) < vectors.collisions(0.85) < vectors.collisions(0.95)


def test_equal_vectors(spark):
    rows = [(i, [1.0, 0.5] * 8) for i in range(12)] + [(50, [1.0, 0.49] * 8)]
    df = spark.createDataFrame(rows, "chunk_id long, embedding array<float>")
    got = {}
    for r in vectors.most_similar(df, 5, 0.85, 16).collect():
        got.setdefault(r["chunk_id"], []).append(r["neighbour"])
    assert all(len(v) == 5 and i not in v for i, v in got.items()) and sorted(got[0]) == [1, 2, 3, 4, 5] and sorted(got[50]) == [0, 1, 2, 3, 4]
    assert vectors.most_similar(df.limit(0), dim=16).count() == 0
