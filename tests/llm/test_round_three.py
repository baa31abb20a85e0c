"""Centroid clustering, SentencePiece rounds and the prefix trie against brute force, edge cases included."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from ampgraph.llm import mixing, pieces, prefixes, quality, yinyang

VECTORS = "vec_id long, embedding array<float>, cluster string"


def lloyd(rows, k=8, rounds=10, dim=64):
    """Plain rounds over all distances."""
    kept = [(i, v) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    x = np.array([np.floor(1024 * np.array(v, np.float32).astype(float)) for _, v in kept]).astype(np.int64)
    start = sorted(range(len(kept)), key=lambda j: (kept[j][0] is None, hashlib.sha256(f"3:{kept[j][0]}".encode()).hexdigest(), list(x[j])))[:k]
    c = [list(x[j]) for j in start]

    def assign():
        d = np.stack([((x - np.array(m)) ** 2).sum(1) for m in c], 1)
        return d.argmin(1), d.min(1)

    for _ in range(rounds):
        of, _ = assign()
        c = [[sum(x[of == j][:, i].tolist()) // int((of == j).sum()) for i in range(dim)] if (of == j).any() else c[j] for j in range(len(c))]
    of, d = assign()
    sha = [hashlib.sha256(",".join(str(int(v)) for v in m).encode()).hexdigest() for m in c]
    return sorted((i is None, i or 0, int(j), int(e), sum(d[of == j].tolist()), sum(d.tolist()), sha[j]) for (i, _), j, e in zip(kept, of, d, strict=True))


@pytest.mark.parametrize("spread", [0.05, 1.0, 100.0, 30_000.0])
def test_clusters_as_plain_rounds_give_them(spark, spread):
    rng = np.random.default_rng(int(spread * 100))
    x = (rng.normal(size=(12, 64))[rng.integers(0, 12, 300)] * spread + rng.normal(size=(300, 64)) * spread / 3).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, x[8].tolist()), (7, x[7].tolist()), (None, x[3].tolist())]
    odd = [(900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 63 + [None]), (904, [1.0] * 63 + [float("nan")]), (905, [1.0] * 63 + [float("inf")])]
    df = spark.createDataFrame([(i, v, "own") for i, v in rows + odd], VECTORS)
    for groups in (None, 1, 8):
        got = yinyang.cluster_vectors(df, groups=groups).collect()
        assert sorted((r.vec_id is None, r.vec_id or 0, *list(r)[1:]) for r in got) == lloyd(rows)


def test_equal_vectors_and_few_of_them(spark):
    same = [(i, [0.5] * 64, None) for i in range(20)]
    got = yinyang.cluster_vectors(spark.createDataFrame(same, VECTORS)).collect()
    assert {(r.cluster, r.distance, r.inertia) for r in got} == {(0, 0, 0)} and len(got) == 20
    two = yinyang.cluster_vectors(spark.createDataFrame([(1, [0.0] * 64, None), (2, [1.0] * 64, None)], VECTORS)).collect()
    assert sorted(r.cluster for r in two) == [0, 1]
    none = yinyang.cluster_vectors(spark.createDataFrame([(1, None, None)], VECTORS))
    assert none.collect() == [] and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_too_large_components_are_an_error(spark):
    with pytest.raises(Exception, match="exceeds"):
        yinyang.cluster_vectors(spark.createDataFrame([(1, [1e30] * 64, None), (2, [0.0] * 64, None)], VECTORS)).collect()


def test_bounds_leave_most_distances_out():
    rng = np.random.default_rng(5)
    x = np.floor(1024 * (rng.normal(size=(8, 64))[rng.integers(0, 8, 2000)] + rng.normal(size=(2000, 64)) / 4)).astype(np.int64)
    c = x[:8].copy()
    group = yinyang.grouped(c, 2)
    of, upper, lower = yinyang.first_bounds(x, c, group)
    for _ in range(6):
        moved = np.stack([x[of == j].sum(0) // max(1, (of == j).sum()) if (of == j).any() else c[j] for j in range(8)])
        drift = np.sqrt(yinyang.squared_to(moved, c).astype(float)) * yinyang.UP
        c = moved
        of, upper, lower = yinyang.moved_bounds(x, of, upper, lower, c, group, drift)
        d2 = yinyang.squared(x, c)
        assert (of == d2.argmin(1)).all()
        d = np.sqrt(d2.astype(float))
        assert (upper >= d[np.arange(2000), of]).all()
        d[np.arange(2000), of] = np.inf
        for g in range(group.max() + 1):
            assert (lower[:, g] <= d[:, group == g].min(1)).all()
    assert (upper < lower.min(1)).mean() > 0.5


ALPHABETS = ["ab▁ \n\t<>", "aeiou tn▁  ", "日本語中文字а б в г", "".join(map(chr, range(32, 600))), "0123456789 .,-=", "🙂é\0ﬁ́ a​", "thequickbrownfox ", "A ", "▁", "=-_*# "]


def test_ids_and_texts_as_the_library_gives_them(spark):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=pieces.default_model())
    draw = random.Random(3)
    texts = ["", " ", "  ", "<s> </s> <unk> <0x41>", "▁▁a", " " * 3000 + "x", "a" * 5000, "=-" * 2000, "\n" * 50, "﻿a�", "the " * 40_000]
    for _ in range(400):
        letters = draw.choice(ALPHABETS) + draw.choice(ALPHABETS)
        x = "".join(draw.choices(letters, k=draw.choice([1, 2, 5, 20, 100, 600])))
        texts.append(x.replace(" ", " " * draw.choice([1, 1, 2, 3, 17, 40])))
    rows = [(i, t, "own") for i, t in enumerate(texts)] + [(None, "null id", None), (5000, None, None), (0, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.ids, r.decoded) for r in pieces.encode_texts(df).collect())
    want = [(i, library.encode(t or "")) for i, t, _ in rows]
    assert got == sorted((i is None, i or 0, ids, library.decode(ids)) for i, ids in want)
    digests = pieces.piece_digests(df).collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in digests) == sorted(
        (i is None, i or 0, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))) for i, ids in want
    )
    assert pieces.encode_texts(df.limit(0)).collect() == []


def test_decoding_any_ids_and_parts_of_long_texts(monkeypatch):
    from sentencepiece import SentencePieceProcessor

    library, own, draw = SentencePieceProcessor(model_file=pieces.default_model()), pieces.pieces(pieces.default_model()), random.Random(4)
    for _ in range(500):
        ids = [draw.randrange(300) if draw.random() < 0.7 else draw.randrange(32_000) for _ in range(draw.choice([0, 1, 2, 3, 20]))]
        assert own.decode(ids) == library.decode(ids)
    monkeypatch.setattr(pieces, "AT_ONCE", 7)
    monkeypatch.setattr(pieces, "ROUNDS", 2)
    monkeypatch.setattr(own, "words", {})
    for _ in range(200):
        text = "".join(draw.choices(draw.choice(ALPHABETS) + " the", k=120))
        assert own.encode([text, text[::-1]])[0].tolist() == library.encode(text)


def trie(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    full = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        full[c] = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, path in full.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    out = []
    for node, m in members.items():
        below = [v for v in members if v[: len(node)] == node]
        ends = ",".join(str(c) for c in sorted(m) if full[c] == node)
        out.append((
            min(m), len(node), min(members[node[:-1]]) if node else None, len(m), sum(len(v) == len(node) + 1 for v in below),
            sum(not any(w[:-1] == v for w in members if w) for v in below), sum((len(members[v]) - 1) * len(v[-1][1].encode()) for v in below if v), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


TURNS = "conv_id long, turn long, role string, text string, depth string"


def in_spark(spark, rows):
    return sorted((tuple(r) for r in prefixes.prefix_trie(spark.createDataFrame([(*r, None) for r in rows], TURNS)).collect()), key=str)


@pytest.mark.parametrize("block", [4, 1024])
def test_trie_as_all_pairs_give_it(spark, monkeypatch, block):
    monkeypatch.setattr(prefixes, "BLOCK", block)
    draw, rows = random.Random(block), []
    for c in draw.sample(range(120), 90):
        for t in range(draw.choice([1, 1, 2, 4, 9, 12])):
            rows.append((c, draw.choice([t, t, t, None]), draw.choice(["user", "user", None]), draw.choice(["a", "é", "bb", None, ""]) if t < 3 else "x" * (t % 3)))
    rows += draw.sample(rows, 20) + [(None, 0, "user", "none"), (200, 0, "user", "a")] + [(c, t, "user", "same") for c in range(300, 340) for t in range(10)]
    rows += [(401, t, "user", "long") for t in range(30)]
    assert in_spark(spark, rows) == trie(rows)


def test_trie_of_nothing_and_of_one(spark):
    assert in_spark(spark, []) == [] and in_spark(spark, [(None, 1, "user", "x")]) == []
    assert in_spark(spark, [(0, None, None, None)]) == trie([(0, None, None, None)])
    absent = next(c for c in range(1, 999) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    only_root = in_spark(spark, [(absent, 0, "user", "x")])
    assert only_root == trie([(absent, 0, "user", "x")]) and len(only_root) == 1 and only_root[0][3:6] == (1, 0, 1)


def test_tolerance_is_looked_at_after_the_last_sweep(spark):
    rows = [(i, "word " * (1 + i % 7), ("de", "en", "fr")[i * i % 3], f"s{i % 4}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert mixing.mixing_probabilities(docs, tolerance=1e-3).count() == 300
    with pytest.raises(ValueError, match="beyond the tolerance"):
        mixing.mixing_probabilities(docs, rounds=1, tolerance=1e-15)


def test_quality_with_another_id_column(spark):
    draw = random.Random(7)
    rows = [(i, " ".join(draw.choices(["fine", "clear", "text"] if i % 2 else ["junk", "spam", "zzz"], k=30)), 0) for i in range(120)]
    docs, labels = spark.createDataFrame(rows, "key long, text string, doc_id int"), spark.createDataFrame([(i, i % 2) for i in range(120)], "key long, quality int")
    got = {r.doc_id: r.predicted for r in quality.quality_scores(docs, labels, id_column="key").collect()}
    assert len(got) == 120 and sum(got[i] == i % 2 for i in got) > 110
