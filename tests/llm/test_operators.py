"""The training-data operators against brute force on small tables, with edge cases."""

import itertools
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from ampgraph.llm import buckets, golay_simhash, histogram_sort, lattice_dedup, mixing, onebit_search, packing, quality, suffix_dedup, tokens, toxicity
from ampgraph.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return [f"w{i}" for i in rng.integers(0, vocabulary, n)]


@pytest.fixture(scope="module")
def corpus(spark):
    """Copies, near copies, a passage shared by many, empty, null, very long and repeated rows, and clashing columns."""
    rng = np.random.default_rng(4)
    shared = words(rng, 70)
    rows = []
    for i in range(60):
        w = words(rng, int(rng.integers(1, 160)))
        if i % 3 == 0:
            w = w[: len(w) // 2] + shared[: int(rng.integers(45, 70))] + w[len(w) // 2 :]
        rows.append((i, " ".join(w)))
    base = words(rng, 300)
    for i in range(60, 75):
        near = list(base)
        near[int(rng.integers(0, 300))] = f"edit{i}"
        rows.append((i, " ".join(near)))
    rows += [(75, rows[5][1]), (76, rows[5][1]), (77, ""), (78, None), (79, "   "), (80, " ".join(words(rng, 20_000, 5000))), (81, "Zwölf\tGRÖSSEN É\n\x0bx"), (82, "one"), (2, rows[2][1])]
    data = [(d, t, None if d % 7 == 0 else "en", "s0" if d % 3 else "s1", None if t is None else len(t), "key", 1) for d, t in rows]
    return spark.createDataFrame(data, SCHEMA + ", key string, id int").repartition(3)


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def roots(ids, links):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 460)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = roots({x for p in pairs for x in p}, pairs)
    assert got == {n: r for n, r in want.items() if any(n in p and p[0] != p[1] for p in pairs)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hot_bucket_is_cut_into_blocks(spark, monkeypatch):
    """A bucket over the block size gives the same groups as its pairwise links."""
    monkeypatch.setattr(buckets, "BLOCK", 16)
    rng = np.random.default_rng(2)
    values = [int(v) for v in rng.integers(0, 1 << 40, 90)]
    values += [values[0] ^ (1 << b) for b in range(30)]
    rows = spark.createDataFrame([(7, i, v) for i, v in enumerate(values)] + [(8, 0, values[0])], "key long, id long, payload long")
    near = lambda x, y: np.bitwise_count(x[:, None, :] ^ y[None]).sum(2) <= 2
    paired = lambda x, y: np.bitwise_count(x ^ y).sum(1) <= 2
    decode = lambda c: c.to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, 1)
    got = [(r.a, r.b) for r in buckets.bucket_links(rows, near, paired, decode).collect()]
    brute = [(i, j) for i, j in itertools.combinations(range(len(values)), 2) if bin(values[i] ^ values[j]).count("1") <= 2]
    assert roots(range(len(values)), got) == roots(range(len(values)), brute)
    assert len(got) < len(brute)


@pytest.mark.parametrize("seeds", [1, 3, 64])
def test_spanning_links_connect_what_all_pairs_connect(seeds):
    rng = np.random.default_rng(17)
    for n, reach in ((150, 0.004), (150, 0.02), (90, 0.2), (70, 2.0), (2, 0.0), (1, 1.0), (0, 1.0)):
        x = rng.random((n, 1))
        near = lambda a, b, r=reach: np.abs(a - b.T) <= r
        got = [tuple(map(int, p)) for p in buckets.spanning(x, near, seeds, step=8)]
        brute = [(i, j) for i, j in itertools.combinations(range(n), 2) if abs(x[i, 0] - x[j, 0]) <= reach]
        assert roots(range(n), got) == roots(range(n), brute) and len(got) <= max(0, n - 1)
        assert all(abs(x[i, 0] - x[j, 0]) <= reach for i, j in got)


# --- op1 ---


def test_e8_decoding_is_nearest():
    rng = np.random.default_rng(1)
    y = rng.normal(size=(200, 8)) * 2
    p = lattice_dedup.e8_decode(y)
    roots_ = lattice_dedup.e8_roots()
    assert len(roots_) == 240 and np.allclose((roots_**2).sum(1), 2)
    d = ((y - p) ** 2).sum(1)
    assert (d[:, None] <= ((y[:, None] - p[:, None] - roots_) ** 2).sum(2) + 1e-9).all()
    assert (np.abs(p * 2 - np.rint(p * 2)) < 1e-9).all() and (d <= 1 + 1e-9).all()


def test_lattice_dedup(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 24))
    for i in range(100, 200):
        x[i] = x[i % 10] + rng.normal(size=24) * 0.08
    x[200:230] = x[7]
    data = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    data += [(900, None), (901, [0.0] * 24), (902, [float("nan")] + [1.0] * 23), (903, [None] + [1.0] * 23), (904, [float(v) * 3 for v in x[7]]), (905, [1.0, 2.0]), (906, []), (None, [float(v) for v in x[7]]), (907, [float("inf")] + [1.0] * 23)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in lattice_dedup.lattice_dedup(df).collect()}
    ids = [i for i, v in data if i is not None and v is not None and len(v) == 24 and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    m = np.array([v for i, v in data if i in ids])
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    hit = m @ m.T >= 0.9
    np.fill_diagonal(hit, False)
    comp = roots(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(hit), strict=True) if a < b])
    assert len(got) == len(data)
    found = sum(got[i].n_links for i in ids)
    assert 0.99 * hit.sum() <= found <= hit.sum()
    assert all(got[i].component_id == comp[i] and got[i].kept == (comp[i] == i) for i in ids)
    assert all(got[i].n_links == 0 for i in (900, 901, 902, 903, 905, 906, 907))
    assert lattice_dedup.lattice_dedup(df.where("vec_id < 0")).count() == 0


def test_lattice_dedup_of_repeated_ids_and_clashing_columns(spark):
    """Rows (id, direction): each row counts the others within the angle, whatever their ids."""
    rows = [(1, 0.0), (1, 1.5), (2, 0.1), (3, 1.6), (1, 0.0), (4, 3.0), (4, 3.0)]
    data = [(i, [float(np.cos(a)), float(np.sin(a))] + [0.0] * 6, "x", 1, 2, i) for i, a in rows]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, v string, node int, n int, root long")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in lattice_dedup.lattice_dedup(df).collect())
    near = [[abs(a - b) < np.arccos(0.9) for _, b in rows] for _, a in rows]
    comp = roots(range(len(rows)), [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if near[i][j]])
    least = {c: min(rows[i][0] for i in comp if comp[i] == c) for c in comp.values()}
    assert got == sorted((d, sum(near[i]) - 1, least[comp[i]], d == least[comp[i]]) for i, (d, _) in enumerate(rows))


# --- op2 ---


def test_onebit_search_of_repeated_ids_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    data = [(i % 5, [float(i), 1.0], "q", 0.5, 1) for i in range(10)]  # every id twice
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, query string, score double, rank int")
    rows = onebit_search.onebit_search(df, F.col("vec_id") == 0, k=20).collect()
    assert len(rows) == 8 and {r.query_id for r in rows} == {0} and sorted(r.vec_id for r in rows) == sorted([1, 2, 3, 4] * 2)
    assert [r["rank"] for r in sorted(rows, key=lambda r: (-r.score, r.vec_id))] == list(range(1, 9))



def test_onebit_search(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 40))
    x[50] = x[20]
    data = [(i, [float(v) for v in r], "label") for i, r in enumerate(x)] + [(1000, None, ""), (1020, [0.0] * 40, ""), (1040, [1.0], "")]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, id string")
    rows = onebit_search.onebit_search(df, F.col("vec_id") % 20 == 0, k=20).collect()
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r.vec_id, r.score))
    score = x @ x.T
    hits = total = 0
    for q in range(0, 400, 20):
        best = sorted((i for i in range(400) if i != q), key=lambda i: (-score[q, i], i))[:20]
        hits, total = hits + len({i for i, _ in got[q]} & set(best)), total + 20
        assert all(abs(s - score[q, i]) < 1e-9 for i, s in got[q]) and len(got[q]) == 20
    assert hits / total >= 0.98 and 1020 not in got and 1040 not in got
    few = onebit_search.onebit_search(df.where("vec_id < 5"), F.col("vec_id") == 0, k=20)
    assert few.count() == 4 and onebit_search.onebit_search(df.where("vec_id < 0"), F.lit(True)).count() == 0


# --- op3 ---


def test_histogram_shards(spark, corpus, monkeypatch):
    monkeypatch.setattr(histogram_sort, "CELL_ROWS", 5)
    out = histogram_sort.histogram_shards(corpus, shards=4).collect()
    assert len(out) == corpus.count() and {r.shard for r in out} <= {0, 1, 2, 3}
    by = defaultdict(list)
    for r in out:
        assert r.size == len((r.text or "").encode()) + 8
        by[r.shard].append(r)
    for rows in by.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
    assert histogram_sort.histogram_shards(corpus.where("doc_id < 0"), 4).count() == 0


def test_shards_against_a_sorted_copy(spark, corpus):
    """Shards are consecutive ranges of the rows sorted by (hash of text, id), nearly equal, and equal texts stay together."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, f"text {i % 700} " + "x" * (i % 37)) for i in range(2000)], "doc_id long, text string")
    out = histogram_sort.histogram_shards(df, 5, tolerance=0.01).select("*", F.xxhash64("text").alias("h")).collect()
    ordered = sorted(out, key=lambda r: (r.h, r.doc_id))
    assert [r.shard for r in ordered] == sorted(r.shard for r in ordered)
    by, of_text = defaultdict(list), defaultdict(set)
    for r in ordered:
        by[r.shard].append(r)
        of_text[r.text].add(r.shard)
    share = sum(r.size for r in out) / 5
    group = max(sum(r.size for r in out if r.text == t) for t in of_text)
    assert all([r.slot for r in rows] == list(range(len(rows))) for rows in by.values())
    assert all(abs(sum(r.size for r in rows) - share) <= 2 * (0.01 * share + group) for rows in by.values())
    assert sum(len(s) > 1 for s in of_text.values()) <= 4


def test_histogram_shards_cut_a_hot_group(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'same text' else concat('t', lpad(id, 8, '0')) end as text")
    size = defaultdict(int)
    for r in histogram_sort.histogram_shards(df, 8).collect():
        size[r.shard] += r.size
    assert max(size.values()) - min(size.values()) <= 2 * 17 + 0.01 * sum(size.values()) / 8


# --- op4, op5 ---


def marked(spark, rng, n=500):
    rows, labels = [], []
    for i in range(n):
        w = words(rng, int(rng.integers(30, 120)))
        bad, toxic = i % 6 == 0, i % 7 == 0
        if bad:
            w = [f"{x}%%%" for x in w]
        if toxic:
            w.insert(int(rng.integers(0, len(w))), "vile" + ("", "ness", "ly")[i % 3])
        rows.append((i, " ".join(w)))
        labels.append((i, 0 if bad else 1, int(toxic)))
    rows += [(n, None), (n + 1, ""), (None, "w1 w2"), (3, rows[3][1])]
    labels += [(None, 1, 1), (5, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_classifiers_on_the_held_out_fold(spark):
    docs, labels = marked(spark, np.random.default_rng(6))
    truth = {r.doc_id: r for r in labels.where("quality is not null").collect()}
    for column, rows in (("quality", quality.quality_scores(docs, labels).collect()), ("toxic", toxicity.toxicity_scores(docs, labels).collect())):
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
        fold = [r for r in rows if r.held_out and r.doc_id in truth]
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
        assert np.mean([r.predicted == truth[r.doc_id][column] for r in fold]) > 0.97
    none = toxicity.toxicity_scores(docs.where("doc_id < 0"), labels.where("doc_id < 0"))
    assert none.count() == 0 and quality.quality_scores(docs.limit(3), labels.where("doc_id < 0")).first().score == 0.5
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id = 500 or doc_id is null").count() == 2


def test_follow_the_regularised_leader_step_by_step():
    """The vectorised learner against the published update, feature by feature."""
    rng = np.random.default_rng(14)
    model = quality.FollowTheRegularisedLeader(20)
    z, n = [0.0] * 21, [0.0] * 21

    def weight(i):
        l1 = 0.0 if i == 20 else model.l1
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - (l1 if z[i] > 0 else -l1)) / ((model.beta + n[i] ** 0.5) / model.alpha + model.l2)

    for _ in range(300):
        at = np.sort(rng.choice(20, 5, replace=False))
        at, x, label = np.r_[at, 20], np.r_[rng.random(5), 1.0], int(rng.random() < 0.4)
        w = [weight(i) for i in at]
        p = 1 / (1 + np.exp(-sum(a * b for a, b in zip(w, x, strict=True))))
        for i, wi, xi in zip(at.tolist(), w, x.tolist(), strict=True):
            g = (p - label) * xi
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / model.alpha * wi
            n[i] += g * g
        model.learn(at, x, label)
    assert np.allclose(model.z, z) and np.allclose(model.weights(), [weight(i) for i in range(21)])


def test_risk_slopes_are_the_derivatives_of_the_non_negative_risk():
    rng = np.random.default_rng(15)
    sigmoid = lambda v: 1 / (1 + np.exp(-v))

    def risk(z, n_p, prior):
        confirmed, clean = prior * sigmoid(-z[:n_p]).mean(), sigmoid(z[n_p:]).mean() - prior * sigmoid(z[:n_p]).mean()
        return confirmed + clean if clean >= 0 else -clean

    signs = set()
    for low in (-3, 3):
        z = np.r_[rng.normal(2, 1, 5), rng.normal(low, 1, 9)]
        prior = 0.3
        signs.add(sigmoid(z[5:]).mean() >= prior * sigmoid(z[:5]).mean())
        got = toxicity.risk_slopes(z, 5, prior)
        for i in range(14):
            e = np.zeros(14)
            e[i] = 1e-6
            assert abs((risk(z + e, 5, prior) - risk(z - e, 5, prior)) / 2e-6 - got[i]) < 1e-7
    assert signs == {True, False}


def test_scores_use_neither_held_out_labels_nor_other_columns(spark):
    from pyspark.sql import functions as F

    docs, labels = marked(spark, np.random.default_rng(16), 240)
    docs = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    turned = labels.withColumns({c: F.when(quality.held_out(), 1 - F.col(c)).otherwise(F.col(c)) for c in ("quality", "toxic")})
    clash = docs.withColumns({"label": F.lit(1), "score": F.lit("x"), "positive": F.lit(0), "order": F.lit(3), "source": F.col("doc_id").cast("string")})
    long_text = spark.createDataFrame([(9001, "vile words " * 100_000)], "doc_id long, text string")
    for f in (quality.quality_scores, toxicity.toxicity_scores):
        want = sorted(tuple(r) for r in f(docs, labels).collect())
        assert sorted(tuple(r) for r in f(docs, turned).collect()) == want
        assert sorted(tuple(r) for r in f(clash, labels).collect()) == want
        assert 0 <= f(docs.unionByName(long_text), labels).where("doc_id = 9001").first().score <= 1
    untrained = toxicity.toxicity_scores(docs, labels, epochs=0).select("score").distinct().collect()
    assert len(untrained) == 1  # all weights begin at zero


# --- op6 ---


def brute_repeats(rows, length):
    """(words that an earlier copy has, words of first copies) by document."""
    seen = defaultdict(set)
    for d, t in rows:
        w = (t or "").encode().split()
        for i in range(len(w) - length + 1):
            seen[tuple(w[i : i + length])].add((d, t, i))
    gone, kept = defaultdict(set), defaultdict(set)
    for places in seen.values():
        for k, (d, _, i) in enumerate(sorted(places)):
            if len(places) > 1:
                (gone if k else kept)[d].update(range(i, i + length))
    return gone, kept


def spans_by_document(df):
    gone, kept = defaultdict(set), defaultdict(set)
    for r in df.collect():
        (gone if r.removed else kept)[r.doc_id].update(range(r.start, r.stop))
    return gone, kept


@pytest.mark.parametrize("run", [4096, 1])
def test_repeated_spans(spark, corpus, run):
    """With short runs sorted in tasks, and with every contested anchor cut into passages."""
    rows = texts(corpus)  # holds one row twice
    found = suffix_dedup.repeated_spans(corpus, 50, run=run)
    want = brute_repeats(rows, 50)
    assert spans_by_document(found) == want and len(want[0]) > 20
    ordered = sorted((r.doc_id, r.text_key, r.removed, r.start, r.stop) for r in found.collect())
    assert all(a[:3] != b[:3] or a[4] < b[3] for a, b in itertools.pairwise(ordered))


def test_remove_repeats(spark, corpus):
    rows = [(d, t) for d, t in texts(corpus.dropDuplicates(["doc_id"]))]
    want = brute_repeats(rows, 50)[0]
    left = suffix_dedup.remove_repeats(corpus.dropDuplicates(["doc_id"]), 50)
    assert left.columns == corpus.columns
    kept = {r.doc_id: r for r in left.collect()}
    for d, t in rows:
        w = (t or "").split()
        rest = [x for i, x in enumerate(w) if i not in want.get(d, ())]
        assert (d in kept and (kept[d].text or "").split() == rest) or (w and not rest and d not in kept)
        if d in kept and want.get(d):
            assert kept[d].n_chars == len(kept[d].text)
        elif d in kept:
            assert kept[d].text == t
    assert suffix_dedup.repeated_spans(corpus.where("doc_id < 0")).count() == 0


def test_passages_that_overlap_in_many_ways(spark):
    """Matches that reach far to one side of a suffix with one partner and to the other side with another."""
    rng = np.random.default_rng(21)
    base = words(rng, 400, 100_000)
    rows = []
    for i in range(60):
        a, n = int(rng.integers(0, 330)), int(rng.integers(45, 70))
        rows.append((i, " ".join(words(rng, 30, 100_000) + base[a : a + n] + words(rng, 30, 100_000))))
    rows += [(100, " ".join(["la"] * 130)), (101, " ".join(["la", "lu"] * 80)), (None, rows[0][1]), (102, " ".join(base[:49]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for run in (4096, 2):
        assert spans_by_document(suffix_dedup.repeated_spans(df, 50, run=run)) == brute_repeats([r for r in rows if r[0] is not None], 50)


def test_repeats_within_one_text_and_repeated_rows(spark):
    w = [f"u{i}" for i in range(60)]
    df = spark.createDataFrame([(1, " ".join([*w, "x", *w]))], "doc_id long, text string")
    got = {(r.start, r.stop, r.removed) for r in suffix_dedup.repeated_spans(df, 50).collect()}
    assert got == {(0, 60, False), (61, 121, True)}
    twice = spark.createDataFrame([(1, " ".join(w))] * 2, "doc_id long, text string")
    assert suffix_dedup.repeated_spans(twice, 50).count() == 0  # a repeated row is one document
    two = spark.createDataFrame([(1, " ".join(w)), (1, " ".join([*w, "end"]))], "doc_id long, text string")
    assert sorted(r.removed for r in suffix_dedup.repeated_spans(two, 50).collect()) == [False, True]


def test_suffix_sql_twin(spark, corpus):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    documents = corpus.dropDuplicates(["doc_id"]).select("doc_id", "text").toPandas()  # noqa: F841  read by DuckDB
    want = sorted(c.execute(suffix_dedup.oracle_sql(50)).fetchall())
    spans = suffix_dedup.repeated_spans(spark.createDataFrame(documents, "doc_id long, text string"), 50)
    assert sorted(tuple(r) for r in spans.select("doc_id", "start", "stop", "first_doc_id", "removed").collect()) == want


# --- op7 ---


def fingerprint(text):
    low = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))
    w = re.findall(rb"[^\x20\x09-\x0D]+", low)
    shingles = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def test_golay_keys_meet_within_two_bits():
    rng = np.random.default_rng(7)
    x = rng.integers(0, 1 << 23, 300)
    keys = lambda v: [set(k[c]) for k, c in zip(*golay_simhash.golay_keys(np.array(v)), strict=True)]
    for flips in itertools.chain(itertools.combinations(range(23), 1), itertools.combinations(range(23), 2)):
        y = x ^ sum(1 << f for f in flips)
        assert all(a & b for a, b in zip(keys(x), keys(y), strict=True))


def test_fingerprints_within_four_bits_share_a_key():
    rng = np.random.default_rng(9)
    x = rng.integers(0, 1 << 63, 400, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 400, dtype=np.uint64)

    def keys(v):
        got = defaultdict(set)
        for r, k in zip(*golay_simhash.fingerprint_keys(v), strict=True):
            got[int(r)].add(int(k))
        return got

    own = keys(x)
    assert 30 < np.mean([len(k) for k in own.values()]) < 50
    for _ in range(40):
        flips = [rng.choice(64, int(rng.integers(1, 5)), replace=False) for _ in x]
        y = np.array([v ^ np.uint64(sum(1 << int(b) for b in f)) for v, f in zip(x, flips, strict=True)], np.uint64)
        assert all(own[i] & k for i, k in keys(y).items())


def test_simhash_groups(spark, corpus):
    rows = texts(corpus)
    prints = {i: fingerprint(t) for i, (d, t) in enumerate(rows)}
    links = [(i, j) for i, j in itertools.combinations(prints, 2) if bin(prints[i] ^ prints[j]).count("1") <= 4]
    group = roots(range(len(rows)), links)
    least = defaultdict(lambda: 1 << 60)
    for i, (d, _) in enumerate(rows):
        least[group[i]] = min(least[group[i]], d)
    want = sorted((d, prints[i], least[group[i]]) for i, (d, _) in enumerate(rows))
    got = sorted((r.id, r.prints[0] & (1 << 64) - 1, r.component_id) for r in golay_simhash.simhash_groups(corpus).collect())
    assert got == want
    assert golay_simhash.simhash_groups(corpus.where("doc_id < 0")).count() == 0


def test_simhash_dedup_keeps_one_of_each_group(spark, corpus):
    kept = golay_simhash.simhash_dedup(corpus)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == corpus.columns and len(ids) == len(set(ids))
    assert sum(60 <= i < 75 for i in ids) == 1 and sum(i in (5, 75, 76) for i in ids) == 1
    assert {i for i in range(60) if i not in (5,)} - set(ids) == set() or len({i for i in range(60)} - set(ids)) <= 2


def test_near_groups_are_those_of_exact_jaccard(spark):
    """Isolated pairs at 0.8 and more all meet, none below does, and repeated lines don't hide a copy."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(300):
        w = [f"p{i}x{j}" for j in range(200)]
        v = list(w)
        for at in rng.choice(200, int(rng.integers(1, 8)), replace=False):
            v[at] = f"e{i}x{at}"
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
    base = [f"q{j}" for j in range(120)]
    rows += [(1000, " ".join(base)), (1001, " ".join(base + ["again and again it went"] * 400)), (1002, ""), (1003, None)]
    for i in range(40):  # a chain, each text near its neighbours only
        rows.append((2000 + i, " ".join(f"c{j}" for j in range(10 * i, 10 * i + 120))))
    grams = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, t in rows for w in [(t or "").split()]}
    links = [(a, b) for a, b in itertools.combinations(grams, 2) if len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])]
    want = roots(list(grams), links)
    assert want[1001] == 1000 and want[2039] == 2000 and 100 < sum(want[2 * i + 1] == 2 * i for i in range(300)) < 300
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.id: r.component_id for r in golay_simhash.near_groups(df).collect()} == want
    kept = {r.doc_id for r in golay_simhash.simhash_dedup(df).collect()}
    assert kept == {d for d, r in want.items() if d == r}


def test_large_near_group_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(golay_simhash, "GROUP", 8)
    rows = [(i, " ".join(f"c{j}" for j in range(10 * i, 10 * i + 120))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in golay_simhash.near_groups(df).collect()} == {0}


# --- op8, op9 ---


def library_ids(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


ODD = ["Привет, мир! ‘quoted’ — dash…  два  слова", "混合 text と かな 123 ١٢٣ e\u0301 \u2003wide", "<|endoftext|> a<|endoftext|>", "naïve café x", "中文 текст 🙂 a  b", "tab\t\tnew\n\n line ", "'s 'll ''re 1234 5", "\x1c\x85 x"]


def test_token_counts(spark, corpus):
    ids = library_ids(tokens.default_tokenizer())
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)] + [(99, None), (None, "x")] + [(d + 100, t) for d, t in texts(corpus)], "doc_id long, text string")
    want = sorted((str(d), len((t or "").encode()), len(ids(t)), len(ids(t)) > 1024) for d, t in texts(df))
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.token_counts(df).collect())
    assert got == want and tokens.token_counts(df.where("doc_id < 0")).count() == 0


def test_packing_is_whole_and_tight(spark, corpus):
    ids = library_ids(tokens.default_tokenizer())
    df = spark.createDataFrame([(i + 1000, t) for i, t in enumerate(ODD)] + [(2000, None)], "doc_id long, text string").union(corpus.dropDuplicates(["doc_id"]).select("doc_id", "text"))
    packed = packing.pack_documents(df, with_ids=True).collect()
    want = {d: [*ids(t), 0] for d, t in texts(df)}
    parts, places = defaultdict(list), defaultdict(list)
    for r in packed:
        part = np.frombuffer(r.ids, "<u4").tolist()
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(part) == r.length <= 2048
        parts[r.doc_id].append((r.piece, r.start, part))
        places[r.sequence_id].append((r.offset, r.length))
    for d, full in want.items():
        own = sorted(parts[d])
        assert [x for _, _, p in own for x in p] == full and [k for k, _, _ in own] == list(range(len(own)))
        assert all(len(p) == 2048 for _, _, p in own[1:])
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) <= 1.02 * sum(map(len, want.values())) / 2048 + 1


def test_bounded_bins_close_the_fullest():
    fit = packing.BestFit(10, space=2)
    assert [fit.put(n) for n in (7, 6, 5, 3, 5, 4)] == [(0, 0), (1, 0), (2, 0), (1, 6), (2, 5), (3, 0)]


def plain_best_fit(lengths, size, space):
    """[(bin, offset)]: among the open bins the one left least free, the newest of equals; the fullest closes first."""
    open_, made, out = [], 0, []
    for n in lengths:
        fits = [b for b in open_ if b[1] >= n]
        if fits:
            left = min(b[1] for b in fits)
            b = [b for b in fits if b[1] == left][-1]
            open_.remove(b)
        else:
            b, made = [made, size], made + 1
            if n < size and len(open_) == space:
                least = min(x[1] for x in open_)
                open_.remove([x for x in open_ if x[1] == least][-1])
        out.append((b[0], size - b[1]))
        if b[1] > n:
            open_.append([b[0], b[1] - n])
    return out


def test_a_full_group_is_packed_as_by_a_plain_best_fit():
    """In arrival order, with a bound that is met many times."""
    rng = np.random.default_rng(13)
    lengths = np.minimum(rng.gamma(1.2, 500, packing.GROUP).astype(int) + 1, 2048).tolist()
    for space in (32, packing.OPEN):
        fit, most = packing.BestFit(2048, space), 0
        got = []
        for n in lengths:
            got.append(fit.put(n))
            most = max(most, fit.open)
        assert got == plain_best_fit(lengths, 2048, space) and most == space
        assert fit.made <= 1.02 * sum(lengths) / 2048


def test_repeated_rows_are_each_packed(spark):
    df = spark.createDataFrame([(1, "a b c")] * 3 + [(None, "d")], "doc_id long, text string")
    rows = packing.pack_documents(df).collect()
    assert len(rows) == 4 and len({(r.sequence_id, r.offset) for r in rows}) == 4


def test_sequences(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "d e")], "doc_id long, text string")
    rows = packing.sequences(packing.pack_documents(df, with_ids=True)).collect()
    assert len(rows) == 1 and len(rows[0].ids) == 4 * 7


# --- op10 ---


def test_raking_meets_the_marginals(spark, corpus):
    rows = mixing.mixing_probabilities(corpus, rounds=60).collect()
    assert len(rows) == corpus.count() and all(0 < r["__probability"] <= 1 for r in rows)
    cells = defaultdict(float)
    for r in rows:
        cells[r.source or "", r.lang or "", r["__topic"]] += r["__tokens"]
    weight = {(r.source or "", r.lang or "", r["__topic"]): r["__probability"] for r in rows}
    total = sum(cells[k] * weight[k] for k in cells)
    for d in range(3):
        own, got = defaultdict(float), defaultdict(float)
        for k, n in cells.items():
            own[k[d]] += n
            got[k[d]] += n * weight[k] / total
        goal = {v: n**mixing.TEMPERATURE for v, n in own.items()}
        for v in own:
            assert abs(got[v] - goal[v] / sum(goal.values())) < 0.02
    assert mixing.mix(corpus.where("doc_id < 0")).count() == 0 and mixing.mix(corpus).columns == corpus.columns


def test_given_targets_are_met_to_the_tolerance(spark, corpus, monkeypatch):
    weights = {("lang", "en"): 0.7, ("lang", ""): 0.3, ("source", "s0"): 0.4, ("source", "s1"): 0.6}
    targets = spark.createDataFrame([(*k, w) for k, w in weights.items()], "dimension string, value string, weight double")
    options = {"dimensions": ("source", "lang"), "rounds": 90, "targets": targets, "tolerance": 1e-6}
    rows = mixing.mixing_probabilities(corpus, **options).collect()
    total = sum(r["__tokens"] * r["__probability"] for r in rows)
    for (d, v), w in weights.items():
        assert abs(sum(r["__tokens"] * r["__probability"] for r in rows if (r[d] or "") == v) / total - w) < 1e-5
    monkeypatch.setattr(mixing, "FEW_CELLS", 0)  # many cells: the same probabilities by shuffled joins
    many = mixing.mixing_probabilities(corpus, **options).collect()
    keyed = lambda rs: sorted((str(r.doc_id), r.text or "", round(r["__probability"], 9), r["__sampled"]) for r in rs)
    assert keyed(many) == keyed(rows)
    for bad in ([("lang", "en", 1.0)], [("lang", "en", 0.5), ("lang", "", 0.4)], [("lang", "en", 0.5), ("lang", "", 0.3), ("lang", "xx", 0.2)], [("shape", "a", 1.0)]):
        with pytest.raises(ValueError, match="target weights"):
            mixing.mixing_probabilities(corpus, targets=spark.createDataFrame(bad, targets.schema))


def test_mixing_without_the_columns_and_by_a_topic_column(spark, corpus):
    bare = mixing.mixing_probabilities(corpus.select("doc_id", "text", "key"), topic_column="key").collect()
    assert len(bare) == corpus.count() and {r["__probability"] for r in bare} == {1.0}


def test_a_stray_row_does_not_shrink_the_mix(spark):
    """The budget is met whatever odd rows there are; they are kept whole, and large values have their target shares."""
    rng = np.random.default_rng(12)
    rows = [(i, " ".join(["w"] * int(rng.integers(50, 400))), "en" if i % 4 else "de", f"s{min(i % 10, 3)}") for i in range(2000)]
    for stray in ([], [(5000, "", "xx", "odd"), (5001, None, None, None)]):
        df = spark.createDataFrame(rows + stray, "doc_id long, text string, lang string, source string")
        out = mixing.mixing_probabilities(df, keep=mixing.KEEP).collect()
        total = sum(r["__tokens"] for r in out)
        kept = sum(r["__tokens"] * r["__probability"] for r in out)
        assert all(0 < r["__probability"] <= 1 for r in out) and abs(kept / total - mixing.KEEP) < 0.01
        assert all(r["__probability"] > 0.99 for r in out if r.doc_id >= 5000)
        own, got = defaultdict(float), defaultdict(float)
        for r in out:
            own[r.source] += r["__tokens"]
            got[r.source] += r["__tokens"] * r["__probability"]
        goal = {v: own[v] ** mixing.TEMPERATURE for v in own}
        assert all(abs(got[v] / kept - goal[v] / sum(goal.values())) < 0.02 for v in own)
        sampled = sum(len((r.text or "").split()) + 1 for r in mixing.mix(df).collect())
        assert abs(sampled / total - mixing.KEEP) < 0.04


def test_mixing_sql_twin(spark, corpus):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    documents = corpus.select("doc_id", "text", "source", "lang").toPandas()  # noqa: F841  read by DuckDB
    want = sorted(c.execute("select doc_id, topic, tokens, probability, sampled from (" + mixing.oracle_sql() + ")").fetchall())
    got = sorted((r.doc_id, r["__topic"], r["__tokens"], round(r["__probability"], 6), r["__sampled"]) for r in mixing.mixing_probabilities(corpus).collect())
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
    assert all(abs(g[3] - w[3]) < 2e-6 for g, w in zip(got, want, strict=True))


# --- the pipeline ---


def test_pipeline_stages(spark, tmp_path, corpus):
    import corpus_pipeline

    d = str(tmp_path)
    rng = np.random.default_rng(8)
    docs, labels = marked(spark, rng, 400)
    whole = docs.selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "cast(length(text) as long) as n_chars").unionByName(corpus.selectExpr("doc_id + 5000 as doc_id", "text", "lang", "source", "n_chars"))
    whole.write.parquet(f"{d}/documents.parquet")
    labels.write.parquet(f"{d}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash_near_dedup", "suffix_array_dedup", "mixing", "best_fit_packing"]
    df = spark.read.parquet(f"{d}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, df, d)
        assert out.columns == whole.columns, name
        out.write.parquet(f"{d}/{i}")
        df = spark.read.parquet(f"{d}/{i}")
        assert 0 < df.count() <= whole.count()
    toxic = {r.doc_id for r in labels.where("toxic = 1").collect()}
    left = {r.doc_id for r in spark.read.parquet(f"{d}/0").collect()}
    assert len(toxic & left) <= 0.05 * len(toxic) and len(left) >= whole.where("doc_id is null or doc_id >= 0").count() - len(toxic) - 8
    assert corpus_pipeline.STAGES[-1][1](spark, df, d).select("sequence_id").distinct().count() > 0
    assert corpus_pipeline.run(spark, d).count() > 0
    empty = df.where("doc_id < -1")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, d).count() == 0
