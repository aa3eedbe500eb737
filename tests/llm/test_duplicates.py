"""MinHash, embeddings and fingerprints."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from llm_cases import make_docs, prose, words_of
from pairscreen.llm import embeddings, exact, minhash, spotsigs
from pairscreen.llm.graph import components


def roots(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        if a == b:
            continue
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_any_shape(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(0, 60)]  # a long chain
    edges += [(100, 101 + i) for i in range(40)] + [(300 + i, 200) for i in range(5)]
    edges += [(rng.randrange(400, 480), rng.randrange(400, 480)) for _ in range(50)] + [(7, 7), (3, 2)]
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == roots(nodes, edges)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingle_set(text, k):
    w = words_of(text)
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_groups(rows, k, percent):
    sets = {i: shingle_set(t, k) for i, t, *_ in rows}
    edges = [(a, b) for a in sets for b in sets if a < b and sets[a] and
             100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return sets, roots(sets, edges)


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_against_all_pairs(spark, collection, k, monkeypatch):
    rows, docs = collection
    monkeypatch.setattr(minhash, "BLOCK", 4)  # large bands are cut into blocks
    sets, want = brute_groups(rows, k, 80)
    got = minhash.mark(minhash.near_duplicates(docs, k=k)).collect()
    assert {r.id: (r.n, r.component_id) for r in got} == {i: (len(sets[i]), want[i]) for i in sets}
    assert all(r.kept == (r.id == r.component_id) for r in got)


def test_links_between_members_that_miss_the_hub(spark):
    """A chain in one band: neighbours are alike, the ends are not."""
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(12):
        w = list(base)
        w[4 * i:4 * i + 4] = [f"x{i}{j}" for j in range(4)]
        rows.append((i, " ".join(w), "en", "a"))
    docs = make_docs(spark, rows)
    for percent in (60, 75, 80):
        want = brute_groups(rows, 2, percent)[1]
        got = minhash.mark(minhash.near_duplicates(docs, k=2, percent=percent)).collect()
        assert {r.id: r.component_id for r in got} == want


def test_keep_one(spark, collection):
    rows, docs = collection
    want = {i for i, c in brute_groups(rows, 5, 80)[1].items() if i == c}
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)


def test_near_duplicates_odd_rows(odd, empty):
    got = minhash.mark(minhash.near_duplicates(odd, k=2)).collect()
    by = {}
    for r in got:
        by.setdefault(r.id, []).append(r)
    assert len(got) == odd.count()
    assert all(by[i][0].n == 0 and by[i][0].component_id == i and by[i][0].kept for i in (1, 2, 9))
    assert by[5][0].component_id == 4 and by[11][0].component_id == 4 and not by[5][0].kept
    assert [r.component_id for r in by[7]] == [7, 7] and by[7][0].n == 1
    assert all(r.component_id is None for r in by[None])
    kept = [r.doc_id for r in minhash.keep_one(odd, k=2).collect()]
    # of the repeated rows one; of the equal rows without an id one, and the empty one
    assert sorted(i for i in kept if i is not None) == [1, 2, 3, 4, 7, 8, 9, 10, 12] and kept.count(None) == 2
    assert minhash.keep_one(empty).count() == 0


def test_copy_of_a_document_without_id(spark):
    docs = make_docs(spark, [(None, "a b c d", "en", "x"), (5, "A b c d", "en", "x"), (6, "other words", "en", "x")])
    got = {r.id: (r.component_id, r.kept) for r in minhash.mark(minhash.near_duplicates(docs, k=2)).collect()}
    assert got == {None: (5, False), 5: (5, True), 6: (6, True)}
    assert sorted(r.doc_id for r in minhash.keep_one(docs, k=2).collect()) == [5, 6]


def test_jaccard_estimates():
    rng = np.random.default_rng(3)
    errors = []
    for _ in range(30):
        shared, own = rng.integers(0, 2 ** 63, 600).astype(np.uint64), rng.integers(0, 2 ** 63, 200).astype(np.uint64)
        values = np.concatenate([shared, own[:100], shared, own[100:]])
        rows = np.repeat([0, 1], 700)
        regs = minhash.registers(*minhash.arrays.distinct(values, rows, 2), 2)
        found, used = minhash.estimate(regs[:1], regs[1:], np.array([700]), np.array([700]))
        errors.append(found[0] - 600 / 800)
        assert used[0] >= minhash.REGISTERS - 8
    assert abs(np.mean(errors)) < 0.03 and max(map(abs, errors)) < 0.2


def test_unrelated_registers_agree_as_often_as_chance_says():
    rng = np.random.default_rng(4)
    n, agreed = 20_000, 0
    for size in (200, 5000):
        regs = minhash.registers(rng.integers(0, 2 ** 63, size * 40).astype(np.uint64), np.repeat(np.arange(40), size), 40)
        same = sum(int(((regs[i] == regs[j]) & (regs[i] != 0xFFFF)).sum()) for i in range(40) for j in range(i))
        expected = minhash.chance(np.array(float(size)), np.array(float(size))) * 128 * 40 * 39 / 2
        assert 0.4 * expected < same < 2 * expected


def brute_vectors(rows, threshold=0.95):
    good = [(i, np.asarray(v, float)) for i, (_, v) in enumerate(rows)
            if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, edges = [0] * len(rows), []
    for a, x in good:
        for b, y in good:
            if a < b and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                links[a] += 1
                links[b] += 1
                edges.append((a, b))
    return links, edges


def test_vectors_against_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 16))
    vectors = [c + rng.normal(size=16) * s for c in centres for s in (0.02, 0.05, 0.1, 0.15, 0.25) for _ in range(8)]
    vectors += [rng.normal(size=16) for _ in range(100)] + [centres[0]] * 10 + [centres[0] * 3]
    order = rng.permutation(len(vectors))
    rows = [(int(i) * 2, [float(x) for x in vectors[int(j)]]) for i, j in enumerate(order)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    links, edges = brute_vectors(rows)
    want = roots(range(len(rows)), edges)
    for name, value in (("HOME_BLOCK", 16), ("GUEST_BLOCK", 32), ("TILE", 5)):
        monkeypatch.setattr(embeddings, name, value)
    for per_cell in (1000, 40, 8):
        got = embeddings.near_duplicates(df, per_cell=per_cell).collect()
        assert {r.id: (r.n_links, r.component_id) for r in got} == {
            rows[i][0]: (links[i], rows[want[i]][0]) for i in range(len(rows))}, per_cell
        assert all(r.kept == (r.id == r.component_id) for r in got)


def test_vectors_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, -0.0]), (3, [2.0, 0.0]), (4, [0.0, 0.0]), (5, None), (6, []), (7, [1.0, nan]),
            (8, [inf, 0.0]), (9, [1.0, None]), (10, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (12, [0.0, 1.0]), (12, [0.0, 1.0]),
            (None, [-1.0, 0.0]), (15, [1e-40, 1e-40]), (16, [1e30, 1e30])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'x' as node", "'y' as vector", "1 as n")
    got = embeddings.near_duplicates(df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.id, []).append(tuple(r[1:]))
    assert by[1] == [(3, 1, True)] and by[2] == [(3, 1, False)] and by[3] == [(3, 1, False)]
    assert all(by[i] == [(0, i, True)] for i in (4, 5, 6, 7, 8, 9, 10))
    assert by[12] == [(1, 12, True)] * 2 and by[15] == [(1, 15, True)] and by[16] == [(1, 15, False)]
    assert sorted(by[None], key=str) == sorted([(3, 1, False), (0, None, True)], key=str)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0
    assert embeddings.near_duplicates(df.filter("vec_id = 4")).collect()[0].kept


def test_spherical_means_fill_all_cells():
    rng = np.random.default_rng(2)
    x = embeddings.units(np.vstack([rng.normal(size=(50, 4)), np.tile([1.0, 0, 0, 0], (50, 1))]))
    centroids = embeddings.fit_centroids(x, 10)
    assert centroids.shape == (10, 4) and np.allclose(np.linalg.norm(centroids, axis=1), 1)
    assert embeddings.fit_centroids(x[:3], 10).shape == (3, 4)


def parts(fingerprint):
    return {fingerprint[i:i + 8] for i in range(0, len(fingerprint), 8)}


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_follow_an_edit(spark, collection):
    rows, docs = collection
    got = {r.doc_id: r for r in spotsigs.compare_with_next(docs).collect()}
    order = sorted(rows, reverse=True)
    assert len(got) == len(rows)
    by_text = {}
    for k, (i, text, *_) in enumerate(order):
        j, after, *_ = order[(k + 1) % len(order)]
        half, r = len(text) // 2, got[i]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256((text[:len(text) - half] + after[:half]).encode()).hexdigest()
        assert abs(r.near_edited - alike(parts(r.fingerprint), parts(r.edited_fingerprint))) < 1e-12
        assert abs(r.near_next - alike(parts(r.fingerprint), parts(got[j].fingerprint))) < 1e-12
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint


def test_chains_after_anchors(spark):
    texts = ["The quick brown fox, and the lazy dog of war", "no anchor words here", "...", None, "THE quick  brown fox and lazy dog is war!"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.s for r in spotsigs.with_signatures(df, df.t, "s").collect()}
    hashes = lambda words: sorted(r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").selectExpr("hash(w)").collect())
    assert got[0] == hashes(["quick brown", "lazy dog", "war"]) == got[4]
    assert len(got[1]) == 1 and got[2] == [] and got[3] == []


def test_fingerprints_odd_rows(odd, empty):
    got = spotsigs.compare_with_next(odd).collect()
    assert len(got) == odd.count() and all(0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1 for r in got)
    assert {r.fingerprint for r in got if r.n_chars == 0} == {""}
    assert spotsigs.compare_with_next(empty).count() == 0
    one = spotsigs.compare_with_next(odd.filter("doc_id = 4")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert spotsigs.fingerprints(odd).count() == odd.count()


def test_fingerprint_groups_against_all_pairs(spark, collection):
    rows, docs = collection
    sets = {r.doc_id: frozenset(r.signatures) for r in spotsigs.fingerprints(docs).collect()}
    for threshold in (0.5, 0.8):
        edges = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and alike(sets[a], sets[b]) >= threshold]
        got = {r.id: r.component for r in spotsigs.near_groups(docs, threshold=threshold).collect()}
        assert got == roots(sets, edges)


def test_hopeless_lengths_are_not_compared(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], [1]), ([1, 2], [1, 2]), ([], [1]), ([], [])], "a array<int>, b array<int>")
    got = [r.x for r in spotsigs.with_likeness(df, "a", "b", "x", 0.5).collect()]
    assert got == [None, 1.0, None, 1.0]
    assert [r.x for r in spotsigs.with_likeness(df, "a", "b", "x").collect()] == [0.25, 1.0, 0.0, 1.0]


def test_sketch_bytes():
    assert minhash._regs(pa.array([b"\x01\x00" * 128])).tolist() == [[1] * 128]


def test_a_bit_map_spares_rows_a_join_and_changes_none(spark, monkeypatch):
    rows, wanted = spark.range(1000), spark.range(0, 1000, 10)
    got = [r.id for r in minhash.marked(rows, "id", wanted).filter("_may").collect()]
    assert {r.id for r in wanted.collect()} <= set(got) and len(got) < 110
    assert not minhash.marked(rows, "id", wanted.limit(0)).filter("_may").count()

    text = "one two three four five six seven eight nine"
    docs = make_docs(spark, [(i, f"{text} {i % 7}" if i % 3 else f"other{i} " + text[::-1] + f" {i}", "en", "a") for i in range(40)]
                     + [(5, f"{text} 5", "en", "a"), (None, "without an id", "en", "a"), (50, None, "en", "a")])
    few = sorted(minhash.keep_one(docs).collect(), key=str)
    monkeypatch.setattr(exact, "MAP_BITS", 8)  # nearly all rows are marked
    assert few == sorted(minhash.keep_one(docs).collect(), key=str)
