import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from llm_cases import EN, make_docs, words_of
from pairscreen.llm import suffix_tree

def held_col():
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 1


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def test_base_scores_by_hand_and_the_tree_beats_them(spark):
    rng = random.Random(12)
    follow = {w: rng.sample(EN, 3) for w in EN}
    rows = []
    for i in range(300):
        w = [rng.choice(EN)]
        for _ in range(60):  # words depend on the one before
            w.append(rng.choice(follow[w[-1]]) if rng.random() < 0.9 else f"rare{rng.randrange(3000)}")
            if w[-1] not in follow:
                w.append(rng.choice(EN))
        rows.append((i, " ".join(w), "en", "a"))
    got = suffix_tree.score(make_docs(spark, rows), held_col()).collect()
    assert len(got) == len(rows)
    tokens = {i: words_of(t) + [None] for i, t, *_ in rows}
    counts = Counter(w for i in tokens if not held(i) for w in tokens[i])
    n, v = sum(counts.values()), len(counts)
    for r in got:
        want = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens[r.doc_id])
        assert r.held_out == held(r.doc_id) and r.n_tokens == len(tokens[r.doc_id]) and r.train_tokens == n
        assert r.n_known == sum(counts[w] > 0 for w in tokens[r.doc_id]) and math.isclose(r.base_score, want, rel_tol=1e-9)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > 0.8 * sum(r.base_score for r in out)


def slow_score(words, counts, tree, paths):
    """Score of one text by walking contexts word by word."""
    symbol = {int(w): int(s) for w, s in zip(tree.words, tree.symbols)}
    history, total = [tree.end], 0.0
    for w in words:
        x = symbol.get(w, 0)
        state = 0
        for d in range(1, suffix_tree.DEPTH + 1):
            state = paths.get(tuple(history[-d:]), state) if len(history) >= d else state
        total += tree.logs[state, x]
        if x == 0:
            c = counts.get(w, 0)
            own = (c - tree.discount if c else tree.discount * tree.distinct) / tree.total
            total += math.log10(own) - tree.logs[0, 0]
        history.append(x)
    return total


def test_tree_against_walking(spark, monkeypatch):
    from pairscreen.llm import arrays
    import pyarrow as pa

    monkeypatch.setattr(suffix_tree, "LEAST_SYMBOL", 0.01)
    monkeypatch.setattr(suffix_tree, "LEAST_CONTEXT", 0.002)
    rng = random.Random(3)
    rows = []
    for i in range(120):
        w = []
        while len(w) < 40:
            w += rng.choice([["a", "b", "c"], ["a", "b", "d", "e"], ["x", "b", "f"], [f"r{rng.randrange(40)}"]])
        rows.append((i, " ".join(w), "en", "a"))
    docs = make_docs(spark, rows)
    chunks = suffix_tree.materialize(suffix_tree.encode(docs, "doc_id", "text", held_col()), "test-chunks")
    counted = suffix_tree.word_counts(chunks)
    counts = {r.word: r.c for r in counted.collect()}
    tree = suffix_tree.grow(chunks, counted)
    assert len(tree.index) == suffix_tree.DEPTH and len(tree.logs) > 5
    assert np.allclose((10 ** tree.logs).sum(axis=1), 1)  # every state is a distribution

    # the contexts behind the numbers
    paths, level = {}, None
    for d, (table, state) in enumerate(zip(tree.index, tree.state)):
        names = {}
        for at in np.argwhere(table >= 0):
            path = (int(at[0]),) if d == 0 else level[int(at[0])] + (int(at[1]),)
            names[int(table[tuple(at)])] = path
            if state[table[tuple(at)]] >= 0:
                paths[path] = int(state[table[tuple(at)]])
        level = names
    assert max(map(len, paths)) >= 2

    got = {r.doc_id: r.score for r in suffix_tree.score(docs, held_col()).collect()}
    for i, text, *_ in rows[:40]:
        hashes, _ = arrays.words(*arrays.buffer(pa.array([text])))
        words = [int(h) for h in hashes.view(np.int64)] + [suffix_tree.END]
        assert math.isclose(got[i], slow_score(words, counts, tree, paths), rel_tol=1e-9)


def test_probabilities_sum_to_one_over_words(spark):
    rows = [(i, f"the cat w{i} w{i % 7} sat", "en", "a") for i in range(50)]
    docs = make_docs(spark, rows)
    chunks = suffix_tree.materialize(suffix_tree.encode(docs, "doc_id", "text", held_col()), "test-chunks")
    counted = suffix_tree.word_counts(chunks)
    tree = suffix_tree.grow(chunks, counted)
    inside = 10 ** tree.logs[0, 0]
    listed = set(tree.words.tolist())
    rest = sum(r.c - tree.discount for r in counted.collect() if r.word not in listed) / tree.total
    assert math.isclose(rest + tree.discount * tree.distinct / tree.total, inside, rel_tol=1e-9)


def test_odd_rows(odd, empty):
    got = suffix_tree.score(odd, held_col()).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert by[1].n_tokens == by[2].n_tokens == by[9].n_tokens == 1
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert suffix_tree.score(empty, held_col()).count() == 0
    # nothing to learn from: both scores are the base
    alone = suffix_tree.score(odd, F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.score == r.base_score for r in alone)


@pytest.mark.parametrize("lengths", [[1], [2, 1, 3]])
def test_contexts_stop_at_documents(lengths):
    symbols = np.arange(10, 10 + sum(lengths))
    one, two = suffix_tree._contexts(symbols, np.asarray(lengths), 2, 5)
    place = 0
    for n in lengths:
        before = [5]
        for k in range(n):
            assert one[place] == before[-1] and two[place] == (before[-2] if len(before) > 1 else -1)
            before.append(symbols[place])
            place += 1


def test_rare_words_and_contexts_are_in_the_tree(spark):
    """Words of a few occurrences among very many tokens are symbols and contexts, however large the rest."""
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(EN) for _ in range(100)), "en", "a") for i in range(600)]
    rows += [(1000 + i, f"{rng.choice(EN)} seldom follows {rng.choice(EN)}", "en", "a") for i in range(12)]
    docs = make_docs(spark, rows)
    chunks = suffix_tree.materialize(suffix_tree.encode(docs, "doc_id", "text", F.lit(False)), "test-chunks")
    counted = suffix_tree.word_counts(chunks)
    few = [r.word for r in counted.collect() if r.c == 12]
    tree = suffix_tree.grow(chunks, counted)
    assert len(few) == 2 and set(few) <= set(tree.words.tolist())
    one, two = (int(np.flatnonzero(tree.words == w)[0]) + 1 for w in few)
    kept = [tree.state[0][tree.index[0][x]] for x in (one, two)]
    assert max(kept) > 0  # 12 of 61,000 tokens make a kept context
    logs = tree.logs[[k for k in kept if k > 0]]
    assert max(logs[:, one].max(), logs[:, two].max()) > math.log10(0.9)  # "follows" after "seldom"


def test_hot_contexts_over_shards(spark, monkeypatch):
    """The same scores whether a context's runs are in one shard or in all."""
    rng = random.Random(9)
    docs = make_docs(spark, [(i, " ".join("the" if rng.random() < 0.3 else rng.choice(EN) for _ in range(60)), "en", "a") for i in range(150)])
    many = {r.doc_id: r.score for r in suffix_tree.score(docs, held_col()).collect()}
    make, made = suffix_tree._model, []

    def one_shard(counts):
        model = make(counts)
        model.bits = 1
        made.append(model)
        return model

    monkeypatch.setattr(suffix_tree, "_model", one_shard)
    few = {r.doc_id: r.score for r in suffix_tree.score(docs, held_col()).collect()}
    monkeypatch.setattr(suffix_tree, "_model", lambda counts: made.append(make(counts)) or made[-1])
    suffix_tree.score(docs, held_col())
    assert not len(made[0].hot[0][0]) and len(made[1].hot[0][0])
    assert many.keys() == few.keys() and all(math.isclose(many[i], few[i], rel_tol=1e-9) for i in many)


def test_questions_are_short(spark):
    """A run is asked for by a small step and its count, not by a hash; packing keeps every array."""
    parts = [np.arange(5, dtype=np.uint64) << np.uint64(40), np.zeros(0, np.uint8), np.asarray([0.1, -2.5]), np.asarray([7, 1 << 31], np.uint32)]
    back = suffix_tree._unpack(suffix_tree._pack(*parts), np.uint64, np.uint8, np.float64, np.uint32)
    assert all(np.array_equal(x, y) and x.dtype == y.dtype for x, y in zip(parts, back))

    rng = random.Random(3)
    rows = [(i, " ".join(f"w{int(300 * rng.random() ** 2)}" for _ in range(400)), "en", "a") for i in range(60)]
    chunks = suffix_tree.materialize(suffix_tree.encode(make_docs(spark, rows), "doc_id", "text", F.lit(False)), "test-chunks")
    counted = suffix_tree.materialize(suffix_tree.word_counts(chunks), "test-counts")
    model, replies = suffix_tree._model(counted), suffix_tree._word_replies(chunks, counted).toArrow()
    left = chunks.toArrow()
    for i in range(left.num_rows):
        one = left.slice(i, 1)
        walk = suffix_tree._walk(one, replies.filter(pc.equal(replies.column("of"), one.column("chunk")[0])), model, 1)
        walk.ask()
        asked = sum(len(x) for _, x in walk.questions(np.zeros(len(walk.lengths), bool)))
        assert asked < 3 * len(walk.runs) + 24 * len(walk.keys)


@pytest.mark.parametrize("top", [0, 5, 1 << 40, (1 << 62) - 1])
def test_distinct_codes(top):
    """The same whether codes leave room for their positions or not."""
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        codes = rng.integers(0, 40, n) * (top // 40) + rng.integers(0, min(top, 3) + 1, n)
        values, places = suffix_tree._distinct(codes)
        assert np.array_equal(values, np.unique(codes)) and np.array_equal(values[places], codes)


def test_runs_are_numbered_without_sorting_positions(spark, monkeypatch):
    """No step of a walk sorts the places of all tokens, which took most of its time."""
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(EN[:12]) for _ in range(300)), "en", "a") for i in range(40)]
    chunks = suffix_tree.materialize(suffix_tree.encode(make_docs(spark, rows), "doc_id", "text", F.lit(False)), "test-chunks")
    counted = suffix_tree.materialize(suffix_tree.word_counts(chunks), "test-counts")
    model, replies = suffix_tree._model(counted), suffix_tree._word_replies(chunks, counted).toArrow()
    left = chunks.toArrow().slice(0, 1)
    walk = suffix_tree._walk(left, replies.filter(pc.equal(replies.column("of"), left.column("chunk")[0])), model, 1)
    sorted_ = []
    for name in ("unique", "lexsort", "argsort"):
        monkeypatch.setattr(np, name, lambda x, *a, f=getattr(np, name), **b: sorted_.append(np.shape(x)[-1]) or f(x, *a, **b))
    walk.ask()
    assert len(walk.here) == len(walk.tokens) > 2000 and max(sorted_) == len(walk.runs) < 200
    contexts = np.searchsorted(walk.starts, np.arange(len(walk.runs)), "right") - 1
    assert np.array_equal(walk.entry, contexts) and np.array_equal(np.unique(walk.at), np.arange(len(walk.runs)))
