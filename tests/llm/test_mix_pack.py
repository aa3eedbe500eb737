"""Mixing, packing and token counts."""

import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from llm_cases import make_docs, prose, words_of
from pairscreen.llm import mixing
from pairscreen.llm.catalog import word_tokenizer
from pairscreen.llm.packing import Packer, pack
from pairscreen.llm.token_counts import count_tokens
from pairscreen.llm.tokens import load


def fill(sizes, weights, share, cap):
    """Water filling by hand: source -> target."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        if not free:
            return {s: cap * sizes[s] for s in names}
        level = (total - sum(cap * sizes[s] for s in capped)) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] >= cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in capped else level * weight[s] for s in names}
        capped |= over


def source_docs(spark):
    rng = random.Random(1)
    rows = []
    for s, n in (("b", 300), ("ä", 40), ("a", 12), (None, 60), ("z", 3)):
        rows += [(s, prose(rng, rng.randint(1, 60))) for _ in range(n)]
    rows.append(("b", prose(rng, 900)))
    return [(i, t, "en", s) for i, (s, t) in enumerate(rows)]


def test_mix_meets_targets(spark):
    rows = source_docs(spark)
    docs = make_docs(spark, rows)
    got, plan = mixing.plan_mix(docs, (3, 1, 2), 1.5)
    out = mixing.decide(got, plan).collect()
    size = Counter()
    for i, t, _, s in rows:
        size[s] += len(words_of(t))
    want = fill(size, (3, 1, 2), 1.5, 2)
    taken = Counter()
    for r in out:
        assert r._size == len(words_of(rows[r._id][1])) and r.source_size == size[r._source]
        assert abs(r.target - want[r._source]) < 1e-6 * want[r._source] and 0 <= r.copies <= 2
        taken[r._source] += r.copies * r._size
    for s, n in want.items():
        assert abs(taken[s] - n) <= 30, s
    again = mixing.decide(*mixing.plan_mix(docs.repartition(7), (3, 1, 2), 1.5)).collect()
    assert Counter((r._id, r.copies) for r in out) == Counter((r._id, r.copies) for r in again)
    # the mix itself: whole rows, as often as decided
    mixed = mixing.mix(docs, (3, 1, 2), 1.5)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({r._id: r.copies for r in out if r.copies})


def test_pareto_inclusion_follows_weights(spark):
    """Many small documents: heavy ones come in about as often as their odds say."""
    rows = [(i, "one two", "en", "s") for i in range(4000)]
    docs = make_docs(spark, rows).selectExpr("*", "if(doc_id % 2 = 0, 3.0, 1.0) as w")
    got = mixing.decide(*mixing.plan_mix(docs, (1,), 0.25, weight_col="w")).collect()
    heavy, light = (sum(r.copies for r in got if r._id % 2 == k) for k in (0, 1))
    assert abs(heavy + light - 1000) <= 1
    assert abs(heavy - 750) < 60 and abs(light - 250) < 60


def test_mix_odd_rows(odd, empty):
    out = mixing.decide(*mixing.plan_mix(odd, (3, 1, 2), 1.5))
    rows = out.collect()
    assert len(rows) == odd.count()
    assert all(r.copies <= 2 for r in rows) and all(r.target == 0 for r in rows if r.source_size == 0)
    assert len({r.copies for r in rows if r._id == 7}) == 1
    mixed = mixing.mix(odd, (3, 1, 2), 1.5)
    assert mixed.columns == odd.columns and mixed.count() == sum(r.copies for r in rows)
    assert mixing.mix(empty, (3, 1, 2), 1.5).count() == 0
    assert mixing.decide(*mixing.plan_mix(empty, (3, 1, 2), 1.5)).count() == 0


def slow_level(counts, size, window):
    """The best level by trying all and summing squares."""
    best = None
    for level in range(window - size, -1, -1):
        if level and not counts[level]:
            continue
        after = counts.copy()
        if level:
            after[level] -= 1
        if level + size < window:
            after[level + size] += 1
        cost = int((after[1:window] ** 2).sum())
        if best is None or cost < best[0]:
            best = (cost, level)
    return best[1]


@settings(max_examples=60, deadline=None)
@given(st.integers(4, 40), st.integers(1, 6), st.lists(st.integers(1, 90), max_size=60))
def test_packer(window, limit, sizes):
    packer, pieces = Packer(window, limit), []
    for k, size in enumerate(sizes):
        rest = size % window
        if rest and packer.n_open < limit:
            level = packer._level(rest)
            tried = slow_level(packer.counts, rest, window)
            squares = lambda at: sum(
                (int(c) + (h == at + rest) - (h == at)) ** 2 for h, c in enumerate(packer.counts) if 0 < h < window)
            assert squares(level) == squares(tried)
        pieces += packer.add(k, np.full(size, k, np.uint32))
        assert packer.n_open <= limit
    fill_levels = sorted((h for h, c in enumerate(packer.counts) for _ in range(c)), reverse=True)
    pieces += packer.close()
    # the fullest windows keep what they hold; only the emptiest are taken apart
    whole = sum(fill_levels) // window
    assert packer.moved <= sum(fill_levels[whole:]) and packer.moved <= sum(window - h for h in fill_levels[:whole + 1])
    at = Counter()
    for document, start, ids, sequence, offset in sorted(pieces, key=lambda p: (p[0], p[1])):
        assert start == at[document] and len(ids)
        at[document] += len(ids)
    assert at == Counter(dict(enumerate(sizes)))
    filled = {}
    for _, _, ids, sequence, offset in sorted(pieces, key=lambda p: (p[3], p[4])):
        assert offset == filled.get(sequence, 0)
        filled[sequence] = offset + len(ids)
    # nothing is padded: full windows, or powers of two
    assert all(n == window or n & (n - 1) == 0 for n in filled.values())


def test_pack_round_trip(spark, odd, empty):
    tokenizer = load(word_tokenizer())
    rows = odd.select("doc_id", "text").collect()
    got = pack(odd, word_tokenizer(), window=256, open_windows=4).collect()
    want = Counter()
    for r in rows:
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2]
        want[r.doc_id, tuple(ids)] += 1
    docs, levels = Counter(), {}
    single = {}
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length
        levels.setdefault(r.sequence_id, []).append((r.offset, r.length))
        if r.doc_id is not None and r.doc_id != 7:
            single.setdefault(r.doc_id, []).append((r.start, ids))
    for key, n in want.items():
        if key[0] is not None and key[0] != 7:
            parts = sorted(single[key[0]], key=lambda p: p[0])
            assert tuple(np.concatenate([p[1] for p in parts]).tolist()) == key[1]
    assert sum(r.length for r in got) == sum(len(k[1]) * n for k, n in want.items())
    for parts in levels.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end == 256 or end & (end - 1) == 0
    assert pack(empty, word_tokenizer()).count() == 0


def test_token_counts(spark, odd, empty, tmp_path, monkeypatch):
    tokenizer = load(word_tokenizer())
    want = Counter((r.doc_id, len((r.text or "").encode()), len(tokenizer.encode(r.text or "", add_special_tokens=False).ids))
                   for r in odd.select("doc_id", "text").collect())
    cache = str(tmp_path / "cache")
    got = count_tokens(odd, word_tokenizer(), cache)
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got.collect()) == want
    stored = spark.read.parquet(cache)
    n = stored.count()
    # each digest once (repeated rows, id included, at most once for each task)
    assert stored.distinct().count() == stored.select("digest").distinct().count()
    # a second run finds all counts
    again = count_tokens(odd, word_tokenizer(), cache)
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in again.collect()) == want
    assert spark.read.parquet(cache).count() == n
    # white space does not matter to this tokenizer; entries of other versions do not count
    more = make_docs(spark, [(90, " once\t", "en", "a"), (91, "never seen", "en", "a")])
    rows = {r.doc_id: r.n_tokens for r in count_tokens(more, word_tokenizer(), cache).collect()}
    assert rows == {90: 1, 91: len(tokenizer.encode("never seen").ids)} and spark.read.parquet(cache).count() == n + 1
    assert count_tokens(empty, word_tokenizer()).count() == 0


def test_token_counts_of_pieces(spark):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["Hello  world", None, " Hello  world", "ä中"]
    got = count_tokens(make_docs(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]), path)
    assert {r.doc_id: r.n_tokens for r in got.collect()} == {i: len(model.encode(t or "")) for i, t in enumerate(texts)}
