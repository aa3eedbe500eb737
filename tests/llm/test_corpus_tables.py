"""Exact duplicates, phrases and divergences against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from llm_cases import LOWER, make_docs, odd_rows, prose
from pairscreen.llm import divergence, exact, phrases


# -- exact duplicates ----------------------------------------------------------

def check_exact(rows, out):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    assert len(out) == len(rows)
    kept = defaultdict(list)
    for r in out:
        ids = groups[r.text or ""]
        least = max((i for i in ids if i is not None), default=None)
        assert r.group_size == len(ids) and r.keep_id == least, r
        assert r.text_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
        if r.kept:
            kept[r.text or ""].append(r.doc_id)
    assert {t: v for t, v in kept.items()} == {t: [max((i for i in ids if i is not None), default=None)] for t, ids in groups.items()}


def found_exact(docs):
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    return exact.exact_duplicates(docs, carried={"text_sha256": digest, "text": F.col("text")}).collect()


def test_exact_groups(spark):
    rng = random.Random(5)
    long = prose(rng, 3000)
    rows = [(i, prose(rng, rng.choice([1, 2, 30, 400]))) for i in range(60)]
    rows += [(100 + i, "a third of all rows") for i in range(50)]
    rows += [(200, long), (201, long), (202, long[:-1] + "!"), (203, "X" + long[1:]), (204, long[:300]), (205, long + " ")]
    rows += [(300, "abc"), (301, "ABC"), (302, "abc "), (303, "é"), (304, "é"), (305, ""), (306, None)]
    rows += [(i + 500, t) for i, t in rows[:20]]
    rng.shuffle(rows)
    docs = make_docs(spark, [(i, t, "en", "a") for i, t in rows])
    check_exact(rows, found_exact(docs.repartition(5)))


def test_exact_takes_odd_rows(spark, odd, empty):
    check_exact(odd_rows(), found_exact(odd))
    assert found_exact(empty) == []
    assert exact.exact_duplicates(empty).columns == ["doc_id", "keep_id", "group_size", "kept"]


def test_whole_texts_are_hashed_only_where_length_and_prefix_meet(spark):
    head = "h" * exact.PREFIX
    rows = [(1, head + "aaa"), (2, head + "bbb"), (3, head + "cc"), (4, "g" * exact.PREFIX + "ddd"), (5, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = docs.select("doc_id", F.octet_length("text").alias("size"), F.xxhash64(F.substring("text", 1, exact.PREFIX)).alias("prefix"))
    shared = exact.shared_cells(keyed)
    assert [r.doc_id for r in keyed.join(shared, ["size", "prefix"]).orderBy("doc_id").collect()] == [1, 2]
    bits = exact.bit_map(shared).collect()
    assert len(bits) == 1 and sum(bin(b).count("1") for b in bytes(bits[0].bits)) == 1


# -- phrases -------------------------------------------------------------------

def brute_phrases(rows, least, top):
    n, count = Counter(), defaultdict(Counter)
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, 6):
                for i in range(len(words) - m + 1):
                    count[lang][tuple(words[i:i + m])] += 1
    out = []
    for lang, f in count.items():
        often = {p: a for p, a in f.items() if 2 <= len(p) and a >= least}
        covered = set()
        for p, a in often.items():
            for m in range(2, len(p)):
                covered |= {p[i:i + m] for i in range(len(p) - m + 1) if a >= f[p[i:i + m]]}
        best = []
        for p, a in often.items():
            if p not in covered:
                score, k = min((1000 * a * n[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                best.append((score, a, " ".join(p), f[p[:k]], f[p[k:]]))
        best.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i, p, a, l, r, n[lang], s) for i, (s, a, p, l, r) in enumerate(best[:top], 1)]
    return sorted(out)


def found_phrases(docs, least, top):
    return sorted(tuple(r) for r in phrases.collocations(docs, least=least, top=top).collect())


def test_phrases_equal_counting(spark):
    """Enough words for well-filled tiles, and for pairs outside the corner."""
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(1300)]
    weights = [1 / (i + 1) for i in range(1300)]
    rows = []
    for i in range(12):
        words = rng.choices(vocabulary, weights, k=4000) + rng.sample(vocabulary, 1300)
        for _ in range(60):
            words.insert(rng.randrange(len(words)), "New York Times, the Old. A b c d e f")
        rows.append((i, " ".join(w + rng.choice([" ", "\t", ". ", "\n"]) if rng.random() < 0.1 else w for w in words), "en" if i % 4 else None, "a"))
    rows += [(100 + i, "rare words come once more " * 3, "de", "a") for i in range(3)]
    docs = make_docs(spark, rows).repartition(3)
    want = brute_phrases(rows, 3, 400)
    assert len({r[0] for r in want}) == 3 and max(len(r[2].split(" ")) for r in want) == 5
    assert found_phrases(docs, 3, 400) == want


def test_phrases_tiles(spark):
    """Both ways of counting a tile were taken above, and give the same."""
    rng = np.random.default_rng(3)
    numbers = rng.zipf(1.3, 60_000).clip(0, 2000) - (rng.random(60_000) < 0.05)
    chunks = spark.createDataFrame([(k, "en", bytearray(phrases._pack(part))) for k, part in enumerate(np.array_split(numbers, 2))]
                                   + [(9, "de", bytearray(phrases._pack(numbers[:5000])))], "chunk long, lang string, numbers binary")
    parts = phrases.count_pairs(chunks, 4)
    kinds = {(r.lang, len(phrases._open(r.blob))) for r in parts.collect()}
    assert {("en", 1), ("en", 2), ("en", 3), ("de", 3)} <= kinds
    want = Counter()
    for lang, part in [("en", p) for p in np.array_split(numbers, 2)] + [("de", numbers[:5000])]:
        want.update((lang, int(a) - 1, int(b) - 1) for a, b in zip(part[:-1], part[1:]) if a and b)
    got = {(r.lang, r.i, r.j): r.a for r in phrases.frequent_pairs(parts, 4).collect()}
    assert got == {k: v for k, v in want.items() if v >= 4}


def test_scores_are_exact_beyond_64_bits(spark):
    big = 3 * 10 ** 16
    rows = [(big, 9 * 10 ** 16, [big + 7, big + 1, big], [2 * big, big + 3, big])]
    df = spark.createDataFrame(rows, "a long, n long, pre array<long>, suf array<long>").select("a", "n", "pre", "suf", phrases.lowest_cut().alias("c"))
    r = df.first()
    want = min((1000 * r.a * r.n // (r.pre[k - 1] * r.suf[2 - k]), k) for k in (1, 2))
    assert (r.c.score, r.c.k) == want


def test_phrases_take_odd_rows(spark, odd, empty):
    assert found_phrases(odd, 2, 100) == brute_phrases(odd_rows(), 2, 100)
    assert found_phrases(empty, 2, 100) == [] and found_phrases(odd, 10 ** 6, 10) == []


# -- divergences ---------------------------------------------------------------

def brute_divergences(rows):
    documents, count, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        key = (lang or "", source or "")
        groups.add(key)
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        count[key].update(terms)
        documents[key[0]].update(set(terms))
    out = []
    for lang in {g for g, _ in groups}:
        kept = [t for t, d in documents[lang].items() if d >= divergence.LEAST_DOCS]
        sources = sorted(s for g, s in groups if g == lang)

        def p_of(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10 ** 9 * (counts[t] + 2) // (total + 2 * len(kept)) for t in kept}

        whole = Counter()
        for s in sources:
            whole.update(count[lang, s])
        q = p_of(whole)
        p = {s: p_of(count[lang, s]) for s in sources}
        for s in sources:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // (p[s][t] + q[t])), t.encode(), t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:divergence.TOP])):
                out += [(lang, s, part, item, -v, i) for i, (v, _, item) in enumerate(items, 1)]
    return sorted(out)


def found_divergences(docs):
    return sorted(tuple(r) for r in divergence.divergences(docs).select("lang", "source", "part", "item", "value", "rank").collect())


def test_divergences_equal_counting(spark):
    rng = random.Random(2)
    words = [f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(2500)] + ["Éa", "中文"]
    rows = []
    for i in range(400):
        source = rng.choice(["a", "a", "a", "b", "ä", None, "c"])
        own = words if source != "b" else words[:900]
        rows.append((i, " ".join(rng.choices(own, k=rng.choice([0, 3, 90]))) + rng.choice(["", " It's", "1x2"]), rng.choice(["en", "en", None, "de"]), source))
    rows += [(900 + i, "only few", "fr", f"s{i}") for i in range(3)] + [(950, None, "en", "silent"), (951, "", "en", "mute")]
    assert found_divergences(make_docs(spark, rows).repartition(5)) == brute_divergences(rows)


def test_divergences_in_blocks_of_sources(spark):
    """More sources than a block, some without any kept word."""
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices("red green blue white black".split(), k=rng.choice([0, 2, 6]))), "en", f"s{i % 300}") for i in range(900)]
    assert found_divergences(make_docs(spark, rows)) == brute_divergences(rows)


def test_divergences_take_odd_rows(spark, odd, empty):
    rows = odd_rows()
    assert found_divergences(odd) == brute_divergences(rows) and found_divergences(empty) == []
    many = odd.unionByName(odd).unionByName(odd).unionByName(odd).unionByName(odd)
    assert found_divergences(many) == brute_divergences(rows * 5)


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10 ** 14), st.integers(1, 10 ** 14)), min_size=1, max_size=4))
def test_p_is_exact(spark, cases):
    cases = [(n, n + more, 10 ** 6) for n, more in cases]
    df = spark.createDataFrame(cases, "n long, total long, v long")
    got = [r.p for r in df.select(divergence._p(F.col("n"), F.col("total"), F.col("v")).alias("p")).collect()]
    assert got == [1 + 10 ** 9 * (n + 2) // (t + 2 * v) for n, t, v in cases]
    p, q = np.asarray(got), np.asarray(got[::-1])
    assert divergence.differ(p, q).tolist() == [(a - b) ** 2 // (a + b) for a, b in zip(got, got[::-1])]


def test_divergence_splits_bounded_parts(spark, monkeypatch):
    """A batch is split into words by parts of bounded size, with the same counts."""
    class Seen:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return run

    texts = [" ".join(f"w{chr(97 + (i * k) % 7)}" for k in range(30)) for i in range(50)] + [None, "", "x " * 400]
    batch = pa.record_batch({"lang": ["en", None, "de"] * 17 + ["en"] * 2, "source": ["a"] * len(texts), "text": texts})
    run, sizes = divergence.partial_counts(Seen(), "text", "lang", "source"), []
    whole = pa.Table.from_batches(run(iter([batch]))).sort_by([(k, "ascending") for k in ("lang", "source", "term")])
    count = divergence._batch_counts
    monkeypatch.setattr(divergence, "PART_BYTES", 500)
    monkeypatch.setattr(divergence, "_batch_counts", lambda b: sizes.append((b.num_rows, pc.sum(pc.binary_length(b.column(2))).as_py() or 0)) or count(b))
    parts = pa.Table.from_batches(run(iter([batch]))).sort_by([(k, "ascending") for k in ("lang", "source", "term")])
    assert parts.equals(whole) and len(sizes) > 5 and all(b <= 500 or n == 1 for n, b in sizes)
