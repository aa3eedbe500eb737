"""Language, quality and URL filters."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from pairscreen.llm import language, quality
from pairscreen.llm.urls import judge, url_host_path

from llm_cases import DE, EN, make_docs, prose


def mixed(spark, n=60):
    rng = random.Random(5)
    rows = [(i, prose(rng, 60, DE if i % 3 == 0 else EN, 0.95), "de" if i % 3 == 0 else "en", f"h{i % 5}") for i in range(n)]
    # declared wrongly
    rows += [(n + i, prose(rng, 60, DE, 0.95), "en", "h0") for i in range(3)]
    return rows, make_docs(spark, rows)


def test_language_prefers_text_to_a_wrong_declaration(spark):
    rows, docs = mixed(spark)
    got = {r.doc_id: r for r in language.identify(docs, "doc_id").collect()}
    assert len(got) == len(rows)
    assert all(got[i].language == ("de" if i % 3 == 0 else "en") and got[i].kept for i in range(60))
    assert [got[60 + i].language for i in range(3)] == ["de"] * 3
    assert all(0 < r.confidence <= 1 for r in got.values())


def test_language_text_table_against_counting():
    texts = ["Über das Meer", "the sea and THE sky", None, "ab"]
    codes, good, offsets = language._trigrams(pa.array(texts))
    found = [Counter(codes[a:b][good[a:b]].tolist()) for a, b in zip(offsets[:-1], offsets[1:])]
    for text, seen in zip(texts, found):
        folded = "".join(c if c.isalpha() else " " for c in (text or "").lower()).encode()
        want = Counter(((folded[i] << 16 | folded[i + 1] << 8 | folded[i + 2]) * 0x9E3779B1 & 0xFFFFFFFF) >> 16
                       for i in range(len(folded) - 2) if folded[i + 1] != 32)
        assert seen == want


def test_language_host_prior_decides_without_text_evidence(spark):
    rows, _ = mixed(spark)
    docs = make_docs(spark, rows + [(900 + i, "zu", None, "german") for i in range(1)] + [
        (800 + i, prose(random.Random(i), 60, DE, 0.95), "de", "german") for i in range(10)])
    got = {r.doc_id: r for r in language.identify(docs, "doc_id").collect()}
    assert got[900].language == "de"


def test_language_odd_rows(odd, empty):
    got = language.identify(odd, "doc_id").collect()
    assert len(got) == odd.count()
    assert not any(r.kept for r in got if r.doc_id in (1, 2, 9, 12))
    assert language.identify(empty, "doc_id").count() == 0
    kept = language.keep_identified(odd)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} >= {3, 4, 5, 10}
    assert language.keep_identified(empty).count() == 0


def test_language_pages_evidence(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, 40, DE if i % 2 else EN, 0.95), "de" if i % 2 else "en", f"w{i % 3}.shop.{'de' if i % 2 else 'uk'}")
            for i in range(30)] + [(99, "in", None, "new.de")]
    docs = spark.createDataFrame(rows, "page_id long, text string, declared string, host string")
    got = {r.page_id: r.language for r in language.identify(docs, "page_id", declared_col="declared", host_col="host").collect()}
    assert got[99] == "de" and got[0] == "en" and got[1] == "de"


def kneser_ney(grams):
    """Interpolated modified Kneser-Ney of {(a, b, c): n} by the book."""
    s = quality.SYMBOLS

    def discounts(counts):
        n = [sum(v == k for v in counts.values()) for k in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] + 2 * n[1] else 0.5
        out = []
        for k in (1, 2, 3):
            usual = k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] and n[0] else 0
            out.append(min(usual, k) if usual > 0 else min(y, 0.5))
        return lambda c: out[min(c, 3) - 1]

    two, one = Counter(), Counter()
    for a, b, c in grams:
        two[b, c] += 1
    for b, c in two:
        one[c] += 1

    def level(counts, below):
        d, by = discounts(counts), defaultdict(dict)
        for key, n in counts.items():
            by[key[:-1]][key[-1]] = n

        def p(*key):
            seen = by.get(key[:-1])
            if not seen:
                return below(*key[1:])
            total = sum(seen.values())
            n = seen.get(key[-1], 0)
            return ((n - d(n)) / total if n else 0) + sum(map(d, seen.values())) / total * below(*key[1:])

        return p

    p1 = level({(c,): n for c, n in one.items()}, lambda: 1 / s)
    return level(dict(grams), level(dict(two), p1))


def test_quality_model_against_the_book(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, 25, DE if i % 2 else EN), "de" if i % 2 else "en", "x") for i in range(20)]
    docs = make_docs(spark, rows)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(16)] + [(17, 0, 0), (18, 1, 1)], "doc_id long, quality int, toxic int")
    table = quality.fit(docs, labels)
    grams = Counter()
    for i, text, lang, _ in rows[:16]:
        if lang == "en":
            s, _ = quality.symbols(pa.array([text]))
            grams.update(tuple(int(x) for x in s[j:j + 3]) for j in range(len(s) - 2))
    p = kneser_ney(grams)
    en = quality.LANGUAGES.index("en")
    for key in list(grams)[:200] + [tuple(rng.randrange(quality.SYMBOLS) for _ in range(3)) for _ in range(200)]:
        assert math.isclose(p(*key), math.exp(table[en][key]), rel_tol=1e-4)
    sums = np.exp(table[en].astype(float)).sum(axis=-1)
    assert np.allclose(sums, 1, atol=1e-4)
    # whole texts are scored
    got = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    s, _ = quality.symbols(pa.array([rows[0][1]]))
    want = -np.mean([math.log(p(*[int(x) for x in s[j:j + 3]])) for j in range(len(s) - 2)])
    assert math.isclose(got[0].log_perplexity, want, rel_tol=1e-4) and got[0].n_symbols == len(s) - 2


def test_quality_drops_noise_and_keeps_prose(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, 80), "en", "x") for i in range(60)]
    rows += [(100 + i, " ".join(w.upper() + "!!" for w in prose(rng, 80).split()), "en", "x") for i in range(10)]
    docs = make_docs(spark, rows)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality.judge(docs, labels).filter("kept").collect()}
    assert len(kept & set(range(60))) >= 45 and not kept & set(range(100, 110))
    assert {r.doc_id for r in quality.keep_good(docs, labels).collect()} == kept


def test_quality_threshold_is_the_quantile(spark):
    scored = spark.createDataFrame([(i, i % 2, 1.0 + i / 100) for i in range(200)], "doc_id long, cell int, log_ppl double")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    got = quality.thresholds(scored, labels, "doc_id", 3, 0.9)
    for cell in (0, 1):
        values = sorted(1.0 + i / 100 for i in range(cell, 200, 2))
        assert values[89] < got[cell] <= values[89] + 0.0021
    assert got[2] > got[0] - 1  # all together where a cell has none
    assert quality.thresholds(scored, labels.limit(0), "doc_id", 1, 0.9) == [float("inf")]


def test_quality_threshold_falls_back_to_the_language(spark):
    lengths = len(quality.LENGTHS) + 1
    # many documents of one length in two languages, few of another length, and a language of few
    rows = [(i, 0, 1.0) for i in range(50)] + [(50 + i, lengths, 5.0) for i in range(50)]
    rows += [(100, 1, 1.2), (101, lengths + 1, 5.2), (102, 2 * lengths, 3.0)]
    scored = spark.createDataFrame(rows, "doc_id long, cell int, log_ppl double")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(103)], "doc_id long, quality int, toxic int")
    got = quality.thresholds(scored, labels, "doc_id", 3 * lengths, 0.9)
    assert got[1] == got[2] == got[0] < 1.1 and got[lengths + 1] == got[lengths] > 4.9
    assert got[2 * lengths] > 4.9  # all together


def test_quality_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1, 0), (5, 1, None), (7, 0, 0), (None, 1, 0), (11, 1, 0), (11, 0, 0)],
                                   "doc_id long, quality int, toxic int")
    got = quality.judge(odd, labels).collect()
    assert len(got) == odd.count() and not any(r.kept for r in got if r.doc_id in (1, 2))
    assert quality.judge(empty, labels).count() == 0
    assert quality.judge(odd, labels.limit(0)).filter("kept").count() == odd.filter("length(text) > 0").count()
    good = quality.keep_good(odd, labels)
    assert good.columns == odd.columns and quality.keep_good(empty, labels).count() == 0


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("a.b", "", "block"),
         ("a.b", "/x", "allow"), ("", "/", "block"), (None, "/", "block"), ("same.org", "/p", "allow"), ("same.org", "/p", "block")]


def by_hand(url):
    at = (url or "").find("://")
    rest = url[at + 3:] if at >= 0 else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
    host = rest[:cut].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    path = rest[cut:]
    path = path[:min([path.find(c) for c in "?#" if c in path] + [len(path)])]
    fits = [(len(h + p), len(p), v, h + p) for h, p, v in RULES if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[2] if best else "allow"


def test_urls_against_all_rules(spark):
    hosts = ["x.net", "example.net", "EN.Example.NET", "badexample.net", "example.com", "w.example.com:80", "a.b", "z.a.b", "a.b.", "..net",
             "same.org", "net", "", "nét.org"]
    paths = ["", "/", "/en/1", "/en", "/de/?q=/", "/de/a#b", "?a://b/c", "#x", "/x/y", "/p", "//", "/\n/en/"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme", "://", "a://b://c.net/", "http://x.net/" + "y" * 5000]
    urls += ["http://x.net/same"] * 50
    urls += ["http://" + "l." * 20_000 + "example.net/en/", "http://" + "." * 50_000 + "org/fr/x"]
    pages = spark.createDataFrame([(i, u, "f", "r") for i, u in enumerate(urls)], "page_id long, url string, found string, rule string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = judge(pages, rules)
    assert got.columns == ["page_id", "url", "found", "host", "path", "rule", "verdict"]
    rows = got.collect()
    assert len(rows) == len(urls)
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == by_hand(urls[r.page_id]), urls[r.page_id]
    assert judge(pages.limit(0), rules).count() == 0
    none = judge(pages, rules.limit(0), default="block").select("rule", "verdict").distinct().collect()
    assert [tuple(r) for r in none] == [(None, "block")]


def test_url_parts(spark):
    df = spark.createDataFrame([("HTTPS://User@Host.EXAMPLE:8/Pa/TH?q#f",)], "u string")
    assert df.select(*url_host_path(df.u)).first()[:] == ("user@host.example:8", "/Pa/TH")
