import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from pairscreen.operators import scoring
from pairscreen.plans.screen import screen
from pairscreen.sources import sinks

N, T, D = 120, 5, 6
RNG = np.random.default_rng(4)
# rounded vectors give many tied scores
DRUGS, TARGETS = RNG.integers(-1, 2, (N, D)).astype(float), RNG.integers(-1, 2, (T, D)).astype(float)


def models():
    gap = scoring.LinearHead(bias=0.5, drug=[0.1] * D, protein=[0.2] * D, gap=[0.3] * D)
    return [scoring.dot_model("dot", D, seed=3),
            scoring.LinearModel("mix", gap, scoring.LinearHead(cross=[1.0, 0.0, 2.0, 0.0, 1.0, 0.0]), 4)]


def logits():
    dot = DRUGS @ TARGETS.T
    gap = (0.5 + DRUGS.sum(1)[:, None] * 0.1 + TARGETS.sum(1)[None] * 0.2
           + 0.3 * np.abs(DRUGS[:, None] - TARGETS[None]).sum(2))
    cross = (DRUGS * [1, 0, 2, 0, 1, 0]) @ TARGETS.T
    return np.stack([dot, gap], 2), np.stack([dot, cross], 2)


def drugs(spark, parts=4):
    rows = [(i, v.tolist()) for i, v in enumerate(DRUGS)]
    return spark.createDataFrame(rows, "drug_id long, vec array<float>").repartition(parts)


def proteins(spark):
    rows = [(i, str(i), f"t::{i}", v.tolist()) for i, v in enumerate(TARGETS)]
    return spark.createDataFrame(rows, "idx long, prot_id string, protein_key string, vec array<float>")


def targets(spark):
    rows = [(str(i), f"t::{i}", f"P{i}") for i in range(T)]
    return spark.createDataFrame(rows, "prot_id string, protein_key string, pdb_id string")


def resolved(spark):
    return targets(spark).join(proteins(spark).select("protein_key", "vec"), "protein_key")


def library(spark):
    return spark.createDataFrame([(i, f"k{i}", i % 7) for i in range(N)], "drug_id long, drug_key string, size int")


def expected(beta=0.0):
    cls, rank = logits()
    final = rank.mean(2) - beta * rank.std(2)
    prob = 1 / (1 + np.exp(-cls.mean(2)))
    return final, prob


def ranked(t, k, allowed=None, gate=0.0, beta=0.0, lowest=False):
    final, prob = expected(beta)
    rows = [(final[i, t], i) for i in range(N) if lowest or ((allowed is None or i in allowed) and prob[i, t] >= gate)]
    return [i for _, i in sorted(rows, reverse=not lowest)[:k]]


def lists(hits):
    out = {}
    for r in hits.collect():
        out.setdefault(int(r["protein_key"].split("::")[1]), []).append((r["rank"], r["drug_id"]))
    return {t: [i for _, i in sorted(v)] for t, v in out.items()}


@pytest.mark.parametrize("block", [1, 64 << 20])
def test_grid_matches_numpy(spark, monkeypatch, block):
    """A tiny block size makes one pass per target."""
    monkeypatch.setattr(scoring, "TARGET_BLOCK_BYTES", block)
    got = scoring.screening_table(scoring.cross_score(drugs(spark), resolved(spark), models(), 0.5), 0.5).collect()
    cls, rank = logits()
    assert len(got) == N * T
    for r in got:
        i, t = r["drug_id"], int(r["protein_key"].split("::")[1])
        assert r["pdb_id"] == f"P{t}"
        assert r["cls_logit_mean"] == pytest.approx(cls[i, t].mean()) and r["cls_logit_std"] == pytest.approx(cls[i, t].std())
        assert r["rank_logit_std"] == pytest.approx(rank[i, t].std())
        assert r["final_score"] == pytest.approx(rank[i, t].mean() - 0.5 * rank[i, t].std())


@pytest.mark.parametrize("parts", [1, 4])
@pytest.mark.parametrize("k, bottom", [(1, 1), (10, 25), (500, 500)])
def test_pruned_screen_equals_full_sort(spark, parts, k, bottom):
    chosen = {i for i in range(N) if i % 7 < 4}
    meta = library(spark).select("drug_key", "size")
    for keep in (False, True):
        got = screen(library(spark), drugs(spark, parts), targets(spark), proteins(spark), models(), top_k=k,
                     bottom_k=bottom, beta=0.7, cls_min_prob=0.55, eligibility=meta, predicate="size < 4",
                     keep_scores=keep)
        top, low = lists(got.top), lists(got.bottom)
        for t in range(T):
            assert top.get(t, []) == ranked(t, k, chosen, 0.55, 0.7)
            assert low[t] == ranked(t, bottom, beta=0.7, lowest=True)
        assert got.report["rows"] == N * T and got.report["eligible_top_drug_count"] == len(chosen)
        if keep:
            assert got.scores.count() == N * T
    assert {"drug_key", "size"} <= set(got.top.columns)


def test_screen_outputs(spark, tmp_path):
    got = screen(library(spark), drugs(spark), targets(spark), proteins(spark), models(), top_k=2, bottom_k=1,
                 pdb_ids=["P1", "P3"], keep_scores=True)
    got.write(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/top_2")).count() == 4
    assert spark.read.parquet(str(tmp_path / "out/bottom_1")).count() == 2
    assert spark.read.parquet(str(tmp_path / "out/ensemble_scores")).count() == 2 * N
    assert spark.read.json(str(tmp_path / "out/manifest/json")).first()["rows"] == 2 * N


def test_small_arrow_batches_give_the_same_lists(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = screen(library(spark), drugs(spark, 2), targets(spark), proteins(spark), models(), top_k=9, bottom_k=4)
        assert lists(got.top) == {t: ranked(t, 9) for t in range(T)}
        assert lists(got.bottom) == {t: ranked(t, 4, lowest=True) for t in range(T)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_pruning_sends_few_rows(spark):
    one = drugs(spark, 1)
    assert scoring.cross_score(one, resolved(spark), models(), top=3).count() < N * T
    assert scoring.cross_score(one, resolved(spark), models(), top=0, bottom=0).count() == 0


def test_bad_inputs(spark):
    with pytest.raises(ValueError, match="repeated"):
        scoring.check_targets(resolved(spark).unionAll(resolved(spark)))
    with pytest.raises(ValueError, match="without a vector"):
        scoring.check_targets(resolved(spark).withColumn("vec", F.lit(None).cast("array<float>")))
    with pytest.raises(ValueError, match="differ"):
        screen(library(spark).filter("drug_id > 0"), drugs(spark), targets(spark), proteins(spark), models())
    with pytest.raises(ValueError, match="may be listed"):
        screen(library(spark), drugs(spark), targets(spark), proteins(spark), models(),
               eligibility=library(spark), predicate="size > 99")


def test_score_pairs_and_predictions(spark):
    rows = [(n, n % N, (n * 3) % T, n % 2) for n in range(300)]
    pairs = spark.createDataFrame(rows, "row_id long, drug_idx long, prot_idx long, label int").repartition(5)
    bank = drugs(spark).withColumnRenamed("drug_id", "idx")
    scored = scoring.score_pairs(pairs, bank, proteins(spark), models())
    cls, rank = logits()
    for r in scored.collect():
        assert np.allclose(r["cls_logits"], cls[r["drug_idx"], r["prot_idx"]])
        assert np.allclose(r["rank_logits"], rank[r["drug_idx"], r["prot_idx"]])
    table = scoring.prediction_table(scored, models())
    assert table.count() == 600 and {r[0] for r in table.select("seed").distinct().collect()} == {3, 4}
    side = {r["row_id"]: r for r in scoring.ensemble_stats(scored).collect()}
    stacked = {r["row_id"]: r for r in scoring.ensemble_align(table, ["row_id"], 2).collect()}
    for i, a in side.items():
        for c in ("cls_logit_mean", "rank_logit_std", "rank_prob_mean"):
            assert a[c] == pytest.approx(stacked[i][c])
    with pytest.raises(Exception, match="do not line up"):
        scoring.ensemble_align(table.filter("row_id > 0 or seed = 3"), ["row_id"], 2).collect()


def test_sinks(spark, tmp_path):
    hits = scoring.top_k_per_target(scoring.screening_table(scoring.cross_score(drugs(spark), resolved(spark), models())), 3)
    path = sinks.write_per_target(hits, str(tmp_path / "hits"), fmt="csv")
    assert sorted(p.name for p in (tmp_path / "hits").iterdir() if p.is_dir()) == [
        f"protein_key_safe=t_{i}" for i in range(T)]
    assert spark.read.option("header", True).csv(path).count() == 3 * T
    sinks.write_report(spark, {"rows": N, "nested": {"a": 1}, "none": None}, str(tmp_path / "r"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "r/txt")).collect()] == [f"rows: {N}", "nested:", "  a: 1", "none: None"]
    assert spark.read.json(str(tmp_path / "r/json")).first()["nested"]["a"] == 1


cloudpickle.register_pickle_by_value(sys.modules[__name__])


class OddScores:
    """A dot product with odd scores for some rows."""

    name, seed = "odd", 0

    def grid(self, d, p):
        out = d @ p.T
        out[d[:, 0] == 3] = np.nan
        out[d[:, 0] == 5] = np.inf
        out[d[:, 0] == 7] = -np.inf
        return out, out.copy()


@pytest.mark.parametrize("beta", [0.0, 0.5])
def test_pruned_and_whole_lists_agree_on_odd_scores(spark, beta):
    rows = [(i, [float(i), float(i % 4)]) for i in range(60)]
    lib = spark.createDataFrame(rows, "drug_id long, vec array<double>").repartition(3)
    targets = spark.createDataFrame([("a", "x", [1.0, 0.0]), ("b", "y", [0.0, 1.0])], "protein_key string, pdb_id string, vec array<double>")

    def lists(**limits):
        table = scoring.screening_table(scoring.cross_score(lib, targets, [OddScores()], beta, **limits), beta)
        return [sorted((r.protein_key, r["rank"], r.drug_id) for r in f(table, 10).collect())
                for f in (scoring.top_hits, scoring.bottom_k_per_target)]

    whole, pruned = lists(), lists(top=10, bottom=10)
    assert whole == pruned and len(whole[0]) == 20
    assert not {3, 5, 7} & {d for part in whole for _, _, d in part}


def test_many_targets_in_blocks(spark, monkeypatch):
    lib = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)], "drug_id long, vec array<double>")
    targets = spark.createDataFrame([(f"t{i:03d}", "x", [1.0, float(i)]) for i in range(50)],
                                    "protein_key string, pdb_id string, vec array<double>")
    whole = scoring.cross_score(lib, targets, [scoring.dot_model("m", 2)], top=3).collect()
    monkeypatch.setattr(scoring, "TARGET_BLOCK_BYTES", 8 * 14 * 7)  # seven targets at once
    cut = scoring.cross_score(lib, targets, [scoring.dot_model("m", 2)], top=3)
    best = lambda rows: {(r.protein_key, r.drug_id) for r in rows if r.drug_id >= 27}
    assert best(cut.collect()) == best(whole) and len(best(whole)) == 150


class Told:
    """A plug-in with one output more."""

    name, seed, outputs = "told", 1, ("gate",)

    def __init__(self, sign=1.0):
        self.sign = sign

    def grid(self, d, p):
        return self.sign * (d @ p.T), self.sign * (d @ p.T)

    def pairs(self, d, p):
        x = (d * p).sum(axis=1)
        return self.sign * x, self.sign * x, np.where(x > 0, x, np.inf)


def test_models_with_domains_and_outputs(spark):
    rng = np.random.default_rng(2)
    d, p = rng.normal(size=(9, 3)), rng.normal(size=(4, 3))
    bank = lambda m: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "idx long, vec array<double>")
    pairs = spark.createDataFrame([(i, i % 9, i % 4, i % 2) for i in range(36)], "row_id long, drug_idx long, prot_idx long, domain_id int")
    models = [scoring.DomainModel("both", Told(1.0), Told(-1.0)), scoring.dot_model("dot", 3), Told()]
    scored = scoring.score_pairs(pairs, bank(d), bank(p), models)
    rows = {(r["row_id"], r["checkpoint"]): r for r in scoring.prediction_table(scored, models).collect()}
    means = {r["row_id"]: r for r in scoring.ensemble_stats(scored).collect()}
    for i in range(36):
        x = float(d[i % 9] @ p[i % 4])
        assert rows[i, "both"]["cls_logit"] == pytest.approx(-x if i % 2 else x) and rows[i, "told"]["rank_logit"] == pytest.approx(x)
        assert rows[i, "told"]["gate"] == pytest.approx(x if x > 0 else np.inf) and np.isnan(rows[i, "dot"]["gate"])
        assert means[i]["gate_mean"] == (pytest.approx(x) if x > 0 else None)
    with pytest.raises(ValueError, match="domain"):
        scoring.score_pairs(pairs.drop("domain_id"), bank(d), bank(p), models)
    # a screen's targets are viral
    targets = spark.createDataFrame([(f"k{i}", f"x{i}", v.tolist()) for i, v in enumerate(p)], "protein_key string, pdb_id string, vec array<double>")
    library = bank(d).withColumnRenamed("idx", "drug_id")
    got = {(r["drug_id"], r["protein_key"]): r["cls_logit_mean"] for r in scoring.screening_table(
        scoring.cross_score(library, targets, models[:1], 0.0), 0.0).collect()}
    assert len(got) == 36
    for i in range(9):
        for k in range(4):
            assert got[i, f"k{k}"] == pytest.approx(-float(d[i] @ p[k]))


def test_a_model_must_return_what_it_declares(spark):
    model = Told()
    model.outputs = ("gate", "other")
    with pytest.raises(ValueError, match="declares 2"):
        scoring._pair_values(model, ["gate", "other"], np.ones((2, 3)), np.ones((2, 3)), None)
