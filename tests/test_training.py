import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairscreen.operators import training
from pairscreen.plans.predict import predict
from pairscreen.plans.train import train_run
from pairscreen.sources import scans


def early_stop(values, others, patience):
    """A plain loop over epochs."""
    best = {"main": (-1e18, None), "other": (-1e18, None)}
    bad, last = 0, 0
    for epoch, (v, o) in enumerate(zip(values, others), start=1):
        improved = False
        for name, x in (("main", v), ("other", o)):
            x = -1e18 if x is None or math.isnan(x) else x
            if x > best[name][0]:
                best[name] = (x, epoch)
                improved = improved or name == "main"
        last, bad = epoch, 0 if improved else bad + 1
        if bad >= patience:
            break
    return {k: (e, s if e else None, last) for k, (s, e) in best.items()}


@pytest.mark.parametrize("patience", [1, 2, 5])
def test_early_stop_select(spark, patience):
    rng = random.Random(patience)
    rows, want = [], {}
    for run in range(12):
        n = rng.randrange(1, 12)
        cell = lambda: rng.choice([None, math.nan, *map(float, range(6))]) if run else math.nan
        values, others = [cell() for _ in range(n)], [cell() for _ in range(n)]
        rows += [(f"r{run}", e, v, o) for e, (v, o) in enumerate(zip(values, others), start=1)]
        for name, result in early_stop(values, others, patience).items():
            want[(f"r{run}", name)] = result
    df = spark.createDataFrame(rows, "stage string, epoch int, main double, other double")
    got = training.early_stop_select(df, ["main", "other"], "main", patience).collect()
    assert {(r["stage"], r["monitor"]): (r["best_epoch"], r["best_score"], r["last_epoch"]) for r in got} == want


def test_select_checkpoint(spark):
    def pick(pre, fine, policy):
        df = spark.createDataFrame([("pretrain", "cls_aupr", 3, pre), ("cls_train", "cls_aupr", 5, fine),
                                    ("pretrain", "cls_f1", 9, 99.0)],
                                   "stage string, monitor string, best_epoch int, best_score double")
        return training.select_checkpoint(df, policy).first()["stage"]

    assert pick(0.9, 0.5, "finetune") == "cls_train"
    assert pick(0.9, 0.5, "best_stage") == "pretrain"
    assert pick(0.5, 0.5, "best_stage") == "cls_train"
    assert pick(None, 0.5, "best_stage") == "cls_train"
    with pytest.raises(ValueError):
        pick(1.0, 1.0, "other")


def newton(x, y, w, reg, intercept):
    """Minimise the weighted logistic loss plus a ridge term directly."""
    if intercept:
        x = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.full(x.shape[1], reg)
    if intercept:
        ridge[-1] = 0.0
    beta = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ beta))
        grad = x.T @ (w * (p - y)) / w.sum() + ridge * beta
        hess = (x * (w * p * (1 - p))[:, None]).T @ x / w.sum() + np.diag(ridge)
        beta -= np.linalg.solve(hess, grad)
    return beta


@pytest.fixture(scope="module")
def labelled():
    rng = np.random.default_rng(0)
    d, p = rng.normal(size=(40, 3)), rng.normal(size=(4, 3))
    rows = []
    for i in range(120):
        a, b = i % 40, i % 4
        signal = float((d[a] * p[b]).sum() + rng.normal() * 2)
        label = -1 if i % 10 == 0 else int(signal > 0)
        rows.append((i, f"p{b}", label, d[a].tolist(), p[b].tolist()))
    return rows


SCHEMA = "row_id long, protein string, label int, drug_vec array<double>, prot_vec array<double>"


def vector(r):
    d, p = np.array(r[3]), np.array(r[4])
    return np.concatenate([d, p, d * p])


def test_train_cls_minimises_the_soft_label_loss(spark, labelled):
    model = training.train_cls(spark.createDataFrame(labelled, SCHEMA), pos_weight=1.5, reg=0.05, max_iter=200)
    x, y, w = [], [], []
    for r in labelled:
        parts = {1: [(1, 1.5)], 0: [(0, 1.0)], -1: [(1, 0.03 * 0.2 * 1.5), (0, 0.03 * 0.8)]}[r[2]]
        for label, weight in parts:
            x.append(vector(r))
            y.append(label)
            w.append(weight)
    beta = newton(np.array(x), np.array(y), np.array(w), 0.05, True)
    assert np.allclose(model.coefficients.toArray(), beta[:-1], atol=1e-3) and model.intercept == pytest.approx(beta[-1], abs=1e-3)
    head = training.cls_head(model)
    d, p = np.array([labelled[0][3]]), np.array([labelled[0][4]])
    assert head.pairs(d, p)[0] == pytest.approx(vector(labelled[0]) @ beta[:-1] + beta[-1], abs=1e-2)
    assert head.grid(d, p)[0, 0] == pytest.approx(head.pairs(d, p)[0])


def test_train_rank_minimises_the_pairwise_loss(spark, labelled):
    model = training.train_rank(spark.createDataFrame(labelled, SCHEMA), "protein", "row_id", cap=10 ** 6, reg=0.05, max_iter=200)
    x, w = [], []
    for g in {r[1] for r in labelled}:
        pos = [vector(r) for r in labelled if r[1] == g and r[2] == 1]
        neg = [vector(r) for r in labelled if r[1] == g and r[2] == 0]
        for a in pos:
            for b in neg:
                x.append(a - b)
                w.append(1 / (len(pos) * len(neg)))
    beta = newton(np.array(x), np.ones(len(x)), np.array(w), 0.05, False)
    assert np.allclose(model.coefficients.toArray(), beta, atol=2e-3) and model.intercept == 0


@pytest.fixture(scope="module")
def planted(spark):
    """Pairs that follow a rule on their vectors."""
    rng = np.random.default_rng(3)
    d, p = rng.normal(size=(60, 4)), rng.normal(size=(9, 4))

    def table(proteins, domain):
        rows = []
        for t in proteins:
            for i in range(60):
                rows.append((len(rows), str(i), f"{t}.0", -1 if (i + t) % 11 == 0 else int(d[i] @ p[t] > 0), domain))
        return spark.createDataFrame(rows, "row_id long, drug_id string, prot_id string, label int, prot_domain string")

    drugs = scans.scan_bank(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(d)], "drug_id long, vec array<float>"), ["drug_id"])
    prots = scans.scan_bank(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(p)], "prot_id long, vec array<float>"), ["prot_id"])
    return table, drugs, prots


def test_whole_run(spark, planted):
    """Both heads learn a planted rule and the reports say so."""
    table, drugs, prots = planted
    run = train_run(table([0, 1], "human"), table([2, 3, 4, 5], "virus"), table([6, 7], "virus"), table([8], "virus"), drugs, prots,
                    policy="best_stage", epochs=(1, 2, 1), steps=12)
    report = run.test_report.first()
    assert report["auc"] > 0.9 and report["perprotein_auc_mean"] > 0.9 and report["n_proteins"] == 1
    assert report["threshold"] == run.val_report.first()["threshold"]
    history = {(r["stage"], r["epoch"]): r for r in run.history.collect()}
    assert {s for s, _ in history} == {"pretrain", "cls_train", "rank_train"}
    # every monitor has its reports, and the main one's are those returned
    reports = {(r["monitor"], r["split"], r["metric"]): r["value"] for r in run.reports.collect()}
    assert {m for m, _, _ in reports} == set(training.MONITORS)
    best = {(r["stage"], r["monitor"]): r for r in run.best.collect()}
    for m in training.MONITORS:
        assert reports[m, "val", m] == pytest.approx(best["rank_train", m]["best_score"], abs=1e-9)
    assert reports["combo_cls_rank", "test", "auc"] == pytest.approx(report["auc"])
    out = predict(table([8], "virus"), drugs, prots, [run.model], domain="virus")
    assert out.per_model.count() == out.ensemble.count() == sum(1 for i in range(60) if (i + 8) % 11)
    with pytest.raises(ValueError, match="lacks a drug"):
        predict(table([8], "virus").withColumn("prot_id", F.lit("77")), drugs, prots, [run.model])


def stage_of(spark, planted, name="cls_train"):
    from pairscreen.plans.predict import prepare_pairs
    from pairscreen.plans.train import with_vectors

    table, drugs, prots = planted
    part = lambda t: training.feature_rows(with_vectors(prepare_pairs(table(t, "virus"), drugs, prots, "gray"), drugs, prots))
    rows, val = part([2, 3, 4]), part([6, 7])
    report = lambda w: training.monitor_values(training.feature_logits(val.filter("label >= 0"), [("x", w, w[:-1])]))
    return rows, report, training.cls_objective(rows)


def test_an_interrupted_stage_ends_with_the_same_rows(spark, planted, tmp_path):
    rows, report, objective = stage_of(spark, planted)
    whole = training.train_stage(spark, "cls_train", objective, np.zeros(13), report, str(tmp_path / "a"), 3, steps=2)
    calls = []

    def killed(theta):
        calls.append(1)
        if len(calls) > 7:
            raise KeyboardInterrupt
        return objective(theta)

    with pytest.raises(KeyboardInterrupt):
        training.train_stage(spark, "cls_train", killed, np.zeros(13), report, str(tmp_path / "b"), 3, steps=2)
    before = training.open_history(spark, str(tmp_path / "b")).count()
    assert 0 < before < 3
    _, _, fresh = stage_of(spark, planted)  # as a new session would
    resumed = training.train_stage(spark, "cls_train", fresh, np.zeros(13), report, str(tmp_path / "b"), 3, steps=2)
    a, b = ([r for r in s.history.orderBy("epoch").collect()] for s in (whole, resumed))
    assert [(r["epoch"], r["weights"], r["train_loss"]) for r in a] == [(r["epoch"], r["weights"], r["train_loss"]) for r in b]
    assert whole.weights.tolist() == resumed.weights.tolist()


def test_twins_tell_unfitted_and_half_fitted_models(spark, planted):
    """The registered fits say a residual of 0; a model that was not fitted to the end says more."""
    from catalog.training import _fit_table
    from pairscreen.operators import optimise

    _, _, objective = stage_of(spark, planted)
    for steps, ends in ((0, False), (1, False), (60, True)):
        table = _fit_table(spark, optimise.fit(objective, np.zeros(13), steps)).collect()
        assert all(r["residual"] == 0 and r["lower"] for r in table) == ends
        assert any(r["start"] != 0 for r in table)


def test_a_stage_stops_by_its_monitor(spark, planted, tmp_path):
    """A monitor that falls from the second epoch on ends the stage ``patience`` later, at the first epoch's weights."""
    rows, report, objective = stage_of(spark, planted)
    seen = []

    def falling(theta):
        seen.append(theta)
        return report(theta).withColumn("cls_aupr", F.lit(1.0 / len(seen)))

    stage = training.train_stage(spark, "cls_train", objective, np.zeros(13), falling, str(tmp_path / "h"), 9, patience=2, steps=1)
    assert stage.history.count() == 3 and stage.weights.tolist() == seen[0].tolist()
    with pytest.raises(ValueError):
        training.cls_objective(rows, "hinge")
    with pytest.raises(ValueError):
        training.rank_objective(rows, "hinge")


def test_bilinear_head_scores_like_its_pair_vector(spark):
    from pairscreen.functions.vectors import pair_features

    rng = np.random.default_rng(5)
    d, p = rng.normal(size=(6, 4)), rng.normal(size=(6, 4))
    dw, pw = rng.normal(size=(3, 4)).tolist(), rng.normal(size=(3, 4)).tolist()
    df = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(d, p))], "i int, d array<double>, p array<double>")
    built = np.array([r.x for r in df.select("i", pair_features(F.col("d"), F.col("p"), "full_bilinear", dw, pw).alias("x")).orderBy("i").collect()])
    beta = rng.normal(size=built.shape[1])
    head = training.head_from_coefficients(beta.tolist(), 0.5, "full_bilinear", dw, pw)
    assert np.allclose(head.pairs(d, p), built @ beta + 0.5)
    assert np.allclose(np.diag(head.grid(d, p)), built @ beta + 0.5)
    with pytest.raises(ValueError, match="matrices"):
        training.head_from_coefficients(beta.tolist(), 0.5, "full_bilinear")


def test_vectors_of_a_fit_take_as_much_on_disk_as_in_tasks(spark):
    """So a split of bounded size is a task of bounded size, however often numbers come."""
    same = F.array(*[F.lit(0.5)] * 32)
    rows = training.cls_rows(spark.range(3000).select((F.col("id") % 2).cast("int").alias("label"), same.alias("drug_vec"), same.alias("prot_vec")))
    files = [f.removeprefix("file:") for f in rows.inputFiles()]
    assert sum(map(os.path.getsize, (f.replace("///", "/") for f in files))) >= 3000 * 96 * 8


def test_gaps_build_pair_vectors_only_where_both_sides_have_met(spark, labelled, monkeypatch):
    """So a shuffled row is two vectors, not a pair vector; the draw's shuffles are given up before."""
    given_up = []
    monkeypatch.setattr(training, "release_shuffles", given_up.append, raising=False)
    gaps = training.rank_differences(spark.createDataFrame(labelled, SCHEMA), "protein", "row_id", cap=10 ** 6)
    plan = gaps._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" in plan.partition("Join")[0] and "zip_with" not in plan.partition("Join")[2]
    assert len(given_up) == 1
    by_id = {r[0]: r for r in labelled}
    drawn = training.pos_neg_pairs(spark.createDataFrame(labelled, SCHEMA), "protein", "row_id", cap=10 ** 6).collect()
    want = sorted(tuple(sign * (vector(by_id[r["pos_row_id"]]) - vector(by_id[r["neg_row_id"]]))) for r in drawn for sign in (1.0, -1.0))
    assert np.allclose(sorted(tuple(r["features"].toArray()) for r in gaps.select("features").collect()), want, rtol=0, atol=0)


def test_the_registered_run_trains_as_long_as_a_run_does(spark, monkeypatch, tmp_path):
    """No parameter leaves out epochs, steps or patience."""
    import inspect
    from types import SimpleNamespace

    from catalog import training as queries
    from pairscreen.plans import train

    spark.createDataFrame([(i % 5, i % 7, "RAN"[i % 3]) for i in range(40)], "l_partkey long, l_suppkey long, l_returnflag string").write.parquet(
        f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i, [0.5, 1.0]) for i in range(9)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    asked = []

    def run(*args, **kwargs):
        asked.append(inspect.signature(train_run).bind(*args, **kwargs))
        asked[0].apply_defaults()
        return SimpleNamespace(reports="reports")

    monkeypatch.setattr(queries, "train_run", run)
    assert queries.whole_run(spark, str(tmp_path)) == "reports"
    own = asked[0].arguments
    assert tuple(own["epochs"]) == train.EPOCHS == (20, 80, 50) and own["steps"] == 5 and own["patience"] == training.PATIENCE == 10


@pytest.mark.parametrize("metric", ["f1", "balanced_acc", "youden", "mcc"])
def test_monitors_counted_in_one_place_are_the_same(spark, metric):
    rng = random.Random(7)
    rows = []
    for i in range(400):
        cls, rank = rng.choice([rng.gauss(0, 1), 0.0, -0.0, round(rng.gauss(0, 1), 1)]), round(rng.gauss(0, 1), 1)
        rows.append((i, f"p{i % 9}", 1 if i % 9 == 8 else rng.choice([-1, 0, 1]), cls, rank, 0.002 * rng.randrange(501), 0.5))
    cells = "row_id long, protein string, label int, cls_logit double, rank_logit double, cls_prob double, rank_prob double"
    for part in (rows, [r for r in rows if r[2] == 1], [r for r in rows if r[2] == 0]):
        df = spark.createDataFrame(part, cells)
        want, got = (training.monitor_values(df, metric=metric, rows=n).first().asDict() for n in (None, len(part)))
        assert got == {k: v if v is None else pytest.approx(v, abs=1e-12) for k, v in want.items()}
    assert training._few_monitors(spark.createDataFrame(rows[:9], cells).select(
        F.lit(None).cast("string").alias("g"), F.col("label").cast("double"), "cls_prob", "rank_logit").toArrow(), metric) is None
