import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairscreen.operators import losses, ranking


def make(seed, n=400, groups=6):
    """Tied scores, a hot group, one single-class group, gray rows."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        g = "hot" if rng.random() < 0.4 else f"p{rng.integers(groups)}"
        label = int(rng.choice([-1, 0, 1], p=[0.1, 0.5, 0.4]))
        if g == "p0":
            label = min(label, 0) or 0
        rows.append((i, g, label, float(np.round(rng.normal() + 0.4 * label, 1)), float(np.round(rng.normal(), 1))))
    return rows


SCHEMA = "row_id long, protein string, label int, cls_logit double, rank_logit double"


@pytest.fixture(scope="module", params=[1, 2])
def rows(request):
    return make(request.param)


@pytest.fixture(scope="module")
def df(spark, rows):
    base = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return base.withColumn("cls_prob", 1 / (1 + F.exp(-F.col("cls_logit")))).withColumn(
        "rank_prob", 1 / (1 + F.exp(-F.col("rank_logit")))).cache()


# -- straight loops over the formulas ---------------------------------------------------

def auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    if not len(pos) or not len(neg):
        return None
    return float(np.mean([(p > neg).mean() + 0.5 * (p == neg).mean() for p in pos]))


def ap(y, s):
    if len(set(y)) < 2:
        return None
    total, last = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        hit = s >= t
        recall = y[hit].sum() / y.sum()
        total += (recall - last) * y[hit].mean()
        last = recall
    return float(total)


def confusion(y, p, t):
    hit = p >= t
    return [int((hit & (y == 1)).sum()), int((hit & (y == 0)).sum()), int((~hit & (y == 1)).sum()),
            int((~hit & (y == 0)).sum())]


def metric(name, tp, fp, fn, tn):
    if name == "f1":
        return 2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0
    if name == "balanced_acc":
        parts = [a / (a + b) for a, b in ((tp, fn), (tn, fp)) if a + b]
        return sum(parts) / len(parts)
    if name == "youden":
        return tp / max(tp + fn, 1) - fp / max(fp + tn, 1)
    den = math.sqrt(tp + fp) * math.sqrt(tp + fn) * math.sqrt(tn + fp) * math.sqrt(tn + fn)
    return (tp * tn - fp * fn) / den if den else 0.0


def hard(rows, column):
    kept = [r for r in rows if r[2] >= 0]
    return np.array([r[2] for r in kept]), np.array([r[column] for r in kept]), [r[1] for r in kept]


def test_areas(df, rows):
    y, s, _ = hard(rows, 4)
    got = ranking.curve_areas(df, "rank_logit").first()
    assert got["auroc"] == pytest.approx(auc(y, s)) and got["average_precision"] == pytest.approx(ap(y, s))


def test_known_average_precision(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.5), (1, 0.5), (0, 0.1)], "label int, s double")
    assert ranking.average_precision(df, "s").first()[0] == pytest.approx(0.5 + 0.5 * 2 / 3)
    tied = spark.createDataFrame([(1, 0.0), (0, -0.0)], "label int, s double")
    assert ranking.auroc(tied, "s").first()[0] == 0.5


def test_one_class_has_no_area(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.5)], "label int, s double")
    row = ranking.curve_areas(df, "s").first()
    assert row["auroc"] is None and row["average_precision"] is None and row["n_pos"] == 2


@pytest.mark.parametrize("name", ["f1", "balanced_acc", "youden", "mcc"])
@pytest.mark.parametrize("minimum", [0.0, 0.3])
def test_threshold_search(df, rows, name, minimum):
    y, s, _ = hard(rows, 3)
    p = 1 / (1 + np.exp(-s))
    steps = max(2, int(round((1 - minimum) * 500)) + 1)
    best, cut = -1e18, minimum
    for t in np.linspace(minimum, 1.0, steps):
        score = metric(name, *confusion(y, p, t))
        if score > best + 1e-12:
            best, cut = score, t
    got = ranking.select_threshold(df, "cls_prob", name, minimum).first()
    assert got["threshold"] == pytest.approx(cut) and got["score"] == pytest.approx(best)


def test_threshold_edges(spark):
    probs = [k * (1 / 500) for k in range(501)]
    df = spark.createDataFrame([(1, p) for p in probs], "label int, p double")
    got = {r["k"]: r["tp"] for r in ranking.threshold_sweep(df, "p").collect()}
    assert got == {k: 501 - k for k in range(501)}
    assert ranking.select_threshold(df, "p", "fixed", fixed=0.3).first()["threshold"] == 0.3
    assert ranking.threshold_grid(0.995) == (0.995, 4) and ranking.threshold_grid(1.5) == (1.0, 2)
    assert ranking.select_threshold(df, "p", "f1", 1.5).first()["threshold"] == 1.0
    with pytest.raises(ValueError):
        ranking.select_threshold(df, "p", "other")


def test_confusion_metrics(df, rows, spark):
    y, s, _ = hard(rows, 3)
    p = 1 / (1 + np.exp(-s))
    tp, fp, fn, tn = confusion(y, p, 0.6)
    for cut in (0.6, spark.createDataFrame([(0.6,)], "threshold double")):
        got = ranking.confusion_metrics(df, "cls_prob", cut).first()
        assert got["f1"] == pytest.approx(metric("f1", tp, fp, fn, tn))
        assert got["balanced_acc"] == pytest.approx(metric("balanced_acc", tp, fp, fn, tn))
        assert got["acc"] == pytest.approx((tp + tn) / len(y)) and got["pp_mean"] == pytest.approx(p.mean())
        assert (got["n"], got["pos"], got["neg"]) == (len(y), int(y.sum()), int((1 - y).sum()))
    nothing = ranking.confusion_metrics(df, "cls_prob", 2.0).first()
    assert nothing["f1"] == 0 and nothing["precision"] == 0 and nothing["recall"] == 0


def macro(rows, column, sizes=(10, 50)):
    """Per-protein means over a stable descending order."""
    by = {}
    for r in rows:
        if r[2] >= 0:
            by.setdefault(r[1], []).append((r[column], r[2]))
    aucs, aps, at = [], [], {k: [] for k in sizes}
    for members in by.values():
        s, y = np.array([m[0] for m in members]), np.array([m[1] for m in members])
        order = np.argsort(-s, kind="stable")
        if len(set(y)) == 2:
            aucs.append(auc(y, s))
            aps.append(ap(y, s))
        for k in sizes:
            if len(y) >= k:
                at[k].append(y[order][:k].sum() / k)
    mean = lambda v: float(np.mean(v)) if v else None
    out = {"perprotein_auc_mean": mean(aucs), "perprotein_aupr_mean": mean(aps), "n_proteins": len(by),
           "n_proteins_with_both_labels": len(aucs)}
    for k in sizes:
        out.update({f"p_at_{k}_mean": mean(at[k]), f"hit_at_{k}_mean": mean([v > 0 for v in at[k]]),
                    f"n_proteins_p_at_{k}": len(at[k])})
    return out


def check(got, want):
    for k, v in want.items():
        assert got[k] == (v if v is None else pytest.approx(v)), k


def test_per_group_metrics(df, rows):
    check(ranking.per_group_metrics(df, "protein", "rank_logit", "row_id").first(), macro(rows, 4))


def test_no_group_is_large_enough(spark):
    small = spark.createDataFrame([(0, "a", 1, 0.5), (1, "a", 0, 0.1)], "row_id long, protein string, label int, s double")
    got = ranking.per_group_metrics(small, "protein", "s", "row_id").first()
    assert got["p_at_10_mean"] is None and got["n_proteins_p_at_10"] == 0 and got["perprotein_auc_mean"] == 1.0


def test_dual_head_report(df, rows):
    got = ranking.dual_head_report(df, metric="mcc").first()
    y, c, _ = hard(rows, 3)
    check(got, {f"rank_{k}": v for k, v in macro(rows, 4).items()})
    check(got, {f"cls_{k}": v for k, v in macro(rows, 3).items()})
    check(got, macro(rows, 4))
    assert got["cls_auc"] == pytest.approx(auc(y, c)) == got["auc"]
    assert got["combo_cls_rank"] == pytest.approx(0.5 * got["cls_aupr"] + 0.5 * got["rank_perprotein_aupr_mean"])
    assert got["combo_cls_f1_rank"] == pytest.approx(0.5 * got["cls_f1"] + 0.5 * got["rank_perprotein_aupr_mean"])
    assert got["cls_threshold_metric"] == "mcc"
    given = ranking.dual_head_report(df, threshold=0.25).first()
    assert given["threshold"] == 0.25 and given["rank_threshold"] == got["rank_threshold"]


def test_finite_means(spark):
    df = spark.createDataFrame([("1.5", math.nan), ("x", 2.0), (None, math.inf)], "a string, b double")
    assert tuple(ranking.finite_means(df, ["a", "b"]).first()) == (1.5, 2.0)


# -- losses --------------------------------------------------------------------------------

def test_losses(df, rows):
    x = np.array([r[3] for r in rows])
    raw = np.array([r[2] for r in rows])
    y, w = np.where(raw < 0, 0.2, raw), np.where(raw < 0, 0.03, 1.0)
    each = 2.5 * y * np.logaddexp(0, -x) + (1 - y) * np.logaddexp(0, x)
    assert losses.weighted_bce(df, "cls_logit", 2.5).first()[0] == pytest.approx((each * w).sum() / max(w.sum(), 1))
    p = 1 / (1 + np.exp(-x))
    pt, alpha = p * y + (1 - p) * (1 - y), 0.25 * y + 0.75 * (1 - y)
    focal = alpha * np.maximum(1 - pt, 1e-6) ** 2 * each
    assert losses.focal_loss(df, "cls_logit", 2.5).first()[0] == pytest.approx((focal * w).sum() / max(w.sum(), 1))
    keep = raw >= 0
    plain = y[keep] * np.logaddexp(0, -x[keep]) + (1 - y[keep]) * np.logaddexp(0, x[keep])
    assert losses.rank_bce(df, "cls_logit").first()[0] == pytest.approx(plain.mean())


def test_pairwise_losses(df, rows):
    bpr, margin = [], []
    for g in {r[1] for r in rows}:
        pos = np.array([r[4] for r in rows if r[1] == g and r[2] == 1])
        neg = np.array([r[4] for r in rows if r[1] == g and r[2] == 0])
        if len(pos) and len(neg):
            gap = pos[:, None] - neg[None, :]
            bpr.append(np.logaddexp(0, -gap).mean())
            margin.append(np.maximum(0.2 - gap, 0).mean())
    assert losses.bpr_loss(df, "protein", "rank_logit").first()[0] == pytest.approx(np.mean(bpr))
    assert losses.margin_loss(df, "protein", "rank_logit").first()[0] == pytest.approx(np.mean(margin))
    assert losses.bpr_loss(df.filter("label = 1"), "protein", "rank_logit").first()[0] == 0.0
