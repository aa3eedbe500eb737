"""Ranking and classification metrics with exact tie handling.

Every metric starts from counts per (group, score), combined before the
shuffle, so repeated scores cost one row and a hot group is split by score
range instead of sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pairscreen.operators.ordering import running_totals, top_k_per_group

# Fixed values ---------------------------------------------------------------
CLS_TOP = ("auc", "aupr", "f1", "acc", "balanced_acc", "precision", "recall", "threshold", "pp_mean", "n", "pos", "neg")
RANK_TOP = ("perprotein_auc_mean", "perprotein_aupr_mean", "p_at_10_mean", "p_at_50_mean", "hit_at_10_mean",
            "hit_at_50_mean", "n_proteins", "n_proteins_with_both_labels", "n_proteins_p_at_10", "n_proteins_p_at_50")
GRID_STEPS = 500
THRESHOLD_METRICS = ("f1", "balanced_acc", "youden", "mcc", "fixed")
TOP_SIZES = (10, 50)
WEIGHT_COLUMNS = ("drug_weight_ecfp", "drug_weight_maccs", "drug_weight_rdkit2d",
                  "drug_aux_gate", "protein_desc_gate")
# ----------------------------------------------------------------------------


def _positive() -> Column:
    return F.count_if(F.col("label") == 1)


def _negative() -> Column:
    return F.count_if(F.col("label") == 0)


# -- AUROC and average precision ---------------------------------------------------

def score_counts(df: DataFrame, score: str, group: Sequence[str] = ()) -> DataFrame:
    """Definitive rows as ``pos, neg`` per (group, score)."""
    return (
        df.filter(F.col("label").isin(0, 1))
        # 0.0 and -0.0 are one score
        .withColumn("score", F.col(score).cast("double") + F.lit(0.0))
        .groupBy(*group, "score").agg(_positive().alias("pos"), _negative().alias("neg"))
    )


def curve_areas(df: DataFrame, score: str, group: Sequence[str] = ()) -> DataFrame:
    """``n_pos, n_neg, auroc, average_precision`` per group.

    Both areas are sums over distinct scores of terms that need only the
    counts below that score, so one distributed running total serves both.
    NULL where a class is missing.
    """
    hard = df.filter(F.col("label").isin(0, 1))
    counts = score_counts(df, score, group)
    sample = hard.select((F.col(score).cast("double") + F.lit(0.0)).alias("score"))
    run = running_totals(counts, list(group), ["score"], ["pos", "neg"], cuts_from=sample)
    pos_from_here = F.col("total_pos") - F.col("before_pos")
    all_from_here = pos_from_here + F.col("total_neg") - F.col("before_neg")
    terms = run.select(
        *group, "pos", "neg",
        (F.col("pos") * (F.col("before_neg") + F.col("neg") / 2)).alias("won"),
        (F.col("pos") * (pos_from_here / all_from_here)).alias("precision_mass"),
    )
    n_pos, n_neg = F.sum("pos"), F.sum("neg")
    both = (n_pos > 0) & (n_neg > 0)
    return terms.groupBy(*group).agg(
        F.coalesce(n_pos, F.lit(0)).alias("n_pos"), F.coalesce(n_neg, F.lit(0)).alias("n_neg"),
        F.when(both, F.sum("won") / (n_pos.cast("double") * n_neg)).alias("auroc"),
        F.when(both, F.sum("precision_mass") / n_pos).alias("average_precision"),
    )


def auroc(df: DataFrame, score: str, group: Sequence[str] = ()) -> DataFrame:
    return curve_areas(df, score, group).select(*group, "auroc")


def average_precision(df: DataFrame, score: str, group: Sequence[str] = ()) -> DataFrame:
    return curve_areas(df, score, group).select(*group, "average_precision")


# -- thresholds ------------------------------------------------------------------------

def threshold_grid(minimum: float = 0.0) -> tuple[float, int]:
    """Lower end and number of points of the threshold grid up to 1."""
    low = max(0.0, min(1.0, float(minimum)))
    return low, max(2, round((1.0 - low) * GRID_STEPS) + 1)


def _grid_point(k: Column, low: float, points: int) -> Column:
    step = (1.0 - low) / (points - 1)
    return F.when(k == points - 1, F.lit(1.0)).otherwise(k * F.lit(step) + F.lit(low))


def threshold_sweep(df: DataFrame, prob: str, minimum: float = 0.0) -> DataFrame:
    """Confusion counts ``k, threshold, tp, fp, fn, tn`` at every grid point
    (a row counts as predicted when ``prob >= threshold``).

    Rows shrink to a histogram over the grid in one pass; the sweep itself
    runs over at most a few hundred rows.
    """
    low, points = threshold_grid(minimum)
    hard = df.filter(F.col("label").isin(0, 1))
    p = F.col(prob).cast("double")
    step = (1.0 - low) / (points - 1)
    if step > 0:
        guess = F.greatest(F.lit(-1), F.least(F.lit(points - 1), F.floor((p - low) / F.lit(step)).cast("int")))
    else:
        guess = F.when(p >= low, points - 1).otherwise(-1)
    k = F.col("_guess")
    # Division only guesses the cell; comparing with the grid itself decides.
    cell = (
        F.when((k < points - 1) & (_grid_point(k + 1, low, points) <= p), k + 1)
        .when((k >= 0) & (_grid_point(k, low, points) > p), k - 1)
        .otherwise(k)
    )
    histogram = (
        hard.select("label", p.alias(prob), guess.alias("_guess")).select("label", cell.alias("k"))
        .groupBy("k").agg(_positive().alias("pos"), _negative().alias("neg"))
    )
    grid = df.sparkSession.range(-1, points).select(F.col("id").cast("int").alias("k"))
    full = grid.join(histogram, "k", "left").select(
        "k", F.coalesce("pos", F.lit(0)).alias("pos"), F.coalesce("neg", F.lit(0)).alias("neg"))
    upward = W.partitionBy(F.lit(0)).orderBy(F.desc("k"))
    everything = W.partitionBy(F.lit(0))
    swept = full.select(
        "k", _grid_point(F.col("k"), low, points).alias("threshold"),
        F.sum("pos").over(upward).alias("tp"), F.sum("neg").over(upward).alias("fp"),
        F.sum("pos").over(everything).alias("_p"), F.sum("neg").over(everything).alias("_n"))
    return swept.filter("k >= 0").select(
        "k", "threshold", "tp", "fp", (F.col("_p") - F.col("tp")).alias("fn"), (F.col("_n") - F.col("fp")).alias("tn"))


def _ratio(a: Column, b: Column) -> Column:
    """0 where the denominator is 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def f1_of(tp: Column, fp: Column, fn: Column) -> Column:
    return _ratio(2 * tp, 2 * tp + fp + fn)


def balanced_accuracy_of(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    """Mean recall over the classes that occur."""
    rec_pos = F.when(tp + fn > 0, tp / (tp + fn))
    rec_neg = F.when(tn + fp > 0, tn / (tn + fp))
    return F.when(rec_pos.isNull(), rec_neg).when(rec_neg.isNull(), rec_pos).otherwise((rec_pos + rec_neg) / 2)


def mcc_of(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    d = lambda c: c.cast("double")
    spread = F.sqrt(d(tp + fp)) * F.sqrt(d(tp + fn)) * F.sqrt(d(tn + fp)) * F.sqrt(d(tn + fn))
    return _ratio(d(tp) * d(tn) - d(fp) * d(fn), spread)


def youden_of(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    return tp / F.greatest(tp + fn, F.lit(1)) - fp / F.greatest(fp + tn, F.lit(1))


def _sweep_score(metric: str) -> Column:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    if metric == "f1":
        return f1_of(tp, fp, fn)
    return {"balanced_acc": balanced_accuracy_of, "mcc": mcc_of, "youden": youden_of}[metric](tp, fp, fn, tn)


def select_threshold(df: DataFrame, prob: str, metric: str = "f1", minimum: float = 0.0,
                     fixed: float = 0.5) -> DataFrame:
    """One row ``threshold, score``: the best grid point, lowest on ties."""
    if metric not in THRESHOLD_METRICS:
        raise ValueError(f"metric must be one of {THRESHOLD_METRICS}")
    if metric == "fixed":
        return df.sparkSession.range(1).select(
            F.lit(float(fixed)).alias("threshold"), F.lit(None).cast("double").alias("score"))
    scored = threshold_sweep(df, prob, minimum).withColumn("score", _sweep_score(metric))
    best = scored.agg(F.max(F.struct("score", (-F.col("k")).alias("neg_k"), "threshold")).alias("b"))
    return best.select("b.threshold", "b.score")


def best_f1_threshold(df: DataFrame, prob: str) -> DataFrame:
    return select_threshold(df, prob, "f1")


def confusion_metrics(df: DataFrame, prob: str, threshold: float | DataFrame) -> DataFrame:
    """Metrics of ``prob >= threshold`` on definitive rows, in one pass. The
    threshold is a number or a one-row frame with a ``threshold`` column."""
    cut = F.lit(float(threshold)) if not isinstance(threshold, DataFrame) else threshold.select("threshold").scalar()
    hard = df.filter(F.col("label").isin(0, 1)).select(
        "label", F.col(prob).cast("double").alias("p"), cut.alias("t"))
    hit, pos = F.col("p") >= F.col("t"), F.col("label") == 1
    cells = hard.agg(
        F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"),
        F.count_if(~hit & pos).alias("fn"), F.count_if(~hit & ~pos).alias("tn"),
        F.avg("p").alias("pp_mean"), F.max("t").alias("threshold"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return cells.select(
        f1_of(tp, fp, fn).alias("f1"), _ratio(tp + tn, tp + tn + fp + fn).alias("acc"),
        balanced_accuracy_of(tp, fp, fn, tn).alias("balanced_acc"),
        _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"),
        "threshold", "pp_mean", (tp + tn + fp + fn).alias("n"), (tp + fn).alias("pos"), (fp + tn).alias("neg"),
    )


# -- per-group ranking -------------------------------------------------------------------

def group_pools(df: DataFrame, group: str) -> DataFrame:
    """Definitive pool per group: ``n, n_pos``."""
    return df.filter(F.col("label").isin(0, 1)).groupBy(group).agg(
        F.count("*").alias("n"), _positive().alias("n_pos"))


def top_labels(df: DataFrame, group: str, score: str, row_id: str, k: int) -> DataFrame:
    """The ``k`` best definitive rows of each group, ties in row order."""
    hard = df.filter(F.col("label").isin(0, 1)).select(group, "label", F.col(score).alias("_s"), row_id)
    return top_k_per_group(hard, [group], [F.col("_s").desc(), F.col(row_id).asc()], k, name="rank")


def precision_at_k(df: DataFrame, group: str, score: str, row_id: str,
                   sizes: Sequence[int] = TOP_SIZES) -> DataFrame:
    """Per group ``n, n_pos`` and ``p_at_<k>, hit_at_<k>``, NULL for a pool
    smaller than k. One top-K pass serves all sizes."""
    top = top_labels(df, group, score, row_id, max(sizes))
    found = top.groupBy(group).agg(*[
        F.count_if((F.col("rank") <= k) & (F.col("label") == 1)).alias(f"_top_{k}") for k in sizes])
    joined = group_pools(df, group).join(found, group)
    cols = []
    for k in sizes:
        eligible = F.col("n") >= k
        cols.append(F.when(eligible, F.col(f"_top_{k}") / F.lit(float(k))).alias(f"p_at_{k}"))
        cols.append(F.when(eligible, (F.col(f"_top_{k}") > 0).cast("double")).alias(f"hit_at_{k}"))
    return joined.select(group, "n", "n_pos", *cols)


def group_metrics(df: DataFrame, group: str, score: str, row_id: str,
                  sizes: Sequence[int] = TOP_SIZES) -> DataFrame:
    """One row per group: pools, areas and fixed-size precision."""
    areas = curve_areas(df, score, [group]).select(group, "auroc", "average_precision")
    return precision_at_k(df, group, score, row_id, sizes).join(areas, group)


def per_group_metrics(df: DataFrame, group: str, score: str, row_id: str,
                      sizes: Sequence[int] = TOP_SIZES) -> DataFrame:
    """Macro means over groups and how many groups each mean covers."""
    g = group_metrics(df, group, score, row_id, sizes)
    return g.agg(
        F.avg("auroc").alias("perprotein_auc_mean"),
        F.avg("average_precision").alias("perprotein_aupr_mean"),
        *[F.avg(f"p_at_{k}").alias(f"p_at_{k}_mean") for k in sizes],
        *[F.avg(f"hit_at_{k}").alias(f"hit_at_{k}_mean") for k in sizes],
        F.count("*").alias("n_proteins"),
        F.count("average_precision").alias("n_proteins_with_both_labels"),
        *[F.count(f"p_at_{k}").alias(f"n_proteins_p_at_{k}") for k in sizes],
    )


# -- reports ---------------------------------------------------------------------------------

def one_row(*frames: DataFrame) -> DataFrame:
    """Side-by-side join of one-row frames."""
    out = frames[0].withColumn("_one", F.lit(1))
    for f in frames[1:]:
        out = out.join(f.withColumn("_one", F.lit(1)), "_one")
    return out.drop("_one")


def head_report(df: DataFrame, prob: str, order: str, group: str, row_id: str,
                threshold: float | DataFrame) -> DataFrame:
    """All metrics of one score head, one row."""
    areas = curve_areas(df, prob).select(
        F.col("auroc").alias("auc"), F.col("average_precision").alias("aupr"))
    return one_row(areas, confusion_metrics(df, prob, threshold), per_group_metrics(df, group, order, row_id))


def finite_means(df: DataFrame, columns: Sequence[str] = WEIGHT_COLUMNS) -> DataFrame:
    """Mean of each column's finite values."""
    from pairscreen.functions.vectors import finite

    return df.agg(*[F.avg(finite(F.col(c).try_cast("double"))).alias(f"fusion_{c}_mean") for c in columns])


def dual_head_report(df: DataFrame, row_id: str = "row_id", group: str = "protein",
                     metric: str = "f1", minimum: float = 0.0, fixed: float = 0.5,
                     threshold: float | DataFrame | None = None) -> DataFrame:
    """One row for a two-headed prediction table (``label, cls_prob,
    rank_logit, rank_prob``): every metric per head, the headline ones (global
    from the classification head, per-group from the ranking head) and their
    blends. A given threshold, e.g. one picked on validation data, replaces
    the selected one for classification only."""
    cut = threshold if threshold is not None else select_threshold(df, "cls_prob", metric, minimum, fixed)
    cls = head_report(df, "cls_prob", "cls_prob", group, row_id, cut)
    rank = head_report(df, "rank_prob", "rank_logit", group, row_id, best_f1_threshold(df, "rank_prob"))
    joined = one_row(cls.select(*[F.col(c).alias(f"cls_{c}") for c in cls.columns]),
                     rank.select(*[F.col(c).alias(f"rank_{c}") for c in rank.columns]))
    half = lambda a, b: 0.5 * F.col(a) + 0.5 * F.col(b)
    combo = half("cls_aupr", "rank_perprotein_aupr_mean")
    out = joined.select(
        "*",
        *[F.col(f"cls_{c}").alias(c) for c in CLS_TOP],
        *[F.col(f"rank_{c}").alias(c) for c in RANK_TOP],
        combo.alias("combo_cls_rank"),
        half("cls_f1", "rank_perprotein_aupr_mean").alias("combo_cls_f1_rank"),
        combo.alias("combo_aupr_ppaupr"),
        F.lit(metric).alias("cls_threshold_metric"),
    )
    weights = [c for c in WEIGHT_COLUMNS if c in df.columns]
    if weights:
        out = one_row(out, finite_means(df.filter(F.col("label").isin(0, 1)), weights))
    return out


def long_report(row: DataFrame, digits: int | None = None) -> DataFrame:
    """One-row numeric report as ``metric, value`` rows."""
    cells = [
        F.struct(F.lit(name).alias("metric"), F.col(name).cast("double").alias("value"))
        for name, kind in row.dtypes if kind not in ("string", "boolean")
    ]
    out = row.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    return out.withColumn("value", F.round("value", digits)) if digits is not None else out
