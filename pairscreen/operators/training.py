"""Training of linear heads, and the choice among stages and epochs.

``train_cls`` and ``train_rank`` fit one head with Spark ML from nothing. ``train_stage`` fits from any
start under any loss, epoch by epoch, and keeps a table of epochs that the stop rule reads
and from which an interrupted run goes on.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairscreen.functions.vectors import pair_features
from pairscreen.operators import optimise
from pairscreen.operators.ranking import (
    confusion_metrics, curve_areas, dual_head_report, long_report, one_row, select_threshold, threshold_grid)
from pairscreen.operators.sampling import expand_gray, pos_neg_pairs
from pairscreen.operators.scoring import LinearHead, LinearModel
from pairscreen.session import materialize, release_shuffles

# Fixed values ---------------------------------------------------------------
MONITORS = ("cls_aupr", "cls_f1", "cls_balanced_acc", "rank_perprotein_aupr_mean",
            "combo_cls_rank", "combo_cls_f1_rank", "combo_aupr_ppaupr")
NO_SCORE = -1e18
PATIENCE = 10
#: Validation rows whose monitors are counted in one place.
MONITOR_ROWS = 100_000
# ----------------------------------------------------------------------------

_PARTS = {"concat_only": ("drug", "protein"), "concat_product": ("drug", "protein", "cross"),
          "concat_product_absdiff": ("drug", "protein", "cross", "gap"),
          "full_bilinear": ("drug", "protein", "cross", "gap")}


def head_from_coefficients(coefficients: Sequence[float], bias: float, mode: str,
                           drug_weights: Sequence[Sequence[float]] | None = None,
                           protein_weights: Sequence[Sequence[float]] | None = None) -> LinearHead:
    """Coefficients on a pair vector as the head that scores without building
    it; ``full_bilinear`` needs the weight matrices that built the vector."""
    parts = _PARTS[mode]
    tail = 0
    if mode == "full_bilinear":
        if drug_weights is None or protein_weights is None:
            raise ValueError("full_bilinear needs both weight matrices")
        tail = len(drug_weights)
    width = (len(coefficients) - tail) // len(parts)
    cut = {name: list(coefficients[i * width:(i + 1) * width]) for i, name in enumerate(parts)}
    if tail:
        cut |= {"bilinear": list(coefficients[-tail:]), "drug_map": drug_weights, "protein_map": protein_weights}
    return LinearHead(bias=bias, **cut)


def gradient(rows: DataFrame, beta: np.ndarray, bias: float, reg: float) -> list[float]:
    """Gradient of the logistic objective over ``label, weight, features`` rows;
    zero at the optimum. Tasks send one sum each, as wide as a feature vector."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        total, weight = np.zeros(len(beta)), 0.0
        for b in batches:
            x = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(beta))
            y, w = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            total += (w * (1 / (1 + np.exp(-(x @ beta + bias))) - y)) @ x
            weight += w.sum()
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()]), pa.array([weight])], names=["g", "w"])

    sums = rows.select(F.col("label").cast("double"), F.col("weight").cast("double"), vector_to_array("features")).mapInArrow(
        run, "g array<double>, w double").select(F.posexplode("g").alias("pos", "v"), "w").groupBy("pos").agg(
        F.sum("v").alias("v"), F.sum("w").alias("w")).orderBy("pos").collect()
    return [r["v"] / r["w"] + reg * float(beta[r["pos"]]) for r in sums]


def cls_rows(pairs: DataFrame, mode: str = "concat_product", pos_weight: float = 1.0, gray_target: float = 0.20,
             gray_weight: float = 0.03, drug: str = "drug_vec", protein: str = "prot_vec") -> DataFrame:
    """``label, weight, features`` rows of the classifier's soft-label loss."""
    built = pairs.select("label", array_to_vector(
        pair_features(F.col(drug), F.col(protein), mode)).alias("features"))
    # Written before it is split and fitted: the fit reads its input several times. It is written plain, as a task
    # holds what a split of the file holds: packed, a split of bounded size could be many times as much.
    return expand_gray(materialize(built, "features", plain=True), gray_target, gray_weight, pos_weight).select(
        F.col("y").alias("label"), "weight", "features")


def train_cls(pairs: DataFrame, mode: str = "concat_product", pos_weight: float = 1.0,
              gray_target: float = 0.20, gray_weight: float = 0.03, reg: float = 1e-4,
              max_iter: int = 50, drug: str = "drug_vec", protein: str = "prot_vec") -> LogisticRegressionModel:
    """Soft-label cross-entropy classifier on pair vectors."""
    return fit_cls(cls_rows(pairs, mode, pos_weight, gray_target, gray_weight, drug, protein), reg, max_iter)


def fit_cls(rows: DataFrame, reg: float = 1e-4, max_iter: int = 50) -> LogisticRegressionModel:
    return LogisticRegression(weightCol="weight", regParam=reg, maxIter=max_iter,
                              standardization=False).fit(rows)


def cls_head(model: LogisticRegressionModel, mode: str = "concat_product") -> LinearHead:
    return head_from_coefficients(model.coefficients.toArray().tolist(), float(model.intercept), mode)


def rank_differences(pairs: DataFrame, group: str, row_id: str, mode: str = "concat_product", cap: int = 512,
                     seed: int = 0, drug: str = "drug_vec", protein: str = "prot_vec") -> DataFrame:
    """Feature gaps of positive/negative pairs, each also mirrored; weighted
    so that every group counts the same."""
    hard = pairs.filter(F.col("label").isin(0, 1))
    # The draw is read twice below, and its ids decide which vectors meet.
    drawn = materialize(pos_neg_pairs(hard.select(group, "label", row_id), group, row_id, cap=cap, seed=seed), "drawn")
    release_shuffles(pairs.sparkSession)  # of the draw; the driver's heap shrinks as well
    share = drawn.groupBy(group).agg((F.lit(1.0) / F.count("*")).alias("weight"))
    # Vectors join the drawn pairs only, not every step of the draw; pair vectors are built where both sides have met.
    side = lambda s: hard.select(*[F.col(c).alias(f"{s}_{a}") for c, a in ((row_id, row_id), (drug, "_drug"), (protein, "_protein"))])
    x = lambda s: pair_features(F.col(f"{s}__drug"), F.col(f"{s}__protein"), mode)
    both = drawn.join(share, group).join(side("pos"), f"pos_{row_id}").join(side("neg"), f"neg_{row_id}").select(
        group, "weight", F.zip_with(x("pos"), x("neg"), lambda a, b: a - b).alias("_gap"))
    gap = F.col("_gap")
    mirrored = F.array(F.struct(F.lit(1.0).alias("label"), gap.alias("x")),
                       F.struct(F.lit(0.0).alias("label"), F.transform(gap, lambda v: -v).alias("x")))
    return both.select(group, "weight", F.explode(mirrored).alias("c")).select(
        group, "weight", "c.label", array_to_vector(F.col("c.x")).alias("features"))


def train_rank(pairs: DataFrame, group: str, row_id: str, mode: str = "concat_product", cap: int = 512,
               seed: int = 0, reg: float = 1e-4, max_iter: int = 50) -> LogisticRegressionModel:
    """Linear pairwise-ranking head: logistic regression without intercept on
    feature gaps minimises the mean softplus(-gap) loss."""
    return fit_rank(materialize(rank_differences(pairs, group, row_id, mode, cap, seed), "gaps"), reg, max_iter)


def fit_rank(rows: DataFrame, reg: float = 1e-4, max_iter: int = 50) -> LogisticRegressionModel:
    return LogisticRegression(weightCol="weight", regParam=reg, maxIter=max_iter, fitIntercept=False,
                              standardization=False).fit(rows)


def rank_head(model: LogisticRegressionModel, mode: str = "concat_product") -> LinearHead:
    return head_from_coefficients(model.coefficients.toArray().tolist(), 0.0, mode)


# -- epochs and stages --------------------------------------------------------------

def early_stop_select(history: DataFrame, monitors: Sequence[str], main: str, patience: int = PATIENCE,
                      run: Sequence[str] = ("stage",), epoch: str = "epoch") -> DataFrame:
    """Best epoch per run and monitor, honouring early stopping.

    ``history`` has one row per run and epoch. A run ends at the first epoch
    that is ``patience`` epochs past the main monitor's last strict
    improvement; a monitor's best epoch is the first to reach its highest
    value before that. A value that is missing never counts; with none at all
    the epoch is NULL. A run has at most its number of epochs, so windows over
    it stay small.
    """
    def filled(m: str):
        value = F.col(m).cast("double")
        return F.when(value.isNull() | F.isnan(value), F.lit(NO_SCORE)).otherwise(value)

    in_order = W.partitionBy(*run).orderBy(epoch)
    before = in_order.rowsBetween(W.unboundedPreceding, -1)
    h = history.withColumn("_main", filled(main))
    h = h.withColumn("_improved", F.col("_main") > F.coalesce(F.max("_main").over(before), F.lit(NO_SCORE)))
    h = h.withColumn("_first", F.min(epoch).over(W.partitionBy(*run)))
    last = F.max(F.when(F.col("_improved"), F.col(epoch))).over(in_order.rowsBetween(W.unboundedPreceding, 0))
    h = h.withColumn("_bad", F.col(epoch) - F.coalesce(last, F.col("_first") - 1))
    h = h.withColumn("_stop", F.min(F.when(F.col("_bad") >= patience, F.col(epoch))).over(W.partitionBy(*run)))
    trained = h.filter(F.col("_stop").isNull() | (F.col(epoch) <= F.col("_stop")))
    cells = F.array(*[F.struct(F.lit(m).alias("monitor"), filled(m).alias("score")) for m in monitors])
    long = trained.select(*run, epoch, F.explode(cells).alias("c")).select(*run, epoch, "c.monitor", "c.score")
    best = long.groupBy(*run, "monitor").agg(
        F.max(F.struct("score", (-F.col(epoch)).alias("_e"))).alias("b"), F.max(epoch).alias("last_epoch"))
    reached = F.col("b.score") > NO_SCORE
    return best.select(
        *run, "monitor", F.when(reached, -F.col("b._e")).alias("best_epoch"),
        F.when(reached, F.col("b.score")).alias("best_score"), "last_epoch")


def select_checkpoint(best: DataFrame, policy: str = "finetune", monitor: str = "cls_aupr",
                      run: Sequence[str] = ()) -> DataFrame:
    """The stage whose classifier goes on (per run, if runs are named):
    fine-tuning, unless the policy is ``best_stage`` and pretraining scored
    strictly higher."""
    if policy not in ("finetune", "best_stage"):
        raise ValueError("policy must be finetune or best_stage")
    stages = ["cls_train"] if policy == "finetune" else ["pretrain", "cls_train"]
    rows = best.filter((F.col("monitor") == monitor) & F.col("stage").isin(stages))
    preference = F.struct(F.coalesce("best_score", F.lit(NO_SCORE)), F.col("stage") == "cls_train")
    chosen = F.max_by(F.struct("stage", "best_epoch", "best_score"), preference).alias("b")
    return rows.groupBy(*run).agg(chosen).select(*run, "b.stage", "b.best_epoch", "b.best_score")


# -- training by epochs -----------------------------------------------------------------

HISTORY = "stage string, epoch int, train_loss double, weights array<double>, " + ", ".join(f"{m} double" for m in MONITORS)


@dataclass
class Stage:
    """``best`` has a row for each monitor; ``weights`` are those of the main monitor's best epoch."""

    history: DataFrame
    best: DataFrame
    weights: np.ndarray
    epochs: dict[int, np.ndarray]


def feature_rows(pairs: DataFrame, mode: str = "concat_product", drug: str = "drug_vec", protein: str = "prot_vec",
                 keep: Sequence[str] = ("row_id", "protein", "label"), hold: bool = True) -> DataFrame:
    """Pairs with their vectors as ``features``, written once, and persisted in an order fixed by ``row_id`` for
    all passes of a fit; ``unpersist`` them after it. Without ``hold`` they are not persisted: an objective holds its own."""
    built = materialize(pairs.select(*keep, pair_features(F.col(drug), F.col(protein), mode).alias("features")), "features")
    rows = optimise.in_order(built, keep[:1])
    return rows.persist() if hold else rows


def cls_objective(rows: DataFrame, loss: str = "bce", pos_weight: float = 1.0, reg: float = 1e-4,
                  gray_target: float = 0.20, gray_weight: float = 0.03, alpha: float = 0.25, gamma: float = 2.0,
                  mode: str = "concat_product") -> optimise.Objective:
    """The classifier's loss, ``bce`` or ``focal``, over ``feature_rows`` or the blocks of ``optimise.pair_vectors``, whose pair
    vectors of ``mode`` are never built; the last weight is the bias."""
    if loss not in ("bce", "focal"):
        raise ValueError("loss must be bce or focal")
    form = optimise.cross_entropy if loss == "bce" else optimise.focal(alpha, gamma)
    if "drugs" in rows.columns:
        return optimise.vector_objective(rows, mode, form, reg, pos_weight, gray_target, gray_weight)
    return optimise.row_objective(rows, form, reg, pos_weight, gray_target, gray_weight)


def rank_objective(rows: DataFrame, loss: str = "bpr", reg: float = 1e-4, margin: float = 0.2, group: str = "protein",
                   row_id: str = "row_id") -> optimise.Objective:
    """The ranking head's loss, without a bias: ``bpr`` or ``margin`` over every pair of a group's hard rows,
    or ``bce`` over the hard rows."""
    if loss not in ("bpr", "margin", "bce"):
        raise ValueError("loss must be bpr, margin or bce")
    if loss == "bce":
        return optimise.row_objective(rows.filter(F.col("label").isin(0, 1)), reg=reg, intercept=False)
    blocks = optimise.packed_blocks(optimise.pair_blocks(rows, group, row_id)).persist()
    return optimise.pair_objective(blocks, optimise.bpr if loss == "bpr" else optimise.margin(margin), reg)


def feature_logits(rows: DataFrame, heads: Sequence[tuple[str, np.ndarray, np.ndarray]]) -> DataFrame:
    """``model, row_id, protein, label`` and both heads' logits and probabilities for every named pair of
    classification weights (bias last) and ranking weights: one scan of ``feature_rows`` serves all."""
    names = [n for n, _, _ in heads]
    cls, rank = (np.stack([np.asarray(h[k], float) for h in heads], axis=1) for k in (1, 2))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(cls) - 1)
            z, r = x @ cls[:-1] + cls[-1], x @ rank
            for k, name in enumerate(names):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * batch.num_rows, pa.string()), *batch.columns[:3], pa.array(z[:, k]), pa.array(r[:, k])],
                    names=["model", "row_id", "protein", "label", "cls_logit", "rank_logit"])

    kind = dict(rows.dtypes)
    scored = rows.select("row_id", "protein", "label", "features").mapInArrow(
        run, f"model string, row_id {kind['row_id']}, protein {kind['protein']}, label {kind['label']}, cls_logit double, rank_logit double")
    return scored.select("*", *[(1 / (1 + F.exp(-F.col(f"{h}_logit")))).alias(f"{h}_prob") for h in ("cls", "rank")])


def _average_precision(label: np.ndarray, score: np.ndarray) -> float | None:
    """What ``curve_areas`` says: equal scores count as one point; none where a class is missing."""
    if not 0 < label.sum() < len(label):
        return None
    score, at = np.unique(score + 0.0, return_inverse=True)
    pos, every = np.bincount(at, label), np.bincount(at)
    from_here = lambda counts: np.cumsum(counts[::-1])[::-1]
    return float((pos * (from_here(pos) / from_here(every))).sum() / label.sum())


def _few_monitors(few: pa.Table, metric: str) -> tuple[float | None, ...] | None:
    """MONITORS of definitive ``group, label, cls_prob, rank_logit`` rows; nothing where scores or groups are missing."""
    label, prob, rank = (c.to_numpy() for c in few.columns[1:])
    if not len(label) or few.column(0).null_count or not (np.isfinite(prob).all() and np.isfinite(rank).all()):
        return None
    low, points = threshold_grid()
    grid = np.arange(points) * ((1.0 - low) / (points - 1)) + low
    grid[-1] = 1.0
    n_pos, n_neg = label.sum(), (1 - label).sum()
    above = lambda own: len(own) - np.searchsorted(np.sort(own), grid)
    tp, fp = above(prob[label == 1]).astype(float), above(prob[label == 0]).astype(float)
    fn, tn = n_pos - tp, n_neg - fp
    ratio = lambda a, b: np.divide(a, b, out=np.zeros(len(a)), where=b != 0)
    f1 = ratio(2 * tp, 2 * tp + fp + fn)
    recalls = [hit / n for hit, n in ((tp, n_pos), (tn, n_neg)) if n]
    balanced = sum(recalls) / len(recalls)
    score = {"f1": lambda: f1, "balanced_acc": lambda: balanced, "youden": lambda: tp / max(n_pos, 1) - fp / max(n_neg, 1),
             "mcc": lambda: ratio(tp * tn - fp * fn, np.sqrt(tp + fp) * np.sqrt(tp + fn) * np.sqrt(tn + fp) * np.sqrt(tn + fn))}[metric]()
    best = int(np.argmax(score))
    _, group = np.unique(few.column(0).combine_chunks().dictionary_encode().indices.to_numpy(), return_inverse=True)
    order = np.argsort(group, kind="stable")
    parts = np.split(order, np.flatnonzero(np.diff(group[order])) + 1)
    each = [v for v in (_average_precision(label[p], rank[p]) for p in parts) if v is not None]
    aupr, per_group = _average_precision(label, prob), math.fsum(each) / len(each) if each else None
    half = lambda a: None if a is None or per_group is None else 0.5 * a + 0.5 * per_group
    return aupr, float(f1[best]), float(balanced[best]), per_group, half(aupr), half(float(f1[best])), half(aupr)


def monitor_values(scored: DataFrame, row_id: str = "row_id", group: str = "protein", metric: str = "f1",
                   rows: int | None = None) -> DataFrame:
    """One row with the MONITORS of a prediction table, without the rest of its report. ``rows`` may say how many rows there are:
    up to MONITOR_ROWS of them are counted in one place, with the same result."""
    if rows is not None and rows <= MONITOR_ROWS and metric != "fixed":
        few = scored.filter(F.col("label").isin(0, 1)).select(
            group, F.col("label").cast("double"), F.col("cls_prob").cast("double"), F.col("rank_logit").cast("double")).toArrow()
        found = _few_monitors(few, metric)
        if found is not None:
            return scored.sparkSession.createDataFrame([found], ", ".join(f"{m} double" for m in MONITORS))
    cls = one_row(curve_areas(scored, "cls_prob").select(F.col("average_precision").alias("cls_aupr")),
                  confusion_metrics(scored, "cls_prob", select_threshold(scored, "cls_prob", metric)).select(
                      F.col("f1").alias("cls_f1"), F.col("balanced_acc").alias("cls_balanced_acc")))
    rank = curve_areas(scored, "rank_logit", [group]).agg(F.avg("average_precision").alias("rank_perprotein_aupr_mean"))
    both = one_row(cls, rank)
    half = lambda name: 0.5 * F.col(name) + 0.5 * F.col("rank_perprotein_aupr_mean")
    return both.select("*", half("cls_aupr").alias("combo_cls_rank"), half("cls_f1").alias("combo_cls_f1_rank"),
                       half("cls_aupr").alias("combo_aupr_ppaupr")).select(*MONITORS)


def open_history(spark: SparkSession, path: str) -> DataFrame:
    """The table of epochs at ``path``, created empty if there is none."""
    spark.createDataFrame([], HISTORY).write.mode("ignore").parquet(path)
    return spark.read.schema(HISTORY).parquet(path)


def train_stage(spark: SparkSession, stage: str, objective: optimise.Objective, start: np.ndarray,
                report: Callable[[np.ndarray], DataFrame], path: str, epochs: int, main: str = "cls_aupr",
                patience: int = PATIENCE, steps: int = 5) -> Stage:
    """Fit from ``start``, ``steps`` descent steps an epoch, until the stop rule of ``early_stop_select`` says
    that the ``main`` monitor no longer improves.

    ``report`` gives the MONITORS of weights on validation data. Every epoch is one row of the table at ``path``: loss,
    monitors and weights. A run that finds rows there goes on after the last of them, from its
    weights, and ends with the same rows as one that was never interrupted, as an epoch depends on
    the weights before it alone. The driver holds one weight vector an epoch.
    """
    def mine() -> DataFrame:
        return open_history(spark, path).filter(F.col("stage") == stage)

    past = mine().select("epoch", "weights", main).collect()
    done, scores = {r["epoch"]: np.asarray(r["weights"]) for r in past}, {r["epoch"]: r[main] for r in past}

    def stopped() -> bool:
        """The rule of ``early_stop_select``, over the few numbers that the table holds so far."""
        best, at = NO_SCORE, 0
        for epoch in sorted(scores):
            value = scores[epoch]
            if value is not None and value > best:
                best, at = value, epoch
            if epoch - at >= patience:
                return True
        return False

    while len(done) < epochs and not stopped():
        epoch = len(done) + 1
        found = optimise.fit(objective, done.get(epoch - 1, np.asarray(start, float)), steps)
        values = report(found.weights).first().asDict()
        row = (stage, epoch, float(found.loss), found.weights.tolist(), *[values[m] for m in MONITORS])
        spark.createDataFrame([row], HISTORY).coalesce(1).write.mode("append").parquet(path)
        done[epoch], scores[epoch] = found.weights, values[main]
    history = mine()
    best = early_stop_select(history, MONITORS, main, patience)
    chosen = best.filter(F.col("monitor") == main).first()
    at = chosen["best_epoch"] if chosen else None
    return Stage(history, best, done[at] if at else np.asarray(start, float), done)


def evaluate_run(val: DataFrame, test: DataFrame, row_id: str = "row_id", group: str = "protein",
                 metric: str = "f1", minimum: float = 0.0) -> DataFrame:
    """Test report at the threshold that validation data selects."""
    cut = select_threshold(val, "cls_prob", metric, minimum)
    return dual_head_report(test, row_id, group, metric, threshold=cut)


def evaluate_monitors(best: DataFrame, val: DataFrame, test: DataFrame, epoch_of: str = "model", row_id: str = "row_id",
                      group: str = "protein", metric: str = "f1", minimum: float = 0.0) -> DataFrame:
    """``monitor, epoch, split, metric, value``: for every monitor, the full report of its best epoch's predictions on
    validation and on test data, the latter at the threshold that validation selects.

    ``best`` is ``early_stop_select``'s table; ``val`` and ``test`` hold the predictions of several epochs, named in
    ``epoch_of``. Monitors that chose the same epoch share its reports; a monitor without an epoch has none.
    """
    chosen = best.filter("best_epoch is not null").select("monitor", F.col("best_epoch").cast("string").alias("epoch"))
    epochs = sorted(r["epoch"] for r in chosen.select("epoch").distinct().collect())  # at most one a monitor
    out = None
    for epoch in epochs:
        own_val, own_test = (df.filter(F.col(epoch_of) == epoch) for df in (val, test))
        cut = select_threshold(own_val, "cls_prob", metric, minimum)
        for split, row in (("val", dual_head_report(own_val, row_id, group, metric, minimum, threshold=cut)),
                           ("test", dual_head_report(own_test, row_id, group, metric, threshold=cut))):
            part = long_report(row).select(F.lit(epoch).alias("epoch"), F.lit(split).alias("split"), "metric", "value")
            out = part if out is None else out.unionByName(part)
    if out is None:
        return chosen.limit(0).select("monitor", F.col("epoch").cast("int").alias("epoch"), F.lit("").alias("split"), F.lit("").alias("metric"),
                                      F.lit(0.0).alias("value"))
    return chosen.join(out, "epoch").select("monitor", F.col("epoch").cast("int").alias("epoch"), "split", "metric", "value")
