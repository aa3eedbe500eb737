"""Ranking and classification metrics, losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import query, r, role, rounded
from pairscreen.functions.vectors import sigmoid
from pairscreen.operators import losses, ordering, ranking

# -- areas: the SQL twins count pairs one by one --------------------------------------

_AUROC = """
    SELECT {keys} avg(CASE WHEN p.score > n.score THEN 1e0 WHEN p.score = n.score THEN 5e-1 ELSE 0e0 END) AS auroc
    FROM h AS p JOIN h AS n ON p.label = 1 AND n.label = 0 {same} {group}"""
_AP = """
    SELECT {keys} avg(prec) AS average_precision FROM (
        SELECT {keys} label, CAST(sum(label) OVER w AS DOUBLE) / count(*) OVER w AS prec FROM h
        WINDOW w AS ({part} ORDER BY score DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    WHERE label = 1 {group}"""


def _hard(source: str, score: str = "score") -> str:
    return f"h AS (SELECT row_id, protein, label, {score} AS score FROM {{{source}}} AS s WHERE label >= 0)"


def _both(source: str, score: str, by: bool) -> str:
    """SQL for both areas, global or per protein."""
    if by:
        a = _AUROC.format(keys="p.protein,", same="AND p.protein = n.protein", group="GROUP BY p.protein")
        b = _AP.format(keys="protein,", part="PARTITION BY protein", group="GROUP BY protein")
        return f"SELECT a.protein, auroc, average_precision FROM ({a}) AS a JOIN ({b}) AS b USING (protein)"
    a = _AUROC.format(keys="", same="", group="")
    b = _AP.format(keys="", part="", group="")
    return f"SELECT auroc, average_precision FROM ({a}) AS a, ({b}) AS b"


@query("auroc", f"WITH {_hard('scored')} SELECT {r('auroc')} AS auroc FROM ({_both('scored', 'score', False)})")
def auroc(spark, sf):
    return ranking.auroc(role(spark, sf, "scored"), "score").select(rounded("auroc").alias("auroc"))


@query("average_precision", f"WITH {_hard('scored')} SELECT {r('average_precision')} AS average_precision "
                            f"FROM ({_both('scored', 'score', False)})")
def average_precision(spark, sf):
    return ranking.average_precision(role(spark, sf, "scored"), "score").select(
        rounded("average_precision").alias("average_precision"))


@query("curve_areas_per_protein", f"WITH {_hard('scored')} SELECT protein, {r('auroc')} AS auroc, "
       f"{r('average_precision')} AS average_precision FROM ({_both('scored', 'score', True)})")
def areas_per_protein(spark, sf):
    out = ranking.curve_areas(role(spark, sf, "scored"), "score", ["protein"])
    return out.select("protein", rounded("auroc").alias("auroc"),
                      rounded("average_precision").alias("average_precision"))


# -- thresholds --------------------------------------------------------------------------

def _sweep(low: float, points: int, prob: str = "cls_prob") -> str:
    step = (1.0 - low) / (points - 1)
    return f"""
    sweep AS (
        SELECT k, t, CAST(count(*) FILTER (p >= t AND label = 1) AS DOUBLE) AS tp,
               CAST(count(*) FILTER (p >= t AND label = 0) AS DOUBLE) AS fp,
               CAST(count(*) FILTER (p < t AND label = 1) AS DOUBLE) AS fn,
               CAST(count(*) FILTER (p < t AND label = 0) AS DOUBLE) AS tn
        FROM (SELECT label, {prob} AS p FROM {{predictions}} AS q WHERE label >= 0) AS h
        JOIN (SELECT k, CASE WHEN k = {points - 1} THEN 1e0 ELSE k * CAST({step!r} AS DOUBLE) + CAST({low!r} AS DOUBLE)
              END AS t FROM range({points}) AS x(k)) AS g ON TRUE GROUP BY k, t)"""


_SCORES = {
    "f1": "CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0e0 END",
    "balanced_acc": "(tp / (tp + fn) + tn / (tn + fp)) / 2",
    "youden": "tp / greatest(tp + fn, 1) - fp / greatest(fp + tn, 1)",
    "mcc": "CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN (tp * tn - fp * fn) / "
           "(sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn)) ELSE 0e0 END",
}


def _best(metric: str, low: float = 0.0, points: int = 501, prob: str = "cls_prob") -> str:
    # equal scores differ by rounding only beyond the 12th digit
    return (f"WITH {_sweep(low, points, prob)} SELECT {r('t')} AS threshold, {r('s')} AS score FROM "
            f"(SELECT t, ROUND({_SCORES[metric]}, 12) AS s, k FROM sweep) ORDER BY s DESC, k LIMIT 1")


def _threshold(spark, sf, metric: str, minimum: float = 0.0):
    out = ranking.select_threshold(role(spark, sf, "predictions"), "cls_prob", metric, minimum)
    return out.select(rounded("threshold").alias("threshold"), rounded("score").alias("score"))


@query("best_f1_threshold", _best("f1"))
def best_f1(spark, sf):
    out = ranking.best_f1_threshold(role(spark, sf, "predictions"), "cls_prob")
    return out.select(rounded("threshold").alias("threshold"), rounded("score").alias("score"))


@query("select_threshold_balanced_acc", _best("balanced_acc"))
def best_balanced(spark, sf):
    return _threshold(spark, sf, "balanced_acc")


@query("select_threshold_youden", _best("youden", 0.25, 376))
def best_youden(spark, sf):
    return _threshold(spark, sf, "youden", 0.25)


@query("select_threshold_mcc", _best("mcc", 0.1, 451))
def best_mcc(spark, sf):
    return _threshold(spark, sf, "mcc", 0.1)


@query("threshold_sweep", f"WITH {_sweep(0.0, 501)} SELECT CAST(k AS INTEGER) AS k, {r('t', 9)} AS threshold, "
       "CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn FROM sweep")
def sweep(spark, sf):
    return ranking.threshold_sweep(role(spark, sf, "predictions"), "cls_prob").withColumn(
        "threshold", rounded("threshold", 9))


def _confusion(prob: str, cut: str) -> str:
    """One row of threshold metrics over ``{predictions}``."""
    return f"""
        SELECT 2 * tp / (2 * tp + fp + fn) AS f1, (tp + tn) / (tp + tn + fp + fn) AS acc,
               (tp / (tp + fn) + tn / (tn + fp)) / 2 AS balanced_acc, tp / (tp + fp) AS precision,
               tp / (tp + fn) AS recall, cut AS threshold, pp_mean, tp + tn + fp + fn AS n, tp + fn AS pos,
               fp + tn AS neg
        FROM (SELECT CAST(count(*) FILTER (p >= cut AND label = 1) AS DOUBLE) AS tp,
                     CAST(count(*) FILTER (p >= cut AND label = 0) AS DOUBLE) AS fp,
                     CAST(count(*) FILTER (p < cut AND label = 1) AS DOUBLE) AS fn,
                     CAST(count(*) FILTER (p < cut AND label = 0) AS DOUBLE) AS tn, avg(p) AS pp_mean, max(cut) AS cut
              FROM (SELECT label, {prob} AS p, {cut} AS cut FROM {{predictions}} AS q WHERE label >= 0))"""


@query("confusion_metrics", f"""
    SELECT {', '.join(f'{r(c)} AS {c}' for c in ('f1', 'acc', 'balanced_acc', 'precision', 'recall', 'threshold',
                                                 'pp_mean'))},
           CAST(n AS BIGINT) AS n, CAST(pos AS BIGINT) AS pos, CAST(neg AS BIGINT) AS neg
    FROM ({_confusion('cls_prob', 'CAST(0.7 AS DOUBLE)')})""")
def confusion(spark, sf):
    out = ranking.confusion_metrics(role(spark, sf, "predictions"), "cls_prob", 0.7)
    return out.select(*[rounded(c).alias(c) for c in ("f1", "acc", "balanced_acc", "precision", "recall",
                                                      "threshold", "pp_mean")], "n", "pos", "neg")


# -- per-protein ranking ----------------------------------------------------------------------

def _group_rows(source: str, score: str) -> str:
    """Per-protein metrics over ``h``."""
    return f"""
        SELECT t.protein, n, n_pos, p_at_10, hit_at_10, p_at_50, hit_at_50, auroc, average_precision FROM (
            SELECT protein, count(*) AS n, count(*) FILTER (label = 1) AS n_pos,
                   CASE WHEN count(*) >= 10 THEN count(*) FILTER (label = 1 AND k <= 10) / 10e0 END AS p_at_10,
                   CASE WHEN count(*) >= 10 THEN CAST(bool_or(label = 1 AND k <= 10) AS INT) END AS hit_at_10,
                   CASE WHEN count(*) >= 50 THEN count(*) FILTER (label = 1 AND k <= 50) / 50e0 END AS p_at_50,
                   CASE WHEN count(*) >= 50 THEN CAST(bool_or(label = 1 AND k <= 50) AS INT) END AS hit_at_50
            FROM (SELECT *, row_number() OVER (PARTITION BY protein ORDER BY score DESC, row_id) AS k FROM h)
            GROUP BY protein) AS t LEFT JOIN ({_both(source, score, True)}) AS c ON c.protein = t.protein"""


_MACRO = """avg(auroc) AS perprotein_auc_mean, avg(average_precision) AS perprotein_aupr_mean,
       avg(p_at_10) AS p_at_10_mean, avg(p_at_50) AS p_at_50_mean, avg(hit_at_10) AS hit_at_10_mean,
       avg(hit_at_50) AS hit_at_50_mean, count(*) AS n_proteins,
       count(average_precision) AS n_proteins_with_both_labels, count(p_at_10) AS n_proteins_p_at_10,
       count(p_at_50) AS n_proteins_p_at_50"""
_MACRO_NAMES = ("perprotein_auc_mean", "perprotein_aupr_mean", "p_at_10_mean", "p_at_50_mean", "hit_at_10_mean",
                "hit_at_50_mean", "n_proteins", "n_proteins_with_both_labels", "n_proteins_p_at_10",
                "n_proteins_p_at_50")


def _long(names, row: str) -> str:
    cells = ", ".join(f"('{n}', CAST({n} AS DOUBLE))" for n in names)
    return (f"SELECT metric, {r('value')} AS value FROM (SELECT x.metric, x.value FROM ({row}) AS one, "
            f"LATERAL (VALUES {cells}) AS x(metric, value))")


@query("group_metrics", f"""
    WITH {_hard('scored')} SELECT protein, CAST(n AS BIGINT) AS n, CAST(n_pos AS BIGINT) AS n_pos,
        {', '.join(f'{r(c)} AS {c}' for c in ('p_at_10', 'hit_at_10', 'p_at_50', 'hit_at_50', 'auroc',
                                              'average_precision'))}
    FROM ({_group_rows('scored', 'score')})""")
def group_metrics(spark, sf):
    out = ranking.group_metrics(role(spark, sf, "scored"), "protein", "score", "row_id")
    return out.select("protein", "n", "n_pos", *[rounded(c).alias(c) for c in (
        "p_at_10", "hit_at_10", "p_at_50", "hit_at_50", "auroc", "average_precision")])


@query("per_group_metrics", f"WITH {_hard('scored')}, m AS (SELECT {_MACRO} FROM ({_group_rows('scored', 'score')})) "
       + _long(_MACRO_NAMES, "SELECT * FROM m"))
def macro_metrics(spark, sf):
    out = ranking.per_group_metrics(role(spark, sf, "scored"), "protein", "score", "row_id")
    return _tidy(out)


def _tidy(row):
    return ranking.long_report(row).withColumn("value", rounded("value"))


@query("rank_within_group", """
    SELECT row_id, protein, CAST(row_number() OVER (PARTITION BY protein ORDER BY score DESC, row_id) AS BIGINT) AS rank
    FROM {scored} AS s""")
def ranks(spark, sf):
    return ordering.rank_within_group(role(spark, sf, "scored"), "protein", "score", "row_id").select(
        "row_id", "protein", "rank")


@query("rank_within_group_ties", """
    SELECT row_id, protein, CAST(row_number() OVER (PARTITION BY protein ORDER BY floor(score / 10) DESC, row_id) AS BIGINT) AS rank
    FROM {scored} AS s""")
def tied_ranks(spark, sf):
    df = role(spark, sf, "scored").withColumn("score", F.floor(F.col("score") / 10).cast("double"))
    return ordering.rank_within_group(df, "protein", "score", "row_id").select("row_id", "protein", "rank")


# -- the full report -----------------------------------------------------------------------------

def _head(prefix: str, prob: str, order: str, cut: str) -> str:
    """CTEs ``<prefix>`` (one row, all metrics of a head)."""
    areas = _both("predictions", prob, False)
    return f"""
    {prefix} AS (
        WITH h AS (SELECT row_id, protein, label, {prob} AS score FROM {{predictions}} AS s WHERE label >= 0)
        SELECT a.auroc AS auc, a.average_precision AS aupr, c.*, m.* FROM ({areas}) AS a, ({_confusion(prob, cut)}) AS c,
            (WITH h AS (SELECT row_id, protein, label, {order} AS score FROM {{predictions}} AS s WHERE label >= 0)
             SELECT {_MACRO} FROM ({_group_rows('predictions', order)})) AS m)"""


_HEAD_NAMES = ("auc", "aupr", "f1", "acc", "balanced_acc", "precision", "recall", "threshold", "pp_mean", "n", "pos",
               "neg", *_MACRO_NAMES)
_TOP = ranking.CLS_TOP


def _report_sql(cls_cut: str, rank_cut: str, threshold_ctes: str, weights: bool) -> str:
    cells = [f"{h}.{n} AS {h}_{n}" for h in ("cls", "rank") for n in _HEAD_NAMES]
    cells += [f"cls.{n} AS {n}" for n in _TOP] + [f"rank.{n} AS {n}" for n in _MACRO_NAMES]
    blends = {"combo_cls_rank": "0.5 * cls.aupr + 0.5 * rank.perprotein_aupr_mean",
              "combo_cls_f1_rank": "0.5 * cls.f1 + 0.5 * rank.perprotein_aupr_mean",
              "combo_aupr_ppaupr": "0.5 * cls.aupr + 0.5 * rank.perprotein_aupr_mean"}
    cells += [f"{v} AS {k}" for k, v in blends.items()]
    names = [c.rsplit(" AS ", 1)[1] for c in cells]
    sql = f"""WITH {threshold_ctes}, {_head('cls', 'cls_prob', 'cls_prob', cls_cut)},
        {_head('rank', 'rank_prob', 'rank_logit', rank_cut)}, wide AS (SELECT {', '.join(cells)} FROM cls, rank)"""
    return sql + _long(names, "SELECT * FROM wide")


def _cut_cte(name: str, prob: str) -> str:
    sweep_cte = _sweep(0.0, 501, prob).replace("sweep AS", f"sweep_{name} AS", 1)
    return (f"{sweep_cte}, cut_{name} AS (SELECT t FROM (SELECT t, k, ROUND({_SCORES['f1']}, 12) AS s "
            f"FROM sweep_{name}) ORDER BY s DESC, k LIMIT 1)")


@query("dual_head_report", _report_sql("(SELECT t FROM cut_cls)", "(SELECT t FROM cut_rank)",
                                       f"{_cut_cte('cls', 'cls_prob')}, {_cut_cte('rank', 'rank_prob')}", False))
def report(spark, sf):
    return _tidy(ranking.dual_head_report(role(spark, sf, "predictions")))


@query("finite_means", """
    SELECT {} AS fusion_drug_weight_ecfp_mean, {} AS fusion_drug_aux_gate_mean FROM {{predictions}} AS p
    WHERE label >= 0""".format(r("avg(w) FILTER (w > 0)"), r("avg(1 / w) FILTER (w > 0)")))
def finite(spark, sf):
    df = role(spark, sf, "predictions").filter("label >= 0").select(
        F.when(F.col("w") > 0, F.col("w")).otherwise(float("nan")).alias("drug_weight_ecfp"),
        F.when(F.col("w") > 0, 1 / F.col("w")).otherwise(float("inf")).alias("drug_aux_gate"))
    out = ranking.finite_means(df, ["drug_weight_ecfp", "drug_aux_gate"])
    return out.select(*[rounded(c).alias(c) for c in out.columns])


# -- losses -----------------------------------------------------------------------------------------

_SOFT = """l AS (
    SELECT cls_logit AS x, 1e0 / (1e0 + exp(-cls_logit)) AS p, CASE WHEN label < 0 THEN 2e-1 ELSE label END AS y,
           CASE WHEN label < 0 THEN 3e-2 ELSE 1e0 END AS w,
           greatest(cls_logit, 0) + ln(1 + exp(-abs(cls_logit))) AS up,
           greatest(-cls_logit, 0) + ln(1 + exp(-abs(cls_logit))) AS down FROM {predictions} AS q)"""


@query("weighted_bce", f"WITH {_SOFT} SELECT {r('sum(w * (1.5 * y * down + (1 - y) * up)) / greatest(sum(w), 1)')} "
                       "AS bce FROM l")
def bce(spark, sf):
    return losses.weighted_bce(role(spark, sf, "predictions"), "cls_logit", 1.5).select(rounded("bce").alias("bce"))


@query("focal_loss", f"""WITH {_SOFT} SELECT {r('''sum(w * (0.25 * y + 0.75 * (1 - y))
    * pow(greatest(1 - (p * y + (1 - p) * (1 - y)), 1e-6), 2) * (1.5 * y * down + (1 - y) * up))
    / greatest(sum(w), 1)''')} AS focal FROM l""")
def focal(spark, sf):
    return losses.focal_loss(role(spark, sf, "predictions"), "cls_logit", 1.5).select(rounded("focal").alias("focal"))


@query("rank_bce", f"WITH {_SOFT} SELECT {r('avg(y * down + (1 - y) * up)')} AS rank_bce FROM l WHERE w = 1")
def plain_bce(spark, sf):
    return losses.rank_bce(role(spark, sf, "predictions"), "cls_logit").select(rounded("rank_bce").alias("rank_bce"))


_GAPS = """g AS (
    SELECT p.protein, p.rank_logit - n.rank_logit AS gap FROM {predictions} AS p JOIN {predictions} AS n
    ON p.protein = n.protein AND p.label = 1 AND n.label = 0)"""


@query("bpr_loss", f"WITH {_GAPS} SELECT {r('avg(l)')} AS bpr FROM (SELECT protein, "
                   "avg(greatest(-gap, 0) + ln(1 + exp(-abs(gap)))) AS l FROM g GROUP BY protein)")
def bpr(spark, sf):
    df = role(spark, sf, "predictions")
    return losses.bpr_loss(df, "protein", "rank_logit").select(rounded("bpr").alias("bpr"))


@query("margin_loss", f"WITH {_GAPS} SELECT {r('avg(l)')} AS margin FROM (SELECT protein, "
                      "avg(greatest(0.2 - gap, 0)) AS l FROM g GROUP BY protein)")
def margin(spark, sf):
    df = role(spark, sf, "predictions")
    return losses.margin_loss(df, "protein", "rank_logit").select(
        rounded("margin").alias("margin"))


@query("sigmoid", f"SELECT row_id, {r('cls_prob', 9)} AS prob FROM {{predictions}} AS p")
def probabilities(spark, sf):
    return role(spark, sf, "predictions").select(
        "row_id", rounded(sigmoid(F.col("cls_logit")), 9).alias("prob"))
