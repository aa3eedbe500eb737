"""Scoring, screening and ensembles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from catalog.base import query, r, role, rounded, table
from pairscreen.operators import joins, ranking, scoring
from pairscreen.plans.predict import predict
from pairscreen.plans.screen import screen
from pairscreen.session import materialize, scratch_path
from pairscreen.sources import scans, sinks

# Screening set-up shared by the queries: the embeddings are the library, the
# lowest vector id of each label its target, and two models the dot products
# over all 64 and over the first 32 dimensions.
TOP, BOTTOM, BETA, GATE = 50, 20, 0.5, 0.48


def models():
    return [scoring.dot_model("full", 64, seed=1), scoring.dot_model("half", 64, 32, seed=2)]


def library_bank(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("drug_id"), F.col("embedding").alias("vec"))


def library_table(spark, sf):
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("drug_id"), F.col("vec_id").cast("string").alias("drug_key"), "label")


def protein_bank(spark, sf):
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("idx"), F.col("vec_id").cast("string").alias("prot_id"),
        F.concat(F.lit("key"), F.col("vec_id").cast("string")).alias("protein_key"), F.col("embedding").alias("vec"))


def resolved_targets(spark, sf):
    return joins.target_lookup(role(spark, sf, "targets"), protein_bank(spark, sf))


_GRID = """
    lib AS (SELECT vec_id AS drug_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    tgt AS (SELECT t.protein_key, t.pdb_id, l.v AS tv FROM {targets} AS t JOIN lib AS l ON l.drug_id = CAST(t.prot_id AS BIGINT)),
    grid AS (SELECT drug_id, label, protein_key, pdb_id, list_inner_product(v, tv) AS a,
                    list_inner_product(v[1:32], tv[1:32]) AS b FROM lib, tgt),
    sc AS (SELECT drug_id, label, protein_key, pdb_id, (a + b) / 2 AS m, abs(a - b) / 2 AS s,
                  1 / (1 + exp(-(a + b) / 2)) AS p FROM grid),
    f AS (SELECT *, m - 0.5 * s AS final FROM sc)"""
_COLUMNS = f"""drug_id, protein_key, pdb_id, {r('m')} AS cls_logit_mean, {r('p')} AS cls_prob_mean,
    {r('m')} AS rank_logit_mean, {r('p')} AS rank_prob_mean, {r('s')} AS cls_logit_std, {r('s')} AS rank_logit_std,
    {r('final')} AS final_score"""
_ELIGIBLE = "drug_id IN (SELECT p_partkey FROM part WHERE p_size <= 25 AND p_type <> 'PROMO')"
_PREDICATE = "p_size <= 25 AND p_type <> 'PROMO'"
_SCORES = ("cls_logit_mean", "cls_prob_mean", "rank_logit_mean", "rank_prob_mean", "cls_logit_std", "rank_logit_std",
           "final_score")


def _tidy(df, *keep):
    return df.select("drug_id", "protein_key", "pdb_id", *keep, *[rounded(c).alias(c) for c in _SCORES])


def grid(spark, sf, **limits):
    return scoring.screening_table(
        scoring.cross_score(library_bank(spark, sf), resolved_targets(spark, sf), models(), BETA, **limits), BETA)


def metadata(spark, sf):
    return table(spark, sf, "part").withColumn("drug_key", F.col("p_partkey").cast("string"))


# -- grid and its columns --------------------------------------------------------------

@query("cross_score", f"WITH {_GRID} SELECT {_COLUMNS} FROM f")
def cross_score(spark, sf):
    return _tidy(grid(spark, sf))


def stored(spark, sf):
    """Stored predictions of two models, side by side."""
    return role(spark, sf, "predictions").select(
        "row_id", F.array("cls_logit", "rank_logit").alias("cls_logits"), F.array("rank_logit", "cls_logit").alias("rank_logits"))


_STORED = """SELECT row_id, (cls_logit + rank_logit) / 2 AS m, abs(cls_logit - rank_logit) / 2 AS s FROM {predictions} AS p"""


@query("final_score", f"SELECT row_id, {r('m - 0.5 * s')} AS final_score FROM ({_STORED})")
def final_scores(spark, sf):
    return scoring.screening_table(stored(spark, sf), BETA).select("row_id", rounded("final_score").alias("final_score"))


@query("ensemble_stats", f"SELECT row_id, {r('m')} AS mean, {r('s')} AS std FROM ({_STORED})")
def ensemble(spark, sf):
    return scoring.ensemble_stats(stored(spark, sf)).select(
        "row_id", rounded("rank_logit_mean").alias("mean"), rounded("rank_logit_std").alias("std"))


@query("score_gate", f"SELECT row_id FROM ({_STORED}) WHERE 1 / (1 + exp(-m)) >= {GATE}")
def gated(spark, sf):
    return scoring.score_gate(scoring.screening_table(stored(spark, sf), BETA), GATE).select("row_id")


@query("top_k_per_target", f"""WITH {_GRID} SELECT drug_id, protein_key, CAST(k AS INTEGER) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY protein_key ORDER BY final DESC, drug_id DESC) AS k FROM f) WHERE k <= {TOP}""")
def top(spark, sf):
    return scoring.top_k_per_target(grid(spark, sf, top=TOP), TOP).select("drug_id", "protein_key", "rank")


@query("bottom_k_per_target", f"""WITH {_GRID} SELECT drug_id, protein_key, CAST(k AS INTEGER) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY protein_key ORDER BY final, drug_id) AS k FROM f) WHERE k <= {BOTTOM}""")
def bottom(spark, sf):
    return scoring.bottom_k_per_target(grid(spark, sf, bottom=BOTTOM), BOTTOM).select("drug_id", "protein_key", "rank")


_TIES = """SELECT protein AS protein_key, row_id AS drug_id, score AS final_score, k AS rank FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY protein ORDER BY score {o}, row_id {o}) AS INTEGER) AS k
    FROM (SELECT protein, row_id, floor(score / 20e0) AS score FROM {{scored}} AS s)) WHERE k <= 7"""


def _tied(spark, sf):
    return role(spark, sf, "scored").select(
        F.col("protein").alias("protein_key"), F.col("row_id").alias("drug_id"),
        F.floor(F.col("score") / 20).cast("double").alias("final_score"))


@query("top_k_with_ties", _TIES.format(o="DESC"))
def top_ties(spark, sf):
    return scoring.top_k_per_target(_tied(spark, sf), 7)


@query("bottom_k_with_ties", _TIES.format(o="ASC"))
def bottom_ties(spark, sf):
    return scoring.bottom_k_per_target(_tied(spark, sf), 7)


# -- whole screens --------------------------------------------------------------------------

@query("screen", f"""WITH {_GRID}, hits AS (
        SELECT *, row_number() OVER (PARTITION BY protein_key ORDER BY final DESC, drug_id DESC) AS k
        FROM f WHERE {_ELIGIBLE} AND p >= {GATE})
    SELECT {_COLUMNS}, CAST(drug_id AS STRING) AS drug_key, label, CAST(k AS INTEGER) AS rank FROM hits WHERE k <= {TOP}""")
def screened(spark, sf):
    found = _screen(spark, sf)
    return _tidy(found.top, "drug_key", "label", "rank")


def _screen(spark, sf, **options):
    return screen(
        library_table(spark, sf), library_bank(spark, sf), role(spark, sf, "targets"), protein_bank(spark, sf), models(),
        top_k=TOP, beta=BETA, cls_min_prob=GATE, eligibility=metadata(spark, sf), predicate=_PREDICATE, **options)


@query("screen_bottom", f"""WITH {_GRID}, hits AS (
        SELECT *, row_number() OVER (PARTITION BY protein_key ORDER BY final, drug_id) AS k FROM f)
    SELECT {_COLUMNS}, CAST(drug_id AS STRING) AS drug_key, label, CAST(k AS INTEGER) AS rank FROM hits WHERE k <= {BOTTOM}""")
def screened_bottom(spark, sf):
    return _tidy(_screen(spark, sf, bottom_k=BOTTOM).bottom, "drug_key", "label", "rank")


@query("screen_all_scores", f"""WITH {_GRID}, hits AS (
        SELECT *, row_number() OVER (PARTITION BY protein_key ORDER BY final DESC, drug_id DESC) AS k
        FROM f WHERE {_ELIGIBLE} AND p >= {GATE})
    SELECT {_COLUMNS}, CAST(drug_id AS STRING) AS drug_key, label, CAST(k AS INTEGER) AS rank FROM hits WHERE k <= {TOP}""")
def screened_keeping_all(spark, sf):
    """The same list with every score kept instead of pruned."""
    return _tidy(_screen(spark, sf, keep_scores=True).top, "drug_key", "label", "rank")


@query("screen_nonfinite", f"""WITH {_GRID}, hits AS (
        SELECT *, row_number() OVER (PARTITION BY protein_key ORDER BY final DESC, drug_id DESC) AS k
        FROM f WHERE drug_id % 3 <> 0 AND drug_id % 5 <> 0)
    SELECT drug_id, protein_key, CAST(k AS INTEGER) AS rank FROM hits WHERE k <= {TOP}""")
def screened_nonfinite(spark, sf):
    """Library rows with NaN or infinite vectors make no list, pruned or not."""
    bad = F.when(F.col("drug_id") % 3 == 0, F.lit(float("nan"))).when(F.col("drug_id") % 5 == 0, F.lit(float("inf")))
    bank = library_bank(spark, sf).withColumn("vec", F.transform("vec", lambda v: F.coalesce(bad, v.cast("double"))))
    targets = resolved_targets(spark, sf)
    pruned = scoring.screening_table(scoring.cross_score(bank, targets, models(), BETA, top=TOP), BETA)
    whole = scoring.screening_table(scoring.cross_score(bank, targets, models(), BETA), BETA)
    lists = [scoring.top_k_per_target(t, TOP).select("drug_id", "protein_key", "rank") for t in (pruned, whole)]
    return lists[0].join(lists[1], ["drug_id", "protein_key", "rank"], "full")


@query("selected_ids", f"""WITH {_GRID}, hits AS (SELECT drug_id,
        row_number() OVER (PARTITION BY protein_key ORDER BY final DESC, drug_id DESC) AS t,
        row_number() OVER (PARTITION BY protein_key ORDER BY final, drug_id) AS b FROM f)
    SELECT DISTINCT drug_id FROM hits WHERE t <= {TOP} OR b <= {BOTTOM}""")
def selected(spark, sf):
    g = materialize(grid(spark, sf, top=TOP, bottom=BOTTOM), "scores")
    return joins.selected_ids(scoring.top_k_per_target(g, TOP), scoring.bottom_k_per_target(g, BOTTOM))


@query("attach_metadata", f"""WITH {_GRID} SELECT f.drug_id, protein_key, p_name, p_brand FROM f LEFT JOIN part
    ON p_partkey = f.drug_id QUALIFY row_number() OVER (PARTITION BY protein_key ORDER BY final DESC, f.drug_id DESC) <= {TOP}""")
def with_metadata(spark, sf):
    hits = materialize(scoring.top_k_per_target(grid(spark, sf, top=TOP), TOP).select("drug_id", "protein_key"), "hits")
    described = table(spark, sf, "part").select(F.col("p_partkey").alias("drug_id"), "p_name", "p_brand")
    return scoring.with_library_columns(hits, described)


@query("write_all_scores", f"WITH {_GRID} SELECT {_COLUMNS} FROM f")
def all_scores(spark, sf):
    return _tidy(spark.read.parquet(sinks.write_table(grid(spark, sf), scratch_path(spark, "all-scores"))))


@query("write_per_target", f"""WITH {_GRID} SELECT replace(protein_key, '::', '_') AS protein_key_safe, protein_key,
    drug_id FROM f QUALIFY row_number() OVER (PARTITION BY protein_key ORDER BY final DESC, drug_id DESC) <= {TOP}""")
def per_target(spark, sf):
    hits = scoring.top_k_per_target(grid(spark, sf, top=TOP), TOP)
    path = sinks.write_per_target(hits, scratch_path(spark, "targets"))
    return spark.read.parquet(path).select("protein_key_safe", "protein_key", "drug_id")


# -- targets and eligibility -------------------------------------------------------------------

@query("eligible_ids", f"SELECT DISTINCT vec_id AS drug_id FROM embeddings WHERE vec_id IN "
                       f"(SELECT p_partkey FROM part WHERE {_PREDICATE})")
def eligible(spark, sf):
    return joins.eligible_ids(metadata(spark, sf), library_table(spark, sf), predicate=_PREDICATE)


@query("eligibility_filter", f"""SELECT vec_id AS drug_id, vec_id IN (SELECT p_partkey FROM part WHERE {_PREDICATE})
    AS eligible FROM embeddings""")
def eligibility_flags(spark, sf):
    from pairscreen.plans.screen import flag_eligible

    ids = joins.eligible_ids(metadata(spark, sf), library_table(spark, sf), predicate=_PREDICATE)
    return flag_eligible(library_bank(spark, sf), ids).select("drug_id", "eligible")


@query("select_targets", "SELECT protein_key, pdb_id FROM {targets} AS t WHERE pdb_id IN ('P2', 'P5')")
def chosen_targets(spark, sf):
    return joins.select_targets(role(spark, sf, "targets"), ["P2", " P5", ""]).select("protein_key", "pdb_id")


@query("target_lookup", """
    WITH t AS (SELECT vec_id, CAST(CASE WHEN vec_id % 3 = 0 THEN 'key' || CAST(vec_id AS STRING) ELSE 'none' END AS STRING)
                      AS protein_key FROM embeddings)
    SELECT CAST(vec_id AS STRING) AS prot_id, protein_key, CASE WHEN vec_id % 3 = 0 THEN vec_id
           ELSE (vec_id + 1) % (SELECT count(*) FROM embeddings) END AS idx FROM t""")
def targets_found(spark, sf):
    """The target names another row's id unless its key hits first."""
    n = F.lit(table(spark, sf, "embeddings").count())
    bank = protein_bank(spark, sf).withColumn("prot_id", ((F.col("idx") + n - 1) % n).cast("string"))
    wanted = table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("prot_id"),
        F.when(F.col("vec_id") % 3 == 0, F.concat(F.lit("key"), F.col("vec_id").cast("string"))).otherwise("none")
        .alias("protein_key"))
    return joins.target_lookup(wanted, bank).select("prot_id", "protein_key", "idx")


@query("manifest_match", """
    WITH m AS (SELECT CAST(s_suppkey AS STRING) AS id, CAST(s_nationkey AS STRING) AS k, s_name AS f FROM supplier),
         t AS (SELECT CAST(n_nationkey AS STRING) AS id, CAST(n_regionkey AS STRING) AS k FROM nation)
    SELECT t.id AS prot_id, t.k AS protein_key, count(m.f) AS n_records, min(m.f) AS token_file
    FROM t LEFT JOIN m ON m.id = t.id OR m.k = t.k GROUP BY ALL""")
def manifest(spark, sf):
    text = lambda c, n: F.col(c).cast("string").alias(n)
    records = table(spark, sf, "supplier").select(
        text("s_suppkey", "prot_id"), text("s_nationkey", "protein_key"), F.col("s_name").alias("token_file"),
        F.length("s_name").alias("length"))
    targets = table(spark, sf, "nation").select(text("n_nationkey", "prot_id"), text("n_regionkey", "protein_key"))
    return joins.manifest_match(targets, records).drop("length")


# -- labelled pairs -----------------------------------------------------------------------------

_PAIR_SCORES = """
    e AS (SELECT drug_id, prot_id, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n
          FROM {pairs} AS q GROUP BY ALL),
    b AS (SELECT CAST(vec_id AS STRING) AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    g AS (SELECT drug_id, prot_id, CAST(p > 0 AS INTEGER) AS label, list_inner_product(d.v, t.v) AS a,
                 list_inner_product(d.v[1:32], t.v[1:32]) AS h
          FROM e JOIN b AS d ON d.id = drug_id JOIN b AS t ON t.id = prot_id WHERE (p > 0) <> (n > 0))"""


def drug_and_protein_banks(spark, sf):
    vectors = table(spark, sf, "embeddings")
    return (scans.scan_bank(vectors.select(F.col("vec_id").alias("drug_id"), "embedding"), ["drug_id"]),
            scans.scan_bank(vectors.select(F.col("vec_id").alias("prot_id"), "embedding"), ["prot_id"]))


def _predictions(spark, sf):
    drugs, proteins = drug_and_protein_banks(spark, sf)
    return predict(role(spark, sf, "messy_pairs"), drugs, proteins, models(), on_mixture="keep_hard")


@query("score_pairs", f"""WITH {_PAIR_SCORES}
    SELECT drug_id AS drug, prot_id AS protein, label, checkpoint, seed, {r('x')} AS logit, {r('1 / (1 + exp(-x))')} AS prob
    FROM (SELECT *, 'full' AS checkpoint, 1 AS seed, a AS x FROM g UNION ALL SELECT *, 'half', 2, h FROM g)""")
def scored_pairs(spark, sf):
    return _predictions(spark, sf).per_model.select(
        "drug", "protein", "label", "checkpoint", "seed", rounded("rank_logit").alias("logit"),
        rounded("prob").alias("prob"))


class _Gated:
    """A plug-in that says more than two logits: how much the second half of the vectors adds, and a gate
    that is no number for half of the pairs."""

    name, seed, outputs = "gated", 5, ("drug_weight_ecfp", "drug_aux_gate")

    def pairs(self, d, p):
        half = d.shape[1] // 2
        first, second = (d[:, :half] * p[:, :half]).sum(axis=1), (d[:, half:] * p[:, half:]).sum(axis=1)
        return first + second, first, second, np.where(first > 0, first, np.nan)


class _Plain(_Gated):
    name, seed, outputs = "plain", 6, ("drug_weight_ecfp",)

    def pairs(self, d, p):
        first = super().pairs(d, p)[1]
        return first, -first, 2 * first


# 'gated' for viral proteins and 'plain' for human ones have one output in common; a third model has both
_WIDE = """g2 AS (SELECT *, CAST(prot_id AS BIGINT) % 2 = 1 AS virus FROM g),
    x AS (SELECT drug_id, prot_id, label, 'by-domain' AS checkpoint, CASE WHEN virus THEN a ELSE h END AS c, CASE WHEN virus THEN h ELSE -h END AS k,
                 CASE WHEN virus THEN a - h ELSE 2 * h END AS w, CAST(NULL AS DOUBLE) AS gate FROM g2
          UNION ALL SELECT drug_id, prot_id, label, 'gated', a, h, a - h, CASE WHEN h > 0 THEN h END FROM g2)"""


def _wide(spark, sf):
    drugs, proteins = drug_and_protein_banks(spark, sf)
    return predict(role(spark, sf, "messy_pairs"), drugs, proteins, [scoring.DomainModel("by-domain", _Plain(), _Gated()), _Gated()],
                   on_mixture="keep_hard")


@query("score_pairs_wide", f"""WITH {_PAIR_SCORES}, {_WIDE}
    SELECT drug_id AS drug, prot_id AS protein, label, checkpoint, {r('c')} AS cls_logit, {r('k')} AS rank_logit,
           {r('w')} AS drug_weight_ecfp, {r('gate')} AS drug_aux_gate FROM x""")
def scored_wide(spark, sf):
    """A model that depends on the protein's domain beside a plug-in with more outputs."""
    return _wide(spark, sf).per_model.select("drug", "protein", "label", "checkpoint", *[
        rounded(F.nanvl(c, F.lit(None).cast("double"))).alias(c) for c in ("cls_logit", "rank_logit", "drug_weight_ecfp", "drug_aux_gate")])


@query("ensemble_outputs", f"""WITH {_PAIR_SCORES}, {_WIDE}
    SELECT drug_id AS drug, prot_id AS protein, {r('avg(c)')} AS cls_logit_mean, {r('avg(w)')} AS drug_weight_ecfp_mean,
           {r('avg(gate)')} AS drug_aux_gate_mean FROM x GROUP BY ALL""")
def wide_ensemble(spark, sf):
    return _wide(spark, sf).ensemble.select("drug", "protein", *[
        rounded(c).alias(c) for c in ("cls_logit_mean", "drug_weight_ecfp_mean", "drug_aux_gate_mean")])


@query("finite_means_outputs", f"""WITH {_PAIR_SCORES}, {_WIDE}
    SELECT {r('avg(w)')} AS fusion_drug_weight_ecfp_mean, {r('avg(gate)')} AS fusion_drug_aux_gate_mean FROM x""")
def output_means(spark, sf):
    """Means of what the plug-ins say of themselves."""
    out = ranking.finite_means(_wide(spark, sf).per_model, ["drug_weight_ecfp", "drug_aux_gate"])
    return out.select(*[rounded(c).alias(c) for c in out.columns])


@query("predict_ensemble", f"""WITH {_PAIR_SCORES}
    SELECT drug_id AS drug, prot_id AS protein, label, {r('(a + h) / 2')} AS cls_logit_mean,
           {r('1 / (1 + exp(-(a + h) / 2))')} AS cls_prob_mean, {r('abs(a - h) / 2')} AS rank_logit_std FROM g""")
def predicted(spark, sf):
    return _predictions(spark, sf).ensemble.select(
        "drug", "protein", "label", *[rounded(c).alias(c) for c in ("cls_logit_mean", "cls_prob_mean", "rank_logit_std")])


@query("ensemble_align", f"""
    SELECT row_id, {r('avg(c)')} AS cls_logit_mean, {r('stddev_pop(c)')} AS cls_logit_std, {r('avg(k)')} AS rank_logit_mean,
           {r('stddev_pop(k)')} AS rank_logit_std, {r('1 / (1 + exp(-avg(c)))')} AS cls_prob_mean,
           {r('1 / (1 + exp(-avg(k)))')} AS rank_prob_mean
    FROM (SELECT row_id, cls_logit + m * (row_id % 7 - 3) / 10e0 AS c, rank_logit - m AS k
          FROM {{predictions}} AS p JOIN (VALUES (0), (1), (2)) AS v(m) ON TRUE) GROUP BY row_id""")
def aligned(spark, sf):
    shift = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("m")
    each = role(spark, sf, "predictions").select("*", shift).select(
        "row_id", (F.col("cls_logit") + F.col("m") * (F.col("row_id") % 7 - 3) / 10).alias("cls_logit"),
        (F.col("rank_logit") - F.col("m")).alias("rank_logit"))
    out = scoring.ensemble_align(each, ["row_id"], 3)
    return out.select("row_id", *[rounded(c).alias(c) for c in out.columns if c != "row_id"])


@query("require_single_record", "SELECT CAST(s_suppkey AS STRING) AS prot_id, s_name AS token_file FROM supplier")
def single_records(spark, sf):
    records = table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("string").alias("prot_id"), F.col("s_name").alias("protein_key"),
        F.col("s_name").alias("token_file"), F.length("s_name").alias("length"))
    return joins.require_single_record(joins.manifest_match(records, records)).select("prot_id", "token_file")


