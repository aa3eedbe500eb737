"""Residues in scoring: stitched windows of documents stand for the residues of their ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import query, r, role, rounded, table
from catalog.features import _TOKENS, stitched_tokens
from catalog.scoring import TOP, library_bank, library_table, protein_bank
from pairscreen.operators import scoring, sequences
from pairscreen.plans.screen import attach_tokens, screen
from pairscreen.session import materialize

LIMIT, SCALE, BETA = 48, 0.05, 0.5


def models():
    return [scoring.dot_model("full", 64, seed=1), scoring.ResidueModel("residues", SCALE, seed=2)]


def residues(spark, sf):
    return stitched_tokens(spark, sf).withColumnRenamed("doc_id", "token_file")


def records(found):
    """A token record for each document, under its id."""
    return sequences.token_manifest(found, ["token_file"]).select(
        F.col("token_file").cast("string").alias("prot_id"), F.concat(F.lit("doc"), "token_file").alias("protein_key"),
        "token_file", "length")


_RESIDUES = f"""{_TOKENS}, l AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
    w AS (SELECT doc_id, n, unnest(CASE WHEN n <= 64 THEN [0] ELSE
          list_distinct(list_append(range(0, n - 64 + 1, 32), n - 64)) END) AS start FROM l),
    st AS (SELECT doc_id, pos, n, avg(a + start) AS a, avg(b) AS b, avg((start + pos - start) % 7) AS c
           FROM t JOIN w USING (doc_id) WHERE pos >= start AND pos < start + 64 GROUP BY ALL),
    cr AS (SELECT doc_id, pos, a, b, c FROM st
           WHERE n <= {LIMIT} OR (pos >= (n - {LIMIT}) // 2 AND pos < (n - {LIMIT}) // 2 + {LIMIT})),
    lib AS (SELECT vec_id AS drug_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"""
_MATCH = f"{SCALE} * (lib.v[1] * cr.a + lib.v[2] * cr.b + lib.v[3] * cr.c)"


@query("attach_tokens", f"""WITH {_RESIDUES} SELECT protein_key, count(*) AS length, CAST(3 AS INTEGER) AS width,
        {r('avg(a)')} AS a, {r('avg(b)')} AS b, {r('avg(c)')} AS c
    FROM {{targets}} AS g JOIN cr ON cr.doc_id = CAST(g.prot_id AS BIGINT) GROUP BY protein_key""")
def attached(spark, sf):
    """Middle residues of each target's one record."""
    tokens = residues(spark, sf)
    found = attach_tokens(role(spark, sf, "targets"), records(tokens), tokens, LIMIT)
    each = found.select("protein_key", F.size("tokens").cast("bigint").alias("length"),
                        F.size(F.get("tokens", F.lit(0))).alias("width"), F.explode("tokens").alias("v"))
    return each.groupBy("protein_key", "length", "width").agg(
        *[rounded(F.avg(F.get("v", F.lit(i)))).alias(n) for i, n in enumerate("abc")])


@query("screen_tokens", f"""WITH {_RESIDUES},
    tgt AS (SELECT g.protein_key, g.pdb_id, l.drug_id AS doc_id, l.v AS tv
            FROM {{targets}} AS g JOIN lib AS l ON l.drug_id = CAST(g.prot_id AS BIGINT)),
    best AS (SELECT lib.drug_id, protein_key, max({_MATCH}) AS hi, avg({_MATCH}) AS mean
             FROM tgt JOIN cr USING (doc_id), lib GROUP BY ALL),
    f AS (SELECT b.drug_id, b.protein_key, pdb_id, (list_inner_product(lib.v, tv) + hi) / 2 AS c,
                 (list_inner_product(lib.v, tv) + mean) / 2 AS m, abs(list_inner_product(lib.v, tv) - mean) / 2 AS s
          FROM best AS b JOIN lib USING (drug_id) JOIN tgt USING (protein_key))
    SELECT drug_id, protein_key, pdb_id, {r('c')} AS cls_logit_mean, {r('m')} AS rank_logit_mean,
           {r('m - 0.5 * s')} AS final_score,
           CAST(row_number() OVER (PARTITION BY protein_key ORDER BY m - 0.5 * s DESC, drug_id DESC) AS INTEGER) AS rank
    FROM f QUALIFY rank <= {TOP}""")
def screened_with_tokens(spark, sf):
    """A model of residues beside one of vectors, best K."""
    tokens = residues(spark, sf)
    found = screen(
        library_table(spark, sf), library_bank(spark, sf), role(spark, sf, "targets"), protein_bank(spark, sf), models(),
        top_k=TOP, beta=BETA, tokens=tokens, manifest=records(tokens), max_tokens=LIMIT)
    return found.top.select("drug_id", "protein_key", "pdb_id", *[
        rounded(c).alias(c) for c in ("cls_logit_mean", "rank_logit_mean", "final_score")], "rank")


@query("score_pairs_tokens", f"""WITH {_RESIDUES},
    p AS (SELECT DISTINCT l_partkey AS d, l_suppkey AS q FROM lineitem),
    best AS (SELECT d, q, max({_MATCH}) AS hi, avg({_MATCH}) AS mean
             FROM p JOIN lib ON lib.drug_id = d JOIN cr ON cr.doc_id = q GROUP BY ALL)
    SELECT d AS drug_idx, q AS prot_idx, {r('(list_inner_product(x.v, y.v) + hi) / 2')} AS cls_logit_mean,
           {r('(list_inner_product(x.v, y.v) + mean) / 2')} AS rank_logit_mean
    FROM best JOIN lib AS x ON x.drug_id = d JOIN lib AS y ON y.drug_id = q""")
def pairs_with_tokens(spark, sf):
    """Labelled pairs whose protein has residues; residues meet chunks of a protein's pairs."""
    bank = table(spark, sf, "embeddings").select(F.col("vec_id").alias("idx"), F.col("embedding").alias("vec"))
    pairs = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("drug_idx"), F.col("l_suppkey").alias("prot_idx")).distinct()
    pairs = materialize(pairs, "pairs")
    paired = pairs.select(F.col("prot_idx").alias("token_file")).distinct()
    wanted = residues(spark, sf).join(materialize(paired, "paired"), "token_file", "left_semi")
    cropped = sequences.center_crop(wanted, "token_file", "residue_idx", LIMIT)
    tokens = sequences.gather_tokens(cropped, "token_file", "residue_idx").withColumnRenamed("token_file", "idx")
    scored = scoring.ensemble_stats(scoring.score_pairs(pairs, bank, bank, models(), tokens=tokens))
    return scored.select("drug_idx", "prot_idx", *[rounded(c).alias(c) for c in ("cls_logit_mean", "rank_logit_mean")])
