"""Score labelled pairs with several models and combine them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairscreen.functions.text import drug_name, infer_domain, protein_name
from pairscreen.operators.joins import attach_features, matched
from pairscreen.operators.pairs import (
    PAIR_COLUMNS, clean_pairs, domain_filter, label_filter, require_columns, with_row_id)
from pairscreen.operators.scoring import ensemble_stats, prediction_table, score_pairs
from pairscreen.session import Scratch, materialize, release_shuffles
from pairscreen.sources.scans import bank_index


@dataclass
class Predictions:
    attached: DataFrame
    per_model: DataFrame
    ensemble: DataFrame


def prepare_pairs(pairs: DataFrame, drugs: DataFrame, proteins: DataFrame, label_mode: str = "binary",
                  domain: str | None = None, on_mixture: str = "error", row_id: str = "row_id",
                  scratch: Scratch | None = None) -> DataFrame:
    """Clean, filter and look pairs up in both banks; misses keep a NULL
    index. Tables without all four pair columns skip the cleaning.

    Cleaned rows are written once, as the lookups scan them several times. With ``scratch`` they are its table ``pairs``, to be
    dropped when the result is written, and the shuffles of the cleaning are given up before the lookups.
    """
    require_columns(pairs, ["label"])
    rows = with_row_id(pairs, row_id)
    if all(c in rows.columns for c in PAIR_COLUMNS):
        extra = [c for c in rows.columns if c not in (*PAIR_COLUMNS, row_id)]
        rows = clean_pairs(rows, row_id, on_mixture, carry=extra)
    if domain:
        rows = domain_filter(rows, domain)
    rows = label_filter(rows, label_mode)
    if scratch is None:
        rows = materialize(rows, "pairs")
    else:
        rows = scratch.table("pairs", rows)
        release_shuffles(rows.sparkSession)
    attached = attach_features(rows, bank_index(drugs), bank_index(proteins))
    return attached.withColumns({
        "drug": drug_name(rows), "protein": protein_name(rows), "domain_id": infer_domain(rows)})


def predict(pairs: DataFrame, drugs: DataFrame, proteins: DataFrame, models: Sequence, label_mode: str = "binary",
            domain: str | None = None, on_mixture: str = "error", row_id: str = "row_id",
            write_once: bool = True) -> Predictions:
    """Per-model and ensemble predictions keyed by ``row_id``; scoring runs
    once for both tables."""
    attached = materialize(
        prepare_pairs(pairs, drugs, proteins, label_mode, domain, on_mixture, row_id), "attached")
    kept = matched(attached).select(row_id, "drug", "protein", "label", "domain_id", "drug_idx", "prot_idx")
    scored = score_pairs(kept, drugs, proteins, models)
    if write_once:
        scored = materialize(scored, "scored-pairs")
    if scored.isEmpty():
        raise ValueError("every pair lacks a drug or a protein vector")
    narrow = scored.drop("drug_idx", "prot_idx", "domain_id")
    return Predictions(attached, prediction_table(narrow, models), ensemble_stats(narrow))


def labelled_scores(predictions: DataFrame) -> DataFrame:
    """Ensemble predictions in the shape the reports read."""
    return predictions.select(
        "row_id", "drug", "protein", "label",
        F.col("cls_logit_mean").alias("cls_logit"), F.col("cls_prob_mean").alias("cls_prob"),
        F.col("rank_logit_mean").alias("rank_logit"), F.col("rank_prob_mean").alias("rank_prob"))
