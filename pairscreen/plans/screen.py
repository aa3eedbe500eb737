"""Screen a library against targets: the best and worst K per target."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairscreen.operators.joins import (
    assert_same_ids, eligible_ids, manifest_match, require_single_record, select_targets, target_lookup)
from pairscreen.operators.scoring import (
    bottom_k_per_target, cross_score, screening_table, top_hits, with_library_columns)
from pairscreen.operators.sequences import center_crop, gather_tokens
from pairscreen.session import materialize
from pairscreen.sources.sinks import write_per_target, write_report, write_table


# Fixed values ---------------------------------------------------------------
SCORE_FORMULA = "rank_logit_mean - uncertainty_beta * rank_logit_std"
# The keys of the report in ``screen`` are fixed as well.
# ----------------------------------------------------------------------------


@dataclass
class ScreenResult:
    top: DataFrame
    bottom: DataFrame | None
    scores: DataFrame | None
    report: dict[str, Any]

    def write(self, folder: str, fmt: str = "parquet") -> None:
        """Lists by target, all scores if kept, and the report."""
        write_per_target(self.top, f"{folder}/top_{self.report['top_k']}", fmt=fmt)
        if self.bottom is not None:
            write_per_target(self.bottom, f"{folder}/bottom_{self.report['bottom_k']}", fmt=fmt)
        if self.scores is not None:
            write_table(self.scores, f"{folder}/ensemble_scores", fmt)
        write_report(self.top.sparkSession, self.report, f"{folder}/manifest")


def flag_eligible(bank: DataFrame, ids: DataFrame | None, drug_id: str = "drug_id") -> DataFrame:
    """Mark library rows that may become top hits."""
    if ids is None:
        return bank
    marked = ids.select(drug_id).distinct().withColumn("_ok", F.lit(True))
    return bank.join(marked, drug_id, "left").withColumn(
        "eligible", F.coalesce("_ok", F.lit(False))).drop("_ok")


def attach_tokens(targets: DataFrame, manifest: DataFrame, tokens: DataFrame, limit: int) -> DataFrame:
    """Targets with ``tokens``, the middle ``limit`` residue vectors of their one token record. Residues
    of other records are left out before they move; the match, one row a target, is written once."""
    match = materialize(require_single_record(manifest_match(targets, manifest)).select("prot_id", "protein_key", "token_file"), "match")
    wanted = tokens.join(match.select("token_file").distinct(), "token_file", "left_semi")
    cropped = center_crop(wanted, "token_file", "residue_idx", limit)
    found = match.join(gather_tokens(cropped, "token_file", "residue_idx"), "token_file", "left").drop("token_file")
    return targets.join(found, ["prot_id", "protein_key"], "left")


def screen(library: DataFrame, drugs: DataFrame, targets: DataFrame, proteins: DataFrame, models: Sequence,
           top_k: int = 1000, bottom_k: int = 0, beta: float = 0.0, cls_min_prob: float = 0.0,
           eligibility: DataFrame | None = None, eligibility_key: str = "drug_key", library_key: str = "drug_key",
           predicate: str | None = None, pdb_ids: Sequence[str] = (), keep_scores: bool = False,
           check_library: bool = True, write_once: bool = True, tokens: DataFrame | None = None,
           manifest: DataFrame | None = None, max_tokens: int = 1024) -> ScreenResult:
    """``library``: ``drug_id`` and descriptive columns; ``drugs``:
    ``drug_id, vec``; ``targets``: ``prot_id, protein_key, pdb_id``;
    ``proteins``: ``idx, prot_id, protein_key, vec``.

    Every pair is scored once. Unless all scores are kept, each task sends on
    only rows that can still make a list; those few (or, with
    ``keep_scores``, all) are written once, and everything else reads them.
    ``write_once=False`` is for callers that read one list once.

    Models that use residues need ``tokens`` (``token_file, residue_idx, vec``) and their ``manifest``
    (``prot_id, protein_key, token_file, length``): each target must match exactly one record, by key or id,
    and gets its middle ``max_tokens`` residues.
    """
    if check_library:
        assert_same_ids(library, drugs, "drug_id")
    chosen = target_lookup(select_targets(targets, pdb_ids), proteins)
    if tokens is not None:
        # Checks, blocks and the report read the targets again and again.
        chosen = materialize(attach_tokens(chosen, manifest, tokens, max_tokens), "targets")
    ids, n_eligible = None, None
    if eligibility is not None:
        ids = eligible_ids(eligibility, library, eligibility_key, library_key, predicate)
        n_eligible = ids.count()
        if not n_eligible:
            raise ValueError("none of the library's compounds may be listed: see eligibility and predicate")
    grid = cross_score(
        flag_eligible(drugs, ids), chosen, models, beta,
        top=None if keep_scores else top_k, bottom=None if keep_scores else bottom_k, cls_min_prob=cls_min_prob)
    scores = screening_table(grid, beta)
    if write_once:
        scores = materialize(scores, "scores")
    top = with_library_columns(top_hits(scores, top_k, cls_min_prob), library)
    bottom = with_library_columns(bottom_k_per_target(scores, bottom_k), library) if bottom_k else None
    report = {
        "rows": library.count() * chosen.count(), "pdb_ids": ",".join(pdb_ids),
        "checkpoints": [m.name for m in models], "top_k": top_k, "bottom_k": bottom_k, "uncertainty_beta": beta,
        "cls_min_prob": cls_min_prob, "eligibility_key_col": eligibility_key, "library_key_col": library_key,
        "eligibility_query": predicate, "eligible_top_drug_count": n_eligible, "score_formula": SCORE_FORMULA}
    return ScreenResult(top, bottom, scores if keep_scores else None, report)
