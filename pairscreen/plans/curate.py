"""From a raw compound export to the drug, metadata and QC tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairscreen.functions.rules import (
    ALERT_FAMILIES, alert_detail, alert_flag, compound_rules, keep_final, property_status, range_rules)
from pairscreen.operators.joins import map_distinct
from pairscreen.operators.library import (
    choose_representatives, drug_table, failure_counts, library_summary, metadata_table, number_library, passing,
    representative_order, status_counts)
from pairscreen.session import materialize
from pairscreen.sources.sinks import report_dict, write_report, write_tables

# What a structure plug-in returns for each distinct SMILES.
STRUCTURE_SCHEMA = (
    "SMILES string, parsed boolean, standardized boolean, finalized boolean, n_components int, "
    "elements array<string>, alerts array<string>, SMILES_Std string, SMILES_ChargeAware string, "
    "MolWt double, HeavyAtoms double, LogP double, HBD double, HBA double, TPSA double, RotB double, QED double")
ALERT_COLUMNS = {"pains": "PAINS", "brenk": "Brenk"}


@dataclass
class CuratedLibrary:
    qc: DataFrame
    library: DataFrame
    prefilter_counts: DataFrame
    range_counts: DataFrame
    status_counts: DataFrame
    summary: DataFrame

    def report(self) -> dict[str, Any]:
        """Counts of every stage, nested as they arise."""
        return {
            "prefilter_counts": report_dict(self.prefilter_counts),
            "metadata_druglike_prefilter_counts": report_dict(self.range_counts),
            **report_dict(self.summary),
            "smiles_status_counts": {r["status"]: r["rows"] for r in self.status_counts.collect()}}

    def write(self, folder: str, fmt: str = "csv") -> None:
        """The drug, metadata and QC tables, and the report."""
        write_tables({"drug2id": self.drugs, "drug_metadata": self.metadata, "drug_qc": self.qc}, folder, fmt)
        write_report(self.qc.sparkSession, self.report(), f"{folder}/processing_summary")

    @property
    def drugs(self) -> DataFrame:
        return drug_table(self.library)

    @property
    def metadata(self) -> DataFrame:
        return metadata_table(self.library)


def standardize_structures(rows: DataFrame, structure_fn: Callable, mode: str = "standard",
                           allow_metals: bool = False, drop_alerts: bool = True) -> DataFrame:
    """QC table: every candidate row with properties, status and
    ``keep_final``; the plug-in runs once per distinct SMILES."""
    found = map_distinct(rows, "SMILES", structure_fn, STRUCTURE_SCHEMA)
    status = F.when(F.col("parsed").isNotNull(), property_status(mode, allow_metals, drop_alerts))
    alerts = {}
    for family in ALERT_FAMILIES:
        stem = ALERT_COLUMNS[family]
        alerts[f"{stem}_Hit"] = F.coalesce(alert_flag(F.col("alerts"), family), F.lit(0))
        alerts[f"{stem}_Detail"] = F.coalesce(alert_detail(F.col("alerts"), family), F.lit(""))
    return (
        found.withColumn("SMILES_Status", status).withColumns(alerts)
        # A rejected structure has no standard form.
        .withColumn("SMILES_Std", F.when(F.col("SMILES_Status") == "ok", F.col("SMILES_Std")).otherwise(""))
        .withColumn("keep_final", keep_final(F.col("SMILES_Status"), F.col("SMILES_Std")))
        .drop("parsed", "standardized", "finalized", "n_components", "elements", "alerts")
    )


def curate_library(raw: DataFrame, structure_fn: Callable, mode: str = "standard", allow_metals: bool = False,
                   drop_alerts: bool = True) -> CuratedLibrary:
    """Cheap filters first, then the structure plug-in on distinct survivors,
    then one representative per standard structure."""
    candidates = passing(raw, compound_rules())
    # The survivors are read three times below; the export is parsed for them once.
    rows = materialize(passing(candidates, range_rules(mode)), "candidates")
    qc = materialize(standardize_structures(rows, structure_fn, mode, allow_metals, drop_alerts), "qc")
    order = representative_order(*[F.col(c) for c in ("max_phase", "bioactivities", "targets", "name", "chembl_id")])
    library = number_library(choose_representatives(qc.filter("keep_final"), "SMILES_Std", order))
    return CuratedLibrary(
        qc=qc, library=library,
        prefilter_counts=failure_counts(raw, compound_rules(), "raw_rows", "prefilter_kept_rows"),
        range_counts=failure_counts(candidates, range_rules(mode), None, "metadata_prefilter_kept_rows",
                                    "metadata_prefilter_removed_rows"),
        status_counts=status_counts(qc), summary=library_summary(qc))
