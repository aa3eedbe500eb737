"""Curation of a compound library: cascades, representatives, ids, counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairscreen.functions.rules import Rule, first_failure
from pairscreen.functions.text import to_float
from pairscreen.operators.ordering import assign_dense_ids, first_per_key

# Fixed values ---------------------------------------------------------------
DRUG_TABLE = ("drug_id", "drug_key", "SMILES", "SMILES_Std", "SMILES_ChargeAware")
METADATA_TABLE = (
    "drug_id", "chembl_id", "drug_key", "SMILES", "SMILES_Std", "SMILES_ChargeAware", "inchi_key",
    "name", "max_phase", "targets", "bioactivities", "MolWt", "HeavyAtoms", "LogP", "HBD", "HBA",
    "TPSA", "RotB", "QED", "PAINS_Hit", "Brenk_Hit", "PAINS_Detail", "Brenk_Detail", "source_db",
)
# ----------------------------------------------------------------------------


def passing(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    return df.filter(first_failure(rules).isNull())


def failure_counts(df: DataFrame, rules: Sequence[Rule], total: str | None, kept: str,
                   removed: str | None = None) -> DataFrame:
    """One row: rows broken first by each rule, kept and removed rows."""
    reasons = df.select(first_failure(rules).alias("_reason"))
    cols: list[Column] = []
    if total:
        cols.append(F.count("*").alias(total))
    cols += [F.count_if(F.col("_reason") == name).alias(name) for name, _ in rules]
    if removed:
        cols.append(F.count_if(F.col("_reason").isNotNull()).alias(removed))
    cols.append(F.count_if(F.col("_reason").isNull()).alias(kept))
    return reasons.agg(*cols)


def representative_order(max_phase: Column, bioactivities: Column, targets: Column, name: Column,
                         source_id: Column) -> list[Column]:
    """Best-documented record first; unknown numbers rank below known ones."""
    number = lambda c: F.coalesce(to_float(c), F.lit(-1.0))
    return [number(max_phase).desc(), number(bioactivities).desc(), number(targets).desc(),
            (F.coalesce(name, F.lit("")) != "").cast("int").desc(), source_id.asc()]


def choose_representatives(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    return first_per_key(df, [key], order)


def number_library(reps: DataFrame, key: str = "SMILES_Std", source_db: str = "ChEMBL") -> DataFrame:
    """Dense ``drug_id`` in key order, the key as ``drug_key`` and the source."""
    return (
        assign_dense_ids(reps, key, "drug_id")
        .withColumn("drug_key", F.col(key)).withColumn("source_db", F.lit(source_db))
    )


def drug_table(library: DataFrame) -> DataFrame:
    return library.select(*DRUG_TABLE)


def metadata_table(library: DataFrame) -> DataFrame:
    return library.select(*[c for c in METADATA_TABLE if c in library.columns])


def status_counts(df: DataFrame, status: str = "SMILES_Status") -> DataFrame:
    named = F.coalesce(F.col(status), F.lit("missing_process_result"))
    return df.groupBy(named.alias("status")).agg(F.count("*").alias("rows"))


def library_summary(qc: DataFrame, raw_key: str = "SMILES", std_key: str = "SMILES_Std") -> DataFrame:
    """One row of counts over the QC table (which carries ``keep_final``).

    Rows are counted by key first, before the shuffle too, so distinct keys are
    plain rows of the last aggregate."""
    cell = lambda kind, key: F.struct(F.lit(kind).alias("kind"), F.col(key).alias("key"))
    cells = F.array_compact(F.array(cell("raw", raw_key), F.when(F.col("keep_final"), cell("std", std_key))))
    counted = qc.select(F.explode(cells).alias("c")).groupBy("c.kind", "c.key").agg(F.count("*").alias("n"))

    def rows(kind: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0))

    def keys(kind: str) -> Column:
        return F.count_if((F.col("kind") == kind) & F.col("key").isNotNull())

    return counted.agg(
        rows("raw").alias("candidate_rows_after_prefilter"), keys("raw").alias("unique_raw_smiles_processed"),
        rows("std").alias("rows_after_filter"), keys("std").alias("unique_drugs_after_dedup"),
        (rows("std") - keys("std")).alias("duplicate_rows_removed"))


def attach_constants(df: DataFrame, **values: object) -> DataFrame:
    """``df`` with one column for each value, the same in every row; a column that is
    there already is an error, not overwritten."""
    taken = {c.lower() for c in df.columns} & {c.lower() for c in values}
    if taken:
        raise ValueError(f"columns exist already: {sorted(taken)}")
    return df.select("*", *[F.lit(v).alias(name) for name, v in values.items()])


def invalid_count(df: DataFrame, valid: Column) -> DataFrame:
    return df.agg(F.count_if(~F.coalesce(valid, F.lit(False))).alias("invalid"))
