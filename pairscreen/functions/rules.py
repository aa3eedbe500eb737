"""Auditable rule cascades: every rejected row names the first rule it broke."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairscreen.functions.text import FALSE_WORDS, clean_text, parse_number

# Fixed values ---------------------------------------------------------------
PROFILES = {
    "standard": {"mw": (120, 850), "heavy": (8, 70), "logp": (-2, 8), "hbd": (None, 8),
                 "hba": (None, 15), "tpsa": (None, 220), "rotb": (None, 20)},
    "relaxed": {"mw": (80, 1200), "heavy": (4, 100), "logp": (-3, 10), "hbd": (None, 12),
                "hba": (None, 20), "tpsa": (None, 300), "rotb": (None, 30)},
    "none": None,
}
REASON_STEMS = {"mw": "mw", "heavy": "heavy_atom", "logp": "logp", "hbd": "hbd",
                "hba": "hba", "tpsa": "tpsa", "rotb": "rotb"}
EXPORT_COLUMNS = {"mw": "chembl_mw", "heavy": "chembl_heavy_atoms", "logp": "chembl_alogp",
                  "hbd": "chembl_hbd", "hba": "chembl_hba", "tpsa": "chembl_tpsa", "rotb": "chembl_rotb"}
PROPERTY_COLUMNS = {"mw": "MolWt", "heavy": "HeavyAtoms", "logp": "LogP", "hbd": "HBD",
                    "hba": "HBA", "tpsa": "TPSA", "rotb": "RotB"}
ORGANIC_ELEMENTS = ("H", "C", "N", "O", "F", "P", "S", "Cl", "Br", "I", "B", "Si", "Se")
METAL_ELEMENTS = ("Li", "Na", "K", "Mg", "Ca", "Mn", "Fe", "Co", "Ni", "Cu", "Zn", "Pt", "Pd", "Ag", "Au")
ALERT_FAMILIES = ("pains", "brenk")
INORGANIC_WORDS = ("1", "True", "true")
# ----------------------------------------------------------------------------

Rule = tuple[str, Column]


def first_failure(rules: Sequence[Rule]) -> Column:
    """Name of the first rule that does not hold, NULL when all hold.

    A rule whose condition is NULL counts as broken, so rules that accept
    unknown values must say so.
    """
    if not rules:
        return F.lit(None).cast("string")
    return F.coalesce(*[
        F.when(~F.coalesce(holds, F.lit(False)), F.lit(reason)) for reason, holds in rules
    ])


def filter_profile(mode: str) -> dict[str, tuple[float | None, float | None]]:
    """Bounds per property; empty for ``none``."""
    if mode not in PROFILES:
        raise ValueError(f"filter profile must be one of: {', '.join(PROFILES)}")
    return dict(PROFILES[mode] or {})


def within(value: Column, low: float | None, high: float | None) -> Column:
    """NULL for an unknown value."""
    if low is None:
        return value <= high
    return value >= low if high is None else value.between(low, high)


def compound_rules(
    smiles: str = "SMILES", kind: str = "type", structure: str = "structure_type",
    withdrawn: str = "withdrawn_flag", inorganic: str = "inorganic_flag",
) -> list[Rule]:
    """Which export rows are small-molecule structures worth standardising.
    Columns are cleaned text, as the scan gives them."""
    return [
        ("missing_smiles", F.col(smiles) != ""),
        ("non_small_molecule", F.lower(F.col(kind)) == "small molecule"),
        ("non_mol_structure", F.upper(F.col(structure)) == "MOL"),
        ("withdrawn", F.lower(F.col(withdrawn)).isin(*FALSE_WORDS)),
        ("inorganic", ~F.col(inorganic).isin(*INORGANIC_WORDS)),
    ]


def range_rules(mode: str, columns: dict[str, str] = EXPORT_COLUMNS) -> list[Rule]:
    """Bounds on source-reported properties; unknown values pass."""
    rules = []
    for name, (low, high) in filter_profile(mode).items():
        known = within(parse_number(F.col(columns[name])), low, high)
        rules.append((f"{REASON_STEMS[name]}_prefilter_out_of_range", F.coalesce(known, F.lit(True))))
    return rules


def element_allowlist(elements: Column, allow_metals: bool = False) -> Column:
    allowed = ORGANIC_ELEMENTS + (METAL_ELEMENTS if allow_metals else ())
    return F.size(F.array_except(elements, F.array(*[F.lit(e) for e in allowed]))) == 0


def alert_hits(names: Column, family: str) -> Column:
    return F.filter(names, lambda n: F.lower(n).contains(family))


def alert_flag(names: Column, family: str) -> Column:
    return (F.size(alert_hits(names, family)) > 0).cast("int")


def alert_detail(names: Column, family: str) -> Column:
    return F.array_join(alert_hits(names, family), "; ")


def property_rules(
    mode: str, allow_metals: bool = False, drop_alerts: bool = True,
    columns: dict[str, str] = PROPERTY_COLUMNS,
) -> list[Rule]:
    """Cascade over computed properties. Expects the columns a structure
    plug-in supplies: ``SMILES, parsed, standardized, finalized, n_components,
    elements, alerts, SMILES_Std`` and the property columns."""
    rules: list[Rule] = [
        ("empty", clean_text(F.col("SMILES")) != ""),
        ("parse_fail", F.col("parsed")),
        ("standardize_fail", F.col("standardized")),
        ("variant_finalize_fail", F.col("finalized")),
        ("multi_component", F.col("n_components") <= 1),
        ("bad_element", element_allowlist(F.col("elements"), allow_metals)),
    ]
    for name, (low, high) in filter_profile(mode).items():
        value = F.col(columns[name])
        unknown = value.isNull() | F.isnan(value.cast("double"))
        rules.append((f"{REASON_STEMS[name]}_out_of_range", unknown | within(value, low, high)))
    if drop_alerts:
        hit = F.lit(False)
        for family in ALERT_FAMILIES:
            hit = hit | (alert_flag(F.col("alerts"), family) == 1)
        rules.append(("structural_alert", ~hit))
    rules.append(("std_variant_fail", F.coalesce(F.col("SMILES_Std"), F.lit("")) != ""))
    return rules


def property_status(mode: str, allow_metals: bool = False, drop_alerts: bool = True,
                    columns: dict[str, str] = PROPERTY_COLUMNS) -> Column:
    return F.coalesce(first_failure(property_rules(mode, allow_metals, drop_alerts, columns)), F.lit("ok"))


def keep_final(status: Column, std_key: Column) -> Column:
    return F.coalesce((status == "ok") & (std_key != ""), F.lit(False))
