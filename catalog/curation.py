"""Compound exports, rule cascades, representatives, sequences' text rules."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from catalog.base import query, role, table
from pairscreen.functions import rules
from pairscreen.functions.text import clean_text, false_ok, safe_filename, to_float
from pairscreen.operators import joins, library
from pairscreen.plans.curate import curate_library, standardize_structures
from pairscreen.session import scratch_path
from pairscreen.sources import scans, sinks

_FIELDS = list(scans.EXPORT_COLUMNS.values())


def _clean(c: str) -> str:
    return f"CASE WHEN lower(trim({c})) IN ('nan', 'none', 'null') THEN '' ELSE COALESCE(trim({c}), '') END"


_CLEANED = f"SELECT p_partkey, {', '.join(f'{_clean(c)} AS {c}' for c in _FIELDS)} FROM {{compounds}} AS c"


def _cleaned(spark, sf):
    return role(spark, sf, "compounds").select(*[clean_text(F.col(c)).alias(c) for c in _FIELDS])


# -- scan --------------------------------------------------------------------------

@query("scan_compounds", f"SELECT {', '.join(_FIELDS)} FROM ({_CLEANED})")
def scan_compounds(spark, sf):
    """Writes an export, with surplus cells on some lines and missing ones on
    others, and reads it back."""
    headers = {v: k for k, v in scans.EXPORT_COLUMNS.items()}
    df = role(spark, sf, "compounds")
    quoted = [F.concat(F.lit('"'), F.coalesce(c, F.lit("")), F.lit('"')) for c in _FIELDS]
    surplus = F.when(F.col("p_partkey") % 4 == 0, ';"surplus";"cells"').otherwise("")
    lines = df.select(F.concat(F.concat_ws(";", *quoted), surplus).alias("value"))
    path = scratch_path(spark, "export")
    lines.write.text(path)
    # Written headerless by many tasks: the column list is given to the scan.
    return scans.scan_compounds(spark, path, [headers[c] for c in _FIELDS])


_BROKEN = "name || chr(10) || '\"quoted\"; ' || chr(10) || 'C' || CAST(p_partkey AS STRING)"


@query("scan_compounds_line_breaks", f"""SELECT {', '.join('n AS name' if c == 'name' else c for c in _FIELDS)} FROM (
    SELECT *, CASE WHEN p_partkey % 3 = 0 THEN trim({_BROKEN}, ' ' || chr(10)) ELSE name END AS n FROM ({_CLEANED}))""")
def scan_broken_lines(spark, sf):
    """The same export with line breaks, quotes and separators inside cells."""
    headers = {v: k for k, v in scans.EXPORT_COLUMNS.items()}
    df = role(spark, sf, "compounds").withColumn("name", F.when(F.col("p_partkey") % 3 == 0, F.concat(
        F.when(F.trim("name") == "", "").otherwise(F.trim("name")), F.lit('\n"quoted"; \nC'),
        F.col("p_partkey").cast("string"))).otherwise(F.col("name")))
    quoted = [F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in _FIELDS]
    path = scratch_path(spark, "export")
    df.select(F.concat_ws(";", *quoted).alias("value")).write.text(path)
    return scans.scan_compounds(spark, path, [headers[c] for c in _FIELDS], line_breaks=True)


@query("clean_text", f"SELECT p_partkey, {_clean('inchi_key')} AS inchi_key, {_clean('name')} AS name, "
                     f"{_clean('max_phase')} AS max_phase FROM {{compounds}} AS c")
def cleaned(spark, sf):
    return role(spark, sf, "compounds").select(
        "p_partkey", *[clean_text(F.col(c)).alias(c) for c in ("inchi_key", "name", "max_phase")])


@query("to_float", "SELECT p_partkey, TRY_CAST(NULLIF(max_phase, 'None') AS DOUBLE) AS max_phase, "
                   "TRY_CAST(chembl_mw AS DOUBLE) AS mw FROM {compounds} AS c")
def floats(spark, sf):
    return role(spark, sf, "compounds").select(
        "p_partkey", to_float(F.col("max_phase")).alias("max_phase"), to_float(F.col("chembl_mw")).alias("mw"))


@query("false_ok", "SELECT p_partkey, lower(withdrawn_flag) IN ('false', '0', 'no', 'n', '') AS ok "
                   "FROM {compounds} AS c")
def flags(spark, sf):
    return role(spark, sf, "compounds").select("p_partkey", false_ok(F.col("withdrawn_flag")).alias("ok"))


@query("safe_filename", "SELECT protein_key, replace(protein_key, '::', '_') AS safe FROM {targets} AS t")
def safe(spark, sf):
    return role(spark, sf, "targets").select("protein_key", safe_filename(F.col("protein_key")).alias("safe"))


@query("attach_constant", "SELECT p_partkey, 'ChEMBL' AS source_db, 7 AS seed FROM part")
def constants(spark, sf):
    return library.attach_constants(table(spark, sf, "part").select("p_partkey"), source_db="ChEMBL", seed=7)


# -- cascades ------------------------------------------------------------------------

_PREFILTER = """CASE WHEN SMILES = '' THEN 'missing_smiles' WHEN lower(type) <> 'small molecule' THEN 'non_small_molecule'
    WHEN upper(structure_type) <> 'MOL' THEN 'non_mol_structure'
    WHEN lower(withdrawn_flag) NOT IN ('false', '0', 'no', 'n', '') THEN 'withdrawn'
    WHEN inorganic_flag IN ('1', 'True', 'true') THEN 'inorganic' ELSE 'kept' END"""
_PREFILTER_NAMES = ("missing_smiles", "non_small_molecule", "non_mol_structure", "withdrawn", "inorganic")


@query("prefilter_compounds", f"""
    WITH f AS (SELECT {_PREFILTER} AS reason FROM ({_CLEANED}))
    SELECT count(*) AS raw_rows, {', '.join(f"count(*) FILTER (reason = '{n}') AS {n}" for n in _PREFILTER_NAMES)},
           count(*) FILTER (reason = 'kept') AS prefilter_kept_rows FROM f""")
def prefilter(spark, sf):
    return library.failure_counts(_cleaned(spark, sf), rules.compound_rules(), "raw_rows", "prefilter_kept_rows")


def _range_reason(mode: str, columns: dict[str, str], suffix: str, number: str) -> str:
    cases = []
    for name, (low, high) in rules.filter_profile(mode).items():
        value = number.format(c=columns[name])
        parts = [f"{value} < {low}"] if low is not None else []
        parts.append(f"{value} > {high}")
        cases.append(f"WHEN {' OR '.join(parts)} THEN '{rules.REASON_STEMS[name]}{suffix}'")
    return " ".join(cases)


def _range_sql(mode: str) -> str:
    reason = _range_reason(mode, rules.EXPORT_COLUMNS, "_prefilter_out_of_range", "TRY_CAST(NULLIF({c}, 'NaN') AS DOUBLE)")
    names = [f"{rules.REASON_STEMS[n]}_prefilter_out_of_range" for n in rules.filter_profile(mode)]
    return f"""WITH f AS (SELECT CASE {reason} ELSE 'kept' END AS reason FROM {{compounds}} AS c)
        SELECT {', '.join(f"count(*) FILTER (reason = '{n}') AS {n}" for n in names)},
               count(*) FILTER (reason <> 'kept') AS removed, count(*) FILTER (reason = 'kept') AS kept FROM f"""


@query("range_prefilter", _range_sql("standard"))
def range_standard(spark, sf):
    return library.failure_counts(role(spark, sf, "compounds"), rules.range_rules("standard"), None, "kept", "removed")


@query("range_prefilter_relaxed", _range_sql("relaxed"))
def range_relaxed(spark, sf):
    return library.failure_counts(role(spark, sf, "compounds"), rules.range_rules("relaxed"), None, "kept", "removed")


@query("filter_profile", f"""
    SELECT 'standard' AS profile, count(*) FILTER (s = '') AS kept FROM (SELECT CASE
        {_range_reason('standard', rules.EXPORT_COLUMNS, '', "TRY_CAST(NULLIF({c}, 'NaN') AS DOUBLE)")} ELSE '' END AS s
        FROM {{compounds}} AS c)
    UNION ALL SELECT 'relaxed', count(*) FILTER (s = '') FROM (SELECT CASE
        {_range_reason('relaxed', rules.EXPORT_COLUMNS, '', "TRY_CAST(NULLIF({c}, 'NaN') AS DOUBLE)")} ELSE '' END AS s
        FROM {{compounds}} AS c)
    UNION ALL SELECT 'none', count(*) FROM {{compounds}} AS c""")
def profiles(spark, sf):
    df = role(spark, sf, "compounds")
    return df.agg(*[F.count_if(rules.first_failure(rules.range_rules(m)).isNull()).alias(m) for m in rules.PROFILES]
                  ).unpivot([], list(rules.PROFILES), "profile", "kept")


def _structures(spark, sf):
    return role(spark, sf, "structures").withColumns({
        "elements": F.split("element_list", ","), "alerts": F.split("alert_list", ",")})


def _status(drop_alerts: bool, metals: bool) -> str:
    allowed = "'C,H,Cl', 'C,Zn'" if metals else "'C,H,Cl'"
    alert = ("WHEN lower(alert_list) LIKE '%pains%' OR lower(alert_list) LIKE '%brenk%' THEN 'structural_alert'"
             if drop_alerts else "")
    ranges = _range_reason("standard", rules.PROPERTY_COLUMNS, "_out_of_range", "NULLIF({c}, CAST('NaN' AS DOUBLE))")
    return f"""CASE WHEN trim(SMILES) = '' THEN 'empty' WHEN NOT parsed THEN 'parse_fail'
        WHEN NOT standardized THEN 'standardize_fail' WHEN NOT finalized THEN 'variant_finalize_fail'
        WHEN n_components > 1 THEN 'multi_component' WHEN element_list NOT IN ({allowed}) THEN 'bad_element'
        {ranges} {alert} WHEN SMILES_Std = '' THEN 'std_variant_fail' ELSE 'ok' END"""


@query("property_status", f"SELECT p_partkey, {_status(True, False)} AS status FROM {{structures}} AS s")
def status(spark, sf):
    return _structures(spark, sf).select("p_partkey", rules.property_status("standard").alias("status"))


@query("status_counts", f"SELECT status, count(*) AS rows FROM (SELECT CASE WHEN p_partkey % 8 = 0 THEN "
       f"'missing_process_result' ELSE {_status(False, True)} END AS status FROM {{structures}} AS s) GROUP BY status")
def counts(spark, sf):
    named = rules.property_status("standard", allow_metals=True, drop_alerts=False)
    df = _structures(spark, sf).withColumn("SMILES_Status", F.when(F.col("p_partkey") % 8 != 0, named))
    return library.status_counts(df)


@query("element_allowlist", "SELECT p_partkey, element_list = 'C,H,Cl' AS organic, element_list <> 'C,N,U' "
                            "AS with_metals FROM {structures} AS s")
def elements(spark, sf):
    return _structures(spark, sf).select(
        "p_partkey", rules.element_allowlist(F.col("elements")).alias("organic"),
        rules.element_allowlist(F.col("elements"), allow_metals=True).alias("with_metals"))


@query("alert_filter", """
    SELECT p_partkey, CAST(alert_list LIKE '%PAINS%' AS INTEGER) AS pains_hit,
           CAST(lower(alert_list) LIKE '%brenk%' AS INTEGER) AS brenk_hit,
           CASE WHEN alert_list LIKE '%PAINS%' THEN 'PAINS_A anil' ELSE '' END AS pains_detail,
           CASE WHEN alert_list LIKE '%Brenk%' THEN 'Brenk thiol' WHEN alert_list LIKE '%brenk%' THEN alert_list
                ELSE '' END AS brenk_detail FROM {structures} AS s""")
def alerts(spark, sf):
    names = F.col("alerts")
    return _structures(spark, sf).select("p_partkey", *[
        fn(names, f).alias(f"{f}_{what}") for f in rules.ALERT_FAMILIES
        for what, fn in (("hit", rules.alert_flag), ("detail", rules.alert_detail))])


@query("keep_final", f"SELECT p_partkey, SMILES_Std FROM (SELECT *, {_status(True, True)} AS st "
                     "FROM {structures} AS s) WHERE st = 'ok' AND SMILES_Std <> ''")
def kept(spark, sf):
    df = _structures(spark, sf)
    state = rules.property_status("standard", allow_metals=True)
    return df.filter(rules.keep_final(state, F.col("SMILES_Std"))).select("p_partkey", "SMILES_Std")


@query("invalid_count", "SELECT count(*) FILTER (NOT parsed) AS invalid FROM {structures} AS s")
def invalid(spark, sf):
    return library.invalid_count(_structures(spark, sf), F.col("parsed"))


# -- representatives --------------------------------------------------------------------

@query("choose_representatives", """
    SELECT p_name, p_partkey FROM (SELECT p.p_name, c.p_partkey, row_number() OVER (PARTITION BY p.p_name ORDER BY
        COALESCE(TRY_CAST(max_phase AS DOUBLE), -1) DESC, COALESCE(TRY_CAST(bioactivities AS DOUBLE), -1) DESC,
        COALESCE(TRY_CAST(targets AS DOUBLE), -1) DESC, CAST(trim(name) <> '' AS INT) DESC, chembl_id) AS k
        FROM {compounds} AS c JOIN part AS p USING (p_partkey)) WHERE k = 1""")
def representatives(spark, sf):
    df = role(spark, sf, "compounds").join(table(spark, sf, "part").select("p_partkey", "p_name"), "p_partkey")
    order = library.representative_order(
        F.col("max_phase"), F.col("bioactivities"), F.col("targets"), clean_text(F.col("name")), F.col("chembl_id"))
    return library.choose_representatives(df, "p_name", order).select("p_name", "p_partkey")


# -- a stand-in for the structure plug-in: properties read off the text -----------------------

def _describe(batches):
    for pdf in batches:
        s = pdf["SMILES"]
        n = s.str.len()
        yield pd.DataFrame({
            "SMILES": s, "parsed": ~s.str.startswith("blue"), "standardized": True, "finalized": True,
            "n_components": s.str.contains("anvil").astype("int32") + 1,
            "elements": [["C", "U"] if t.startswith("old") else ["C", "N"] for t in s],
            "alerts": [["pains x"] if t.endswith("7") else [] for t in s],
            "SMILES_Std": s.str.split("-").str[0].str.upper(), "SMILES_ChargeAware": s,
            "MolWt": n * 20.0, "HeavyAtoms": n * 1.0, "LogP": 1.0, "HBD": 1.0, "HBA": 1.0, "TPSA": 10.0, "RotB": 1.0,
            "QED": 0.5})


_CURATED = f"""
    kept AS (SELECT * FROM (SELECT *, {_PREFILTER} AS pre, CASE {_range_reason('standard', rules.EXPORT_COLUMNS, '',
             "TRY_CAST({c} AS DOUBLE)")} ELSE '' END AS rng FROM ({_CLEANED})) WHERE pre = 'kept' AND rng = ''),
    qc AS (SELECT *, CASE WHEN SMILES LIKE 'blue%' THEN 'parse_fail' WHEN SMILES LIKE '%anvil%' THEN 'multi_component'
             WHEN SMILES LIKE 'old%' THEN 'bad_element' WHEN length(SMILES) * 20 < 120 THEN 'mw_out_of_range'
             WHEN length(SMILES) < 8 THEN 'heavy_atom_out_of_range' WHEN SMILES LIKE '%7' THEN 'structural_alert'
             ELSE 'ok' END AS st, upper(split_part(SMILES, '-', 1)) AS std FROM kept)"""


@query("curate_library", f"""
    WITH {_CURATED}, best AS (SELECT *, row_number() OVER (PARTITION BY std ORDER BY
        COALESCE(TRY_CAST(max_phase AS DOUBLE), -1) DESC, COALESCE(TRY_CAST(bioactivities AS DOUBLE), -1) DESC,
        COALESCE(TRY_CAST(targets AS DOUBLE), -1) DESC, CAST(name <> '' AS INT) DESC, chembl_id) AS k
        FROM qc WHERE st = 'ok')
    SELECT CAST(row_number() OVER (ORDER BY std) - 1 AS BIGINT) AS drug_id, std AS drug_key, SMILES,
           std AS SMILES_Std, SMILES AS SMILES_ChargeAware, chembl_id, 'ChEMBL' AS source_db FROM best WHERE k = 1""")
def curated(spark, sf):
    out = curate_library(_cleaned(spark, sf), _describe).library
    return out.select("drug_id", "drug_key", "SMILES", "SMILES_Std", "SMILES_ChargeAware", "chembl_id", "source_db")


def _qc(spark, sf):
    raw = _cleaned(spark, sf)
    rows = library.passing(library.passing(raw, rules.compound_rules()), rules.range_rules("standard"))
    return standardize_structures(rows, _describe)


@query("library_summary", f"""
    WITH {_CURATED} SELECT count(*) AS candidate_rows_after_prefilter, count(DISTINCT SMILES) AS
        unique_raw_smiles_processed, count(*) FILTER (st = 'ok') AS rows_after_filter,
        count(DISTINCT std) FILTER (st = 'ok') AS unique_drugs_after_dedup,
        count(*) FILTER (st = 'ok') - count(DISTINCT std) FILTER (st = 'ok') AS duplicate_rows_removed FROM qc""")
def summary(spark, sf):
    return library.library_summary(_qc(spark, sf))


@query("map_distinct", """
    SELECT p_partkey, p_name, CAST(length(regexp_replace(p_name, '[^aeiou]', '', 'g')) AS BIGINT) AS vowels FROM part""")
def vowels(spark, sf):
    def count(batches):
        for pdf in batches:
            yield pd.DataFrame({"p_name": pdf["p_name"], "vowels": pdf["p_name"].str.count("[aeiou]")})

    parts = table(spark, sf, "part").select("p_partkey", "p_name")
    return joins.map_distinct(parts, "p_name", count, "p_name string, vowels long")


@query("write_tables", f"""
    WITH {_CURATED}, best AS (SELECT std, SMILES, row_number() OVER (PARTITION BY std ORDER BY
        COALESCE(TRY_CAST(max_phase AS DOUBLE), -1) DESC, COALESCE(TRY_CAST(bioactivities AS DOUBLE), -1) DESC,
        COALESCE(TRY_CAST(targets AS DOUBLE), -1) DESC, CAST(name <> '' AS INT) DESC, chembl_id) AS k
        FROM qc WHERE st = 'ok')
    SELECT 'qc' AS name, COALESCE(SMILES, '') AS smiles, count(*) AS rows FROM qc GROUP BY ALL
    UNION ALL SELECT 'drug2id', SMILES, count(*) FROM best WHERE k = 1 GROUP BY ALL
    UNION ALL SELECT 'metadata', std, count(*) FROM best WHERE k = 1 GROUP BY ALL""")
def written(spark, sf):
    out = curate_library(_cleaned(spark, sf), _describe)
    paths = sinks.write_tables({"qc": out.qc, "drug2id": out.drugs, "metadata": out.metadata},
                               scratch_path(spark, "library"), "csv")
    back = None
    for name, path in paths.items():
        key = "SMILES_Std" if name == "metadata" else "SMILES"
        part = spark.read.option("header", True).csv(path).groupBy(
            F.lit(name).alias("name"), F.coalesce(F.col(key), F.lit("")).alias("smiles")).agg(F.count("*").alias("rows"))
        back = part if back is None else back.unionByName(part)
    return back


@query("write_report", "SELECT 'rows' AS key, CAST(count(*) AS STRING) AS value FROM part UNION ALL "
                       "SELECT 'names', CAST(count(DISTINCT p_name) AS STRING) FROM part")
def reported(spark, sf):
    row = table(spark, sf, "part").agg(F.count("*").alias("rows"), F.count_distinct("p_name").alias("names"))
    path = sinks.write_report(spark, sinks.report_dict(row), scratch_path(spark, "report"))
    lines = spark.read.text(f"{path}/txt")
    return lines.select(F.split_part("value", F.lit(": "), F.lit(1)).alias("key"),
                        F.split_part("value", F.lit(": "), F.lit(2)).alias("value"))


@query("sort_output", "SELECT p_name, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY p_name ORDER BY p_name")
def sorted_output(spark, sf):
    return sinks.sort_output(table(spark, sf, "part").groupBy("p_name").agg(F.count("*").alias("n")), ["p_name"])


