import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairscreen.functions.rules import compound_rules, range_rules
from pairscreen.operators import library
from pairscreen.operators.joins import incremental_todo
from pairscreen.operators.ordering import limit_distinct
from pairscreen.plans.curate import curate_library
from pairscreen.session import materialize, scratch_path
from pairscreen.sources import scans, sinks

HEADERS = list(scans.EXPORT_COLUMNS)


def export(tmp_path, rows, name="export.csv"):
    """Rows give some fields by new name; the rest read as usable."""
    usual = {"type": "Small molecule", "structure_type": "MOL", "withdrawn_flag": "False", "inorganic_flag": "0",
             "SMILES": "CCO", "chembl_mw": "300", "chembl_heavy_atoms": "20"}
    lines = [";".join(f'"{h}"' for h in [*HEADERS, "Extra"])]
    for i, row in enumerate(rows):
        cells = {**usual, "chembl_id": f"C{i}", **row}
        lines.append(";".join(f'"{cells.get(v, "")}"' for v in scans.EXPORT_COLUMNS.values()) + row.get("_tail", ';""'))
    path = tmp_path / name
    path.write_text("\n".join(lines) + "\n\n")
    return str(path)


def test_scan_matches_pandas(spark, tmp_path):
    path = export(tmp_path, [
        {"name": 'a;b ""q""'}, {"name": " NULL "}, {"name": "N/A"}, {"name": "x", "_tail": ';"";"surplus";"cells"'},
        {"name": "short", "_tail": ""}])
    with open(path, "a") as f:
        f.write('"C9";"only"\n')
    got = [tuple(r) for r in scans.scan_compounds(spark, path).select("chembl_id", "name", "withdrawn_flag").collect()]
    raw = pd.read_csv(path, sep=";", quotechar='"', usecols=HEADERS, dtype=str, on_bad_lines="skip")
    blank = {"nan", "none", "null"}
    tidy = lambda v: "" if pd.isna(v) or str(v).strip().lower() in blank else str(v).strip()
    want = [tuple(tidy(raw[h][i]) for h in ("Compound ChEMBL ID", "Name", "Withdrawn Flag")) for i in range(len(raw))]
    assert sorted(got) == sorted(want) and len(got) == 6


def test_scan_needs_every_column(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("Name;Type\nx;y\n")
    with pytest.raises(ValueError, match="missing columns"):
        scans.scan_compounds(spark, str(path))


def test_cascades_name_the_first_broken_rule(spark, tmp_path):
    path = export(tmp_path, [
        {}, {"SMILES": ""}, {"type": "Protein", "structure_type": "SEQ"}, {"structure_type": "SEQ"},
        {"withdrawn_flag": "Yes"}, {"inorganic_flag": "True"}, {"type": "SMALL MOLECULE", "structure_type": "mol"}])
    raw = scans.scan_compounds(spark, path)
    got = library.failure_counts(raw, compound_rules(), "raw_rows", "prefilter_kept_rows").first().asDict()
    assert got == {"raw_rows": 7, "missing_smiles": 1, "non_small_molecule": 1, "non_mol_structure": 1, "withdrawn": 1,
                   "inorganic": 1, "prefilter_kept_rows": 2}


def test_range_bounds_are_inclusive_and_unknown_passes(spark, tmp_path):
    path = export(tmp_path, [{"chembl_mw": "120"}, {"chembl_mw": "850"}, {"chembl_mw": "119.9"}, {"chembl_mw": "850.1"},
                             {"chembl_mw": "x"}, {"chembl_mw": ""}, {"chembl_alogp": "9", "chembl_mw": "9"},
                             {"chembl_alogp": "9"}, {"chembl_rotb": "21"}, {"chembl_hbd": "8"}, {"chembl_mw": "inf"}])
    raw = scans.scan_compounds(spark, path)
    got = library.failure_counts(raw, range_rules("standard"), None, "kept", "removed").first().asDict()
    assert (got["mw_prefilter_out_of_range"], got["logp_prefilter_out_of_range"], got["rotb_prefilter_out_of_range"],
            got["kept"], got["removed"]) == (4, 1, 1, 5, 6)
    assert library.passing(raw, range_rules("none")).count() == 11
    assert library.passing(raw, range_rules("relaxed")).count() == 9
    with pytest.raises(ValueError, match="filter profile"):
        range_rules("strict")


def test_curation(spark, tmp_path):
    def describe(batches):
        for pdf in batches:
            s = pdf["SMILES"]
            yield pd.DataFrame({
                "SMILES": s, "parsed": s != "bad", "standardized": True, "finalized": True, "n_components": 1,
                "elements": [["C"]] * len(s), "alerts": [["PAINS_A x", "brenk y"] if t == "alert" else [] for t in s],
                "SMILES_Std": s.str.upper().str[:2], "SMILES_ChargeAware": s, "MolWt": 200.0,
                "HeavyAtoms": [99.0 if t == "heavy" else 20.0 for t in s],
                "LogP": float("nan"), "HBD": 1.0, "HBA": 1.0, "TPSA": 1.0, "RotB": 1.0, "QED": 0.4})

    path = export(tmp_path, [{"SMILES": "abc"}, {"SMILES": "abd", "max_phase": "4"}, {"SMILES": "bad"}, {"SMILES": "alert"},
                             {"SMILES": "heavy"}, {"SMILES": "aa"}, {"SMILES": "abc"}, {"SMILES": "zz", "type": "Protein"}])
    raw = scans.scan_compounds(spark, path)
    out = curate_library(raw, describe)
    assert {r["status"]: r["rows"] for r in out.status_counts.collect()} == {
        "ok": 4, "parse_fail": 1, "structural_alert": 1, "heavy_atom_out_of_range": 1}
    assert [(r["drug_id"], r["drug_key"], r["SMILES"]) for r in out.drugs.orderBy("drug_id").collect()] == [
        (0, "AA", "aa"), (1, "AB", "abd")]
    assert out.metadata.columns == list(library.METADATA_TABLE)
    assert out.summary.first().asDict() == {
        "candidate_rows_after_prefilter": 7, "unique_raw_smiles_processed": 6, "rows_after_filter": 4,
        "unique_drugs_after_dedup": 2, "duplicate_rows_removed": 2}
    out.write(str(tmp_path / "library"))
    assert spark.read.option("header", True).csv(str(tmp_path / "library/drug2id")).count() == 2
    report = spark.read.json(str(tmp_path / "library/processing_summary/json")).first().asDict(recursive=True)
    assert report["prefilter_counts"]["non_small_molecule"] == 1 and report["smiles_status_counts"]["ok"] == 4
    kept = curate_library(raw, describe, drop_alerts=False).qc.filter("SMILES = 'alert'").first()
    assert kept["keep_final"] and kept["PAINS_Detail"] == "PAINS_A x" and kept["Brenk_Hit"] == 1
    first = curate_library(limit_distinct(raw, "SMILES", 2), describe)
    assert {r[0] for r in first.qc.select("SMILES").distinct().collect()} == {"aa", "abc"}


def test_incremental_and_tables(spark, tmp_path):
    todo = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    path = str(tmp_path / "done")
    sinks.append_outputs(todo.filter("id = 2"), path)
    done = spark.read.parquet(path)
    assert incremental_todo(todo, done, "id").count() == 2
    assert incremental_todo(todo, done, "id", overwrite=True).count() == 3
    paths = sinks.write_tables({"a": todo, "b": done}, str(tmp_path / "t"), "csv")
    assert spark.read.option("header", True).csv(paths["a"]).columns == ["id"]


def test_pair_scan_reads_text(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("drug_id,prot_id,label,prot_domain,note\n007,1.0,1,virus,x\n")
    row = scans.scan_pairs(spark, str(path)).first()
    assert (row["drug_id"], row["prot_id"], row["note"]) == ("007", "1.0", "x")


def test_shared_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x").startswith(named)
    assert materialize(spark.range(3).withColumn("v", F.array("id"))).count() == 3
