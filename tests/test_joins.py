import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairscreen.operators import joins, library
from pairscreen.sources import scans


def test_hot_keys_finds_every_heavy_key(spark):
    rows = [("hot",)] * 400 + [(f"k{i}",) for i in range(600)]
    df = spark.createDataFrame(rows, "k string").repartition(6)
    want = spark.createDataFrame([("hot",)], "k string").select(F.xxhash64("k")).first()[0]
    found = joins.hot_keys(df, ["k"])
    assert want in found and len(found) <= 64


def test_salted_join_keeps_every_row_once(spark):
    rows = [(i, "hot" if i % 3 else f"k{i % 50}") for i in range(900)] + [(900, None), (901, "absent")]
    left = spark.createDataFrame(rows, "i int, k string").repartition(5)
    right = spark.createDataFrame(
        [("hot", 1)] + [(f"k{i}", i + 10) for i in range(50)] + [(None, 7)], "k string, v int")
    got = {r["i"]: r["v"] for r in joins.salted_join(left, right, ["k"]).collect()}
    lookup = {"hot": 1, None: 7, **{f"k{i}": i + 10 for i in range(50)}}
    assert got == {i: lookup.get(k) for i, k in rows}
    assert joins.salted_join(left, right, ["k"], "inner").count() == 901


def test_alias_precedence(spark):
    bank = spark.createDataFrame([(0, "1", "9"), (1, "2.0", "1"), (2, "9", "x"), (3, "2", None)],
                                 "idx long, drug_ids string, drug_keys string")
    index = {r["alias"]: r["idx"] for r in joins.alias_index(bank, ["drug_ids", "drug_keys"]).collect()}
    # earlier column first, then earlier row: "9" is an id of row 2, "1" an id of row 0
    assert index == {"1": 0, "2.0": 1, "2": 1, "9": 2, "x": 2}


def test_alias_lookup_tries_columns_then_forms(spark):
    index = spark.createDataFrame([("5", 50), ("005", 55), ("key", 60)], "alias string, idx long")
    rows = [(0, "005", None), (1, "5.0", "key"), (2, "none", "key"), (3, None, "key"), (4, "zz", "zz"), (5, "5e0", None)]
    df = spark.createDataFrame(rows, "i int, drug_id string, drug_key string")
    got = {r["i"]: r["hit"] for r in joins.alias_lookup(df, ["drug_id", "drug_key"], index, "hit").collect()}
    assert got == {0: 55, 1: 50, 2: 60, 3: 60, 4: None, 5: 50}


def test_attach_counts_misses(spark):
    drugs = spark.createDataFrame([("1", 0), ("2", 1)], "alias string, idx long")
    second = spark.createDataFrame([("1", 0)], "alias string, idx long")
    prots = spark.createDataFrame([("p", 0)], "alias string, idx long")
    df = spark.createDataFrame([("1", "p"), ("2", "p"), ("3", "p"), ("1", "q"), ("9", "q")], "drug_id string, prot_id string")
    got = joins.attach_features(df, drugs, prots, second)
    assert joins.missing_counts(got).first().asDict() == {
        "missing_ecfp": 2, "missing_unimol": 3, "missing_prot": 2, "missing_any": 4}
    assert joins.matched(got).count() == 1


def test_map_distinct_runs_once_per_key(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), (None, 4)], "k string, i int")

    def fn(batches):
        for pdf in batches:
            assert pdf["k"].is_unique
            yield pd.DataFrame({"k": pdf["k"], "n": pdf["k"].str.len()})

    got = {r["i"]: r["n"] for r in joins.map_distinct(df, "k", fn, "k string, n long").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: None}


def test_id_checks(spark):
    a = spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "id int, o int")
    b = spark.createDataFrame([(1, 0), (3, 1), (2, 2)], "id int, o int")
    joins.assert_same_ids(a, b, "id")
    with pytest.raises(ValueError):
        joins.assert_same_ids(a, b, "id", "o")
    with pytest.raises(ValueError):
        joins.assert_same_ids(a, b.filter("id < 3"), "id")
    with pytest.raises(ValueError):
        joins.assert_same_ids(a, b.unionAll(b.filter("id = 1")), "id")
    joins.require_ids(a, b, "id")
    with pytest.raises(ValueError, match="1 required"):
        joins.require_ids(a, b.filter("id > 1"), "id")


def test_target_lookup_precedence(spark):
    bank = spark.createDataFrame(
        [(0, "10", "a", [0.0]), (1, "a", "b", [1.0]), (2, "11", "b", [2.0])],
        "idx long, prot_id string, protein_key string, vec array<double>")
    targets = spark.createDataFrame([("x", "a"), ("x", "b"), ("10", "zz"), ("11", "b"), ("q", "q")],
                                    "prot_id string, protein_key string")
    got = sorted(((r["prot_id"], r["protein_key"]), r["idx"]) for r in joins.target_lookup(targets, bank).collect())
    # a key beats another row's id; of equal keys the later row counts
    assert got == [(("10", "zz"), 0), (("11", "b"), 2), (("q", "q"), None), (("x", "a"), 0), (("x", "b"), 2)]


def test_manifest_needs_one_record(spark):
    targets = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c")], "prot_id string, protein_key string")
    records = spark.createDataFrame([("1", "a", "f1", 5), ("9", "b", "f2", 6), ("2", "z", "f3", 7)],
                                    "prot_id string, protein_key string, token_file string, length int")
    got = {r["prot_id"]: r["n_records"] for r in joins.manifest_match(targets, records).collect()}
    assert got == {"1": 1, "2": 2, "3": 0}
    with pytest.raises(Exception, match="must match a single"):
        joins.require_single_record(joins.manifest_match(targets, records)).collect()


def test_manifest_is_read_once(spark):
    targets = spark.createDataFrame([("1", "1"), (None, "b"), ("c", None)], "prot_id string, protein_key string")
    rows = [("1", "1", "f1", 5), (None, None, "f2", 6), ("b", "c", "f3", 7)]
    schema = "prot_id string, protein_key string, token_file string, length int"
    found = joins.manifest_match(targets, spark.createDataFrame(rows, schema).withColumn("length", F.col("length") + F.lit(1000)))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("+ 1000)") == 1
    assert {(r["prot_id"], r["protein_key"]): r["n_records"] for r in found.collect()} == {("1", "1"): 1, (None, "b"): 0, ("c", None): 0}


def test_attach_metadata_rejects_repeated_ids(spark):
    hits = spark.createDataFrame([(1, "p"), (1, "q"), (3, "p")], "drug_id int, protein_key string")
    lib = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "drug_id int, name string")
    got = sorted(((r["drug_id"], r["protein_key"]), r["name"]) for r in joins.attach_metadata(hits, lib).collect())
    assert got == [((1, "p"), "a"), ((1, "q"), "a"), ((3, "p"), None)]
    with pytest.raises(Exception, match="repeats id"):
        joins.attach_metadata(hits.withColumn("drug_id", F.lit(2)), lib).collect()


def test_select_targets(spark):
    t = spark.createDataFrame([("P1",), ("P2",)], "pdb_id string")
    assert joins.select_targets(t, [" P2 ", ""]).count() == 1
    assert joins.select_targets(t, []).count() == 2
    with pytest.raises(ValueError):
        joins.select_targets(t, ["P9"])


def test_representatives_and_ids(spark):
    rows = [("k2", "3", None, "1", "", "C2"), ("k2", "3", "nan", "1", "n", "C1"), ("k1", None, "9", "9", "x", "C3"),
            ("k1", "0", "1", "1", "x", "C4"), ("k2", "3", "0", "0", "", "C5")]
    df = spark.createDataFrame(rows, "SMILES_Std string, max_phase string, bioactivities string, targets string, "
                                     "name string, chembl_id string")
    order = library.representative_order(*[F.col(c) for c in (
        "max_phase", "bioactivities", "targets", "name", "chembl_id")])
    got = library.number_library(library.choose_representatives(df, "SMILES_Std", order)).orderBy("drug_id").collect()
    assert [(r["drug_id"], r["drug_key"], r["chembl_id"]) for r in got] == [(0, "k1", "C4"), (1, "k2", "C5")]


def test_bank_scan(spark):
    df = spark.createDataFrame([(5, [1.0], [9.0]), (2, [2.0], [8.0])], "id long, zz array<double>, x array<double>")
    assert scans.pick_vector_column(df) == "x"
    assert scans.pick_vector_column(df.drop("x")) == "zz"
    by_row = scans.scan_bank(df, order="id").orderBy("idx").collect()
    assert [(r["idx"], r["row_key"], r["vec"]) for r in by_row] == [(0, "0", [8.0]), (1, "1", [9.0])]
    named = scans.scan_bank(df.withColumn("key", F.concat(F.lit("k"), "id")), ["key"]).orderBy("idx").collect()
    assert [(r["idx"], r["key"]) for r in named] == [(0, "k2"), (1, "k5")]
    assert {r["alias"]: r["idx"] for r in scans.bank_index(scans.scan_bank(df, ["id"])).collect()} == {"5": 5, "2": 2}
