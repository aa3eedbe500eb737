import pytest
from pyspark.sql import functions as F

from pairscreen.operators import audit, pairs

SCHEMA = "row_id long, drug_id string, prot_id string, label string, prot_domain string"


def frame(spark, rows):
    return spark.createDataFrame([(i, *map(str, r)) for i, r in enumerate(rows)], SCHEMA).repartition(3)


def tuples(df):
    return sorted((r["row_id"], r["drug_id"], r["prot_id"], r["label"]) for r in df.collect())


EXAMPLE = [  # one protein with three positives and negatives, one with one and three
    (51588, 262, 1, "virus"), (51719, 262, 1, "virus"), (52230, 262, 1, "virus"), (53974, 262, 0, "virus"),
    (54060, 262, 0, "virus"), (54069, 262, 0, "virus"), (42532, 217, 1, "virus"), (42122, 217, 0, "virus"),
    (42551, 217, 0, "virus"), (42578, 217, 0, "virus")]


def test_clean_rows_pass_unchanged(spark):
    df = frame(spark, EXAMPLE)
    once = pairs.clean_pairs(df)
    assert tuples(once) == sorted((i, str(d), str(p), y) for i, (d, p, y, _) in enumerate(EXAMPLE))
    assert tuples(pairs.clean_pairs(once)) == tuples(once)
    stats = pairs.clean_pairs_stats(df, on_mixture="error").first()
    assert (stats["input_rows"], stats["output_rows"], stats["duplicate_rows_removed"]) == (10, 10, 0)


def test_conflicts_go_with_their_gray_rows(spark):
    df = frame(spark, [("1", "a", 1, "virus"), ("1.0", " a", 0, "VIRUS"), ("1", "a", -1, "virus"),
                       ("2", "a", 1.0, "human "), ("2.0", "a", "1", "human"), ("3", "b", -1, "virus")])
    assert tuples(pairs.clean_pairs(df)) == [(3, "2", "a", 1), (5, "3", "b", -1)]
    got = pairs.clean_pairs_stats(df).first().asDict()
    assert got == {"input_rows": 6, "conflicting_pairs_removed": 1, "conflicting_rows_removed": 3,
                   "duplicate_rows_removed": 1, "mixture_rows_removed": 0, "output_rows": 2}
    assert pairs.conflict_exclusion(df).count() == 3


def test_mixtures(spark):
    df = frame(spark, [("1", "a", -1, "virus"), ("1", "a", 1, "virus"), ("1", "a", 1, "virus"), ("2", "a", 0, "virus")])
    with pytest.raises(Exception, match="hard and a gray label"):
        pairs.clean_pairs(df).collect()
    assert tuples(pairs.clean_pairs(df, on_mixture="drop")) == [(3, "2", "a", 0)]
    assert tuples(pairs.clean_pairs(df, on_mixture="keep_hard")) == [(1, "1", "a", 1), (3, "2", "a", 0)]
    for mode, rows in (("drop", 1), ("keep_hard", 2)):
        assert pairs.clean_pairs_stats(df, on_mixture=mode).first()["output_rows"] == rows


@pytest.mark.parametrize("row, rule", [
    (("", "a", 1, "virus"), "empty_drug_id"), (("1", " ", 1, "virus"), "empty_prot_id"),
    (("1", "a", 2, "virus"), "bad_label"), (("1", "a", "x", "virus"), "bad_label"),
    (("1", "a", 0.5, "virus"), "bad_label"), (("1", "a", 1, "mouse"), "bad_domain")])
def test_bad_rows_stop_the_job(spark, row, rule):
    df = frame(spark, [("5", "c", 1, "virus"), row])
    with pytest.raises(Exception, match=rule):
        pairs.clean_pairs(df).collect()
    with pytest.raises(ValueError, match=rule):
        pairs.validate_pairs(df)
    assert pairs.pair_violations(df).first()[rule] == 1


def test_inconsistent_domain_and_missing_columns(spark):
    df = frame(spark, [("1", "a", 1, "virus"), ("1", "a", 1, "human")])
    with pytest.raises(Exception, match="under human and virus"):
        pairs.clean_pairs(df).collect()
    with pytest.raises(ValueError, match="prot_domain"):
        pairs.clean_pairs(df.drop("prot_domain"))


def test_carried_columns_come_from_the_surviving_row(spark):
    df = frame(spark, [("1", "a", -1, "virus"), ("1", "a", 1, "virus"), ("1", "a", 1, "virus")])
    got = pairs.clean_pairs(df.withColumn("note", F.col("row_id") * 10), on_mixture="keep_hard", carry=["note"])
    assert [r["note"] for r in got.collect()] == [10]


def test_filters(spark):
    df = frame(spark, [("1", "a", 1, "Virus"), ("1", "b", "-1", "human"), ("1", "c", "x", "human"), ("1", "d", "0.0", "virus")])
    assert pairs.label_filter(df).count() == 2
    assert pairs.label_filter(df, "gray").count() == 3
    assert pairs.domain_filter(df, "virus").count() == 2
    assert pairs.stage_dataset(df, "pretrain").count() == 1
    with pytest.raises(ValueError):
        pairs.label_filter(df, "other")
    with pytest.raises(ValueError, match="all labels are gray"):
        pairs.definitive_pairs(pairs.label_filter(df, "gray").filter("label < 0"))


def test_pos_weight_without_positives(spark):
    assert pairs.pos_weight(spark.createDataFrame([(0,), (0,)], "label int")).first()[0] == 1.0
    assert pairs.pos_weight(spark.createDataFrame([(0,), (0,), (1,), (-1,)], "label int")).first()[0] == 2.0


def test_split_audit(spark):
    rows = [("1", "a", 1, "virus", "train", "s1", "c1"), ("1", "a", 0, "virus", "train", "s1", "c1"),
            ("2", "b", 1, "virus", "train", "s2", "c1"), ("2", "b", 1, "virus", "train", "s2", "c1"),
            ("1", "a", 1, "virus", "val", "s1", "c2"), ("3", "c", 0, "virus", "test", "s2", "c3")]
    df = spark.createDataFrame(rows, "drug_id string, prot_id string, label int, prot_domain string, split string, "
                                     "scaffold string, cluster string")
    train = audit.split_stats(df).filter("split = 'train'").first()
    assert (train["rows"], train["exact_duplicate_rows"], train["conflicting_pairs"], train["unique_drugs"]) == (4, 1, 1, 2)
    got = {(r["axis"], r["split_a"], r["split_b"]): r["shared"]
           for r in audit.split_overlap(df, ["train", "val", "test"]).collect()}
    assert got[("pairs", "train", "val")] == 1 and got[("scaffolds", "train", "test")] == 1
    assert got[("clusters", "train", "val")] == 0 and got[("drugs", "val", "test")] == 0
    leaks = {r["axis"]: r["heldout_in_training"] for r in audit.holdout_leakage(df, ["val", "test"], ["train"]).collect()}
    assert leaks == {"scaffolds": 2, "clusters": 0}


def test_carried_columns_follow_their_row(spark):
    """Whatever the partitioning, and with or without ids."""
    rows = [(f"d{i % 50}", f"p{i % 7}", "1" if i % 50 % 2 else "0", "human", f"smiles-{i % 50}-{i % 7}") for i in range(700)]
    df = spark.createDataFrame(rows, "drug_id string, prot_id string, label string, prot_domain string, smiles string")
    seen = set()
    for n in (1, 3, 7):
        got = pairs.clean_pairs(df.repartition(n), carry=["smiles"]).collect()
        assert all(r.smiles == f"smiles-{r.drug_id[1:]}-{r.prot_id[1:]}" for r in got) and len(got) == 350
        seen.add(tuple(sorted((r.row_id, r.drug_id, r.prot_id) for r in got)))
    assert len(seen) == 1
    own = df.withColumn("row_id", F.monotonically_increasing_id())
    first = pairs.clean_pairs(own, carry=["smiles"])
    assert first.columns == ["row_id", "drug_id", "prot_id", "label", "prot_domain", "smiles"]
    assert all(r.smiles == f"smiles-{r.drug_id[1:]}-{r.prot_id[1:]}" for r in first.collect())


def test_split_audits_normalise_ids(spark):
    df = spark.createDataFrame(
        [("7", "p", 1, "human", "train"), ("7.0", "p", 1, "human", "train"), (" 7 ", "p", 0, "human", "test"), ("8", "q", 1, "virus", "test")],
        "drug_id string, prot_id string, label int, prot_domain string, split string")
    train = audit.split_stats(df).filter("split = 'train'").first()
    assert (train.rows, train.unique_drugs, train.exact_duplicate_rows) == (2, 1, 1)
    shared = {r.axis: r.shared for r in audit.split_overlap(df, ["train", "test"]).collect()}
    assert shared["drugs"] == 1 and shared["pairs"] == 1
