import math

import pytest
from pyspark.sql import functions as F

from pairscreen.functions import text
from pairscreen.functions.rules import first_failure


def values(spark, cells, expr, kind="string"):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


def python_keys(s):
    """The rule in words: the stripped text, then its whole-number form."""
    if s is None or s.strip() == "" or s.strip().lower() == "nan":
        return []
    s = s.strip()
    keys = [s]
    try:
        f = float(s)
        if math.isfinite(f) and abs(f - int(f)) < 1e-8 and str(int(f)) not in keys:
            keys.append(str(int(f)))
    except ValueError:
        pass
    return keys


def test_clean_text(spark):
    cells = [None, "", "  a b\t", "NaN", " none ", "NULL", "nanx", "None of", "\xa0x　", "\x1cy"]
    assert values(spark, cells, text.clean_text) == ["", "", "a b", "", "", "", "nanx", "None of", "x", "y"]


def test_to_float(spark):
    cells = ["1", " 2.5 ", "1e3", ".5", "5.", "1d", "0x1p3", "abc", "nan", None, "1_000", "-7", "inf", "1e", "--1"]
    assert values(spark, cells, text.to_float) == [
        1, 2.5, 1000, 0.5, 5, None, None, None, None, None, 1000, -7, math.inf, None, None]


def test_false_ok(spark):
    cells = ["False", "0", " NO", "n", "", None, "nan", "true", "1", "y"]
    assert values(spark, cells, text.false_ok) == [True] * 7 + [False] * 3


def test_normalize_id(spark):
    assert values(spark, [" 7.0 ", "7.00", "7", "a.0", ".0", "7.0.0"], text.normalize_id) == [
        "7", "7.00", "7", "a", "", "7.0"]
    assert values(spark, [7.0, 12.5], text.normalize_id, "double") == ["7", "12.5"]


@pytest.mark.parametrize("cell", [
    "7", "7.0", "007", "1e3", "-0.0", "0", "abc", "", " ", "nan", None, "12.5", " 8 ", "6.999999999999", "inf",
    "9007199254740993", "12345678901234567", "12345678901234567890", "-98765432109876543210", "1e23", "123e25", "+5", "1_0", "-3", "0.0", "1e-9"])
def test_norm_keys(spark, cell):
    assert values(spark, [cell], text.norm_keys) == [python_keys(cell)]


def test_clean_sequence(spark):
    cells = [">sp|X\nMK V\r\n  >again\nac\tg", "plain", ">only header", "a\x85>b\x85c", " >x", "straße", "m>k"]
    want = []
    for c in cells:
        body = "".join(line.strip() for line in c.splitlines() if not line.lstrip().startswith(">"))
        want.append("".join(body.split()).upper())
    assert values(spark, cells, text.clean_sequence) == want


def test_entity_names_and_domain(spark):
    df = spark.createDataFrame(
        [("k", 1.0, "HUMAN kinase"), (None, 2.0, "viral x"), (None, float("nan"), None)],
        "protein_key string, prot_id double, domain string")
    assert [r[0] for r in df.select(text.protein_name(df)).collect()] == ["k", "2.0", "unknown_protein"]
    assert [r[0] for r in df.select(text.infer_domain(df)).collect()] == [0, 1, 0]
    assert [r[0] for r in df.select(text.drug_name(df)).distinct().collect()] == ["unknown_drug"]


def test_domain_reads_the_protein_key_too(spark):
    df = spark.createDataFrame([("human", "virus::P1")], "prot_domain string, protein_key string")
    assert df.select(text.infer_domain(df)).first()[0] == 1


def test_first_failure_counts_unknown_as_broken(spark):
    df = spark.createDataFrame([(1, 1), (0, 1), (1, None), (0, None)], "a int, b int")
    got = df.select(first_failure([("a", F.col("a") == 1), ("b", F.col("b") == 1)])).collect()
    assert [r[0] for r in got] == [None, "a", "b", "a"]
