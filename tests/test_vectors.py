import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairscreen.functions import vectors
from pairscreen.operators import features


def one(spark, expr, **columns):
    names = list(columns)
    kinds = {n: "array<double>" if isinstance(v, list) else "double" for n, v in columns.items()}
    df = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{n} {kinds[n]}" for n in names))
    return df.select(expr).first()[0]


def test_sigmoid_and_softplus_do_not_overflow(spark):
    for x in (-800.0, -3.0, 0.0, 3.0, 800.0):
        want = 1 / (1 + math.exp(-x)) if x > -700 else 0.0
        assert one(spark, vectors.sigmoid(F.col("x")), x=x) == pytest.approx(want)
        assert one(spark, vectors.softplus(F.col("x")), x=x) == pytest.approx(np.logaddexp(0, x))


def test_vec_std_is_population_and_stable(spark):
    v = [1e8 + d for d in (0.1, 0.2, 0.4)]
    assert one(spark, vectors.vec_std(F.col("v")), v=v) == pytest.approx(np.std(v), rel=1e-6)


def test_standardize_vector(spark):
    got = one(spark, vectors.standardize_vector(F.col("v"), F.col("m"), F.col("a"), F.col("s")),
              v=[1.0, math.nan, math.inf, 900.0], m=[0.0, 2.0, 5.0, 0.0], a=[0.0, 1.0, 1.0, 0.0], s=[2.0, 1.0, 2.0, 1.0])
    assert got == [0.5, 1.0, 2.0, 10.0]


def test_split_and_mask(spark):
    v = [float(i) for i in range(6)]
    cells = F.array(*vectors.split_views(F.col("v"), [3, 1, 2]))
    assert one(spark, cells, v=v) == [[0, 1, 2], [3], [4, 5]]
    assert one(spark, vectors.mask_views(F.col("v"), [3, 1, 2], [1, 0, 1]), v=v) == [0, 1, 2, 0, 4, 5]
    with pytest.raises(Exception, match="vector length"):
        one(spark, F.array(*vectors.split_views(F.col("v"), [3, 1])), v=v)


@pytest.mark.parametrize("mode", vectors.PAIR_MODES)
def test_pair_features(spark, mode):
    d, p = np.array([1.0, -2.0, 3.0]), np.array([0.5, 4.0, -1.0])
    wd, wp = [[1.0, 0.0, 2.0], [0.0, 1.0, 0.0]], [[1.0, 1.0, 1.0], [2.0, 0.0, 0.0]]
    parts = [d, p, d * p, np.abs(d - p), (np.array(wd) @ d) * (np.array(wp) @ p)]
    want = np.concatenate(parts[: vectors.PAIR_MODES.index(mode) + 2])
    got = one(spark, vectors.pair_features(F.col("d"), F.col("p"), mode, wd, wp), d=d.tolist(), p=p.tolist())
    assert np.allclose(got, want)
    normed = one(spark, vectors.layer_norm(F.col("v")), v=want.tolist())
    assert np.allclose(normed, (want - want.mean()) / np.sqrt(want.var() + 1e-5))


def test_boundary_trim(spark):
    df = spark.createDataFrame([(["a", "b"], 2), (["<", "a", "b", ">"], 2)], "t array<string>, n int")
    assert [r[0] for r in df.select(vectors.boundary_trim(F.col("t"), F.col("n"))).collect()] == [["a", "b"]] * 2
    bad = spark.createDataFrame([(["a", "b", "c"], 2)], "t array<string>, n int")
    with pytest.raises(Exception, match="cannot align"):
        bad.select(vectors.boundary_trim(F.col("t"), F.col("n"))).collect()


# -- standardisation statistics ------------------------------------------------------

def bank(spark, matrix):
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(matrix)]
    return spark.createDataFrame(rows, "id long, vec array<double>")


def numpy_fit(m):
    m = np.where(np.isfinite(m), m, np.nan)
    with np.errstate(all="ignore"):
        median = np.array([np.nanmedian(c) if np.isfinite(c).any() else 0.0 for c in m.T])
    filled = np.where(np.isfinite(m), m, median)
    std = filled.std(axis=0)
    return median, filled.mean(axis=0), np.where(std > 0, std, 1.0)


@pytest.mark.parametrize("limit", [100_000, 20, 3])
@pytest.mark.parametrize("rows", [101, 100])
def test_fit_standardization_matches_numpy(spark, monkeypatch, limit, rows):
    """Small limits force the histogram passes that large data would need."""
    monkeypatch.setattr(features, "EXACT_LIMIT", limit)
    monkeypatch.setattr(features, "HISTOGRAM_BINS", 8)
    rng = np.random.default_rng(rows)
    m = np.stack([
        rng.normal(size=rows), rng.integers(0, 3, rows), np.exp(rng.normal(size=rows) * 6), np.full(rows, 4.0),
        np.full(rows, np.nan), np.where(np.arange(rows) < rows // 2, -1.0, 1e6)], axis=1)
    m[rng.random(m.shape) < 0.1] = np.nan
    m[3, 0], m[4, 1] = np.inf, -np.inf
    df = bank(spark, np.vstack([m, np.full((5, 6), 1e9)]))
    train = df.filter(F.col("id") < rows).select("id")
    got = features.fit_standardization(df, train, "id").orderBy("pos").collect()
    for column, want in zip(("median", "mean", "std"), numpy_fit(m)):
        assert np.allclose([r[column] for r in got], want), column


def test_apply_standardization_rejects_bad_statistics(spark):
    df = bank(spark, np.ones((2, 2)))
    stats = spark.createDataFrame([(0, 0.0, 0.0, 1.0), (1, 0.0, 0.0, 0.0)], "pos int, median double, mean double, std double")
    with pytest.raises(ValueError, match="no finite median"):
        features.apply_standardization(df, stats)


def test_combine_banks_needs_the_same_ids(spark):
    a, b = bank(spark, np.ones((3, 2))), bank(spark, np.zeros((3, 1)))
    got = features.combine_banks([a, b], "id").orderBy("id").collect()
    assert [r["vec"] for r in got] == [[1.0, 1.0, 0.0]] * 3
    with pytest.raises(ValueError, match="differ"):
        features.combine_banks([a, b.filter("id < 2")], "id")
