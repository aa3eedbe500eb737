"""Feature banks: tables of ``idx, <alias columns>, vec ARRAY<FLOAT>``."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairscreen.functions.vectors import concat_views, finite, standardize_vector
from pairscreen.operators.joins import assert_same_ids
from pairscreen.session import materialize, parallelism

EXACT_LIMIT = 100_000
HISTOGRAM_BINS = 256
# A matrix of vectors in a task.
TILE_ROWS = 10_000
TILE_CELLS = 1_000_000


def explode_vector(df: DataFrame, keys: Sequence[str], vec: str = "vec") -> DataFrame:
    """Long form: one row per element, ``pos`` from 0."""
    return df.select(*keys, F.posexplode(vec).alias("pos", "value"))


def collect_vector(long: DataFrame, keys: Sequence[str], value: str = "value", name: str = "vec") -> DataFrame:
    """Wide form again; a group holds one vector, so its size is the dimension."""
    packed = long.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", value))).alias("_cells"))
    return packed.select(*keys, F.transform("_cells", lambda c: c[value]).alias(name))


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Vectors as rows of matrices of bounded size, with NaN where an element
    is missing, not finite, or beyond its vector's end; and the vectors' sizes."""
    for batch in batches:
        column = batch.column(0).drop_null()
        start = 0
        while start < len(column):
            sizes = column.slice(start, TILE_ROWS).value_lengths().to_numpy()
            width = max(1, int(sizes.max()))
            sizes = sizes[:max(1, TILE_CELLS // width)]
            flat = column.slice(start, len(sizes)).flatten().to_numpy(zero_copy_only=False)
            out = np.full((len(sizes), width), np.nan)
            out[np.arange(width) < sizes[:, None]] = np.where(np.isfinite(flat), flat, np.nan)
            yield out, sizes
            start += len(sizes)


def _per_task(df: DataFrame, vec: str, run: Callable, schema: str) -> DataFrame:
    """``run`` over the vectors of every task. Tasks are no more than the
    session's reduce side, which bounds what a dimension's merge receives."""
    return df.select(F.col(vec).cast("array<double>")).coalesce(parallelism(df.sparkSession)).mapInArrow(run, schema)


def _widen(parts: np.ndarray, width: int, neutral: Sequence[float]) -> np.ndarray:
    """Accumulators ``[quantity, dimension]``, with further dimensions if need be."""
    more = width - parts.shape[1]
    return np.hstack([parts, np.repeat(np.array(neutral, float)[:, None], more, axis=1)]) if more > 0 else parts


_NOTHING = (0, 0, np.inf, -np.inf, 0, 0)  # rows, finite values, least, greatest, mean, squared deviations


def _tile_moments(tile: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    known = ~np.isnan(tile)
    f = known.sum(axis=0)
    mean = np.where(known, tile, 0).sum(axis=0) / np.maximum(f, 1)
    return np.stack([
        (np.arange(tile.shape[1]) < sizes[:, None]).sum(axis=0), f, np.where(known, tile, np.inf).min(axis=0),
        np.where(known, tile, -np.inf).max(axis=0), mean, np.square(np.where(known, tile - mean, 0)).sum(axis=0)])


def _together(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    width = max(a.shape[1], b.shape[1])
    a, b = _widen(a, width, _NOTHING), _widen(b, width, _NOTHING)
    f, apart = a[1] + b[1], b[4] - a[4]
    share = b[1] / np.maximum(f, 1)
    return np.stack([a[0] + b[0], f, np.minimum(a[2], b[2]), np.maximum(a[3], b[3]),
                     a[4] + apart * share, a[5] + b[5] + np.square(apart) * a[1] * share])


def dimension_moments(df: DataFrame, vec: str = "vec") -> DataFrame:
    """Per dimension: rows ``n``, finite values ``f`` and their ``lo, hi``,
    mean ``m`` and population variance ``v``. A task adds up whole matrices and
    sends one row per dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = np.zeros((len(_NOTHING), 0))
        for tile, sizes in _matrices(batches):
            parts = _together(parts, _tile_moments(tile, sizes))
        found = parts[:, parts[0] > 0]
        yield pa.record_batch([
            pa.array(np.flatnonzero(parts[0] > 0), pa.int32()), pa.array(found[0].astype(np.int64)), pa.array(found[1].astype(np.int64)),
            *[pa.array(found[i], mask=found[1] == 0) for i in (2, 3, 4, 5)]], names=["pos", "n", "f", "lo", "hi", "m", "q"])

    parts = _per_task(df, vec, run, "pos int, n long, f long, lo double, hi double, m double, q double")
    w = W.partitionBy("pos")
    f = F.sum("f").over(w)
    centred = parts.withColumn("mean", F.when(f > 0, F.sum(F.col("f") * F.col("m")).over(w) / f))
    spread = F.sum(F.col("q") + F.col("f") * (F.col("m") - F.col("mean")) ** 2)
    return centred.groupBy("pos").agg(
        F.sum("n").alias("n"), F.sum("f").alias("f"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.first("mean").alias("m"), F.when(F.sum("f") > 0, spread / F.sum("f")).alias("v"))


class _Histograms:
    """Counts, least and greatest value of every bin of every open bracket."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray, bins: int):
        self.lo, self.hi, self.bins = lo, hi, bins
        shape = (len(lo), bins)
        self.counts, self.first, self.last = np.zeros(shape, np.int64), np.full(shape, np.inf), np.full(shape, -np.inf)

    def add(self, tile: np.ndarray, columns: np.ndarray) -> None:
        """``columns`` says which dimension of the tile each bracket is of."""
        for row, column in enumerate(columns):
            if column >= tile.shape[1]:
                continue
            v = tile[:, column]
            v = v[(v >= self.lo[row]) & (v <= self.hi[row])]
            if not len(v):
                continue
            # halves, so that the width of a bracket stays finite
            place = (v / 2 - self.lo[row] / 2) / (self.hi[row] / 2 - self.lo[row] / 2) * self.bins
            bins = np.minimum(place.astype(np.int64), self.bins - 1)
            self.counts[row] += np.bincount(bins, minlength=self.bins)
            np.minimum.at(self.first[row], bins, v)
            np.maximum.at(self.last[row], bins, v)


def _closer(counts: np.ndarray, first: np.ndarray, last: np.ndarray, n: int, below: int) -> tuple:
    """``median, lo, hi, below, inside``: the middle of ``n`` values, if it
    lies between two bins, else the bin that holds it as the next bracket."""
    low, high = (n - 1) // 2, n // 2
    upto = below + np.cumsum(counts)
    at, other = int(np.searchsorted(upto, low, "right")), int(np.searchsorted(upto, high, "right"))
    if at != other:
        return float(last[at] / 2 + first[other] / 2), None, None, None, None
    return None, float(first[at]), float(last[at]), int(upto[at] - counts[at]), int(counts[at])


def _narrowed(df: DataFrame, vec: str, wide: dict[int, dict]) -> list[Row]:
    """The next bracket, or the median, of every dimension in ``wide``."""
    columns, bins = np.array(sorted(wide)), HISTOGRAM_BINS
    lo, hi = (np.array([wide[p][side] for p in columns.tolist()], float) for side in ("lo", "hi"))
    state = {p: (s["n"], s["below"]) for p, s in wide.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Histograms(lo, hi, bins)
        for tile, _ in _matrices(batches):
            found.add(tile, columns)
        yield pa.record_batch([
            pa.array(columns, pa.int32()), pa.array(list(found.counts)), pa.array(list(found.first)), pa.array(list(found.last))],
            names=["pos", "counts", "first", "last"])

    def merge(table: pa.Table) -> pa.Table:
        pos = table.column("pos")[0].as_py()
        stack = {c: table.column(c).combine_chunks().flatten().to_numpy().reshape(-1, bins) for c in ("counts", "first", "last")}
        got = _closer(stack["counts"].sum(axis=0), stack["first"].min(axis=0), stack["last"].max(axis=0), *state[pos])
        kinds = (pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
        return pa.table([pa.array([pos], pa.int32()), *[pa.array([g], k) for g, k in zip(got, kinds)]],
                        names=["pos", "median", "lo", "hi", "below", "inside"])

    parts = _per_task(df, vec, run, "pos int, counts array<long>, first array<double>, last array<double>")
    return parts.groupBy("pos").applyInArrow(
        merge, "pos int, median double, lo double, hi double, below long, inside long").collect()


def _sorted_medians(df: DataFrame, vec: str, left: dict[int, dict]) -> list[Row]:
    """Medians of dimensions whose brackets hold at most ``EXACT_LIMIT`` values."""
    state = {p: (s["lo"], s["hi"], s["n"], s["below"]) for p, s in left.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile, _ in _matrices(batches):
            inside = {p: tile[:, p][(tile[:, p] >= lo) & (tile[:, p] <= hi)]
                      for p, (lo, hi, _, _) in state.items() if p < tile.shape[1]}
            yield pa.record_batch([pa.array(list(inside), pa.int32()), pa.array(list(inside.values()), pa.list_(pa.float64()))],
                                  names=["pos", "found"])

    def middle(table: pa.Table) -> pa.Table:
        pos = table.column("pos")[0].as_py()
        _, _, n, below = state[pos]
        v = np.sort(table.column("found").combine_chunks().flatten().to_numpy())
        return pa.table({"pos": pa.array([pos], pa.int32()),
                         "median": pa.array([(v[(n - 1) // 2 - below] + v[n // 2 - below]) / 2])})

    return _per_task(df, vec, run, "pos int, found array<double>").groupBy("pos").applyInArrow(
        middle, "pos int, median double").collect()


def dimension_medians(df: DataFrame, moments: Sequence[Row], vec: str = "vec") -> dict[int, float]:
    """Exact median of each dimension's finite values, given the collected
    moments; dimensions without any are left out.

    No dimension's values are gathered in one place. Every task counts all
    its vectors into one histogram per dimension, a merge by dimension picks
    the bin that holds the middle, and so on, pass by pass, until at most
    ``EXACT_LIMIT`` candidates per dimension are left to sort; only those are
    shuffled. The driver holds one bracket per dimension.
    """
    # per pos: finite count, bracket [lo, hi], values below the bracket, values in it
    state = {r["pos"]: {"n": r["f"], "lo": r["lo"], "hi": r["hi"], "below": 0, "inside": r["f"]}
             for r in moments if r["f"]}
    settled: dict[int, float] = {}
    while True:
        settled |= {p: s["lo"] for p, s in state.items() if p not in settled and s["lo"] == s["hi"]}
        wide = {p: s for p, s in state.items() if p not in settled and s["inside"] > EXACT_LIMIT}
        if not wide:
            break
        for r in _narrowed(df, vec, wide):
            if r["median"] is not None:
                settled[r["pos"]] = r["median"]
            else:
                state[r["pos"]].update(lo=r["lo"], hi=r["hi"], below=r["below"], inside=r["inside"])
    left = {p: s for p, s in state.items() if p not in settled}
    return {**settled, **{r["pos"]: r["median"] for r in (_sorted_medians(df, vec, left) if left else [])}}


def fit_standardization(bank: DataFrame, training_ids: DataFrame, key: str, vec: str = "vec") -> DataFrame:
    """``pos, median, mean, std`` over training rows only.

    Missing elements count as the median (0 where a dimension has no finite
    value), so the mean and population deviation follow from the finite
    values' moments and the number missing, without an imputed copy. Training
    vectors are written once, as the statistics take a few passes; only
    per-dimension rows reach the driver.
    """
    train = materialize(bank.join(training_ids.select(key).distinct(), key, "left_semi").select(vec), "training")
    moments = dimension_moments(train, vec).collect()
    if not moments:
        raise ValueError("no training rows to fit on")
    medians = dimension_medians(train, moments, vec)
    rows = []
    for r in sorted(moments, key=lambda r: r["pos"]):
        n, f, miss = r["n"], r["f"], r["n"] - r["f"]
        median, m, v = medians.get(r["pos"], 0.0), r["m"] or 0.0, r["v"] or 0.0
        mean = (f * m + miss * median) / n
        std = ((f * (v + (m - mean) ** 2) + miss * (median - mean) ** 2) / n) ** 0.5
        rows.append((r["pos"], median, mean, std if std > 0 else 1.0))
    return bank.sparkSession.createDataFrame(rows, "pos int, median double, mean double, std double")


def standardization_arrays(stats: DataFrame) -> DataFrame:
    """The statistics as one row of three arrays, checked for use."""
    bad = stats.filter(
        finite(F.col("median")).isNull() | finite(F.col("mean")).isNull()
        | finite(F.col("std")).isNull() | (F.col("std") <= 0))
    if not bad.isEmpty():
        raise ValueError("a dimension has no finite median and mean, or no positive deviation")
    cells = F.array_sort(F.collect_list(F.struct("pos", "median", "mean", "std")))
    row = stats.agg(cells.alias("c"))
    return row.select(*[F.col("c")[n].alias(n) for n in ("median", "mean", "std")])


def apply_standardization(bank: DataFrame, stats: DataFrame, vec: str = "vec") -> DataFrame:
    """Bank with standardised vectors. The statistics are one row of three
    arrays as long as a vector; they enter the plan as constants."""
    arrays = standardization_arrays(stats).first()
    literal = lambda name: F.array(*[F.lit(float(v)) for v in arrays[name]])
    return bank.withColumn(vec, standardize_vector(F.col(vec), *[literal(n) for n in ("median", "mean", "std")]))


def combine_banks(banks: Sequence[DataFrame], key: str, vec: str = "vec", check: bool = True) -> DataFrame:
    """Concatenate the vectors of banks that hold the same ids."""
    if check:
        for other in banks[1:]:
            assert_same_ids(banks[0], other, key)
    out = banks[0].withColumnRenamed(vec, "_v0")
    for i, other in enumerate(banks[1:], start=1):
        out = out.join(other.select(key, F.col(vec).alias(f"_v{i}")), key)
    names = [f"_v{i}" for i in range(len(banks))]
    return out.withColumn(vec, concat_views(*[F.col(n) for n in names])).drop(*names)

