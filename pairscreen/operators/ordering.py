"""Order-dependent operators that never put one key's rows in one task.

A window over a key that holds a third of all rows sorts a third of the data
in a single task. Everything here instead splits each group into value ranges
(or hash slices), works inside the slices in parallel, and joins the slices
through their totals, which number at most ``groups x ranges``.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Sequence
from itertools import accumulate

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairscreen.session import parallelism

ROWS_PER_RANGE = 100_000
MAX_RANGES = 8192
SAMPLES_PER_RANGE = 30
HASH_SLICES = 256


# -- ranges --------------------------------------------------------------------

def range_cuts(df: DataFrame, order: Sequence[str], n_ranges: int | None = None) -> list[tuple]:
    """Upper-open cut points that split ``order`` into about equal ranges.

    The driver receives about ``SAMPLES_PER_RANGE`` key tuples per range and
    there are at most ``MAX_RANGES``, so its load is bounded. Cut points only
    steer balance: any choice gives the same results.
    """
    keys = df.select(*order)
    for field in keys.schema.fields:
        if not isinstance(field.dataType, (T.NumericType, T.StringType)):
            raise ValueError(f"order by numbers or text, not {field.dataType.simpleString()}: {field.name}")
    total = keys.count()
    if n_ranges is None:
        n_ranges = min(MAX_RANGES, max(parallelism(df.sparkSession), total // ROWS_PER_RANGE))
    if total == 0 or n_ranges <= 1:
        return []
    wanted = SAMPLES_PER_RANGE * n_ranges
    sampled = keys if total <= wanted else keys.sample(wanted / total, seed=17)
    # NULL and NaN have no place among cut points.
    rows = sorted(tuple(r) for r in sampled.collect() if all(v is not None and v == v for v in r))
    cuts = [rows[i * len(rows) // n_ranges] for i in range(1, n_ranges)] if rows else []
    return sorted(set(cuts))


def _range_number(order: Sequence[str], schema: T.StructType, cuts: list[tuple]) -> Column:
    """How many cuts lie below the row's key, by binary search."""
    key_type = T.StructType([T.StructField(f"k{i}", schema[name].dataType) for i, name in enumerate(order)])
    table = F.from_json(
        F.lit(json.dumps([{f"k{i}": v for i, v in enumerate(cut)} for cut in cuts])), T.ArrayType(key_type)
    )
    key = F.struct(*[F.col(name).alias(f"k{i}") for i, name in enumerate(order)])
    steps, step = [], 1
    while step <= len(cuts):
        steps.append(step)
        step *= 2
    found = F.aggregate(
        F.array(*[F.lit(s) for s in reversed(steps)]),
        F.lit(0),
        lambda below, s: F.when(F.get(table, below + s - 1) < key, below + s).otherwise(below),
    )
    # Declared non-NULL so that joins on it add no second evaluation as a filter.
    return F.coalesce(found, F.lit(0))


def _bucketed(df: DataFrame, order: Sequence[str], cuts: list[tuple]) -> DataFrame:
    """``_range`` by a bucketizer on a numeric leading column. Only values
    that make up several cuts (heavy ties) look at the other columns, all of
    them through one search, so the plan does not grow with the ties."""
    cuts = [c for c in cuts if abs(float(c[0])) != float("inf")]
    per_lead = Counter(float(c[0]) for c in cuts)
    leads = sorted(per_lead)
    splits = [float("-inf"), *leads, float("inf")]
    bucketed = Bucketizer(splits=splits, inputCol=order[0], outputCol="_b", handleInvalid="keep").transform(df)
    number = F.col("_b").cast("int")
    heavy = [v for v in leads if per_lead[v] > 1 and len(order) > 1]
    if heavy:
        # bucket -> cuts at or below its lower bound
        upto = [0, *accumulate(per_lead[v] for v in leads)]
        found = F.get(F.from_json(F.lit(json.dumps([*upto, upto[-1]])), T.ArrayType(T.IntegerType())), number)
        # heavy value -> true; a search in a sorted list, not one branch for each value
        tied = F.array_contains(F.from_json(F.lit(json.dumps(heavy)), T.ArrayType(T.DoubleType())), F.col(order[0]).cast("double"))
        number = F.when(tied, _range_number(order, df.schema, cuts)).otherwise(found)
    return bucketed.withColumn("_range", F.coalesce(number, F.lit(0))).drop("_b")


def with_range(df: DataFrame, order: Sequence[str], n_ranges: int | None = None,
               cuts_from: DataFrame | None = None) -> DataFrame:
    """Add ``_range``, non-decreasing in ``order`` (ascending columns).

    ``cuts_from`` may name a cheaper frame with the same columns to sample.
    """
    cuts = range_cuts(cuts_from if cuts_from is not None else df, order, n_ranges)
    if not cuts:
        return df.withColumn("_range", F.lit(0))
    if isinstance(df.schema[order[0]].dataType, T.NumericType):
        return _bucketed(df, order, cuts)
    return df.withColumn("_range", _range_number(order, df.schema, cuts))


def _offsets(sliced: DataFrame, group: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Per (group, slice): sums of earlier slices and of the whole group."""
    totals = sliced.groupBy(*group, "_range").agg(*[F.sum(v).alias(f"_sum_{v}") for v in values])
    whole = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    earlier = whole.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    cols = []
    for v in values:
        cols.append(F.coalesce(F.sum(f"_sum_{v}").over(earlier), F.lit(0)).alias(f"_add_{v}"))
        cols.append(F.sum(f"_sum_{v}").over(whole).alias(f"total_{v}"))
    return totals.select(*group, "_range", *cols)


def _accumulate(sliced: DataFrame, group: Sequence[str], order: Sequence[str],
                values: Sequence[str]) -> DataFrame:
    """Running totals inside slices, each opened by a row that carries the
    slice's offset: rows and offsets meet in one shuffle, without a join."""
    rows = sliced.withColumns({f"_add_{v}": F.col(v) for v in values}).withColumn("_row", F.lit(1))
    opened = rows.unionByName(
        _offsets(sliced, group, values).withColumn("_row", F.lit(0)), allowMissingColumns=True)
    slice_ = W.partitionBy(*group, "_range").orderBy("_row", *order)
    earlier = slice_.rowsBetween(W.unboundedPreceding, -1)
    upto = slice_.rowsBetween(W.unboundedPreceding, 0)
    summed = opened.withColumns({
        **{f"before_{v}": F.sum(f"_add_{v}").over(earlier) for v in values},
        **{f"total_{v}": F.first(f"total_{v}").over(upto) for v in values}})
    return summed.filter("_row = 1").drop("_range", "_row", *[f"_add_{v}" for v in values])


def running_totals(df: DataFrame, group: Sequence[str], order: Sequence[str], values: Sequence[str],
                   cuts_from: DataFrame | None = None) -> DataFrame:
    """Add ``before_<v>`` (sum over earlier rows of the group) and
    ``total_<v>`` (sum over the group). Rows must be distinct on
    ``group + order``; grouping columns must not be NULL."""
    return _accumulate(with_range(df, order, cuts_from=cuts_from), group, order, values)


# -- numbering -----------------------------------------------------------------

def number_rows(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """0-based position of each row in its group under a total order."""
    one = df.withColumn("_one", F.lit(1).cast("bigint"))
    out = running_totals(one, group, order, ["_one"])
    return out.withColumnRenamed("before__one", name).drop("_one", "total__one")


def number_by_hash(df: DataFrame, group: Sequence[str], hash_col: str, tie: str, name: str) -> DataFrame:
    """0-based position in the group's pseudo-random order given by a 64-bit
    hash. The hash's high byte slices every group evenly, so no cut points are
    needed. Also adds ``<name>_total``, the group's size."""
    sliced = df.withColumn("_one", F.lit(1).cast("bigint")).withColumn(
        "_range", F.shiftrightunsigned(F.col(hash_col), 56).cast("int"))
    out = _accumulate(sliced, group, [hash_col, tie], ["_one"])
    return out.withColumnsRenamed({"before__one": name, "total__one": f"{name}_total"}).drop("_one")


def assign_dense_ids(df: DataFrame, key: str, name: str, start: int = 0) -> DataFrame:
    """Consecutive ids in key order; keys must be unique."""
    out = number_rows(df, [], [key], name)
    return out.withColumn(name, F.col(name) + F.lit(start)) if start else out


def rank_within_group(df: DataFrame, group: str, score: str, tie: str, name: str = "rank") -> DataFrame:
    """1-based rank by descending score; ties keep ascending ``tie`` order."""
    ordered = df.withColumn("_descending", -F.col(score))
    out = number_rows(ordered, [group], ["_descending", tie], name)
    return out.withColumn(name, F.col(name) + 1).drop("_descending")


def group_ids(df: DataFrame, group: str, row_id: str, name: str = "group_id") -> DataFrame:
    """Number groups 0.. in order of first appearance."""
    from pairscreen.operators.joins import salted_join

    first = df.groupBy(group).agg(F.min(row_id).alias("_first"))
    numbered = number_rows(first, [], ["_first"], name).select(group, name)
    return salted_join(df, numbered, [group])


# -- best row / best K -----------------------------------------------------------

def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Keep the first row of each key. Spark limits each key to one row per
    map task before the shuffle, so a hot key costs one row per task."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def top_k_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int,
                    name: str | None = None, salts: int | None = None) -> DataFrame:
    """First ``k`` rows of every group under a total order.

    Every map task keeps ``k`` rows per group before the shuffle; task numbers
    then spread a group over ``salts`` reducers, each of which passes on
    ``k`` rows, so the last step sees ``salts * k`` rows per group.
    """
    if k <= 0:
        empty = df.limit(0)
        return empty.withColumn(name, F.lit(0)) if name else empty
    n = salts or parallelism(df.sparkSession)
    salted = df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(n)))
    local = W.partitionBy(*group, "_salt").orderBy(*order)
    kept = salted.withColumn("_rn", F.row_number().over(local)).filter(F.col("_rn") <= k).drop("_rn", "_salt")
    final = W.partitionBy(*group).orderBy(*order)
    out = kept.withColumn("_rn", F.row_number().over(final)).filter(F.col("_rn") <= k)
    return out.withColumnRenamed("_rn", name) if name else out.drop("_rn")


def limit_distinct(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows of the first ``n`` distinct keys in sorted order."""
    if n <= 0:
        return df
    first = df.select(key).distinct().orderBy(key).limit(n)
    return df.join(first, key, "left_semi")
