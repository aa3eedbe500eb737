"""Training losses as aggregates over scored pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairscreen.functions.vectors import sigmoid, softplus
from pairscreen.operators.pairs import valid_groups

# Fixed values ---------------------------------------------------------------
GRAY_TARGET = 0.20
GRAY_WEIGHT = 0.03
FOCAL_FLOOR = 1e-6
# ----------------------------------------------------------------------------
#: Scores of one side that meet the other side's at once.
BLOCK = 2048


def soft_target(gray_target: float = GRAY_TARGET) -> Column:
    return F.when(F.col("label") == -1, F.lit(gray_target)).otherwise(F.col("label").cast("double"))


def row_weight(gray_weight: float = GRAY_WEIGHT) -> Column:
    return F.when(F.col("label") == -1, F.lit(gray_weight)).otherwise(F.lit(1.0))


def bce(logit: Column, target: Column, pos_weight: float | Column = 1.0) -> Column:
    """Binary cross-entropy on a logit with a weight on the positive part."""
    pw = pos_weight if isinstance(pos_weight, Column) else F.lit(float(pos_weight))
    return pw * target * softplus(-logit) + (F.lit(1.0) - target) * softplus(logit)


def _weighted(df: DataFrame, loss: Column, weight: Column, name: str) -> DataFrame:
    return df.select(loss.alias("l"), weight.alias("w")).agg(
        (F.sum(F.col("l") * F.col("w")) / F.greatest(F.sum("w"), F.lit(1.0))).alias(name))


def weighted_bce(df: DataFrame, logit: str, pos_weight: float, gray_target: float = GRAY_TARGET,
                 gray_weight: float = GRAY_WEIGHT) -> DataFrame:
    return _weighted(df, bce(F.col(logit), soft_target(gray_target), pos_weight), row_weight(gray_weight), "bce")


def focal_loss(df: DataFrame, logit: str, pos_weight: float, alpha: float = 0.25, gamma: float = 2.0,
               gray_target: float = GRAY_TARGET, gray_weight: float = GRAY_WEIGHT) -> DataFrame:
    target, prob = soft_target(gray_target), sigmoid(F.col(logit))
    agreement = prob * target + (1 - prob) * (1 - target)
    balance = alpha * target + (1 - alpha) * (1 - target)
    focus = F.pow(F.greatest(1 - agreement, F.lit(FOCAL_FLOOR)), F.lit(float(gamma)))
    return _weighted(df, balance * focus * bce(F.col(logit), target, pos_weight), row_weight(gray_weight), "focal")


def rank_bce(df: DataFrame, logit: str) -> DataFrame:
    return df.filter(F.col("label").isin(0, 1)).agg(
        F.avg(bce(F.col(logit), F.col("label").cast("double"))).alias("rank_bce"))


def _pairwise(df: DataFrame, group: str, logit: str, loss: Callable[[np.ndarray], np.ndarray], name: str) -> DataFrame:
    """Mean over groups of the mean loss of positive/negative gaps, over every
    pair and without a pair row.

    Equal scores of a side are one weighted score. Each side of a group is cut
    into blocks of about ``BLOCK`` scores, by a hash of the score; a block of positives
    meets each block of negatives in one row of two arrays, whose gaps are
    summed as matrices. A hot group is so spread over many rows.
    """
    hard = df.filter(F.col("label").isin(0, 1)).groupBy(group, "label", F.col(logit).cast("double").alias("_x")).agg(
        F.count("*").cast("double").alias("_w"))
    sizes = valid_groups(hard, group).select(group, *[
        F.ceil(F.col(n) / BLOCK).cast("int").alias(f"_blocks_{k}") for n, k in (("n_neg", 0), ("n_pos", 1))])
    placed = hard.join(sizes, group).withColumn("_block", F.pmod(
        F.xxhash64("_x"), F.when(F.col("label") == 1, F.col("_blocks_1")).otherwise(F.col("_blocks_0"))))
    blocks = placed.groupBy(group, "label", "_block").agg(F.collect_list(F.struct("_x", "_w")).alias("_xs"))

    def side(label: int, column: str) -> DataFrame:
        return blocks.filter(F.col("label") == label).select(
            group, F.col("_xs._x").alias(column), F.col("_xs._w").alias(f"{column}w"))

    schema = T.StructType([df.schema[group], T.StructField("_sum", T.DoubleType()), T.StructField("_n", T.DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            sums, counts = [], []
            for i in range(batch.num_rows):
                p, pw, n, nw = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("_p", "_pw", "_n", "_nw"))
                sums.append(sum(w * float(loss(x - n) @ nw) for x, w in zip(p, pw)))
                counts.append(float(pw.sum() * nw.sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums, pa.float64()), pa.array(counts, pa.float64())],
                                             names=schema.names)

    summed = side(1, "_p").join(side(0, "_n"), group).select(group, "_p", "_pw", "_n", "_nw").mapInArrow(run, schema)
    per_group = summed.groupBy(group).agg((F.sum("_sum") / F.sum("_n")).alias("l"))
    return per_group.agg(F.coalesce(F.avg("l"), F.lit(0.0)).alias(name))


def bpr_loss(df: DataFrame, group: str, logit: str) -> DataFrame:
    """Mean over groups of the mean softplus(-gap) over positive/negative pairs."""
    return _pairwise(df, group, logit, lambda gap: np.logaddexp(0.0, -gap), "bpr")


def margin_loss(df: DataFrame, group: str, logit: str, margin: float = 0.2) -> DataFrame:
    """Mean over groups of the mean max(margin - gap, 0)."""
    return _pairwise(df, group, logit, lambda gap: np.maximum(margin - gap, 0.0), "margin")
