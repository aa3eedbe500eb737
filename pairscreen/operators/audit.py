"""Audits of train/validation/test splits.

Frames hold all splits with a ``split`` column. Scaffold and cluster columns
are optional inputs.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairscreen.functions.text import normalize_id
from pairscreen.operators.pairs import DOMAINS, PAIR_KEYS, normalize_pairs

AXES = {"pairs": ("drug_id", "prot_id"), "drugs": ("drug_id",), "proteins": ("prot_id",),
        "scaffolds": ("scaffold",), "clusters": ("cluster",)}


def split_stats(df: DataFrame, split: str = "split") -> DataFrame:
    """Rows, exact repeats, conflicting pairs, distinct entities and label
    counts per split.

    One aggregate of numbers per pair carries everything: which labels and domains a pair has
    is one bit each. Rows whose label or domain breaks the rules of ``validate_pairs``
    have no bit, so they count as repeats. Distinct entities are counted from the
    far fewer rows of pairs, on normalised ids.
    """
    code = (F.col("label") + 1) * len(DOMAINS) + F.when(F.col("prot_domain") == DOMAINS[0], 0).when(F.col("prot_domain") == DOMAINS[1], 1)
    bit = F.when(F.col("label").isin(-1, 0, 1), F.call_function("shiftleft", F.lit(1), code.cast("int")))
    per_pair = normalize_pairs(df).groupBy(split, *PAIR_KEYS).agg(
        F.count("*").alias("rows"),
        *[F.count_if(F.col("label") == v).alias(n) for v, n in ((-1, "gray"), (0, "neg"), (1, "pos"))],
        F.bit_count(F.coalesce(F.bit_or(bit), F.lit(0))).alias("kinds"))
    main = per_pair.groupBy(split).agg(
        F.sum("rows").alias("rows"), (F.sum("rows") - F.sum("kinds")).alias("exact_duplicate_rows"),
        F.count_if((F.col("pos") > 0) & (F.col("neg") > 0)).alias("conflicting_pairs"),
        F.sum("gray").alias("label_gray"), F.sum("neg").alias("label_neg"), F.sum("pos").alias("label_pos"))
    # Distinct (entity) rows first, then a plain count: no task holds a split's id set.
    entities = _flat(per_pair, ["drugs", "proteins"], split).distinct().groupBy(split).agg(
        F.count_if(F.col("axis") == "drugs").alias("unique_drugs"),
        F.count_if(F.col("axis") == "proteins").alias("unique_proteins"))
    return main.join(entities, split)


def _axis_rows(df: DataFrame, axes: Sequence[str] | None, split: str) -> DataFrame:
    """``axis, value, split`` for every row and axis. Drug and protein ids are
    normalised first, so that ``7`` and ``7.0`` are one value."""
    ids = {c: normalize_id(F.col(c)) for c in PAIR_KEYS if c in df.columns}
    return _flat(df.withColumns(ids) if ids else df, axes, split)


def _flat(df: DataFrame, axes: Sequence[str] | None, split: str) -> DataFrame:
    """``axis, value, split`` of normalised rows; missing values have no place
    on an axis."""
    names = [a for a in (axes or AXES) if all(c in df.columns for c in AXES[a])]

    def value(columns: Sequence[str]) -> Column:
        text = [F.col(c).cast("string") for c in columns]
        # The first part's length keeps ("a", "bc") apart from ("ab", "c").
        return text[0] if len(text) == 1 else F.concat(F.length(text[0]).cast("string"), F.lit(":"), *text)

    cells = F.array(*[F.struct(F.lit(a).alias("axis"), value(AXES[a]).alias("value")) for a in names])
    long = df.select(split, F.explode(cells).alias("c")).select("c.axis", "c.value", split)
    return long.filter(F.col("value").isNotNull())


def axis_values(df: DataFrame, axes: Sequence[str] | None = None, split: str = "split") -> DataFrame:
    """Distinct ``axis, value, split``."""
    return _axis_rows(df, axes, split).distinct()


def split_overlap(df: DataFrame, splits: Sequence[str], axes: Sequence[str] | None = None,
                  split: str = "split") -> DataFrame:
    """Values shared by each pair of splits, per axis.

    Each value becomes one row with a flag per split, so overlaps are counted
    without joining splits to each other.
    """
    flags = split_flags(df, splits, axes, split)
    cells = F.array(*[
        F.struct(F.lit(a).alias("split_a"), F.lit(b).alias("split_b"),
                 (F.col(f"_in_{i}") & F.col(f"_in_{j}")).alias("shared"))
        for (i, a), (j, b) in combinations(enumerate(splits), 2)])
    return flags.select("axis", F.explode(cells).alias("c")).groupBy("axis", "c.split_a", "c.split_b").agg(
        F.count_if(F.col("c.shared")).alias("shared"))


def split_flags(df: DataFrame, splits: Sequence[str], axes: Sequence[str] | None = None,
                split: str = "split") -> DataFrame:
    """One row per value and axis with a flag per split."""
    return _axis_rows(df, axes, split).groupBy("axis", "value").agg(
        *[F.max(F.col(split) == s).alias(f"_in_{i}") for i, s in enumerate(splits)])


def holdout_leakage(df: DataFrame, held_out: Sequence[str], training: Sequence[str],
                    axes: Sequence[str] = ("scaffolds", "clusters"), split: str = "split") -> DataFrame:
    """Held-out values that also occur in each training split."""
    splits = [*training, *held_out]
    flags = split_flags(df, splits, axes, split)
    outside = F.lit(False)
    for i in range(len(training), len(splits)):
        outside = outside | F.col(f"_in_{i}")
    cells = F.array(*[
        F.struct(F.lit(s).alias("split"), (F.col(f"_in_{i}") & outside).alias("leaked"))
        for i, s in enumerate(training)])
    return flags.select("axis", F.explode(cells).alias("c")).groupBy("c.split", "axis").agg(
        F.count_if(F.col("c.leaked")).alias("heldout_in_training"))


def precision_coverage(df: DataFrame, group: str, sizes: Sequence[int] = (10, 50)) -> DataFrame:
    """Per K: groups with at least K definitive rows and their mean share of
    positives, the level that random ranking would reach."""
    pools = df.filter(F.col("label").isin(0, 1)).groupBy(group).agg(
        F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("n_pos"))
    cells = F.array(*[F.lit(k) for k in sizes])
    return pools.select("n", "n_pos", F.explode(cells).alias("k")).groupBy("k").agg(
        F.count_if(F.col("n") >= F.col("k")).alias("eligible_proteins"),
        F.avg(F.when(F.col("n") >= F.col("k"), F.col("n_pos") / F.col("n"))).alias("positive_prevalence"))


