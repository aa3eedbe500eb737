"""Expressions over ARRAY<FLOAT> feature vectors and logits."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values ---------------------------------------------------------------
PREFERRED_VECTOR_COLUMNS = (
    "embeddings", "embedding", "features", "feature", "feat",
    "x", "X", "fp", "fps", "ecfp", "unimol",
)
VIEW_WIDTHS = {"ecfp4": 2048, "maccs": 167, "rdkit2d": 208}
CLIP = 10.0
NORM_EPSILON = 1e-5
# ----------------------------------------------------------------------------

PAIR_MODES = ("concat_only", "concat_product", "concat_product_absdiff", "full_bilinear")


def sigmoid(c: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))


def softplus(c: Column) -> Column:
    """log(1 + e^c) without overflow."""
    return F.greatest(c, F.lit(0.0)) + F.log1p(F.exp(-F.abs(c)))


def finite(c: Column) -> Column:
    """The value as DOUBLE, NULL where it is NaN or infinite."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))), d)


def vec_sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return vec_sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def vec_mean(v: Column) -> Column:
    return vec_sum(v) / F.size(v)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row, not once per
    use inside the body's own lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def vec_std(v: Column) -> Column:
    """Population standard deviation of an array's elements."""
    return bind(vec_mean(v), lambda m: F.sqrt(vec_mean(F.transform(v, lambda x: (x - m) * (x - m)))))


def standardize_vector(v: Column, median: Column, mean: Column, std: Column) -> Column:
    """Impute non-finite elements with the median, z-score and clip."""

    def one(cell: Column) -> Column:
        value = F.coalesce(finite(cell["v"]), cell["median"])
        return F.least(F.lit(CLIP), F.greatest(F.lit(-CLIP), (value - cell["mean"]) / cell["std"]))

    zipped = F.arrays_zip(v.alias("v"), median.alias("median"), mean.alias("mean"), std.alias("std"))
    return F.transform(zipped, one)


def split_views(v: Column, widths: Sequence[int]) -> list[Column]:
    """One slice per view, in layout order; the widths must add up."""
    total = sum(widths)
    checked = F.when(F.size(v) == total, v).otherwise(
        F.raise_error(F.concat(F.lit(f"vector length differs from {total}: "), F.size(v).cast("string")))
    )
    starts = [sum(widths[:i]) + 1 for i in range(len(widths))]
    return [F.slice(checked, start, width) for start, width in zip(starts, widths)]


def concat_views(*views: Column) -> Column:
    return F.concat(*views)


def mask_views(v: Column, widths: Sequence[int], active: Sequence[float]) -> Column:
    """Scale each view's segment by its 0/1 weight."""
    if len(widths) != len(active):
        raise ValueError("one weight per view is required")

    def weight(position: Column) -> Column:
        expr = F.lit(float(active[-1]))
        for i in reversed(range(len(widths) - 1)):
            expr = F.when(position < sum(widths[: i + 1]), float(active[i])).otherwise(expr)
        return expr

    return F.transform(v, lambda x, i: x * weight(i))


def matvec(weights: Sequence[Sequence[float]], v: Column) -> Column:
    """Product of a small constant matrix (rows x len(v)) and a vector."""
    rows = F.array(*[F.array(*[F.lit(float(w)) for w in row]) for row in weights])
    return F.transform(rows, lambda row: dot(row, v))


def pair_features(
    drug: Column,
    protein: Column,
    mode: str = "full_bilinear",
    drug_weights: Sequence[Sequence[float]] | None = None,
    protein_weights: Sequence[Sequence[float]] | None = None,
) -> Column:
    """Joint vector of a pair: both vectors, then product, absolute
    difference and bilinear terms as the mode asks."""
    if mode not in PAIR_MODES:
        raise ValueError(f"mode must be one of {PAIR_MODES}")
    level = PAIR_MODES.index(mode)
    d = F.transform(drug, lambda x: x.cast("double"))
    p = F.transform(protein, lambda x: x.cast("double"))
    parts = [d, p]
    if level >= 1:
        parts.append(F.zip_with(d, p, lambda x, y: x * y))
    if level >= 2:
        parts.append(F.zip_with(d, p, lambda x, y: F.abs(x - y)))
    if level >= 3:
        if drug_weights is None or protein_weights is None:
            raise ValueError("full_bilinear needs both weight matrices")
        parts.append(F.zip_with(matvec(drug_weights, d), matvec(protein_weights, p), lambda x, y: x * y))
    return F.concat(*parts)


def layer_norm(v: Column) -> Column:
    """Zero-mean, unit-variance vector (no learnt scale)."""
    stats = lambda w: F.struct(vec_mean(w).alias("m"), vec_std(w).alias("s"))
    return bind(v, lambda w: bind(stats(w), lambda t: F.transform(
        w, lambda x: (x - t["m"]) / F.sqrt(t["s"] * t["s"] + F.lit(NORM_EPSILON)))))


def boundary_trim(tokens: Column, n_residues: Column) -> Column:
    """Drop the begin and end tokens only when exactly two are surplus."""
    return (
        F.when(F.size(tokens) == n_residues, tokens)
        .when(F.size(tokens) == n_residues + 2, F.slice(tokens, F.lit(2), n_residues))
        .otherwise(F.raise_error(F.concat(
            F.lit("cannot align tokens with residues: "), F.size(tokens).cast("string"),
            F.lit(" tokens for "), n_residues.cast("string"))))
    )
