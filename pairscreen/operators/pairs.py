"""Hygiene of labelled compound-protein pairs.

A pair table has ``drug_id, prot_id, label in {-1, 0, 1}, prot_domain in
{human, virus}`` and a ``row_id`` that fixes row order. Label -1 ("gray") is
uncertain evidence; 0 and 1 are definitive ("hard").
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairscreen.functions.text import normalize_id, number_of, protein_name, strip

# Fixed values ---------------------------------------------------------------
PAIR_COLUMNS = ("drug_id", "prot_id", "label", "prot_domain")
PAIR_KEYS = ["drug_id", "prot_id"]
LABELS = (-1, 0, 1)
HARD_LABELS = (0, 1)
DOMAINS = ("human", "virus")
STAGES = {
    "pretrain": ("human", "gray"),
    "cls_train": ("virus", "gray"),
    "rank_train": ("virus", "binary"),
    "val": ("virus", "binary"),
    "test": ("virus", "binary"),
}
# ----------------------------------------------------------------------------


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """The row's own id, or one made from its content. Ids made from places
    change with the partitioning and with every evaluation. Equal rows share an
    id, which the first-row rule cannot tell apart anyway."""
    if name in df.columns:
        return df
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\u0000")) for c in sorted(PAIR_COLUMNS) if c in df.columns]
    return df.withColumn(name, F.xxhash64(*cells))


def normalize_pairs(df: DataFrame) -> DataFrame:
    """Normalised ids, integer label (NULL if unusable) and domain."""
    require_columns(df, PAIR_COLUMNS)
    number = number_of(df, "label")
    return df.withColumns({
        "drug_id": normalize_id(F.col("drug_id")),
        "prot_id": normalize_id(F.col("prot_id")),
        "label": F.when(number.isin(*[float(v) for v in LABELS]), number.cast("int")),
        "prot_domain": F.lower(strip(F.col("prot_domain").cast("string"))),
    })


def _violations() -> list[tuple[str, Column]]:
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return [
        ("empty_drug_id", empty("drug_id")),
        ("empty_prot_id", empty("prot_id")),
        ("bad_label", F.col("label").isNull()),
        ("bad_domain", ~F.coalesce(F.col("prot_domain").isin(*DOMAINS), F.lit(False))),
    ]


def pair_violations(df: DataFrame) -> DataFrame:
    """One row: how many rows break each rule."""
    return normalize_pairs(df).agg(*[F.count_if(bad).alias(name) for name, bad in _violations()])


def validate_pairs(df: DataFrame) -> None:
    found = {k: v for k, v in pair_violations(df).first().asDict().items() if v}
    if found:
        raise ValueError(f"invalid pairs: {found}")


def _fail_if(bad: Column, message: str | Column) -> Column:
    """Filter condition that is always true or ends the job, so checking
    costs no extra pass."""
    text = message if isinstance(message, Column) else F.lit(message)
    return F.when(bad, F.raise_error(text).cast("boolean")).otherwise(F.lit(True))


def pair_evidence(df: DataFrame, row_id: str = "row_id", strict: bool = True, carry: Sequence[str] = ()) -> DataFrame:
    """One row per pair: how often each label and domain was seen, and the
    first row of each label (with ``carry``, its further columns as structs).

    A single hash aggregate over plain numbers, combined before the shuffle,
    so a pair that holds a third of all rows reaches its reducer as one
    partial row per task.
    """
    rows = normalize_pairs(with_row_id(df, row_id))
    hit = lambda v: F.col("label") == v
    # The number of a broken rule rides along in the same aggregate.
    rules = _violations()
    broken = F.coalesce(*[F.when(bad, F.lit(i)) for i, (_, bad) in enumerate(rules)])
    checked = [F.min(broken).alias("_broken")] if strict else []
    # The columns ride along with the id, so both are of one row. Rows of one
    # id are told apart by the columns themselves.
    cells = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else None
    carried = [F.min(F.when(hit(v), F.struct(F.col(row_id).alias("id"), cells.alias("of")))).alias(f"_of_{name}")
               for v, name in ((1, "pos"), (0, "neg"), (-1, "gray"))] if carry else []
    evidence = rows.groupBy(*PAIR_KEYS).agg(
        *checked,
        F.count("*").alias("n_rows"),
        F.count_if(hit(1)).alias("n_pos"),
        F.count_if(hit(0)).alias("n_neg"),
        F.count_if(hit(-1)).alias("n_gray"),
        F.count_if(F.col("prot_domain") == "human").alias("n_human"),
        F.count_if(F.col("prot_domain") == "virus").alias("n_virus"),
        F.min(F.when(hit(1), F.col(row_id))).alias("first_pos"),
        F.min(F.when(hit(0), F.col(row_id))).alias("first_neg"),
        F.min(F.when(hit(-1), F.col(row_id))).alias("first_gray"),
        *carried,
    )
    if strict:
        names = F.get(F.array(*[F.lit(name) for name, _ in rules]), F.col("_broken"))
        evidence = evidence.filter(_fail_if(
            F.col("_broken").isNotNull(), F.concat(F.lit("invalid pair row: "), names))).drop("_broken")
    return evidence


def is_conflict() -> Column:
    return (F.col("n_pos") > 0) & (F.col("n_neg") > 0)


def is_mixture() -> Column:
    return (F.col("n_gray") > 0) & ((F.col("n_pos") > 0) != (F.col("n_neg") > 0))


def clean_pairs(df: DataFrame, row_id: str = "row_id", on_mixture: str = "error",
                strict: bool = True, carry: Sequence[str] = ()) -> DataFrame:
    """One row per usable pair.

    Pairs with both hard labels go entirely, gray rows included; exact
    repeats shrink to the first row. A pair with one hard and a gray label has
    no defensible answer: ``error`` (default) stops, ``drop`` removes the
    pair, ``keep_hard`` keeps the hard row. ``carry`` brings further columns
    of the surviving row, out of the same aggregate. Without a ``row_id``
    column, ids come from the pair itself.
    """
    if on_mixture not in ("error", "drop", "keep_hard"):
        raise ValueError("on_mixture must be error, drop or keep_hard")
    evidence = pair_evidence(df, row_id, strict, carry)
    if strict:
        evidence = evidence.filter(_fail_if(
            (F.col("n_human") > 0) & (F.col("n_virus") > 0), "one drug and protein occur under human and virus"))
    kept = evidence.filter(~is_conflict())
    if on_mixture == "error":
        kept = kept.filter(_fail_if(is_mixture(), "a pair has a hard and a gray label: choose on_mixture"))
    elif on_mixture == "drop":
        kept = kept.filter(~is_mixture())
    out = kept.select(
        F.coalesce("first_pos", "first_neg", "first_gray").alias(row_id),
        *PAIR_KEYS,
        F.when(F.col("n_pos") > 0, 1).when(F.col("n_neg") > 0, 0).otherwise(-1).alias("label"),
        F.when(F.col("n_virus") > 0, "virus").otherwise("human").alias("prot_domain"),
        *([F.coalesce("_of_pos", "_of_neg", "_of_gray").alias("_of")] if carry else []),
    )
    return out.select(*out.columns[:-1], *[F.col("_of.of").getField(c).alias(c) for c in carry]) if carry else out


def clean_pairs_stats(df: DataFrame, row_id: str = "row_id", on_mixture: str = "drop",
                      strict: bool = False) -> DataFrame:
    """One row of counts; ``mixture_rows_removed`` is zero when mixtures stop
    the job or keep their hard row only loses repeats."""
    e = pair_evidence(df, row_id, strict)
    mixed = is_mixture() & ~is_conflict()
    labels = ((F.col("n_pos") > 0).cast("int") + (F.col("n_neg") > 0).cast("int")
              + (F.col("n_gray") > 0).cast("int"))
    survives = ~is_conflict()
    removed_mixture = {"drop": labels, "keep_hard": labels - 1, "error": F.lit(0)}[on_mixture]
    out = e.agg(
        F.sum("n_rows").alias("input_rows"),
        F.count_if(is_conflict()).alias("conflicting_pairs_removed"),
        F.sum(F.when(is_conflict(), F.col("n_rows")).otherwise(0)).alias("conflicting_rows_removed"),
        F.sum(F.when(survives, F.col("n_rows") - labels).otherwise(0)).alias("duplicate_rows_removed"),
        F.sum(F.when(mixed, removed_mixture).otherwise(0)).cast("bigint").alias("mixture_rows_removed"),
    )
    return out.withColumn("output_rows", F.col("input_rows") - F.col("conflicting_rows_removed")
                          - F.col("duplicate_rows_removed") - F.col("mixture_rows_removed"))


def conflicting_pairs(df: DataFrame, row_id: str = "row_id", strict: bool = False) -> DataFrame:
    return pair_evidence(df, row_id, strict).filter(is_conflict()).select(*PAIR_KEYS, "n_rows")


def conflict_exclusion(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    """All rows except those of pairs with both hard labels."""
    return normalize_pairs(with_row_id(df, row_id)).join(
        conflicting_pairs(df, row_id).select(*PAIR_KEYS), PAIR_KEYS, "left_anti")


def label_filter(df: DataFrame, mode: str = "binary") -> DataFrame:
    """Definitive rows (``binary``) or also gray ones; others are dropped."""
    if mode not in ("binary", "gray"):
        raise ValueError("label mode must be binary or gray")
    wanted = HARD_LABELS if mode == "binary" else LABELS
    number = number_of(df, "label")
    return df.filter(number.isin(*[float(v) for v in wanted])).withColumn("label", number.cast("int"))


def domain_filter(df: DataFrame, domain: str) -> DataFrame:
    require_columns(df, ["prot_domain"])
    if domain not in DOMAINS:
        raise ValueError("domain must be human or virus")
    return df.filter(F.lower(F.col("prot_domain")) == domain)


def definitive_pairs(df: DataFrame, check: bool = True) -> DataFrame:
    out = df.filter(F.col("label").isin(*HARD_LABELS))
    if check and out.isEmpty():
        raise ValueError("no row to evaluate: all labels are gray")
    return out


def stage_dataset(df: DataFrame, stage: str) -> DataFrame:
    domain, mode = STAGES[stage]
    return label_filter(domain_filter(df, domain), mode)


def pos_weight(df: DataFrame) -> DataFrame:
    """Negatives per positive, 1 where there are no positives."""
    pos, neg = F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)
    return df.agg(F.when(pos > 0, neg / pos).otherwise(F.lit(1.0)).alias("pos_weight"))


def dataset_summary(raw: DataFrame, selected: DataFrame, final: DataFrame) -> DataFrame:
    """Row counts through the stages and the label make-up of the last."""
    named = final.withColumn("_protein", protein_name(final))
    pos, neg = F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)
    last = named.agg(
        F.count("*").alias("final_rows"), pos.alias("pos"), neg.alias("neg"),
        F.count_if(F.col("label") == -1).alias("gray"),
        (pos / F.greatest(pos + neg, F.lit(1))).alias("pos_rate_01"),
        F.count_distinct("_protein").alias("n_proteins"),
    )
    counts = (
        raw.select(F.lit("raw").alias("s")).unionAll(selected.select(F.lit("selected").alias("s")))
        .agg(F.count_if(F.col("s") == "raw").alias("raw_rows"),
             F.count_if(F.col("s") == "selected").alias("selected_rows"))
    )
    key = F.lit(1).alias("_one")
    return counts.select(key, "*").join(last.select(key, "*"), "_one").drop("_one")


def valid_groups(df: DataFrame, group: str) -> DataFrame:
    """Groups that have both a positive and a negative row."""
    return (
        df.groupBy(group)
        .agg(F.count_if(F.col("label") == 1).alias("n_pos"), F.count_if(F.col("label") == 0).alias("n_neg"))
        .filter((F.col("n_pos") > 0) & (F.col("n_neg") > 0))
    )
