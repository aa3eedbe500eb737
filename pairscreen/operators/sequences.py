"""Sequences, windows and residue-level vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairscreen.functions.text import clean_sequence, parse_number
from pairscreen.operators.joins import HOT_SHARE, salted_join
from pairscreen.operators.ordering import first_per_key
from pairscreen.session import materialize, parallelism

# Fixed values ---------------------------------------------------------------
WINDOW = 1024
STRIDE = 512
KEYS_SENT = 50_000
# ----------------------------------------------------------------------------


def valid_sequences(df: DataFrame, key: str, seq: str, strict: bool = False,
                    row_id: str | None = None) -> DataFrame:
    """Cleaned sequences, one per id.

    Lenient: rows whose id is not a number or whose sequence is empty are
    dropped. Strict: an empty sequence or a non-numeric id is an error.
    """
    number = parse_number(F.col(key).cast("string"))
    rows = df.withColumns({"_id": number, seq: clean_sequence(F.col(seq).cast("string"))})
    if strict:
        rows = rows.filter(F.col(key).isNotNull() & F.col(seq).isNotNull())
        broken = F.col("_id").isNull() | (F.col(seq) == "")
        rows = rows.filter(F.when(
            broken, F.raise_error(F.lit("empty sequence or unusable id")).cast("boolean")).otherwise(F.lit(True)))
    else:
        # One mention of the sequence, so that cleaning runs once in the filter.
        rows = rows.filter(F.col("_id").isNotNull() & ~F.lower(seq).isin("", "nan"))
    rows = rows.withColumn(key, F.col("_id").cast("bigint")).drop("_id")
    order = [F.col(row_id)] if row_id else [F.xxhash64(seq), F.col(seq)]
    return first_per_key(rows, [key], order)


def window_starts(length: Column, width: int = WINDOW, stride: int = STRIDE, tail_anchored: bool = False) -> Column:
    """0-based window starts.

    Sliding: every ``stride`` until a window reaches the end; the last may be
    short. Tail-anchored: all windows full, the last pinned to the end.
    """
    surplus = length - width
    if tail_anchored:
        regular = F.sequence(F.lit(0), surplus, F.lit(stride))
        return F.when(surplus <= 0, F.array(F.lit(0))).otherwise(F.array_union(regular, F.array(surplus)))
    steps = F.sequence(F.lit(0), F.ceil(surplus / F.lit(stride)).cast("int"))
    starts = F.transform(steps, lambda i: i * stride)
    if stride > width:  # a step may jump past the end
        starts = F.filter(starts, lambda s: s < length)
    return F.when(surplus <= 0, F.array(F.lit(0))).otherwise(starts)


def sequence_windows(df: DataFrame, seq: str, width: int = WINDOW, stride: int = STRIDE,
                     tail_anchored: bool = False) -> DataFrame:
    """One row per window: ``window, start, piece``."""
    starts = window_starts(F.length(seq), width, stride, tail_anchored)
    others = [c for c in df.columns if c != seq]
    # Cut before exploding: a row per window must not carry the whole sequence.
    pieces = F.transform(starts, lambda s: F.struct(
        s.alias("start"), F.substring(F.col(seq), s + 1, F.lit(width)).alias("piece")))
    return df.select(*others, F.posexplode(pieces).alias("window", "_w")).select(*others, "window", "_w.*")


def encoding_stats(windows: DataFrame, key: str) -> DataFrame:
    """Sequences cut into several windows, and all windows."""
    per = windows.groupBy(key).agg(F.count("*").alias("n"))
    return per.agg(
        F.count("*").alias("proteins"), F.count_if(F.col("n") > 1).alias("long_proteins"),
        F.sum("n").alias("total_windows"))


def embed(df: DataFrame, encoder: Callable, schema: T.StructType | str, partitions: int | None = None) -> DataFrame:
    """Run an encoder over Arrow batches of rows; ``schema`` is its output.

    Rows are spread evenly first (over the session's shuffle partitions, or
    ``partitions``), as windows of one long sequence would otherwise sit in one
    task. A hash of the row deals them out, so a task that runs again does the same.
    """
    keys = [F.col(f"`{f.name}`") for f in df.schema.fields if isinstance(f.dataType, T.AtomicType)]
    spread = df.repartition(partitions or parallelism(df.sparkSession), F.xxhash64(*keys) if keys else F.lit(0))
    return spread.mapInPandas(encoder, schema)


def _mean(vec: str) -> Column:
    return vector_to_array(Summarizer.mean(array_to_vector(F.col(vec))))


def pool_mean(tokens: DataFrame, key: str, vec: str = "vec", pool: str = "mean") -> DataFrame:
    """Sequence vector from residue tokens ``key, window, residue, vec``: the
    mean (or, for ``cls``, the first token) of each window, then the plain
    mean of the windows. Element-wise sums combine before the shuffle."""
    if pool == "mean":
        per_window = tokens.groupBy(key, "window").agg(_mean(vec).alias(vec))
    elif pool == "cls":
        per_window = first_per_key(tokens, [key, "window"], [F.col("residue")]).select(key, "window", vec)
    else:
        raise ValueError("pool must be mean or cls")
    return per_window.groupBy(key).agg(_mean(vec).alias(vec))


def stitch_windows(tokens: DataFrame, key: str, lengths: DataFrame | None = None, vec: str = "vec",
                   dims: int | None = None) -> DataFrame:
    """Residue vectors at their original position, overlaps averaged.

    ``tokens`` has ``key, start, offset, vec``; ``lengths`` (``key, length``)
    turns on the check that every residue is covered. The vectors gathered
    per residue are those of the windows over it, ``width / stride`` at most.
    Where vectors are narrow and all have ``dims`` elements, name it: elements are then plain sums,
    which combine before a shuffle, and a later choice of sequences is made before they are stitched.
    """
    if lengths is not None and not uncovered_sequences(tokens, key, lengths).isEmpty():
        raise ValueError("uncovered residues")
    placed = tokens.select(key, (F.col("start") + F.col("offset")).alias("residue_idx"),
                           F.col(vec).cast("array<double>").alias(vec))
    if dims is not None:
        return _summed(placed, key, vec, dims)
    gathered = placed.groupBy(key, "residue_idx").agg(F.collect_list(vec).alias("_v"))
    total = F.reduce(F.slice("_v", 2, F.size("_v")), F.get("_v", F.lit(0)),
                     lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y))
    mean = F.when(F.size("_v") == 1, F.get("_v", F.lit(0))).otherwise(
        F.transform(total, lambda x: x / F.size("_v")))
    return gathered.select(key, "residue_idx", mean.alias(vec))


def _summed(placed: DataFrame, key: str, vec: str, dims: int) -> DataFrame:
    """Means by element; like the gathered ones, NULL vectors do not count, and a NULL element leaves none."""
    fits = F.col(vec).isNull() | (F.size(vec) == dims)
    cells = placed.select(key, "residue_idx", F.when(
        fits, F.col(vec)).otherwise(F.raise_error(F.lit(f"vectors must have {dims} elements"))).alias(vec))
    n = F.count(vec)
    mean = F.array(*[F.when(F.count(c) == n, F.sum(c) / n) for c in (F.get(vec, F.lit(i)) for i in range(dims))])
    return cells.groupBy(key, "residue_idx").agg(F.when(n > 0, mean).alias(vec))


def uncovered_sequences(tokens: DataFrame, key: str, lengths: DataFrame) -> DataFrame:
    """Sequences whose windows leave a gap, judged from window extents; the
    vectors are not read."""
    extents = tokens.groupBy(key, "start").agg(
        F.count("*").alias("_n"), (F.max("offset") + 1).alias("_width"))
    before = W.partitionBy(key).orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    reached = F.coalesce(F.max(F.col("start") + F.col("_width")).over(before), F.lit(0))
    broken = extents.withColumn("_gap", (F.col("start") > reached) | (F.col("_n") < F.col("_width")))
    covered = broken.groupBy(key).agg(
        F.max("_gap").alias("_gap"), F.max(F.col("start") + F.col("_width")).alias("covered"))
    return (
        lengths.join(covered, key, "left")
        .filter(F.coalesce("_gap", F.lit(True)) | (F.col("covered") != F.col("length")))
        .select(key, "length", "covered")
    )


def center_crop(tokens: DataFrame, key: str, residue: str, limit: int) -> DataFrame:
    """At most ``limit`` residues per sequence, taken from the middle.

    Counts are written once and joined back instead of windowed, and a sequence that holds a
    large share of all residues is spread over tasks. Residues stream past the
    counts of their task and are never sorted.
    """
    sizes = materialize(tokens.groupBy(key).agg(F.count("*").alias("_n")), "sizes")
    keys, total = sizes.agg(F.count("*"), F.sum("_n")).first()
    hot = [r["h"] for r in sizes.filter(F.col("_n") > (total or 0) * HOT_SHARE).select(F.xxhash64(key).alias("h")).collect()]
    start = F.floor((F.col("_n") - limit) / 2)
    keep = (F.col("_n") <= limit) | ((F.col(residue) >= start) & (F.col(residue) < start + limit))
    counts = sizes.hint("shuffle_hash") if keys > KEYS_SENT else sizes
    return salted_join(tokens, counts, [key], "inner", hot=hot).filter(keep).drop("_n")


def gather_tokens(tokens: DataFrame, key: str, residue: str, vec: str = "vec") -> DataFrame:
    """``key, tokens``: a sequence's residue vectors in order, in one row. Crop first: a row holds
    all residues that are left."""
    rows = tokens.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(
        F.col(residue).alias("at"), F.col(vec).alias("v")))).alias("_t"))
    return rows.select(key, F.transform("_t", lambda t: t["v"]).alias("tokens"))


def token_manifest(tokens: DataFrame, keys: list[str], vec: str = "vec") -> DataFrame:
    """Length and vector width per sequence, sorted by id."""
    return tokens.groupBy(*keys).agg(
        F.count("*").alias("length"), F.max(F.size(vec)).alias("embedding_dim")).orderBy(*keys)


def unmapped_bank_rows(bank: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Bank rows that no token record covers."""
    return bank.join(manifest.select(key), key, "left_anti")
