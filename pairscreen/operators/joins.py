"""Lookups and joins that stay balanced when one key is hot."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairscreen.functions.text import DRUG_COLUMNS, PROTEIN_COLUMNS, as_text, norm_keys, present
from pairscreen.operators.ordering import first_per_key, number_rows
from pairscreen.session import materialize, parallelism

HOT_SHARE = 1 / 64


# -- skew ------------------------------------------------------------------------

def hot_keys(df: DataFrame, keys: Sequence[str], share: float = HOT_SHARE) -> list[int]:
    """Hashes of every key that may hold more than ``share`` of the rows.

    One column-pruned pass with a bounded counter per task; misses no such
    key and returns at most ``1 / share`` of them.
    """
    hashed = df.select(F.xxhash64(*keys).alias("h"))
    row = hashed.stat.freqItems(["h"], share).collect()
    return [int(h) for h in (row[0][0] or [])] if row else []


def salted_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left",
                salts: int | None = None, hot_from: DataFrame | None = None, hot: Sequence[int] | None = None) -> DataFrame:
    """Equi-join of a large, possibly skewed left side with a right side whose
    keys are unique. Only hot keys are spread (left) and copied (right).
    NULL keys match NULL keys. ``hot_from`` may name a frame with the same
    keys that is cheaper to read than ``left``, ``hot`` the hashes of hot keys where they are known."""
    if how not in ("left", "inner"):
        raise ValueError("how must be left or inner")
    if hot is None:
        hot = hot_keys(hot_from if hot_from is not None else left, on)
    n = salts or parallelism(left.sparkSession)
    left_key, right_key = F.xxhash64(*on), F.xxhash64(*[F.col(f"_r_{c}") for c in on])
    renamed = right.select(*[F.col(c).alias(f"_r_{c}" if c in on else c) for c in right.columns])
    if hot:
        # A hash of the row itself, not of its place: a task that runs again
        # after an executor is lost must send each row the same way.
        row = [f.name for f in left.schema.fields if isinstance(f.dataType, T.AtomicType)]
        spread = left.withColumn("_salt", F.when(
            left_key.isin(hot), F.pmod(F.xxhash64(F.lit(n), *row), F.lit(n)).cast("int")).otherwise(0))
        copied = renamed.withColumn("_r_salt", F.explode(F.when(
            right_key.isin(hot), F.sequence(F.lit(0), F.lit(n - 1))).otherwise(F.array(F.lit(0)))))
    else:
        spread = left.withColumn("_salt", F.lit(0))
        copied = renamed.withColumn("_r_salt", F.lit(0))
    condition = F.col("_salt") == F.col("_r_salt")
    for c in on:
        condition = condition & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    joined = spread.join(copied, condition, how)
    return joined.drop("_salt", "_r_salt", *[f"_r_{c}" for c in on])


# -- per-key plug-in ---------------------------------------------------------------

def map_distinct(df: DataFrame, key: str, fn: Callable, schema: T.StructType | str,
                 partitions: int | None = None) -> DataFrame:
    """Left-join ``fn``'s result to every row, running ``fn`` once per
    distinct key.

    ``fn`` receives an iterator of pandas batches holding the key column and
    yields batches with the key and result columns (``schema`` lists both).
    Its output is written before the join, so the expensive step never reruns
    when a consumer scans the result twice.
    """
    n = partitions or 4 * parallelism(df.sparkSession)
    keys = df.select(key).filter(F.col(key).isNotNull()).distinct().repartition(n, key)
    results = materialize(keys.mapInPandas(fn, schema), "map-distinct")
    return salted_join(df, results, [key])


# -- feature-bank lookup -------------------------------------------------------------

def alias_index(bank: DataFrame, aliases: Sequence[str], idx: str = "idx") -> DataFrame:
    """``(alias, idx)`` with one row per alias key. Where two bank rows claim
    a key, the earlier alias column wins, then the earlier row."""
    tagged = F.array(*[
        F.struct(F.lit(i).alias("column"), norm_keys(as_text(bank, name)).alias("keys"))
        for i, name in enumerate(aliases)
    ])
    flat = (
        bank.select(F.col(idx).alias("idx"), F.explode(tagged).alias("t"))
        .select("idx", F.col("t.column").alias("column"), F.explode("t.keys").alias("alias"))
    )
    # MIN of one small struct of numbers: partial results combine before the shuffle.
    best = flat.groupBy("alias").agg(F.min(F.struct("column", "idx")).alias("best"))
    return best.select("alias", F.col("best.idx").alias("idx"))


def alias_lookup(df: DataFrame, columns: Sequence[str], index: DataFrame, name: str,
                 keys_from: DataFrame | None = None) -> DataFrame:
    """Add the bank index found through the first candidate column (and key
    form) that hits; NULL where none does.

    Rows are first reduced to their distinct candidate tuples, so the lookup
    joins entities and not pairs. ``keys_from`` may name a cheaper frame with
    the same candidates.
    """
    source = keys_from if keys_from is not None else df
    used = present(source, list(columns))
    if not used:
        return df.withColumn(name, F.lit(None).cast("bigint"))
    entities = source.select(*used).distinct()
    candidates = F.flatten(F.array(*[norm_keys(as_text(df, c)) for c in used]))
    options = entities.select(*used, F.posexplode(candidates).alias("priority", "alias"))
    hits = options.join(index, "alias")
    found = hits.groupBy(*used).agg(F.min(F.struct("priority", "idx")).alias("best"))
    return salted_join(df, found.select(*used, F.col("best.idx").alias(name)), used, hot_from=source)


def attach_features(pairs: DataFrame, drug_index: DataFrame, protein_index: DataFrame,
                    second_drug_index: DataFrame | None = None) -> DataFrame:
    """Add ``drug_idx``, ``prot_idx`` (and ``drug2_idx``); NULL marks a miss."""
    out = alias_lookup(pairs, DRUG_COLUMNS, drug_index, "drug_idx")
    if second_drug_index is not None:
        out = alias_lookup(out, DRUG_COLUMNS, second_drug_index, "drug2_idx", keys_from=pairs)
    return alias_lookup(out, PROTEIN_COLUMNS, protein_index, "prot_idx", keys_from=pairs)


def _index_columns(df: DataFrame) -> list[str]:
    return present(df, ["drug_idx", "drug2_idx", "prot_idx"])


def matched(attached: DataFrame) -> DataFrame:
    """Only rows found in every bank."""
    return attached.dropna(subset=_index_columns(attached))


def missing_counts(attached: DataFrame) -> DataFrame:
    """Misses per bank and rows with any miss."""
    labels = {"drug_idx": "missing_ecfp", "drug2_idx": "missing_unimol", "prot_idx": "missing_prot"}
    cols = _index_columns(attached)
    any_miss = F.lit(False)
    for c in cols:
        any_miss = any_miss | F.col(c).isNull()
    return attached.agg(
        *[F.count_if(F.col(c).isNull()).alias(labels[c]) for c in cols],
        F.count_if(any_miss).alias("missing_any"),
    )


# -- completeness checks ---------------------------------------------------------------

def missing_ids(required: DataFrame, available: DataFrame, key: str) -> DataFrame:
    """Distinct required keys that the other table lacks."""
    return required.select(key).distinct().join(available.select(key), key, "left_anti")


def require_ids(required: DataFrame, available: DataFrame, key: str) -> None:
    count = missing_ids(required, available, key).count()
    if count:
        raise ValueError(f"{count} required values of {key} are missing")


def id_order_differences(a: DataFrame, b: DataFrame, key: str, order: str) -> DataFrame:
    """Keys whose positions differ between two tables, or that only one has."""
    left = number_rows(a.select(key, order), [], [order], "pos_a").select(key, "pos_a")
    right = number_rows(b.select(key, order), [], [order], "pos_b").select(key, "pos_b")
    return left.join(right, key, "full_outer").filter(~F.col("pos_a").eqNullSafe(F.col("pos_b")))


def assert_same_ids(a: DataFrame, b: DataFrame, key: str, order: str | None = None) -> None:
    """Fail unless both tables hold the same ids (in the same order when an
    order column is named)."""
    if order is not None:
        differing = id_order_differences(a, b, key, order)
    else:
        counted = a.select(key, F.lit(1).alias("n")).unionByName(b.select(key, F.lit(-1).alias("n")))
        differing = counted.groupBy(key).agg(F.sum("n").alias("n")).filter("n <> 0")
    if not differing.isEmpty():
        raise ValueError(f"tables differ on {key}")


def eligible_ids(metadata: DataFrame, library: DataFrame, metadata_key: str = "drug_key",
                 library_key: str = "drug_key", predicate: str | None = None,
                 id_col: str = "drug_id") -> DataFrame:
    """Library ids whose key passes a SQL predicate over a metadata table."""
    chosen = metadata.filter(F.expr(predicate)) if predicate else metadata
    keys = chosen.select(F.col(metadata_key).cast("string").alias("_key"))
    return (
        library.select(id_col, F.col(library_key).cast("string").alias("_key"))
        .join(keys, "_key", "left_semi").select(id_col).distinct()
    )


def target_lookup(targets: DataFrame, bank: DataFrame, vec: str = "vec") -> DataFrame:
    """Each target's vector by ``protein_key``, else by ``prot_id``; NULL
    where neither is known. In the bank a ``protein_key`` outranks another
    row's ``prot_id``; of equal keys the later row counts, of equal ids the earlier."""
    names = F.array(
        F.struct(F.lit(0).alias("column"), F.col("protein_key").cast("string").alias("name")),
        F.struct(F.lit(1).alias("column"), F.col("prot_id").cast("string").alias("name")),
    )
    flat = bank.select("idx", F.explode(names).alias("n")).select("idx", "n.column", "n.name")
    # A later protein_key row replaces an earlier one; a prot_id only fills gaps.
    best = flat.groupBy("name").agg(F.min(F.struct(
        "column", F.when(F.col("column") == 0, -F.col("idx")).otherwise(F.col("idx")).alias("rank"),
        "idx")).alias("best")).select("name", F.col("best.idx").alias("idx"))
    by_key = best.select(F.col("name").alias("_k"), F.col("idx").alias("_by_key"))
    by_id = best.select(F.col("name").alias("_p"), F.col("idx").alias("_by_id"))
    found = (
        targets.join(by_key, F.col("protein_key").cast("string") == F.col("_k"), "left")
        .join(by_id, F.col("prot_id").cast("string") == F.col("_p"), "left")
        .withColumn("idx", F.coalesce("_by_key", "_by_id"))
        .drop("_k", "_p", "_by_key", "_by_id")
    )
    return found.join(bank.select("idx", F.col(vec).alias("vec")), "idx", "left")


def manifest_match(targets: DataFrame, manifest: DataFrame) -> DataFrame:
    """Token records per target, matched on key or id, with ``n_records``;
    one equi-join on tagged names instead of an OR join, so the manifest is read once."""
    t = targets.select("prot_id", "protein_key").distinct()
    m = manifest.select(
        F.col("prot_id").alias("m_prot_id"), F.col("protein_key").alias("m_protein_key"),
        "token_file", "length")

    def names(df: DataFrame, key: str, prot: str) -> DataFrame:
        each = F.explode(F.array(*[
            F.struct(F.lit(i).alias("_column"), F.col(c).cast("string").alias("_name")) for i, c in enumerate((key, prot))]))
        return df.select("*", each.alias("_n")).select(*df.columns, "_n.*").filter("_name is not null")

    on = ["_column", "_name"]
    hits = names(t, "protein_key", "prot_id").join(names(m, "m_protein_key", "m_prot_id"), on).drop(*on).distinct()
    counted = hits.groupBy("prot_id", "protein_key").agg(
        F.count("*").alias("n_records"), F.min("token_file").alias("token_file"), F.min("length").alias("length"))
    return t.join(counted, ["prot_id", "protein_key"], "left").withColumn(
        "n_records", F.coalesce("n_records", F.lit(0)))


def require_single_record(match: DataFrame) -> DataFrame:
    """The same rows, failing on a target without exactly one record."""
    one = F.col("n_records") == 1
    return match.filter(F.when(one, F.lit(True)).otherwise(F.raise_error(F.concat(
        F.lit("target "), F.col("protein_key").cast("string"), F.lit(" must match a single token record but matches "),
        F.col("n_records").cast("string"))).cast("boolean")))


def attach_metadata(hits: DataFrame, library: DataFrame, key: str = "drug_id") -> DataFrame:
    """Library columns for selected hits only.

    The library is cut to the selected ids before its columns move; a
    repeated library id is an error, as it would multiply hits.
    """
    selected = hits.select(key).distinct()
    narrow = library.join(selected, key, "left_semi")
    per_key = narrow.groupBy(key).agg(
        F.count("*").alias("_n"),
        F.min(F.struct(*[c for c in library.columns if c != key])).alias("_meta"))
    checked = per_key.filter(F.when(F.col("_n") == 1, F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("library repeats id "), F.col(key).cast("string"))).cast("boolean")))
    return hits.join(checked.select(key, "_meta.*"), key, "left")


def selected_ids(*hits: DataFrame, key: str = "drug_id") -> DataFrame:
    out = hits[0].select(key)
    for other in hits[1:]:
        out = out.unionByName(other.select(key))
    return out.distinct()


def incremental_todo(entities: DataFrame, done: DataFrame, key: str, overwrite: bool = False) -> DataFrame:
    """Entities whose output does not exist yet."""
    return entities if overwrite else entities.join(done.select(key), key, "left_anti")


def keep_first(df: DataFrame, keys: Sequence[str], row_id: str) -> DataFrame:
    """First row per key in the given order."""
    return first_per_key(df, keys, [F.col(row_id)])


def union_ids(*frames: DataFrame, key: str) -> DataFrame:
    return selected_ids(*frames, key=key)


def semi_filter(df: DataFrame, column: Column, values: Sequence[str], what: str) -> DataFrame:
    """Rows whose column is in a list; an empty result is an error."""
    out = df.filter(column.cast("string").isin([str(v) for v in values]))
    if out.isEmpty():
        raise ValueError(f"no {what} matched")
    return out


def select_targets(targets: DataFrame, pdb_ids: Sequence[str]) -> DataFrame:
    wanted = [v.strip() for v in pdb_ids if v.strip()]
    return semi_filter(targets, F.col("pdb_id"), wanted, "targets") if wanted else targets
