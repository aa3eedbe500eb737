"""Typed scans: compound exports, pair tables and feature banks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairscreen.functions.text import clean_text
from pairscreen.functions.vectors import PREFERRED_VECTOR_COLUMNS
from pairscreen.operators.joins import alias_index
from pairscreen.operators.ordering import number_rows
from pairscreen.sources.records import quoted_records

# Export headers and the names their columns take ----------------
EXPORT_COLUMNS = {
    "Compound ChEMBL ID": "chembl_id",
    "Name": "name",
    "Type": "type",
    "Max Phase": "max_phase",
    "Molecular Weight": "chembl_mw",
    "Targets": "targets",
    "Bioactivities": "bioactivities",
    "AlogP": "chembl_alogp",
    "Polar Surface Area": "chembl_tpsa",
    "HBA": "chembl_hba",
    "HBD": "chembl_hbd",
    "#RO5 Violations": "chembl_ro5_violations",
    "#Rotatable Bonds": "chembl_rotb",
    "Structure Type": "structure_type",
    "Inorganic Flag": "inorganic_flag",
    "Heavy Atoms": "chembl_heavy_atoms",
    "Smiles": "SMILES",
    "Inchi Key": "inchi_key",
    "Withdrawn Flag": "withdrawn_flag",
}
# Cells that read as missing.
MISSING_CELLS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
                 "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
PAIR_SCHEMA = T.StructType([
    T.StructField("drug_id", T.StringType()), T.StructField("prot_id", T.StringType()),
    T.StructField("label", T.StringType()), T.StructField("prot_domain", T.StringType())])
# --------------------------------------------------------------------------------


def scan_compounds(spark: SparkSession, path: str, columns: Sequence[str] | None = None,
                   line_breaks: bool = False) -> DataFrame:
    """A ``;``-separated, quoted compound export as cleaned text columns.

    ``columns`` names the cells of files without a header line, such as parts
    that many tasks wrote; left out, each file's header line is read.
    Surplus cells of a line are ignored and short lines are padded with
    missing cells. ``line_breaks`` reads files whose quoted cells hold line
    breaks (``records.quoted_records``), still split by split, at the cost of
    writing the lines once.
    """
    header = list(columns) if columns else (
        spark.read.options(sep=";", header=True, quote='"').csv(path).columns)
    missing = [c for c in EXPORT_COLUMNS if c not in header]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(header))])
    options = {"sep": ";", "quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    if line_breaks:
        cells = F.from_csv("value", ", ".join(f"{f.name} STRING" for f in schema.fields), options)
        raw = quoted_records(spark, path, ";", header=columns is None).select(cells.alias("c")).select("c.*")
    else:
        raw = spark.read.schema(schema).options(header=columns is None, enforceSchema=True, **options).csv(path)
    return raw.select(*[
        _cell(f"c{header.index(source)}").alias(name) for source, name in EXPORT_COLUMNS.items()])


def _cell(name: str):
    c = F.col(name)
    return clean_text(F.when(~c.isin(*MISSING_CELLS), c))


def scan_pairs(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Pair rows with text ids; labels are checked by the pair operators."""
    if fmt == "csv":
        head = spark.read.option("header", True).csv(path).columns
        extra = [T.StructField(c, T.StringType()) for c in head if c not in PAIR_SCHEMA.names]
        by_name = {f.name: f for f in [*PAIR_SCHEMA.fields, *extra]}
        return spark.read.schema(T.StructType([by_name[c] for c in head])).option("header", True).csv(path)
    return spark.read.format(fmt).load(path)


def scan_projected(spark: SparkSession, path: str, columns: Sequence[str], fmt: str = "parquet") -> DataFrame:
    """Only the named columns; a columnar source reads nothing else."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.load(path).select(*columns)


def pick_vector_column(df: DataFrame) -> str:
    """The vector column of a bank: the best-known name among its numeric
    arrays, else the first."""
    numeric = (T.FloatType, T.DoubleType, T.IntegerType, T.LongType, T.ShortType, T.ByteType)
    found = [f.name for f in df.schema.fields
             if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, numeric)]
    if not found:
        raise ValueError("the bank has no vector column")
    known = {name: i for i, name in enumerate(PREFERRED_VECTOR_COLUMNS)}
    return min(found, key=lambda n: known.get(n, len(known)))


def scan_bank(df: DataFrame, aliases: Sequence[str] = (), order: str | None = None) -> DataFrame:
    """``idx, <aliases>, vec`` from a table with a vector column.

    ``order`` names the unique column that fixes row order, by default the
    first alias. ``idx`` only has to be unique and follow that order, so a
    whole-number column serves as it is and the vectors stay in place; any
    other kind is numbered, keys first. A bank without alias columns answers
    to its row number.
    """
    vec = pick_vector_column(df)
    order = order or (aliases[0] if aliases else None)
    if order is None:
        raise ValueError("name an order column for a bank without aliases")
    names = list(aliases) or ["row_key"]
    if aliases and isinstance(df.schema[order].dataType, T.IntegralType):
        numbered = df.withColumn("idx", F.col(order).cast("bigint"))
    else:
        positions = number_rows(df.select(order), [], [order], "idx")
        numbered = df.join(positions, order)
    if not aliases:
        numbered = numbered.withColumn("row_key", F.col("idx").cast("string"))
    return numbered.select("idx", *names, F.col(vec).cast("array<float>").alias("vec"))


def bank_index(bank: DataFrame) -> DataFrame:
    """Alias keys of a scanned bank."""
    return alias_index(bank, [c for c in bank.columns if c not in ("idx", "vec")])


def scan_manifest(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Token records ``prot_id, protein_key, length, token_file, embedding_dim``."""
    return scan_projected(
        spark, path, ["prot_id", "protein_key", "length", "token_file", "embedding_dim"], fmt)
